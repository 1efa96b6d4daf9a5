"""Full-text helpers: tokens, text queries and phrase chunks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"
#: A phrase's chunks are words, numbers or single marks; at most 20 are kept.
CHUNK = r"(?U)\w+|\d+|[^\w\s]"
MAX_CHUNKS = 20


def tokens(col: Column) -> Column:
    """Lower-cased words; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def chunks(col: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(CHUNK), F.lit(0)), F.array().cast("array<string>"))


def split_words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def split_chunks(text: str) -> list[str]:
    return re.findall(r"\w+|\d+|[^\w\s]", text.lower())


def has_prefix(toks: Column, prefix: str) -> Column:
    return F.exists(toks, lambda t: t.startswith(prefix))


def has_phrase(toks: Column, words: list[str]) -> Column:
    """The words stand in a row among the tokens."""
    if not words:
        return F.lit(False)
    sep = "\u0001"
    return F.concat(F.lit(sep), F.array_join(toks, sep), F.lit(sep)).contains(sep + sep.join(words) + sep)


def text_query(toks: Column, query: str) -> Column:
    """Words, prefixes (word:*), &, |, ! and parentheses; words side by side are joined by &."""
    parts = re.findall(r"\w+(?::\*)?|[&|!()]", query.lower())
    if re.sub(r"\w+(?::\*)?|[&|!()]|\s", "", query.lower()):
        raise ValueError(f"text query {query!r} has characters that are no part of the language")
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(parts) and parts[at] not in ("|", ")"):
            at += parts[at] == "&"
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"text query {query!r} ends too early")
        part, at = parts[at], at + 1
        if part == "!":
            return ~one()
        if part == "(":
            inner = either()
            if at >= len(parts) or parts[at] != ")":
                raise ValueError(f"text query {query!r} lacks a parenthesis")
            at += 1
            return inner
        if part in "&|)":
            raise ValueError(f"text query {query!r} has {part!r} where a word is expected")
        if part.endswith(":*"):
            return has_prefix(toks, part[:-2])
        return F.array_contains(toks, part)

    if not parts:
        return F.lit(False)
    out = either()
    if at != len(parts):
        raise ValueError(f"text query {query!r} has {parts[at]!r} too many")
    return out


#: Marks that join the chunk before them, and marks that join those on both sides.
LEFT_MARKS, BOTH_MARKS = ".,!?:;)]}", "-/"


def glue(col: Column) -> Column:
    """Chunks back to a phrase: no blank before closing marks, and none on either side of a hyphen or slash.

    A mark that follows a hyphen or slash is taken as its right side; one that begins a phrase stands alone."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("glued"))

    def add(acc: Column, chunk: Column) -> Column:
        left, both = chunk.isin(*LEFT_MARKS), chunk.isin(*BOTH_MARKS)
        joins = acc["glued"] | ((left | both) & (acc["text"] != ""))
        text = F.when(joins | (acc["text"] == ""), F.concat(acc["text"], chunk)).otherwise(F.concat(acc["text"], F.lit(" "), chunk))
        return F.struct(text.alias("text"), (both & ~acc["glued"] & (acc["text"] != "")).alias("glued"))

    return F.aggregate(col, start, add, lambda acc: acc["text"])
