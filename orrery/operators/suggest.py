"""Autocompletion over phrases (phrase, prob, labels, domains). A request is the chunks found so far and the start of the next."""

from __future__ import annotations

import re
from dataclasses import dataclass
from difflib import get_close_matches
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

#: Least difflib ratio of a chunk that counts as a misspelt word.
CLOSE = 0.8


@dataclass(frozen=True)
class Request:
    found: tuple[str, ...]
    next: str | None


def request(phrase: str) -> Request:
    """Lower-cased chunks, the last 20; without a blank at the end the last one is still being typed."""
    parts = T.split_chunks(phrase)[-T.MAX_CHUNKS :]
    if parts and not phrase[-1].isspace():
        return Request(tuple(parts[:-1]), parts[-1])
    return Request(tuple(parts), None)


def phrase_documents(phrases: DataFrame) -> DataFrame:
    """With phrase_id (md5) and chunks; phrases of more than 20 chunks are left out, of equal ones the most probable stays."""
    docs = phrases.withColumn("chunks", T.chunks(F.col("phrase"))).withColumn("phrase_id", F.md5("phrase"))
    docs = docs.where(F.size("chunks").between(1, T.MAX_CHUNKS))
    rest = [c for c in docs.columns if c != "phrase_id"]
    return docs.groupBy("phrase_id").agg(F.max_by(F.struct(*rest), F.col("prob")).alias("r")).select("phrase_id", "r.*")


def _same(chunk: Column, word: str, soft: bool) -> Column:
    return F.levenshtein(chunk, F.lit(word)) <= 1 if soft else chunk == word


def _starts(chunk: Column, word: str, soft: bool) -> Column:
    return (F.levenshtein(F.substring(chunk, 1, len(word)), F.lit(word)) <= 1) if soft else chunk.startswith(word)


def simple_match(word: str, soft: bool = False) -> Column:
    """The first chunk starts with word."""
    return _starts(F.element_at("chunks", 1), word, soft)


def shifted_match(found: tuple[str, ...], next_: str | None = None, soft: bool = False) -> Column:
    """For some number of leading chunks left off, the phrase goes on from the rest of what was found."""
    tests = []
    for i in range(len(found)):
        tail = found[i:]
        test = F.size("chunks") >= len(tail) + (next_ is not None)
        for k, word in enumerate(tail):
            test = test & _same(F.get("chunks", F.lit(k)), word, soft)
        if next_ is not None:
            test = test & _starts(F.get("chunks", F.lit(len(tail))), next_, soft)
        tests.append(F.coalesce(test, F.lit(False)))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def match(req: Request, soft: bool = False, domain: str | None = None) -> Column:
    """The generator is chosen by what the request has."""
    if req.found and req.next is not None:
        test = shifted_match(req.found, req.next, soft) | simple_match(req.next, soft)
    elif req.found:
        test = shifted_match(req.found, None, soft)
    elif req.next is not None:
        test = simple_match(req.next, soft)
    else:
        test = F.lit(True)
    return test if domain is None else test & F.array_contains("domains", domain)


def diverse(docs: DataFrame, order: Column) -> DataFrame:
    """Drops repeated phrases and keeps a phrase only if it brings a label that none before it had; without labels it never stays.

    order, smallest first, tells phrases apart. A label is new exactly at the first phrase that carries it, so two
    groupings replace the sequential walk and no task orders all phrases."""
    rest = docs.columns
    first = docs.withColumn("_order", order).groupBy("phrase").agg(F.min_by(F.struct(*rest), "_order").alias("_r"), F.min("_order").alias("_order"))
    first = first.select("_r.*", "_order")
    new = first.select("_order", F.explode("labels").alias("label")).groupBy("label").agg(F.min("_order").alias("_order")).select("_order").distinct()
    return first.join(new, "_order", "left_semi").drop("_order")


def suggest(docs: DataFrame, phrase: str, k: int = 10, domain: str | None = None, soft: bool = True, window: int = 100) -> DataFrame:
    """The k best suggestions: strict matches first, and where those are fewer than k also near ones; by probability.

    Only the window * k most probable of each tier compete, so what is ranked is bounded by the request."""
    req = request(phrase)
    cols = ["phrase_id", "phrase", "chunks", "prob", "labels", "domains"]
    strict = docs.where(match(req, False, domain)).select(*cols, F.lit(0).alias("tier")).orderBy(F.desc("prob"), "phrase").limit(window * k)
    both = strict
    if soft and (req.found or req.next is not None):
        near = docs.where(match(req, True, domain) & ~match(req, False, domain)).select(*cols, F.lit(1).alias("tier")).orderBy(F.desc("prob"), "phrase").limit(window * k)
        n = strict.agg(F.count("*").alias("n"))
        both = strict.unionByName(near.crossJoin(F.broadcast(n)).where(F.col("n") < k).drop("n"))
    order = [F.col("tier"), F.desc("prob"), F.col("phrase")]
    return diverse(both, F.struct(F.col("tier"), -F.col("prob"), F.col("phrase"))).orderBy(*order).limit(k).select("phrase", "prob", "tier", "labels")


def _close_position(word: str):
    def run(chunks: pd.Series) -> pd.Series:
        found = []
        for row in chunks:
            row = [] if row is None else list(row)
            near = get_close_matches(word, row, n=1, cutoff=CLOSE)
            found.append(row.index(near[0]) + 1 if near else 0)
        return pd.Series(found, dtype="int32")

    return F.pandas_udf(run, "int")


def match_position(chunks: Column, word: str) -> Column:
    """Where word stands among chunks, from 0: the first equal one, else the first that starts with it, else the closest
    one by difflib if its ratio is CLOSE or more, else the last."""
    exact = F.array_position(chunks, word)
    start = F.array_position(F.transform(chunks, lambda c: c.startswith(word)), True)
    close = _close_position(word)(F.when((exact == 0) & (start == 0), chunks))
    place = F.when(exact > 0, exact).when(start > 0, start).when(close > 0, close).otherwise(F.size(chunks))
    return (place - 1).cast("int")


def aligned(chunks: Column, position: Column) -> list[Column]:
    """prefix, match and postfix of a suggestion around the matched chunk, each glued to text."""
    before = F.slice(chunks, F.lit(1), position)
    after = F.slice(chunks, position + 2, F.size(chunks))
    return [T.glue(before).alias("prefix"), F.get(chunks, position).alias("match"), T.glue(after).alias("postfix")]


def by_phrase_id(docs: DataFrame, phrase_id: str) -> DataFrame:
    return docs.where(F.col("phrase_id") == phrase_id)


def by_phrase(docs: DataFrame, phrase: str) -> DataFrame:
    return docs.where(F.col("phrase") == phrase)


#: Longest text of which a fuzzy pattern is made; its length grows with the square.
FUZZY_CHARS = 64


def fuzzy_pattern(text: str) -> str:
    """A pattern for texts that begin with text, where one character may be any one or two letters; case plays no part.

    Of a single character only that one."""
    if len(text) > FUZZY_CHARS:
        raise ValueError(f"a fuzzy pattern is of {FUZZY_CHARS} characters at most")
    if len(text) < 2:
        return f"(?i)^{re.escape(text)}" if text else ""
    each = [re.escape(text[:i]) + "[a-zA-Z]{1,2}" + re.escape(text[i + 1 :]) for i in range(len(text))]
    return f"(?i)^(?:{'|'.join(each)})"


def quality(chunk: Column, word: str, whole: bool = False) -> Column:
    """3 for an equal chunk, 2 for one that starts with word, 1 for one that fuzzily does, else 0; whole: only 3, or 1 for a near word."""
    fuzzy = chunk.rlike(fuzzy_pattern(word) + ("$" if whole else ""))
    rank = F.when(chunk == word, 3)
    if not whole:
        rank = rank.when(chunk.startswith(word), 2)
    return F.coalesce(rank.when(fuzzy, 1).otherwise(0), F.lit(0))


def _best(ranked: DataFrame, keys: list[Column], names: list[str], k: int) -> DataFrame:
    """Of each group of keys and labels the most probable phrase, then the shorter, by rank, probability and length."""
    row = F.struct(F.col("prob"), (-F.length("phrase")).alias("l"), F.col("phrase"))
    got = ranked.where("rank > 0").groupBy(*[c.alias(n) for c, n in zip(keys, names, strict=True)], "labels")
    best = got.agg(F.max("rank").alias("rank"), F.max(row).alias("b")).select(*names, "rank", F.col("b.prob").alias("prob"), F.col("b.phrase").alias("phrase"))
    return best.orderBy(F.desc("rank"), F.desc("prob"), F.length("phrase"), "phrase").limit(k)


def ranked_match(docs: DataFrame, word: str, k: int = 10) -> DataFrame:
    """The k best by the quality of their first chunk, one for each first chunk and labels."""
    return _best(docs.withColumn("rank", quality(F.element_at("chunks", 1), word)), [F.element_at("chunks", 1)], ["first"], k)


def ranked_prefix(docs: DataFrame, found: tuple[str, ...], k: int = 10) -> DataFrame:
    """The k best that begin with the chunks found, each equal or near, by the smallest quality of these; one for each next chunk and labels."""
    rank = F.least(*[quality(F.get("chunks", F.lit(i)), w, True) for i, w in enumerate(found)]) if len(found) > 1 else quality(F.get("chunks", F.lit(0)), found[0], True)
    return _best(docs.withColumn("rank", rank), [F.get("chunks", F.lit(len(found)))], ["next"], k)


def ranked_full(docs: DataFrame, found: tuple[str, ...], next_: str, k: int = 10) -> DataFrame:
    """The k best on a ladder: the whole of found and the start of the next chunk first, then ever shorter tails of found
    with it, at last the next chunk alone at the start of a phrase. Within a step the quality of the chunks decides."""
    ladder = []
    for i in range(len(found) + 1):
        tail = found[i:]
        tests = [quality(F.get("chunks", F.lit(n)), w, True) for n, w in enumerate(tail)] + [quality(F.get("chunks", F.lit(len(tail))), next_)]
        worst = F.least(*tests) if len(tests) > 1 else tests[0]
        ladder.append(F.when(worst > 0, worst + 3 * len(tail)).otherwise(0))
    rank = F.greatest(*ladder) if len(ladder) > 1 else ladder[0]
    return _best(docs.withColumn("rank", rank), [F.element_at("chunks", 1)], ["first"], k)


def update_probability(docs: DataFrame, phrase_id: str, prob: float) -> DataFrame:
    if not 0 <= prob <= 1:
        raise ValueError("a probability lies between 0 and 1")
    return docs.withColumn("prob", F.when(F.col("phrase_id") == phrase_id, prob).otherwise(F.col("prob")))


def edit_set(docs: DataFrame, column: str, values: list[str], phrase_id: str | None = None, remove: bool = False) -> DataFrame:
    """Adds to or removes from labels or domains, of one phrase or of all."""
    arr = F.array(*[F.lit(v) for v in values]).cast("array<string>")
    new = F.array_except(column, arr) if remove else F.array_union(column, arr)
    return docs.withColumn(column, new if phrase_id is None else F.when(F.col("phrase_id") == phrase_id, new).otherwise(F.col(column)))


def delete_phrases(docs: DataFrame, ids: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    gone = F.col("phrase_id").isin(ids or []) | F.col("phrase").isin(values or [])
    return docs.where(~gone)


def list_phrases(docs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return docs.orderBy("phrase", "phrase_id").offset(offset).limit(limit)
