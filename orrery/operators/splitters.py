"""Splitting items into parts, and turning dict items into lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_split(text: Column) -> Column:
    return F.array(text)


def by_separators(text: Column, separators: list[str]) -> Column:
    """Non-empty pieces between any of the separators."""
    return F.filter(F.split(text, "|".join(re.escape(s) for s in separators)), lambda p: F.length(F.trim(p)) > 0)


def by_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def by_fields(payload: Column, fields: list[str]) -> Column:
    """The values of a JSON object's fields, those that are there."""
    return F.filter(F.array(*[F.get_json_object(payload, f"$.{f}") for f in fields]), lambda x: x.isNotNull())


def combined_fields(line: Column, fields: list[str]) -> Column:
    """The `name: "value"` pieces of a combined line."""
    return by_pattern(line, "(?:" + "|".join(re.escape(f) for f in fields) + r'): "(?:[^"\\]|\\.)*"')


_CODE, _LIST = re.compile(r"```.*?```", re.DOTALL), re.compile(r"(?m)^\s*\d+[.)]\s.*(?:\n\s*\d+[.)]\s.*)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def sentences(text: str | None) -> list[str]:
    """Sentences; code blocks and numbered lists stay whole."""
    out, at, text = [], 0, text or ""
    whole = sorted((m.span() for p in (_CODE, _LIST) for m in p.finditer(text)))
    for a, b in [*whole, (len(text), len(text))]:
        if a < at:
            continue
        out += [s.strip() for s in _SENTENCE.split(text[at:a]) if s.strip()]
        if b > a:
            out.append(text[a:b].strip())
        at = b
    return out


def split_sentences(col: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(sentences)

    return run(col)


def words_of(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def group_tokens(col: Column, budget: int) -> Column:
    """An array of pieces joined by blanks while they fit the budget of words; a piece over it is cut at words, which then join."""
    unit = lambda text, size: F.struct(text.alias("text"), size.alias("size"))
    units = F.flatten(F.transform(col, lambda p: F.when(F.size(words_of(p)) <= budget, F.array(unit(p, F.size(words_of(p))))).otherwise(F.transform(words_of(p), lambda w: unit(w, F.lit(1))))))
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("out"), F.array().cast(texts).alias("held"), F.lit(0).alias("used"))

    def add(acc: Column, u: Column) -> Column:
        full = (acc["used"] + u["size"] > budget) & (F.size(acc["held"]) > 0)
        out = F.when(full, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])
        held = F.when(full, F.array(u["text"])).otherwise(F.concat(acc["held"], F.array(u["text"])))
        return F.struct(out.alias("out"), held.alias("held"), F.when(full, u["size"]).otherwise(acc["used"] + u["size"]).alias("used"))

    done = lambda acc: F.when(F.size(acc["held"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])
    return F.coalesce(F.aggregate(units, start, add, done), F.array().cast(texts))


def split_items(items: DataFrame, parts: Column, id_col: str = "item_id") -> DataFrame:
    """One row per part: part_id `<id>:<i>`, item_id, part_index, part."""
    return items.select(F.col(id_col).cast("string").alias("item_id"), F.posexplode(parts).alias("part_index", "part")).select(F.concat_ws(":", "item_id", F.col("part_index").cast("string")).alias("part_id"), "item_id", "part_index", "part")


def average_parts(parts: DataFrame) -> DataFrame:
    """Rows (object_id, vector) to one part `<object>:average` with the mean of each object's vectors."""
    each = parts.select("object_id", F.posexplode(F.col("vector").cast("array<double>")).alias("i", "x"))
    mean = each.groupBy("object_id", "i").agg(F.avg("x").alias("x"))
    out = mean.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return out.select("object_id", F.concat_ws(":", F.col("object_id").cast("string"), F.lit("average")).alias("part_id"), F.transform("v", lambda s: s["x"]).alias("vector"), F.lit(True).alias("is_average"))


def dict_line(fields: dict[str, Column]) -> Column:
    """`name: "value"` pieces in order of names, joined by blanks; null values are left out."""
    return F.concat_ws(" ", *[F.when(fields[k].isNotNull(), F.concat(F.lit(f'{k}: "'), fields[k].cast("string"), F.lit('"'))) for k in sorted(fields)])


def json_line(fields: dict[str, Column], rename: dict[str, str] | None = None) -> Column:
    return F.to_json(F.struct(*[c.alias((rename or {}).get(k, k)) for k, c in fields.items()]))


def normalise_fields(df: DataFrame, id_field: str, item_field: str) -> DataFrame:
    """The id as text under item_id and the item under item."""
    return df.withColumnRenamed(item_field, "item").withColumn("item_id", F.col(id_field).cast("string"))


def remap_sessions(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (session_id, id, ...) with each id's part ids (item_id, part_id) in its place, the id itself kept as group_id; ids without parts drop out."""
    each = parts.select(F.col("item_id").alias("group_id"), "part_id")
    rest = [c for c in rows.columns if c not in ("id", "group_id")]
    return rows.drop("group_id").withColumnRenamed("id", "group_id").join(each, "group_id").select(*rest, "group_id", F.col("part_id").alias("id"))
