"""Substring de-duplication by line or paragraph hashing.

A text is cut into units that add up to it: lines, paragraphs, or lines cut further at sentence ends (the default, so
that a passage that begins or ends within a line is found as well). Units are normalised, their digests grouped over
all documents, and the occurrence with the smallest (id, place) stays. Of the others those go that stand in a run of
repeated units with enough words together; they are reported by their offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialize, meet, table, tidy

#: Words that a run of repeated units must have together to go: shorter ones recur by chance, or as a title or a mark of a source. 1: all repeats go.
RUN_WORDS = 16
#: No unit reaches over the start of a line, so equal lines have equal units whatever stands before them.
UNITS = {"sentence": r"[^.!?\n]+[.!?]*\n*|[.!?]+\n*|\n+", "line": r"[^\n]*\n+|[^\n]+", "paragraph": r"(?s:.+?)(?:\n[ \t]*\n\s*|\Z)"}
_SCHEMA = "doc_id long, row long, n_units long, n_chars long, starts array<int>, ends array<int>, words array<int>, again array<boolean>, d1 array<long>, d2 array<long>"


def _cut(unit: str):
    """The units that have words: offsets, numbers of words, whether an equal one stands before in the text, and digests."""
    pattern = re.compile(UNITS[unit])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, chars, ends, digests = [], [], [0], []
            cols: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                seen, n = set(), 0
                for m in pattern.finditer(text):
                    n += 1
                    words = m.group().encode("utf-8", "surrogatepass").lower().split()
                    if words:
                        d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                        for c, v in zip(cols, (m.start(), m.end(), len(words), d in seen), strict=True):
                            c.append(v)
                        digests.append(d)
                        seen.add(d)
                counts.append(n)
                chars.append(len(text))
                ends.append(len(digests))
            pairs = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            values = [*(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(chars, pa.int64()), *lists], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return run


def _runs(least: int):
    """The spans of the repeated units of a text (hits) that stand in runs with least words or more."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed = []
            for s, e, w, hits in zip(*(batch.column(k).to_pylist() for k in ("starts", "ends", "words", "hits")), strict=True):
                spans, k, hits = [], 0, sorted(hits or [])
                while k < len(hits):
                    stop = k + 1
                    while stop < len(hits) and hits[stop] == hits[stop - 1] + 1:
                        stop += 1
                    if sum(w[i] for i in hits[k:stop]) >= least:
                        spans += [{"start": s[i], "end": e[i]} for i in hits[k:stop]]
                    k = stop
                removed.append(spans)
            kept = [c - sum(x["end"] - x["start"] for x in r) for c, r in zip(batch.column("n_chars").to_pylist(), removed, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_units"), pa.array([len(r) for r in removed], pa.int64()), pa.array(kept, pa.int64()), pa.array(removed, kind)], names=["doc_id", "row", "n_units", "n_removed", "kept_chars", "removed"])

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, row, n_units, n_removed, kept_chars, removed) per row of docs; removed: sorted offsets (start, end) of the text, row: a hash of it.

    Units are equal if their words are, after lower-casing A-Z, whatever ASCII white space parts them. A unit is
    repeated if an equal one has a smaller (id, place). Repeated units go where they stand in a run of them, units
    without words aside, that has run_words words or more. Null and empty texts have no units. A row with a null id
    takes no part and loses nothing. Rows that share an id have one rank: of a unit that stays there, each of them
    keeps its first; a row's spans are always of its own text. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("row"), "text")
    cut = materialize(source.mapInArrow(tidy(_cut(unit)), _SCHEMA), "units")
    each = cut.where("doc_id is not null").select("doc_id", "row", F.posexplode(F.arrays_zip("again", "d1", "d2")).alias("at", "u")).select("doc_id", "row", "at", "u.*")
    first = each.where("not again").groupBy("d1", "d2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"), F.count("*").alias("m")).where("keeper <> other")
    first = materialize(first.select("d1", "d2", "keeper", "m"), "keepers")
    units = cut.where("doc_id is not null").agg(F.coalesce(F.sum(F.size("again")), F.lit(0)).alias("n")).first().n
    later = meet(each.where("not again").drop("again"), first, ["d1", "d2"], units).where("doc_id <> keeper").select("doc_id", "row", "at")
    hits = later.union(each.where("again").select("doc_id", "row", "at")).groupBy("doc_id", "row").agg(F.collect_set("at").alias("hits"))
    out = cut.select("doc_id", "row", "n_units", "n_chars", "starts", "ends", "words").join(hits, ["doc_id", "row"], "left")
    return out.mapInArrow(tidy(_runs(run_words)), "doc_id long, row long, n_units long, n_removed long, kept_chars long, removed array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", run_words: int = RUN_WORDS) -> DataFrame:
    """The columns of docs with the repeats of repeated_units cut out of the text, and removed_spans, their offsets in the original one, null if none.

    Rows meet their spans by id and text, so rows that share an id with other texts keep their own; repeated rows are
    cut alike. Null and empty texts and rows with a null id stay as they are; an empty table gives no rows; a column
    named removed_spans is replaced."""
    found = repeated_units(docs, id_col, text_col, unit, run_words).where("n_removed > 0")
    spans = found.select(F.col("doc_id").alias("__span_id"), F.col("row").alias("__span_row"), F.col("removed").alias("__spans")).dropDuplicates(["__span_id", "__span_row"])
    kept = [c for c in docs.columns if c not in (text_col, "removed_spans")]
    text = F.col(text_col).cast("string")
    joined = docs.select(*kept, text_col).join(spans, (F.col(id_col).cast("long") == F.col("__span_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__span_row")), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def part(acc, x):
        return F.struct(x["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]))).alias("parts"))

    rest = F.aggregate("__spans", start, part, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select(*kept, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(rest).alias(text_col), F.col("__spans").alias("removed_spans"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_units(table(spark, sf_dir, "documents"))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return out.select("doc_id", "n_units", "n_removed", "kept_chars", F.array_join(spans, ",").alias("removed_spans"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = {
    "op9_line_dedup": rf"""
WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_extract_all(coalesce(text, ''), '{UNITS["sentence"]}') AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS pos FROM p),
y AS (SELECT doc_id, pos, length(raw) AS n, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "end",
             regexp_extract_all(translate(raw, '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, pos) > 1 AS again FROM y WHERE len(words) > 0),
r AS (SELECT *, sum((NOT again)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM z),
s AS (SELECT *, sum(CASE WHEN again THEN len(words) ELSE 0 END) OVER (PARTITION BY doc_id, run) AS total FROM r),
g AS (SELECT doc_id, count(*) AS n_removed, sum(n)::BIGINT AS lost, string_agg(("end" - n)::VARCHAR || '-' || "end"::VARCHAR, ',' ORDER BY pos) AS removed_spans
      FROM s WHERE again AND total >= {RUN_WORDS} GROUP BY doc_id)
SELECT p.doc_id, len(parts) AS n_units, coalesce(n_removed, 0) AS n_removed, chars - coalesce(lost, 0) AS kept_chars, coalesce(removed_spans, '') AS removed_spans
FROM p LEFT JOIN g ON p.doc_id = g.doc_id
""",
}
