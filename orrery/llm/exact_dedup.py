"""Exact de-duplication by an exchange of Golomb-coded fingerprints.

Each sender (a run of rows of one scan partition) splits its sorted distinct fingerprints by owner, codes the gaps
and sends them; an owner merges what it received and answers each sender with a bitmap of the fingerprints that
occur more than once. The bits return to the rows as notes beside the files, which the task that scans a row reads.
Only suspects are normalised again and travel as text: they are grouped by their bytes, so a fingerprint that two
texts share by chance joins nothing. Copies combine before the shuffle, so a hot group is one row per task. The plan
is the same at any size, and no text but a suspect's leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import forget, leave_notes, materialize, notes_of, placed, table, tidy

#: Bits of a fingerprint: with 3e10 texts one in 10,000 is suspected by chance, which verification settles.
BITS = 48
#: Rows of one sender's message set, and fingerprints that an owner merges on average.
SENDER_ROWS, OWNER_ROWS = 1 << 17, 1 << 21


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes]:
    """Golomb-Rice code: the unary quotients of all gaps, then their k-bit remainders."""
    if gaps.size == 0:
        return 0, b""
    k = max(0, int(math.log2(max(1.0, float(gaps.mean()) * math.log(2)))))
    stops = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.ones(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(k: int, blob: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    rest_bytes = (n * k + 7) // 8
    raw = np.frombuffer(blob, np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[: raw.size - rest_bytes]) == 0)[:n]
    gaps = np.diff(stops, prepend=-1).astype(np.uint64) - np.uint64(1)
    if k:
        bits = np.unpackbits(raw[raw.size - rest_bytes :])[: n * k].reshape(n, k)
        weights = np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)
        gaps = (gaps << np.uint64(k)) + (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return gaps


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty. Plain byte replacements run at memory speed."""
    out = F.coalesce(text, F.lit(""))
    for code in (32, 9, 10, 11, 12, 13):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


_SENT = "chunk long, owner long, n long, k int, code binary, local binary, docs array<struct<id: long, file: long, row: long, slot: int, sha: binary>>"


def _send(owners: int, bits: int):
    def messages(held: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        ids, files, places, shas = (pa.concat_arrays([b.column(k) for b in held]) for k in range(4))
        raw = np.frombuffer(b"".join(shas.to_pylist()), dtype=">u8").reshape(-1, 4)[:, 0].astype(np.uint64)
        fp = raw >> np.uint64(64 - bits)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        owner = (fp * np.uint64(owners)) >> np.uint64(bits)
        first = np.concatenate([[True], fp[1:] != fp[:-1]])
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows: dict[str, list] = {x: [] for x in ("owner", "n", "k", "code", "local")}
        slots = np.zeros(fp.size, np.int32)
        for a, b in zip(cuts, [*cuts[1:], fp.size], strict=True):
            slots[a:b] = np.cumsum(first[a:b]) - 1
            values = fp[a:b][first[a:b]]
            k, code = golomb_encode(np.diff(values, prepend=np.uint64(0)))
            local = np.bincount(slots[a:b]) > 1
            for x, v in zip(rows, (int(owner[a]), values.size, k, code, np.packbits(local).tobytes()), strict=True):
                rows[x].append(v)
        order = pa.array(order)
        docs = pa.StructArray.from_arrays([ids.take(order), files.take(order), places.take(order), pa.array(slots), shas.take(order).cast(pa.binary())], names=["id", "file", "row", "slot", "sha"])
        lists = pa.ListArray.from_arrays(pa.array([*cuts, fp.size], pa.int32()), docs)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk] * len(cuts), pa.int64()), pa.array(rows["owner"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["k"], pa.int32()), pa.array(rows["code"], pa.binary()), pa.array(rows["local"], pa.binary()), lists],
            names=["chunk", "owner", "n", "k", "code", "local", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SENDER_ROWS:
                yield messages(held, (part << 32) + seq)
                held, seq = [], seq + 1
        if held:
            yield messages(held, (part << 32) + seq)

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """The owner's side: for each message the bitmap of its fingerprints that it or another message has again."""
    got = [np.cumsum(golomb_decode(k, code, n)) for k, code, n in zip(*(rows[x].to_pylist() for x in ("k", "code", "n")), strict=True)]
    values, times = np.unique(np.concatenate(got), return_counts=True)
    again = values[times > 1]
    marks = []
    for x, local in zip(got, rows["local"].to_pylist(), strict=True):
        own = np.unpackbits(np.frombuffer(local, np.uint8))[: x.size].astype(bool)
        marks.append(np.packbits(own | np.isin(x, again)).tobytes())
    return pa.table({"chunk": rows["chunk"], "owner": rows["owner"], "marks": pa.array(marks, pa.binary())})


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docs, marks in zip(batch.column("docs"), batch.column("marks"), strict=True):
            inner = docs.values
            bits = np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8)).astype(bool)
            slots = inner.field("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([*(inner.field(x) for x in ("id", "file", "row", "sha")), pa.array(bits[slots])], names=["id", "file_at", "row_at", "sha", "suspect"])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Null texts count as empty, and all texts that normalise to nothing are equal. Of equal texts the row with the
    most code points stays, then the one with the smallest id; a null id comes last. Rows that share both id and
    text are one document: each counts in group_size, and all are kept or none. A row with a null id is kept only
    if it is alone. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    source = placed(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "texts")
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    owners = max(8, -(-docs.count() // OWNER_ROWS))
    hashed = source.select("id", "file_at", "row_at", normalised(F.col("text")).alias("norm")).select("id", "file_at", "row_at", sha)
    sent = materialize(hashed.mapInArrow(tidy(_send(owners, bits)), _SENT), "sent")
    answers = sent.select("chunk", "owner", "n", "k", "code", "local").groupBy("owner").applyInArrow(_answer, "chunk long, owner long, marks binary")
    marked = sent.select("chunk", "owner", "docs").join(answers, ["chunk", "owner"]).select("docs", "marks")
    marked = materialize(marked.mapInArrow(tidy(_marked), "id long, file_at long, row_at long, sha binary, suspect boolean"), "marked")
    forget(sent)
    notes = leave_notes(marked.where("suspect").select("file_at", "row_at", F.lit(1).cast("long").alias("note")), "suspects")
    noted = notes_of(notes)
    # Byte verification: suspects travel as text and meet only those of the same bytes.
    suspects = source.withColumn("note", noted("file_at", "row_at")).where("note is not null").select("id", F.length("text").cast("long").alias("chars"), normalised(F.col("text")).alias("norm"))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("id")))
    verified = suspects.select("id", "chars", "norm", sha).groupBy("sha", "norm").agg(F.count("*").alias("size"), best.alias("best"))
    groups = materialize(verified.where("size > 1").select("sha", "size", F.col("best.id").alias("keep_id")), "groups")
    forget(notes)
    # Digests only; what is no suspect needs no partner, and adaptive execution splits the digest of a hot group.
    alone = marked.where("not suspect").select("id", "sha", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("keep_id"))
    out = marked.where("suspect").select("id", "sha").join(groups, "sha", "left").select("id", "sha", "size", "keep_id").union(alone)
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("size").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == keep, F.lit(False))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(replace(replace(replace(replace(replace(replace(coalesce(text, ''), ' ', ''), chr(9), ''), chr(10), ''), chr(11), ''), chr(12), ''), chr(13), '')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
