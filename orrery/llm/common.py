"""Shared pieces of the training-data operators: tables, shared storage, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels handle at once; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"orrery-{os.getuid()}")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Hadoop's names of stores, and pyarrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a folder named as Hadoop names it."""
    scheme, mark, rest = uri.partition("://")
    if not mark and uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else uri)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder among those of shared_dir, for files that tasks write themselves."""
    folder = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    return folder


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that reach a Python task at once while a table is written.
BATCH_BYTES = 16 << 20


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives its free memory back at the end of a task: workers live on, and executors have little to spare."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not with every C library
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def materialize(df: DataFrame, tag: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage and survives lost executors.

    batch_bytes bounds the Arrow batches that Python tasks get meanwhile."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    try:
        spark.conf.set(_BATCH, str(batch_bytes))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before) if before else spark.conf.unset(_BATCH)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def forget(*written: DataFrame | str) -> None:
    """Deletes tables that materialize wrote, and folders, once nothing will read them again: not even a lost executor's work."""
    for x in written:
        path = x if isinstance(x, str) else x._shared_path
        spark = SparkSession.active()
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(id_col: str, modulus: int) -> Column:
    """True where crc32(id as text) mod modulus is 0; a null id counts as held out, so nothing is learnt from it."""
    key = F.col(id_col).cast("string").cast("binary")
    return F.coalesce(F.crc32(key) % modulus == 0, F.lit(True))


#: Keys that hold at least one row in HEAVY are sent to all tasks; there can't be more than this number of them.
HEAVY = 1000


def meet(many: DataFrame, few: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """many joined with few, which has a row for each key and in m the rows of many that have it at most; total is at least the rows of many.

    Heavy keys, HEAVY of them for each that a row of many can have, are sent to all tasks, so no task gets all rows of one."""
    heavy, light = few.where(F.col("m") * HEAVY >= total), few.where(F.col("m") * HEAVY < total)
    rest = many.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return many.join(F.broadcast(heavy), on, how).unionByName(rest.join(light, on, how))


# ------------------------------------------------------------------ notes beside rows

#: Rows of a file whose notes are one file; bounds what a task holds of them.
NOTE_ROWS = 1 << 20


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is a file scan under selections and filters alone, so that a file's row is one row of df at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return plan.children().isEmpty()


def placed(df: DataFrame, tag: str = "placed") -> DataFrame:
    """df with file_at and row_at: a place that no two rows share and that every later scan finds again.

    Of Parquet scans these are the file's path, hashed, and the row's number in it; anything else is written first."""
    if not _plain_scan(df):
        df = materialize(df, tag)
    return df.withColumns({"file_at": F.xxhash64("_metadata.file_path"), "row_at": F.col("_metadata.row_index")})


def leave_notes(rows: DataFrame, tag: str) -> str:
    """Writes the notes (file_at, row_at, note long) of rows to the shared folder, whence the task that scans them reads them again.

    So what is found out about a row returns to it without a shuffle or broadcast of the rows, at any size. A task that
    runs again writes the same bytes under the same name."""
    folder = shared_folder(rows.sparkSession, tag)
    fs, base = store(folder)
    with fs.open_output_stream(f"{base}/here") as out:
        out.write(b"notes")

    def write(some: pa.Table) -> pa.Table:
        fs, base = store(folder)
        some = some.sort_by([("row_at", "ascending"), ("note", "ascending")])
        at, note = (some[x].to_numpy() for x in ("row_at", "note"))
        name = f"{base}/{some['file_at'][0].as_py()}.{at[0] // NOTE_ROWS}"
        with fs.open_output_stream(name) as out:
            out.write(np.concatenate([at, note]).astype(np.int64).tobytes())
        return pa.table({"n": pa.array([at.size], pa.int64())})

    block = F.expr(f"row_at div {NOTE_ROWS}")
    rows.select("file_at", "row_at", "note").groupBy("file_at", block.alias("block")).applyInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


class Notes:
    """Reads, in a task, what leave_notes wrote to a folder; holds the notes of one block of rows at a time."""

    def __init__(self, folder: str):
        self.fs, self.base = store(folder)
        self.key, self.at, self.note = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        with self.fs.open_input_stream(f"{self.base}/here"):  # a folder out of reach is an error, a file that isn't there a block without notes
            pass

    def _open(self, key: tuple[int, int]) -> None:
        try:
            with self.fs.open_input_stream(f"{self.base}/{key[0]}.{key[1]}") as stream:
                both = np.frombuffer(stream.read(), np.int64)
        except FileNotFoundError:
            both = np.zeros(0, np.int64)
        self.key, self.at, self.note = key, both[: both.size // 2], both[both.size // 2 :]

    def of(self, files: pa.Array, rows: pa.Array) -> pa.Array:
        """The notes at these places, null where there are none."""
        files, rows = files.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False)
        out, found = np.zeros(rows.size, np.int64), np.zeros(rows.size, dtype=bool)
        blocks = rows // NOTE_ROWS
        cuts = np.flatnonzero(np.concatenate([[True], (files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])])) if rows.size else []
        for a, b in zip(cuts, [*cuts[1:], rows.size], strict=True):
            if self.key != (key := (int(files[a]), int(blocks[a]))):
                self._open(key)
            if self.at.size:
                k = np.minimum(np.searchsorted(self.at, rows[a:b]), self.at.size - 1)
                found[a:b], out[a:b] = self.at[k] == rows[a:b], self.note[k]
        return pa.array(out, mask=~found)


def notes_of(folder: str) -> Callable[[Column, Column], Column]:
    """A function of file_at and row_at: the note there, null without one. For plans that have no other Python in the stage."""

    @F.arrow_udf("long")
    def note(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        notes = Notes(folder)
        for files, rows in batches:
            yield notes.of(files, rows)

    return note


# ------------------------------------------------------------------ words


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE = _RANDOM[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd multiplier, 5 mod 8, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 - 0x10
_BASE += (5 - _BASE) % 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or have.size < n:
        size = max(n, SLICE_BYTES)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:  # tables for single huge documents are not kept
            _powers[base] = have
    return have[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about limit bytes: (first row, end row, bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, is_space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of all rows, and the first word of each row (one more at the end)."""
    if data.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offs.size, np.int64)
    word = ~is_space[data]
    cut = np.zeros(data.size + 1, dtype=bool)
    cut[offs] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    finishes = word.copy()
    finishes[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words after lower-casing A-Z: a random-table polynomial by prefix sums, then a mixer."""
    if starts.size == 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(data.size + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power_table(_BASE, data.size), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power_table(_INVERSE, data.size)[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; with fewer words, of the whole sequence as one; without words, none."""
    starts, ends, first = word_spans(data, offs)
    h = word_hashes(data, starts, ends)
    joined = np.zeros(0, np.uint64)
    if h.size >= width:
        joined = np.zeros(h.size - width + 1, np.uint64)
        for k in range(width):
            joined = mix64(joined + h[k : k + joined.size] + np.uint64(k + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(joined[a : b - width + 1])
            keep = np.empty(s.size, dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, b):
                x = mix64(x + h[k : k + 1] + np.uint64(k - a + 1))
            out.append(mix64(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
