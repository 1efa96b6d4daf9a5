"""Circulant MinHash near-duplicate detection.

Two permutations make all coordinates of a signature: the shingle hash places an element at a point of a ring
(the first permutation); a table that permutes the ring, read with a shift of k places, is coordinate k (the
second, circularly shifted). A signature is therefore the minimum over windows of one table. Bands of coordinates
give candidate groups; every link is confirmed on the full shingle sets.

No link between different texts is lost beyond what banding itself misses (see BANDS): every pair of a band's
group is either tested or already known to lie in one component. Equal sets collapse first. Then each group's
members are tested against its smallest member only; after components are found, members outside the smallest
member's component are tested against all others of the group, in blocks of bounded size, without emitting pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Notes, forget, leave_notes, materialize, meet, mix64, placed, shingle_sets, table, text_slices, tidy

#: Bands x rows: a pair of similarity 0.8 shares no band with a chance of (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
RING_BITS = 20
#: Sets in a block of queries and of targets when a group's remaining pairs are tested.
QUERY_BLOCK, TARGET_BLOCK = 128, 256
#: Columns of a dense block of the shingle matrix.
COLUMNS = 8192
#: Members of a group that meet one copy of their hub's set in a task.
HUB_ROWS = 512


class Circulant:
    """Signatures of sorted distinct shingle hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        k = bands * rows
        ring = np.random.default_rng(seed).permutation(1 << RING_BITS).astype(np.int32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: k - 1]]), k)
        self.bands, self.rows = bands, rows
        self.weights = mix64(np.arange(1, k + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (shingles >> np.uint64(64 - RING_BITS)).astype(np.int64)
        out = None
        for i in range(0, at.size, 1024):
            low = self.windows[at[i : i + 1024]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        return mix64((mix64(s + np.uint64(1)) * self.weights).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _signed(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Circulant(bands, rows)
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offs in text_slices(batch.column(1), 1 << 19):
                sets = shingle_sets(data, offs, width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                found = [kernel.band_keys(s) if s.size else np.zeros(0, np.int64) for s in sets]
                ends = np.cumsum([0, *(x.size for x in found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), *(batch.column(k).slice(i, j - i) for k in (2, 3)), pa.array([s.size for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))],
                    names=["id", "file_at", "row_at", "n", "class_key", "bands"],
                )

    return run


def _sets(width: int, folder: str):
    """The sets of the rows that have a note, which is their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(folder)
        for batch in batches:
            node = notes.of(batch.column(1), batch.column(2))
            wanted = node.is_valid()
            node, text = node.filter(wanted), batch.column(0).filter(wanted)
            for i, j, data, offs in text_slices(text, 1 << 19):
                sets = shingle_sets(data, offs, width)
                yield pa.RecordBatch.from_arrays([node.slice(i, j - i), pa.array([s.size for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "shingles"])

    return run


def _similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a_set"), batch.column("b_set")
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                keep.append(bool(_similar(np.count_nonzero(both[1:] == both[:-1]), x.size, y.size, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(percent: int):
    """Tests a block's queries against its targets by products of 0/1 matrices; gives a spanning forest of the links."""

    def run(rows: pa.Table) -> pa.Table:
        nodes = rows["node"].to_numpy()
        asks = rows["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        aims = rows["is_target"].to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"].combine_chunks()]
        sizes = np.array([s.size for s in sets], dtype=np.int64)
        of = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat := np.concatenate(sets), kind="stable")
        flat, of = flat[order], of[order]
        head = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(head) - 1
        shared = np.bincount(column) > 1
        keep = shared[column]
        column, of = (np.cumsum(shared) - 1)[column[keep]], of[keep]
        q, t = np.flatnonzero(asks), np.flatnonzero(aims)
        common = np.zeros((q.size, t.size), dtype=np.float64)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            dense = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            dense[of[a:b], column[a:b] - low] = 1
            common += dense[q] @ dense[t].T
        hit = _similar(common.astype(np.int64), sizes[q][:, None], sizes[t][None, :], percent) & (nodes[q][:, None] != nodes[t][None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
            a, b = int(nodes[q[i]]), int(nodes[t[j]])
            if (x := root(a)) != (y := root(b)):
                parent[x] = y
                links.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by alternating large-star and small-star steps.

    Distributed throughout; each step is written to the shared folder. Nodes without edges do not appear."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total = now.count()
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("m"))
        large = meet(both, low, ["u"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low"))  # a node's few centres: all lie below it
        small = large.join(down, "u").select(F.col("v").alias("x"), "low").union(down.select(F.col("u").alias("x"), "low"))
        after = materialize(small.where("x <> low").select(F.col("x").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        before, total = total, after.count()
        same = total == before and after.exceptAll(now).isEmpty()
        forget(now)
        if same:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs.

    Rows link when 100 * common shingles >= percent * all shingles. A null text or one without words has an empty
    set and links with nothing, so it is kept. Equal sets link. component_id is the smallest id reachable. A row
    with a null id links with nothing, has a null component and is kept. Rows that share an id count as one
    document whose links are united. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    source = placed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "texts")
    signed = source.mapInArrow(tidy(_signed(width, bands, rows)), "id long, file_at long, row_at long, n long, class_key binary, bands array<long>")
    signed = materialize(signed, "signed")
    named = signed.where("id is not null and class_key is not null")
    # One node for each distinct set, with the place of a row that has it.
    one = F.min(F.struct("id", "file_at", "row_at")).alias("one")
    classes = named.groupBy("class_key").agg(one, F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("class_key", F.col("one.id").alias("node"), "one.file_at", "one.row_at", "n", "bands"), "classes")
    spread = classes.select("node", F.posexplode("bands").alias("band", "bucket")).distinct()
    heads = spread.groupBy("band", "bucket").agg(F.min("node").alias("hub"), F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    written = materialize(heads, "heads")
    # Groups with the same members in several bands count once.
    heads = written.groupBy("hub", "m", "x").agg(F.min(F.struct("band", "bucket")).alias("g")).select("g.band", "g.bucket", "hub", "m")
    nodes = classes.count()
    members = materialize(meet(spread, heads, ["band", "bucket"], nodes), "members")
    # Only candidates' texts are cut into sets again, each by the task that scans it; a node has several sets if rows share its id.
    wanted = members.select("node").distinct().join(classes, "node").select("file_at", "row_at", F.col("node").alias("note"))
    folder = leave_notes(wanted, "wanted")
    sets = source.select("text", "file_at", "row_at").mapInArrow(tidy(_sets(width, folder)), "node long, n long, shingles binary")
    sets = materialize(sets, "sets")
    forget(folder)
    # A hub's set is copied for each HUB_ROWS of its members, so that a large group is many tasks' work.
    salts = F.ceil(F.col("m") / HUB_ROWS)
    pairs = members.where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.max("m").alias("m"))
    pairs = pairs.select("a", "b", F.expr(f"pmod(xxhash64(a), ceil(m / {HUB_ROWS}))").alias("salt"))
    hubs = members.groupBy(F.col("hub").alias("b")).agg(F.max("m").alias("m")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("shingles").alias("a_set")), "a")
    hubs = hubs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("shingles").alias("b_set")), "b")
    sides = sides.join(hubs, ["b", "salt"])
    sides = sides.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    links = materialize(sides.select("a", "b", "a_set", "b_set").mapInArrow(tidy(_confirm(percent)), "a long, b long"), "links")
    found = components(links)
    # What is left: members of a group outside its hub's component, against the whole group.
    part = members.join(found.select("node", "component"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    part = part.join(found.select(F.col("node").alias("hub"), F.col("component").alias("hc")), "hub", "left")
    part = part.where("node <> hub").select("band", "bucket", "node", (F.col("c") != F.coalesce("hc", "hub")).alias("out"))
    outside = materialize(part, "outside")
    rest = outside.groupBy("band", "bucket").agg(F.sum(F.col("out").cast("long")).alias("outs"), F.count("*").alias("m")).where("outs > 0 and m > 1")
    part = meet(outside, rest, ["band", "bucket"], nodes).withColumn("h", F.xxhash64("node"))
    part = part.withColumn("qn", F.ceil(F.col("outs") / QUERY_BLOCK)).withColumn("tn", F.ceil(F.col("m") / TARGET_BLOCK))
    part = materialize(part, "rest")
    targets = part.select("band", "bucket", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qn") - 1)).alias("qb"), F.expr("pmod(h, tn)").alias("tb"), F.lit(False).alias("is_query"), F.lit(True).alias("is_target"))
    queries = part.where("out").select("band", "bucket", "node", F.expr("pmod(h, qn)").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tn") - 1)).alias("tb"), F.lit(True).alias("is_query"), F.lit(False).alias("is_target"))
    blocks = targets.union(queries).groupBy("band", "bucket", "qb", "tb", "node").agg(F.max("is_query").alias("is_query"), F.max("is_target").alias("is_target"))
    blocks = blocks.join(sets.select("node", "shingles"), "node")
    more = materialize(blocks.groupBy("band", "bucket", "qb", "tb").applyInArrow(_blocks(percent), "a long, b long"), "links")
    whole = components(links.union(more))
    forget(written, members, sets, links, outside, part, more)
    by_class = classes.select("class_key", "node").join(whole, "node", "left").select("class_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("id", "n", "class_key").join(by_class, "class_key", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE: dict[str, str] = {}
