"""Benchmark decontamination: BM25 over benchmark items, block-max WAND, then overlap of question and answer or of the whole item.

Every window of every document is a query of distinct terms against the items. Impacts are scaled by an item's own
score (that of the item as a query), so one threshold holds for all items. As all items above a fixed threshold are
wanted, WAND needs no heap: a window is dropped when the sum of its terms' largest impacts stays below the
threshold, then block by block when the sum of the block maxima does; what is left is scored exactly.

The index is built by tasks, in shards of a bounded number of postings with the statistics of the whole benchmark, and
kept as files. Tasks read one shard at a time for each batch of documents: documents are read once whatever the number.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import _LOWER, forget, materialize, mix64, shared_folder, store, table, text_slices, tidy, word_hashes, word_spans

K1, B = 1.2, 0.75
#: Share of an item's own score from which a window is verified, and shares of its shingles that must be there.
THRESHOLD, OVERLAP, WIDTH = 0.6, 0.8, 5
#: Postings in one shard of the index (of 8 bytes, and 8 for each word of its items), items in a block of it; least words between starts of windows.
SHARD_POSTINGS, BLOCK_ITEMS, STRIDE = 1 << 21, 16, 128

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, data.size]), _GAP)
    return word_hashes(_LOWER[data], starts, ends)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    if h.size < width or not width:
        return np.zeros(0, np.uint64)
    out = np.zeros(h.size - width + 1, np.uint64)
    for k in range(width):
        out = mix64(out + h[k : k + out.size] + np.uint64(k + 1))
    return out


def alignment(item: np.ndarray, text: np.ndarray) -> float:
    """The share of item's words that need no edit (replaced, left out or put in) to make it a passage of text, at least 0."""
    steps = np.arange(text.size + 1)
    row = np.zeros(text.size + 1, dtype=np.int64)
    for k, word in enumerate(item, 1):
        cost = np.empty_like(row)
        cost[0] = k
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=cost[1:])
        row = np.minimum.accumulate(cost - steps) + steps
    return max(0, item.size - int(row.min())) / item.size


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: at an answer mark, else the last sentence is the answer; a single sentence is both."""
    if m := re.search(r"(?:^|\n|\s)(?:answer|a)\s*:\s*", text, re.IGNORECASE):
        if words_of(text[: m.start()]).size and words_of(text[m.end() :]).size:
            return text[: m.start()], text[m.end() :]
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    if cut and words_of(text[: cut[-1]]).size and words_of(text[cut[-1] :]).size:
        return text[: cut[-1]], text[cut[-1] :]
    return text, text


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size, one run after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Statistics:
    """Of a whole benchmark: its items with words, their mean length and longest one."""

    n: int
    mean_length: float
    longest: int


@dataclass
class Item:
    id: int | None
    words: np.ndarray
    #: Width and distinct shingles of question and answer.
    parts: list[tuple[int, np.ndarray]]

    @classmethod
    def read(cls, id_: int | None, text: str) -> Item:
        both = [words_of(x) for x in question_answer(text)]
        return cls(id_, words_of(text), [(w := min(WIDTH, h.size), np.unique(shingles(h, w))) for h in both])


@dataclass
class Index:
    """An inverted index: for each sorted term its items with impacts, its blocks of items with the largest impact there, and the largest of all."""

    items: list[Item]
    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    stride: int

    @classmethod
    def build(cls, items: list[Item], whole: Statistics, terms: np.ndarray, df: np.ndarray) -> Index:
        """terms are the sorted ones of items, df the number of items of the whole benchmark that hold each."""
        each = [np.unique(x.words, return_counts=True) for x in items]
        size = np.array([t.size for t, _ in each])
        owner, tf = np.repeat(np.arange(len(items)), size), np.concatenate([c for _, c in each])
        at = np.searchsorted(terms, np.concatenate([t for t, _ in each]))
        norm = K1 * (1 - B + B * np.array([x.words.size for x in items]) / whole.mean_length)
        impact = np.log1p((whole.n - df + 0.5) / (df + 0.5))[at] * tf * (K1 + 1) / (tf + norm[owner])
        impact /= np.bincount(owner, impact, len(items))[owner]
        order = np.lexsort((owner, at))
        at, owner, impact = at[order], owner[order], impact[order]
        edges = np.arange(terms.size + 1)
        group = at * len(items) + owner // BLOCK_ITEMS
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        start, top = np.searchsorted(at, edges), np.maximum.reduceat(impact, heads)
        block_start = np.searchsorted(at[heads], edges)
        # Two strides hold an item wherever it starts, with a quarter more words put in.
        stride = max(STRIDE, whole.longest * 5 // 4 + 1)
        return cls(items, terms, start, owner.astype(np.int32), impact.astype(np.float32), block_start, (owner[heads] // BLOCK_ITEMS).astype(np.int32), top.astype(np.float32), np.maximum.reduceat(impact, start[:-1]).astype(np.float32), stride)

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct known terms of each window as sorted (window, term), and the first window of each row."""
        at = np.minimum(np.searchsorted(self.terms, h), self.terms.size - 1)
        known = np.flatnonzero(self.terms[at] == h)
        rows = np.searchsorted(first, known, side="right") - 1
        base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // self.stride))])
        own = (known - first[rows]) // self.stride
        # A window spans two strides: each word is in the one that starts in its stride and in the one before.
        before = own > 0
        window = np.concatenate([base[rows] + own, (base[rows] + own - 1)[before]])
        key = np.unique(window * self.terms.size + np.concatenate([at[known], at[known][before]]))
        return *np.divmod(key, self.terms.size), base

    def candidates(self, window: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) for all scores from the threshold on."""
        if not window.size:
            return
        n, blocks = len(self.items), -(-len(self.items) // BLOCK_ITEMS)
        heads = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        sizes = np.diff(np.append(heads, window.size))
        alive = np.add.reduceat(self.term_max[term], heads) >= threshold - 1e-4
        heads, sizes = heads[alive], sizes[alive]
        step = max(1, min(256, (1 << 21) // blocks))
        for low in range(0, heads.size, step):
            some, size = heads[low : low + step], sizes[low : low + step]
            t, of = term[_ragged(some, size)], np.repeat(np.arange(some.size), size)
            many = self.block_start[t + 1] - self.block_start[t]
            at = _ragged(self.block_start[t], many)
            bounds = np.bincount(np.repeat(of, many) * blocks + self.block[at], self.block_max[at], some.size * blocks)
            left = bounds >= threshold - 1e-4
            used = left.reshape(-1, blocks).any(axis=1)[of]
            t, of = t[used], of[used]
            many = self.start[t + 1] - self.start[t]
            at, of = _ragged(self.start[t], many), np.repeat(of, many)
            item = self.item[at].astype(np.int64)
            keep = left[of * blocks + item // BLOCK_ITEMS]
            key, place = np.unique(of[keep] * n + item[keep], return_inverse=True)
            score = np.bincount(place, self.impact[at[keep]], key.size)
            for k in np.flatnonzero(score >= threshold - 1e-6).tolist():
                yield int(window[some[key[k] // n]]), int(key[k] % n), float(score[k])

    def search(self, h: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item, score, question's overlap, answer's overlap, item's alignment) for words h of rows that begin at first; the best window of each.

        An item is there if both parts' shingles are, or if the whole item aligns: shingles of a short part don't survive an edit."""
        if not h.size:
            return []
        window, term, base = self.windows(h, first)
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        for w, j, score in self.candidates(window, term, threshold):
            row, item = int(np.searchsorted(base, w, side="right")) - 1, self.items[j]
            start = first[row] + (w - base[row]) * self.stride
            text = h[start : min(start + 2 * self.stride, first[row + 1])]
            q, r = (np.isin(s, shingles(text, width)).mean() for width, s in item.parts)
            shingled = q >= overlap and r >= overlap
            # Words that are missing are edits at least, so few candidates need to be aligned.
            if shingled or np.isin(item.words, text).mean() >= overlap:
                aligned = alignment(item.words, text)
                if shingled or aligned >= overlap:
                    best[row, j] = max(best.get((row, j), (0.0, 0.0, 0.0, 0.0)), (score, float(q), float(r), aligned))
        return [(row, j, *x) for (row, j), x in sorted(best.items())]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        terms = pa.array([np.unique(h).view(np.int64) for h in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, terms, pa.array([h.size for h in words], pa.int64())], names=["i", "t", "terms", "length"])


def build_index(benchmark: DataFrame, item_col: str, text_col: str, shard_postings: int = SHARD_POSTINGS) -> tuple[str, list[str]]:
    """The shared folder and the names in it of the shards of an index of the items; those without words can't be found and are left out."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    items = materialize(items.mapInArrow(tidy(_terms), "i long, t string, terms array<long>, length long").where("length > 0"), "items")
    sums = items.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest"), F.sum(F.size("terms")).alias("postings")).first()
    folder = shared_folder(benchmark.sparkSession, "index")
    if not sums.n:
        return folder, []
    whole = Statistics(sums.n, sums.mean, sums.longest)
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(-(-sums.postings // shard_postings))))
    each = sharded.select("shard", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    df = each.distinct().join(df, "term").select(F.col("shard").alias("of"), "term", "df")

    def build(rows: pa.Table, known: pa.Table) -> pa.Table:
        texts = sorted(zip(rows["i"].to_pylist(), rows["t"].to_pylist(), strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        terms = known["term"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(terms)
        index = Index.build([Item.read(i, t) for i, t in texts], whole, terms[order], known["df"].to_numpy()[order])
        fs, base = store(folder)
        name = f"{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(pickle.dumps(index, protocol=5))
        return pa.table({"name": pa.array([name], pa.string())})

    built = sharded.select("shard", "i", "t").groupBy("shard").cogroup(df.groupBy("of")).applyInArrow(build, "name string")
    names = sorted(r.name for r in built.collect())  # one for each shard
    forget(items)
    return folder, names


class Shards:
    """An index in a task: reads a shard at a time, and a single one once."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.held = folder, names, None

    def __iter__(self) -> Iterator[Index]:
        for name in self.names:
            if self.held is None or len(self.names) > 1:
                fs, base = store(self.folder)
                with fs.open_input_stream(f"{base}/{name}") as stream:
                    self.held = pickle.loads(stream.read())
            yield self.held

    def found(self, column: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, Item, float, float, float, float]]:
        """(row, item, ...) as Index.search gives them, shard by shard."""
        for index in self:
            for i, _, data, offs in text_slices(column):
                starts, ends, first = word_spans(data, offs, _GAP)
                for row, j, *rest in index.search(word_hashes(data, starts, ends), first, threshold, overlap):
                    yield i + row, index.items[j], *rest


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap): rows of docs that hold a benchmark item.

    It is held where both parts' shingle overlaps reach overlap, or where item_overlap does: the share of the item's
    words that need no edit. score is the best window's BM25 over the item's own. Words are runs of ASCII letters and digits and of other
    characters, A-Z lower-cased. Null and empty texts on either side match nothing. Repeated rows of docs are each
    reported, repeated items once; rows with a null id are reported with a null. Empty tables give no rows; other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    folder, names = build_index(benchmark, item_col, item_text_col, shard_postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, names)
        for batch in batches:
            hits = list(shards.found(batch.column(1), threshold, overlap))
            if hits:
                ids = batch.column(0).take(pa.array([x[0] for x in hits]))
                items = pa.array([x[1].id for x in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, items, *(pa.array([x[k] for x in hits], pa.float64()) for k in (2, 3, 4, 5))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"])

    return source.mapInArrow(tidy(run), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, item_overlap double")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The rows and columns of docs without rows that hold a benchmark item, in one pass.

    Null and empty texts hold nothing and stay; repeated rows share their fate; ids play no part, null or not. An empty
    benchmark removes nothing, an empty table gives no rows; other columns pass through, whatever their names.
    """
    position = docs.columns.index(text_col)
    folder, names = build_index(benchmark, item_col, item_text_col, shard_postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, names)
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[x[0] for x in shards.found(batch.column(position), threshold, overlap)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
