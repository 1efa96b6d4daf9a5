"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are trained on the driver from a bounded sample of labelled rows and flattened into arrays; scoring walks
all trees for a batch of documents at once in numpy, in the same pass that computes the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import held_out, table, text_slices, tidy, word_hashes, word_spans

#: Labelled rows that the trees learn from at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

#: Classes of bytes: lower, upper, digit, space, line end, sentence marks, other ASCII, beyond ASCII, control, bar, exclamation, hash-like.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[:32], _CLASS[127], _CLASS[10], _CLASS[ord("|")], _CLASS[ord("!")] = 8, 8, 4, 9, 10
_CLASS[[ord(c) for c in ".,;:?'\""]] = 5
_CLASS[[ord(c) for c in "#$%&*@<>=_~^"]] = 11
CLASSES = 12
_LINE = np.zeros(256, dtype=bool)
_LINE[10] = True


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _repeats(h: np.ndarray, first: np.ndarray, cut: int = 0) -> np.ndarray:
    """For each row, without its last cut units: distinct, occurrences of the most frequent, units that occur more than once."""
    out = np.zeros((first.size - 1, 3))
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), (first[1:] - cut).tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            n = np.diff(np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [s.size]]))
            out[r] = n.size, n.max(), n[n > 1].sum()
    return out


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of statistics of texts; all are finite, and those of an empty text are zero."""
    rows, size = offs.size - 1, np.diff(offs).astype(np.float64)
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    counts = np.bincount(row_of * CLASSES + _CLASS[data], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(np.float64)
    starts, ends, first = word_spans(data, offs)
    h = word_hashes(data, starts, ends)
    words = np.diff(first).astype(np.float64)
    per = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    last, begin = data[ends - 1] if ends.size else data[:0], data[starts] if starts.size else data[:0]
    same = np.zeros(h.size)
    if h.size > 1:
        same[1:] = h[1:] == h[:-1]
        same[first[:-1][first[:-1] < h.size]] = 0  # a row's first word has none before it
    upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    loud = (upper[ends] - upper[starts]) * 2 > length if ends.size else np.zeros(0)
    once = _repeats(h, first)
    pairs = _repeats(h[:-1] * np.uint64(3) + h[1:], first, 1)  # a row's last word begins none
    l_starts, l_ends, l_first = word_spans(data, offs, _LINE)
    lines = _repeats(word_hashes(data, l_starts, l_ends), l_first)
    n_lines = np.diff(l_first).astype(np.float64)
    per_line = np.maximum(n_lines, 1)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    feats = [
        share,
        np.log1p(size),
        np.log1p(words),
        n_lines,
        _per_row(length, first) / per,
        _per_row(length * length, first) / per,
        _per_row(length <= 2, first) / per,
        _per_row(length >= 12, first) / per,
        _per_row(same, first) / per,
        _per_row(loud, first) / per,
        _per_row(_CLASS[last] == 11, first) / per,
        _per_row(_CLASS[last] == 10, first) / per,
        _per_row(_CLASS[last] == 5, first) / per,
        _per_row(_CLASS[begin] == 1, first) / per,
        _per_row(_CLASS[begin] == 9, first) / per,
        _per_row(_CLASS[begin] == 2, first) / per,
        once / per[:, None],
        pairs / per[:, None],
        lines / per_line[:, None],
        _per_row((l_ends - l_starts) ** 1.0, l_first) / per_line,
        words / per_line,
        entropy,
    ]
    return np.column_stack(feats).astype(np.float32)


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: tree t's node k splits feature[t, k] at cut[t, k]; leaves follow the nodes."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(x.shape[0], self.start), np.arange(x.shape[0])
        nodes = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(x.shape[0], dtype=np.int64)
            while nodes and at.size and at[0] < nodes:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - nodes]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 5, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Newton boosting of the logistic loss on binned features. Without rows, or with one class, it predicts the base rate."""
    p = (y.sum() + 0.5) / (y.size + 1.0)
    nodes = (1 << depth) - 1
    start = float(np.log(p / (1 - p)))
    if y.size == 0 or y.min() == y.max():
        return Trees(start, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    cols = x.shape[1]
    flat = binned + np.arange(cols) * bins
    total = np.full(y.size, start)
    out_f, out_c, out_l = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(y.size, dtype=np.int64)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        split_bin = np.full(nodes, bins)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            key = ((at - base)[:, None] * (cols * bins) + flat).ravel()
            shape = (width, cols, bins)
            hg = np.bincount(key, np.repeat(g, cols), width * cols * bins).reshape(shape).cumsum(axis=2)
            hh = np.bincount(key, np.repeat(h, cols), width * cols * bins).reshape(shape).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            gain[(hh < least) | (th - hh < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            f, b = best // bins, best % bins
            feature[base : base + width] = np.where(ok, f, 0)
            split_bin[base : base + width] = np.where(ok, b, bins)
            cut[base : base + width] = [edges[i][j] if o and j < edges[i].size else np.inf for i, j, o in zip(f, b, ok, strict=True)]
            at = 2 * at + 1 + (binned[np.arange(y.size), feature[at]] > split_bin[at])
        at -= nodes
        sg, sh = np.bincount(at, g, nodes + 1), np.bincount(at, h, nodes + 1)
        leaf = -rate * sg / (sh + ridge)
        total += leaf[at]
        out_f.append(feature)
        out_c.append(cut)
        out_l.append(leaf)
    return Trees(start, np.array(out_f), np.array(out_c), np.array(out_l))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in text_slices(batch.column(0)):
            x = statistics(data, offs).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (1, 2)), lists], names=["id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS) -> Trees:
    """Trains on at most sample_rows labelled documents whose crc32(id as text) mod folds is not 0: those with the smallest hashes of their ids.

    Of labels or rows that share an id one is learnt from: the smallest label, with the smallest statistics; so neither
    repeated labels nor repeated rows make the sample larger. Null ids and labels teach nothing; null texts count as
    empty ones. Without usable labels, or with one class, the trees predict the base rate. Other columns are ignored."""
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
    usable = usable.where(~held_out("id", folds) & F.col("label").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = source.join(F.broadcast(sample), "id").select("text", "id", "label").mapInArrow(tidy(_features), "id long, label double, x array<double>")
    # One row for each id, sorted on the driver: the same trees whatever the partitions.
    got = rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x").toArrow().sort_by("id")
    y = got["label"].to_numpy()
    x = got["x"].combine_chunks().values.to_numpy().reshape(y.size, -1) if y.size else np.zeros((0, 1))
    return train(x.astype(np.float32), (y > 0).astype(np.float64))


def _scored(shared, threshold: float, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(shared.value.score(statistics(data, offs)) for _, _, data, offs in text_slices(column))])


def score_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs. A null text scores as an empty one; a null id is held out.

    Repeated rows score alike; an empty table gives no rows; other columns are ignored, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(shared, threshold, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs that score at least the threshold.

    A null text scores as an empty one; ids play no part, so repeated rows share their fate and null ids stay or go by
    their texts; an empty table gives no rows; other columns pass through, whatever their names."""
    shared, position = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(shared, threshold, batch.column(position)) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
