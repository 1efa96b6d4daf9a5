"""Language identification by language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages: each position keeps a bit per language (bit slices), so the AND
of the masks at an n-gram's positions gives all languages that contain it. A text's popcount for a language, less
what false positives add on average, decides. Masks are as many 64-bit words wide as the languages need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import held_out, materialize, mix64, table, text_slices, tidy

#: Rows per language that are learnt from on average at most; n-grams kept per language; least share of the strongest language's frequency.
SAMPLE_ROWS, TOP_GRAMS, RATIO = 3000, 8000, 0.25
FOLDS, SIZE, HASHES, WIDTH = 5, 1 << 18, 2, 4

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte 4-grams of letters, a word's edge counting as a blank, and the row of each."""
    # A blank before and after each row, so that rows share no n-gram.
    rows = offs.size - 1
    padded = np.full(data.size + rows + 1, 32, dtype=np.uint8)
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    padded[np.arange(data.size) + row_of + 1] = _LETTER[data]
    if padded.size < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = padded.size - WIDTH + 1
    blank = padded == 32
    keep = np.flatnonzero(~(blank[1 : n + 1] | blank[2 : n + 2]))
    wide = padded.astype(np.uint64)
    code = (wide[keep] << np.uint64(24)) | (wide[keep + 1] << np.uint64(16)) | (wide[keep + 2] << np.uint64(8)) | wide[keep + 3]
    edges = offs[1:] + np.arange(1, rows + 1)  # the blank after each row
    return code, np.searchsorted(edges, keep + 1)


def positions(codes: np.ndarray) -> np.ndarray:
    h = mix64(codes + np.uint64(1))
    return np.stack([(h >> np.uint64(20 * k)) & np.uint64(SIZE - 1) for k in range(HASHES)]).astype(np.int64)


@dataclass
class Filter:
    langs: list[str]
    masks: np.ndarray
    false: np.ndarray
    prior: int
    prior_share: float

    @classmethod
    def build(cls, by_lang: dict[str, np.ndarray], rows: dict[str, int]) -> Filter:
        langs = sorted(rows)
        masks = np.zeros((-(-len(langs) // 64), SIZE), dtype=np.uint64)
        for bit, lang in enumerate(langs):
            for at in positions(by_lang.get(lang, np.zeros(0, np.uint64))):
                masks[bit // 64, at] |= np.uint64(1 << bit % 64)
        fill = np.array([((masks[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in range(len(langs))])
        prior = max(range(len(langs)), key=lambda b: (rows[langs[b]], -b), default=-1)
        return cls(langs, masks, fill**HASHES, prior, rows[langs[prior]] / sum(rows.values()) if langs else 0.0)

    def decide(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the chosen language's number and its share of the corrected popcounts."""
        rows = offs.size - 1
        code, row = grams(data, offs)
        at = positions(code)
        total = np.bincount(row, minlength=rows).astype(np.float64)
        counts = np.zeros((rows, max(1, len(self.langs))))
        for low, mask in enumerate(self.masks):
            hit = mask[at[0]]
            for k in range(1, HASHES):
                hit &= mask[at[k]]
            for b in range(64 * low, min(64 * low + 64, len(self.langs))):
                counts[:, b] = np.bincount(row[((hit >> np.uint64(b % 64)) & np.uint64(1)).astype(bool)], minlength=rows)
        f = self.false if self.langs else np.zeros(1)
        right = np.maximum((counts - f * total[:, None]) / np.maximum(1 - f, 1e-9), 0)
        best, sums = right.argmax(axis=1), right.sum(axis=1)
        score = np.where(sums > 0, right.max(axis=1) / np.maximum(sums, 1e-12), self.prior_share)
        return np.where(sums > 0, best, self.prior), np.clip(score, 0, 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for i, j, data, offs in text_slices(batch.column(0)):
            code, row = grams(data, offs)
            own = langs[i:j][row] if row.size else np.zeros(0, object)
            for lang in sorted(set(langs[i:j])):
                c, n = np.unique(code[own == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * c.size, pa.string()), pa.array(c.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, sample_rows: int = SAMPLE_ROWS, top: int = TOP_GRAMS, ratio: float = RATIO) -> Filter:
    """Learns from rows with a language whose crc32(id as text) mod folds is not 0: of each language a hashed share of about sample_rows rows.

    A language contains an n-gram if it is among its top most frequent (ties: the smaller code) and its share there is
    at least ratio of the largest share in any language. Rows with a null id or language teach nothing, null and empty
    texts no n-gram; repeated rows count each. An empty table, or one without languages, makes a filter that calls
    every text `und`; other columns are ignored. The driver holds what the number of languages bounds."""
    usable = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = usable.where(~held_out("id", folds) & F.col("lang").isNotNull())
    rows = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Filter.build({}, {})
    share = F.element_at(F.create_map(*[x for k, n in sorted(rows.items()) for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))]), F.col("lang"))
    chosen = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    counts = chosen.mapInArrow(tidy(_counted), "lang string, code long, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    sums = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not sums:
        return Filter.build({}, rows)
    size = F.element_at(F.create_map(*[x for k, n in sorted(sums.items()) for x in (F.lit(k), F.lit(float(n)))]), F.col("lang"))
    freq = counts.withColumn("f", F.col("n") / size)
    strong = freq.groupBy("code").agg(F.collect_list(F.struct("lang", "f", "n")).alias("x"), F.max("f").alias("m"))
    strong = strong.select("code", "m", F.explode("x").alias("x")).select("code", "x.*", "m").where(F.col("f") >= ratio * F.col("m"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    kept = strong.withColumn("place", place).where(F.col("place") <= top).select("lang", "code").toArrow()
    langs, codes = kept["lang"].to_numpy(), kept["code"].to_numpy().astype(np.uint64)
    by_lang = {lang: codes[langs == lang] for lang in sorted(rows)}
    return Filter.build(by_lang, rows)


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs. A null text or one without a letter is `und`, with score 0.

    Where no known n-gram occurs the most frequent language is taken, with its share as score. A null id is held
    out; repeated rows are told alike; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.langs, "und"], dtype=object)
        for batch in batches:
            langs, scores = [], []
            for i, _, data, offs in text_slices(batch.column(2)):
                best, score = shared.value.decide(data, offs)
                plain = np.concatenate([[0], np.cumsum((_LETTER[data] < 128) & (_LETTER[data] != 32))])
                for r in np.flatnonzero(plain[offs[1:]] == plain[offs[:-1]]).tolist():
                    if not any(c.isalpha() for c in batch.column(2)[i + r].as_py() or ""):
                        best[r], score[r] = len(names) - 1, 0.0
                langs.append(names[best])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, object), *langs]), pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
