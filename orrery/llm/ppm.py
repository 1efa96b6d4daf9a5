"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts up to ORDER, trained on the training texts as lower-cased words with a blank
after each. A context reaches over the blank before a word into the word before it, no further. An unseen symbol
escapes to the next shorter context with probability q / 2T, q being the distinct symbols seen there and T their
occurrences; a symbol seen n times has (2n - 1) / 2T. Symbols that the longer context had are excluded below. A blank ends a word, a line end the text.

Only a word's first ORDER - 1 symbols depend on the word before. So a text's code length is a sum over its words of
what each costs from there on, and over its pairs of a word's last and the next one's first bytes. Chunks of texts
keep their words as numbers of a dictionary of their own; only dictionaries and the pairs' codes meet in the shuffle,
so what is frequent is one row per chunk. Counts return to a chunk for those of its words that other chunks have too,
costs for its codes. Nothing is broadcast but the counts of three bytes, which the alphabet bounds.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import _LOWER, forget, held_out, materialize, shared_folder, store, table, text_slices, tidy, word_hashes, word_spans

ORDER, FOLDS = 5, 10
#: Bytes of text whose words share a dictionary.
CHUNK_BYTES = 16 << 20
#: The blank that ends a word and stands before it, and the end of a text.
BLANK, END = 0x20, 0x0A

#: Bytes of text that reach a Python task at once.
BATCH_BYTES = 8 << 20

_CHUNKS = "chunk long, path string, wh long, slot int, code long, n long"


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of words, A-Z lower-cased."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), size.size, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(_LOWER[data[at]].tobytes())]).cast(pa.binary())


def _pack(words: pa.Array) -> bytes:
    """Lengths and bytes of words."""
    words = words.cast(pa.large_binary())
    offs = np.frombuffer(words.buffers()[1], np.int64, count=len(words) + 1, offset=8 * words.offset)
    return np.diff(offs).astype(np.uint32).tobytes() + words.buffers()[2].to_pybytes()[offs[0] : offs[-1]]


def _unpack(blob: bytes, count: int) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(np.frombuffer(blob, np.uint32, count=count))]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offs), pa.py_buffer(blob[4 * count :])])


def _edges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, in one number, the last four bytes of blank and word, and the first four symbols of word and blank."""
    size, low = ends - starts, _LOWER[data]
    out = np.zeros(size.size, dtype=np.uint64)
    for k in range(4):
        last = np.where(size > k, low[np.maximum(ends - 1 - k, 0)], BLANK * (size == k)) if size.size else out
        head = np.where(size > k, low[np.minimum(starts + k, data.size - 1)], BLANK * (size == k)) if size.size else out
        out |= (last.astype(np.uint64) << np.uint64(32 + 8 * k)) | (head.astype(np.uint64) << np.uint64(24 - 8 * k))
    return out


def _press(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpress(blob: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


_HEAD, _TAIL = np.uint64((1 << 32) - 1), np.uint64(((1 << 32) - 1) << 32)


def _pairs(edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word, then for each text's end, the last bytes of what stands before with its own first symbols."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    before = np.zeros(edges.size + 1, dtype=np.uint64)
    before[1:] = edges & _TAIL
    ends = np.where(sizes > 0, before[first[1:]], np.uint64(0)) | np.uint64(END << 24)
    before[first[:-1]] = 0
    return np.concatenate([before[: edges.size] | (edges & _HEAD), ends])


def pair_codes(pairs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the first symbols, which depend on the word before, the codes and the pair of each. A code holds order + 1 bytes, the symbol lowest."""
    reach, alive = order - 1, np.ones(pairs.size, dtype=bool)

    def byte(at: int) -> np.ndarray | np.uint64:
        """Of last bytes, blank and first symbols."""
        if at == reach:
            return np.uint64(BLANK)
        shift = 32 + 8 * (reach - 1 - at) if at < reach else 24 - 8 * (at - reach - 1)
        return (pairs >> np.uint64(shift)) & np.uint64(255)

    for k in range(reach):
        code = np.zeros(pairs.size, dtype=np.uint64)
        for at in range(k, k + order + 1):
            code = (code << np.uint64(8)) | byte(at)
        yield code[alive], np.flatnonzero(alive)
        last = byte(k + order)
        alive &= (last != BLANK) & (last != END)


def _tally(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their summed weights, part by part."""
    got = []
    for code, weight in parts:
        code, at = np.unique(code, return_inverse=True)
        got.append((code, np.bincount(at, weight, minlength=code.size)))
    code, at = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([w for _, w in got]), minlength=code.size).astype(np.int64)


def _chunked(order: int, chunk_bytes: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk a file with its texts' words as dictionary numbers and a row that names it, then rows for its dictionary and for its pairs' codes.

        A file's name is its attempt's own, so a task that runs again leaves nothing that is read."""
        fs, base = store(folder)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
            name = pa.array(np.full(count, (part << 32) + seq, np.int64))
            return pa.RecordBatch.from_arrays([name if x == "chunk" else columns[x] if x in columns else pa.nulls(count, k) for x, k in _KINDS.items()], names=list(_KINDS))

        def flush() -> Iterator[pa.RecordBatch]:
            ids, outs, sizes, hashes, edges, words = (list(x) for x in zip(*held, strict=True))
            held.clear()
            outs, sizes = np.concatenate(outs), np.concatenate(sizes)
            starts = np.concatenate([[0], np.cumsum([x.size for x in hashes])])
            hashes = np.concatenate(hashes)
            uniq, at, slot = np.unique(hashes, return_index=True, return_inverse=True)
            del hashes
            train = np.repeat(~outs, sizes)
            n = np.bincount(slot[train], minlength=uniq.size)
            picked: list[pa.Array] = [pa.array([], pa.binary())]
            seen = np.sort(at)
            for k, (data, s, e) in enumerate(words):
                own = seen[np.searchsorted(seen, starts[k]) : np.searchsorted(seen, starts[k + 1])] - starts[k]
                picked.append(_gather(data, s[own].astype(np.int64), e[own].astype(np.int64)))
            del words
            text = pa.concat_arrays(picked).take(pa.array(np.argsort(np.argsort(at))))  # from the order of first places to that of slots
            del picked, seen, at
            name = f"{base}/{uuid.uuid4().hex}"
            each = pa.table({"ids": pa.concat_arrays(ids), "held": pa.array(outs, pa.bool_()), "sizes": pa.array(sizes, pa.int64())})
            blobs = pa.table({"slots": pa.array([_press(slot)], pa.binary()), "words": pa.array([zstandard.ZstdCompressor(level=1).compress(_pack(text))], pa.binary()), "seen": pa.array([_press(n)], pa.binary())})
            del slot
            with fs.open_output_stream(name) as out:
                for x in (each, blobs):
                    with pa.ipc.new_stream(out, x.schema) as stream:
                        stream.write_table(x)
            yield rows(1, path=pa.array([name], pa.string()))
            del blobs, each
            for low in range(0, uniq.size, 50_000):
                some = uniq[low : low + 50_000]
                yield rows(some.size, wh=pa.array(some.view(np.int64)), slot=pa.array(np.arange(low, low + some.size, dtype=np.int32)), n=pa.array(n[low : low + 50_000].astype(np.int64)))
            del uniq
            pair, index = np.unique(_pairs(np.concatenate(edges), sizes), return_inverse=True)
            del edges
            weight = np.bincount(index, np.concatenate([train, ~outs]), minlength=pair.size)
            del index, train

            def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for code, own in pair_codes(pair, order):
                    yield code, weight[own]
                for low in range(0, len(text), 100_000):
                    code, own = word_codes(text.slice(low, 100_000), order)
                    yield code, n[low + own]

            code, weight = _tally(parts())
            for low in range(0, code.size, 50_000):
                yield rows(code[low : low + 50_000].size, code=pa.array(code[low : low + 50_000].view(np.int64)), n=pa.array(weight[low : low + 50_000]))

        for batch in batches:
            outs = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offs in text_slices(batch.column(2)):
                starts, ends, first = word_spans(data, offs)
                held.append((batch.column(0).slice(i, j - i), outs[i:j], np.diff(first), word_hashes(data, starts, ends), _edges(data, starts, ends), (data.copy(), starts.astype(np.int32), ends.astype(np.int32))))
                size += data.size
                if size >= chunk_bytes:
                    yield from flush()
                    pa.default_memory_pool().release_unused()
                    size, seq = 0, seq + 1
        if held:
            yield from flush()

    return run


_KINDS = {"chunk": pa.int64(), "path": pa.string(), "wh": pa.int64(), "slot": pa.int32(), "code": pa.int64(), "n": pa.int64()}


def word_codes(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the symbols of words, the blank after them included, that don't depend on the word before, and the word of each."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64, count=len(words) + 1, offset=8 * words.offset)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    size, offs = np.diff(offs), offs - offs[0]
    # A blank before each word and one at the end: the blank before the next word is that after this one.
    buf = np.full(raw.size + size.size + 1, BLANK, dtype=np.uint64)
    buf[np.arange(raw.size) + np.repeat(np.arange(size.size), size) + 1] = raw
    n = np.maximum(size + 2 - order, 0)
    row = np.repeat(np.arange(size.size), n)
    at = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n) + (offs[:-1] + np.arange(size.size))[row]
    code = np.zeros(row.size, dtype=np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | buf[at + k]
    return code, row


def _costs(order: int, shared):
    """Costs of the codes of one three-byte context: all longer contexts lie in it; shared are the counts of three bytes, by their codes."""

    def run(rows: pa.Table) -> pa.Table:
        triples, triple_n = shared.value
        pairs = np.bincount((triples & np.uint64(0xFFFF)).astype(np.int64), triple_n, 1 << 16).astype(np.int64).reshape(256, 256)
        single = pairs.sum(axis=0)
        code, n = rows["code"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
        cost, found = np.zeros(code.size), np.zeros(code.size, dtype=bool)
        # What the context above excludes: distinct symbols, and their occurrences in the next shorter context.
        q_above, e_above = np.zeros(code.size, np.int64), np.zeros(code.size, np.int64)
        trained = n > 0
        levels = {}
        for k in range(order, 0, -1):
            above = int(code[0] >> np.uint64(8)) & ((1 << (8 * k)) - 1)  # one for all rows where k < 4
            if k > 2:
                g, at = np.unique(code[trained] & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
                times = np.bincount(at, n[trained], minlength=g.size).astype(np.int64)
            elif k == 2:
                some = slice(*np.searchsorted(triples, np.array([above << 8, (above + 1) << 8], dtype=np.uint64)))
                g, times = triples[some], triple_n[some]
            else:
                symbols = np.flatnonzero(pairs[above])
                g, times = np.uint64(above << 8) | symbols.astype(np.uint64), pairs[above][symbols]
            levels[k] = (g, times)
        g0 = np.flatnonzero(single)
        levels[0] = (g0.astype(np.uint64), single[g0])
        for k in range(order, -1, -1):
            g, times = levels[k]
            if not g.size:
                continue
            ctx, of = np.unique(g >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, times).astype(np.int64), np.bincount(of)
            if k:
                low, low_times = levels[k - 1]
                next_ = g & np.uint64((1 << (8 * k)) - 1)
                excluded = np.bincount(of, low_times[np.minimum(np.searchsorted(low, next_), low.size - 1)]).astype(np.int64)
            else:
                excluded = np.zeros(ctx.size, np.int64)
            mine = code & np.uint64((1 << (8 * (k + 1))) - 1)
            c = np.minimum(np.searchsorted(ctx, mine >> np.uint64(8)), ctx.size - 1)
            s = np.minimum(np.searchsorted(g, mine), g.size - 1)
            here = ~found & (ctx[c] == mine >> np.uint64(8))
            hit = here & (g[s] == mine)
            new = distinct[c] - q_above
            whole = 2.0 * np.maximum(total[c] - e_above, 1)
            cost += np.where(hit, np.log10((2 * times[s] - 1) / whole), np.where(here & (new > 0), np.log10(np.maximum(new, 1) / whole), 0.0))
            found |= hit
            q_above, e_above = np.where(here, distinct[c], q_above), np.where(here, excluded[c], e_above)
        cost -= np.where(found, 0.0, np.log10(np.maximum(256 - q_above, 1)))
        return pa.table({"code": rows["code"], "cost": pa.array(cost)})

    return run


def symbol_costs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, cost): log10 of the probability of each code's symbol after its context, for (code, n) with n 0 where not trained.

    Codes meet by the last three bytes of their contexts; of shorter contexts the counts of three bytes are sent about,
    one for each that occurs (2**24 at most, some 100,000 in text of a few languages)."""
    low = counts.where("n > 0").groupBy(F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("g")).agg(F.sum("n").alias("n")).toArrow().sort_by("g")
    shared = counts.sparkSession.sparkContext.broadcast((low["g"].to_numpy().astype(np.uint64), low["n"].to_numpy()))
    by = F.expr("shiftright(code, 8) & 16777215")
    return counts.groupBy(by.alias("by")).applyInArrow(_costs(order, shared), "code long, cost double")


def _summed(order: int, n_train: int, train_tokens: int, distinct: int, folder: str):
    """Adds up a chunk: its file, and what it was told: counts of those of its words that other chunks have too, and costs of its codes."""
    floor = math.log10(train_tokens + 0.1 * (distinct + 1))
    end = math.log10(n_train + 0.1) - floor

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if chunk.num_rows == 0:
            return _OUT.empty_table()
        key, value = told["key"].to_numpy(), told["value"].to_numpy()
        with store(folder)[0].open_input_stream(chunk["path"][0].as_py()) as file:
            each, blobs = (pa.ipc.open_stream(file).read_all() for _ in range(2))
        ids, held, sizes, packed, words, seen = (x.combine_chunks() for x in (*each.columns, *blobs.columns))
        c, is_word = _unpress(seen[0]).astype(np.float64), key >= 0
        c[key[is_word]] = value[is_word]
        codes, costs = -1 - key[~is_word], value[~is_word]
        order_ = np.argsort(codes)
        codes, costs = codes[order_].view(np.uint64), costs[order_]
        sizes, slot = sizes.to_numpy(), _unpress(packed[0])
        text = _unpack(zstandard.ZstdDecompressor().decompress(words[0].as_buffer()), c.size)
        first = np.concatenate([[0], np.cumsum(sizes)])
        cost = np.zeros(c.size)
        for low in range(0, c.size, 100_000):
            inner, of = word_codes(text.slice(low, 100_000), order)
            cost[low : low + 100_000] = np.bincount(of, costs[np.searchsorted(codes, inner)], minlength=min(100_000, c.size - low))
        offs = np.frombuffer(text.buffers()[1], np.int64, count=c.size + 1)
        edges = _edges(np.frombuffer(text.buffers()[2], np.uint8), offs[:-1], offs[1:])
        pair, index = np.unique(_pairs(edges[slot], sizes), return_inverse=True)
        opening = np.zeros(pair.size)
        for code, own in pair_codes(pair, order):
            opening[own] += costs[np.searchsorted(codes, code)]
        opening = opening[index]

        def total(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[first[1:]] - sums[first[:-1]]

        score = total(cost[slot] + opening[: slot.size]) + opening[slot.size :]
        return pa.table([
            ids, held, pa.array(sizes + 1), pa.array(total((c > 0)[slot].astype(np.int64)) + int(n_train > 0)), pa.array(np.full(sizes.size, train_tokens, np.int64)),
            pa.array(total((np.log10(c + 0.1) - floor)[slot]) + end), pa.array(score),
        ], schema=_OUT)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = FOLDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:  # order: 3 to 5
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Trained on rows whose crc32(id as text) mod folds is not 0, whole corpus. score is log10 of the model's
    probability of the text, as lower-cased words with one blank after each and its end; base_score that of smoothed
    word counts. A null text counts as empty: it has one token, its end. A null id is held out; repeated rows each
    count. Without training texts every symbol has probability 1/256. An empty table gives no rows; other columns
    are ignored. Words are told apart by 64-bit hashes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, folds).alias("held"), F.col(text_col).cast("string").alias("text"))
    n_train = source.where("not held").count()
    folder = shared_folder(docs.sparkSession, "texts")
    chunks = materialize(source.mapInArrow(tidy(_chunked(order, chunk_bytes, folder)), _CHUNKS), "chunks", BATCH_BYTES)
    words = chunks.where("wh is not null").select("chunk", "wh", "slot", "n")
    # A word that one chunk alone has is counted there; the others meet by their hashes, one row for each chunk.
    over = Window.partitionBy("wh")
    met = words.select("chunk", "slot", "n", F.count("*").over(over).alias("k"), F.sum("n").over(over).alias("c"), (F.min("chunk").over(over) == F.col("chunk")).alias("first"))
    met = materialize(met.where("k > 1").select("chunk", "slot", "c", (F.col("n") > 0).alias("own"), "first"), "words")
    all_ = words.agg(F.count_if(F.col("n") > 0).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    twice = met.agg(F.count_if("own").alias("rows"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("words")).first()
    distinct, train_tokens = all_.v - twice.rows + twice.words + int(n_train > 0), all_.n + n_train
    asked = chunks.where("code is not null").select("chunk", "code", "n")
    counts = materialize(asked.groupBy("code").agg(F.sum("n").alias("n")), "codes")
    costs = materialize(symbol_costs(counts, order), "costs")
    forget(counts)
    # What a chunk is told: a slot's count, or, under -1 - code, a code's cost.
    told = met.select(F.col("chunk").alias("of"), F.col("slot").cast("long").alias("key"), F.col("c").cast("double").alias("value"))
    told = told.union(asked.join(costs, "code").select("chunk", F.lit(-1) - F.col("code"), "cost"))
    whole = chunks.where("path is not null").select("chunk", "path")
    summed = _summed(order, n_train, train_tokens, distinct, folder)
    return whole.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_ppm(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op5_ppm": op5_ppm}
ORACLE: dict[str, str] = {}
