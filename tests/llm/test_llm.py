"""The training-data operators: small cases with nulls, empties, ties and clashing columns; brute force; round trips."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import common, decontamination, exact_dedup, language, licenses, line_dedup, mixing, near_dedup, ppm, quality, registry, warc
from orrery.llm.common import text_slices, word_hashes, word_spans

DIR = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, norm string, sha string, node long, chunk string, hub int, size int, removed string, suspect int"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", ["a", None][k % 2], len(t or ""), 0, "", "", 0, "", 0, 0, "", 0) for k, (i, t) in enumerate(texts)], EXTRA)


LONG = "word " * 3000 + "Ünïcode\u00a0x \x0b end"  # a blank beyond ASCII parts no words
CASES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "ONE"), (7, LONG), (8, LONG + " more"), (9, "a b c d e f g h."), (9, "a b c d e f g h."), (None, "one"), (10, "x\0y z"), (11, "中文")]


@pytest.fixture
def cases(spark):
    return rows(spark, CASES)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = c.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    clean = lambda x: x[cols].astype(object).where(x[cols].notna(), None).map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)).sort_values(cols).reset_index(drop=True)
    assert clean(want).equals(clean(got))


def test_word_hashes():
    data = np.frombuffer("Ab aB ab\x0bc\n".encode() * 2, np.uint8)
    s, e, first = word_spans(data, np.array([0, 10, data.size]))
    h = word_hashes(data, s, e)
    assert first.tolist() == [0, 4, 8] and len(set(h.tolist())) == 2 and h[0] == h[1] == h[2] != h[3]
    assert [i for i, *_ in text_slices(pa.array(["a", None, "b" * 50]), 10)] == [0, 2]


def test_notes(spark, docs, tmp_path):
    """Notes return to the rows of a file scan, and of what had to be written first; the rest have none."""
    plain = docs.select("doc_id", "text").where("doc_id % 3 = 0")
    grouped = docs.groupBy("doc_id").count()
    assert common._plain_scan(plain) and not common._plain_scan(grouped) and not common._plain_scan(docs.join(grouped, "doc_id")) and not common._plain_scan(docs.select(F.explode(F.array("doc_id", "n_chars"))))
    for df in (plain, grouped):
        at = common.placed(df)
        assert at.select("file_at", "row_at").distinct().count() == df.count()
        noted = common.notes_of(common.leave_notes(at.where("doc_id % 2 = 0").select("file_at", "row_at", (F.col("doc_id") + (1 << 60) + 5).alias("note")), "n"))
        got = at.select("doc_id", noted("file_at", "row_at").alias("note")).collect()
        assert got and all(r.note is None if r.doc_id % 2 else r.note == r.doc_id + (1 << 60) + 5 for r in got)
    none = common.notes_of(common.leave_notes(common.placed(plain).where("doc_id < 0").select("file_at", "row_at", F.lit(1).cast("long").alias("note")), "n"))
    assert common.placed(plain).where(none("file_at", "row_at").isNotNull()).count() == 0
    lost = common.notes_of(f"file://{tmp_path}/nowhere")
    with pytest.raises(Exception, match="nowhere"):
        common.placed(plain).where(lost("file_at", "row_at").isNotNull()).count()
    assert common.store("file:/a/b")[1] == common.store("file:///a/b")[1] == "/a/b"


def test_texts_stay_in_their_tasks(spark, docs):
    """With broadcasts off as with them on, the scan of texts that looks for suspects feeds no exchange but through its notes."""
    noted = common.notes_of("file:///none")
    at = common.placed(docs.select("doc_id", "text"))
    plan = at.withColumn("note", noted("file_at", "row_at")).where("note is not null").groupBy("text").count()._jdf.queryExecution().executedPlan().toString()
    tree = plan[plan.rindex("Exchange") :]
    assert "isnotnull(" in tree and "ArrowEvalPython" in tree and "FileScan" in tree


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, width, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_brute_force(docs, width):
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=width).collect()}
    assert got == want


def test_near_star_and_chain(spark):
    """Copies that are near their base but not each other, and a chain, in one large group."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(200)]
    texts = [(500, " ".join(base))]
    for i in range(300):
        w = list(base)
        for k in rng.choice(200, 9, replace=False):
            w[k] = f"n{i}_{k}"
        texts.append((i, " ".join(w)))
    for i in range(5):
        texts.append((600 + i, " ".join(f"c{k}" for k in range(12 * i, 12 * i + 200))))
    want = brute_components(texts, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(rows(spark, texts), width=2).collect()}
    assert got == want and len({c for _, c in want.values()}) < 20


def test_near_cases(cases, empty):
    got = [tuple(r) for r in near_dedup.near_duplicates(cases, width=2).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(CASES) and near_dedup.near_duplicates(empty).count() == 0
    assert by[1] == (1, 0, 1, True) and by[3] == (3, 0, 3, True) and by[4][2:] == (4, True) and by[5][2:] == (4, False) and by[6][2:] == (4, False)
    assert by[None][2:] == (None, True) and by[7][1] == 3 and by[8][1:] == (4, 8, True) and by[9][2:] == (9, True)


def test_circulant_estimates():
    k = near_dedup.Circulant(64, 4)
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    b = np.sort(np.concatenate([a[:800], rng.integers(0, 2**64, 200, dtype=np.uint64)]))
    assert abs((k.signature(a) == k.signature(b)).mean() - 800 / 1200) < 0.12


# ---------------------------------------------------------------- exact duplicates


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_golomb(n):
    gaps = np.random.default_rng(n).integers(0, 1 << 40, n).astype(np.uint64)
    k, code = exact_dedup.golomb_encode(gaps)
    assert exact_dedup.golomb_decode(k, code, n).tolist() == gaps.tolist()


@pytest.mark.parametrize("bits", [3, 48])
def test_exact_cases(cases, empty, bits):
    got = sorted((tuple(r) for r in exact_dedup.duplicate_groups(cases, bits=bits).collect()), key=str)
    groups = defaultdict(list)
    for i, t in CASES:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        want += [(m[3], keep, len(members), True if len(members) == 1 else m[3] is not None and m[3] == keep, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    assert got == sorted(want, key=str)
    assert exact_dedup.duplicate_groups(empty).count() == 0


# ---------------------------------------------------------------- decontamination


def test_leaks(spark, docs):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    assert want and want <= got
    left = {r.doc_id for r in decontamination.remove_leaks(docs, bench).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def brute_leaks(texts, items, threshold, overlap):
    """BM25 of every window against every item by its formula, then overlap and edits, all in plain Python."""
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode().lower())
    items = [(i, t, words(t)) for i, t in {(i, t) for i, t in items if t} if words(t)]
    n, mean = len(items), sum(len(w) for *_, w in items) / len(items)
    df = Counter(x for *_, w in items for x in set(w))
    stride = max(decontamination.STRIDE, max(len(w) for *_, w in items) * 5 // 4 + 1)
    grams = lambda w, k: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}

    def edits(item, text):
        row = [0] * (len(text) + 1)
        for k, x in enumerate(item, 1):
            new = [k]
            for a, y in enumerate(text):
                new.append(min(row[a] + (x != y), row[a + 1] + 1, new[a] + 1))
            row = new
        return max(0, len(item) - min(row)) / len(item)

    told = []
    for i, t, w in items:
        impact = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * (decontamination.K1 + 1) / (c + decontamination.K1 * (1 - decontamination.B + decontamination.B * len(w) / mean)) for x, c in Counter(w).items()}
        parts = [words(x) for x in decontamination.question_answer(t)]
        told.append((i, w, impact, sum(impact.values()), [(min(5, len(x)), grams(x, min(5, len(x)))) for x in parts]))
    out = {}
    for d, t in texts:
        h = words(t)
        for a in range(0, len(h), stride):
            window = h[a : a + 2 * stride]
            seen = set(window)
            for i, w, impact, own, parts in told:
                score = sum(v for x, v in impact.items() if x in seen) / own
                if score >= threshold:
                    q, r = (len(g & grams(window, k)) / len(g) for k, g in parts)
                    if (q >= overlap and r >= overlap) or edits(w, window) >= overlap:
                        out[d, i] = max(out.get((d, i), 0), score)
    return out


@pytest.mark.parametrize("postings", [decontamination.SHARD_POSTINGS, 800])
def test_leaks_brute_force(spark, postings):
    """More items than one block or, with 800 postings, one shard holds, some long; near copies and texts that only resemble them."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{k}" for k in rng.zipf(1.4, n) % 700)
    items = [(i, f"{say(rng.integers(6, 30))}. {say(rng.integers(1, 6))}.") for i in range(600)] + [(600, "y " * 150), (601, "?"), (3, "the same id"), (None, "an item without id here")]
    texts = []
    for d in range(120):
        words = items[rng.integers(0, 600)][1].split()
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = "other"
        texts.append((d, f"{say(rng.integers(0, 200))} {' '.join(words)} {say(rng.integers(0, 200))}"))
    texts += [(200, "and y" + " y" * 149), (201, "so the same id"), (202, "an item without id here it is")]
    want = brute_leaks(texts, items, 0.6, 0.8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.find_leaks(rows(spark, texts), bench, shard_postings=postings).collect()}
    assert got == pytest.approx(want, abs=1e-5) and len(want) > 60 and {(200, 600), (201, 3), (202, None)} <= want.keys()
    assert {r.doc_id for r in decontamination.remove_leaks(rows(spark, texts), bench, shard_postings=postings).collect()} == {d for d, _ in texts} - {d for d, _ in want}


def test_leak_cases(spark, cases, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g h."), (1, "a b c d e f g h."), (2, None), (3, "")], "item_id long, text string")
    assert [r.doc_id for r in decontamination.find_leaks(cases, bench).collect()] == [9, 9]
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(cases, bench.limit(0)).count() == 0
    assert decontamination.remove_leaks(cases, bench).count() == len(CASES) - 2
    assert decontamination.question_answer("What is it? Answer: a cow.") == ("What is it?", "a cow.")


def test_near_verbatim_leaks(spark):
    item = "Which of the grey herons came back to the lake before the ice had gone in the north? Two."
    words = item.split()
    texts = [" ".join(words[:k] + ["other"] + words[k + 1 :]) for k in range(len(words))]
    texts += [" ".join(words[:-1]), " ".join([*words[:5], "more", *words[5:]]), " ".join(words[:3] + words[4:])]
    clean = [" ".join(sorted(words)), " ".join(words[:9])]  # the same words in another order, and half of the item
    docs = rows(spark, [(k, f"Before it. {t} After it.") for k, t in enumerate(texts + clean)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_leaks(docs, bench).collect()}
    assert set(got) == set(range(len(texts))) and all(r.item_overlap >= 0.9 for r in got.values())
    assert {r.doc_id for r in decontamination.remove_leaks(docs, bench).collect()} == {len(texts), len(texts) + 1}
    a, b = (decontamination.words_of(x) for x in ("one two three four", "zero one three five six"))
    assert decontamination.alignment(a, b) == 0.5 and decontamination.alignment(b, b) == 1.0


# ---------------------------------------------------------------- mixing


def test_mixing(spark, cases, empty):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    got = mixing.mix_sources(big, targets={"x": 3.0, "y": 1.0}, total=8000)
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["x"] - 6000) < 250 and abs(counts["y"] - 2000) < 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert mixing.mix_sources(empty).count() == 0 and {c for c in mixing.mix_sources(cases).columns} >= {"text", "mix_copy", "mix_key"}
    assert sorted(map(str, mixing.mix_sources(cases).collect())) == sorted(map(str, mixing.mix_sources(cases.repartition(3)).collect()))


def test_mixing_uneven_sources(spark, monkeypatch):
    """A source a million times smaller than another, and many small ones beside a large one."""
    rate = spark.range(400).select(mixing.copies(F.lit(1300.0), "s", F.col("id")).alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert abs(rate[0] - 1300) < 4 * 1300**0.5 / 20 and abs(rate[1] - 1300**0.5) < 6
    big = spark.range(1_000_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "x").otherwise("y").alias("source"))
    counts = {r.source: r["count"] for r in mixing.mix_sources(big, total=1_001_000).groupBy("source").count().collect()}
    assert abs(counts["x"] - 1000) < 160 and abs(counts["y"] - 1_000_000) < 5000
    some = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "y").otherwise(F.concat(F.lit("s"), F.col("id") % 300)).alias("source"))
    want = sorted(map(str, mixing.mix_sources(some).collect()))
    for heavy in (3, 100_000):
        monkeypatch.setattr(mixing, "HEAVY", heavy)
        assert sorted(map(str, mixing.mix_sources(some).collect())) == want


# ---------------------------------------------------------------- language, quality


def test_language(spark, docs, cases, empty):
    model = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    known = [(r.lang, got[r.doc_id]) for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(a == b.lang_pred for a, b in known) >= 0.9 * len(known)
    other = {r.doc_id: r for r in language.identify(cases, model).collect()}
    assert all(other[i].lang_pred == "und" and other[i].score == 0 for i in (1, 2, 3)) and other[11].lang_pred in model.langs
    assert language.identify(empty, model).count() == 0 and all(0 <= r.score <= 1 for r in other.values())
    none = language.learn(empty)
    assert {r.lang_pred for r in language.identify(cases, none).collect()} == {"und"}


def test_quality(spark, docs, cases, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = quality.fit(big, labels)
    got = {r.doc_id: r for r in quality.score_quality(big, trees).collect()}
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.9 * len(held)
    out = quality.score_quality(cases, trees).collect()
    assert len(out) == len(CASES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.score for r in out if r.doc_id == 1} == {r.score for r in out if r.doc_id == 2}
    assert quality.score_quality(empty, quality.fit(empty, labels)).count() == 0
    assert quality.keep_good(cases, trees).columns == cases.columns


def test_language_brute_force(spark, docs):
    """Counting, choice of n-grams, filter and decision in plain Python."""
    rows_ = docs.collect()
    model = language.learn(docs, top=300)

    def grams(text):
        data = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in text.encode().lower())
        data = b" " + data + b" "
        return [data[k : k + 4] for k in range(len(data) - 3) if 32 not in data[k + 1 : k + 3]]

    counts = defaultdict(Counter)
    for r in rows_:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts[r.lang].update(grams(r.text or ""))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = {}
    for x, c in counts.items():
        strong = [g for g in c if share[x][g] >= language.RATIO * max(share[y].get(g, 0) for y in counts)]
        top[x] = sorted(strong, key=lambda g: (-c[g], g))[:300]
    code = lambda g: int.from_bytes(g, "big")
    slots = {x: {int(p) for p in language.positions(np.array([code(g) for g in top[x]], np.uint64)).ravel()} for x in top}
    told = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r in rows_[:80]:
        seen = grams(r.text or "")
        at = language.positions(np.array([code(g) for g in seen], np.uint64).reshape(-1)).T.tolist()
        right = {}
        for x in sorted(slots):
            false = (len(slots[x]) / language.SIZE) ** language.HASHES
            right[x] = max(0.0, (sum(all(p in slots[x] for p in ps) for ps in at) - false * len(at)) / (1 - false))
        if sum(right.values()):
            best = max(sorted(right), key=lambda x: right[x])
            assert told[r.doc_id].lang_pred == best and told[r.doc_id].score == pytest.approx(right[best] / sum(right.values()))


def test_seventy_languages(spark):
    """More languages than a word of the mask has bits, each with words of its own; one of them has no text."""
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:02d}": ["".join(rng.choice(letters, 7)) for _ in range(12)] for k in range(70)}
    texts = [(i, " ".join(rng.choice(words[x], 15)), x) for i, x in enumerate([*words] * 6)]
    df = spark.createDataFrame([*texts, (10_000, None, "none")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.learn(df)).collect()}
    assert len({r.lang_pred for r in got.values()}) == 71 and all(got[i].lang_pred == x for i, _, x in texts)


def test_statistics_brute_force():
    """The statistics of texts, some of several batches' length, one by one in plain Python."""
    texts = ["", "same same", "", "same", "Hello there, hello THERE!", "a b a b a b\n| x | y |\n\n12 12 $$$ !!", "é" * 20 + "\tq" * 3, "Words " * 50 + "\nWords Words\n" * 4, "w%d " * 5 % (1, 2, 3, 4, 5)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = quality.statistics(data, offs)
    assert [quality.statistics(data[a:b], np.array([0, b - a])).tolist()[0] for a, b in zip(offs[:-1], offs[1:], strict=True)] == [pytest.approx(x.tolist(), abs=1e-5) for x in got]
    for row, t in zip(got, texts, strict=True):
        raw = t.encode()
        share = [sum(quality._CLASS[c] == k for c in raw) / max(len(raw), 1) for k in range(quality.CLASSES)]
        words, lines = re.findall(rb"[^\x20\x09-\x0d]+", raw), [x for x in raw.split(b"\n") if x]
        low = [w.lower() for w in words]
        per, per_line = max(len(words), 1), max(len(lines), 1)
        group = lambda xs: [len(Counter(xs)), max(Counter(xs).values(), default=0), sum(n for n in Counter(xs).values() if n > 1)]
        kind = lambda c: quality._CLASS[c]
        want = [
            *share, math.log1p(len(raw)), math.log1p(len(words)), len(lines), sum(map(len, words)) / per, sum(len(w) ** 2 for w in words) / per,
            sum(len(w) <= 2 for w in words) / per, sum(len(w) >= 12 for w in words) / per, sum(a == b for a, b in zip(low, low[1:], strict=False)) / per,
            sum(2 * sum(65 <= c <= 90 for c in w) > len(w) for w in words) / per, *(sum(kind(w[-1]) == k for w in words) / per for k in (11, 10, 5)),
            *(sum(kind(w[0]) == k for w in words) / per for k in (1, 9, 2)), *(x / per for x in group(low)), *(x / per for x in group(list(zip(low, low[1:], strict=False)))),
            *(x / per_line for x in group([x.lower() for x in lines])), sum(map(len, lines)) / per_line, len(words) / per_line, -sum(x * math.log(x) for x in share if x),
        ]
        assert len(want) == row.size
        assert row.tolist() == pytest.approx(want, rel=1e-4, abs=1e-5), t


def test_one_small_tree():
    """One boosted stump, its cut and leaves against all cuts tried one by one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)).astype(np.float32)
    y = (x[:, 1] > 0.2).astype(float)
    trees = quality.train(x, y, trees=1, depth=1, bins=16)
    p = 1 / (1 + math.exp(-trees.start))
    best = []
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1], method="lower")):
            left = x[:, f] <= cut
            n, g = left.sum(), (p - y)[left].sum()
            h, total = n * p * (1 - p), (p - y).sum()
            rest = (80 - n) * p * (1 - p)
            if h >= 3 and rest >= 3:
                best.append((g * g / (h + 1) + (total - g) ** 2 / (rest + 1), f, float(cut), -0.1 * g / (h + 1), -0.1 * (total - g) / (rest + 1)))
    _, f, cut, low, high = max(best)
    assert (trees.feature[0, 0], trees.cut[0, 0]) == (f, pytest.approx(cut)) and trees.leaf[0].tolist() == pytest.approx([low, high])


def test_quality_sample_is_bounded(spark):
    """Repeated labels and rows of an id teach once, so the sample has no more rows than it may."""
    docs = rows(spark, [(i, f"text {i}") for i in (1, 2, 3) for _ in range(50)] + [(None, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3) for _ in range(20)] + [(None, 1), (2, None)], "doc_id long, quality int")
    taught = []
    before, quality.train = quality.train, lambda x, y, **k: taught.append(y.size) or before(x, y, **k)
    try:
        quality.fit(docs, labels, sample_rows=2)
    finally:
        quality.train = before
    assert taught[0] <= 2


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    trees = quality.train(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=10, depth=3)
    want = []
    for row in x:
        total = trees.start
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            total += leaf[k - len(f)]
        want.append(1 / (1 + math.exp(-total)))
    assert np.allclose(trees.score(x), want)


# ---------------------------------------------------------------- language model


def brute_ppm(texts, order):
    words = [(t or "").encode().lower().split() for _, t in texts]
    train = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in texts]
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def symbols(ws):
        before = None
        for w in [*ws, None]:
            tail = (b"\0" * 4 + (b" " + before if before is not None else b""))[-4:]
            body = b"\n" if w is None else w + b" "
            for i in range(len(body)):
                yield (tail + b" " + body[:i])[-order:], body[i]
            before = w

    for ws, own in zip(words, train, strict=True):
        if own:
            for ctx, s in symbols(ws):
                for k in range(order + 1):
                    counts[k][ctx[order - k :]][s] += 1

    def cost(ctx, s):
        out, gone = 0.0, set()
        for k in range(order, -1, -1):
            m = {a: n for a, n in counts[k].get(ctx[order - k :], {}).items() if a not in gone}
            if m:
                total, q = sum(m.values()), len(m)
                if s in m:
                    return out + math.log10((m[s] - 0.5) / total)
                out += math.log10(q / 2 / total)
                gone |= set(m)
        return out - math.log10(256 - len(gone))

    c = Counter(w for ws, own in zip(words, train, strict=True) if own for w in ws)
    n_train = sum(train)
    n, v = sum(c.values()) + n_train, len(c) + (n_train > 0)
    floor = math.log10(n + 0.1 * (v + 1))
    for (i, _), ws in zip(texts, words, strict=True):
        base = math.log10(n_train + 0.1) - floor + sum(math.log10(c[w] + 0.1) - floor for w in ws)
        yield i, len(ws) + 1, sum(c[w] > 0 for w in ws) + (n_train > 0), n, base, sum(cost(*x) for x in symbols(ws))


@pytest.mark.parametrize("size", [ppm.CHUNK_BYTES, 20_000])
def test_ppm(spark, docs, size):
    texts = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    want = {r[0]: r[1:] for r in brute_ppm(texts, ppm.ORDER)}
    got = {r.doc_id: tuple(r)[2:] for r in ppm.score_texts(rows(spark, texts).repartition(3), chunk_bytes=size).collect()}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i] == pytest.approx(x, rel=1e-9)


def test_ppm_cases(spark, cases, empty):
    want = sorted(map(str, ((r[0], *r[1:4]) for r in brute_ppm(CASES, ppm.ORDER))))
    out = ppm.score_texts(cases).collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens)) for r in out) == want
    scores = {r[0]: r[5] for r in brute_ppm(CASES, ppm.ORDER) if r[0] not in (None, 9)}
    assert {r.doc_id: r.score for r in out if r.doc_id in scores} == pytest.approx(scores, rel=1e-9)
    assert ppm.score_texts(empty).count() == 0
    blank = rows(spark, [(1, None), (2, "")])
    assert [r.n_tokens for r in ppm.score_texts(blank).collect()] == [1, 1]


# ---------------------------------------------------------------- licences


def test_templates():
    machine = licenses.Automaton([("t", 1.0, "red {{2}} fox [[big cat]] runs"), ("u", 0.5, "[[a]] b c")])
    say = lambda s: set(machine.found(s.encode().split()))
    assert say("x red fox runs") == {"t"} and say("red one two fox big cat runs") == {"t"}
    assert say("red one two three fox runs") == set() and say("red fox big runs") == set() and say("fox runs") == set()
    assert say("b c") == {"u"} and say("a b c red fox runs") == {"t", "u"} and machine.found([b"b", b"c"]) == {"u": 0.5}


def test_anchors(spark):
    """Anchors are words of the compiled states that no acceptance can do without, whatever the markup."""
    of = lambda m: licenses.anchor(licenses.compile_template(m))
    assert of("a [[b [[c]] extraordinary]] d") == b"d" and of("some Capital word") == b"capital" and of("[[all]] {{3}}") is None and of("x {{2}} yy x") == b"yy"
    for markup, yes, no in [("a [[b [[c]] extraordinary]] d", ["a d", "a b extraordinary d", "A B C extraordinary, d"], ["a b d", "extraordinary"]), ("some Capital word", ["Some CAPITAL word"], ["some word"]), ("[[maybe]] {{1}}", ["maybe", "q"], [""])]:
        got = {r.doc_id: r.labels for r in licenses.scan_licenses(rows(spark, list(enumerate(yes + no))), templates=[("t", 1.0, markup)]).collect()}
        assert [got[k] for k in range(len(yes + no))] == ["t"] * len(yes) + [""] * len(no)


def test_licenses_brute_force(spark):
    """Texts made from the templates, whole or altered, against the templates as regular expressions."""
    rng = np.random.default_rng(6)
    texts, rules = [], [(label, score, re.compile(licenses.template_pattern(m))) for label, score, m in licenses.TEMPLATES]
    for label, score, markup in licenses.TEMPLATES * 6:
        words = []
        for part in re.findall(licenses._PART, re.sub(r"\[\[.*?\]\]", lambda m: m.group()[2:-2] if rng.random() < 0.5 else " ", markup)):
            words += [f"n{k}" for k in range(rng.integers(0, int(part[2:-2]) + 1))] if part.startswith("{{") else [part.title() if rng.random() < 0.2 else part]
        if rng.random() < 0.4:
            words[rng.integers(0, len(words))] = "altered"
        texts.append(f"Copyright. {', '.join(words)}; mit licence")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows(spark, list(enumerate(texts)))).collect()}
    seen = set()
    for k, t in enumerate(texts):
        norm = f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "
        want = {label: score for label, score, p in sorted(rules, key=lambda x: x[1]) if p.search(norm)}
        base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in norm}
        assert (got[k].labels, got[k].score) == (",".join(sorted(want.keys() | base)), max([*want.values(), 0.5 * bool(base)]))
        seen |= set(want.items())
    assert {x for x, _ in seen} == {x for x, *_ in licenses.TEMPLATES} and {x for x, score in seen if score == 1.0} == {x for x, score, _ in licenses.TEMPLATES if score == 1.0}


def test_licenses(spark, empty):
    texts = [(1, "Released under the MIT License."), (2, "mit, license apache-license; General public\nlicense"), (3, "MITLicense mit x license"), (4, None), (5, "Licensed under the Apache License, Version 2.0 Émit license"), (6, "mit license mit license")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(rows(spark, texts)).collect()}
    assert got[1] == (5, 1, 3, 3, "mit", "mit", licenses.NOTICE)
    assert got[2] == (7, 3, 0, 4, "apache,gpl,mit", "apache,gpl,mit", licenses.PHRASE)
    assert got[3] == (4, 0, None, None, "", "", 0.0) and got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5] == (10, 1, 3, 3, "apache", "apache,apache-2.0", licenses.NOTICE) and got[6][1:4] == (2, 0, 2)
    assert licenses.scan_licenses(empty).count() == 0


def test_mixed_documents_are_whole(spark, docs):
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = registry.queries()["op2_mix_sources"](spark, DIR)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression", 1)[1]
    assert "text#" in plan and {(r.doc_id, r.text, r.lang) for r in got.collect()} <= {(i, *x) for i, x in texts.items()}


# ---------------------------------------------------------------- lines, archives


def brute_repeats(texts, unit, least):
    pattern, cut = re.compile(line_dedup.UNITS[unit]), []
    for k, (i, t) in enumerate(texts):
        for m in pattern.finditer(t or ""):
            if w := m.group().encode().lower().split():
                cut.append((i, k, m.start(), m.end(), tuple(w)))
    first = {}
    for i, k, a, _, w in cut:
        if i is not None and (w not in first or (i, k, a) < first[w]):
            first[w] = (i, k, a)
    out = []
    for k, (_, t) in enumerate(texts):
        spans, run = [], []
        for i, _, a, b, w in [*(x for x in cut if x[1] == k), (None, k, 0, 0, ())]:
            if i is not None and first[w] != (i, k, a):
                run.append((a, b, len(w)))
                continue
            spans += [x[:2] for x in run] if sum(x[2] for x in run) >= least else []
            run = []
        out.append((len(pattern.findall(t or "")), len(spans), len(t or "") - sum(b - a for a, b in spans), tuple(spans)))
    return out


@pytest.mark.parametrize(("unit", "least"), [("sentence", line_dedup.RUN_WORDS), ("line", 1), ("paragraph", 1), ("sentence", 1)])
def test_line_brute_force(spark, docs, unit, least):
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_units, r.n_removed, r.kept_chars, tuple(map(tuple, r.removed))) for r in line_dedup.repeated_units(docs, unit=unit, run_words=least).collect()}
    want = dict(zip([i for i, _ in texts], brute_repeats(texts, unit, least), strict=True))
    assert got == want and any(x[1] for x in want.values())
    cut = {r.doc_id: r for r in line_dedup.remove_repeats(docs, unit=unit, run_words=least).collect()}
    for i, t in texts:
        assert cut[i].text == "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in want[i][3]))


def test_line_cases(spark, cases, empty):
    for unit in line_dedup.UNITS:
        got = {r.doc_id: r for r in line_dedup.repeated_units(cases, unit=unit, run_words=1).collect()}
        assert line_dedup.repeated_units(cases, unit=unit).count() == len(CASES) and got[1].n_units == got[2].n_units == 0 and got[None].n_removed == 0
        assert got[4].n_removed == 0 and got[5].n_removed == got[6].n_removed == 1 and got[5].kept_chars == got[6].kept_chars == 0
        assert line_dedup.repeated_units(empty, unit=unit).count() == line_dedup.remove_repeats(empty, unit=unit).count() == 0
    texts = [(2, "alpha beta gamma delta eps zeta. tail"), (1, "Head. Alpha  beta gamma delta eps zeta. alpha beta gamma delta eps zeta.")]
    out = {r.doc_id: r for r in line_dedup.remove_repeats(rows(spark, texts), run_words=6).collect()}
    assert out[2].text == " tail" and [tuple(s) for s in out[2].removed_spans] == [(0, 32)]
    assert [tuple(s) for s in out[1].removed_spans] == [(39, 72)] and out[1].text == texts[1][1][:39]


def test_lines_of_rows_that_share_an_id(spark):
    """Spans are cut from their own row's text, whatever stands under the same id; equal rows are cut alike."""
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen. "
    texts = [(1, line), (9, "short"), (9, "a completely other and longer text of its own that says nothing twice elsewhere"), (9, f"Begin. {line}End."), (9, f"Begin. {line}End."), (None, line)]
    found = [r for r in line_dedup.repeated_units(rows(spark, texts)).collect()]
    assert sorted(r.kept_chars for r in found) == sorted([len(line), 5, len(texts[2][1]), 11, 11, len(line)])
    got = sorted((r.text for r in line_dedup.remove_repeats(rows(spark, texts)).collect()))
    assert got == sorted([line, "short", texts[2][1], "Begin. End.", "Begin. End.", line])
    most = rows(spark, [(k, f"{line}\nown {k}") for k in range(3000)])  # one line in every document
    assert {r.n_removed for r in line_dedup.repeated_units(most).where("doc_id > 0").collect()} == {1}


def test_warc_round_trip(spark):
    body = "x" * 1200
    pages = [(1, "http://a/1", body), (2, None, body), (3, "u r l\n", body), (4, "d", "short"), (5, "d", "short"), (6, "e", None), (None, "f", body), (7, "g", "é" * 700)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("keep", F.lit(1)).withColumn("size", F.lit(2))
    back = {r.page_id: r for r in warc.read_archives(warc.write_archives(df, archive_bytes=2000)).collect()}
    assert len(back) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        r = back[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else data)
    assert [(i, back[i].record_type, back[i].refers_to) for i in (1, 2, 3, None, 5)] == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (None, "response", None), (5, "response", None)]
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    records = [warc.record(i, "u", str(i).encode() * 50, None, "d") for i in range(200)]
    data = warc.archive(records)
    assert data[:4] == (warc.MAGIC).to_bytes(4, "little") and [r["page_id"] for r in warc.parse(data)] == list(range(200))


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    kept, docs = {}, spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            first = {}
            for i, t in sorted(before.items(), key=lambda x: (-len(x[1]), x[0])):
                first.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), i)
            assert kept[name] == set(first.values())
        if name == "near_dedup":
            assert kept[name] == {i for i, (_, c) in brute_components(list(before.items()), 5).items() if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
            assert kept[name] == {i for i, t in before.items() if not any(x in t for x in items)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} <= kept["decontamination"]


def test_pipeline_cases(spark, empty):
    """Every stage on nulls, empty texts, shared ids, clashing and extra columns, and an empty table."""
    import corpus_pipeline

    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    words = " ".join(f"w{k}" for k in range(40))
    texts = [(1, None), (2, ""), (None, "one two"), (3, "one  two"), (4, "one two three four"), (5, words), (6, words + " end"), (7, words.upper()), (8, f"So: {item} Yes."), (9, "Other."), (9, "one two"), (None, None), (11, "word " * 400_000)]
    docs = rows(spark, texts).withColumn("file_at", F.lit("x")).withColumn("kept", F.lit("y"))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        out = stage(spark, docs, DIR)
        assert set(docs.columns) <= set(out.columns) and stage(spark, docs.limit(0), DIR).count() == 0
        ids = [r.doc_id for r in out.select("doc_id", "file_at", "kept").collect() if r.file_at == "x" and r.kept == "y"]
        if name == "exact_dedup":  # 1 and 2 are equal, 3 is the longest of its texts, one row of 9 is another text
            assert sorted(map(str, ids)) == sorted(map(str, [1, None, 3, 4, 5, 6, 7, 8, 9, 9, None, 11]))
        if name == "near_dedup":
            assert sorted(map(str, ids)) == sorted(map(str, [1, 2, None, 3, 4, 5, 8, 9, 9, None, 11]))
        if name == "decontamination":
            assert sorted(map(str, ids)) == sorted(str(i) for i, _ in texts if i != 8)


def test_very_long_texts(spark):
    """Texts beyond the bytes that the kernels handle at once, and chunks and senders that end within a task."""
    rng = np.random.default_rng(9)
    vocab = [f"v{k}" for k in range(5000)]
    long = [" ".join(rng.choice(vocab, 300_000)) for _ in range(2)]  # of more than common.SLICE_BYTES
    texts = [(1, long[0]), (2, "  " + long[0]), (3, long[0] + " one more"), (4, long[1]), (5, "short"), (6, None)]
    assert len(long[0]) > common.SLICE_BYTES
    df = rows(spark, texts).coalesce(1)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=2).collect()}
    assert near == brute_components([(i, t) for i, t in texts], 2)
    assert {r.doc_id: r.keep_id for r in exact_dedup.duplicate_groups(df).collect()} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}
    some = [(i, t and t[:60_000]) for i, t in texts]
    want = {r[0]: r[5] for r in brute_ppm(some, ppm.ORDER)}
    assert {r.doc_id: r.score for r in ppm.score_texts(rows(spark, some).coalesce(1), chunk_bytes=50_000).collect()} == pytest.approx(want, rel=1e-9)
    found = {r.doc_id: r for r in licenses.scan_licenses(rows(spark, [(1, long[0] + " mit license")])).collect()}
    assert found[1].n_words == 300_002 and found[1].first_word == 300_000
    bench = spark.createDataFrame([(1, "which of these is the last one? the very last.")], "item_id long, text string")
    leaks = decontamination.find_leaks(rows(spark, [(1, long[0] + " Which of these is the last one? The very last. " + long[1])]), bench).collect()
    assert [r.item_id for r in leaks] == [1]
    assert line_dedup.repeated_units(rows(spark, [(1, long[0]), (2, "x. " + long[0])])).where("n_removed > 0").first().kept_chars == 2
