import math
import operator
import re
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import vectors as V
from orrery.operators import ann, augment, clickstream, collections, features, filters, improve, indexing, search, splitters, suggest, tasks
from orrery.sources import loaders
from orrery.streaming import clickstream as streaming


def test_vectors(spark):
    row = spark.range(1).select(V.cosine_distance(V.literal([1, 0]), V.literal([2, 0])).alias("c"), V.l2_distance(V.literal([0, 0]), V.literal([3, 4])).alias("l"), V.soft_extreme(V.literal([1, 2, 3]), 1e5).alias("s"), V.padded(F.array(V.literal([1, 2])), 2, 2).alias("p")).first()
    assert (row.c, row.l, row.s, row.p) == (0.0, 5.0, 3.0, [[1.0, 2.0], [0.0, 0.0]])
    with pytest.raises(ValueError):
        V.distance("none", F.lit(1), F.lit(1))


def test_filter_cases(spark):
    df = spark.createDataFrame([(1, '{"a":1,"t":["x",2],"s":"Hello big World","n":null,"b":true}'), (2, '{"a":"abc"}'), (3, None)], "id int, payload string")

    def ids(spec):
        return [r.id for r in df.where(filters.compile_filter(spec)).orderBy("id").collect()]

    assert ids({"term": {"field": "a", "value": 1}}) == [1]
    assert ids({"term": {"field": "b", "value": True}}) == [1]
    assert ids({"terms": {"field": "a", "values": []}}) == [1, 2, 3]
    assert ids({"exists": {"field": "n"}}) == [1]
    assert ids({"all": {"field": "t", "values": ["x", 2]}}) == [1]
    assert ids({"any": {"field": "t", "values": ["z"]}}) == []
    assert ids({"match_phrase": {"field": "s", "value": "big world"}}) == [1]
    assert ids({"wildcard": {"field": "s", "value": "wor*"}}) == [1]
    assert ids({"type": "range", "field": "a", "gte": 1}) == [1]
    assert ids({"bool": {"must_not": [{"exists": {"field": "a"}}]}}) == [3]
    assert ids({"bool": {}}) == [1, 2, 3]
    assert ids({"nothing": {}}) == ids({"type": "nothing", "field": "a"}) == [1, 2, 3]
    with pytest.raises(ValueError):
        T.text_query(F.array(), "a & ")


def test_pages_and_strategies(spark):
    objects = spark.createDataFrame([(str(i), "{}", None, None) for i in range(20)], "object_id string, payload string, original_id string, user_id string")
    parts = spark.createDataFrame([(f"{i}:{k}", str(i), [float(i + 1), float(k + 1)], False) for i in range(20) for k in range(2)], "part_id string, object_id string, vector array<float>, is_average boolean")
    c = search.Collection(objects, parts, "euclid", 2)
    pages = [{r.object_id for r in search.similar(c, [1.0, 1.0], 7, o).collect()} for o in (0, 7, 14)]
    assert sum(map(len, pages)) == 20 and len(set.union(*pages)) == 20
    assert search.next_offset(7, 7, 0) == 7 and search.next_offset(6, 7, 14) is None
    post = {r.object_id for r in search.similar(c, [1.0, 1.0], 3, strategy="post_filter", enlarged_limit=6).collect()}
    assert post <= pages[0]
    with pytest.raises(ValueError):
        search.similar(c, [1.0], 3)


def test_ann_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    parts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "part_id long, vector array<double>")
    centres = ann.train_centroids(parts, 8)
    assigned = ann.assign(parts, centres).cache()
    hits = 0
    for q in x[:10]:
        got = {r.part_id for r in ann.search(assigned, centres, q.tolist(), 10, 6, "euclid").collect()}
        hits += len(got & set(np.argsort(((x - q) ** 2).sum(1))[:10].tolist()))
    assert hits >= 90


def test_ann_recall_of_defaults(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("part_id"), F.col("embedding").alias("vector")).cache()
    rows = sorted((r.part_id, r.vector) for r in e.collect())
    x = np.array([v for _, v in rows], dtype=float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = ann.train_centroids(e)
    assigned = ann.assign(e, centres).cache()
    shares = []
    for i in range(len(rows)):
        if rows[i][0] % 20 == 0:
            true = {rows[j][0] for j in np.argsort(-unit @ unit[i], kind="stable")[:10]}
            shares.append(len(true & {r.part_id for r in ann.search(assigned, centres, x[i].tolist(), 10).collect()}) / 10)
    print(f"recall@10 of the defaults: {np.mean(shares):.3f} on average, {min(shares)} at worst, {len(shares)} queries")
    assert len(centres) == 32 and len(shares) == 100 and np.mean(shares) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dot"])
def test_batch_searches_against_all_pairs(spark, metric, monkeypatch):
    """Ids as texts and numbers, copies, near copies, vectors of no length, nulls, several blocks of queries and tiles of parts."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    monkeypatch.setattr(search, "TILE_PARTS", 64)
    monkeypatch.setattr(search, "TILE_PAIRS", 1024)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    x[100:250], x[300:330], x[7], x[8] = x[100], x[300] * 3, 0, -0.0
    x[400:450] = x[400] + rng.normal(size=(50, 6)).astype(np.float32) * 1e-7
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(600), x, strict=True)] + [(600, None)]
    parts = spark.createDataFrame(rows, "part_id long, vector array<float>").repartition(5).cache()
    asked = parts.where("part_id % 5 = 0").select(F.col("part_id").alias("query_id"), "vector")
    centres = ann.train_centroids(parts, 8)
    assigned = ann.assign(parts, centres).cache()

    def gap(a, b):
        total = lambda v: reduce(operator.add, v, 0.0)  # noqa: E731  sum() makes up for rounding
        if metric == "cosine":
            n = total([p * p for p in a]) * total([p * p for p in b])
            return 1 - total([p * r for p, r in zip(a, b, strict=True)]) / math.sqrt(n) if n else None
        return math.sqrt(total([(p - r) * (p - r) for p, r in zip(a, b, strict=True)])) if metric == "euclid" else -total([p * r for p, r in zip(a, b, strict=True)])

    def true(cells=None, name=int):
        want = set()
        for i, q in rows:
            if i % 5 == 0 and q:
                near = sorted((d, name(j)) for j, v in rows if v and (cells is None or cells[j] in nearest[i]) and (d := gap(q, v)) is not None)
                want |= {(i, j, d, rank) for rank, (d, j) in enumerate(near[:7], 1)}
        return want

    assert {tuple(r) for r in search.batch_similar(asked, parts, 7, metric).collect()} == true()
    cells = {r.part_id: r.cell for r in assigned.collect()}
    nearest = {i: set(np.argsort(((centres - np.array(q)) ** 2).sum(1))[:3].tolist()) for i, q in rows if q}
    named = assigned.withColumn("part_id", F.col("part_id").cast("string"))
    assert cells[600] is None
    assert {tuple(r) for r in ann.batch_search(named, centres, asked, 7, 3, metric).collect()} == true(cells, str)


def test_batch_search_makes_no_row_for_each_pair(spark):
    parts = spark.range(2_000).select(F.col("id").alias("part_id"), F.array(*[F.randn(i) for i in range(16)]).alias("vector")).cache()
    asked = parts.where("part_id % 20 = 0").select(F.col("part_id").alias("query_id"), "vector")
    centres = ann.train_centroids(parts)
    found = ann.batch_search(ann.assign(parts, centres), centres, asked, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 1_000 and "Join" not in plan and "Generate" not in plan


def test_centroids_sample_by_hash(spark):
    """The bound on hashes cuts none of the sample."""
    e = spark.range(5_000).select(F.col("id").alias("part_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    sample = [r.part_id for r in e.orderBy(F.xxhash64("part_id"), "part_id").limit(100).collect()]
    assert sorted(ann.train_centroids(e, 100, 100, 0)[:, 0].tolist()) == sorted(map(float, sample))


def test_suggest_matches_sequential_walk(spark):
    rows = [("red bolt", 0.9, ["a"], ["d"]), ("red nut", 0.8, ["a"], ["d"]), ("red ring", 0.7, ["b", "a"], ["d"]), ("rad ring", 0.6, ["c"], []), ("none", 0.5, [], [])]
    docs = suggest.phrase_documents(spark.createDataFrame(rows, "phrase string, prob double, labels array<string>, domains array<string>"))
    assert [r.phrase for r in suggest.suggest(docs, "red ", 10).collect()] == ["red bolt", "red ring", "rad ring"]
    assert suggest.request("Red bo") == suggest.Request(("red",), "bo")
    assert suggest.edit_set(docs, "labels", ["a"], remove=True).where("array_contains(labels, 'a')").count() == 0


def test_collections(spark, tmp_path):
    cat = collections.Catalog(spark, f"file://{tmp_path}")
    cat.create(collections.CollectionInfo("c", 2), with_queries=True)
    assert cat.exists("c_q")
    cat.set_blue("c")
    assert cat.blue().collection_id == "c"
    with pytest.raises(ValueError):
        cat.delete("c")
    old = spark.createDataFrame([("1", "a", None), ("1_u", "b", "1"), ("2", "c", None)], "object_id string, payload string, original_id string")
    ids = spark.createDataFrame([("1_u",)], "object_id string")
    assert {r.object_id for r in collections.cascade_ids(old, ids).collect()} == {"1", "1_u"}
    new = spark.createDataFrame([("2", "z", None)], "object_id string, payload string, original_id string")
    once = collections.upsert(old, new, "object_id")
    assert sorted(map(tuple, collections.upsert(once, new, "object_id").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert cat.optimize("c", "x", lambda *_: None) and not cat.optimize("c", "x", lambda *_: None)


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
@pytest.mark.parametrize("aggregate", ["min", "avg"])
def test_similarity_gradients(metric, aggregate):
    """Analytic gradients against differences, for several query vectors."""
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    s, g = improve.similarity(q, x, metric, aggregate, 0.7)
    for i in range(4):
        for k in range(5):
            step = np.zeros_like(x)
            step[i, k] = 1e-6
            up, down = (improve.similarity(q, x + z, metric, aggregate, 0.7)[0] for z in (step, -step))
            assert np.allclose((up - down)[i] / 2e-6, g[i, k], atol=1e-6) and np.allclose(np.delete(up, i), np.delete(s, i))
    clicked = np.array([True, False, True, False])
    moved = improve.similarity(q, improve.adjust(q, x, clicked, 0.01, 5, metric, aggregate, 0.7), metric, aggregate, 0.7)[0]
    loss = lambda v: -(v[clicked] ** 3).mean() + (v[~clicked] ** 3).mean()
    assert loss(moved) < loss(s)


def test_confidences_by_hand(spark):
    """A session of five without a click, its shares all 0: (1 - s) fades with the position; and one with a click."""
    rows = spark.createDataFrame([(1, i, 0.5, 0) for i in range(5)] + [(2, 0, 0.9, 1), (2, 1, 0.5, 0), (2, 2, 0.1, 0)], "session_id int, position int, rank double, clicked int")
    got = {(r.session_id, r.position): r.confidence for r in features.confidences(rows).collect()}
    assert [round(got[1, i], 3) for i in range(5)] == [1.0, 0.504, 0.231, 0.082, 0.0]
    fade = [math.exp(-(i + 1) - 0.3) + 0.25 for i in range(3)]
    raw = [(1 - 0.2 / 0.7) * 0.5 + 0.5 * 0.2 / 0.7, 2 / 3, (1 - 0.2 / 0.3)]
    raw = [a * b for a, b in zip(raw, fade, strict=True)]
    assert [got[2, i] for i in range(3)] == pytest.approx([(x - min(raw)) / (max(raw) - min(raw)) for x in raw], abs=1e-6)


def test_shifts_and_losses_by_hand(spark):
    old = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.9, 0), (2, "a", 0.5, 0), (2, "b", 0.4, 0)], "session_id int, id string, rank double, clicked int")
    new = spark.createDataFrame([(1, "a", 0.7), (1, "b", 0.1), (2, "a", 0.3), (2, "b", 0.4)], "session_id int, id string, rank double")
    got = features.distance_shift(old, new).first()
    assert (got.not_irrelevant_dist_shift, got.irrelevant_dist_shift) == (pytest.approx(0.2), pytest.approx(0.1))
    assert features.distance_shift(old, new, False).first().not_irrelevant_dist_shift == pytest.approx(-0.2)
    assert features.distance_shift(old.where("session_id = 1"), new).first().irrelevant_dist_shift == 0.0
    pair = spark.createDataFrame([(0.5, 0.5, 1, 1.0, 1.0)], "positive_rank double, negative_rank double, target int, positive_confidence double, negative_confidence double")
    assert features.cosine_margin_loss(pair, 1e-9).first().loss == pytest.approx(1 / (1 + math.exp(6)), rel=1e-5)
    assert features.margin_loss(pair, 1.0).first().loss == pytest.approx(1 / (1 + math.exp(-1)))
    with pytest.raises(ValueError):
        features.margin_loss(pair, 0)


def test_session_pairs(spark):
    rows = spark.createDataFrame([(s, p, int(s < 3 and p == 0)) for s in range(10) for p in range(2)], "session_id int, position int, clicked int")
    got = features.paired_inputs(rows).collect()
    assert sorted(r.k for r in got) == list(range(7)) and {r.irrelevant for r in got} == set(range(3, 10))
    assert sorted(Counter(r.relevant for r in got).values()) == [2, 2, 3]
    assert features.paired_inputs(rows, 4).count() == 4
    assert {r.irrelevant for r in features.paired_inputs(rows.where("session_id < 3")).collect()} == {None}
    assert features.paired_inputs(rows.where("session_id > 2")).count() == 0 == features.paired_inputs(rows.limit(0)).count()


def test_glue_and_fuzzy(spark):
    df = spark.createDataFrame([(["a", "b", "-", "c", "d", "."],), ([".", "x", "/"],), (["-", "y", "-", "-", "z"],), ([],)], "c array<string>")
    assert [r.t for r in df.select(T.glue(F.col("c")).alias("t")).collect()] == ["a b-c d.", ". x/", "- y-- z", ""]
    p = re.compile(suggest.fuzzy_pattern("ca.e"))
    assert all(p.search(x) for x in ("ca.e", "CA.Es", "xa.e", "caxe", "xya.e")) and not any(p.search(x) for x in ("cab1e", "a.e", "1a.e"))
    assert suggest.fuzzy_pattern("") == ""
    with pytest.raises(ValueError):
        suggest.fuzzy_pattern("x" * 100)


def test_index_stages(spark):
    def embed(df):
        return df.withColumn("vector", F.when(F.col("part") != "bad", F.array(F.lit(1.0), F.length("part").cast("double"))))

    items = spark.createDataFrame([("a", "x|yy"), ("b", None), ("c", " "), ("d", "ok|bad"), ("a", None)], "item_id string, item string")
    got = indexing.prepare(items, lambda c: splitters.by_separators(c, ["|"]), embed, 2, average=True)
    assert [r.object_id for r in got.objects.collect()] == ["a"] and {r.part_id: list(r.vector) for r in got.parts.collect()} == {"a:0": [1, 1], "a:1": [1, 2], "a:average": [1, 1.5]}
    assert sorted((r.object_id, r.stage) for r in got.failed.collect()) == [("b", "load"), ("c", "split"), ("d", "embed")]
    out, state = indexing.reindex(got.objects, got.objects.limit(0), got.parts.limit(0), embed, 2, budget=0)
    assert tuple(state.first()) == (1, 0, False) and out.parts.count() == 1


def test_improvement_moves_clicked_nearer():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=4), rng.normal(size=(6, 4))
    clicked = np.array([True, True, False, False, False, False])
    x[:2] = q + 0.5 * rng.normal(size=(2, 4))
    y = improve.adjust(q, x, clicked, 0.01, 5)
    cos = lambda a: (a @ q) / np.linalg.norm(a, axis=1)
    assert (cos(y)[:2] > cos(x)[:2]).all() and (cos(y)[2:] <= cos(x)[2:] + 1e-3).all()


def test_splitters_and_augment(spark):
    assert splitters.sentences("A b. C d! ```x. y``` E.") == ["A b.", "C d!", "```x. y```", "E."]
    pieces = spark.createDataFrame([(["a b", "c", "d e f g"],), (None,), ([],)], "p array<string>")
    assert [r.g for r in pieces.select(splitters.group_tokens(F.col("p"), 3).alias("g")).collect()] == [["a b c", "d e f", "g"], [], []]
    df = spark.createDataFrame([(1, "Hello world")], "id long, text string")
    assert {r.text for r in augment.change_cases(df).collect()} == {"Hello world", "hello world", "HELLO WORLD"}
    assert augment.misspell("hello world", 0.3, "s") == augment.misspell("hello world", 0.3, "s")
    assert augment.select_random(augment.change_cases(df), 2).count() == 2
    assert augment.compose(df, augment.change_cases).count() == 4


def test_clickstream_batches(spark):
    b = spark.createDataFrame([("b1", 3, 10, "collecting", None, None)], "batch_id string, session_counter int, created_at int, status string, release_id string, released_at long")
    once = clickstream.release_batch(b, "r1", "b2", 20)
    assert {(r.batch_id, r.status) for r in once.collect()} == {("b1", "released"), ("b2", "collecting")}
    assert {(r.batch_id, r.status) for r in clickstream.release_batch(once, "r1", "b3", 30).collect()} == {("b1", "released"), ("b2", "collecting")}


def test_streaming_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    (tmp_path / "in").mkdir()
    batch.write.mode("overwrite").parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "e"))
    q = streaming.deduplicated(stream, ["event_id"]).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("dedup").count() == batch.dropDuplicates(["event_id"]).count()


def test_tasks(spark):
    old = spark.createDataFrame([("a", "processing", 1), ("b", "failed", 2)], "task_id string, status string, created_at int")
    new = spark.createDataFrame([("b", "pending", 3), ("c", "pending", 3)], "task_id string, status string, created_at int")
    assert tasks.create_tasks(old, new).count() == 3
    assert {(r.task_id, r.status) for r in tasks.restart(tasks.restart(old, "a"), "b").collect()} == {("a", "processing"), ("b", "pending")}
    locks = spark.createDataFrame([("m1", "m2")], "src string, dst string")
    req = spark.createDataFrame([("t1", "m2", "m3", 1), ("t2", "m4", "m5", 2), ("t3", "m6", "m7", 3)], "task_id string, src string, dst string, created_at int")
    assert [r.task_id for r in tasks.admissible(req, locks, 2).collect()] == ["t2"]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("one\ntwo")
    assert [r.item for r in loaders.text_files(spark, str(tmp_path / "a")).collect()] == ["one\ntwo"]
    assert [bytes(r.item) for r in loaders.binary_files(spark, str(tmp_path / "a"), "*.txt").collect()] == [b"one\ntwo"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"rows": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}')
    got = loaders.json_files(spark, str(tmp_path / "j"), list_field="rows", fields=["a", "b"]).orderBy("item_id").collect()
    assert [(r.item_id.rsplit(":", 1)[1], r.a, r.b) for r in got] == [("0", 1, "x"), ("1", 2, None)]
    assert loaders.count(loaders.page(spark.range(10), "id", 5, 7)).first().n == 3


def test_suggestion_alignment(spark):
    df = spark.createDataFrame([(["red", "steel", "bolt"],)], "chunks array<string>")
    at = suggest.match_position(F.col("chunks"), "ste")
    assert tuple(df.select(*suggest.aligned(F.col("chunks"), at)).first()) == ("red", "steel", "bolt")
    assert df.select(suggest.match_position(F.col("chunks"), "zinc")).first()[0] == 2


def test_training_helpers(spark):
    runs = spark.createDataFrame([("e", 1, 0.5, "FINISHED"), ("e", 2, 0.5, "FINISHED"), ("e", 3, 0.1, "FAILED"), ("f", 4, None, "FINISHED")], "experiment string, params_id int, q double, status string")
    assert [tuple(r) for r in features.best_quality(runs, "q", False).collect()] == [("e", 1, 0.5)]
    ids = spark.range(3)
    assert features.files_to_load(ids, ids, spark.range(5)).count() == 5
    old = spark.createDataFrame([("a", "pending", 1, "m")], "task_id string, status string, created_at int, model string")
    assert tasks.by_value(old, "model", "m").count() == 1 and tasks.remove_tasks(old, old).count() == 0


def test_borrowed_positives(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 2, 0), ("a", 3, 3, 0), ("b", 1, 4, 1), ("b", 2, 5, 0), ("b", 3, 6, 1)], "session_id string, position int, id int, clicked int")
    lenders = spark.createDataFrame([("a", "b"), ("b", "a")], "session_id string, lender_id string")
    assert sorted(map(tuple, features.borrow_positives(rows, lenders).collect())) == [("a", 0, 4, 1), ("a", 1, 6, 2)]


def test_split_top_up(spark):
    # sessions of 20 results each: by overlap alone none is test
    rows = spark.range(2000).select((F.col("id") % 100).alias("session_id"), "id")
    got = {r.session_id: r.split for r in features.train_test_split(rows).collect()}
    assert len(got) == 100 and sum(x == "test" for x in got.values()) == 20
    assert got == {r.session_id: r.split for r in features.train_test_split(rows.repartition(7)).collect()}
    short = spark.range(300).select(F.col("id").alias("session_id"), F.col("id"))  # one result each, enough of them test
    whole, bare = (sorted((r.session_id, r.split) for r in features.train_test_split(short, 0.2, s, top_up=u).collect()) for s, u in (("t", True), ("t", False)))
    n = sum(x == "test" for _, x in bare)
    assert sum(x == "test" for _, x in whole) == max(n, 60) and set(x for x in bare if x[1] == "test") <= set(whole)
    assert features.train_test_split(rows.limit(0)).count() == 0


def test_suggestion_close_match(spark):
    df = spark.createDataFrame([(["red", "steel", "bolt", "set"],), (["steal", "steele", "x"],), ([],), (None,)], "chunks array<string>")
    at = [r[0] for r in df.select(suggest.match_position(F.col("chunks"), "stele")).collect()]
    assert at[:3] == [1, 1, -1]  # both steal and steele are close, steele is closest
    assert [r[0] for r in df.limit(1).select(suggest.match_position(F.col("chunks"), "zinc")).collect()] == [3]
    assert [r[0] for r in df.limit(1).select(suggest.match_position(F.col("chunks"), "st")).collect()] == [1]
