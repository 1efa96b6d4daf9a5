"""The registered queries of the search engine and their SQL.

The driver's tables stand in for the engine's: embeddings are parts (four to an object), documents the payload of
objects with the same id, events clicks and sessions, lineitem ranked results, part names phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import augment, clickstream, collections, features, filters, search, selectors, splitters, suggest
from orrery.sources import loaders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def parts(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("part_id"), F.expr("vec_id div 4").alias("object_id"), F.col("embedding").alias("vector"), F.lit(False).alias("is_average"))


def objects(spark, sf_dir) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    payload = collections.payload_of(lang=F.col("lang"), source=F.col("source"), n_chars=F.col("n_chars"))
    return d.select(F.col("doc_id").alias("object_id"), payload.alias("payload"), F.lit(None).cast("long").alias("original_id"), F.lit(None).cast("string").alias("user_id"))


def query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return [float(x) for x in t(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


def collection(spark, sf_dir, metric: str = "cosine") -> search.Collection:
    return search.Collection(objects(spark, sf_dir), parts(spark, sf_dir), metric)


_Q = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"
_P = f"{_Q}, p AS (SELECT vec_id AS part_id, vec_id // 4 AS object_id, list_cosine_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q)"
_O = "o AS (SELECT doc_id AS object_id, lang, source, n_chars FROM documents)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered similarity search over multi-part objects."""
    spec = {"bool": {"must": [{"terms": {"field": "lang", "values": ["en", "fr"]}}, {"range": {"field": "n_chars", "gte": 100}}]}}
    found = search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, filter=spec, max_distance=1.5)
    return found.select("object_id", r6("distance").alias("distance"), F.array_join(F.transform("part_ids", lambda x: x.cast("string")), ",").alias("part_ids"), "subset_count")


_FLAG = f"""WITH {_P}, {_O}, g AS (SELECT object_id, min(d) AS distance, string_agg(part_id::VARCHAR, ',' ORDER BY d, part_id) AS part_ids
FROM p JOIN o USING (object_id) WHERE d <= 1.5 AND lang IN ('en', 'fr') AND n_chars >= 100 GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance, part_ids, count(*) OVER () AS subset_count FROM g ORDER BY g.distance, object_id LIMIT 10"""


@query(_FLAG)
def search_prefilter(spark, sf_dir):
    return flagship(spark, sf_dir)


def _knn(name: str, metric: str, expr: str) -> None:
    def run(spark, sf_dir):
        near = search.part_distances(collection(spark, sf_dir, metric), query_vector(spark, sf_dir))
        return near.orderBy("distance", "part_id").limit(10).select("part_id", r6("distance").alias("distance"))

    QUERIES[name] = run
    SQL[name] = f"WITH {_Q} SELECT vec_id AS part_id, round({expr}, 6) AS distance FROM embeddings, q ORDER BY {expr}, vec_id LIMIT 10"


_knn("knn_cosine", "cosine", "list_cosine_distance(embedding::DOUBLE[], q.v)")
_knn("knn_l2", "euclid", "list_distance(embedding::DOUBLE[], q.v)")
_knn("knn_ip", "dot", "-list_dot_product(embedding::DOUBLE[], q.v)")


@query(f"WITH {_P} SELECT part_id, round(d, 6) AS distance FROM p WHERE d <= 0.9")
def knn_within_radius(spark, sf_dir):
    return search.part_distances(collection(spark, sf_dir), query_vector(spark, sf_dir), max_distance=0.9).select("part_id", r6("distance").alias("distance"))


@query(f"WITH {_P} SELECT object_id, round(min(d), 6) AS distance, string_agg(part_id::VARCHAR, ',' ORDER BY d, part_id) AS part_ids FROM p GROUP BY object_id")
def knn_multi_part_rollup(spark, sf_dir):
    got = search.rollup(search.part_distances(collection(spark, sf_dir), query_vector(spark, sf_dir)))
    return got.select("object_id", r6("distance").alias("distance"), F.array_join(F.transform("part_ids", lambda x: x.cast("string")), ",").alias("part_ids"))


@query(f"WITH {_P}, g AS (SELECT object_id, avg(d) AS d FROM p GROUP BY object_id) SELECT object_id, round(d, 6) AS distance FROM g ORDER BY d, object_id LIMIT 20")
def knn_avg_aggregation(spark, sf_dir):
    got = search.rollup(search.part_distances(collection(spark, sf_dir), query_vector(spark, sf_dir)), "avg")
    return got.orderBy("distance", "object_id").limit(20).select("object_id", r6("distance").alias("distance"))


@query(f"""WITH {_Q}, e AS (SELECT vec_id // 4 AS object_id, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
m AS (SELECT object_id, i, avg(x) AS x FROM e GROUP BY ALL), a AS (SELECT object_id, list(x ORDER BY i) AS v FROM m GROUP BY object_id)
SELECT object_id, round(list_cosine_distance(a.v, q.v), 6) AS distance FROM a, q""")
def knn_average_only(spark, sf_dir):
    c = collection(spark, sf_dir)
    whole = search.Collection(c.objects, splitters.average_parts(c.parts), c.metric)
    return search.part_distances(whole, query_vector(spark, sf_dir), average_only=True).select("object_id", r6("distance").alias("distance"))


@query(f"""WITH {_P}, {_O}, n AS (SELECT * FROM p ORDER BY d, part_id LIMIT 60), g AS (SELECT object_id, min(d) AS distance FROM n JOIN o USING (object_id) WHERE lang = 'en' GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance FROM g ORDER BY g.distance, object_id LIMIT 10""")
def search_postfilter(spark, sf_dir):
    got = search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, filter={"term": {"field": "lang", "value": "en"}}, strategy="post_filter", enlarged_limit=60)
    return got.select("object_id", r6("distance").alias("distance"))


@query(f"""WITH {_P}, {_O}, g AS (SELECT object_id, min(d) AS distance, any_value(n_chars) AS n FROM p JOIN o USING (object_id) GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance FROM g ORDER BY n DESC, object_id LIMIT 10""")
def search_field_order(spark, sf_dir):
    got = search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, sort_by=("n_chars", False))
    return got.select("object_id", r6("distance").alias("distance"))


@query(f"""WITH {_P}, {_O}, g AS (SELECT object_id, min(d) AS distance FROM p JOIN o USING (object_id) GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance FROM g ORDER BY g.distance, object_id LIMIT 10 OFFSET 10""")
def search_page_two(spark, sf_dir):
    return search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, 10).select("object_id", r6("distance").alias("distance"))


@query(f"""WITH {_Q}, p AS (SELECT vec_id // 4 AS object_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT object_id, v, object_id % 10 = 0 AS own FROM p),
d AS (SELECT object_id, own, list_distance(CASE WHEN own THEN list_transform(m.v, lambda x: x * 0.5) ELSE m.v END, q.v) AS d FROM m, q),
g AS (SELECT object_id, own, min(d) AS distance FROM d JOIN documents ON doc_id = object_id GROUP BY ALL)
SELECT object_id, object_id::VARCHAR || CASE WHEN own THEN '_u1' ELSE '' END AS found_id, round(distance, 6) AS distance FROM g ORDER BY g.distance, object_id LIMIT 20""")
def user_overlay(spark, sf_dir):
    c = collection(spark, sf_dir, "euclid")
    text = c.parts.withColumn("object_id", F.col("object_id").cast("string"))
    base = c.objects.withColumn("object_id", F.col("object_id").cast("string")).withColumn("original_id", F.lit(None).cast("string"))
    tenth = F.col("object_id").cast("long") % 10 == 0
    copies = base.where(tenth).withColumn("original_id", F.col("object_id")).withColumn("object_id", F.concat("object_id", F.lit("_u1"))).withColumn("user_id", F.lit("u1"))
    own = text.where(tenth).withColumn("object_id", F.concat("object_id", F.lit("_u1"))).withColumn("vector", F.transform("vector", lambda x: (x.cast("double") * 0.5)))
    both = search.Collection(base.unionByName(copies), text.withColumn("vector", V.as_vector("vector")).unionByName(own), "euclid")
    got = search.similar(both, query_vector(spark, sf_dir), 25, user_id="u1").withColumn("object_id", F.col("object_id").cast("long"))
    return got.orderBy("distance", "object_id").limit(20).select("object_id", "found_id", r6("distance").alias("distance"))


@query("""WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label), v AS (SELECT query_id, embedding::DOUBLE[] AS v FROM q JOIN embeddings ON vec_id = query_id),
d AS (SELECT query_id, vec_id AS part_id, list_cosine_distance(embedding::DOUBLE[], v) AS d FROM v, embeddings)
SELECT query_id, part_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), part_id)::INT AS rank FROM d QUALIFY rank <= 5""")
def batch_knn_per_label(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("query_id"))
    queries = firsts.join(e, firsts.query_id == e.vec_id).select("query_id", F.col("embedding").alias("vector"))
    return search.batch_similar(queries, parts(spark, sf_dir), 5).select("query_id", "part_id", F.abs(r6("distance")).alias("distance"), "rank")


@query(f"""WITH {_Q}, e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
c AS (SELECT label AS object_id, list_cosine_distance(list(x ORDER BY i), (SELECT v FROM q)) AS d FROM m GROUP BY label)
SELECT object_id::BIGINT AS object_id, round(1 / (1 + exp(-(1 - d - 0.8) * 10)), 6) AS probability FROM c WHERE 1 / (1 + exp(-(1 - d - 0.8) * 10)) > 0.0004""")
def category_probability_select(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("object_id"), F.col("embedding").alias("vector"))
    near = splitters.average_parts(e).select("object_id", V.cosine_distance(F.col("vector"), V.literal(query_vector(spark, sf_dir))).alias("distance"))
    return selectors.select_categories(near, "cosine", threshold=0.0004).select("object_id", r6("probability").alias("probability"))


def _filter(name: str, spec: dict, where: str) -> None:
    def run(spark, sf_dir):
        p = t(spark, sf_dir, "part")
        payload = collections.payload_of(name=F.col("p_name"), brand=F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), type=F.col("p_type"), size=F.col("p_size"), price=F.col("p_retailprice"), words=F.split("p_name", " "))
        return p.select("p_partkey", payload.alias("payload")).where(filters.compile_filter(spec)).select("p_partkey")

    QUERIES[f"filter_{name}"] = run
    SQL[f"filter_{name}"] = f"WITH p AS (SELECT * REPLACE (CASE WHEN p_size % 4 <> 0 THEN p_brand END AS p_brand), string_split(p_name, ' ') AS words FROM part) SELECT p_partkey FROM p WHERE {where}"


_filter("term", {"term": {"field": "size", "value": 7}}, "p_size = 7")
_filter("terms", {"terms": {"field": "brand", "values": ["Brand#11", "Brand#23"]}}, "p_brand IN ('Brand#11', 'Brand#23')")
_filter("range", {"range": {"field": "price", "gte": 950, "lt": 1000}}, "p_retailprice >= 950 AND p_retailprice < 1000")
_filter("exists", {"exists": {"field": "brand"}}, "p_brand IS NOT NULL")
_filter("any", {"any": {"field": "words", "values": ["red", "blue", "steel", "small"]}}, "list_has_any(words, ['red', 'blue', 'steel', 'small'])")
_filter("all", {"all": {"field": "words", "values": ["red", "widget"]}}, "list_has_all(words, ['red', 'widget'])")
_filter("match", {"match": {"field": "name", "value": "red | (blue & !steel)"}}, "list_contains(string_split(lower(p_name), ' '), 'red') OR (list_contains(string_split(lower(p_name), ' '), 'blue') AND NOT list_contains(string_split(lower(p_name), ' '), 'steel'))")
_filter("wildcard", {"wildcard": {"field": "name", "value": "s*"}}, "regexp_matches(lower(p_name), '(^| )s')")
_filter("bool_nested", {"bool": {"must": [{"range": {"field": "size", "gt": 10}}], "should": [{"term": {"field": "brand", "value": "Brand#11"}}, {"bool": {"filter": [{"range": {"field": "price", "lte": 1200}}]}}]}}, "p_size > 10 AND (coalesce(p_brand = 'Brand#11', false) OR p_retailprice <= 1200)")
_filter("must_not_and", {"bool": {"must_not": [{"range": {"field": "size", "gt": 10}}, {"range": {"field": "price", "gt": 950}}]}}, "NOT (p_size > 10 AND p_retailprice > 950)")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])version[^\p{L}\p{N}_]+2[^\p{L}\p{N}_]+0([^\p{L}\p{N}_]|$)')")
def filter_phrase(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    spec = {"match_phrase": {"field": "text", "value": "version 2.0", "force_not_payload": True}}
    return d.where(filters.compile_filter(spec, F.lit("{}"))).select("doc_id")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::INT >= 50")
def filter_event_props(spark, sf_dir):
    return t(spark, sf_dir, "events").where(filters.compile_filter({"range": {"field": "k", "gte": 50}}, "props")).select("event_id")


def _part_collection(spark, sf_dir) -> search.Collection:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), collections.payload_of(brand=F.col("p_brand"), size=F.col("p_size"), price=F.col("p_retailprice")).alias("payload"), F.lit(None).cast("long").alias("original_id"), F.lit(None).cast("string").alias("user_id"))
    li = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("part_id"))
    return search.Collection(p, li)


@query("""WITH o AS (SELECT p_partkey AS object_id, p_retailprice AS price FROM part WHERE p_size <= 20 ORDER BY price DESC, object_id LIMIT 25)
SELECT object_id, count(*) AS n_parts FROM o JOIN lineitem ON l_partkey = object_id GROUP BY object_id""")
def payload_search_sorted(spark, sf_dir):
    return search.payload_search(_part_collection(spark, sf_dir), 25, filter={"range": {"field": "size", "lte": 20}}, order=search.field_order("price", False)).select("object_id", "n_parts")


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#11'")
def payload_count(spark, sf_dir):
    return search.payload_count(_part_collection(spark, sf_dir), {"term": {"field": "brand", "value": "Brand#11"}})


@query("SELECT * FROM (SELECT p_partkey, (p_size > 25)::INT + (p_retailprice > 1200)::INT + (p_brand = 'Brand#11')::INT AS match_count FROM part) WHERE match_count >= 2")
def relax_conditions(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return filters.relaxed(p, [F.col("p_size") > 25, F.col("p_retailprice") > 1200, F.col("p_brand") == "Brand#11"]).select("p_partkey", "match_count")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS session_number FROM a""")
def sessions_from_events(spark, sf_dir):
    return clickstream.sessionize(t(spark, sf_dir, "events")).select("event_id", "user_id", "session_number")


def _sessions(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("created_at")).select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("session_id"), F.col("day").cast("string").alias("batch_id"), "created_at")


@query("""WITH s AS (SELECT user_id || '/' || ts::DATE AS session_id, ts::DATE::VARCHAR AS batch_id, epoch_us(min(ts)) AS created_at FROM events GROUP BY user_id, ts::DATE)
SELECT session_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, session_id)::INT AS session_number FROM s""")
def session_numbering(spark, sf_dir):
    return clickstream.number_sessions(clickstream.register_sessions(_sessions(spark, sf_dir))).select("session_id", "batch_id", "session_number")


@query("""WITH e AS (SELECT event_id, user_id, ts, event_id % 3 <> 0 AS old FROM events)
SELECT event_id, user_id, CASE WHEN old THEN 'log' ELSE 'new' END AS source FROM e UNION ALL SELECT event_id, user_id + 1, 'new' FROM e WHERE old AND event_id % 5 = 0""")
def dedupe_events(spark, sf_dir):
    """A log of two thirds of the events gets all of them, twice, and some under another session."""
    e = t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), "ts")
    log, new = e.where("event_id % 3 <> 0").withColumn("source", F.lit("log")), e.withColumn("source", F.lit("new"))
    other = new.where("event_id % 3 <> 0 and event_id % 5 = 0").withColumn("session_id", F.col("session_id") + 1)
    return clickstream.push_events(log, new.union(new).union(other)).select("event_id", F.col("session_id").alias("user_id"), "source")


@query("""WITH m AS (SELECT max(epoch_us(ts)) // 1000000 - 3600 AS now FROM events), e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) // 1000000 ELSE now END AS created_at, now FROM events, m)
SELECT event_id, created_at FROM e WHERE created_at BETWEEN now - 43200 AND now + 300""")
def late_event_guard(spark, sf_dir):
    """An hour before the last event: some lie too far ahead, most too far back, and each eleventh has no time."""
    e = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.expr("unix_seconds(cast(ts as timestamp))")).alias("created_at"), F.expr("unix_seconds(cast(ts as timestamp))").alias("at"))
    now = e.agg(F.max("at")).first()[0] - 3600
    return clickstream.timestamp_guard(e, now).select("event_id", "created_at")


def _results(spark, sf_dir) -> DataFrame:
    """Results of a session in order; lineitem's own numbers may repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    li = t(spark, sf_dir, "lineitem").withColumn("position", F.row_number().over(w))
    return li.select(F.col("l_orderkey").alias("session_id"), "position", F.col("position").alias("id"), (F.col("l_suppkey") % 3).alias("group_id"), F.col("l_discount").alias("rank"), F.col("l_tax").alias("new_rank"), (F.col("l_returnflag") == "R").cast("int").alias("clicked"))


_R = """r AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS position,
l_suppkey % 3 AS group_id, l_discount AS rank, l_tax AS new_rank, (l_returnflag = 'R')::INT AS clicked FROM lineitem)"""


@query(f"WITH {_R} SELECT session_id, position AS object_id, clicked = 1 AS is_clicked FROM r")
def clicked_vs_not(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumnRenamed("id", "object_id")
    return clickstream.clicked_split(rows.select("session_id", "object_id"), rows.where("clicked = 1")).select("session_id", "object_id", "is_clicked")


@query("SELECT l_orderkey AS session_id, sum((l_returnflag = 'R')::INT) = 0 AS is_irrelevant FROM lineitem GROUP BY 1")
def irrelevant_sessions(spark, sf_dir):
    return features.irrelevant_sessions(_results(spark, sf_dir))


_CONF = """c AS (SELECT *, avg(rank) OVER f + 1e-9 AS mean, avg(clicked::DOUBLE) OVER f AS share, row_number() OVER o AS i, count(*) OVER s AS n FROM r
WINDOW s AS (PARTITION BY session_id), o AS (PARTITION BY session_id ORDER BY position), f AS (PARTITION BY session_id ORDER BY position ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
d AS (SELECT *, abs(rank - mean) / mean AS near FROM c),
e AS (SELECT *, (CASE WHEN clicked = 1 THEN (1 - near) * share + (1 - share) * near ELSE (1 - share) * (1 - near) + share * near END) * (exp(-3 * i / n - 0.3) + 0.25) AS score FROM d),
k AS (SELECT *, (score - min(score) OVER s) / (max(score) OVER s - min(score) OVER s + 1e-9) AS confidence FROM e WINDOW s AS (PARTITION BY session_id))"""


@query(f"WITH {_R}, {_CONF} SELECT session_id, position, round(confidence + 1e-9, 5) AS confidence FROM k")
def click_confidences(spark, sf_dir):
    return features.confidences(_results(spark, sf_dir)).select("session_id", "position", F.round(F.col("confidence") + 1e-9, 5).alias("confidence"))


@query(f"WITH {_R}, {_CONF} SELECT session_id, position, group_id, round(max(confidence) OVER (PARTITION BY session_id, group_id) + 1e-9, 5) AS confidence FROM k")
def group_confidences(spark, sf_dir):
    got = features.group_confidences(features.confidences(_results(spark, sf_dir)))
    return got.select("session_id", "position", "group_id", F.round(F.col("confidence") + 1e-9, 5).alias("confidence"))


@query(f"WITH {_R} SELECT session_id, position, 1.0::DOUBLE AS confidence FROM r")
def unit_confidences(spark, sf_dir):
    return features.unit_confidences(_results(spark, sf_dir)).select("session_id", "position", "confidence")


@query(f"WITH {_R} SELECT session_id, group_id, max(rank) AS rank, max(clicked) AS clicked FROM r GROUP BY ALL")
def group_rank_max(spark, sf_dir):
    return features.group_ranks(_results(spark, sf_dir), "max")


@query(f"WITH {_R}, m AS (SELECT session_id, max(rank) AS t FROM r GROUP BY 1) SELECT session_id, round(sum(rank * exp(100 * (rank - t))) / sum(exp(100 * (rank - t))), 6) AS soft FROM r JOIN m USING (session_id) GROUP BY session_id")
def soft_extreme(spark, sf_dir):
    return features.soft_extreme_over("rank", ["session_id"], _results(spark, sf_dir), 100.0).select("session_id", r6("soft").alias("soft"))


@query(f"""WITH {_R}, g AS (SELECT session_id, group_id, max(clicked) = 0 AS neg FROM r GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, neg ORDER BY md5('s' || group_id), group_id) AS i, count(*) OVER (PARTITION BY session_id, neg) AS n FROM g)
SELECT session_id, group_id FROM n WHERE NOT neg OR i <= floor(0.5 * n)""")
def negative_downsample(spark, sf_dir):
    return features.downsample_negatives(_results(spark, sf_dir), 0.5).select("session_id", "group_id").distinct()


@query("""WITH h AS (SELECT l_orderkey AS session_id, (('0x' || substr(md5('t' || l_partkey), 1, 8))::BIGINT / 4294967296.0) < 0.4 AS test FROM lineitem)
SELECT session_id, CASE WHEN avg(test::INT) > 0.5 THEN 'test' ELSE 'train' END AS split FROM h GROUP BY 1""")
def split_train_test(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("id"))
    return features.train_test_split(rows, 0.4, top_up=False).select("session_id", "split")


@query("""WITH h AS (SELECT l_orderkey AS session_id, (('0x' || substr(md5('t' || l_partkey), 1, 8))::BIGINT / 4294967296.0) < 0.2 AS test FROM lineitem),
s AS (SELECT session_id, avg(test::INT) > 0.5 AS test FROM h GROUP BY 1),
r AS (SELECT session_id, test, row_number() OVER (PARTITION BY test ORDER BY md5('t:top-up:' || session_id), session_id) AS place FROM s)
SELECT session_id, CASE WHEN test OR place <= (SELECT floor(0.2 * count(*)) - count(*) FILTER (test) FROM s) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_train_test_topped_up(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("id"))
    return features.train_test_split(rows).select("session_id", "split")


@query(f"""WITH {_R}, n AS (SELECT session_id, position AS id, clicked, row_number() OVER (PARTITION BY session_id, clicked ORDER BY position) - 1 AS i, count(*) OVER (PARTITION BY session_id, clicked) AS n FROM r),
z AS (SELECT session_id, max(n) FILTER (clicked = 1) AS pn, max(n) FILTER (clicked = 0) AS nn FROM n GROUP BY 1), k AS (SELECT session_id, pn, nn, unnest(range(greatest(pn, nn))) AS k FROM z WHERE pn > 0 AND nn > 0)
SELECT k.session_id, k, p.id AS positive, x.id AS negative, 1 AS target FROM k JOIN n p ON p.session_id = k.session_id AND p.clicked = 1 AND p.i = k % pn JOIN n x ON x.session_id = k.session_id AND x.clicked = 0 AND x.i = k % nn""")
def positives_and_negatives(spark, sf_dir):
    return features.positives_and_negatives(_results(spark, sf_dir))


def _paired(limit: int) -> str:
    return f"""WITH s AS (SELECT l_orderkey AS session_id, sum((l_returnflag = 'R')::INT) = 0 AS bad FROM lineitem GROUP BY 1),
n AS (SELECT session_id, bad, row_number() OVER (PARTITION BY bad ORDER BY md5(CASE WHEN bad THEN 'p:irrelevant:' ELSE 'p:relevant:' END || session_id), session_id) - 1 AS r FROM s),
z AS (SELECT count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS bad FROM s), k AS (SELECT unnest(range(least(greatest(good, bad), {limit}))) AS k, good, bad FROM z)
SELECT k, a.session_id AS relevant, b.session_id AS irrelevant FROM k JOIN n a ON NOT a.bad AND a.r = k % good JOIN n b ON b.bad AND b.r = k % k.bad"""


@query(_paired(1 << 60))
def paired_inputs(spark, sf_dir):
    return features.paired_inputs(_results(spark, sf_dir))


@query(_paired(500))
def paired_inputs_capped(spark, sf_dir):
    return features.paired_inputs(_results(spark, sf_dir), 500)


def _pairs(spark, sf_dir) -> DataFrame:
    li = t(spark, sf_dir, "lineitem")
    return li.select(F.col("l_discount").alias("positive_rank"), F.col("l_tax").alias("negative_rank"), F.lit(1.0).alias("target"), (1 - F.col("l_discount")).alias("positive_confidence"), (1 - F.col("l_tax")).alias("negative_confidence"))


_LOSS = "avg(least(1 - l_discount, 1 - l_tax) / (1 + exp({x})))"
_SMALL = "sum(abs(l_discount - l_tax) / (1 + exp(-2000 * (0.05 - abs(l_discount - l_tax))))) / (sum(1 / (1 + exp(-2000 * (0.05 - abs(l_discount - l_tax))))) + 1e-10)"


@query(f"SELECT round({_LOSS.format(x='-(1 - (l_discount - l_tax))')}, 6) AS loss FROM lineitem")
def margin_loss(spark, sf_dir):
    return features.margin_loss(_pairs(spark, sf_dir)).select(r6("loss").alias("loss"))


@query(f"SELECT round({_LOSS.format(x='-(0.05 - (l_discount - l_tax))')} + {_SMALL}, 6) AS loss FROM lineitem")
def margin_loss_small_difference(spark, sf_dir):
    return features.margin_loss(_pairs(spark, sf_dir), 0.05, True).select(r6("loss").alias("loss"))


@query(f"SELECT round({_LOSS.format(x='-400 * (0.01 - (l_discount - l_tax)) + 6')}, 6) AS loss FROM lineitem")
def cosine_margin_loss(spark, sf_dir):
    return features.cosine_margin_loss(_pairs(spark, sf_dir), 0.01).select(r6("loss").alias("loss"))


@query("SELECT round(sum(abs(l_discount) * w) / (sum(w) + 1e-10), 6) AS mean FROM (SELECT l_discount, 1 / (1 + exp(-100 * (0.05 - abs(l_discount)))) AS w FROM lineitem)")
def soft_small_mean(spark, sf_dir):
    return features.soft_small_mean(t(spark, sf_dir, "lineitem"), "l_discount", 0.05, 100).select(r6("mean").alias("mean"))


_SHIFT = f"""WITH {_R}, m AS (SELECT session_id, max(clicked) = 0 AS is_irrelevant, CASE WHEN max(clicked) = 0 THEN avg(rank - new_rank) ELSE avg(new_rank - rank) FILTER (clicked = 1) END AS shift FROM r GROUP BY 1)"""


def _old_and_new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _results(spark, sf_dir)
    return rows.drop("new_rank"), rows.select("session_id", "id", F.col("new_rank").alias("rank"))


@query(f"{_SHIFT} SELECT session_id, is_irrelevant, round(shift + 1e-9, 6) + 0.0 AS shift FROM m")
def distance_shifts(spark, sf_dir):
    got = features.distance_shifts(*_old_and_new(spark, sf_dir))
    return got.select("session_id", "is_irrelevant", (r6(F.col("shift") + 1e-9) + 0.0).alias("shift"))


@query(f"{_SHIFT} SELECT round(-avg(shift) FILTER (NOT is_irrelevant), 6) AS not_irrelevant_dist_shift, round(-avg(shift) FILTER (is_irrelevant), 6) AS irrelevant_dist_shift FROM m")
def distance_shift(spark, sf_dir):
    got = features.distance_shift(*_old_and_new(spark, sf_dir), is_similarity=False)
    return got.select(*[r6(c).alias(c) for c in got.columns])


@query("""SELECT user_id, event_id, round(value, 6) AS last, round(avg(value) OVER a + 1e-9, 6) AS mean, round(avg(value) OVER s + 1e-9, 6) AS sliding, min(value) OVER a AS min, max(value) OVER a AS max FROM events
WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def metric_running(spark, sf_dir):
    got = features.running_metrics(t(spark, sf_dir, "events"), "value", ["event_id"], ["user_id"])
    return got.select("user_id", "event_id", r6("last").alias("last"), r6(F.col("mean") + 1e-9).alias("mean"), r6(F.col("sliding") + 1e-9).alias("sliding"), "min", "max")


@query("SELECT o_orderkey AS params_id, o_totalprice AS loss FROM orders WHERE o_orderstatus = 'F' ORDER BY loss, params_id LIMIT 10")
def top_params(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("params_id"), F.col("o_totalprice").alias("loss"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("RUNNING").alias("status"))
    return features.top_parameters(runs, "loss", 10, True).select("params_id", "loss")


def phrases(spark, sf_dir) -> DataFrame:
    p = t(spark, sf_dir, "part")
    n = p.agg(F.count("*").alias("all"))
    got = p.groupBy(F.col("p_name").alias("phrase")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("p_brand")).alias("labels"), F.sort_array(F.collect_set("p_type")).alias("domains"))
    return suggest.phrase_documents(got.crossJoin(F.broadcast(n)).select("phrase", (F.col("n") / F.col("all")).alias("prob"), "labels", "domains"))


_PH = "ph AS (SELECT p_name AS phrase, count(*) / (SELECT count(*) FROM part) AS prob, list_sort(list(DISTINCT p_brand)) AS labels, list_sort(list(DISTINCT p_type)) AS domains FROM part GROUP BY p_name)"


def _suggest(name: str, req: suggest.Request, where: str, domain: str | None = None) -> None:
    def run(spark, sf_dir):
        return phrases(spark, sf_dir).where(suggest.match(req, False, domain)).orderBy(F.desc("prob"), "phrase").limit(10).select("phrase", r6("prob").alias("prob"))

    QUERIES[f"suggest_{name}"] = run
    SQL[f"suggest_{name}"] = f"WITH {_PH} SELECT phrase, round(prob, 6) AS prob FROM ph WHERE {where} ORDER BY ph.prob DESC, phrase LIMIT 10"


_suggest("simple", suggest.request("s"), "starts_with(lower(phrase), 's')")
_suggest("prefix", suggest.request("red "), "string_split(lower(phrase), ' ')[1] = 'red'")
_suggest("combined", suggest.request("red s"), "starts_with(lower(phrase), 'red s') OR starts_with(lower(phrase), 's')")


@query(f"WITH {_PH} SELECT phrase, round(prob, 6) AS prob FROM ph WHERE list_contains(domains, 'STANDARD') ORDER BY ph.prob DESC, phrase LIMIT 10")
def suggest_domain(spark, sf_dir):
    return phrases(spark, sf_dir).where(suggest.match(suggest.Request((), None), False, "STANDARD")).orderBy(F.desc("prob"), "phrase").limit(10).select("phrase", r6("prob").alias("prob"))


@query(f"""WITH {_PH}, w AS (SELECT phrase, prob, labels, row_number() OVER (ORDER BY prob DESC, phrase) AS pos FROM ph), l AS (SELECT unnest(labels) AS label, pos FROM w), f AS (SELECT DISTINCT first_pos FROM (SELECT label, min(pos) AS first_pos FROM l GROUP BY label))
SELECT phrase, round(prob, 6) AS prob FROM w JOIN f ON pos = first_pos""")
def suggest_diverse(spark, sf_dir):
    return suggest.diverse(phrases(spark, sf_dir), F.struct(-F.col("prob"), F.col("phrase"))).select("phrase", r6("prob").alias("prob"))


@query("""SELECT doc_id, unnest(range(len(p))) AS part_index, unnest(p) AS part FROM (SELECT doc_id, list_filter(string_split_regex(text, '\n| \\| '), lambda x: length(trim(x, ' ')) > 0) AS p FROM documents)""")
def split_separator(spark, sf_dir):
    got = splitters.split_items(t(spark, sf_dir, "documents"), splitters.by_separators(F.col("text"), ["\n", " | "]), "doc_id")
    return got.select(F.col("item_id").cast("long").alias("doc_id"), F.col("part_index").cast("long").alias("part_index"), "part")


@query("SELECT doc_id, unnest(range(len(p))) AS part_index, unnest(p) AS part FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS p FROM documents)")
def split_pattern(spark, sf_dir):
    got = splitters.split_items(t(spark, sf_dir, "documents"), splitters.by_pattern(F.col("text"), "[0-9]+"), "doc_id")
    return got.select(F.col("item_id").cast("long").alias("doc_id"), F.col("part_index").cast("long").alias("part_index"), "part")


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS p FROM documents),
l AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS piece FROM s), c AS (SELECT doc_id, i, piece, regexp_extract_all(piece, '\S+') AS w FROM l),
x AS (SELECT doc_id, i, CASE WHEN len(w) <= 40 THEN [piece] ELSE w END AS us, CASE WHEN len(w) <= 40 THEN len(w) ELSE 1 END AS n FROM c),
u AS (SELECT doc_id, i, unnest(range(len(us))) AS j, unnest(us) AS unit, n FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k FROM u),
g AS (SELECT doc_id, k, unit, n AS used, 0 AS part FROM o WHERE k = 1
      UNION ALL SELECT o.doc_id, o.k, o.unit, CASE WHEN g.used + o.n > 40 THEN o.n ELSE g.used + o.n END, CASE WHEN g.used + o.n > 40 THEN g.part + 1 ELSE g.part END FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1)
SELECT doc_id || ':' || part AS part_id, part::INT AS part_index, string_agg(unit, ' ' ORDER BY k) AS part FROM g GROUP BY doc_id, part""")
def split_token_budget(spark, sf_dir):
    pieces = splitters.group_tokens(splitters.by_separators(F.col("text"), ["\n"]), 40)
    return splitters.split_items(t(spark, sf_dir, "documents"), pieces, "doc_id").select("part_id", "part_index", "part")


@query()
def split_sentences(spark, sf_dir):
    got = splitters.split_items(t(spark, sf_dir, "documents"), splitters.split_sentences(F.col("text")), "doc_id")
    return got.select("part_id", "part_index", F.length("part").alias("n_chars"))


@query("""SELECT p_partkey, 'brand: "' || p_brand || '" name: "' || p_name || '" size: "' || p_size || '"' AS line FROM part""")
def dict_line(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", splitters.dict_line({"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("line"))


@query("""SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || '}' AS line FROM part""")
def json_line(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", splitters.json_line({"p_name": F.col("p_name"), "size": F.col("p_size")}, {"p_name": "name"}).alias("line"))


def _tags(spark, sf_dir, outer: bool) -> DataFrame:
    links = t(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("tag_id"))
    tags = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_type").alias("label"))
    return loaders.with_tags(t(spark, sf_dir, "orders").select("o_orderkey"), links, tags, "o_orderkey", outer)


_TAGS = "SELECT o_orderkey, string_agg(p_type, ', ' ORDER BY p_type) AS tags FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY 1"


@query(f"WITH g AS ({_TAGS}) SELECT o.o_orderkey, coalesce(tags, '') AS tags FROM orders o LEFT JOIN g ON o.o_orderkey = g.o_orderkey")
def tags_left(spark, sf_dir):
    return _tags(spark, sf_dir, True)


@query(_TAGS)
def tags_inner(spark, sf_dir):
    return _tags(spark, sf_dir, False)


@query("SELECT p_partkey, p_brand || '/' || p_type || '/' || 'size' || ':' || p_size AS category FROM part")
def category_text(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", loaders.category_text(F.col("p_brand"), F.col("p_type"), F.lit("size"), F.col("p_size")).alias("category"))


@query("SELECT p_partkey, 'same' AS augmentation, p_name AS text FROM part UNION ALL SELECT p_partkey, 'lower', lower(p_name) FROM part UNION ALL SELECT p_partkey, 'upper', upper(p_name) FROM part")
def augment_cases(spark, sf_dir):
    return augment.change_cases(t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))).select("p_partkey", "augmentation", "text")


@query()
def augment_misspell(spark, sf_dir):
    return augment.misspellings(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


@query("SELECT doc_id AS object_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE lang END AS payload FROM documents")
def upsert_objects(spark, sf_dir):
    old = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.col("lang").alias("payload"))
    new = old.where("object_id % 7 = 0").withColumn("payload", F.lit("new"))
    return collections.upsert(old, new, "object_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def promote_columns(spark, sf_dir):
    return collections.promote(t(spark, sf_dir, "events"), {"k": "double"}, "props").select("event_id", "k")


@query()
def improve_vectors(spark, sf_dir):
    from orrery.operators.improve import improve_vectors as run

    e = t(spark, sf_dir, "embeddings")
    q = V.literal(query_vector(spark, sf_dir))
    rows = e.select(F.expr("cast(vec_id div 20 as string)").alias("session_id"), F.lit("u1").alias("user_id"), q.alias("query"), F.col("vec_id").cast("string").alias("object_id"), F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("part_id"), V.as_vector("embedding").alias("vector"), (F.col("label") == 0).alias("is_clicked"))
    got = run(rows)
    return got.select("session_id", "object_id", "part_id", "original_id", r6(V.norm(F.col("vector"))).alias("length"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from orrery.plans import more, records  # noqa: E402, F401  they register their queries here
