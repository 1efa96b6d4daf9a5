"""Registered queries over search pages, selectors, suggestions, loaders, splitters, augmentations, tasks and indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions import vectors as V
from orrery.operators import ann, augment, clickstream, collections, features, indexing, search, selectors, splitters, suggest, tasks
from orrery.plans.records import _S, _T, _events, _tasks
from orrery.plans.registry import _O, _P, _PH, _Q, _R, _results, _sessions, collection, objects, parts, phrases, query, query_vector, r6, t
from orrery.sources import loaders

# ------------------------------------------------------------------ search


def ids(col: str = "part_ids"):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",").alias(col)


_V = f"{_Q}, p AS (SELECT vec_id AS part_id, vec_id // 4 AS object_id, embedding::DOUBLE[] AS v, list_cosine_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q)"


@query(f"""WITH {_V}, {_O}, g AS (SELECT object_id, min(d) AS distance, string_agg(part_id::VARCHAR, ',' ORDER BY d, part_id) AS part_ids, string_agg(round(v[1], 4)::VARCHAR, ',' ORDER BY d, part_id) AS firsts
FROM p JOIN o USING (object_id) GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance, part_ids, len(string_split(firsts, ','))::INT AS n_vectors, count(*) OVER () AS subset_count FROM g ORDER BY g.distance, object_id LIMIT 10""")
def search_with_vectors(spark, sf_dir):
    got = search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, with_vectors=True)
    return got.select("object_id", r6("distance").alias("distance"), ids(), F.size("vectors").alias("n_vectors"), "subset_count")


@query(f"""WITH {_V}, {_O}, n AS (SELECT * FROM p ORDER BY d, part_id LIMIT 80), g AS (SELECT object_id, min(d) AS distance, round(sum(v[1]), 5) AS firsts FROM n JOIN o USING (object_id) WHERE lang IN ('en', 'de') GROUP BY object_id)
SELECT object_id, round(distance, 6) AS distance, firsts FROM g ORDER BY g.distance, object_id LIMIT 10""")
def search_postfilter_vectors(spark, sf_dir):
    got = search.similar(collection(spark, sf_dir), query_vector(spark, sf_dir), 10, filter={"terms": {"field": "lang", "values": ["en", "de"]}}, strategy="post_filter", enlarged_limit=80, with_vectors=True)
    return got.select("object_id", r6("distance").alias("distance"), F.round(F.aggregate("vectors", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0))), 5).alias("firsts"))


_USER = f"""{_Q}, p AS (SELECT vec_id AS part_id, vec_id // 4 AS object_id, list_cosine_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q),
o AS (SELECT doc_id AS object_id, lang, n_chars, doc_id % 10 = 0 AS own FROM documents)"""


@query(f"""WITH {_USER}, g AS (SELECT object_id, own, any_value(n_chars) AS n, min(d) AS distance FROM p JOIN o USING (object_id) WHERE lang IN ('en', 'fr') AND n_chars >= 50 GROUP BY ALL)
SELECT object_id, CASE WHEN own THEN object_id + 100000000 ELSE object_id END AS found_id, round(distance, 6) AS distance, count(*) OVER () AS subset_count FROM g ORDER BY n DESC, found_id LIMIT 15""")
def search_user_filter_sorted(spark, sf_dir):
    """A user's copies hide their originals; filtered, ordered by a field of the payload, with vectors."""
    base, own = objects(spark, sf_dir), parts(spark, sf_dir)
    tenth = F.col("object_id") % 10 == 0
    copies = base.where(tenth).withColumn("original_id", F.col("object_id")).withColumn("object_id", F.col("object_id") + 100_000_000).withColumn("user_id", F.lit("u1"))
    c = search.Collection(base.unionByName(copies), own.unionByName(own.where(tenth).withColumn("object_id", F.col("object_id") + 100_000_000)))
    spec = {"bool": {"must": [{"terms": {"field": "lang", "values": ["en", "fr"]}}, {"range": {"field": "n_chars", "gte": 50}}]}}
    got = search.similar(c, query_vector(spark, sf_dir), 15, filter=spec, user_id="u1", sort_by=("n_chars", False), with_vectors=True)
    return got.select("object_id", "found_id", r6("distance").alias("distance"), "subset_count")


@query(f"""WITH {_P}, {_O}, g AS (SELECT object_id, min(d) AS distance FROM p JOIN o USING (object_id) GROUP BY object_id ORDER BY distance, object_id LIMIT 12)
SELECT g.object_id, round(g.distance, 6) AS distance, lang, count(*)::INT AS n_parts, string_agg(part_id::VARCHAR, ',' ORDER BY part_id) AS part_ids FROM g JOIN p USING (object_id) JOIN o USING (object_id) GROUP BY ALL""")
def search_similar_objects(spark, sf_dir):
    got = search.similar_objects(collection(spark, sf_dir), query_vector(spark, sf_dir), 12)
    return got.select("object_id", r6("distance").alias("distance"), F.get_json_object("payload", "$.lang").alias("lang"), F.size("parts").alias("n_parts"), ids("parts.part_id").alias("part_ids"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark, sf_dir):
    """Approximate search with its defaults for each twentieth vector; whether recall@10 against brute force reaches 0.9 on average."""
    own = parts(spark, sf_dir)
    asked = own.where("part_id % 20 = 0").select(F.col("part_id").alias("query_id"), "vector")
    centres = ann.train_centroids(own)
    found = ann.batch_search(ann.assign(own, centres), centres, asked, 10).select("query_id", "part_id")
    exact = search.batch_similar(asked, own, 10).select("query_id", "part_id")
    hits = exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "part_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))
    return asked.select("query_id").join(hits, "query_id", "left").agg(F.count("*").alias("queries"), (F.avg("share") >= 0.9).alias("reached"))


# ------------------------------------------------------------------ selectors

_CAT = """e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
c AS (SELECT label::BIGINT AS object_id, list(x ORDER BY i) AS v FROM m GROUP BY label)"""


def _categories(spark, sf_dir) -> search.Collection:
    e = t(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("object_id"), F.col("embedding").alias("vector"))
    own = splitters.average_parts(e)
    base = own.select("object_id", F.lit("{}").alias("payload"), F.lit(None).cast("long").alias("original_id"), F.lit(None).cast("string").alias("user_id"))
    return search.Collection(base, own)


@query(f"""WITH {_Q}, {_CAT}, d AS (SELECT object_id, list_cosine_distance(c.v, q.v) AS d FROM c, q), k AS (SELECT * FROM d WHERE d <= 1.02 ORDER BY d, object_id LIMIT 6)
SELECT object_id, round(1 / (1 + exp(-(1 - d - 0.8) * 10)), 6) AS probability FROM k WHERE 1 / (1 + exp(-(1 - d - 0.8) * 10)) > 0.0004""")
def query_to_categories(spark, sf_dir):
    """Search over categories within a distance, then the probability selector."""
    got = selectors.parse_query(_categories(spark, sf_dir), query_vector(spark, sf_dir), 6, 1.02, 0.0004)
    return got.select("object_id", r6("probability").alias("probability"))


@query(f"WITH {_Q}, d AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q.v) AS d FROM embeddings, q) SELECT vec_id, 1 / greatest(d, 1e-8) - 0.8 > 0 AS selected, round(CASE WHEN d > 0 THEN d END, 6) AS distance FROM d")
def select_by_euclid(spark, sf_dir):
    d = t(spark, sf_dir, "embeddings").select("vec_id", V.l2_distance(V.as_vector("embedding"), V.literal(query_vector(spark, sf_dir))).alias("d"))
    return d.select("vec_id", selectors.binary_select("euclid", F.col("d"), 0.2).alias("selected"), r6(F.when(F.col("d") > 0, F.col("d"))).alias("distance"))


_OBJ = f"{_Q}, s AS (SELECT vec_id // 4 AS object_id, list_cosine_similarity(embedding::DOUBLE[], q.v) AS cos, list_dot_product(embedding::DOUBLE[], q.v) AS dot FROM embeddings, q)"


@query(f"""WITH {_OBJ}, w AS (SELECT object_id, 1 - (cos + 1) / 2 AS d, dot FROM s)
SELECT object_id, round(sum(d * exp(-d / 0.5)) / sum(exp(-d / 0.5)), 6) AS soft_min, round(avg(1 - (1 - d) * 2 + 1), 6) AS mean, round(avg(dot), 5) AS dot FROM w GROUP BY object_id""")
def select_by_vectors(spark, sf_dir):
    """Distances from vectors: the soft minimum on a scale of one, the mean of cosine distances, and the mean dot product."""
    q = V.literal(query_vector(spark, sf_dir))
    own = parts(spark, sf_dir).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("part_id", V.as_vector("vector").alias("v")))).alias("p")).select("object_id", F.transform("p", lambda x: x["v"]).alias("p"))
    soft = selectors.vector_distance(q, F.col("p"), temperature=0.5, scale_to_one=True)
    mean = selectors.vector_distance(q, F.col("p"), aggregate="avg")
    return own.select("object_id", r6(soft).alias("soft_min"), r6(mean).alias("mean"), F.round(selectors.vector_distance(q, F.col("p"), "dot", True, "avg"), 5).alias("dot"))


@query(f"WITH {_OBJ} SELECT object_id, round((dot - (SELECT avg(dot) FROM s)) / (SELECT stddev(dot) FROM s), 4) AS dot FROM s")
def scaled_dot(spark, sf_dir):
    d = parts(spark, sf_dir).select("object_id", V.dot(V.as_vector("vector"), V.literal(query_vector(spark, sf_dir))).alias("dot"))
    return selectors.scaled_dot(d, "dot").select("object_id", F.round("dot", 4).alias("dot"))


# ------------------------------------------------------------------ collections


@query("SELECT doc_id AS object_id, lang, (SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) FROM embeddings WHERE vec_id // 4 = doc_id) AS part_ids FROM documents WHERE doc_id % 25 = 3")
def find_by_ids(spark, sf_dir):
    base = objects(spark, sf_dir)
    got = collections.find_by_ids(base, parts(spark, sf_dir), base.where("object_id % 25 = 3").select("object_id"))
    return got.select("object_id", F.get_json_object("payload", "$.lang").alias("lang"), F.nullif(ids("parts.part_id"), F.lit("")).alias("part_ids"))


@query("SELECT doc_id + 100000000 AS object_id, doc_id AS original_id FROM documents WHERE doc_id % 50 = 0")
def find_by_original_ids(spark, sf_dir):
    base = objects(spark, sf_dir)
    copies = base.where("object_id % 10 = 0").withColumn("original_id", F.col("object_id")).withColumn("object_id", F.col("object_id") + 100_000_000)
    asked = base.where("object_id % 50 = 0").select(F.col("object_id").alias("original_id"))
    return collections.find_by_ids(base.unionByName(copies), parts(spark, sf_dir), asked, "original_id").select("object_id", "original_id")


@query("SELECT doc_id AS object_id FROM documents WHERE source = 'src1'")
def find_by_session(spark, sf_dir):
    base = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.col("source").alias("session_id"))
    return collections.find_by_session(base, parts(spark, sf_dir), "src1").select("object_id")


@query("SELECT vec_id AS part_id, vec_id // 4 AS object_id FROM embeddings WHERE vec_id // 4 % 3 <> 0 UNION ALL SELECT vec_id + 1000000, vec_id // 4 FROM embeddings WHERE vec_id // 4 % 3 = 0 AND vec_id % 4 < 2")
def upsert_parts(spark, sf_dir):
    """Each third object gets new parts, and fewer of them."""
    own = parts(spark, sf_dir).select("part_id", "object_id")
    new = own.where("object_id % 3 = 0 and part_id % 4 < 2").withColumn("part_id", F.col("part_id") + 1_000_000)
    return collections.upsert_parts(own, new)


@query("SELECT doc_id AS object_id, lang, NULL AS extra FROM documents UNION ALL SELECT doc_id + 1000, lang, 'x' FROM documents WHERE doc_id < 5")
def insert_objects(spark, sf_dir):
    old = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), "lang")
    return collections.insert(old, old.where("object_id < 5").select((F.col("object_id") + 1000).alias("object_id"), "lang", F.lit("x").alias("extra")))


@query(f"""WITH {_S} SELECT 'query:' || session_id AS object_id, session_id, CASE WHEN user_id % 3 = 0 THEN '{{}}' ELSE '{{"search_query":"' || user_id || '"}}' END AS payload FROM s WHERE user_id % 3 = 0 OR clicked""")
def capture_queries(spark, sf_dir):
    """Sessions whose query has a vector join the query collection, unless they are there."""
    s = _sessions(spark, sf_dir).select("session_id", F.split("session_id", "/")[0].alias("search_query"))
    old = s.where("cast(search_query as long) % 3 = 0").select(F.concat_ws(":", F.lit("query"), "session_id").alias("object_id"), F.lit("{}").alias("payload"), "session_id", F.lit(None).cast("string").alias("user_id"))
    clicked = _events(spark, sf_dir).where("event_type = 'click'").select("session_id").distinct()
    new = s.join(clicked, "session_id").withColumn("vector", F.array(F.lit(1.0))).withColumn("user_id", F.lit(None).cast("string"))
    none = s.join(clicked, "session_id", "left_anti").withColumn("vector", F.lit(None).cast("array<double>")).withColumn("user_id", F.lit(None).cast("string"))
    nothing = spark.createDataFrame([], "part_id string, object_id string, vector array<double>, is_average boolean, user_id string")
    got, _ = collections.capture_queries(old, nothing, new.unionByName(none))
    return got.select("object_id", "session_id", "payload")


# ------------------------------------------------------------------ clickstream and ranking features


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_update(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("order"))
    return clickstream.latest(e, ["user_id"], "order").select("user_id", "event_id")


_B = "b AS (SELECT c_custkey::VARCHAR AS batch_id, CASE WHEN c_custkey = 7 THEN 'collecting' ELSE 'archived' END AS status, CASE WHEN c_custkey <> 7 THEN 'r' || c_custkey END AS release_id FROM customer)"


def _batches(spark, sf_dir) -> DataFrame:
    c, open_ = t(spark, sf_dir, "customer"), F.col("c_custkey") == 7
    return c.select(F.col("c_custkey").cast("string").alias("batch_id"), F.lit(3).alias("session_counter"), F.lit(1).cast("long").alias("created_at"), F.when(open_, "collecting").otherwise("archived").alias("status"), F.when(~open_, F.concat(F.lit("r"), F.col("c_custkey"))).alias("release_id"), F.lit(None).cast("long").alias("released_at"))


@query(f"WITH {_B} SELECT batch_id, CASE WHEN batch_id = '7' THEN 'released' ELSE status END AS status, coalesce(release_id, 'new') AS release_id FROM b UNION ALL SELECT 'next', 'collecting', NULL")
def release_batch(spark, sf_dir):
    return clickstream.release_batch(_batches(spark, sf_dir), "new", "next", 99).select("batch_id", "status", "release_id")


@query(f"WITH {_B} SELECT batch_id, status, release_id FROM b")
def release_batch_twice(spark, sf_dir):
    """A release that is there already changes nothing."""
    return clickstream.release_batch(_batches(spark, sf_dir), "r9", "next", 99).select("batch_id", "status", "release_id")


@query(f"WITH {_B} SELECT batch_id, CASE WHEN batch_id = '9' THEN 'fine_tuning' ELSE status END AS status FROM b")
def batch_status_update(spark, sf_dir):
    return clickstream.set_batch_status(_batches(spark, sf_dir), "9", "fine_tuning").select("batch_id", "status")


@query(f"WITH {_R} SELECT session_id, position FROM r WHERE clicked = 0")
def not_clicked(spark, sf_dir):
    return features.not_clicked(_results(spark, sf_dir)).select("session_id", "position")


@query(f"WITH {_R} SELECT session_id, group_id, round(avg(rank) + 1e-9, 6) AS mean, min(rank) AS min FROM r GROUP BY ALL")
def group_rank_mean_min(spark, sf_dir):
    rows = _results(spark, sf_dir)
    mean = features.group_ranks(rows, "mean").select("session_id", "group_id", r6(F.col("rank") + 1e-9).alias("mean"))
    return mean.join(features.group_ranks(rows, "min").select("session_id", "group_id", F.col("rank").alias("min")), ["session_id", "group_id"])


@query(f"WITH {_R} SELECT session_id, position, rank, NULL AS confidence FROM r WHERE clicked = 0 UNION ALL SELECT session_id, position, rank, 1.0 FROM r WHERE clicked = 1")
def concat_features(spark, sf_dir):
    rows = _results(spark, sf_dir).select("session_id", "position", "rank", "clicked")
    return features.concat_features(rows.where("clicked = 0").drop("clicked"), features.unit_confidences(rows.where("clicked = 1")).drop("clicked"))


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size < 5")
def files_to_load(spark, sf_dir):
    return features.files_to_load(t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")), t(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("id")))


@query(f"""WITH {_R}, s AS (SELECT session_id, max(clicked) = 0 AS idle FROM r GROUP BY 1), n AS (SELECT session_id, position AS id, clicked, row_number() OVER (PARTITION BY session_id, clicked ORDER BY position) - 1 AS k FROM r)
SELECT x.session_id, x.k, p.id AS positive, x.id AS negative FROM n x JOIN s ON s.session_id = x.session_id AND idle JOIN n p ON p.session_id = x.session_id + 1 AND p.clicked = 1 AND p.k = x.k WHERE x.clicked = 0""")
def borrow_positives(spark, sf_dir):
    """Sessions without a click borrow from the one with the next number."""
    rows = _results(spark, sf_dir)
    lenders = rows.select("session_id").distinct().withColumn("lender_id", F.col("session_id") + 1)
    return features.borrow_positives(rows, lenders)


# ------------------------------------------------------------------ suggestions


@query(f"""WITH {_PH}, c AS (SELECT *, string_split(lower(phrase), ' ') AS c FROM ph),
m AS (SELECT *, CASE WHEN starts_with(c[1], 'smll') THEN 0 WHEN levenshtein(substr(c[1], 1, 4), 'smll') <= 1 THEN 1 END AS tier FROM c),
w AS (SELECT *, row_number() OVER (ORDER BY tier, prob DESC, phrase) AS pos FROM m WHERE tier IS NOT NULL), l AS (SELECT unnest(labels) AS label, pos FROM w), f AS (SELECT DISTINCT pos FROM (SELECT min(pos) AS pos FROM l GROUP BY label))
SELECT phrase, round(prob, 6) AS prob, tier::INT AS tier FROM w JOIN f USING (pos) ORDER BY pos LIMIT 10""")
def suggest_soft(spark, sf_dir):
    """A misspelt beginning: no strict match, so near ones fill the page."""
    return suggest.suggest(phrases(spark, sf_dir), "smll").select("phrase", r6("prob").alias("prob"), "tier")


@query(f"""WITH {_PH}, w AS (SELECT *, row_number() OVER (ORDER BY prob DESC, phrase) AS pos FROM ph WHERE starts_with(lower(phrase), 'red')), l AS (SELECT unnest(labels) AS label, pos FROM w), f AS (SELECT DISTINCT pos FROM (SELECT min(pos) AS pos FROM l GROUP BY label)),
n AS (SELECT phrase, prob, 0 AS tier FROM w JOIN f USING (pos) ORDER BY pos LIMIT 5)
SELECT phrase, round(prob, 6) AS prob, tier FROM n""")
def suggest_strict(spark, sf_dir):
    return suggest.suggest(phrases(spark, sf_dir), "red", 5, soft=False).select("phrase", r6("prob").alias("prob"), "tier")


def _fuzzy(word: str) -> str:
    if len(word) == 1:
        return f"(?i)^{word}"
    each = "|".join(word[:i] + "[a-zA-Z]{1,2}" + word[i + 1 :] for i in range(len(word)))
    return f"(?i)^({each})"


def _rank(chunk: str, word: str, whole: bool = False) -> str:
    prefix = "" if whole else f" WHEN starts_with({chunk}, '{word}') THEN 2"
    return f"coalesce(CASE WHEN {chunk} = '{word}' THEN 3{prefix} WHEN regexp_matches({chunk}, '{_fuzzy(word)}{'$' if whole else ''}') THEN 1 ELSE 0 END, 0)"


def _ranked(rank: str, key: str, name: str) -> str:
    return f"""WITH {_PH}, c AS (SELECT *, string_split(lower(phrase), ' ') AS c FROM ph), k AS (SELECT *, {rank} AS rank FROM c),
b AS (SELECT {key} AS {name}, max(rank) AS rank, max({{'p': prob, 'l': -length(phrase), 'n': phrase}}) AS b FROM k WHERE rank > 0 GROUP BY {key}, labels)
SELECT {name}, rank::INT AS rank, round(b.p, 6) AS prob, b.n AS phrase FROM b ORDER BY rank DESC, b.p DESC, length(b.n), b.n LIMIT 10"""


@query(_ranked(_rank("c[1]", "red"), "c[1]", "first"))
def suggest_ranked_simple(spark, sf_dir):
    return suggest.ranked_match(phrases(spark, sf_dir), "red").select("first", "rank", r6("prob").alias("prob"), "phrase")


@query(_ranked(f"least({_rank('c[1]', 'rad', True)})", "c[2]", "next"))
def suggest_ranked_prefix(spark, sf_dir):
    """After a misspelt chunk."""
    return suggest.ranked_prefix(phrases(spark, sf_dir), ("rad",)).select("next", "rank", r6("prob").alias("prob"), "phrase")


_S1, _S0 = f"least({_rank('c[1]', 'red', True)}, {_rank('c[2]', 's')})", _rank("c[1]", "s")


@query(_ranked(f"greatest(CASE WHEN {_S1} > 0 THEN {_S1} + 3 ELSE 0 END, CASE WHEN {_S0} > 0 THEN {_S0} ELSE 0 END)", "c[1]", "first"))
def suggest_ranked_full(spark, sf_dir):
    return suggest.ranked_full(phrases(spark, sf_dir), ("red",), "s").select("first", "rank", r6("prob").alias("prob"), "phrase")


@query(f"WITH {_PH} SELECT phrase FROM ph WHERE regexp_matches(phrase, '{_fuzzy('blze')}')")
def fuzzy_phrases(spark, sf_dir):
    return phrases(spark, sf_dir).where(F.col("phrase").rlike(suggest.fuzzy_pattern("blze"))).select("phrase")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate(left(text, 300), chr(10) || chr(9), '  '), '([.,])', ' \1 ', 'g'), ' +', ' ', 'g')), ' ([.,])', '\1', 'g'), '^ ', ''), ' $', '') AS line
FROM documents WHERE NOT regexp_matches(left(text, 300), '[!?:;)\]}/-]')""")
def glue_chunks(spark, sf_dir):
    """Marks cut off and joined again."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.translate(F.left("text", F.lit(300)), "\n\t", "  ").alias("x"))
    cut = F.filter(F.split(F.regexp_replace("x", "([.,])", " $1 "), " +"), lambda c: c != "")
    return d.where("not x rlike '[!?:;)\\\\]}/-]'").select("doc_id", T.glue(cut).alias("line"))


@query(f"WITH {_PH}, c AS (SELECT phrase, string_split(phrase, ' ') AS c FROM ph) SELECT phrase, array_to_string(c[:1], ' ') AS prefix, c[2] AS match, array_to_string(c[3:], ' ') AS postfix FROM c WHERE len(c) > 1")
def aligned_suggestion(spark, sf_dir):
    d = phrases(spark, sf_dir).withColumn("c", F.split("phrase", " ")).where("size(c) > 1")
    return d.select("phrase", *suggest.aligned(F.col("c"), F.lit(1)))


@query(f"WITH {_PH}, m AS (SELECT min(phrase) AS first FROM ph) SELECT phrase, CASE WHEN phrase = first THEN 0.25 ELSE round(prob, 6) END AS prob FROM ph, m")
def phrase_probability(spark, sf_dir):
    d = phrases(spark, sf_dir)
    first = d.orderBy("phrase").first().phrase_id
    return suggest.update_probability(d, first, 0.25).select("phrase", r6("prob").alias("prob"))


@query(f"WITH {_PH} SELECT phrase, array_to_string(list_sort(list_distinct(list_filter(domains, lambda x: x <> 'STANDARD') || ['shop'])), ',') AS domains FROM ph")
def phrase_domains(spark, sf_dir):
    d = suggest.edit_set(suggest.edit_set(phrases(spark, sf_dir), "domains", ["STANDARD"], remove=True), "domains", ["shop"])
    return d.select("phrase", F.array_join(F.array_sort("domains"), ",").alias("domains"))


# ------------------------------------------------------------------ loaders, splitters, augmentations


@query("SELECT doc_id::VARCHAR AS item_id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang END, '') AS lang, source FROM documents")
def text_columns(spark, sf_dir):
    d = t(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return loaders.text_columns(d, "doc_id", ["lang", "source"])


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN p_brand || ':' || p_size ELSE p_partkey::VARCHAR END AS id, p_partkey FROM part")
def derived_id(spark, sf_dir):
    known = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string"))
    return t(spark, sf_dir, "part").select(loaders.derived_id(known, F.col("p_brand"), F.col("p_size").cast("string")).alias("id"), "p_partkey")


@query("SELECT p_brand, p_size, sha256(p_brand || ':' || p_size) AS item_key FROM part GROUP BY ALL")
def distinct_items(spark, sf_dir):
    return loaders.distinct_items(t(spark, sf_dir, "part").select("p_brand", "p_size", "p_name"), "p_brand", "p_size").select("p_brand", "p_size", "item_key")


@query("SELECT doc_id::VARCHAR AS item_id, lang AS item FROM documents")
def normalise_fields(spark, sf_dir):
    return splitters.normalise_fields(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang").select("item_id", "item")


@query("SELECT doc_id || ':0' AS part_id, lang AS part FROM documents")
def split_whole(spark, sf_dir):
    return splitters.split_items(t(spark, sf_dir, "documents"), splitters.no_split(F.col("lang")), "doc_id").select("part_id", "part")


_PAY = "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS brand FROM part"


@query(f"WITH p AS ({_PAY}), l AS (SELECT p_partkey, list_filter([brand, name], lambda x: x IS NOT NULL) AS l FROM p) SELECT p_partkey, unnest(range(len(l)))::INT AS part_index, unnest(l) AS part FROM l")
def split_json_fields(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    payload = collections.payload_of(name=F.col("p_name"), brand=F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    got = splitters.split_items(p.select("p_partkey", payload.alias("payload")), splitters.by_fields(F.col("payload"), ["brand", "name"]), "p_partkey")
    return got.select(F.col("item_id").cast("long").alias("p_partkey"), "part_index", "part")


@query("""SELECT p_partkey, unnest(['brand: "' || p_brand || '"', 'size: "' || p_size || '"']) AS part FROM part""")
def split_combined_line(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    line = splitters.dict_line({"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")})
    got = splitters.split_items(p.select("p_partkey", line.alias("line")), splitters.combined_fields(F.col("line"), ["brand", "size"]), "p_partkey")
    return got.select(F.col("item_id").cast("long").alias("p_partkey"), "part")


@query("""WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS p FROM documents), x AS (SELECT doc_id, unnest(range(len(p))) AS i FROM d)
SELECT l_orderkey AS session_id, l_linenumber AS line, x.doc_id::VARCHAR AS group_id, x.doc_id || ':' || i AS id FROM lineitem JOIN x ON x.doc_id = l_partkey % 50""")
def remap_sessions(spark, sf_dir):
    """Results that are whole items become results that are their parts."""
    own = splitters.split_items(t(spark, sf_dir, "documents"), splitters.by_separators(F.col("text"), ["\n"]), "doc_id")
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 50).cast("string").alias("id"))
    return splitters.remap_sessions(rows, own)


_AUG = "a AS (SELECT p_partkey AS id, unnest(['same', 'lower', 'upper']) AS augmentation, unnest([p_name, lower(p_name), upper(p_name)]) AS text FROM part)"


@query(f"WITH {_AUG} SELECT id, augmentation, text FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('r:' || id || ':' || augmentation), augmentation) <= 2")
def augment_selection(spark, sf_dir):
    return augment.select_random(augment.change_cases(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))), 2).select("id", "augmentation", "text")


@query(f"WITH {_AUG} SELECT id, augmentation, text FROM a UNION ALL SELECT p_partkey, 'original', p_name FROM part")
def augment_composed(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return augment.compose(p, augment.change_cases).select("id", "augmentation", "text")


@query("SELECT vec_id // 4 AS object_id, count(*) FILTER (vec_id % 4 <> 1) AS kept, round(avg(embedding[1]::DOUBLE) FILTER (vec_id % 4 <> 1), 5) AS first, 6 AS padded FROM embeddings GROUP BY 1")
def pooled_parts(spark, sf_dir):
    """Parts padded to six, and the mean of those that a mask keeps."""
    own = parts(spark, sf_dir).groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("part_id", V.as_vector("vector").alias("v")))).alias("p"))
    rows, mask = F.transform("p", lambda x: x["v"]), F.transform("p", lambda x: x["part_id"] % 4 != 1)
    return own.select("object_id", F.size(F.filter(mask, lambda m: m)).cast("long").alias("kept"), F.round(F.get(V.masked_mean(rows, mask, 64), F.lit(0)), 5).alias("first"), F.size(V.padded(rows, 6, 64)).alias("padded"))


# ------------------------------------------------------------------ tasks


@query(f"WITH {_T}, a AS (SELECT c_custkey AS task_id FROM customer) SELECT a.task_id, t.task_id IS NOT NULL AS found FROM a LEFT JOIN t USING (task_id)")
def tasks_exist(spark, sf_dir):
    return tasks.exists(_tasks(spark, sf_dir), t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id")))


@query(f"WITH {_T} SELECT task_id, status FROM t WHERE task_id IN (1, 2, 3, 33)")
def tasks_get(spark, sf_dir):
    return tasks.get(_tasks(spark, sf_dir), [1, 2, 3, 33]).select("task_id", "status")


@query(f"WITH {_T} SELECT task_id FROM t WHERE parent_id = 3 ORDER BY created_at, task_id LIMIT 5 OFFSET 1")
def tasks_of_model(spark, sf_dir):
    return tasks.by_value(_tasks(spark, sf_dir), "parent_id", 3, 5, 1).select("task_id")


@query(f"WITH {_T} SELECT task_id, status FROM t WHERE task_id % 2 = 0 UNION ALL SELECT task_id, 'pending' FROM t WHERE task_id % 2 = 1 AND task_id % 3 = 0")
def tasks_created(spark, sf_dir):
    """Tasks that are there stay as they are; repeated new ones are made once."""
    old = _tasks(spark, sf_dir).select("task_id", "status")
    new = old.where("task_id % 3 = 0").select("task_id", F.lit("pending").alias("status"))
    return tasks.create_tasks(old.where("task_id % 2 = 0"), new.union(new))


@query(f"WITH {_T} SELECT task_id, CASE WHEN task_id = 1 AND status <> 'processing' THEN 'pending' WHEN task_id = 2 AND status IN ('pending', 'processing') THEN 'canceled' ELSE status END AS status FROM t")
def tasks_restart_cancel(spark, sf_dir):
    return tasks.cancel(tasks.restart(_tasks(spark, sf_dir), 1), 2).select("task_id", "status")


@query("""WITH o AS (SELECT o_orderkey AS task_id, o_custkey AS src, o_custkey + 1 AS dst, o_orderdate AS created_at FROM orders), h AS (SELECT c_custkey AS m FROM customer WHERE c_custkey % 9 IN (0, 1) OR c_custkey % 10 = 5)
SELECT task_id FROM o WHERE src NOT IN (SELECT m FROM h) AND dst NOT IN (SELECT m FROM h) ORDER BY created_at, task_id LIMIT greatest(40 - (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0 AND c_custkey <= 90), 0)""")
def tasks_admitted(spark, sf_dir):
    """Locks on both sides, models pending deletion, and room for what the locks leave of 40."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.col("o_orderdate").alias("created_at"))
    c = t(spark, sf_dir, "customer")
    locks = c.where("c_custkey % 9 = 0 and c_custkey <= 90").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    gone = c.where("c_custkey % 10 = 5 or (c_custkey % 9 in (0, 1))").select(F.col("c_custkey").alias("model"))
    return tasks.admissible(o, locks, 40, gone).select("task_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 9 = 0 THEN o_custkey + 1000 ELSE o_custkey END AS model FROM orders")
def tasks_redirected(spark, sf_dir):
    locks = t(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1000).alias("dst"))
    return tasks.redirect(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("model")), locks).select("id", "model")


@query("SELECT p_partkey, 'run / ' || p_brand || ' / ' || p_type AS name, p_brand AS brand FROM part")
def experiment_names(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", tasks.experiment_name("run", F.col("p_brand"), F.col("p_type")).alias("name"))
    return p.select("p_partkey", "name", tasks.parse_experiment(F.col("name"), ["kind", "brand", "type"])[1])


# ------------------------------------------------------------------ indexing


def _embed(df: DataFrame) -> DataFrame:
    """A stand-in for a model: length, words and a number of vowels; parts that name a digit get no vector, very short ones a shorter one."""
    words, vowels = F.size(F.split("part", " ")), F.length(F.regexp_replace("part", "[^aeiou]", ""))
    v = F.array(F.length("part").cast("double"), words.cast("double"), vowels.cast("double"))
    return df.withColumn("vector", F.when(F.col("part").rlike("[0-9]"), F.lit(None)).when(F.length("part") < 4, F.slice(v, 1, 2)).otherwise(v))


_IDX = """d AS (SELECT doc_id::VARCHAR AS object_id, CASE WHEN doc_id % 13 <> 0 THEN CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END END AS item FROM documents),
l AS (SELECT object_id, item, list_filter(string_split(coalesce(item, ''), chr(10)), lambda x: length(trim(x, ' ')) > 0) AS p FROM d),
x AS (SELECT object_id, unnest(range(len(p))) AS i, unnest(p) AS part FROM l),
y AS (SELECT *, NOT regexp_matches(part, '[0-9]') AND length(part) >= 4 AS good FROM x),
z AS (SELECT l.object_id, CASE WHEN item IS NULL THEN 'load' WHEN len(p) = 0 THEN 'split' WHEN NOT (SELECT bool_and(good) FROM y WHERE y.object_id = l.object_id) THEN 'embed' END AS stage FROM l)"""


def _items(spark, sf_dir) -> DataFrame:
    item = F.when(F.col("doc_id") % 13 != 0, F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.col("text")))
    return t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), item.alias("item"))


def _lines(col):
    return splitters.by_separators(col, ["\n"])


@query(f"WITH {_IDX} SELECT z.object_id, i::INT AS part_index, length(part) + 0.0::DOUBLE AS length, len(string_split(part, ' ')) + 0.0::DOUBLE AS words FROM z JOIN y ON y.object_id = z.object_id WHERE stage IS NULL")
def index_items(spark, sf_dir):
    """Documents cut into lines and embedded; a document with a part that fails is left out."""
    got = indexing.prepare(_items(spark, sf_dir), _lines, _embed, 3).parts
    return got.select("object_id", F.substring_index("part_id", ":", -1).cast("int").alias("part_index"), F.get("vector", F.lit(0)).alias("length"), F.get("vector", F.lit(1)).alias("words"))


@query(f"WITH {_IDX} SELECT object_id, stage FROM z WHERE stage IS NOT NULL")
def index_failures(spark, sf_dir):
    return indexing.prepare(_items(spark, sf_dir), _lines, _embed, 3).failed


@query(f"WITH {_IDX} SELECT object_id, CASE WHEN stage IS NULL THEN 'new' ELSE 'old' END AS state FROM z")
def index_upsert(spark, sf_dir):
    """Items that fail keep the objects that they had."""
    old = _items(spark, sf_dir).select(F.col("item_id").alias("object_id"), F.lit("old").alias("payload"))
    none = spark.createDataFrame([], "part_id string, object_id string, vector array<double>, is_average boolean")
    got = indexing.upsert_items(old, none, _items(spark, sf_dir), _lines, _embed, 3).objects
    return got.select("object_id", F.when(F.col("payload") == "old", "old").otherwise("new").alias("state"))


@query("""WITH s AS (SELECT doc_id, lang || CASE WHEN doc_id % 6 = 0 THEN '7' ELSE '-text' END AS item FROM documents)
SELECT count(*) AS total, count(*) FILTER (doc_id % 6 = 0) AS failed, count(*) FILTER (doc_id % 6 = 0) / count(*) > 0.1 AS over_budget FROM s""")
def reindex_budget(spark, sf_dir):
    item = F.concat("lang", F.when(F.col("doc_id") % 6 == 0, "7").otherwise("-text"))
    source = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("object_id"), F.to_json(F.struct(item.alias("item"))).alias("payload"))
    objects_ = spark.createDataFrame([], "object_id string, payload string")
    none = spark.createDataFrame([], "part_id string, object_id string, vector array<double>, is_average boolean")
    return indexing.reindex(source, objects_, none, _embed, 3, budget=0.1)[1]
