"""Registered queries over records: sessions and their events, training inputs, tasks, collections and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import clickstream, collections, features, suggest, tasks
from orrery.plans.registry import _PH, _R, _results, _sessions, objects, phrases, query, r6, t
from orrery.sources import loaders

# ------------------------------------------------------------------ clickstream


def _flagged(spark, sf_dir) -> DataFrame:
    user = F.split("session_id", "/")[0].cast("long")
    return _sessions(spark, sf_dir).withColumn("is_irrelevant", user % 5 == 0).withColumn("is_payload_search", user % 7 == 0)


def _events(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    session = F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return e.select(session.alias("session_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))


_S = "s AS (SELECT user_id || '/' || ts::DATE AS session_id, user_id, ts::DATE::VARCHAR AS batch_id, epoch_us(min(ts)) AS created_at, bool_or(event_type = 'click') AS clicked FROM events GROUP BY user_id, ts::DATE)"


@query("SELECT user_id || '/' || ts::DATE AS session_id, array_to_string(list_slice(list(event_id::VARCHAR ORDER BY ts, event_id), 1, 5), ',') AS event_ids FROM events GROUP BY user_id, ts::DATE")
def session_with_events(spark, sf_dir):
    got = clickstream.with_events(_sessions(spark, sf_dir), _events(spark, sf_dir).drop("event_type"), 5)
    return got.select("session_id", F.array_join(F.transform("events", lambda x: x["event_id"].cast("string")), ",").alias("event_ids"))


@query(f"WITH {_S} SELECT session_id FROM s WHERE user_id % 7 <> 0 AND (user_id % 5 = 0 OR clicked)")
def improvement_queue(spark, sf_dir):
    return clickstream.improvement_queue(_flagged(spark, sf_dir), _events(spark, sf_dir).where("event_type = 'click'")).select("session_id")


@query(f"WITH {_S} SELECT session_id, user_id % 5 = 0 AS is_irrelevant FROM s")
def mark_irrelevant(spark, sf_dir):
    flagged = _flagged(spark, sf_dir)
    plain = flagged.select("session_id", F.lit(None).cast("boolean").alias("is_irrelevant"))
    return clickstream.mark_irrelevant(plain, flagged.where("is_irrelevant"))


@query(f"""WITH {_S}, n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, session_id)::INT AS session_number FROM s)
SELECT session_id, session_number FROM n WHERE batch_id = (SELECT min(batch_id) FROM s) AND session_number > 2 ORDER BY session_number LIMIT 10""")
def session_batch_page(spark, sf_dir):
    numbered = clickstream.number_sessions(_sessions(spark, sf_dir))
    first = numbered.agg(F.min("batch_id")).first()[0]
    return clickstream.batch_page(numbered, first, 2, 10).select("session_id", "session_number")


@query(f"WITH {_R} SELECT session_id, string_agg(position || ':' || rank, ',' ORDER BY position) AS results FROM r GROUP BY session_id")
def session_from_results(spark, sf_dir):
    rows = _results(spark, sf_dir).select("session_id", "position", F.col("id").alias("object_id"), F.col("rank").alias("distance"))
    got = clickstream.session_from_results(rows)
    return got.select("session_id", F.array_join(F.transform("search_results", lambda x: F.concat_ws(":", x["object_id"].cast("string"), x["rank"].cast("string"))), ",").alias("results"))


# ------------------------------------------------------------------ training inputs


@query(f"WITH {_R} SELECT session_id, position AS id, clicked FROM r")
def training_input(spark, sf_dir):
    rows = _results(spark, sf_dir)
    clicks = rows.where("clicked = 1").select("session_id", F.col("id").alias("object_id"))
    return features.training_input(rows.select("session_id", "id", "rank"), clicks).select("session_id", "id", "clicked")


@query("""WITH l AS (SELECT l_orderkey AS session_id, l_partkey AS id FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT session_id, id FROM l WHERE session_id IN (SELECT session_id FROM l GROUP BY session_id HAVING count(*) >= 2)""")
def remove_failed_results(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("id"))
    failed = t(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    return features.remove_results(rows, failed).select("session_id", "id")


@query("SELECT l_discount AS positive, l_tax AS negative FROM lineitem WHERE abs(l_discount - l_tax) > 0.015 AND abs(l_discount - l_tax) < 0.045")
def pair_filter(spark, sf_dir):
    pairs = t(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("positive"), F.col("l_tax").alias("negative"))
    return features.pair_filter(pairs, 0.015, 0.045)


@query("""WITH q AS (SELECT label, embedding::DOUBLE[] AS q FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)
SELECT label AS session_id, vec_id // 4 AS group_id, round(max(1 - list_cosine_distance(embedding::DOUBLE[], q)), 6) AS rank FROM embeddings JOIN q USING (label) GROUP BY ALL""")
def item_ranking(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("label").alias("session_id"), "vec_id", F.expr("vec_id div 4").alias("group_id"), F.col("embedding").alias("vector"))
    first = e.groupBy("session_id").agg(F.min_by("vector", "vec_id").alias("vector"))
    return features.item_ranks(first, e).select("session_id", "group_id", r6("rank").alias("rank"))


@query("SELECT event_type AS metric, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def validation_mean(spark, sf_dir):
    got = features.validation_means(t(spark, sf_dir, "events").withColumnRenamed("event_type", "metric"), "value")
    return got.select("metric", r6("mean").alias("mean"))


@query("SELECT o_custkey AS experiment, min({'v': o_totalprice, 'k': o_orderkey}).k AS params_id, min(o_totalprice) AS quality FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def best_quality(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("experiment"), F.col("o_orderkey").alias("params_id"), F.col("o_totalprice").alias("loss"), F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("RUNNING").alias("status"))
    return features.best_quality(runs, "loss", True)


@query("SELECT p_partkey, sha256('brand: ' || p_brand || ' / size: ' || p_size) AS params_id FROM part")
def params_id(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", features.parameters_id({"size": F.col("p_size"), "brand": F.col("p_brand")}).alias("params_id"))


# ------------------------------------------------------------------ tasks


def _tasks(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("processing")
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("parent_id"))


_T = "t AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'processing' END AS status, o_orderdate AS created_at, o_custkey AS parent_id FROM orders)"


@query(f"WITH {_T} SELECT task_id FROM t WHERE status = 'pending' ORDER BY created_at, task_id LIMIT 20 OFFSET 10")
def tasks_by_status(spark, sf_dir):
    return tasks.by_status(_tasks(spark, sf_dir), "pending", 20, 10).select("task_id")


@query(f"""WITH {_T} SELECT parent_id, {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in tasks.STATUSES)} FROM t GROUP BY parent_id""")
def tasks_merged(spark, sf_dir):
    return tasks.merge_subtasks(_tasks(spark, sf_dir))


@query(f"WITH {_T} SELECT parent_id, sum((status <> 'pending')::INT) / count(*) AS progress, sum((status = 'processing')::INT) / count(*) > 0.1 AS failed FROM t GROUP BY parent_id")
def tasks_progress(spark, sf_dir):
    n = tasks.merge_subtasks(_tasks(spark, sf_dir)).withColumn("all", F.col("pending") + F.col("done") + F.col("processing"))
    return n.select("parent_id", tasks.progress(F.col("all") - F.col("pending"), F.col("all")).alias("progress"), tasks.over_budget(F.col("processing"), F.col("all"), 0.1).alias("failed"))


@query(f"WITH {_T} SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'canceled' ELSE status END AS status FROM t WHERE task_id % 4 <> 0")
def tasks_updated(spark, sf_dir):
    old = _tasks(spark, sf_dir).select("task_id", "status")
    left = tasks.remove_tasks(old, old.where("task_id % 4 = 0"))
    changes = old.where("task_id % 3 = 0").select("task_id", F.lit("canceled").alias("status"))
    return tasks.update_tasks(left, changes, F.lit(0))


@query("SELECT doc_id, right(text, 1500) AS detail FROM documents")
def error_detail(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tasks.error_detail(F.col("text")).alias("detail"))


# ------------------------------------------------------------------ collections and items


def _with_copies(spark, sf_dir) -> DataFrame:
    base = objects(spark, sf_dir).select("object_id", "original_id", "user_id")
    copies = base.where("object_id % 10 = 0").select((F.col("object_id") + 100_000_000).alias("object_id"), F.col("object_id").alias("original_id"), F.lit("u1").alias("user_id"))
    return base.unionByName(copies)


_C = "c AS (SELECT doc_id AS object_id, NULL AS original_id FROM documents UNION ALL SELECT doc_id + 100000000, doc_id FROM documents WHERE doc_id % 10 = 0)"


@query(f"WITH {_C} SELECT object_id FROM c WHERE coalesce(original_id, object_id) % 20 <> 0 AND coalesce(original_id, object_id) % 70 <> 0")
def cascade_delete(spark, sf_dir):
    all_ = _with_copies(spark, sf_dir)
    ids = all_.where("(original_id % 20 = 0) or (original_id is null and object_id % 70 = 0)").select("object_id")
    return collections.delete_ids(all_, collections.cascade_ids(all_, ids)).select("object_id")


@query(f"WITH {_C} SELECT object_id FROM c WHERE original_id IS NULL OR original_id % 20 <> 0")
def drop_improved_copies(spark, sf_dir):
    all_ = _with_copies(spark, sf_dir)
    return collections.drop_improved_copies(all_, all_.where("original_id is null and object_id % 20 = 0")).select("object_id")


@query("SELECT count(*) AS n FROM documents")
def collection_total(spark, sf_dir):
    return collections.total(_with_copies(spark, sf_dir))


@query("SELECT doc_id AS object_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def collection_page(spark, sf_dir):
    return collections.page(objects(spark, sf_dir), 25, 50).select("object_id")


@query("SELECT 'customer' AS source_name, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, NULL FROM supplier")
def union_sources(spark, sf_dir):
    customers = t(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return loaders.union_sources({"customer": customers, "supplier": t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))})


@query("SELECT event_id::VARCHAR AS item_id, json_extract_string(props, '$.k') AS k FROM events")
def json_columns(spark, sf_dir):
    return loaders.json_columns(t(spark, sf_dir, "events"), "event_id", "props", ["k"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size < 20 ORDER BY p_partkey LIMIT 30 OFFSET 15")
def items_page(spark, sf_dir):
    return loaders.page(t(spark, sf_dir, "part").where("p_size < 20").select("p_partkey", "p_name"), "p_partkey", 30, 15)


# ------------------------------------------------------------------ phrases


@query(f"WITH {_PH} SELECT phrase, array_to_string(list_sort(list_concat(list_filter(labels, lambda x: x <> 'Brand#11' AND x <> 'new'), ['new'])), ',') AS labels FROM ph WHERE phrase NOT IN (SELECT min(phrase) FROM ph)")
def phrase_edits(spark, sf_dir):
    docs = phrases(spark, sf_dir)
    docs = suggest.delete_phrases(docs, values=[docs.agg(F.min("phrase")).first()[0]])
    docs = suggest.edit_set(suggest.edit_set(docs, "labels", ["Brand#11"], remove=True), "labels", ["new"])
    return docs.select("phrase", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query(f"WITH {_PH} SELECT phrase, round(prob, 6) AS prob FROM ph ORDER BY phrase LIMIT 20 OFFSET 5")
def phrase_page(spark, sf_dir):
    return suggest.list_phrases(phrases(spark, sf_dir), 20, 5).select("phrase", r6("prob").alias("prob"))


@query(f"WITH {_PH}, c AS (SELECT phrase, string_split(lower(phrase), ' ') AS c FROM ph) SELECT phrase, CASE WHEN list_contains(c, 're') THEN list_position(c, 're') ELSE coalesce(list_position(list_transform(c, lambda x: starts_with(x, 're')), true), len(c)) END::INT - 1 AS position FROM c")
def suggest_match_position(spark, sf_dir):
    return phrases(spark, sf_dir).select("phrase", suggest.match_position(F.col("chunks"), "re").alias("position"))
