"""Ranking features, losses and metrics from user feedback, in long form: session_id, position, id, group_id, rank, clicked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.vectors import as_vector, cosine_distance


def training_input(results: DataFrame, events: DataFrame) -> DataFrame:
    """Exploded results (session_id, position, id, rank) with clicked (0/1) and importance (1.0 unless an event says otherwise)."""
    clicks = events.groupBy("session_id", F.col("object_id").alias("id")).agg(F.max(F.coalesce("importance", F.lit(1.0))).alias("importance")) if "importance" in events.columns else events.select("session_id", F.col("object_id").alias("id")).distinct().withColumn("importance", F.lit(1.0))
    return results.join(clicks, ["session_id", "id"], "left").withColumn("clicked", F.col("importance").isNotNull().cast("int")).withColumn("importance", F.coalesce("importance", F.lit(1.0)))


def not_clicked(rows: DataFrame) -> DataFrame:
    return rows.where("clicked = 0")


def irrelevant_sessions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg((F.sum("clicked") == 0).alias("is_irrelevant"))


def remove_results(rows: DataFrame, failed: DataFrame, least: int = 2) -> DataFrame:
    """Without the failed ids, and without sessions of which fewer than least results are left."""
    left = rows.join(failed.select("id").distinct(), "id", "left_anti")
    enough = left.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return left.join(enough.select("session_id"), "session_id", "left_semi")


def unit_confidences(rows: DataFrame) -> DataFrame:
    """Confidence 1 for every result, for clicks that are all trusted."""
    return rows.withColumn("confidence", F.lit(1.0))


def confidences(rows: DataFrame, window: int = 3) -> DataFrame:
    """Windowed click confidence, scaled to 0..1 within the session.

    Within the frame of window results around one, share is that of the clicked, and s the distance of its rank to the
    frame's mean over that mean. A clicked result has (1 - s) * share + (1 - share) * s, another (1 - share) * (1 - s)
    + share * s; both fade with the position."""
    half = window // 2
    by = Window.partitionBy("session_id")
    frame = by.orderBy("position").rowsBetween(-half, half)
    i = F.row_number().over(by.orderBy("position")) - 1
    n = F.count("*").over(by)
    mean = F.avg("rank").over(frame) + 1e-9
    share = F.avg(F.col("clicked").cast("double")).over(frame)
    s = F.abs(F.col("rank") - mean) / mean
    fit = F.when(F.col("clicked") == 1, (1 - s) * share + (1 - share) * s).otherwise((1 - share) * (1 - s) + share * s)
    out = rows.withColumn("_raw", fit * (F.exp(-3 * (i + 1) / n - 0.3) + 0.25))
    low, high = F.min("_raw").over(by), F.max("_raw").over(by)
    return out.withColumn("confidence", (F.col("_raw") - low) / (high - low + 1e-9)).drop("_raw")


def group_ranks(rows: DataFrame, how: str = "max", empty: float = 0.0) -> DataFrame:
    """One row per session and group: rank over its parts and whether any was clicked."""
    agg = {"max": F.max, "mean": F.avg, "min": F.min}[how]("rank")
    return rows.groupBy("session_id", "group_id").agg(F.coalesce(agg, F.lit(empty)).alias("rank"), F.max("clicked").alias("clicked"))


def group_confidences(rows: DataFrame) -> DataFrame:
    """The largest confidence of a group, given back to each of its parts."""
    return rows.withColumn("confidence", F.max("confidence").over(Window.partitionBy("session_id", "group_id")))


def soft_extreme_over(values: str, group: list[str], df: DataFrame, beta: float) -> DataFrame:
    """Softmax-weighted value per group: beta > 0 near the maximum, beta < 0 near the minimum."""
    top = df.groupBy(*group).agg((F.max if beta > 0 else F.min)(values).alias("_t"))
    w = F.exp(beta * (F.col(values) - F.col("_t")))
    return df.join(top, group).groupBy(*group).agg((F.sum(F.col(values) * w) / F.sum(w)).alias("soft"))


def downsample_negatives(rows: DataFrame, fraction: float, seed: str = "s") -> DataFrame:
    """All clicked groups and int(fraction * n) of a session's n others, by the md5 of seed and id."""
    by = Window.partitionBy("session_id", "_neg").orderBy(F.md5(F.concat(F.lit(seed), F.col("group_id").cast("string"))), "group_id")
    groups = rows.groupBy("session_id", "group_id").agg((F.max("clicked") == 0).alias("_neg"))
    size = F.count("*").over(Window.partitionBy("session_id", "_neg"))
    kept = groups.withColumn("_r", F.row_number().over(by)).withColumn("_n", size).where(~F.col("_neg") | (F.col("_r") <= F.floor(F.lit(fraction) * F.col("_n"))))
    return rows.join(kept.select("session_id", "group_id"), ["session_id", "group_id"], "left_semi")


def pair_filter(pairs: DataFrame, low: float, high: float) -> DataFrame:
    d = F.abs(F.col("positive") - F.col("negative"))
    return pairs.where((d > low) & (d < high))


def positives_and_negatives(rows: DataFrame, is_similarity: bool = True) -> DataFrame:
    """Clicked and other results of a session in pairs, the shorter list repeated: session_id, k, positive, negative (ids),
    target: 1 where a larger rank is better, -1 for distances."""
    order = Window.partitionBy("session_id", "clicked").orderBy("position", "id")
    numbered = rows.select("session_id", "id", "clicked", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("session_id", "clicked")).alias("n"))
    pos = numbered.where("clicked = 1").select("session_id", F.col("id").alias("positive"), F.col("r").alias("pr"), F.col("n").alias("pn"))
    neg = numbered.where("clicked = 0").select("session_id", F.col("id").alias("negative"), F.col("r").alias("nr"), F.col("n").alias("nn"))
    sizes = pos.groupBy("session_id").agg(F.first("pn").alias("pn")).join(neg.groupBy("session_id").agg(F.first("nn").alias("nn")), "session_id")
    slots = sizes.select("session_id", "pn", "nn", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("pn", "nn") - 1)).alias("k"))
    slots = slots.withColumn("pr", F.col("k") % F.col("pn")).withColumn("nr", F.col("k") % F.col("nn"))
    both = slots.join(pos.select("session_id", "pr", "positive"), ["session_id", "pr"]).join(neg.select("session_id", "nr", "negative"), ["session_id", "nr"])
    return both.select("session_id", "k", "positive", "negative", F.lit(1 if is_similarity else -1).alias("target"))


def _shuffled(sessions: DataFrame, key: str) -> DataFrame:
    """(session_id, r): numbers from 0 in the order of an md5 of key and session; no task holds all sessions."""
    got = sessions.select("session_id", F.md5(F.concat(F.lit(key), F.col("session_id").cast("string"))).alias("_key")).withColumn("_range", F.substring("_key", 1, 3))
    ranges = got.groupBy("_range").agg(F.count("*").alias("n"))  # 4,096 rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", "session_id")) - 1
    return got.withColumn("_place", place).join(F.broadcast(ranges.select("_range", before.alias("_before"))), "_range").select("session_id", (F.col("_before") + F.col("_place")).alias("r"))


def paired_inputs(rows: DataFrame, limit: int = -1, seed: str = "p") -> DataFrame:
    """(k, relevant, irrelevant): whole sessions with and without a click in pairs, both shuffled by seed, the shorter list
    repeated, limit pairs at most (-1: all). Without irrelevant sessions that side is null; without relevant ones there is no pair."""
    kinds = irrelevant_sessions(rows)
    sides = [_shuffled(kinds.where(F.col("is_irrelevant") == bad), f"{seed}:{name}:") for bad, name in ((False, "relevant"), (True, "irrelevant"))]
    sizes = kinds.groupBy("is_irrelevant").agg(F.count("*").alias("n")).collect()
    n = {r.is_irrelevant: r.n for r in sizes}
    relevant, irrelevant = (s.select(F.col("r").alias(f"_{name}"), F.col("session_id").alias(name)) for s, name in zip(sides, ("relevant", "irrelevant"), strict=True))
    pairs = max(n.values(), default=0) if n.get(False) else 0
    if limit > 0:
        pairs = min(pairs, limit)
    slots = rows.sparkSession.range(pairs).select(F.col("id").alias("k"), (F.col("id") % n.get(False, 1)).alias("_relevant"), (F.col("id") % n.get(True, 1)).alias("_irrelevant"))
    return slots.join(relevant, "_relevant").join(irrelevant, "_irrelevant", "left").select("k", "relevant", "irrelevant")


def concat_features(*features: DataFrame) -> DataFrame:
    """All rows of all; a feature that one lacks is null there."""
    out = features[0]
    for more in features[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def train_test_split(rows: DataFrame, test_share: float = 0.2, seed: str = "t", overlap: float = 0.5, top_up: bool = True) -> DataFrame:
    """Ids go to test by the md5 of seed and id; a session is test when more than overlap of its results are.

    Where fewer than int(test_share * sessions) are, top_up adds the train sessions with the smallest md5 of seed and
    session. They are ranked by ranges of the md5, so no task holds all sessions."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    split = F.when(F.col("share") > overlap, "test").otherwise("train")
    got = rows.groupBy("session_id").agg(F.avg((h < test_share).cast("double")).alias("share")).select("session_id", "share", split.alias("split"))
    if not top_up:
        return got
    key = F.md5(F.concat(F.lit(f"{seed}:top-up:"), F.coalesce(F.col("session_id").cast("string"), F.lit(""))))
    got = got.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    ranges = got.groupBy("_range").agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("train"))
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("train").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.floor(F.lit(test_share) * F.sum("n").over(every)) - F.sum(F.col("n") - F.col("train")).over(every)
    ranges = ranges.select("_range", (wanted - before).alias("_wanted"))  # 4,096 rows at most
    place = F.row_number().over(Window.partitionBy("_range", "split").orderBy("_key", "session_id"))
    out = got.withColumn("_place", place).join(F.broadcast(ranges), "_range")
    return out.select("session_id", "share", F.when(F.col("_place") <= F.col("_wanted"), "test").otherwise(F.col("split")).alias("split"))


def _pair_loss(df: DataFrame, margin: float, adjust, small_difference: bool) -> DataFrame:
    if margin <= 0:
        raise ValueError("a margin is positive")
    d = F.col("positive_rank") - F.col("negative_rank")
    loss = F.avg(F.least("positive_confidence", "negative_confidence") / (1 + F.exp(adjust(-F.col("target") * d + margin))))
    if small_difference:
        w = soft_indicator(d, margin, int(1 / margin * 100))
        loss = loss + F.sum(F.abs(d) * w) / (F.sum(w) + 1e-10)
    return df.agg(loss.alias("loss"))


def margin_loss(df: DataFrame, margin: float = 1.0, small_difference: bool = False) -> DataFrame:
    """Mean of min(confidences) / (1 + exp(-x)) over pairs, x = margin - target * (positive rank - negative rank).

    small_difference adds the soft mean of the differences below the margin."""
    return _pair_loss(df, margin, lambda x: -x, small_difference)


def cosine_margin_loss(df: DataFrame, margin: float = 1.0, small_difference: bool = False) -> DataFrame:
    """As margin_loss with exp(-400 x + 6) in place of exp(-x)."""
    return _pair_loss(df, margin, lambda x: -400 * x + 6, small_difference)


def soft_indicator(x: Column, threshold: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-scale * (threshold - F.abs(x))))


def soft_small_mean(df: DataFrame, value: str, threshold: float, scale: float) -> DataFrame:
    w = soft_indicator(F.col(value), threshold, scale)
    return df.agg((F.sum(F.abs(value) * w) / (F.sum(w) + 1e-10)).alias("mean"))


def distance_shifts(old: DataFrame, new: DataFrame, is_similarity: bool = True) -> DataFrame:
    """(session_id, is_irrelevant, shift): of a session with clicks the mean over the clicked of new - old rank, of one
    without the mean over all of old - new; both turned for distances, so that a larger shift is better."""
    joined = old.join(new.select("session_id", "id", F.col("rank").alias("new_rank")), ["session_id", "id"])
    gain = (F.col("new_rank") - F.col("rank")) * (1.0 if is_similarity else -1.0)
    got = joined.groupBy("session_id").agg((F.max("clicked") == 0).alias("is_irrelevant"), F.avg(F.when(F.col("clicked") == 1, gain)).alias("c"), F.avg(gain).alias("a"))
    return got.select("session_id", "is_irrelevant", F.when(F.col("is_irrelevant"), -F.col("a")).otherwise(F.col("c")).alias("shift"))


def distance_shift(old: DataFrame, new: DataFrame, is_similarity: bool = True) -> DataFrame:
    """One row: not_irrelevant_dist_shift and irrelevant_dist_shift, the means over sessions of either kind, 0 without any."""
    mean = lambda bad: F.coalesce(F.avg(F.when(F.col("is_irrelevant") == bad, F.col("shift"))), F.lit(0.0))
    return distance_shifts(old, new, is_similarity).agg(mean(False).alias("not_irrelevant_dist_shift"), mean(True).alias("irrelevant_dist_shift"))


def running_metrics(df: DataFrame, value: str, order: list[str], by: list[str], window: int = 10) -> DataFrame:
    """last, mean, sliding mean, min and max of a metric so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    far = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*by, *order, F.col(value).alias("last"), F.avg(value).over(far).alias("mean"), F.avg(value).over(w.rowsBetween(1 - window, 0)).alias("sliding"), F.min(value).over(far).alias("min"), F.max(value).over(far).alias("max"))


def top_parameters(runs: DataFrame, metric: str, n: int, is_loss: bool) -> DataFrame:
    order = F.col(metric).asc_nulls_last() if is_loss else F.col(metric).desc_nulls_last()
    return runs.where("status = 'FINISHED'").orderBy(order, "params_id").limit(n)


def parameters_id(params: dict[str, Column]) -> Column:
    """sha256 of `name: value` pieces in order of names, joined by ` / `."""
    return F.sha2(F.concat_ws(" / ", *[F.concat_ws(": ", F.lit(k), params[k].cast("string")) for k in sorted(params)]), 256)


def item_ranks(queries: DataFrame, items: DataFrame, how: str = "max") -> DataFrame:
    """(session_id, group_id, rank): cosine similarity of each part (session_id, group_id, vector) to its session's query
    (session_id, vector, one row each), over the group by max, mean or min."""
    q = queries.select("session_id", as_vector("vector").alias("_q"))
    near = items.join(q, "session_id").select("session_id", "group_id", (1 - cosine_distance(as_vector("vector"), F.col("_q"))).alias("_s"))
    return near.groupBy("session_id", "group_id").agg({"max": F.max, "mean": F.avg, "min": F.min}[how]("_s").alias("rank"))


def files_to_load(*inputs: DataFrame) -> DataFrame:
    """The distinct ids that any of the inputs needs."""
    out = inputs[0].select("id")
    for more in inputs[1:]:
        out = out.union(more.select("id"))
    return out.distinct()


def validation_means(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("metric").agg(F.avg(value).alias("mean"))


def best_quality(runs: DataFrame, metric: str, is_loss: bool) -> DataFrame:
    """(experiment, params_id, quality) of each experiment's best finished run; ties fall to the smallest params_id."""
    best = F.struct((F.col(metric) if is_loss else -F.col(metric)).alias("v"), F.col("params_id").alias("k"), F.col(metric).alias("q"))
    got = runs.where(F.col("status") == "FINISHED").where(F.col(metric).isNotNull()).groupBy("experiment").agg(F.min(best).alias("b"))
    return got.select("experiment", F.col("b.k").alias("params_id"), F.col("b.q").alias("quality"))


def borrow_positives(rows: DataFrame, lenders: DataFrame) -> DataFrame:
    """Pairs (session_id, k, positive, negative) for sessions without a click: positives come from the session that
    lenders (session_id, lender_id) names, in order of position; the longer side is cut to the shorter."""
    order = Window.partitionBy("session_id").orderBy("position", "id")
    pos = rows.where("clicked = 1").select(F.col("session_id").alias("lender_id"), F.col("id").alias("positive"), (F.row_number().over(order) - 1).alias("k"))
    idle = irrelevant_sessions(rows).where("is_irrelevant").select("session_id").join(lenders, "session_id")
    neg = rows.where("clicked = 0").select("session_id", F.col("id").alias("negative"), (F.row_number().over(order) - 1).alias("k"))
    return idle.join(neg, "session_id").join(pos, ["lender_id", "k"]).select("session_id", "k", "positive", "negative")
