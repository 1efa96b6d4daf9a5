"""Sessions, events and batches of a clickstream, as batch DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the largest order (null smallest); rows that tie are told apart by their hash."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(order), F.xxhash64(*rest))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def register_sessions(sessions: DataFrame) -> DataFrame:
    """The first registration of each session_id counts."""
    rest = [c for c in sessions.columns if c != "session_id"]
    return sessions.groupBy("session_id").agg(F.min_by(F.struct(*rest), F.struct("created_at", F.xxhash64(*rest))).alias("r")).select("session_id", "r.*")


def number_sessions(sessions: DataFrame) -> DataFrame:
    """session_number from 1 without gaps within a batch, by created_at, then session_id."""
    w = Window.partitionBy("batch_id").orderBy("created_at", "session_id")
    return sessions.withColumn("session_number", F.row_number().over(w))


def sessionize(events: DataFrame, gap_seconds: int = 1800, user: str = "user_id", time: str = "ts", key: str = "event_id") -> DataFrame:
    """session_number per user from 1: a pause of more than gap_seconds begins a session."""
    w = Window.partitionBy(user).orderBy(time, key)
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)
    begins = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("_begins", begins).withColumn("session_number", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_begins")


def push_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """log with the new events whose (session_id, event_id) it lacks."""
    new = new.dropDuplicates(["session_id", "event_id"])
    return log.unionByName(new.join(log.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti"))


def timestamp_guard(events: DataFrame, now, time: str = "created_at", past_seconds: int = 12 * 3600, future_seconds: int = 300) -> DataFrame:
    """Rows from 12 hours back to 5 minutes ahead; a missing time is filled with now. now: epoch seconds or a Column."""
    now = F.lit(now) if not hasattr(now, "alias") else now
    filled = events.withColumn(time, F.coalesce(F.col(time), now))
    return filled.where((F.col(time) >= now - past_seconds) & (F.col(time) <= now + future_seconds))


def mark_irrelevant(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    marked = ids.select("session_id").distinct().withColumn("_m", F.lit(True))
    return sessions.join(marked, "session_id", "left").withColumn("is_irrelevant", F.coalesce("_m", "is_irrelevant", F.lit(False))).drop("_m")


def with_events(sessions: DataFrame, events: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with their events in order of time, the first limit of each."""
    rest = [c for c in events.columns if c not in ("session_id", "created_at")]
    got = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("created_at", *rest))).alias("events"))
    if limit:
        got = got.withColumn("events", F.slice("events", 1, limit))
    return sessions.join(got, "session_id", "left")


def batch_page(sessions: DataFrame, batch_id: str, after: int = 0, limit: int = 0) -> DataFrame:
    """Sessions of a batch numbered above after, in order; a limit of 0 is none."""
    page = sessions.where((F.col("batch_id") == batch_id) & (F.col("session_number") > after)).orderBy("session_number")
    return page.limit(limit) if limit else page


BATCH_STATUSES = ("collecting", "released", "fine_tuning", "archiving", "archived")


def release_batch(batches: DataFrame, release_id: str, new_batch_id: str, now: int) -> DataFrame:
    """Releases the collecting batch and opens a new one; nothing changes if the release is already there."""
    done = batches.where(F.col("release_id") == release_id).limit(1).withColumn("_d", F.lit(True)).select("_d")
    state = batches.join(F.broadcast(done), F.lit(True), "left")
    fresh = F.col("_d").isNull() & (F.col("status") == "collecting")
    opened = state.where(fresh).limit(1).select(F.lit(new_batch_id).alias("batch_id"), F.lit(0).alias("session_counter"), F.lit(now).alias("created_at"), F.lit("collecting").alias("status"), F.lit(None).cast("string").alias("release_id"), F.lit(None).cast("long").alias("released_at"))
    kept = state.select("batch_id", "session_counter", "created_at", F.when(fresh, "released").otherwise(F.col("status")).alias("status"), F.when(fresh, F.lit(release_id)).otherwise(F.col("release_id")).alias("release_id"), F.when(fresh, F.lit(now)).otherwise(F.col("released_at")).alias("released_at"))
    return kept.unionByName(opened)


def set_batch_status(batches: DataFrame, batch_id: str, status: str) -> DataFrame:
    if status not in BATCH_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return batches.withColumn("status", F.when(F.col("batch_id") == batch_id, status).otherwise(F.col("status")))


def improvement_queue(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions that are irrelevant or have events; payload searches have no vector and stay out."""
    have = events.select("session_id").distinct().withColumn("_e", F.lit(True))
    joined = sessions.join(have, "session_id", "left").where(~F.coalesce("is_payload_search", F.lit(False)))
    return joined.where(F.coalesce("is_irrelevant", F.lit(False)) | F.col("_e").isNotNull()).drop("_e")


def session_from_results(results: DataFrame, default_rank: float = 1.0) -> DataFrame:
    """(session_id, search_results) from rows (session_id, object_id, distance, position)."""
    item = F.struct("position", "object_id", F.coalesce("distance", F.lit(default_rank)).alias("rank"))
    return results.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("search_results"))


def clicked_split(results: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (session_id, object_id, ...) of results with is_clicked."""
    clicks = events.select("session_id", "object_id").distinct().withColumn("_c", F.lit(True))
    return results.join(clicks, ["session_id", "object_id"], "left").withColumn("is_clicked", F.col("_c").isNotNull()).drop("_c")
