"""Task tables (task_id, status, ...): creation, guarded updates, locks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "done", "failed", "canceled", "refused")


def create_tasks(tasks: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """Adds those whose key isn't there yet."""
    return tasks.unionByName(new.dropDuplicates([key]).join(tasks.select(key), key, "left_anti"), allowMissingColumns=True)


def update_tasks(tasks: DataFrame, changes: DataFrame, now: Column, key: str = "task_id") -> DataFrame:
    """Non-null columns of changes replace those of the same key; updated_at is set."""
    names = [c for c in changes.columns if c != key and c in tasks.columns]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit"))
    out = tasks.join(new, key, "left")
    cols = [F.coalesce(f"_{c}", c).alias(c) if c in names else F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in tasks.columns]
    return out.select(*cols)


def remove_tasks(tasks: DataFrame, gone: DataFrame, key: str = "task_id") -> DataFrame:
    return tasks.join(gone.select(key), key, "left_anti")


def get(tasks: DataFrame, ids: list, key: str = "task_id") -> DataFrame:
    return tasks.where(F.col(key).isin(ids))


def exists(tasks: DataFrame, ids: DataFrame, key: str = "task_id") -> DataFrame:
    """The keys of ids, each with whether it is there."""
    here = tasks.select(key).distinct().withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(here, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def by_value(tasks: DataFrame, column: str, value, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the tasks of a model, a destination model or any other column's value."""
    return tasks.where(F.col(column) == value).orderBy("created_at", "task_id").offset(offset).limit(limit)


def by_status(tasks: DataFrame, status: str, limit: int = 100, offset: int = 0) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return tasks.where(F.col("status") == status).orderBy("created_at", "task_id").offset(offset).limit(limit)


def restart(tasks: DataFrame, task_id: str) -> DataFrame:
    hit = (F.col("task_id") == task_id) & (F.col("status") != "processing")
    return tasks.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def cancel(tasks: DataFrame, task_id: str) -> DataFrame:
    hit = (F.col("task_id") == task_id) & F.col("status").isin("pending", "processing")
    return tasks.withColumn("status", F.when(hit, "canceled").otherwise(F.col("status")))


def admissible(requests: DataFrame, locks: DataFrame, capacity: int, pending_deletion: DataFrame | None = None) -> DataFrame:
    """Requests (task_id, src, dst, created_at) that meet no lock (src, dst) and no pending deletion (model) on either
    side, while the capacity lasts. capacity bounds the rows that the last step orders."""
    held = locks.select(F.explode(F.array("src", "dst")).alias("m"))
    if pending_deletion is not None:
        held = held.union(pending_deletion.select("model"))
    held = held.distinct()
    free = requests.join(held, requests.src == held.m, "left_anti").join(held, requests.dst == held.m, "left_anti")
    room = locks.agg(F.greatest(F.lit(capacity) - F.count("*"), F.lit(0)).alias("room"))
    first = free.orderBy("created_at", "task_id").limit(capacity)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("created_at", "task_id"))
    return first.withColumn("_r", place).crossJoin(F.broadcast(room)).where("_r <= room").drop("_r", "room")


def redirect(writes: DataFrame, locks: DataFrame) -> DataFrame:
    """While a model is being reindexed its writes go to the destination too: model is the destination's."""
    return writes.join(locks.select(F.col("src").alias("model"), "dst"), "model", "left").withColumn("model", F.coalesce("dst", "model")).drop("dst")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(0.0)


def over_budget(failed: Column, total: Column, budget: int | float) -> Column:
    """-1 is no budget, an int a number of failures, a float a share of all."""
    if budget == -1:
        return F.lit(False)
    return failed > budget if isinstance(budget, int) else failed / total > budget


def merge_subtasks(subtasks: DataFrame) -> DataFrame:
    """One row per parent_id with a count of each status."""
    return subtasks.groupBy("parent_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def error_detail(col: Column) -> Column:
    return F.right(col, F.lit(1500))


def experiment_name(*parts: str | Column) -> Column:
    return F.concat_ws(" / ", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def parse_experiment(col: Column, names: list[str]) -> list[Column]:
    return [F.get(F.split(col, " / "), F.lit(i)).alias(n) for i, n in enumerate(names)]
