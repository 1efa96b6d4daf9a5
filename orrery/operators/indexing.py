"""Upserts and reindexing of items: load, split, embed, store, with the items that failed and the stage where they did.

An embedder is a function from a DataFrame with a column part to one with a column vector more; failing parts get a
null or a vector of another length. One lazy job takes the place of batches of items and subtasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import collections, splitters
from orrery.operators.tasks import over_budget

STAGES = ("load", "split", "embed")


@dataclass(frozen=True)
class Outcome:
    """What an upsert makes: objects (object_id, payload), parts (part_id, object_id, vector, is_average), failed (object_id, stage)."""

    objects: DataFrame
    parts: DataFrame
    failed: DataFrame


def prepare(items: DataFrame, split: Callable[[Column], Column], embed: Callable[[DataFrame], DataFrame], dimensions: int, average: bool = False) -> Outcome:
    """Items (item_id, item text) to an Outcome; average adds each object's mean part.

    An item fails at load if its text is null, at split if it has no part, at embed if a part has no vector of the
    dimensions. A failed item has neither object nor parts. Of items that share an id one is taken."""
    items = items.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.max("item").alias("item"))
    cut = items.withColumn("pieces", split(F.col("item")))
    loaded = cut.where("item is not null")
    parts = embed(splitters.split_items(loaded, F.col("pieces"))).withColumn("right", F.coalesce(F.size("vector") == dimensions, F.lit(False)))
    whole = parts.groupBy("item_id").agg(F.min("right").alias("right"))
    state = cut.join(whole, "item_id", "left")
    stage = F.when(F.col("item").isNull(), "load").when(F.col("right").isNull(), "split").when(~F.col("right"), "embed")
    state = state.select("item_id", "item", stage.alias("stage"))
    good = state.where("stage is null")
    objects = good.select(F.col("item_id").alias("object_id"), F.to_json(F.struct("item")).alias("payload"))
    kept = parts.join(good.select("item_id"), "item_id", "left_semi").select("part_id", F.col("item_id").alias("object_id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(False).alias("is_average"))
    if average:
        kept = kept.unionByName(splitters.average_parts(kept).select(kept.columns))
    return Outcome(objects, kept, state.where("stage is not null").select(F.col("item_id").alias("object_id"), "stage"))


def upsert_items(objects: DataFrame, parts: DataFrame, items: DataFrame, split, embed, dimensions: int, average: bool = False) -> Outcome:
    """objects and parts with those of the items in place of older ones; items that failed leave theirs as they were."""
    new = prepare(items, split, embed, dimensions, average)
    return Outcome(collections.upsert(objects, new.objects, "object_id"), collections.upsert_parts(parts, new.parts), new.failed)


def reindex(source: DataFrame, objects: DataFrame, parts: DataFrame, embed, dimensions: int, split=splitters.no_split, budget: int | float = -1) -> tuple[Outcome, DataFrame]:
    """All objects of source (object_id, payload with an item) embedded anew into objects and parts, and one row (total, failed, over_budget)."""
    items = source.select(F.col("object_id").alias("item_id"), F.get_json_object("payload", "$.item").alias("item"))
    out = upsert_items(objects, parts, items, split, embed, dimensions)
    counts = items.agg(F.count_distinct("item_id").alias("total")).crossJoin(out.failed.agg(F.count("*").alias("failed")))  # a row each
    return out, counts.withColumn("over_budget", over_budget(F.col("failed"), F.col("total"), budget))
