"""Choosing categories for a query from distances or vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import distance, similarity_of


def margin_value(metric: str, dist: Column, margin: float, is_similarity: bool = True) -> Column:
    """Similarity less the threshold 1 - margin, or margin less distance: positive where a category is near enough."""
    return similarity_of(metric, dist) - (1 - margin) if is_similarity else margin - dist


def binary_select(metric: str, dist: Column, margin: float, is_similarity: bool = True) -> Column:
    return margin_value(metric, dist, margin, is_similarity) > 0


def probability(metric: str, dist: Column, margin: float = 0.2, scale: float = 10.0, is_similarity: bool = True) -> Column:
    return 1 / (1 + F.exp(-margin_value(metric, dist, margin, is_similarity) * scale))


def probable(metric: str, dist: Column, threshold: float, margin: float = 0.2, scale: float = 10.0, is_similarity: bool = True) -> Column:
    return probability(metric, dist, margin, scale, is_similarity) > threshold


def soft_min_distance(query_parts: Column, parts: Column, metric: str = "cosine", beta: float = 10.0) -> Column:
    """Mean over the query's parts of the soft minimum of distances to an object's parts; only real parts take part."""
    per = F.transform(query_parts, lambda q: F.transform(parts, lambda p: distance(metric, q, p)))

    def soft(ds: Column) -> Column:
        low = F.array_min(ds)
        weight = F.transform(ds, lambda d: F.exp(-(d - low) * beta))
        total = F.aggregate(weight, F.lit(0.0), lambda a, x: a + x)
        return F.aggregate(F.zip_with(ds, weight, lambda d, w: d * w), F.lit(0.0), lambda a, x: a + x) / total

    means = F.transform(per, soft)
    return F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)


def vector_distance(query: Column, parts: Column, metric: str = "cosine", is_similarity: bool = False, aggregate: str = "min", temperature: float = 1.0, scale_to_one: bool = False) -> Column:
    """Distance or similarity of a query vector to an object's parts, computed from the vectors.

    min is the soft minimum, values weighted by exp(-value / temperature); avg the mean. scale_to_one brings cosine
    similarities to 0..1 before they are turned into distances (dot values are scaled over a whole batch by scaled_dot)."""

    def value(p: Column) -> Column:
        if metric == "euclid":
            d = distance("euclid", query, p)
            return -d if is_similarity else d
        sim = 1 - distance("cosine", query, p) if metric == "cosine" else -distance("dot", query, p)
        if metric == "cosine" and scale_to_one:
            sim = (sim + 1) / 2
        if is_similarity:
            return sim
        return 1 - sim if metric == "cosine" else -sim

    values = F.transform(parts, value)
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if aggregate == "avg":
        return add(values) / F.size(parts)
    weights = F.transform(values, lambda v: F.exp((F.array_min(values) - v) / temperature))
    return add(F.zip_with(values, weights, lambda v, w: v * w)) / add(weights)


def scaled_dot(df: DataFrame, value: str) -> DataFrame:
    """value less its mean over all rows, over its standard deviation: dot products of a batch on one scale."""
    stats = df.agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_dev"))
    return df.crossJoin(F.broadcast(stats)).withColumn(value, (F.col(value) - F.col("_mean")) / F.col("_dev")).drop("_mean", "_dev")  # stats is one row


def parse_query(c, query, top: int = 36, max_distance: float | None = None, threshold: float = 0.985, margin: float = 0.2, scale: float = 10.0, **options) -> DataFrame:
    """Categories of a query: the top nearest objects of a collection within max_distance that the selector finds probable."""
    from orrery.operators.search import similar

    found = similar(c, query, top, max_distance=max_distance, **options).select("object_id", "distance")
    return select_categories(found, c.metric, threshold, margin, scale, top)


def select_categories(candidates: DataFrame, metric: str, threshold: float = 0.985, margin: float = 0.2, scale: float = 10.0, top: int = 36) -> DataFrame:
    """The candidates (object_id, distance) nearest first, cut to top, that are probable."""
    near = candidates.orderBy("distance", "object_id").limit(top)
    return near.withColumn("probability", probability(metric, F.col("distance"), margin, scale)).where(F.col("probability") > threshold)
