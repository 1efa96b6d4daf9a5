"""Approximate search: parts are assigned to centroids trained on a bounded sample, and only the nearest cells are searched."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.vectors import as_vector, distance, literal
from orrery.operators.search import matrix, nearest

#: Of the 32 cells that train_centroids makes. Fewer lose neighbours where vectors hardly cluster; the README has the recall.
PROBES = 24


def train_centroids(parts: DataFrame, k: int = 32, sample_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """k-means on at most sample_rows parts with vectors, those with the smallest hashes of their ids."""
    named = parts.select(F.xxhash64("part_id").alias("h"), "part_id", "vector").where("vector is not null")
    # Hashes below this bound belong to somewhat more than sample_rows parts, so no task has to keep and sort more vectors than that.
    share = (sample_rows + 8 * sample_rows**0.5 + 64) / max(1, named.count())
    if share < 1:
        named = named.where(F.col("h") < int(share * 2.0**64) - 2**63)
    x, _ = matrix(named.orderBy("h", "part_id").limit(sample_rows).select("vector").toArrow().column("vector"))
    x = x[np.isfinite(x).all(1)]
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        near = _gaps(x, centres).argmin(1)
        for j in range(len(centres)):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]


def assign(parts: DataFrame, centres: np.ndarray) -> DataFrame:
    """parts with the number of their nearest cell, null without a vector; partition what is written by it to prune at search."""
    shared = parts.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            x, there = matrix(batch.column("vector"))
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(x):
                cell[there] = _gaps(x, shared.value).argmin(1)
            yield batch.append_column("cell", pa.array(cell, mask=cell < 0))

    from pyspark.sql import types as ST

    return parts.mapInArrow(run, ST.StructType([*parts.schema.fields, ST.StructField("cell", ST.IntegerType())]))


def search(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = PROBES, metric: str = "cosine") -> DataFrame:
    """The k nearest parts of the probes nearest cells, with exact distances."""
    cells = np.argsort(((centres - np.asarray(query)) ** 2).sum(1))[:probes].tolist()
    return assigned.where(F.col("cell").isin(cells)).select("part_id", distance(metric, as_vector("vector"), literal(query)).alias("distance")).orderBy("distance", "part_id").limit(k)


def batch_search(assigned: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = PROBES, metric: str = "cosine") -> DataFrame:
    """query_id, part_id, distance, rank: for each row of queries (query_id, vector) the k nearest parts of its probes
    nearest cells. Each task meets the queries that want the cells of its parts, in products of matrices; see search.nearest."""
    return nearest(queries, assigned, k, metric, lambda q: np.argsort(_gaps(q, centres), axis=1)[:, :probes] if len(q) else np.zeros((0, 1), int))
