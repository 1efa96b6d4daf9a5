"""Vector adjustment from feedback: per session a few AdamW steps that draw clicked items to the query and push others away."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: AdamW's defaults.
BETA1, BETA2, EPSILON, DECAY = 0.9, 0.999, 1e-8, 0.01


def similarity(queries: np.ndarray, x: np.ndarray, metric: str, aggregate: str, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of rows of x to a set of query vectors, gathered over the set, and their gradients by x.

    min weighs them by exp(-similarity / temperature), avg takes the mean."""
    ip = x @ queries.T
    if metric == "cosine":
        n, m = np.maximum(np.linalg.norm(x, axis=1), 1e-12), np.maximum(np.linalg.norm(queries, axis=1), 1e-12)
        s = ip / n[:, None] / m[None, :]
        grads = (queries / m[:, None])[None, :, :] / n[:, None, None] - s[:, :, None] * x[:, None, :] / (n**2)[:, None, None]
    elif metric == "dot":
        s, grads = ip, np.broadcast_to(queries, (x.shape[0], *queries.shape))
    elif metric == "euclid":
        gap = queries[None, :, :] - x[:, None, :]
        s = -np.linalg.norm(gap, axis=2)
        grads = gap / np.maximum(-s, 1e-12)[:, :, None]
    else:
        raise ValueError(f"unknown metric {metric!r}")
    if aggregate == "avg":
        share, out = np.full(s.shape, 1 / s.shape[1]), s.mean(axis=1)
    else:
        w = np.exp(-(s - s.min(axis=1, keepdims=True)) / temperature)
        w /= w.sum(axis=1, keepdims=True)
        out = (w * s).sum(axis=1)
        share = w * (1 - (s - out[:, None]) / temperature)
    return out, (share[:, :, None] * grads).sum(axis=1)


def adjust(query: np.ndarray, items: np.ndarray, clicked: np.ndarray, rate: float, steps: int, metric: str = "cosine", aggregate: str = "min", temperature: float = 1.0) -> np.ndarray:
    """Items after so many steps on -mean(similarity of clicked^3) + mean(similarity of others^3), by analytic gradients; query: one vector or several."""
    x = items.astype(np.float64).copy()
    queries = np.atleast_2d(query).astype(np.float64)
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = np.where(clicked, -1.0 / max(clicked.sum(), 1), 1.0 / max((~clicked).sum(), 1))
    for t in range(1, steps + 1):
        s, g = similarity(queries, x, metric, aggregate, temperature)
        g = (weight * 3 * s**2)[:, None] * g
        x *= 1 - rate * DECAY
        m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
        x -= rate * (m / (1 - BETA1**t)) / (np.sqrt(v / (1 - BETA2**t)) + EPSILON)
    return x


def improve_vectors(rows: DataFrame, rate: float = 0.001, steps: int = 5, metric: str = "cosine", aggregate: str = "min", temperature: float = 1.0) -> DataFrame:
    """Adjusted vectors of rows (session_id, user_id, query: a vector or several, object_id, part_id, vector, is_clicked), as a user's own
    copies: object_id `<object>_<user>`, part_id `<copy>:<i>` or `<copy>:average`, original_id the object."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["object_id", "part_id"])
        out = adjust(np.array([*pdf["query"].iloc[0]], dtype=np.float64), np.stack(pdf["vector"].to_numpy()).astype(np.float64), pdf["is_clicked"].to_numpy(dtype=bool), rate, steps, metric, aggregate, temperature)
        return pd.DataFrame({"session_id": pdf["session_id"], "user_id": pdf["user_id"], "object_id": pdf["object_id"], "part_id": pdf["part_id"], "vector": list(out)})

    new = rows.groupBy("session_id").applyInPandas(run, "session_id string, user_id string, object_id string, part_id string, vector array<double>")
    copy = F.concat_ws("_", "object_id", "user_id")
    return new.select("session_id", "user_id", copy.alias("object_id"), F.concat_ws(":", copy, F.substring_index("part_id", ":", -1)).alias("part_id"), F.col("object_id").alias("original_id"), "vector")
