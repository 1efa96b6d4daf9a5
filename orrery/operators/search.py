"""Similarity and payload search over objects (object_id, payload, original_id, user_id, ...) and their parts
(part_id, object_id, vector, is_average). One planner covers order by similarity or field, filters, vectors and users.

Ties always fall by object_id. A null threshold is no bound. Of an object's parts the nearest counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from orrery.functions.vectors import METRICS, as_vector, checked, distance, literal
from orrery.operators.filters import compile_filter


#: Queries of a batch that are compared at once.
QUERY_BLOCK = 100_000
#: Parts that meet queries at once, pairs whose products are in memory, and pairs whose exact distances are.
TILE_PARTS, TILE_PAIRS, EXACT_PAIRS = 2048, 1 << 18, 1 << 15


@dataclass(frozen=True)
class Collection:
    """objects and parts, with the metric and width of the vectors."""

    objects: DataFrame
    parts: DataFrame
    metric: str = "cosine"
    dimensions: int | None = None


def part_distances(c: Collection, query: Sequence[float], average_only: bool = False, max_distance: float | None = None) -> DataFrame:
    if c.dimensions is not None and len(query) != c.dimensions:
        raise ValueError(f"the query has {len(query)} dimensions, the collection {c.dimensions}")
    parts = c.parts.where("is_average") if average_only else c.parts
    vector = as_vector("vector")
    if c.dimensions is not None:
        vector = checked(vector, c.dimensions)
    out = parts.select("object_id", "part_id", "vector", distance(c.metric, vector, literal(query)).alias("distance"))
    return out if max_distance is None else out.where(F.col("distance") <= max_distance)


def rollup(parts: DataFrame, aggregate: str = "min", with_vectors: bool = False) -> DataFrame:
    """object_id, distance and part_ids by distance (and vectors in the same order)."""
    fields = ["distance", "part_id", *(["vector"] if with_vectors else [])]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    out = parts.groupBy("object_id").agg({"min": F.min, "avg": F.avg}[aggregate]("distance").alias("distance"), ordered.alias("p"))
    cols = ["object_id", "distance", F.transform("p", lambda x: x["part_id"]).alias("part_ids")]
    return out.select(*cols, *([F.transform("p", lambda x: x["vector"]).alias("vectors")] if with_vectors else []))


def visible(objects: DataFrame, user_id: str | None) -> DataFrame:
    """Global objects; for a user also the user's own, which hide the originals they were made from."""
    if user_id is None:
        return objects.where("user_id is null")
    own = objects.where(F.col("user_id") == user_id)
    hidden = own.where("original_id is not null").select(F.col("original_id").alias("object_id")).distinct()
    return objects.where(F.col("user_id").isNull()).join(hidden, "object_id", "left_anti").unionByName(own)


def field_order(field: str, ascending: bool = True, from_payload: bool = True, payload: str = "payload") -> list[Column]:
    """Numbers by value, then texts; nulls last ascending and first descending."""
    value = F.get_json_object(payload, f"$.{field}") if from_payload else F.col(field).cast("string")
    keys = [value.try_cast("double"), value]
    return [k.asc_nulls_last() if ascending else k.desc_nulls_first() for k in keys]


def similar(
    c: Collection,
    query: Sequence[float],
    limit: int,
    offset: int = 0,
    *,
    filter: dict | None = None,
    user_id: str | None = None,
    max_distance: float | None = None,
    average_only: bool = False,
    with_vectors: bool = False,
    strategy: str = "pre_filter",
    enlarged_limit: int | None = None,
    sort_by: tuple[str, bool] | None = None,
    aggregate: str = "min",
) -> DataFrame:
    """The page [offset, offset + limit) of objects: object_id (the original's for a personal copy), distance,
    part_ids, found_id (as stored), subset_count (objects that qualify before the page is cut).

    pre_filter is exact. post_filter takes the enlarged_limit nearest parts first and filters after, as an
    approximate index would; it may return fewer rows. sort_by, a payload key and whether it ascends, orders in place of distance.
    """
    if strategy not in ("pre_filter", "post_filter"):
        raise ValueError(f"unknown strategy {strategy!r}")
    objects = visible(c.objects, user_id).where(compile_filter(filter)).select("object_id", "original_id", "payload")
    parts = part_distances(c, query, average_only, max_distance)
    if strategy == "post_filter":
        parts = parts.orderBy("distance", "part_id").limit(max(enlarged_limit or 0, limit + offset))
    near = parts.join(objects.select("object_id"), "object_id", "left_semi")
    # An object's distance alone is gathered for all; parts, vectors and payloads only for those of the page.
    found = near.groupBy("object_id").agg({"min": F.min, "avg": F.avg}[aggregate]("distance").alias("distance"))
    total = near.agg(F.count_distinct("object_id").alias("subset_count"))
    if sort_by is None:
        keys, order = found, [F.col("distance").asc(), F.col("object_id").asc()]
    else:
        keys, order = found.join(objects.select("object_id", "payload"), "object_id"), [*field_order(*sort_by), F.col("object_id").asc()]
    page = (keys.orderBy(*order).offset(offset) if offset else keys.orderBy(*order)).limit(limit)
    if sort_by is not None:
        page = page.select("object_id", "distance", "payload")
    own = rollup(near.join(F.broadcast(page.select("object_id")), "object_id", "left_semi"), aggregate, with_vectors).drop("distance")  # limit objects
    named = objects.select("object_id", "original_id").join(F.broadcast(page), "object_id").join(F.broadcast(own), "object_id")
    extra = ["vectors"] if with_vectors else []
    out = named.crossJoin(F.broadcast(total)).orderBy(*order)  # total is one row
    return out.select(F.coalesce("original_id", "object_id").alias("object_id"), F.col("object_id").alias("found_id"), "distance", "part_ids", *extra, "subset_count")


def similar_objects(c: Collection, query: Sequence[float], limit: int, offset: int = 0, **options) -> DataFrame:
    """The page of similar, with the whole objects: all their columns and parts, an array of (part_id, vector, is_average)
    by part_id, of the objects as found, under the ids of their originals."""
    page = similar(c, query, limit, offset, **options)
    ids = F.broadcast(page.select("found_id"))  # limit rows at most
    rest = [x for x in c.objects.columns if x not in ("object_id", "original_id")]
    objects = c.objects.join(ids, F.col("object_id") == F.col("found_id"), "left_semi").select(F.col("object_id").alias("found_id"), *rest)
    parts = c.parts.join(ids, F.col("object_id") == F.col("found_id"), "left_semi").groupBy(F.col("object_id").alias("found_id"))
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("part_id", "vector", "is_average"))).alias("parts"))
    return page.select("object_id", "found_id", "distance", "subset_count").join(objects, "found_id").join(parts, "found_id").orderBy("distance", "found_id")


def next_offset(returned: int, limit: int, offset: int = 0) -> int | None:
    """Where the next page starts; None after a page that isn't full."""
    return limit + offset if returned == limit else None


def payload_search(c: Collection, limit: int, offset: int = 0, *, filter: dict | None = None, order: list[Column] | None = None) -> DataFrame:
    """Originals that meet the filter, a page in order, with the number of their parts; without parts an object drops out."""
    objects = c.objects.where("user_id is null and original_id is null").where(compile_filter(filter))
    order = [*(order or []), F.col("object_id").asc()]
    page = objects.orderBy(*order)
    page = (page.offset(offset) if offset else page).limit(limit)
    counts = c.parts.join(F.broadcast(page.select("object_id")), "object_id", "left_semi").groupBy("object_id").agg(F.count("part_id").alias("n_parts"))
    return page.join(counts, "object_id").select("object_id", "payload", "n_parts")


def payload_count(c: Collection, filter: dict | None = None) -> DataFrame:
    return c.objects.where("user_id is null and original_id is null").where(compile_filter(filter)).agg(F.count("object_id").alias("n"))


def matrix(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an Arrow column as rows of doubles, and the places of these rows; nulls are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null().cast(pa.list_(pa.float64()))
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = values.size // max(1, len(column))
    if (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors of several lengths")
    return values.reshape(len(column), width), there


def places(mask: np.ndarray) -> np.ndarray:
    """np.flatnonzero of a mask with few places set, eight at a time."""
    flat = np.ascontiguousarray(mask).ravel()
    end = flat.size // 8 * 8
    words = np.flatnonzero(flat[:end].view(np.uint64))
    i, j = np.nonzero(flat[:end].reshape(-1, 8)[words])
    return np.concatenate([words[i] * 8 + j, end + np.flatnonzero(flat[end:])])


class Nearest:
    """The k nearest parts of each row of q among all parts added, by distance and id.

    Products of blocks sift the pairs, with a margin for their rounding; what is near enough gets its distance term by term,
    as the columns of orrery.functions.vectors do. So equal vectors are equally far wherever they stand, and ids settle ties.
    A pair without a distance (a zero vector by cosine, a value that is no number) is no neighbour."""

    def __init__(self, q: np.ndarray, k: int, metric: str, block: int = 512):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
        self.q, self.k, self.metric, self.block = q, k, metric, block
        self.ids: np.ndarray | None = None
        self.row, self.distance = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)
        self.norm = np.sqrt((q * q).sum(1))
        self.sifted = self._sifted(q, self.norm) * (-2 if metric == "euclid" else -1)

    def _sifted(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            return (x / norm[:, None]).astype(np.float32)

    def _exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        total = lambda a: np.add.accumulate(a, axis=1)[:, -1]  # noqa: E731  in order, as Spark adds
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if self.metric == "cosine":
                return 1 - total(q * x) / np.sqrt(total(q * q) * total(x * x))
            return np.sqrt(total((q - x) * (q - x))) if self.metric == "euclid" else -total(q * x)

    def add(self, ids: np.ndarray, x: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        """groups: rows of x and the rows of q that they are compared with; without, all with all."""
        if not len(x) or not len(self.q):
            return
        if x.shape[1] != self.q.shape[1]:
            raise ValueError(f"the queries have {self.q.shape[1]} dimensions, the parts {x.shape[1]}")
        first = 0 if self.ids is None else self.ids.size
        self.ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        kept = self._few_copies(ids, x)
        norm = np.sqrt((x * x).sum(1))
        sifted = self._sifted(x, norm)
        for rows, asked in groups if groups is not None else [(np.arange(len(x)), np.arange(len(self.q)))]:
            rows = rows[kept[rows]]
            own = np.ascontiguousarray(sifted[rows].T)
            step = min(self.block, TILE_PAIRS // max(1, min(rows.size, TILE_PARTS)))
            for low in range(0, asked.size, step):
                some = asked[low : low + step]
                for left in range(0, rows.size, TILE_PARTS):
                    part = slice(left, left + TILE_PARTS)
                    self._tile(some, rows[part], own[:, part], norm[rows[part]], x, first)

    def _few_copies(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether each row is among the k first, by id, of its equals; no later one is among the k nearest."""
        bits = np.ascontiguousarray(x).view(np.uint64)
        odd = np.random.default_rng(0).integers(1 << 62, size=x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        key = (bits * odd).sum(1, dtype=np.uint64)
        order = np.lexsort((ids, key))
        new = np.ones(len(x), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        late = np.flatnonzero(np.arange(len(x)) - start >= self.k)
        late = late[(bits[order[late]] == bits[order[start[late]]]).all(1)]
        kept = np.ones(len(x), bool)
        kept[order[late]] = False
        return kept

    def _tile(self, asked: np.ndarray, rows: np.ndarray, own: np.ndarray, norm: np.ndarray, x: np.ndarray, first: int) -> None:
        """asked: rows of q; rows: rows of x, with their columns of the sifting matrix and their lengths."""
        k, worst = self.k, self.distance[asked, -1]
        with np.errstate(all="ignore"):
            key = self.sifted[asked] @ own
            if self.metric == "euclid":
                key += norm * norm
            # Twice what rounding may add up to in products, lengths and what is known of the worst.
            length, high = self.norm[asked], np.max(norm, where=np.isfinite(norm), initial=0)
            unit, scale = {"cosine": (2.0**-23, 1.0), "dot": (2.0**-52, length * high), "euclid": (2.0**-52, (length + high) ** 2)}[self.metric]
            margin = 2 * (x.shape[1] + 8) * unit * scale + np.zeros(asked.size)
            bound = {"cosine": worst - 1, "dot": worst, "euclid": worst * worst - length * length}[self.metric] + margin
            if len(rows) > k and (open_ := np.flatnonzero(np.isinf(worst))).size:
                bound[open_] = np.minimum(bound[open_], np.partition(key[open_], k - 1, axis=1)[:, k - 1] + 2 * margin[open_])
            bound[np.isnan(bound)] = np.inf
            bound = np.nextafter(bound.astype(key.dtype), key.dtype.type(np.inf))
            i, j = np.divmod(places(key <= bound[:, None]), len(rows))
        if not i.size:
            return
        d = np.concatenate([self._exact(self.q[asked[i[s : s + EXACT_PAIRS]]], x[rows[j[s : s + EXACT_PAIRS]]]) for s in range(0, i.size, EXACT_PAIRS)])
        near = np.isfinite(d) & (d <= worst[i])
        i, j, d = i[near], j[near], d[near]
        if not i.size:
            return
        some, place = np.unique(i, return_inverse=True)
        every_i = np.concatenate([np.repeat(np.arange(some.size), k), place])
        every_r = np.concatenate([self.row[asked[some]].ravel(), rows[j] + first])
        every_d = np.concatenate([self.distance[asked[some]].ravel(), d])
        order = np.lexsort((self.ids[every_r], every_d, every_i))
        rank = np.arange(order.size) - np.searchsorted(every_i[order], every_i[order])
        order = order[rank < k]  # k of each, as k of each were there before
        self.row[asked[some]], self.distance[asked[some]] = every_r[order].reshape(-1, k), every_d[order].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, ids of parts and distances."""
        i, j = np.nonzero(np.isfinite(self.distance))
        return i, self.ids[self.row[i, j]] if i.size else np.zeros(0, np.int64), self.distance[i, j]


def nearest(queries: DataFrame, parts: DataFrame, k: int, metric: str = "cosine", cells: Callable[[np.ndarray], np.ndarray] | None = None, block: int = 512) -> DataFrame:
    """query_id, part_id, distance, rank: the k nearest parts (part_id, vector) of each row of queries (query_id, vector).
    cells gives the cells in which each query looks; parts have theirs in the column cell then. block queries at most are in a product.

    Queries go in blocks of 100,000 at most against all parts, each task keeping its k best, so nothing grows with the
    product but the arithmetic, and neither driver nor tasks hold more than a block of queries."""
    spark, n = queries.sparkSession, queries.count()
    rows = parts.select("part_id", "vector", *(["cell"] if cells is not None else []))
    schema = ST.StructType([ST.StructField("query_id", queries.schema["query_id"].dataType), ST.StructField("part_id", parts.schema["part_id"].dataType), ST.StructField("distance", ST.DoubleType())])
    local, by_cell = None, cells is not None
    blocks = max(1, -(-n // QUERY_BLOCK))
    for b in range(blocks):
        asked = queries.select("query_id", "vector").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        q, there = matrix(asked.column("vector"))
        looks = cells(q) if cells is not None else np.zeros((0, 1), int)
        wanted = [np.flatnonzero((looks == c).any(1)).astype(np.int32) for c in range(looks.max(initial=-1) + 1)]
        shared = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks().take(pa.array(there)), q, wanted))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, wanted = shared.value
            best, kind = Nearest(q, k, metric, block), None
            for batch in batches:
                x, there = matrix(batch.column("vector"))
                kind, groups = batch.schema.field("part_id").type, None
                if batch.column("part_id").null_count:
                    raise ValueError("a part without part_id")
                own = batch.column("part_id").to_numpy(zero_copy_only=False)[there]
                if by_cell:
                    cell = batch.column("cell").to_numpy(zero_copy_only=False)[there]
                    groups = [(np.flatnonzero(cell == c), wanted[int(c)]) for c in np.unique(cell) if c < len(wanted)]
                best.add(own.astype(str) if own.dtype == object else own, x, groups)
            if kind is not None:
                i, ids, d = best.found()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(ids).cast(kind), pa.array(d)], names=["query_id", "part_id", "distance"])

        part = rows.mapInArrow(run, schema)
        local = part if local is None else local.union(part)
    w = Window.partitionBy("query_id").orderBy("distance", "part_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def batch_similar(queries: DataFrame, parts: DataFrame, k: int, metric: str = "cosine", block: int = 512) -> DataFrame:
    """The k nearest parts of each query row (query_id, vector) by number: query_id, part_id, distance, rank. See nearest."""
    return nearest(queries.withColumn("query_id", F.col("query_id").cast("long")), parts.withColumn("part_id", F.col("part_id").cast("long")), k, metric, block=block)
