"""Collections of objects and parts as Parquet tables: catalog with a blue pointer, upserts and deletes by rewriting."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = "object_id string, payload string, storage_meta string, original_id string, user_id string, session_id string"
PARTS = "part_id string, object_id string, vector array<float>, is_average boolean, user_id string"


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those of the same key; every column is replaced. new has a key once."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert(table: DataFrame, new: DataFrame) -> DataFrame:
    """table and the rows of new; columns that one lacks are null there. Keys are not looked at: upsert does that."""
    return table.unionByName(new, allowMissingColumns=True)


def capture_queries(objects: DataFrame, parts: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects and parts of a query collection with those of sessions (session_id, search_query, vector, user_id), each one
    object with one part; a session that is there already is left as it is, one without a vector is left out."""
    new = sessions.where(F.col("vector").isNotNull()).join(objects.select("session_id"), "session_id", "left_anti")
    key = F.concat_ws(":", F.lit("query"), F.col("session_id").cast("string"))
    payload = F.to_json(F.struct("search_query"))
    rows = new.select(key.alias("object_id"), payload.alias("payload"), "session_id", "user_id")
    own = new.select(F.concat_ws(":", key, F.lit("0")).alias("part_id"), key.alias("object_id"), "vector", F.lit(False).alias("is_average"), "user_id")
    return insert(objects, rows), insert(parts, own)


def upsert_parts(parts: DataFrame, new: DataFrame) -> DataFrame:
    """All parts of the objects in new are replaced, so an object may also shrink."""
    return parts.join(new.select("object_id").distinct(), "object_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "object_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def cascade_ids(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids, the originals of those, and the personal copies of both."""
    own = objects.join(ids.select("object_id").distinct(), "object_id", "left_semi")
    base = ids.select("object_id").union(own.where("original_id is not null").select(F.col("original_id"))).distinct()
    copies = objects.join(base.select(F.col("object_id").alias("original_id")), "original_id", "left_semi").select("object_id")
    return base.union(copies).distinct()


def find_by_ids(objects: DataFrame, parts: DataFrame, ids: DataFrame, key: str = "object_id") -> DataFrame:
    """Objects by object_id or original_id with their parts as an array; without parts it is empty."""
    found = objects.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return _with_parts(found, parts)


def find_by_session(objects: DataFrame, parts: DataFrame, session_id: str) -> DataFrame:
    return _with_parts(objects.where(F.col("session_id") == session_id), parts)


def _with_parts(objects: DataFrame, parts: DataFrame) -> DataFrame:
    got = parts.join(objects.select("object_id"), "object_id", "left_semi").groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("part_id", "vector", "is_average"))).alias("parts"))
    return objects.join(got, "object_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast(got.schema["parts"].dataType)))


def total(objects: DataFrame) -> DataFrame:
    return objects.where("user_id is null and original_id is null").agg(F.count("*").alias("n"))


def page(objects: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A stable page: by id."""
    return objects.orderBy("object_id").offset(offset).limit(limit)


def promote(objects: DataFrame, columns: dict[str, str], payload: str = "payload") -> DataFrame:
    """Payload keys as real columns (name -> type), null where they don't convert; what is already there wins."""
    out = objects
    for name, kind in columns.items():
        value = F.get_json_object(payload, f"$.{name}").try_cast(kind)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in objects.columns else value)
    return out


def drop_improved_copies(objects: DataFrame, upserted: DataFrame) -> DataFrame:
    """Without the personal copies of objects that were just upserted."""
    gone = upserted.select(F.col("object_id").alias("original_id")).distinct()
    return objects.join(gone, "original_id", "left_anti").select(objects.columns)


@dataclass
class CollectionInfo:
    collection_id: str
    dimensions: int
    metric: str = "cosine"
    aggregation: str = "min"
    state: str = "green"
    index_created: bool = False
    optimizations: list[str] = field(default_factory=list)


class Catalog:
    """Collections under a folder; small JSON rows, written whole through Spark so that any store will do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self) -> dict[str, CollectionInfo]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_catalog")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return {}
        rows = [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/_catalog").collect()]
        last = max((r["version"] for r in rows), default=0)
        return {r["collection_id"]: CollectionInfo(**{k: v for k, v in r.items() if k != "version"}) for r in rows if r["version"] == last and r["collection_id"]}

    def _write(self, infos: dict[str, CollectionInfo]) -> None:
        import time

        rows = [(json.dumps(asdict(i) | {"version": time.time_ns()}),) for i in infos.values()]
        version = time.time_ns()
        rows = [(json.dumps(json.loads(r[0]) | {"version": version}),) for r in rows] or [(json.dumps({"collection_id": "", "version": version}),)]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{self.folder}/_catalog")

    def exists(self, collection_id: str) -> bool:
        return collection_id in self._read()

    def get(self, collection_id: str) -> CollectionInfo:
        return self._read()[collection_id]

    def list(self) -> list[CollectionInfo]:
        return sorted(self._read().values(), key=lambda i: i.collection_id)

    def create(self, info: CollectionInfo, with_queries: bool = False) -> CollectionInfo:
        infos = self._read()
        for one in [info, *([CollectionInfo(f"{info.collection_id}_q", info.dimensions, info.metric, info.aggregation)] if with_queries else [])]:
            if one.collection_id in infos:
                raise ValueError(f"collection {one.collection_id} is already there")
            infos[one.collection_id] = one
            for kind, schema in (("objects", OBJECTS), ("parts", PARTS)):
                self.save(one.collection_id, kind, self.spark.createDataFrame([], schema))
        self._write(infos)
        return info

    def get_or_create(self, info: CollectionInfo) -> CollectionInfo:
        return self.get(info.collection_id) if self.exists(info.collection_id) else self.create(info)

    def delete(self, collection_id: str) -> None:
        infos = self._read()
        if infos[collection_id].state == "blue":
            raise ValueError("the blue collection can't be deleted")
        del infos[collection_id]
        self._write(infos)

    def set_blue(self, collection_id: str) -> None:
        infos = self._read()
        infos[collection_id].state = "blue"
        for other in infos.values():
            if other.collection_id != collection_id and other.state == "blue":
                other.state = "green"
        self._write(infos)

    def blue(self) -> CollectionInfo | None:
        return next((i for i in self._read().values() if i.state == "blue"), None)

    def optimize(self, collection_id: str, name: str, job) -> bool:
        """Runs a maintenance job once per collection."""
        infos = self._read()
        if name in infos[collection_id].optimizations:
            return False
        job(self, collection_id)
        infos[collection_id].optimizations.append(name)
        self._write(infos)
        return True

    def load(self, collection_id: str, kind: str) -> DataFrame:
        """The table's last whole version: a pointer row is appended after each write."""
        pointers = self.spark.read.schema("path string, version long").json(f"{self.folder}/{collection_id}/{kind}/_current")
        return self.spark.read.parquet(pointers.orderBy(F.desc("version")).first().path)

    def save(self, collection_id: str, kind: str, df: DataFrame) -> None:
        import time

        path = f"{self.folder}/{collection_id}/{kind}/v-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.spark.createDataFrame([(path, time.time_ns())], "path string, version long").coalesce(1).write.mode("append").json(f"{self.folder}/{collection_id}/{kind}/_current")


def payload_of(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))
