"""Readers for items: text, JSON and binary files of any Hadoop store, SQL tables over JDBC, and tags joined on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One item per file: item_id is the file's path."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("item_id"), F.col("value").alias("item"))


def json_files(spark: SparkSession, path: str, fields: list[str] | None = None, schema: str | None = None, list_field: str | None = None) -> DataFrame:
    """One item per file, or per element of list_field with `:<index>` in its id."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).json(path).withColumn("item_id", F.col("_metadata.file_path"))
    if list_field:
        df = df.select("item_id", F.posexplode(list_field).alias("_i", "_x")).select(F.concat_ws(":", "item_id", F.col("_i").cast("string")).alias("item_id"), "_x.*")
    return df.select("item_id", *fields) if fields else df


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("item_id"), F.col("content").alias("item"), "length")


def sql_table(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A JDBC table; partition: column, low, high and number of parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    return df.where(F.col(key).isin(ids))


def page(df: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def text_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The id as text and columns without nulls."""
    return df.select(F.col(key).cast("string").alias("item_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def json_columns(df: DataFrame, key: str, column: str, keys: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("item_id"), *[F.get_json_object(column, f"$.{k}").alias(k) for k in keys])


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows with source_name; a column that a source lacks is null there."""
    out = None
    for name in sorted(sources):
        df = sources[name].withColumn("source_name", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def derived_id(object_id: Column, *parts: Column) -> Column:
    return F.coalesce(object_id, F.concat_ws(":", *parts))


def with_tags(items: DataFrame, links: DataFrame, tags: DataFrame, key: str, outer: bool = True) -> DataFrame:
    """items (key, ...) with tags, the labels in order joined by ', ', as often as they are linked. links: key, tag_id; tags: tag_id, label.

    outer keeps items without tags, with an empty text; otherwise they drop out. Text columns of items are empty where
    null. Labels are gathered before the join, so each item's row is moved once."""
    labels = links.join(tags, "tag_id").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("tags"))
    out = items.join(labels, key, "left" if outer else "inner")
    return out.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" and f.name != key else F.col(f.name) for f in out.schema.fields])


def category_text(intent: Column, tag: Column, name: Column, value: Column) -> Column:
    """`intent/tag/name:value`; a null part is empty."""
    e = [F.coalesce(c.cast("string"), F.lit("")) for c in (intent, tag, name, value)]
    return F.concat(e[0], F.lit("/"), e[1], F.lit("/"), e[2], F.lit(":"), e[3])


def distinct_items(items: DataFrame, *identity: str) -> DataFrame:
    """One row for each identity (columns), whichever comes first by the hash of the rest; item_key is the sha256 of the identity."""
    rest = [c for c in items.columns if c not in identity]
    got = items.groupBy(*identity).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_r")) if rest else items.select(*identity).distinct()
    key = F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in identity]), 256).alias("item_key")
    return got.select(*identity, *([F.col("_r")[c].alias(c) for c in rest]), key)
