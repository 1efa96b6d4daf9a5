"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Counted as part of the subpackage orrery.llm. Every stage takes (spark, docs, sf_dir) and keeps whole rows: all columns
that docs has, whatever their names. An empty table gives no rows. What becomes of nulls, empty texts and repeated rows
is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import leave_notes, materialize, notes_of, placed, table
from orrery.llm.decontamination import remove_leaks
from orrery.llm.exact_dedup import duplicate_groups
from orrery.llm.mixing import mix_sources
from orrery.llm.near_dedup import near_duplicates
from orrery.llm.quality import fit, keep_good


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the rows whose id found does not keep in any row: ids alone are joined, and the outcome returns to the rows as notes."""
    gone = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("kept")).where("not kept")
    names = [f"c{k}" for k in range(len(docs.columns))]
    at = placed(docs.toDF(*names))
    key = F.col(names[docs.columns.index("doc_id")]).cast("long")
    noted = notes_of(leave_notes(at.join(gone, key == F.col("gone")).select("file_at", "row_at", F.col("gone").alias("note")), "gone"))
    return at.where(noted("file_at", "row_at").isNull()).select(*names).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more stay. Null texts score as empty ones; null ids play no part."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id.

    Null and empty texts are equal. Rows with a null id stay. Rows that share an id go only if all of them would."""
    return _without(docs, duplicate_groups(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8 the smallest id stays.

    Null and empty texts and rows with a null id are linked with nothing and stay. Rows that share an id go only if all of them would."""
    return _without(docs, near_duplicates(docs, width=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go. Null and empty texts hold none and stay, ids play no part."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by the square root of their size; documents repeat, and copies are shuffled.

    A null source is one of its own; rows with the same id and source are drawn alike, a null id as an empty one."""
    return mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix),
]

#: The classifier and MinHash can't be told in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
