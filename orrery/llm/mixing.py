"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A document of a source whose target is r copies for each of its documents gets a Poisson(r) number of copies: a
hash of seed and id is its uniform number, and the count is where the cumulative distribution reaches it. Large rates
are sums of independent draws, each of its own hash. So the count depends on nothing but the document and its
source's rate; any executor computes it again alike.

Rates reach the documents in two ways that are the same at any size. Sources that hold at least one row in HEAVY are
HEAVY at most, so their rates are sent to all tasks. The documents of all other sources meet their rates by a shuffle
in which no key has more than one row in HEAVY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import table

SEED = "orrery-mix-1"
#: Sources are weighted by the given power of their number of documents unless targets are given.
TEMPERATURE = 0.5
#: Steps of the cumulative distribution beyond a rate r: P(count > 2r + 40) is below 2**-52 for any r.
STEPS = 40
#: The largest rate of one draw (exp(-rate) nears underflow at 700); a larger one is split evenly.
DRAW_RATE = 500
#: Sources with at least one row in so many are sent to all tasks; there can't be more than this number of them.
HEAVY = 1000


def uniform(seed: str, key: Column, draw: Column | None = None) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key), or of md5(seed:key:draw) for draws from 1."""
    told = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    if draw is not None:
        told = F.concat(told, F.when(draw > 0, F.concat(F.lit(":"), draw.cast("string"))).otherwise(F.lit("")))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(rate: Column, u: Column) -> Column:
    """How many of the cumulative probabilities of 0, 1, 2, ... up to 2 * rate + STEPS are at most u."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), (F.exp(-rate) <= u).cast("int").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["n"] + (acc["cdf"] + p <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(2 * rate + STEPS).cast("int")), start, step, lambda acc: acc["n"])


def copies(rate: Column, seed: str, key: Column) -> Column:
    """A Poisson(rate) number that depends on seed and key: a sum of ceil(rate / DRAW_RATE) draws of equal rates."""
    draws = F.greatest(F.ceil(rate / DRAW_RATE).cast("int"), F.lit(1))
    return F.aggregate(F.sequence(F.lit(0), draws - 1), F.lit(0), lambda acc, j: acc + poisson(rate / draws, uniform(seed, key, j)))


def source_rates(docs: DataFrame, source_col: str = "source", targets: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(key, n, all, rate) per source, all being the rows of docs: rate = total * weight / n, weights summing to 1. total defaults to the rows of docs.

    A null source is a source of its own. With targets, sources that they do not name get rate 0."""
    counts = docs.groupBy(_key(source_col).alias("key")).agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = F.create_map(*[x for k, v in targets.items() for x in (F.lit("s" + k), F.lit(float(v)))]) if targets else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.element_at(named, F.col("key")), F.lit(0.0))
    counts = counts.withColumn("w", weight)
    sums = counts.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn"))
    rate = F.when(F.col("sw") > 0, (F.lit(float(total)) if total is not None else F.col("sn").cast("double")) * F.col("w") / F.col("sw") / F.col("n")).otherwise(0.0)
    return counts.crossJoin(F.broadcast(sums)).select("key", "n", F.col("sn").alias("all"), rate.alias("rate"))  # sums is one row


def _key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", targets: dict[str, float] | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The columns of docs, each row repeated as drawn, with mix_copy (from 0), mix_copies and mix_key; shuffled globally.

    The order is that of mix_key, a hash of seed, id and copy, within partitions that hold a random share each. Rows
    with the same id and source get the same number of copies; a null id hashes as an empty one. Texts, null, empty or
    long, play no part. Columns of docs named like the three new ones are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_copies", "mix_key")]
    rates = source_rates(docs, source_col, targets, total, temperature)
    heavy = F.col("n") * HEAVY >= F.col("all")
    named = docs.select(*kept, _key(source_col).alias("__mix_source"))
    few = rates.where(heavy).select(F.col("key").alias("__mix_key"), F.col("rate").alias("__mix_rate"))
    many = rates.where(~heavy).select(F.col("key").alias("__mix_key"), F.col("rate").alias("__mix_rate"))
    same = F.col("__mix_source") == F.col("__mix_key")
    rated = named.join(F.broadcast(few), same).union(named.join(F.broadcast(few), same, "left_anti").join(many.hint("merge"), same))  # few has HEAVY rows at most
    drawn = rated.select(*kept, copies(F.col("__mix_rate"), seed, F.col(id_col)).alias("mix_copies")).where("mix_copies > 0")
    drawn = drawn.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    return drawn.withColumn("mix_key", order).repartition("mix_key").sortWithinPartitions("mix_key")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every copy of every document, the whole row."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE = {
    "op2_mix_sources": f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * pow(n::DOUBLE, {TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {TEMPERATURE})) FROM s) / n AS rate FROM s),
r AS (SELECT source, greatest(ceil(rate / {DRAW_RATE})::INT, 1) AS draws, rate / greatest(ceil(rate / {DRAW_RATE})::INT, 1) AS rate FROM w),
t AS (SELECT source, rate, unnest(range(0, ceil(2 * rate + {STEPS})::INT + 1)) AS k FROM r),
p AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM t),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p) GROUP BY source),
x AS (SELECT doc_id, text, lang, d.source, n_chars, cdf, unnest(range(0, draws)) AS j, row_number() OVER () AS place FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN c ON d.source IS NOT DISTINCT FROM c.source),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN j > 0 THEN ':' || j::VARCHAR ELSE '' END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM x),
d AS (SELECT place, any_value(doc_id) AS doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars, sum(len(list_filter(cdf, lambda v: v <= u))) AS mix_copies FROM u GROUP BY place),
e AS (SELECT *, unnest(range(0, mix_copies::BIGINT))::INT AS mix_copy FROM d)
SELECT doc_id, text, lang, source, n_chars, mix_copy, mix_copies::INT AS mix_copies,
       md5('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || mix_copy::VARCHAR) AS mix_key FROM e
"""
}
