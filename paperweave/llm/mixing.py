"""Mixing sources to target weights.

Sizes are summed per source, each source gets a target and with it a repetition
rate, and every document is emitted floor(rate) times plus one more copy where a
hash of the document falls below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, shielded, unshielded, with_broadcast_if_small

#: Sources in order weigh so much, repeating.
WEIGHTS = (5, 2, 1)
#: All sources together share so much of their sizes, and one source at most so much of its own.
TOTAL_SHARE, MOST = 1.5, 2.0
#: Up to so many sources are broadcast to the documents; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The reshared excess has a closed form. With sources ordered by cap / weight,
    those before some point stop at their caps and the rest get one multiple of
    their weights; the point is the first at which that multiple is within the
    next source's cap. A null source is a source of its own and comes last.
    An empty table gives an empty table; a source without words has target 0.
    Only this table of one row per source passes through one task.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % n + 1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(whole) * F.lit(float(total_share)))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("open_weight"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def mix_plan(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """Documents with size, source_size, target, rate, copies and taken added.

    Null text has size 0. Repeated rows are documents of their own, though equal
    rows share one draw. The draw hashes the seed, doc_id and text, so reruns
    agree. Columns of these names in the input are replaced.
    """
    own = {"size", "source_size", "target", "rate", "copies", "taken"}
    base = docs.drop(*own).withColumn("size", word_count(F.col("text")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = materialize(targets(sizes, **options)).withColumnRenamed("source", "_source")
    joined = base.join(with_broadcast_if_small(per_source, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as its copies say, with the input's columns and their values.

    Columns of the input may have the plan's names. Null texts have size 0;
    repeated rows, very long texts and empty tables are as in mix_plan.
    """
    inner, other = shielded(docs, {"size", "source_size", "target", "rate", "copies", "taken", "_copy", "_source"})
    plan = mix_plan(inner, seed, **options)
    copies = plan.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return unshielded(copies, docs.columns, other)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
    source_size * 2.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM w
), l AS (
  SELECT *, (wanted - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM r
  WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT source, source_size, coalesce(least(cap, weight * arg_min(level, ratio) FILTER (level <= ratio) OVER ()), cap) AS target FROM l
), x AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source
), y AS (
  SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM x
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM y
"""
