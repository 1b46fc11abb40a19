"""Comparison of documents: matrices of dimensions, shared labels, opposite results, reviews by people, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import jaccard
from ..storage import durable


def dimension_matrix(items: DataFrame, papers: DataFrame, dimensions: list[str], top: int = 8) -> DataFrame:
    """(record, dimension, count, items): a row for every paper and dimension, with its best items; items (record, dimension, label, confidence)."""
    spark = papers.sparkSession
    dims = F.broadcast(spark.createDataFrame([(d,) for d in dimensions], "dimension string"))
    order = Window.partitionBy("record", "dimension").orderBy(F.col("confidence").desc(), "label")
    best = items.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    listed = best.groupBy("record", "dimension").agg(F.count("*").alias("count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]), " | ").alias("items"))
    return papers.select("record").join(dims).join(listed, ["record", "dimension"], "left").select("record", "dimension", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("items", F.lit("")).alias("items"))


def overlay_reviews(matrix: DataFrame, reviews: DataFrame) -> DataFrame:
    """The matrix with the latest review of each cell: replace and add set a label, reject empties, confirm only marks it.

    reviews (record, dimension, at, action, label).
    """
    last = reviews.groupBy("record", "dimension").agg(F.max_by(F.struct("action", "label"), F.struct("at", "action", "label")).alias("_r"))
    x = matrix.join(last, ["record", "dimension"], "left")
    action, label = F.col("_r.action"), F.col("_r.label")
    items = F.when(action == "replace", label).when(action == "reject", F.lit("")).when(action == "add", F.concat_ws(" | ", F.nullif("items", F.lit("")), label)).otherwise(F.col("items"))
    return x.withColumn("items", items).withColumn("state", F.coalesce(action, F.lit("automatic"))).drop("_r")


def shared_nodes(nodes: DataFrame, record: str, key: str) -> DataFrame:
    """(key, records, first): labels that two records or more have."""
    return nodes.groupBy(key).agg(F.countDistinct(record).alias("records"), F.min(record).alias("first")).filter("records >= 2")


def missing_dimensions(items: DataFrame, papers: DataFrame, dimensions: list[str]) -> DataFrame:
    dims = F.broadcast(papers.sparkSession.createDataFrame([(d,) for d in dimensions], "dimension string"))
    return papers.select("record").join(dims).join(items.select("record", "dimension").distinct(), ["record", "dimension"], "left_anti")


#: What says that a result rises or falls (fixed values of the comparison, looked for in lower-case text).
RISING = ("improve", "outperform", "increase", "higher", "提升", "优于", "增加")
FALLING = ("not ", "underperform", "decrease", "lower", "降低", "不显著", "未提升")


def polarity(text: Column) -> Column:
    """up, down, or both by the words of change in a text; null without one."""
    low = F.lower(text)
    has = lambda words: F.coalesce(_any(low, words), F.lit(False))
    return F.when(has(RISING) & has(FALLING), "both").when(has(RISING), "up").when(has(FALLING), "down")


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


#: Likenesses from which pairs are looked for, in turn, until enough are found (fixed values); what rounding may add to a likeness.
ROUNDS, ROUNDING = (1.0, 0.8, 0.5), 0.0001


def opposite_results(claims: DataFrame, least: float = 0.20, limit: int = 40) -> DataFrame:
    """(a, b, likeness): rising and falling claims of different records that share enough terms, the likest first.

    claims (id, record, polarity in up, down or both, terms array<string>); a
    rises and b falls, and of two that do both the lesser id is a. Equal sets of
    terms are one. Two sets of which a share is common hold such a term among the
    rarest ones (prefix filter): with likeness j, a set of n terms needs only its
    n - ceil(j n) + 1 rarest to meet. The likest pairs come first, so a round
    that finds `limit` of them is the last. Of the claims of one set and polarity
    the first `limit` of a record, and of those the first 2 `limit`, can be
    among the first pairs: any other stands behind `limit` pairs of theirs.
    """
    known = claims.filter("polarity IS NOT NULL").select("id", "record", "polarity", F.sort_array(F.array_distinct("terms")).alias("terms")).filter(F.size("terms") > 0)
    known = durable(known.withColumn("key", F.sha2(F.concat_ws(",", "terms"), 256)))
    order = Window.partitionBy("key", "polarity", "record").orderBy("id")
    mine = known.select("key", "id", "record", "polarity").distinct().withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    mine = durable(mine.withColumn("_n", F.row_number().over(Window.partitionBy("key", "polarity").orderBy("id", "record"))).filter(F.col("_n") <= 2 * limit).drop("_n"))
    does = lambda own: F.max(F.col("polarity").isin(own, "both"))
    sets = durable(known.groupBy("key").agg(F.first("terms").alias("terms"), does("up").alias("up"), does("down").alias("down")))
    each = sets.select("key", "up", "down", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    ranked = durable(each.join(df, "term").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("df", "term"))))
    side = lambda rows, own, k: rows.filter(own).select("term", *[F.col(c).alias(f"{k}_{c}") for c in ("key", "n", "place")])
    member = lambda own, k: mine.filter(F.col("polarity").isin(own, "both")).select(F.col("key").alias(f"{k}_key"), F.col("id").alias(k), F.col("record").alias(f"r{k}"), (F.col("polarity") == "both").alias(f"m{k}"))
    once = ~(F.col("ma") & F.col("mb")) | (F.col("a") < F.col("b"))
    for at in [r for r in ROUNDS if r > least] + [least]:
        low = at - ROUNDING
        prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(low * F.col("n")) + 1)
        # what the two can still have in common from their first common term on
        rest = 1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
        fits = (F.least("a_n", "b_n") >= low * F.greatest("a_n", "b_n")) & (rest * (1 + low) >= low * (F.col("a_n") + F.col("b_n")))
        near = side(prefix, "up", "a").join(side(prefix, "down", "b"), "term").filter(fits).select("a_key", "b_key").distinct()
        texts = lambda k: sets.select(F.col("key").alias(f"{k}_key"), F.col("terms").alias(f"t{k}"))
        alike = near.join(texts("a"), "a_key").join(texts("b"), "b_key").select("a_key", "b_key", F.round(jaccard(F.col("ta"), F.col("tb")), 4).alias("likeness")).filter(F.col("likeness") >= at)
        pairs = alike.join(member("up", "a"), "a_key").join(member("down", "b"), "b_key").filter((F.col("ra") != F.col("rb")) & once)
        found = durable(pairs.select("a", "b", "likeness").distinct().orderBy(F.col("likeness").desc(), "a", "b").limit(limit))
        if at == least or found.count() >= limit:
            return found.orderBy(F.col("likeness").desc(), "a", "b")


def append_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of new whose key it lacks, once each."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def ordered_distinct(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by the order."""
    columns = rows.columns
    best = F.min_by(F.struct(*columns), F.struct(*order, *[c for c in columns if c not in order])).alias("_b")
    return rows.withColumn("_key", key).groupBy("_key").agg(best).select("_b.*")
