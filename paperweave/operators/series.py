"""Yearly series, growth, bursts, shares, interpolation and gap repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_series(rows: DataFrame, topic: str, year: str, id_: str, score: str) -> DataFrame:
    """(topic, year, count, cumulative, representative) for every topic and every year that occurs.

    The representative is the id of greatest score, the smaller id on ties.
    """
    counted = rows.groupBy(topic, year).agg(F.count("*").alias("count"), F.max_by(id_, F.struct(F.col(score), -F.col(id_))).alias("representative"))
    grid = rows.select(topic).distinct().crossJoin(F.broadcast(rows.select(year).distinct()))
    w = Window.partitionBy(topic).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(counted, [topic, year], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return full.withColumn("cumulative", F.sum("count").over(w)).select(topic, year, "count", "cumulative", "representative")


def _windows(yearly: DataFrame, topic: str, year: str) -> DataFrame:
    """Counts of the last three years and of the three before, by each topic's own last year."""
    last = F.max(year).over(Window.partitionBy(topic))
    own = yearly.withColumn("last", last)
    between = lambda a, b: F.coalesce(F.sum(F.when(F.col(year).between(F.col("last") - a, F.col("last") - b), F.col("count"))), F.lit(0))
    return own.groupBy(topic).agg(F.sum("count").alias("total"), F.count("*").alias("years"), between(2, 0).alias("recent"), between(5, 3).alias("previous"))


def growth(yearly: DataFrame, topic: str, year: str) -> DataFrame:
    """recent, previous, rate and class: growing or declining need two items and a quarter of change."""
    x = _windows(yearly, topic, year).withColumn("rate", F.round((F.col("recent") - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1)), 4))
    diff = F.col("recent") - F.col("previous")
    trend = F.when((diff >= 2) & (F.col("rate") >= 0.25), "growing").when((diff <= -2) & (F.col("rate") <= -0.25), "declining").otherwise("stable")
    return x.select(topic, "recent", "previous", "rate", trend.alias("trend"))


def bursts(yearly: DataFrame, topic: str, year: str, limit: int = 40) -> DataFrame:
    """Terms whose recent counts rise: log2 of the smoothed ratio times log1p of the recent count."""
    x = _windows(yearly, topic, year)
    score = F.round(F.log2((F.col("recent") + 1) / (F.col("previous") + 1)) * F.log1p("recent"), 4)
    kept = x.withColumn("score", score).filter("total >= 3 AND years >= 2 AND recent >= 2 AND score > 0.35")
    return kept.select(topic, "recent", "previous", "score").orderBy(F.col("score").desc(), topic).limit(limit)


def window_share(yearly: DataFrame, topic: str, year: str, start: int, end: int) -> DataFrame:
    """Each topic's count in [start, end] and its share of all."""
    x = yearly.filter(F.col(year).between(start, end)).groupBy(topic).agg(F.sum("count").alias("count"))
    return x.withColumn("share", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 4))


def resample(points: DataFrame, by: str, x: str, y: str, step: float) -> DataFrame:
    """Median y of each step of x; steps without points between two others are interpolated, at most four in a row."""
    cells = points.groupBy(by, F.floor(F.col(x) / step).cast("long").alias("cell")).agg(F.median(y).alias("y"))
    bounds = cells.groupBy(by).agg(F.explode(F.sequence(F.min("cell"), F.max("cell"))).alias("cell"))
    full = bounds.join(cells, [by, "cell"], "left")
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy("cell").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("y").isNotNull(), F.struct("cell", "y"))
    full = full.withColumn("_a", F.last(known, ignorenulls=True).over(before)).withColumn("_b", F.first(known, ignorenulls=True).over(after))
    gap = F.col("_b.cell") - F.col("_a.cell")
    line = F.col("_a.y") + (F.col("cell") - F.col("_a.cell")) * (F.col("_b.y") - F.col("_a.y")) / F.nullif(gap, F.lit(0))
    value = F.when(F.col("y").isNotNull(), F.col("y")).when(gap <= 5, line)
    return full.select(by, "cell", F.round(value, 6).alias("y"), F.col("y").isNull().alias("filled"))


def repair_gaps(points: DataFrame, series: str, order: str, y: str) -> DataFrame:
    """Missing values become the mean of what is known on both sides, in series that miss a fifth (rounded down, or two) at most.

    A repaired value is known to the next: the i-th of a run between L and R is
    R + (L - R) / 2^i. With one known side it is that side's value; a series
    without known values stays.
    """
    all_ = Window.partitionBy(series)
    w = all_.orderBy(order)
    place = F.row_number().over(w)
    left = F.last(F.when(F.col(y).isNotNull(), F.struct(F.col("_place").alias("p"), F.col(y).alias("v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(y, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    few = F.sum(F.col(y).isNull().cast("int")).over(all_) <= F.greatest(F.lit(2), F.floor(0.2 * F.count(F.lit(1)).over(all_)))
    steps = F.col("_place") - F.col("_left.p")
    value = F.coalesce(F.col("_right") + (F.col("_left.v") - F.col("_right")) / F.pow(F.lit(2.0), steps), F.col("_left.v"), F.col("_right"))
    known = points.withColumn("_place", place).withColumn("_left", left).withColumn("_right", right).withColumn("_few", few)
    return known.withColumn(y, F.coalesce(y, F.when(F.col("_few"), value))).select(*points.columns)
