"""The filterable library: filters, six sort orders, facets, pages, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relevance levels by least score (fixed values).
LEVELS = (("core", 12), ("high", 9), ("medium", 6), ("low", 4))


def relevance_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("none")


def filter_records(records: DataFrame, query: str = "", least_score: float | None = None, equals: dict | None = None, any_of: dict | None = None, text: str = "search_text", score: str = "score") -> DataFrame:
    """AND of a substring, a floor of the score, equal values, and overlap with any of some values (array columns)."""
    test = F.lit(True)
    if query:
        test = test & F.contains(F.lower(text), F.lit(query.lower().strip()))
    if least_score is not None:
        test = test & (F.coalesce(score, F.lit(0)) >= least_score)
    for c, v in (equals or {}).items():
        test = test & (F.col(c) == v)
    for c, v in (any_of or {}).items():
        test = test & F.arrays_overlap(c, F.array(*map(F.lit, v)))
    return records.filter(test)


def sort_records(records: DataFrame, mode: str, score: str = "score", year: str = "year", title: str = "title", source: str = "source", key: str = "id") -> DataFrame:
    """Six orders; the two descending ones turn the whole key round, titles included. `key` breaks ties."""
    low = F.lower(title)
    orders = {
        "relevance_desc": [F.col(score).desc(), F.col(year).desc(), low.desc(), F.col(key).desc()],
        "relevance_asc": [F.col(score), F.col(year), low, F.col(key)],
        "year_desc": [F.col(year).desc(), F.col(score).desc(), low.desc(), F.col(key).desc()],
        "year_asc": [F.col(year), F.col(score), low, F.col(key)],
        "title": [low, F.col(year), F.col(key)],
        "source": [F.lower(source), low, F.col(key)],
    }
    return records.orderBy(*orders[mode])


def page(records: DataFrame, offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    """A page of ordered records; the limit is held between 1 and `most`."""
    return records.offset(max(0, offset)).limit(min(max(1, limit), most))


def facets(records: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, count) of all records, in one pass; missing values count as empty text."""
    values = F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])
    return records.select(F.explode(values).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("count"))


def buckets(records: DataFrame, value: Column, limit: int = 12, by_key: bool = False) -> DataFrame:
    """The most frequent values (or the greatest, by_key) with their counts."""
    counted = records.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("count")).filter("value IS NOT NULL AND value != ''")
    return counted.orderBy(F.col("value").desc() if by_key else F.col("count").desc(), "value").limit(limit)


def modal_labels(records: DataFrame, key: str, label: str, limit: int = 30) -> DataFrame:
    """For each key its count and its most frequent label; the longer, then the smaller one wins ties."""
    counted = records.groupBy(key, label).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy(F.col("_n").desc(), F.length(label).desc(), F.col(label))
    ranked = counted.withColumn("_rank", F.row_number().over(order)).withColumn("count", F.sum("_n").over(Window.partitionBy(key)))
    return ranked.filter("_rank = 1").select(key, label, "count").orderBy(F.col("count").desc(), key).limit(limit)
