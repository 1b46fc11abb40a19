"""De-duplication by keys with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: Column | str, *order: Column) -> DataFrame:
    """The first row of each key by the order; rows whose key is null are all kept."""
    key = F.col(key) if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return rows.withColumn("_key", key).withColumn("_rank", rank).filter("_rank = 1 OR _key IS NULL").drop("_key", "_rank")


def last_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    return first_per_key(rows, key, F.col(ordinal).desc())


def copy_groups(rows: DataFrame, digest: Column, id_: str) -> DataFrame:
    """Each row's group of equal content: the least id and the size."""
    named = rows.withColumn("_d", digest)
    groups = named.groupBy("_d").agg(F.min(id_).alias("first_id"), F.count("*").alias("copies"))
    return named.join(groups, "_d").drop("_d")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def merge_by_precedence(rows: DataFrame, key: list[str], rank: str, ordinal: str) -> DataFrame:
    """Of each key the row of highest rank; of equal rank the later one."""
    w = Window.partitionBy(*key).orderBy(F.col(rank).desc(), F.col(ordinal).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
