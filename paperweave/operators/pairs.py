"""Pairs that share a neighbour: co-citation, coupling, collaboration, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import packed

#: Items of a group that meet in one piece; a larger group is cut into blocks of about so many.
BLOCK = 1000


def capped(links: DataFrame, group: str, item: str, cap: int) -> DataFrame:
    """The first `cap` items of each group, in item order; Spark keeps so many before its shuffle."""
    order = Window.partitionBy(group).orderBy(item)
    return links.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows by a key over all tasks of a shuffle: a grouping that has the key needs no other one.

    Pairs seldom repeat, so a table of them before the shuffle would hold each
    task's pairs and save nothing; and few bytes of memberships make many pairs,
    so tasks are not to be joined by their bytes.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def blocks(links: DataFrame, group: str, item: str) -> DataFrame:
    """The links with the cells (_x, _y) that they meet in and the block (_own) they are of.

    A group of over BLOCK items is cut by a hash of the items, and its blocks meet
    two by two, each pair of them in a cell: no task holds a whole group, and two
    items meet in one cell if their blocks differ, in (_own, _own) if not.
    """
    # a row of these stands for half a million pairs, so they are few in any job that ends
    large = links.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).filter("_blocks > 1")
    count = F.coalesce("_blocks", F.lit(1))
    own = links.join(F.broadcast(large), group, "left").select(group, item, F.pmod(F.xxhash64(item), count).cast("int").alias("_own"), count.alias("_blocks"))
    met = own.select(group, item, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_met"))
    return met.select(group, item, "_own", F.least("_own", "_met").alias("_x"), F.greatest("_own", "_met").alias("_y"))


def meetings(links: DataFrame, group: str, item: str) -> DataFrame:
    """(group, a, b): items that meet in a group, once for each group that has both; groups are whole, whatever their size."""
    kept = blocks(links.select(group, item).dropna().distinct(), group, item)
    cell = [group, "_x", "_y"]
    kept = dealt(kept, *cell)
    met = kept.alias("l").join(kept.alias("r"), cell).filter(F.col(f"l.{item}") < F.col(f"r.{item}")).filter("_x = _y OR l._own <> r._own")
    return met.select(group, F.col(f"l.{item}").alias("a"), F.col(f"r.{item}").alias("b"))


def truncated(links: DataFrame, group: str, cap: int) -> DataFrame:
    """One row: how many groups and items a cap leaves out."""
    over = links.groupBy(group).count().select(F.greatest(F.col("count") - cap, F.lit(0)).alias("over"))
    return over.agg(F.count_if(F.col("over") > 0).alias("groups_truncated"), F.coalesce(F.sum("over"), F.lit(0)).alias("items_left_out"))


def shared_pairs(links: DataFrame, group: str, item: str, cap: int | None = None) -> DataFrame:
    """(a, b, shared, score): items that meet in a group, and their Jaccard over the uncapped memberships.

    Groups are whole, whatever their size. Only a result that is defined by a fan-out takes the first `cap` items of each.
    """
    if cap is not None and isinstance(links.schema[item].dataType, IntegralType):
        return _packed_pairs(links, group, item, cap)
    links = links.select(group, item).distinct()
    degree = links.groupBy(item).agg(F.count("*").alias("_n"))
    if cap is None:
        kept, cell = blocks(links.filter(F.col(group).isNotNull() & F.col(item).isNotNull()), group, item), [group, "_x", "_y"]
    else:
        # nulls come last in the order of the SQL, so they take no place of the first
        kept, cell = capped(links.filter(F.col(item).isNotNull()), group, item, cap), [group]
    # degrees come to the few memberships, not to the many pairs
    kept = dealt(kept.join(degree, item), *cell)
    met = kept.alias("l").join(kept.alias("r"), cell).filter(F.col(f"l.{item}") < F.col(f"r.{item}"))
    if cap is None:
        met = met.filter("_x = _y OR l._own <> r._own")
    pairs = dealt(met.select(F.col(f"l.{item}").alias("a"), F.col(f"r.{item}").alias("b"), F.col("l._n").alias("na"), F.col("r._n").alias("nb")), "a")
    score = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4)
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).select("a", "b", "shared", score.alias("score"))


def _packed_pairs(links: DataFrame, group: str, item: str, cap: int) -> DataFrame:
    """shared_pairs of whole numbers in groups of up to `cap` items.

    Memberships are dealt twice, by item for the degrees and by group for the
    lists. An item then sends the rest of its group's list as bytes, so what is
    shuffled and held is a few bytes a pair, and pairs become rows only when they
    are counted.
    """
    kind = links.schema[item].dataType
    known = dealt(links.select(group, item).filter(F.col(item).isNotNull()), item).distinct()
    known = known.withColumn("_n", F.count("*").over(Window.partitionBy(item))).filter(F.col(group).isNotNull())
    lists = capped(known, group, item, cap).groupBy(group).agg(packed.lists_of(F.col(item), F.col("_n")).alias("_l")).filter(F.size("_l") > 1)
    rows = dealt(packed.tails(lists.select(F.col("_l.i").alias("items"), F.col("_l.n").alias("degrees"))), "a", "lane")
    found = packed.counted(rows.groupBy("a", "na", "lane").agg(F.collect_list("tail").alias("tails")).select("a", "na", "tails"))
    score = F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4)
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared", score.alias("score"))


def top_per_document(terms: DataFrame, doc: str, term: str, weight: str, k: int) -> DataFrame:
    order = Window.partitionBy(doc).orderBy(F.col(weight).desc(), F.col(term))
    return terms.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


def term_network(terms: DataFrame, doc: str, term: str, max_nodes: int = 120, max_links: int = 480) -> DataFrame:
    """(a, b, count, jaccard, pmi) between the most frequent terms, the strongest links first."""
    n = terms.select(doc).distinct().agg(F.count("*").alias("docs"))
    df = terms.groupBy(term).agg(F.countDistinct(doc).alias("df")).orderBy(F.col("df").desc(), term).limit(max_nodes)
    kept = terms.select(doc, term).distinct().join(F.broadcast(df), term)
    a = kept.select(doc, F.col(term).alias("a"), F.col("df").alias("df_a"))
    b = kept.select(doc, F.col(term).alias("b"), F.col("df").alias("df_b"))
    pairs = a.join(b, doc).filter("a < b").groupBy("a", "b", "df_a", "df_b").agg(F.count("*").alias("count"))
    scored = pairs.join(F.broadcast(n)).select(
        "a",
        "b",
        "count",
        F.round(F.col("count") / (F.col("df_a") + F.col("df_b") - F.col("count")), 4).alias("jaccard"),
        F.round(F.log2(F.col("count") * F.col("docs") / (F.col("df_a") * F.col("df_b"))), 4).alias("pmi"),
    )
    return scored.orderBy(F.col("count").desc(), F.col("jaccard").desc(), "a", "b").limit(max_links)
