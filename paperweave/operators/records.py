"""Rows of records and graphs for display and bookkeeping: states, facts, timelines, layouts, uploads, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges that give a paper's facets (fixed values).
FACET_EDGES = {"AUTHOR_OF": "author", "PUBLISHED_IN": "venue", "HAS_TOPIC": "topic"}


def collection_counts(collections: DataFrame, favorites: DataFrame) -> DataFrame:
    """collections (collection_id, name) with their number of records; empty ones have 0."""
    n = favorites.groupBy("collection_id").agg(F.countDistinct("record_id").alias("records"))
    return collections.join(n, "collection_id", "left").fillna(0, ["records"])


def favorites_from_log(log: DataFrame) -> DataFrame:
    """(record_id, collection_id) after a log of add and remove (record_id, collection_id, at, action): the last action counts."""
    last = log.groupBy("record_id", "collection_id").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return last.filter("action = 'add'").select("record_id", "collection_id")


def paper_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, facet, value): labels of the neighbours of papers by the edge's type, and institutions over authors."""
    papers, labels = nodes.filter("type = 'paper'").select("id"), nodes.select(F.col("id").alias("n"), "label")
    either = edges.select("type", "source", "target").union(edges.select("type", F.col("target"), F.col("source"))).toDF("type", "id", "n")
    facet = F.element_at(F.create_map(*[F.lit(x) for kv in FACET_EDGES.items() for x in kv]), F.col("type"))
    near = either.join(papers, "id", "left_semi").withColumn("facet", facet).filter("facet IS NOT NULL")
    direct = near.join(labels, "n").select("id", "facet", F.col("label").alias("value"))
    at = either.filter("type = 'AFFILIATED_WITH'").select(F.col("id").alias("n"), F.col("n").alias("inst"))
    indirect = near.filter("facet = 'author'").select("id", "n").join(at, "n").join(labels.select(F.col("n").alias("inst"), "label"), "inst").select("id", F.lit("institution").alias("facet"), F.col("label").alias("value"))
    return direct.union(indirect).distinct()


def literature_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Papers with the citations that they get and give; sorted by importance, then label."""
    cites = edges.filter("type = 'CITES'")
    got, given = cites.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("cited")), cites.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("citing"))
    rows = nodes.filter("type IN ('paper', 'citation')").join(got, "id", "left").join(given, "id", "left").fillna(0, ["cited", "citing"])
    return rows.orderBy(F.coalesce("importance", F.lit(0.0)).desc(), "label", "id")


def timeline(series: DataFrame, year: str, start: int, end: int, at: int) -> DataFrame:
    """The series within the years that it has of start to end, with `playing`: the rows of the year nearest to `at`, the earlier on ties."""
    part = series.filter(F.col(year).between(min(start, end), max(start, end)))
    near = part.agg(F.min_by(year, F.struct(F.abs(F.col(year) - at), F.col(year))).alias("_near"))
    return part.join(F.broadcast(near)).withColumn("playing", F.col(year) == F.col("_near")).drop("_near")


def replay_events(evidence: DataFrame) -> DataFrame:
    """evidence (record, page, element, excerpt, top, left, node) as events in reading order, with the nodes that each shows."""
    grouped = evidence.groupBy("record", "page", "element", "excerpt").agg(F.min("top").alias("top"), F.min("left").alias("left"), F.countDistinct("node").alias("nodes"))
    return grouped.withColumn("index", F.row_number().over(Window.partitionBy("record").orderBy("page", "top", "left", "element", "excerpt")))


def seed_node(nodes: DataFrame, preferred: str | None = None) -> DataFrame:
    """One row: the preferred paper, else the first paper, else the node of most importance."""
    rank = F.when((F.col("type") == "paper") & F.col("id").eqNullSafe(F.lit(preferred)), 0).when(F.col("type") == "paper", 1).otherwise(2)
    order = F.struct(rank, F.when(rank == 2, -F.coalesce("importance", F.lit(0.0))).otherwise(0.0), "id")
    return nodes.agg(F.min_by("id", order).alias("id"))


def layered(nodes: DataFrame, columns: int = 8, width: float = 180.0, height: float = 120.0) -> DataFrame:
    """Nodes (id, layer, importance) with row, col, x and y: in each layer by importance, `columns` in a row."""
    rank = F.row_number().over(Window.partitionBy("layer").orderBy(F.coalesce("importance", F.lit(0.0)).desc(), "id")) - 1
    x = nodes.withColumn("_n", rank).withColumn("row", F.floor(F.col("_n") / columns).cast("int")).withColumn("col", (F.col("_n") % columns).cast("int"))
    return x.withColumn("x", F.col("col") * width).withColumn("y", F.col("layer") * height * 4 + F.col("row") * height).drop("_n")


def upload_state(chunks: DataFrame, upload: str, offset: str, size: str, expected: DataFrame) -> DataFrame:
    """(upload, bytes, gaps, complete): whether the chunks follow on each other from 0 and add up. expected (upload, total)."""
    end = F.col(offset) + F.col(size)
    w = Window.partitionBy(upload).orderBy(offset)
    follows = F.col(offset) == F.coalesce(F.lag(end).over(w), F.lit(0))
    got = chunks.withColumn("_ok", follows).groupBy(upload).agg(F.sum(size).alias("bytes"), F.count_if(~F.col("_ok")).alias("gaps"))
    return got.join(expected, upload, "left").withColumn("complete", F.coalesce((F.col("gaps") == 0) & (F.col("bytes") == F.col("total")), F.lit(False)))


def tenant_rows(tables: dict[str, DataFrame], column: str, tenant) -> DataFrame:
    """(table, row): every row of a tenant as JSON; the filter reaches each scan."""
    out = None
    for name, rows in tables.items():
        part = rows.filter(F.col(column) == tenant).select(F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def frequency_keywords(docs: DataFrame, id_: str, words: Column, top: int = 20) -> DataFrame:
    """(id, term, count): each document's most frequent words; the longer, then the smaller one first on ties."""
    counted = docs.select(id_, F.explode(words).alias("term")).groupBy(id_, "term").agg(F.count("*").alias("count"))
    order = Window.partitionBy(id_).orderBy(F.col("count").desc(), F.length("term").desc(), "term")
    return counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def tenant_counts(rows: DataFrame, tenant: str, status: str) -> DataFrame:
    """(tenant, status, n)."""
    return rows.groupBy(F.col(tenant).alias("tenant"), F.col(status).alias("status")).agg(F.count("*").alias("n"))


def quota(tenants: DataFrame, files: DataFrame) -> DataFrame:
    """(tenant, bytes, files) of every tenant; one without files has 0. files (tenant, bytes)."""
    used = files.groupBy("tenant").agg(F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes"), F.count("*").alias("files"))
    return tenants.select("tenant").distinct().join(used, "tenant", "left").fillna(0, ["bytes", "files"])
