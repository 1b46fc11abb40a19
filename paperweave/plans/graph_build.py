"""Graphs of papers: nodes, edges and evidence from metadata, layout elements and statements in the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import extract
from ..storage import durable, table
from .statement_queries import papers

#: Kinds of nodes made of a record's fields, and their relations to the paper (fixed values).
LISTS = (("keywords", "keyword", "has_keyword"), ("authors", "author", "written_by"))
SINGLE = (("journal", "journal", "published_in"), ("year", "year", "published_in_year"))
#: Keywords and authors of a record at most (fixed values of the flat graph).
MOST = {"keywords": 20, "authors": 50}
#: Kinds of layout elements that become nodes (fixed values).
ELEMENTS = ("figure", "table", "formula")

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@dataclass
class Graph:
    """nodes (record, id, type, label), edges (record, source, target, type, confidence), evidence (record, node, section, block_id, sentence, text, confidence)."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame | None = None


def _key(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def flat_graph(records: DataFrame, elements: DataFrame | None = None) -> Graph:
    """A star per record: its keywords, authors, journal, year, abstract and layout elements around the paper.

    records (record, title, keywords, authors, journal, year, abstract), elements
    (record, kind, id, caption). Values of a record that differ in case or spaces
    only are one node, labelled as the first of them; blank ones are none. A null
    title is Untitled; elements without a caption are numbered by kind.
    """
    record = F.col("record").cast("string")
    paper = F.concat(F.lit("paper:"), record)
    made = []
    for column, kind, relation in LISTS:
        values = F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")
        said = records.select("record", F.posexplode(values).alias("at", "label")).withColumn("key", _key(F.col("label")))
        first = said.groupBy("record", "key").agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"))
        kept = first.groupBy("record").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "key", "label"))), 1, MOST[column]).alias("v")).select("record", F.explode("v").alias("v"))
        made.append(kept.select("record", F.lit(kind).alias("type"), F.col("v.key").alias("key"), F.col("v.label").alias("label"), F.lit(relation).alias("relation")))
    for column, kind, relation in SINGLE:
        value = F.trim(F.col(column).cast("string"))
        made.append(records.filter(F.coalesce(value, F.lit("")) != "").select("record", F.lit(kind).alias("type"), _key(value).alias("key"), value.alias("label"), F.lit(relation).alias("relation")))
    made.append(records.filter(F.trim(F.coalesce("abstract", F.lit(""))) != "").select("record", F.lit("abstract").alias("type"), _key(record).alias("key"), F.lit("Abstract").alias("label"), F.lit("has_abstract").alias("relation")))
    if elements is not None:
        from pyspark.sql import Window

        kind = F.lower("kind")
        number = F.row_number().over(Window.partitionBy("record", "kind").orderBy("id")).cast("string")
        listed = elements.filter(kind.isin(*ELEMENTS)).withColumn("kind", kind)
        label = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.concat(F.initcap("kind"), F.lit(" "), number))
        made.append(listed.select("record", F.col("kind").alias("type"), _key(F.concat_ws(":", record, F.col("id").cast("string"))).alias("key"), label.alias("label"), F.concat(F.lit("has_"), F.col("kind")).alias("relation")))
    around = made[0]
    for m in made[1:]:
        around = around.unionByName(m)
    around = durable(around.withColumn("id", F.concat_ws(":", "type", "key")))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    nodes = records.select("record", paper.alias("id"), F.lit("paper").alias("type"), title.alias("label")).unionByName(around.select("record", "id", "type", "label"))
    edges = around.select("record", paper.alias("source"), F.col("id").alias("target"), F.col("relation").alias("type"), F.lit(1.0).alias("confidence"))
    return Graph(nodes, edges)


def build_graph(records: DataFrame, blocks: DataFrame, elements: DataFrame | None = None) -> Graph:
    """The graph of each record: the flat one, sections of its text, and the entities of its statements with their relations and evidence.

    blocks as `extract.sections` takes them; records' abstracts count as blocks
    of metadata. elements (record, kind, id, caption, and page, text and
    confidence where known) are entities too. Duplicate ids of a record become
    one node; edges to ids that are no nodes cannot arise.
    """
    flat = flat_graph(records, elements)
    if elements is not None:
        others = {"page": F.lit(0), "text": F.lit(None).cast("string"), "confidence": F.lit(1.0)}
        elements = elements.withColumns({c: v for c, v in others.items() if c not in elements.columns})
    metadata = records.select("record", "abstract", F.lit(None).cast("string").alias("summary"))
    found = durable(extract.with_nodes(extract.mentions(blocks, metadata, elements)))
    entities = durable(extract.entities(found))
    paper = F.concat(F.lit("paper:"), F.col("record").cast("string"))
    section = F.concat_ws(":", F.lit("section"), F.col("record").cast("string"), "section")
    parts = extract.sections(blocks).filter("section IS NOT NULL").select("record", "section").distinct()
    nodes = flat.nodes.unionByName(parts.select("record", section.alias("id"), F.lit("section").alias("type"), F.col("section").alias("label")))
    nodes = nodes.unionByName(entities.select("record", F.col("node").alias("id"), F.col("kind").alias("type"), "label")).dropDuplicates(["record", "id"])
    edges = flat.edges.unionByName(parts.select("record", paper.alias("source"), section.alias("target"), F.lit("HAS_SECTION").alias("type"), F.lit(1.0).alias("confidence")))
    said = extract.root_relations(found, entities).unionByName(extract.pair_relations(found, entities))
    edges = edges.unionByName(said.select("record", "source", "target", "type", "confidence")).distinct()
    evidence = found.select("record", "node", "section", "block_id", "sentence", "text", "confidence")
    return Graph(nodes, edges, evidence)


# parts as papers

def _records(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("record"),
        F.col("p_name").alias("title"),
        F.concat(words, F.array("p_type"), words).alias("keywords"),
        F.array("p_brand").alias("authors"),
        F.concat_ws(" ", F.lit("Journal of"), "p_type").alias("journal"),
        (1990 + F.col("p_size")).alias("year"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("abstract"),
    )


_STAR = """s AS (SELECT p_partkey AS record, 'keyword' AS type, lower(k) AS key, 'has_keyword' AS relation FROM (SELECT p_partkey, unnest(list_concat(string_split(p_name, ' '), [p_type])) AS k FROM part) WHERE trim(k) <> '' GROUP BY ALL
UNION ALL SELECT p_partkey, 'author', lower(p_brand), 'written_by' FROM part UNION ALL SELECT p_partkey, 'journal', lower('Journal of ' || p_type), 'published_in' FROM part
UNION ALL SELECT p_partkey, 'year', CAST(1990 + p_size AS VARCHAR), 'published_in_year' FROM part UNION ALL SELECT p_partkey, 'abstract', CAST(p_partkey AS VARCHAR), 'has_abstract' FROM part WHERE p_size % 2 = 0)"""


@query(f"WITH {_STAR} SELECT record, 'paper:' || record AS source, type || ':' || key AS target, relation AS type, 1.0::DOUBLE AS confidence FROM s")
def flat_graph_edges(spark, d):
    return flat_graph(_records(spark, d)).edges


@query(f"WITH {_STAR} SELECT type, count(*) AS nodes, count(DISTINCT id) AS ids FROM (SELECT type, type || ':' || key AS id FROM s UNION ALL SELECT 'paper', 'paper:' || p_partkey FROM part) GROUP BY 1")
def flat_graph_nodes(spark, d):
    return flat_graph(_records(spark, d)).nodes.groupBy("type").agg(F.count("*").alias("nodes"), F.countDistinct("id").alias("ids"))


@query()
def built_graph(spark, d):
    """All nodes, edges and evidence of the parts' graphs, as counts by kind."""
    g = build_graph(_records(spark, d), papers(spark, d))
    count = lambda df, what, kind: df.groupBy(F.lit(what).alias("what"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("record").alias("records"))
    return count(g.nodes, "node", "type").unionByName(count(g.edges, "edge", "type")).unionByName(count(g.evidence, "evidence", "section"))
