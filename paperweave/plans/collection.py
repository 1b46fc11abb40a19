"""Composites over a collection of papers: topics, evolution, structure and people, each as a few tables.

A collection is two tables: papers (id, year, title) and features (id, term,
weight), with links (source, target) and members (paper, person).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graphs, pairs, papers, series, vectors
from ..storage import durable, table

#: Edges that join papers of a topic, topics at most, and terms that name a topic (fixed values).
CLUSTER, TOPICS, NAMES = 0.22, 12, 3

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@dataclass
class TopicMap:
    """assignments (id, topic, cosine), topics (topic, size, name, representative), links (a, b, score)."""

    assignments: DataFrame
    topics: DataFrame
    links: DataFrame


def topic_map(features: DataFrame, links: DataFrame | None = None, edge: float = CLUSTER, most: int = TOPICS) -> TopicMap:
    """Topics are components of the similarity graph, to which citations (links) add; the largest `most` stay, single papers are unassigned, the rest is `other`.

    A topic's id is a digest of its least member, its name its heaviest terms,
    its representative the paper nearest to the centroid.
    """
    vec = durable(vectors.tfidf(features, "id"))
    near = durable(vectors.similarity(vec, "id", links=links))
    parts = graphs.components(near.filter(F.col("score") >= edge).select(F.col("a").alias("source"), F.col("b").alias("target")))
    ids = features.select("id").distinct().join(parts, "id", "left")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.col("size").desc(), "component").limit(most).withColumn("_kept", F.lit(True))
    named = F.when(F.col("component").isNull(), "unassigned").when(F.col("_kept"), F.concat(F.lit("topic-"), F.substring(F.sha1(F.col("component").cast("string")), 1, 12))).otherwise("other")
    assigned = durable(ids.join(F.broadcast(sizes), "component", "left").select("id", named.alias("topic")))
    centers = durable(vectors.centroids(vec, assigned, "id", "topic"))
    cosine = vectors.cosine_to_centroid(vec, centers, assigned, "id", "topic")
    out = durable(assigned.join(cosine, ["id", "topic"], "left").select("id", "topic", F.coalesce("cosine", F.lit(0.0)).alias("cosine")))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.round("w", 6).desc(), "term"))
    names = centers.withColumn("_r", rank).filter(F.col("_r") <= NAMES).groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), " / ").alias("name"))
    topics = out.groupBy("topic").agg(F.count("*").alias("size"), F.round(F.avg("cosine"), 4).alias("cohesion"), F.min_by("id", F.struct(-F.col("cosine"), "id")).alias("representative")).join(names, "topic", "left")
    return TopicMap(out, topics, near)


def topic_links(topics: TopicMap, least: float = 0.04, per_topic: int = 3) -> DataFrame:
    """(a, b, score): how alike topics are by the links between their papers, the best few of each."""
    at = topics.assignments.select("id", "topic")
    joined = topics.links.join(at.select(F.col("id").alias("a"), F.col("topic").alias("ta")), "a").join(at.select(F.col("id").alias("b"), F.col("topic").alias("tb")), "b").filter("ta != tb")
    mean = joined.groupBy(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.round(F.avg("score"), 4).alias("score")).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))
    return mean.withColumn("_r", rank).filter(F.col("_r") <= per_topic).drop("_r")


def evolution(topics: TopicMap, years: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Yearly series of the topics, their growth and turning points, states of the citations, and key papers."""
    rows = topics.assignments.join(years, "id").filter("year IS NOT NULL")
    yearly = series.dense_series(rows.withColumnRenamed("cosine", "score"), "topic", "year", "id", "score")
    counted = rows.groupBy("topic", "year").agg(F.count("*").alias("count"))
    states = papers.classify_citations(links, years)
    cited = states.filter("state = 'valid'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("cited"))
    most = cited.agg(F.max("cited").alias("_most"))
    reps = topics.topics.select(F.col("representative").alias("id"), F.lit(True).alias("_rep")).distinct()
    all_ = topics.assignments.join(cited, "id", "left").join(reps, "id", "left").join(F.broadcast(most))
    key = papers.key_score(F.coalesce("cited", F.lit(0)), F.coalesce("_most", F.lit(0)), F.col("cosine"), F.lit(0.5), F.coalesce("_rep", F.lit(False)))
    return {"series": yearly, "growth": series.growth(counted, "topic", "year"), "turning_points": papers.turning_points(yearly, "topic", "year"), "citations": states, "key_papers": all_.select("id", "topic", key.alias("key"))}


def network(topics: TopicMap, features: DataFrame, links: DataFrame, cap: int | None = None, sources: int = 48) -> dict[str, DataFrame]:
    """Co-citation, coupling, keyword links, and core and bridge papers."""
    cocited = durable(pairs.shared_pairs(links, "source", "target", cap))
    coupled = durable(pairs.shared_pairs(links, "target", "source", cap))
    both = cocited.unionByName(coupled)
    strength = both.select(F.explode(F.array("a", "b")).alias("id"), "shared").groupBy("id").agg(F.sum("shared").alias("strength"))
    terms = pairs.top_per_document(features, "id", "term", "weight", 12)
    between = graphs.betweenness(links, sources)
    return {"cocitation": cocited, "coupling": coupled, "keywords": pairs.term_network(terms, "id", "term"), "papers": papers.paper_metrics(links, strength, topics.assignments.select("id", "topic"), between)}


def research_network(metrics: DataFrame, members: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """Who works with whom, what each contributed, and what to read next. members (paper, person), facts (paper, person, year, cited, topic).

    Links and partners are those of all members of a paper and of all pairs: the
    limits of the report (40 members, 600 pairs) do not hold here.
    """
    near = papers.partners(members, "paper", "person")
    return {"links": papers.collaboration(members, "paper", "person", cap=None, limit=None), "people": papers.entity_metrics(facts, "person", "paper", "year", "cited", "topic", near), "reading": papers.recommendations(metrics)}


# parts as papers, their words as features, orders as people

def _collection(spark, d):
    """Parts as papers: their brand and type as one strong term, the words of their name as weak ones; each cites the part before it of its brand and type."""
    part = table(spark, d, "part")
    strong = F.concat_ws("-", "p_brand", "p_type")
    words = F.concat(F.array(strong, strong), F.split(F.lower("p_name"), " "))
    features = durable(part.select(F.col("p_partkey").alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("weight")))
    years = part.select(F.col("p_partkey").alias("id"), (1990 + F.col("p_size")).cast("int").alias("year"))
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    links = part.select(F.col("p_partkey").alias("source"), before.alias("target")).filter("target IS NOT NULL")
    return features, years, durable(links)


@query()
def topic_map_topics(spark, d):
    features, _, links = _collection(spark, d)
    return topic_map(features, links).topics


@query()
def topic_map_assignments(spark, d):
    features, _, links = _collection(spark, d)
    return topic_map(features, links).assignments


@query()
def topic_map_links(spark, d):
    features, _, links = _collection(spark, d)
    return topic_links(topic_map(features, links))


@query()
def evolution_key_papers(spark, d):
    features, years, links = _collection(spark, d)
    return evolution(topic_map(features, links), years, links)["key_papers"]


@query()
def network_papers(spark, d):
    features, _, links = _collection(spark, d)
    return network(topic_map(features, links), features, links)["papers"]
