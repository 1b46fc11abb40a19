"""Report queries over the driver's tables: counts, sizes, warnings, captions, orders and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import elements, lookup, papers, records, segments
from ..sources import mappings
from ..storage import durable, table
from ..streaming import changes
from .collection import research_network

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT o_custkey AS tenant, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def tenant_counts(spark, d):
    return records.tenant_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT c_custkey AS tenant, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS bytes, count(o_orderkey) AS files FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def quota_sums(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return records.quota(table(spark, d, "customer").select(F.col("c_custkey").alias("tenant")), files)


@query("SELECT coalesce(l_returnflag, 'unknown') AS reason, count(*) AS count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def size_by_reason(spark, d):
    return elements.size_by_reason(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("reason"), F.col("l_quantity").cast("long").alias("bytes")))


@query("""WITH w AS (SELECT doc_id AS sid, text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS words FROM documents)
SELECT sid, CAST(sid AS VARCHAR) || ': possible untranslated English remains: ' || left(trim(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '\\s+', ' ', 'g')), 90) AS warning FROM w WHERE len(words) >= 5""")
def warning_report(spark, d):
    """Documents as segments whose translation is the text itself."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("sid"), F.coalesce("text", F.lit("")).alias("text"))
    return segments.warning_report(s.withColumn("result", F.col("text")).withColumn("translate", F.lit(True)))


@query("SELECT l_orderkey AS doc, l_linenumber AS id, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity % 3, l_partkey % 5, l_suppkey % 4, CASE WHEN l_tax < 0.04 THEN 1 ELSE 2 END, l_linenumber, l_partkey) AS INTEGER) AS place FROM lineitem")
def reading_order(spark, d):
    box = F.array((F.col("l_suppkey") % 4).cast("double"), (F.col("l_partkey") % 5).cast("double"))
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_quantity") % 3).alias("page"), F.struct(F.col("l_linenumber"), F.col("l_partkey")).alias("id"), F.when(F.col("l_tax") < 0.04, "table").otherwise("figure").alias("kind"), box.alias("box"))
    return elements.reading_order(e, ["table", "figure"]).select("doc", F.col("id.l_linenumber").alias("id"), F.col("id.l_partkey").alias("l_partkey"), "place")


@query("""WITH l AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, event_id, event_type FROM l WHERE event_type <> 'error' ORDER BY event_id DESC, user_id DESC LIMIT 50""")
def annotation_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("action"))
    return changes.fold_annotations(e, "user_id", "event_id", "action", 50).select("user_id", "event_id", "event_type")


_REFS = """r AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'doc:' || (item_id * 7) ELSE '' END AS identifier, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS title FROM benchmark),
p AS (SELECT doc_id, 'doc:' || doc_id AS alias, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS title FROM documents)"""


@query(f"""WITH {_REFS}, a AS (SELECT item_id, min(doc_id) AS t FROM r JOIN p ON identifier = alias GROUP BY 1), e AS (SELECT item_id, min(doc_id) AS t FROM r JOIN p ON r.title = p.title WHERE r.title <> '' GROUP BY 1),
c AS (SELECT item_id, min(doc_id) AS t FROM r JOIN p ON contains(p.title, r.title) OR contains(r.title, p.title) WHERE length(r.title) >= 16 AND p.title <> '' GROUP BY 1 HAVING count(DISTINCT p.title) = 1)
SELECT item_id, coalesce(a.t, e.t, c.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'alias' WHEN e.t IS NOT NULL THEN 'title' WHEN c.t IS NOT NULL THEN 'containment' ELSE 'none' END AS tier FROM r LEFT JOIN a USING (item_id) LEFT JOIN e USING (item_id) LEFT JOIN c USING (item_id)""")
def resolved_references(spark, d):
    """Benchmark passages as references, whole documents as titles."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    refs = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("doc:"), (F.col("item_id") * 7).cast("string"))).otherwise("").alias("identifier"), plain("text").alias("title"))
    known = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("aliases"), plain("text").alias("title"))
    return lookup.resolve_references(refs, known, "item_id")


@query()
def research_people(spark, d):
    """Suppliers as people, orders as papers: people's scores of a research network."""
    items = table(spark, d, "lineitem")
    members = durable(items.select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("person")).distinct())
    facts = items.select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("person"), F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("cited"), F.col("l_returnflag").alias("topic"))
    links = items.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).filter("source != target").distinct()
    topics = links.select(F.col("source").alias("id")).union(links.select("target")).distinct().select("id", (F.col("id") % 5).alias("topic"))
    metrics = papers.paper_metrics(links, topics.select("id", F.lit(0).alias("strength")), topics)
    return research_network(metrics, members, facts)["people"]


@query("SELECT p_partkey, translate(replace(replace(p_name || ' ﬁ Ａ１－' || p_type, 'ﬁ', 'fi'), 'Ａ１－', 'A1-'), '—', '-') AS folded, 'alpha-' || p_size AS greek FROM part")
def folded_text(spark, d):
    return table(spark, d, "part").select("p_partkey", text.fold(F.concat("p_name", F.lit(" ﬁ Ａ１－"), "p_type")).alias("folded"), text.fold(F.concat(F.lit("α—"), F.col("p_size").cast("string"))).alias("greek"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-01-01') END AS day FROM orders")
def date_parts(spark, d):
    day = F.col("o_orderdate")
    parts = F.slice(F.array(F.year(day), F.month(day), F.dayofmonth(day)), 1, (3 - F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", ids.date_from_parts(parts).cast("string").alias("day"))


@query("""SELECT CASE p_size % 3 WHEN 0 THEN 'europepmc:MED:' || p_partkey WHEN 1 THEN 'crossref:10.5/p' || p_partkey ELSE 'doaj:d' || p_partkey END AS id, CASE WHEN p_size % 3 < 2 OR p_size % 2 = 0 THEN '10.5/P' || p_partkey END AS doi,
  p_name || ' H₂O & ' || p_size || '%' AS title, CASE p_size % 3 WHEN 0 THEN (1970 + p_size) || '-01-01' WHEN 1 THEN (1970 + p_size) || '-03-01' ELSE (1970 + p_size) || '-07-01' END AS publication_date, CAST(1970 + p_size AS VARCHAR) AS publication_year,
  CASE p_size % 3 WHEN 2 THEN NULL ELSE CAST(p_size AS INTEGER) END AS cited_by_count, CASE WHEN p_size % 3 > 0 THEN p_type END AS journal, CASE WHEN p_size % 3 > 0 THEN '1234-567X' END AS issn_l, p_brand AS author,
  CASE p_size % 3 WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN p_partkey % 5 = 0 ELSE true END AS is_oa FROM part""")
def captured_records(spark, d):
    """Parts as result pages of three services, mapped to one shape."""
    title = "concat(p_name, ' H<sub>2</sub>O &amp; ', p_size, ' %')"
    europe = f"named_struct('resultList', named_struct('result', array(named_struct('id', CAST(p_partkey AS STRING), 'source', 'MED', 'doi', concat('10.5/P', p_partkey), 'title', {title}, 'pubYear', CAST(1970 + p_size AS STRING), 'citedByCount', p_size, 'isOpenAccess', IF(p_partkey % 2 = 0, 'Y', 'N'), 'authorList', named_struct('author', array(named_struct('fullName', p_brand)))))))"
    dated = "named_struct('date-parts', array(array(1970 + p_size, 3)))"
    crossref = f"named_struct('message', named_struct('items', array(named_struct('DOI', concat('10.5/P', p_partkey), 'title', array({title}), 'issued', {dated}, 'is-referenced-by-count', p_size, 'container-title', p_type, 'ISSN', array('1234567x'), 'author', array(named_struct('name', p_brand)), 'license', array(named_struct('URL', IF(p_partkey % 5 = 0, 'https://creativecommons.org/by', 'https://x.org')))))))"
    doaj = f"named_struct('results', array(named_struct('id', concat('d', p_partkey), 'bibjson', named_struct('title', {title}, 'year', CAST(1970 + p_size AS STRING), 'month', 7, 'author', array(named_struct('name', p_brand)), 'journal', named_struct('title', p_type, 'issn', '1234567X'), 'identifier', IF(p_size % 2 = 0, array(named_struct('type', 'doi', 'id', concat('10.5/P', p_partkey))), array())))))"
    pages = table(spark, d, "part").selectExpr("element_at(array('europe_pmc', 'crossref', 'doaj'), CAST(p_size % 3 + 1 AS INT)) AS source", f"CASE p_size % 3 WHEN 0 THEN to_json({europe}) WHEN 1 THEN to_json({crossref}) ELSE to_json({doaj}) END AS body")
    hits = mappings.captured_hits(pages)
    venue = F.col("primary_location.source")
    return hits.select("id", "doi", "title", "publication_date", "publication_year", "cited_by_count", venue["display_name"].alias("journal"), venue["issn_l"].alias("issn_l"), F.col("authorships")[0]["author"]["display_name"].alias("author"), F.col("open_access.is_oa").alias("is_oa"))
