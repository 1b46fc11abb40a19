"""Library, relevance, lookup and de-duplication queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import compare, dedup, library, lookup, relevance
from ..operators.extract import group_candidates
from ..sources.readers import page_links
from ..storage import table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _records(spark, d):
    """documents as library records: title is the first line, score the label's quality and a length bonus, year from the id."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.get(F.split("text", "\n", 2), 0), F.lit("")).alias("title"),
        F.coalesce(ids.present(F.col("source")), F.lit("unknown")).alias("source"),
        F.coalesce(ids.present(F.col("lang")), F.lit("")).alias("lang"),
        (F.lit(2000) + F.pmod("doc_id", F.lit(25))).cast("int").alias("year"),
        (6 * F.coalesce("quality", F.lit(0)) + F.least(F.floor(F.col("n_chars") / 500), F.lit(8))).cast("int").alias("score"),
        "n_chars",
        F.col("quality").isNull().alias("unlabelled"),
    )


RECORDS = """records AS (
  SELECT d.doc_id AS id, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(nullif(trim(source), ''), 'unknown') AS source, coalesce(nullif(trim(lang), ''), '') AS lang,
    CAST(2000 + doc_id % 25 AS INTEGER) AS year, CAST(6 * coalesce(quality, 0) + least(floor(n_chars / 500), 8) AS INTEGER) AS score, n_chars, quality IS NULL AS unlabelled
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""


@query(f"WITH {RECORDS} SELECT id, title, source, lang, year, score, CASE WHEN score >= 12 THEN 'core' WHEN score >= 9 THEN 'high' WHEN score >= 6 THEN 'medium' WHEN score >= 4 THEN 'low' ELSE 'none' END AS level, lower(title || ' ' || source || ' ' || lang) AS search_text, unlabelled FROM records")
def library_projection(spark, d):
    r = _records(spark, d)
    return r.select("id", "title", "source", "lang", "year", "score", library.relevance_level(F.col("score")).alias("level"), text.search_document(F.col("title"), F.col("source"), F.col("lang")).alias("search_text"), "unlabelled")


@query(f"WITH {RECORDS} SELECT id, title, score FROM records WHERE score >= 6 AND lang = 'en' AND contains(lower(title), 'the')")
def library_filter(spark, d):
    r = _records(spark, d)
    return library.filter_records(r, query="The ", least_score=6, equals={"lang": "en"}, text="title").select("id", "title", "score")


def _sorted(mode: str):
    def f(spark, d):
        return library.page(library.sort_records(_records(spark, d), mode), 10, 50).select("id", "year", "score", "source")

    return f


_ORDERS = {
    "relevance_desc": "score DESC, year DESC, lower(title) DESC, id DESC",
    "relevance_asc": "score, year, lower(title), id",
    "year_desc": "year DESC, score DESC, lower(title) DESC, id DESC",
    "year_asc": "year, score, lower(title), id",
    "title": "lower(title), year, id",
    "source": "lower(source), lower(title), id",
}
for _mode, _order in _ORDERS.items():
    QUERIES[f"library_sort_{_mode}"] = (_sorted(_mode), f"WITH {RECORDS} SELECT id, year, score, source FROM records ORDER BY {_order} LIMIT 50 OFFSET 10")


@query(f"WITH {RECORDS}, f AS (SELECT unnest([{{'facet': 'source', 'value': source}}, {{'facet': 'lang', 'value': lang}}, {{'facet': 'year', 'value': CAST(year AS VARCHAR)}}]) AS f FROM records) SELECT f.facet AS facet, f.value AS value, count(*) AS count FROM f GROUP BY ALL")
def library_facets(spark, d):
    return library.facets(_records(spark, d), ["source", "lang", "year"])


@query("SELECT CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS count FROM orders WHERE o_orderpriority <> '' GROUP BY 1 ORDER BY count DESC, value LIMIT 12")
def statistics_buckets(spark, d):
    return library.buckets(table(spark, d, "orders"), F.col("o_orderpriority"))


@query("SELECT p_brand, p_type, count FROM (SELECT p_brand, p_type, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS count, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, length(p_type) DESC, p_type) AS r FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)) WHERE r = 1 ORDER BY count DESC, p_brand LIMIT 30")
def modal_label(spark, d):
    return library.modal_labels(table(spark, d, "part"), "p_brand", "p_type")


_STEM = "list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: CASE WHEN t = 'li' THEN 'lithium' WHEN t = 'na' THEN 'sodium' WHEN t = 's' THEN 'sulfur' WHEN length(t) >= 5 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END)"


@query(f"SELECT p_partkey, p_name, list_has_any([1], [1]) AND (contains(lower(p_name), 'red widgets') OR len(list_intersect(['red', 'widget'], {_STEM.format('p_name')})) >= 2) AS matched FROM part")
def keyword_match(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", text.keyword_match(F.lit("red widgets"), F.col("p_name")).alias("matched"))


_PHRASES = ["steel bolt", "blue widget", "small ring"]


@query(
    "SELECT p_partkey, greatest("
    + ", ".join(
        f"CASE WHEN contains(lower(p_name), '{p}') THEN 6 WHEN contains(lower(p_type), '{p}') THEN 4 ELSE 0 END + least(2 * len(list_intersect({p.split()}, {_STEM.format(chr(39) + chr(39) + ' || p_name || ' + chr(39) + ' ' + chr(39) + ' || p_type')})), 6)" for p in _PHRASES
    )
    + ") AS score FROM part"
)
def topic_score(spark, d):
    return table(spark, d, "part").select("p_partkey", relevance.topic_score(F.col("p_name"), F.col("p_type"), _PHRASES).alias("score"))


@query("SELECT d.doc_id, coalesce(quality >= 1, true) AS passes, coalesce(toxic = 1, false) AS flagged FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)")
def threshold_with_unknown(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    x = table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left")
    return x.select("doc_id", relevance.at_least(F.col("quality"), 1).alias("passes"), relevance.open_access(F.col("toxic") == 1).alias("flagged"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def allow_list(spark, d):
    wanted = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT user_id, kind, attempts, last, attempts < CASE kind WHEN 'transient' THEN 8 WHEN 'blocked' THEN 3 ELSE 1 END AND last + INTERVAL 7 DAY <= TIMESTAMP '2024-02-01' AS due FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'transient' WHEN user_id % 3 = 1 THEN 'blocked' ELSE 'terminal' END AS kind, count(*) FILTER (value > 50) AS attempts, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1)")
def retry_due(spark, d):
    kind = F.when(F.col("user_id") % 3 == 0, "transient").when(F.col("user_id") % 3 == 1, "blocked").otherwise("terminal")
    x = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("attempts"), F.max("ts").alias("last")).withColumn("kind", kind)
    return x.select("user_id", "kind", "attempts", "last", relevance.retry_due(F.col("kind"), F.col("attempts"), F.col("last"), F.lit("2024-02-01").cast(table(spark, d, "events").schema["ts"].dataType)).alias("due"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(PROMO|ECONOMY)') THEN 'budget' WHEN regexp_matches(p_name, 'widget|ring') THEN 'small' ELSE 'unknown' END AS kind FROM part")
def category_rules(spark, d):
    both = F.concat_ws("|", "p_type", "p_name")
    return table(spark, d, "part").select("p_partkey", relevance.classify(both, [("budget", "^(PROMO|ECONOMY)"), ("small", r"\|.*(widget|ring)")]).alias("kind"))


@query("SELECT p_partkey, round(0.25 * (p_size / 50.0) + CASE WHEN lower(p_name) = 'red widget' THEN 3.0 WHEN contains(lower(p_name), 'red widget') THEN 2.0 ELSE 0.0 END, 4) AS relevance FROM part")
def query_relevance(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select("p_partkey", relevance.query_relevance("red widget", F.col("p_size") / 50.0, F.col("p_name"), none, none, none).alias("relevance"))


@query("SELECT p_brand, count(*) AS count, CAST(sum(1 + p_size) AS BIGINT) AS weight FROM part WHERE p_size >= 10 GROUP BY 1 ORDER BY weight DESC, count DESC, p_brand LIMIT 10")
def weighted_sources(spark, d):
    return relevance.weighted_sources(table(spark, d, "part"), "p_brand", F.col("p_size"), F.col("p_size") >= 10, 10)


_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(f"SELECT o_custkey, CAST(max(list_position({_PRIORITIES}, o_orderpriority)) AS INTEGER) AS rank, max(list_position({_PRIORITIES}, o_orderpriority)) >= 4 AS allowed FROM orders GROUP BY 1")
def grants_allowed(spark, d):
    return relevance.allowed(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", _PRIORITIES, "2-HIGH")


@query("""WITH m AS (SELECT p_brand AS brand, p_type AS name, p_partkey AS ord, p_retailprice AS metric FROM part WHERE p_size > 40),
c AS (SELECT brand, arg_min(metric, ord) AS v FROM m WHERE brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1), n AS (SELECT name, arg_min(metric, ord) AS v FROM m GROUP BY 1)
SELECT p_partkey, coalesce(c.v, n.v) AS metric, CASE WHEN c.v IS NOT NULL THEN 'code' WHEN n.v IS NOT NULL THEN 'name' ELSE 'none' END AS match
FROM part p LEFT JOIN c ON p.p_brand = c.brand LEFT JOIN n ON p.p_type = n.name""")
def metric_join(spark, d):
    part = table(spark, d, "part")
    records = part.select("p_partkey", F.array("p_brand").alias("codes"), F.col("p_type").alias("name"))
    coded = F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    metrics = part.filter("p_size > 40").select(coded.alias("codes"), F.col("p_type").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("metric"))
    return lookup.two_tier(records, metrics, "p_partkey", "codes", "name", "ord", "metric").select("p_partkey", "metric", "match")


@query("SELECT p_partkey, CAST(CASE WHEN p_brand = 'Brand#7' THEN 3 WHEN p_name IN ('red widget', 'ring') THEN 2 WHEN contains(p_name, 'red widget') OR contains(p_name, 'ring') THEN 1 ELSE 0 END AS INTEGER) AS match_score FROM part")
def graded_match(spark, d):
    pack = spark.createDataFrame([("red widget", "Brand#7"), ("ring", "")], "p_name string, p_brand string")
    return lookup.graded_match(table(spark, d, "part"), pack, "p_name", "p_brand").select("p_partkey", "match_score")


@query("SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(replace(d.text, chr(10), ' '), replace(b.text, chr(10), ' ')) GROUP BY item_id HAVING count(DISTINCT doc_id) = 1")
def unique_containment(spark, d):
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" ")).alias(c)
    docs = table(spark, d, "documents").select("doc_id", flat("text"))
    passages = table(spark, d, "benchmark").select("item_id", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("passage"))
    return lookup.unique_containment(docs, passages, "doc_id", "text", "item_id", "passage")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_joins(spark, d):
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("SELECT CAST(i - 1 AS INTEGER) AS position, p_partkey, p_name FROM (SELECT unnest([5, 3, 999999999, 8]) AS k, generate_subscripts([5, 3, 999999999, 8], 1) AS i) JOIN part ON k = p_partkey")
def ordered_lookup(spark, d):
    wanted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 999999999, 8)))).alias("position", "k"))
    return F.broadcast(wanted).join(table(spark, d, "part"), F.col("k") == F.col("p_partkey")).select("position", "p_partkey", "p_name").orderBy("position")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'valid' END AS state, CASE WHEN o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1996-01-01' THEN c_name END AS resource FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def share_lookup(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    state = F.when(F.col("o_orderstatus") == "P", "revoked").when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "expired").otherwise("valid")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", state.alias("state"), F.when(state == "valid", F.col("c_name")).alias("resource"))


@query("SELECT event_id, user_id, ts, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")
def as_of_last(spark, d):
    e = table(spark, d, "events")
    return lookup.last_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("value"), "last_purchase").select("event_id", "user_id", "ts", "last_purchase")


@query("SELECT p_partkey, band FROM part JOIN (SELECT i AS band, 900 + 37.5 * i AS lo, 900 + 37.5 * (i + 1) AS hi FROM range(40) t(i)) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, d):
    bands = spark.range(40).select(F.col("id").alias("band"), (900 + 37.5 * F.col("id")).alias("lo"), (900 + 37.5 * (F.col("id") + 1)).alias("hi"))
    return lookup.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


@query("SELECT p_partkey, year, price FROM (SELECT p.p_partkey, y.year, y.price, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(y.year - p.p_size), y.year) AS r FROM part p JOIN (SELECT p_brand, p_size AS year, min(p_retailprice) AS price FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2) y USING (p_brand)) WHERE r = 1")
def nearest_value(spark, d):
    part = table(spark, d, "part")
    points = part.select("p_partkey", "p_brand", "p_size")
    targets = part.filter("p_size % 7 = 0").groupBy("p_brand", F.col("p_size").alias("year")).agg(F.min("p_retailprice").alias("price"))
    return lookup.nearest(points, targets, ["p_brand"], "p_size", "year", "price").select("p_partkey", "year", "price")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first_id, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copies FROM documents")
def copy_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dedup.copy_groups(docs, F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id").select("doc_id", "first_id", "copies")


@query("SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) ORDER BY page_id) AS r FROM pages) WHERE r = 1")
def ordered_distinct(spark, d):
    pages = table(spark, d, "pages").select("page_id", ids.host_of(F.col("url")).alias("host"))
    return compare.ordered_distinct(pages, F.col("host"), ["page_id"])


@query("SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') AS host, regexp_replace(url, '[?#].*$', '') AS bare, regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.pdf$|/pdf(?:/|$)|/pdfft$') OR regexp_matches(lower(url), '[?&](?:format|type)=pdf(?:&|$)') AS is_pdf FROM pages".replace("\\\\", "\\"))
def url_functions(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", "url", ids.host_label(u).alias("host"), ids.strip_query(u).alias("bare"), ids.looks_like_pdf(u).alias("is_pdf"))


@query("""WITH t AS (SELECT page_id, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) AS host, regexp_extract_all(coalesce(html, ''), '(?is)<((?:a|link|iframe|meta)\\b[^>]*)>', 1) AS tags FROM pages),
e AS (SELECT page_id, host, unnest(range(len(tags))) AS place, unnest(tags) AS tag FROM t),
r AS (SELECT page_id, CAST(place AS INTEGER) AS place, lower(regexp_extract(tag, '^(\\w+)', 1)) AS kind, host, regexp_extract(tag, '(?is)\\b(?:href|src|content)\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS raw FROM e),
a AS (SELECT page_id, place, kind, CASE WHEN raw LIKE '/%' AND raw NOT LIKE '//%' THEN host || raw ELSE raw END AS u FROM r),
b AS (SELECT page_id, place, kind, regexp_replace(CASE WHEN u LIKE '//%' THEN 'https:' || replace(u, '&amp;', '&') WHEN regexp_matches(u, '^[\\w.-]+\\.[A-Za-z]{2,}(?:/|$)') THEN 'https://' || replace(u, '&amp;', '&') ELSE replace(u, '&amp;', '&') END, '(?i)^http://', 'https://') AS u FROM a)
SELECT page_id AS id, place, kind, 'https://' || lower(regexp_extract(u, '(?i)^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(u, '(?i)^https://[^/?#]+(.*)$', 1), '#.*$', '') AS link FROM b WHERE regexp_matches(u, '(?i)^https://[^/?#]+')""")
def html_links(spark, d):
    return page_links(table(spark, d, "pages"), "page_id", "url", "html")


@query("""SELECT p_brand AS record, p_type AS kind, key, min(p_name) AS label, count(*) AS mentions FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(p_name)), '\\b(model|method|framework|dataset|result)s\\b', '\\1', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM part) WHERE length(key) >= 3 GROUP BY 1, 2, 3""")
def entity_groups(spark, d):
    x = group_candidates(table(spark, d, "part"), "p_brand", "p_type", "p_name")
    return x.select(F.col("p_brand").alias("record"), F.col("p_type").alias("kind"), "key", "label", "mentions")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity DESC, l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def merge_precedence(spark, d):
    rows = table(spark, d, "lineitem").withColumn("at", F.struct("l_linenumber", "l_suppkey"))
    return dedup.merge_by_precedence(rows, ["l_orderkey", "l_partkey"], "l_quantity", "at").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def unseen_rows(spark, d):
    seen = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return dedup.unseen(table(spark, d, "orders"), seen, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 100) UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 100")
def keyed_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, d, "supplier").filter("s_suppkey < 100").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    return dedup.upsert(old, new, "id")


@query("SELECT p_name AS source, p_type AS target FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT p_name, p_type FROM part p WHERE p_partkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_name = p.p_name AND q.p_type = p.p_type)")
def append_missing(spark, d):
    pairs = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("target"))
    return compare.append_missing(pairs.filter("p_partkey % 2 = 0").drop("p_partkey"), pairs.filter("p_partkey % 2 = 1").drop("p_partkey"), ["source", "target"])
