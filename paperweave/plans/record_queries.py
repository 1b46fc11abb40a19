"""Record, state, timeline and identifier queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import records
from ..storage import table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_LOG = "l AS (SELECT o_custkey AS r, o_orderkey % 7 AS c, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'remove' ELSE 'add' END, o_orderkey) AS action FROM orders GROUP BY 1, 2)"


def _log(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("record_id"), (F.col("o_orderkey") % 7).alias("collection_id"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") == "F", "remove").otherwise("add").alias("action"))


@query(f"WITH {_LOG} SELECT r AS record_id, c AS collection_id FROM l WHERE action = 'add'")
def favorites_state(spark, d):
    return records.favorites_from_log(_log(spark, d))


@query(f"WITH {_LOG} SELECT id AS collection_id, 'c' || id AS name, (SELECT count(DISTINCT r) FROM l WHERE action = 'add' AND c = id) AS records FROM range(9) t(id)")
def state_projection(spark, d):
    named = spark.range(9).select(F.col("id").alias("collection_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("name"))
    return records.collection_counts(named, records.favorites_from_log(_log(spark, d)))


@query("""SELECT DISTINCT 'o' || o_orderkey AS id, 'author' AS facet, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT 'o' || o_orderkey, 'institution', n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def paper_facts(spark, d):
    """Orders as papers, customers as authors, nations as institutions."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = o.select(key("o", "o_orderkey").alias("id"), F.lit("paper").alias("type"), F.lit("").alias("label")).union(c.select(key("c", "c_custkey"), F.lit("author"), "c_name")).union(n.select(key("n", "n_nationkey"), F.lit("institution"), "n_name"))
    edges = o.select(F.lit("AUTHOR_OF").alias("type"), key("c", "o_custkey").alias("source"), key("o", "o_orderkey").alias("target")).union(c.select(F.lit("AFFILIATED_WITH"), key("c", "c_custkey"), key("n", "c_nationkey")))
    return records.paper_facts(nodes, edges)


@query("SELECT p_partkey AS id, p_name AS label, p_size / 50.0 AS importance, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1 AND l_partkey = p_partkey) AS cited FROM part")
def literature_rows(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("paper").alias("type"), F.col("p_name").alias("label"), (F.col("p_size") / 50.0).alias("importance"))
    edges = table(spark, d, "lineitem").filter("l_linenumber = 1").select(F.lit("CITES").alias("type"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return records.literature_rows(nodes, edges).select("id", "label", "importance", "cited")


@query("WITH s AS (SELECT o_orderstatus AS topic, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders GROUP BY 1, 2), p AS (SELECT * FROM s WHERE year BETWEEN 1995 AND 1998) SELECT *, year = (SELECT year FROM p ORDER BY abs(year - 2003), year LIMIT 1) AS playing FROM p")
def timeline_window(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("topic"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("count"))
    return records.timeline(s, "year", 1995, 1998, 2003)


@query("""WITH g AS (SELECT l_orderkey AS record, l_quantity AS page, l_returnflag AS element, l_linestatus AS excerpt, min(l_linenumber) AS top, min(l_partkey) AS left, count(DISTINCT l_suppkey) AS nodes FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT *, CAST(row_number() OVER (PARTITION BY record ORDER BY page, top, "left", element, excerpt) AS INTEGER) AS index FROM g""".replace("AS left,", 'AS "left",'))
def replay_events(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_quantity").alias("page"), F.col("l_returnflag").alias("element"), F.col("l_linestatus").alias("excerpt"), F.col("l_linenumber").alias("top"), F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("node"))
    return records.replay_events(e)


@query("SELECT min(p_partkey) AS id FROM part WHERE p_type = 'PROMO'")
def seed_node(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "paper").otherwise("other").alias("type"), (F.col("p_size") / 50.0).alias("importance"))
    return records.seed_node(nodes)


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 5 AS layer, p_retailprice AS importance, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part)
SELECT id, layer, CAST(n // 8 AS INTEGER) AS row, CAST(n % 8 AS INTEGER) AS col, n % 8 * 180.0::DOUBLE AS x, layer * 480.0::DOUBLE + n // 8 * 120.0::DOUBLE AS y FROM r""")
def layered_positions(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("layer"), F.col("p_retailprice").alias("importance"))
    return records.layered(nodes).drop("importance")


@query("""WITH c AS (SELECT l_orderkey AS upload, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS size, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
SELECT upload, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (upload % 3 = 0) AS gaps, upload % 3 <> 0 AS complete FROM c GROUP BY 1, 4""")
def upload_state(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("l_quantity").cast("long")
    # the offsets of every third upload are spread, so that each of its chunks leaves a gap
    offset = F.sum(size).over(w) - size
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload"), size.alias("size"), F.when(F.col("l_orderkey") % 3 == 0, offset * 2 + 1).otherwise(offset).alias("offset"))
    total = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("upload")).agg(F.sum(size).alias("total"))
    return records.upload_state(c, "upload", "offset", "size", total).drop("total")


@query("SELECT 'orders' AS \"table\", o_orderkey AS id FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey = 7")
def tenant_export(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"), F.col("c_custkey").alias("id"))
    return records.tenant_rows({"orders": o, "customer": c}, "tenant", 7).select("table", F.get_json_object("row", "$.id").cast("long").alias("id"))


@query("""WITH c AS (SELECT doc_id, term, count(*) AS count FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY 1, 2)
SELECT doc_id, term, count FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, length(term) DESC, term) <= 20""")
def frequency_keywords(spark, d):
    return records.frequency_keywords(table(spark, d, "documents"), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))


@query("""SELECT page_id, regexp_matches(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '(^|\\.)example\\.com$') AS on_host, CAST(CASE WHEN contains(url, '/fr/') THEN 1 WHEN contains(url, '/de/') THEN 2 ELSE 99 END AS INTEGER) AS priority FROM pages""")
def host_rules(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", ids.on_hosts(u, ["example.com"]).alias("on_host"), ids.priority(u, [("/fr/", 1), ("/de/", 2)]).alias("priority"))


@query("""SELECT p_partkey, 'all:"' || lower(trim(p_name)) || '" OR (' || array_to_string(list_transform(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda t: NOT list_contains(['of', 'the', 'and'], t)), lambda t: 'all:' || t), ' AND ') || ')' AS q FROM part""")
def query_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", text.query_string(F.col("p_name")).alias("q"))


@query("""SELECT p_partkey, lower(p_type) <> lower(p_brand) AS known, lower(p_type) || '|' || lower(p_brand) AS first_two FROM part""")
def keyword_lists(spark, d):
    k = text.keyword_candidates(F.array("p_type", "p_brand"), F.array("p_type"), F.col("p_name"))
    first = text.bind(k, lambda k: F.struct((F.size(k) >= 2).alias("known"), F.lower(F.concat_ws("|", F.get(k, 0), F.get(k, 1))).alias("first_two")))
    return table(spark, d, "part").select("p_partkey", first.alias("k")).select("p_partkey", "k.known", "k.first_two")
