"""Change, limit, session, segment, element, extraction and comparison queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, ids, text
from ..operators import compare, elements, extract, segments
from ..sources import sinks
from ..streaming import changes, limits
from ..storage import table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# change data: events as a log, event_id the cursor, user_id the resource

_CHANGES = "c AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS base, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS operation, value FROM events)"


def _changes(spark, d):
    from pyspark.sql import Window

    base = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 11 == 0, base + 1).otherwise(base).alias("base"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("operation"), "value")


@query("""WITH RECURSIVE c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, CASE WHEN event_id % 11 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 END AS base FROM events),
a AS (SELECT event_id, user_id, r, CASE WHEN base = 0 THEN 1 ELSE 0 END AS revision, base = 0 AS good FROM c WHERE r = 1
UNION ALL SELECT c.event_id, c.user_id, c.r, a.revision + CASE WHEN c.base = a.revision THEN 1 ELSE 0 END, c.base = a.revision FROM a JOIN c ON c.user_id = a.user_id AND c.r = a.r + 1)
SELECT event_id, user_id, CAST(revision AS BIGINT) AS revision, CASE WHEN good THEN 'applied' ELSE 'conflict' END AS state FROM a""")
def cdc_apply(spark, d):
    return changes.apply_changes(_changes(spark, d), "user_id", "event_id", "base").select("event_id", "user_id", "revision", "state")


@query("SELECT event_id, user_id, event_id < (SELECT max(event_id) FROM events) AS has_more FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 500")
def cdc_pull(spark, d):
    return changes.pull(table(spark, d, "events"), "event_id", 1000, 500).select("event_id", "user_id", "has_more")


@query(f"WITH {_CHANGES} SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM c GROUP BY 1 HAVING arg_max(operation, event_id) <> 'delete'")
def cdc_snapshot(spark, d):
    return changes.snapshot(_changes(spark, d).withColumn("revision", F.col("event_id")), "user_id", "revision", "operation").select("user_id", "event_id", "value")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def cdc_once(spark, d):
    e = table(spark, d, "events").withColumn("mutation", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return changes.once_per_mutation(e, "mutation", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, o_orderkey, n, o_orderkey % 12 = n AS accepted, n + CASE WHEN o_orderkey % 12 = n THEN 1 ELSE 0 END AS revision FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey)")
def snapshot_cas(spark, d):
    o = table(spark, d, "orders")
    state = o.groupBy("o_custkey").agg(F.count("*").alias("revision")).withColumn("value", F.lit(""))
    asked = o.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 12).alias("expected"))
    return changes.compare_and_set(state, asked, "o_custkey").select("o_custkey", "o_orderkey", (F.col("revision") - F.col("accepted").cast("long")).alias("n"), "accepted", "revision")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS value FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey || '-copy', c_mktsegment FROM customer WHERE c_acctbal < 0")
def conflict_copies(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("local"), F.col("c_name").alias("remote"))
    return changes.resolve_conflicts(c, "copy_local")


@query("SELECT event_id, user_id, event_type, before, list_contains(['>click', '>view', 'view>click', 'click>purchase', 'view>view', 'purchase>view', 'error>view'], before || '>' || event_type) AS legal FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS before FROM events)")
def state_transitions(spark, d):
    allowed = {"": ["click", "view"], "view": ["click", "view"], "click": ["purchase"], "purchase": ["view"], "error": ["view"]}
    return changes.transitions(table(spark, d, "events"), "user_id", "event_id", "event_type", allowed).select("event_id", "user_id", "event_type", "before", "legal")


@query("SELECT p_partkey FROM part WHERE p_size % 5 = 0")
def needs_rebuild(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.sha2("p_name", 256).alias("digest"))
    built = p.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit("old")).otherwise(F.col("digest")).alias("digest"))
    return changes.needs_rebuild(p, built, "p_partkey", "digest").select("p_partkey")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 10 AS u, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS r FROM events),
a AS (SELECT event_id, u, r, t, true AS admitted, [t] AS log FROM e WHERE r = 1
UNION ALL SELECT e.event_id, e.u, e.r, e.t, len(list_filter(a.log, lambda x: x > e.t - 3600)) < 3, CASE WHEN len(list_filter(a.log, lambda x: x > e.t - 3600)) < 3 THEN list_append(list_filter(a.log, lambda x: x > e.t - 3600), e.t) ELSE list_filter(a.log, lambda x: x > e.t - 3600) END FROM a JOIN e ON e.u = a.u AND e.r = a.r + 1)
SELECT event_id, admitted FROM a""")
def sliding_rate_limit(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("u")).withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.sliding_log(e, "u", ["ts", "event_id"], "ts", 3, 3600.0).select("event_id", "admitted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id % 10 AS u, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS r FROM events),
a AS (SELECT event_id, u, r, t AS anchor, 1 AS n FROM e WHERE r = 1
UNION ALL SELECT e.event_id, e.u, e.r, CASE WHEN e.t - a.anchor >= 3600 THEN e.t ELSE a.anchor END, CASE WHEN e.t - a.anchor >= 3600 THEN 1 ELSE a.n + 1 END FROM a JOIN e ON e.u = a.u AND e.r = a.r + 1)
SELECT event_id, n <= 3 AS admitted FROM a""")
def anchored_rate_limit(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("u")).withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.anchored_window(e, "u", ["ts", "event_id"], "ts", 3, 3600.0).select("event_id", "admitted")


_GAP = "epoch_us(ts) - epoch_us(lag(ts) OVER w)"


@query(f"WITH x AS (SELECT *, CASE WHEN {_GAP} > 7200000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM x) SELECT user_id, session, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY 1, 2")
def event_sessions(spark, d):
    e = table(spark, d, "events").withColumn("t", F.expr("unix_micros(cast(ts as timestamp))") / 1000000.0)
    runs = limits.sessions(e.withColumnRenamed("ts", "at"), "user_id", ["t", "event_id"], "t", 7200.0)
    micros = lambda c: F.expr(f"cast(timestamp_micros(cast(round({c} * 1000000) as bigint)) as timestamp_ntz)").alias(c)
    return runs.select("user_id", "session", micros("first"), micros("last"), "events")


@query(f"WITH x AS (SELECT *, CASE WHEN coalesce({_GAP} <= 600000000 AND event_type = lag(event_type) OVER w, false) THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS entry FROM x) SELECT user_id, entry, event_type, count(*) AS merged FROM s GROUP BY 1, 2, 3")
def coalesced_history(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return limits.coalesced(e, "user_id", "event_type", ["ts", "event_id"], "ts", 600.0).select("user_id", "entry", "event_type", "merged")


@query("SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02') > 300000000 THEN 'early' WHEN epoch_us(TIMESTAMP '2024-01-02') - epoch_us(ts) > 43200000000 THEN 'late' ELSE 'ok' END AS verdict FROM events")
def late_and_early(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("received", F.lit("2024-01-02").cast("timestamp"))
    at = e.withColumn("verdict", F.when(F.col("ts").isNull(), "late"))
    return limits.accepted(at.drop("verdict"), "ts", "received", 300, 0.5).select("event_id", "verdict")


@query("SELECT event_type, le, count(*) FILTER (value <= le) AS count, count(*) AS total, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / 100.0, 4) AS sum FROM events CROSS JOIN (SELECT unnest([1.0::DOUBLE, 10.0, 50.0, 100.0]) AS le) GROUP BY 1, 2")
def latency_histogram(spark, d):
    return limits.histogram(table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", [1.0, 10.0, 50.0, 100.0]).select("event_type", "le", "count", "total", F.round("sum", 2).alias("sum"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS count FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return limits.windowed_counts(table(spark, d, "events"), "event_type", "ts")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS events FROM events GROUP BY 1")
def counter_merge(spark, d):
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return e.select("event_type", "event_id", F.explode("m")).filter("key = 'k'").groupBy("event_type").agg(F.sum("value").alias("total"), F.count("*").alias("events"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def retention(spark, d):
    return sinks.keep_newest(table(spark, d, "events"), ["user_id"], F.col("event_id"), 3).select("user_id", "event_id", "ts")


# segments: conversations and documents

@query("""WITH x AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS s FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE 'user' END AS role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM x) SELECT conv_id, run, role, min(turn) AS first, count(*) AS parts, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM r GROUP BY 1, 2, 3""")
def merged_runs(spark, d):
    c = table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise("user"))
    return segments.merge_runs(c, "conv_id", "turn", "role", "text")


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderkey AS id, CAST(floor(o_totalprice / 100) AS BIGINT) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
a AS (SELECT g, id, r, 0 AS batch, 1 AS k, n AS total FROM c WHERE r = 1
UNION ALL SELECT c.g, c.id, c.r, CASE WHEN a.k >= 4 OR a.total + c.n > 6000 THEN a.batch + 1 ELSE a.batch END, CASE WHEN a.k >= 4 OR a.total + c.n > 6000 THEN 1 ELSE a.k + 1 END, CASE WHEN a.k >= 4 OR a.total + c.n > 6000 THEN c.n ELSE a.total + c.n END FROM a JOIN c ON c.g = a.g AND c.r = a.r + 1)
SELECT id AS o_orderkey, CAST(batch AS INTEGER) AS batch FROM a""")
def size_batches(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return segments.size_batches(o, "o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100), 4, 6000).select("o_orderkey", "batch")


@query("SELECT DISTINCT lower(trim(p_name)) AS key FROM part WHERE lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey < 30)")
def cache_misses(spark, d):
    part = table(spark, d, "part")
    key = F.lower(F.trim("p_name"))
    return segments.cached_results(part, part.filter("p_partkey < 30").select(key.alias("key"), F.lit("x").alias("result")).distinct(), key)[1]


@query("SELECT conv_id, turn, coalesce(b = 0 OR (a >= 80 AND (b / greatest(a, 1)::DOUBLE < 0.15 OR b / greatest(a, 1)::DOUBLE > 4.0)) OR (ea >= 3 AND eb = 0), true) AS suspicious FROM (SELECT conv_id, turn, length(regexp_replace(coalesce(prev, ''), '\\s+', '', 'g')) AS a, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS b, len(regexp_extract_all(coalesce(prev, ''), '[.!?。！？]')) AS ea, len(regexp_extract_all(coalesce(text, ''), '[.!?。！？]')) AS eb FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations))")
def suspicious_pairs(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    return c.select("conv_id", "turn", segments.suspicious_pair(F.col("prev"), F.coalesce("text", F.lit(""))).alias("suspicious"))


@query()
def segment_kinds(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.groupBy(segments.segment_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


# layout elements: line items as boxes on the page of their order

def _boxes(spark, d, shift: float = 0.0, where: str = "true"):
    x, y = F.col("l_quantity") + shift, F.col("l_partkey") % 5 * 4.0
    box = F.array(x, y, x + 12.0, y + 9.0)
    return table(spark, d, "lineitem").filter(where).select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.expr("l_linenumber * 100000L + l_partkey").alias("id"), F.when(F.col("l_tax") < 0.04, "table").otherwise("figure").alias("kind"), box.alias("box"), (F.col("l_discount") + 0.5).alias("score"))


@query()
def overlap_suppression(spark, d):
    return elements.suppress_overlaps(_boxes(spark, d), ["id"], 0.3).select("page", "kind", "id")


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber * 100000::BIGINT + l_partkey AS id, l_quantity AS x0, l_partkey % 5 * 4.0::DOUBLE AS y0 FROM lineitem)
SELECT DISTINCT page, id AS a, bid AS b, round(i / (216.0::DOUBLE - i), 4) AS iou FROM (SELECT a.page, a.id, b.id AS bid, greatest(12 - abs(a.x0 - b.x0), 0) * greatest(9 - abs(a.y0 - b.y0), 0) AS i FROM b a JOIN b b ON a.page = b.page AND a.id < b.id) WHERE i > 0""")
def box_overlaps(spark, d):
    return _overlaps(_boxes(spark, d))


def _overlaps(b):
    x, y = b.select("page", F.col("id").alias("a"), F.col("box").alias("p")), b.select("page", F.col("id").alias("b"), F.col("box").alias("q"))
    pairs = x.join(y, "page").filter("a < b").withColumn("iou", F.round(geo.iou(geo.box_of(F.col("p")), geo.box_of(F.col("q"))), 4))
    return pairs.filter("iou > 0").select("page", "a", "b", "iou").distinct()


@query()
def robust_lines(spark, d):
    """Line items as ticks, eight pixels apart; two of three lie on a line."""
    y = F.when(F.col("l_partkey") % 3 == 0, F.col("l_quantity")).otherwise(F.col("l_linenumber") * 2.0 + 1.0)
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("axis"), (F.col("l_linenumber") * 8).alias("x"), y.alias("y"))
    return elements.robust_line(items, "axis", "x", "y")


@query("SELECT event_type, dayofyear(ts) AS x, median(value) AS y FROM events GROUP BY 1, 2")
def curve_columns(spark, d):
    e = table(spark, d, "events").select("event_type", F.dayofyear("ts").cast("long").alias("x"), F.col("value").alias("y"))
    return elements.curve_by_column(e, ["event_type"], "x", "y")


@query("SELECT event_id, CASE WHEN greatest(r, g, b) - least(r, g, b) < 34 OR 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b < 95 THEN 'gray' ELSE CAST(round(r / 48::DOUBLE) AS INTEGER) || '-' || CAST(round(g / 48::DOUBLE) AS INTEGER) || '-' || CAST(round(b / 48::DOUBLE) AS INTEGER) END AS bucket FROM (SELECT event_id, event_id * 37 % 256 AS r, event_id * 91 % 256 AS g, event_id * 53 % 256 AS b FROM events)")
def colour_buckets(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_id * 37 % 256 AS r", "event_id * 91 % 256 AS g", "event_id * 53 % 256 AS b")
    return e.select("event_id", elements.colour_bucket(F.col("r"), F.col("g"), F.col("b")).alias("bucket"))


@query("WITH a AS (SELECT l_returnflag AS s, l_linenumber AS x, CAST(avg(l_quantity) AS DOUBLE) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), e AS (SELECT l_returnflag AS s, l_linenumber AS x, CAST(avg(l_quantity) AS DOUBLE) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2) SELECT s AS series, count(a.y) / count(*)::DOUBLE AS coverage, round(avg(abs(a.y - e.y)), 6) AS mae, round(sqrt(avg((a.y - e.y) * (a.y - e.y))), 6) AS rmse FROM e LEFT JOIN a USING (s, x) GROUP BY 1")
def point_errors(spark, d):
    items = table(spark, d, "lineitem")
    at = lambda s: items.filter(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("series"), F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").alias("y"))
    return elements.point_errors(at("O"), at("F"), "series", "x", "y")


# extraction and comparison

@query("""WITH n AS (SELECT c_custkey AS id, 0.55::DOUBLE + c_custkey % 45 / 100.0::DOUBLE AS confidence, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS evidence FROM customer), e AS (SELECT o_custkey AS source, o_custkey * 3 AS target FROM orders), u AS (SELECT source AS id FROM e UNION SELECT target FROM e)
SELECT count(*) AS nodes, round(avg(confidence), 4) AS confidence, round(avg(CASE WHEN evidence > 0 THEN 1 ELSE 0 END), 4) AS with_evidence, round(avg(CASE WHEN confidence < 0.6 THEN 1 ELSE 0 END), 4) AS to_review, round(avg(CASE WHEN id NOT IN (SELECT id FROM u) THEN 1 ELSE 0 END), 4) AS isolated, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM (SELECT DISTINCT * FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n))) AS dangling FROM n""")
def graph_quality(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (0.55 + F.col("c_custkey") % 45 / 100.0).alias("confidence"), (F.col("c_acctbal") > 0).cast("int").alias("evidence"))
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") * 3).alias("target"))
    return extract.graph_quality(n, e)


_DIMS = ["ECONOMY", "PROMO", "STANDARD", "NONE"]


@query(f"""WITH i AS (SELECT p_brand AS record, p_type AS dimension, p_name || '-' || p_partkey AS label, p_size / 50.0 AS confidence FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY record, dimension ORDER BY confidence DESC, label) AS r FROM i QUALIFY r <= 8)
SELECT p.record, x.dimension, count(label) AS count, coalesce(string_agg(label, ' | ' ORDER BY r), '') AS items FROM (SELECT DISTINCT p_brand AS record FROM part) p CROSS JOIN (SELECT unnest({_DIMS}) AS dimension) x LEFT JOIN k ON k.record = p.record AND k.dimension = x.dimension GROUP BY 1, 2""")
def dimension_matrix(spark, d):
    return compare.dimension_matrix(_items(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("record")).distinct(), _DIMS)


def _items(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("record"), F.col("p_type").alias("dimension"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("label"), (F.col("p_size") / 50.0).alias("confidence"))


@query(f"SELECT record, dimension FROM (SELECT DISTINCT p_brand AS record FROM part) CROSS JOIN (SELECT unnest({_DIMS}) AS dimension) EXCEPT SELECT p_brand, p_type FROM part")
def missing_dimensions(spark, d):
    return compare.missing_dimensions(_items(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("record")).distinct(), _DIMS)


@query("""WITH l AS (SELECT o_custkey AS record, arg_max(o_orderpriority, (o_orderkey, o_orderpriority)) AS p, arg_max(o_orderstatus, (o_orderkey, o_orderstatus)) AS s FROM orders GROUP BY 1), m AS (SELECT c_custkey AS record, c_mktsegment AS items FROM customer)
SELECT record, CASE WHEN s = 'F' THEN p WHEN s = 'O' THEN '' WHEN s = 'P' THEN items || ' | ' || p ELSE items END AS items, CASE s WHEN 'F' THEN 'replace' WHEN 'O' THEN 'reject' WHEN 'P' THEN 'add' ELSE 'automatic' END AS state FROM m LEFT JOIN l USING (record)""")
def review_overlay(spark, d):
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), F.lit("x").alias("dimension"), F.col("c_mktsegment").alias("items"))
    action = F.when(F.col("o_orderstatus") == "F", "replace").when(F.col("o_orderstatus") == "O", "reject").otherwise("add")
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("record"), F.lit("x").alias("dimension"), F.col("o_orderkey").alias("at"), action.alias("action"), F.col("o_orderpriority").alias("label"))
    return compare.overlay_reviews(m, r).select("record", "items", "state")


@query("""WITH s AS (SELECT d.doc_id, d.text || CASE WHEN quality = 1 THEN ' results improve' ELSE ' results decrease' END AS text FROM documents d JOIN labels USING (doc_id) WHERE d.text IS NOT NULL AND quality IS NOT NULL),
c AS (SELECT doc_id AS id, doc_id % 97 AS record, contains(lower(text), 'improve') OR contains(lower(text), 'outperform') OR contains(lower(text), 'increase') OR contains(lower(text), 'higher') AS up,
  contains(lower(text), 'not ') OR contains(lower(text), 'underperform') OR contains(lower(text), 'decrease') OR contains(lower(text), 'lower') AS down, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS t FROM s),
p AS (SELECT x.id AS a, y.id AS b, x.t AS p, y.t AS q FROM c x JOIN c y ON x.up AND y.down AND x.record <> y.record AND (NOT (x.up AND x.down AND y.up AND y.down) OR x.id < y.id) WHERE len(x.t) > 0 AND len(y.t) > 0)
SELECT a, b, likeness FROM (SELECT a, b, round(len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q)))::DOUBLE, 4) AS likeness FROM p) WHERE likeness >= 0.20 ORDER BY likeness DESC, a, b LIMIT 40""")
def opposite_results(spark, d):
    """Documents that say in their last words, by their label, that results rise or fall."""
    said = F.concat("text", F.when(F.col("quality") == 1, " results improve").otherwise(" results decrease"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").filter("text IS NOT NULL AND quality IS NOT NULL").withColumn("text", said)
    return compare.opposite_results(_claims(docs))


def _claims(docs):
    return docs.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 97).alias("record"), compare.polarity(F.col("text")).alias("polarity"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("terms"))


@query()
def opposite_results_all(spark, d):
    """Claims of the documents' own texts."""
    return compare.opposite_results(_claims(table(spark, d, "documents")))


@query()
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


@query("SELECT page_id, facet FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '\\b(?:18|19|20|21)\\d{2}\\b'), ''), '') AS facet FROM pages)")
def facet_years(spark, d):
    return table(spark, d, "pages").select("page_id", ids.facet_year(F.col("url")).alias("facet"))
