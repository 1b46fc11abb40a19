"""Pair, series, text-mining and graph queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import compare, detail, graphs, pairs, papers, series, vectors
from ..storage import durable, table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def shared_sql() -> str:
    return f"""SELECT a, b, shared, round(CAST(shared AS DOUBLE) / (x.n + y.n - shared), 4) AS score FROM (
  SELECT p.i AS a, q.i AS b, count(*) AS shared FROM k p JOIN k q ON p.g = q.g AND p.i < q.i GROUP BY 1, 2) s
  JOIN n x ON x.i = a JOIN n y ON y.i = b"""


def _with(group: str, item: str, cap: int | None = None) -> str:
    kept = f"(SELECT *, row_number() OVER (PARTITION BY g ORDER BY i) AS r FROM u) WHERE r <= {cap}" if cap else "u"
    return f"""u AS (SELECT DISTINCT {group} AS g, {item} AS i FROM lineitem), n AS (SELECT i, count(*) AS n FROM u GROUP BY 1),
k AS (SELECT g, i FROM {kept})"""


@query(f"WITH {_with('l_orderkey', 'l_partkey')} {shared_sql()}")
def cocitation(spark, d):
    """Parts that orders have in common, as papers cited together."""
    return pairs.shared_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query(f"WITH {_with('l_partkey', 'l_orderkey', 80)} {shared_sql()}")
def coupling(spark, d):
    """Orders that share parts, as papers with common references."""
    return pairs.shared_pairs(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", 80)


@query("SELECT count(*) FILTER (c > 20) AS groups_truncated, CAST(coalesce(sum(greatest(c - 20, 0)), 0) AS BIGINT) AS items_left_out FROM (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)")
def pair_truncation(spark, d):
    return pairs.truncated(table(spark, d, "lineitem"), "l_partkey", 20)


_COLLAB = """m AS (SELECT l_orderkey AS g, i FROM (SELECT l_orderkey, i, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey AS i FROM lineitem)) WHERE r <= 40),
p AS (SELECT x.i AS a, y.i AS b, x.g FROM m x JOIN m y ON x.g = y.g AND x.i < y.i),
c AS (SELECT a, b, count(*) AS count FROM p GROUP BY 1, 2 ORDER BY count DESC, a, b LIMIT 600)"""


@query(f"WITH {_COLLAB} SELECT a, b, count, (SELECT string_agg(g, ',' ORDER BY g) FROM (SELECT g FROM p WHERE p.a = c.a AND p.b = c.b ORDER BY g LIMIT 12)) AS evidence FROM c")
def collaboration(spark, d):
    """Suppliers that deliver to the same orders, as authors of the same papers."""
    return papers.collaboration(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query(f"""WITH {_COLLAB}, e AS (SELECT s, count(*) AS partners FROM (SELECT a AS s FROM c UNION ALL SELECT b FROM c) GROUP BY 1),
x AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS papers, sum(CAST(l_quantity AS BIGINT)) AS citations, coalesce(any_value(partners), 0) AS partners, count(DISTINCT l_returnflag) AS topics, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year FROM lineitem LEFT JOIN e ON s = l_suppkey GROUP BY 1)
SELECT l_suppkey, papers, CAST(citations AS BIGINT) AS citations, partners, topics, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year,
  round(0.36::DOUBLE * papers / greatest(max(papers) OVER (), 1) + 0.30::DOUBLE * citations / greatest(max(citations) OVER (), 1) + 0.20::DOUBLE * partners / greatest(max(partners) OVER (), 1) + 0.14::DOUBLE * topics / greatest(max(topics) OVER (), 1), 4) AS score FROM x""")
def entity_metrics(spark, d):
    items = table(spark, d, "lineitem")
    rows = items.select("l_suppkey", "l_orderkey", F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("long").alias("cited"), "l_returnflag")
    near = papers.collaboration(items, "l_orderkey", "l_suppkey")
    return papers.entity_metrics(rows, "l_suppkey", "l_orderkey", "year", "cited", "l_returnflag", near)


_STATE = "CASE WHEN sy IS NULL OR ty IS NULL THEN 'unknown_year' WHEN ty > sy THEN 'chronology_conflict' ELSE 'valid' END"
_PARTS = "parts AS (SELECT p_partkey AS id, CASE WHEN p_size = 50 THEN NULL ELSE CAST(1990 + p_size AS INTEGER) END AS year FROM part)"
_LINKS = "links AS (SELECT DISTINCT l_partkey AS source, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS target FROM lineitem WHERE l_partkey <> (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part))"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 50, (1990 + F.col("p_size")).cast("int")).alias("year"))


def _links(spark, d):
    """Line items as citations; the cited part is any of all parts."""
    parts = table(spark, d, "part").count()
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % parts).alias("target")).filter("source != target").distinct()


@query(f"WITH {_PARTS}, {_LINKS} SELECT source, target, a.year AS source_year, b.year AS target_year, {_STATE.replace('sy', 'a.year').replace('ty', 'b.year')} AS state FROM links JOIN parts a ON source = a.id JOIN parts b ON target = b.id")
def citation_states(spark, d):
    return papers.classify_citations(_links(spark, d), _parts(spark, d))


@query(f"WITH {_PARTS}, {_LINKS}, c AS (SELECT {_STATE.replace('sy', 'a.year').replace('ty', 'b.year')} AS state FROM links JOIN parts a ON source = a.id JOIN parts b ON target = b.id) SELECT count(*) AS links, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'chronology_conflict') AS chronology_conflict, count(*) FILTER (state = 'unknown_year') AS unknown_year, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 4) AS per_paper FROM c")
def citation_coverage(spark, d):
    return papers.coverage(papers.classify_citations(_links(spark, d), _parts(spark, d)), table(spark, d, "part").count())


@query(f"""WITH {_LINKS}, t AS (SELECT p_partkey AS id, p_brand AS topic FROM part), s AS (SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS strength FROM lineitem GROUP BY 1),
e AS (SELECT source AS id, target AS other, 0 AS cited FROM links UNION ALL SELECT target, source, 1 FROM links),
c AS (SELECT e.id, sum(cited) AS ci, count(*) AS deg, count(*) FILTER (t.topic <> o.topic) AS cross_links FROM e LEFT JOIN t ON t.id = e.id LEFT JOIN t o ON o.id = e.other GROUP BY 1),
x AS (SELECT t.id, CAST(coalesce(ci, 0) AS BIGINT) AS ci, coalesce(deg, 0) AS deg, coalesce(cross_links, 0) AS cross_links, coalesce(strength, 0) AS strength FROM t LEFT JOIN c USING (id) LEFT JOIN s USING (id))
SELECT id, ci AS citations_in, deg AS degree, cross_links, round(0.55::DOUBLE * ci / greatest(max(ci) OVER (), 1) + 0.30::DOUBLE * deg / greatest(max(deg) OVER (), 1) + 0.15::DOUBLE * least(1.0, strength / 5::DOUBLE), 4) AS core_score, round(CASE WHEN deg > 0 THEN 0.38::DOUBLE * (CAST(cross_links AS DOUBLE) / deg) ELSE 0 END, 4) AS bridge_score FROM x""")
def paper_metrics(spark, d):
    strength = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("strength"))
    topics = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"))
    return papers.paper_metrics(_links(spark, d), strength, topics)


_READ = f"""m AS ({QUERIES["paper_metrics"][1]}), r AS (
  SELECT m.*, 1990 + p_size AS year, p_partkey % 9 = 0 AS archived, p_partkey % 4 = 0 AS context, p_partkey % 3 = 0 AS available, p_partkey % 6 = 1 AS queued, p_size % 2 = 0 AS growing, (p_partkey % 11) / 20.0::DOUBLE AS key_score FROM m JOIN part ON p_partkey = id
), s AS (
  SELECT *, round(0.30 * core_score + 0.20 * bridge_score + 0.20 * key_score + 0.10 * growing::INT + 0.06 * (year >= (SELECT max(year) FROM r) - 2)::INT + 0.08 * context::INT + 0.04 * available::INT + 0.02 * queued::INT, 4)::DOUBLE AS score,
    CASE WHEN core_score >= greatest(0.28, bridge_score * 1.25) OR citations_in >= 2 THEN 'foundation' WHEN bridge_score >= 0.12 OR cross_links > 0 THEN 'bridge' ELSE 'frontier' END AS stage FROM r WHERE NOT archived
), c AS (SELECT id, stage, score, year, row_number() OVER (ORDER BY score DESC, year, id) AS place FROM s QUALIFY place <= 24)"""


def _readable(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS id", "1990 + p_size AS year", "p_partkey % 9 = 0 AS archived", "p_partkey % 4 = 0 AS context", "p_partkey % 3 = 0 AS available", "p_partkey % 6 = 1 AS queued", "p_size % 2 = 0 AS growing", "(p_partkey % 11) / 20.0D AS key_score")
    return paper_metrics(spark, d).join(p, "id")


@query(f"WITH {_READ} SELECT id, stage, score, year, place FROM c")
def recommendations(spark, d):
    """Parts as papers, what is read of them by rules of their numbers."""
    return papers.recommendations(_readable(spark, d))


@query(f"""WITH {_READ}, q AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY CASE WHEN stage = 'foundation' THEN year ELSE place END, place) AS k, CASE stage WHEN 'foundation' THEN 1 WHEN 'bridge' THEN 2 ELSE 3 END AS o FROM c),
f AS (SELECT *, k <= CASE stage WHEN 'frontier' THEN 4 ELSE 3 END AS chosen FROM q), g AS (SELECT *, count(*) FILTER (chosen) OVER () AS n, row_number() OVER (PARTITION BY chosen ORDER BY place) AS more FROM f)
SELECT id, stage, row_number() OVER (ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, CASE WHEN chosen THEN o END, CASE WHEN chosen THEN k END, place) AS step FROM g WHERE chosen OR (n < 5 AND more <= 8 - n) QUALIFY step <= 10""")
def reading_path(spark, d):
    return papers.reading_path(papers.recommendations(_readable(spark, d)), _links(spark, d)).select("id", "stage", "step")


_CHAIN = "o AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS nxt, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS r FROM orders)"


def _chain(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), "o_custkey")
    before = F.lag("id").over(Window.partitionBy("o_custkey").orderBy("year", "id"))
    return o.withColumn("before", before).withColumn("key", F.lit(0.0))


@query(f"""WITH {_CHAIN}, g AS (SELECT id, o_custkey, r, CASE WHEN r > 1 THEN 1 + least(0.6::DOUBLE, 0.04::DOUBLE * (year - lag(year) OVER w)) END AS gain, lag(id) OVER w AS parent FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY r))
SELECT id, round(1 + coalesce(sum(gain) OVER (PARTITION BY o_custkey ORDER BY r), 0), 6) AS score, CAST(r - 1 AS INTEGER) AS length, parent FROM g""")
def citation_paths(spark, d):
    """Each customer's orders as a chain of citations; a general operator on acyclic links."""
    return _longest(durable(_chain(spark, d)))


def _longest(o):
    return papers.longest_paths(o.filter("before IS NOT NULL").select(F.col("id").alias("source"), F.col("before").alias("target")), o.select("id", "year", "key"))


@query()
def key_paths(spark, d):
    o = durable(_chain(spark, d))
    return papers.key_paths(o.filter("before IS NOT NULL").select(F.col("id").alias("source"), F.col("before").alias("target")), o.select("id", "year", "key"))


_YEARS = "y AS (SELECT c_mktsegment AS topic, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_WIN = "w AS (SELECT topic, CAST(sum(count) AS BIGINT) AS total, count(*) AS years, CAST(coalesce(sum(count) FILTER (year BETWEEN last - 2 AND last), 0) AS BIGINT) AS recent, CAST(coalesce(sum(count) FILTER (year BETWEEN last - 5 AND last - 3), 0) AS BIGINT) AS previous FROM (SELECT *, max(year) OVER (PARTITION BY topic) AS last FROM y) GROUP BY topic)"


def _yearly(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("topic"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return x


def _counts(spark, d):
    return _yearly(spark, d).groupBy("topic", "year").agg(F.count("*").alias("count"))


@query("""WITH x AS (SELECT c_mktsegment AS topic, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS id, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT topic, year, count(*) AS count, arg_max(id, (score, -id)) AS representative FROM x GROUP BY 1, 2)
SELECT t.topic, y.year, coalesce(count, 0) AS count, CAST(sum(coalesce(count, 0)) OVER (PARTITION BY t.topic ORDER BY y.year) AS BIGINT) AS cumulative, representative FROM (SELECT DISTINCT topic FROM x) t CROSS JOIN (SELECT DISTINCT year FROM x) y LEFT JOIN c ON c.topic = t.topic AND c.year = y.year""")
def yearly_series(spark, d):
    return series.dense_series(_yearly(spark, d), "topic", "year", "id", "score")


@query(f"WITH {_YEARS}, {_WIN}, g AS (SELECT *, round((recent - previous) / greatest(previous, 1)::DOUBLE, 4) AS rate FROM w) SELECT topic, recent, previous, rate, CASE WHEN recent - previous >= 2 AND rate >= 0.25 THEN 'growing' WHEN recent - previous <= -2 AND rate <= -0.25 THEN 'declining' ELSE 'stable' END AS trend FROM g")
def window_growth(spark, d):
    return series.growth(_counts(spark, d), "topic", "year")


_EVENT_DAYS = "y AS (SELECT event_type || '-' || (user_id % 20) AS topic, CAST(dayofyear(ts) AS INTEGER) AS year, count(*) AS count FROM events GROUP BY 1, 2)"


@query(f"WITH {_EVENT_DAYS}, {_WIN}, g AS (SELECT topic, recent, previous, total, years, round(log2((recent + 1) / (previous + 1)::DOUBLE) * ln(1 + recent::DOUBLE), 4) AS score FROM w) SELECT topic, recent, previous, score FROM g WHERE total >= 3 AND years >= 2 AND recent >= 2 AND score > 0.35 ORDER BY score DESC, topic LIMIT 40")
def burst_scores(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("topic"), F.dayofyear("ts").alias("year"))
    return series.bursts(e.groupBy("topic", "year").agg(F.count("*").alias("count")), "topic", "year")


@query(f"WITH {_YEARS}, c AS (SELECT topic, CAST(sum(count) AS BIGINT) AS count FROM y WHERE year BETWEEN 1996 AND 1999 GROUP BY 1) SELECT topic, count, round(count / sum(count) OVER (), 4) AS share FROM c")
def topic_share(spark, d):
    return series.window_share(_counts(spark, d), "topic", "year", 1996, 1999)


@query("""WITH x AS (SELECT c_mktsegment AS topic, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT t.topic, y.year, (SELECT count(*) FROM x WHERE x.topic = t.topic AND x.year = y.year) AS count FROM (SELECT DISTINCT topic FROM x) t CROSS JOIN (SELECT DISTINCT year FROM x) y),
w AS (SELECT *, lag(count) OVER p AS before, max(count) OVER (PARTITION BY topic) AS peak, sum(count) OVER (PARTITION BY topic ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s WINDOW p AS (PARTITION BY topic ORDER BY year))
SELECT topic, year, 'emergence' AS kind, 0.7::DOUBLE AS score FROM w WHERE count > 0 AND coalesce(seen, 0) = 0
UNION ALL SELECT topic, min(year), 'expansion', round(min(least(1.0, 0.5::DOUBLE + 0.08::DOUBLE * peak)), 4) FROM w WHERE count = peak AND count > coalesce(before, 0) AND peak >= 2 GROUP BY 1
UNION ALL SELECT topic, max(year), 'decline', 0.72::DOUBLE FROM w WHERE count * 2 <= before GROUP BY 1""")
def turning_points(spark, d):
    return _turning_points(_yearly(spark, d))


def _turning_points(rows):
    return papers.turning_points(series.dense_series(rows, "topic", "year", "id", "score"), "topic", "year")


@query("SELECT user_id, event_id, event_type AS to_type, before AS from_topic FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def topic_transitions(spark, d):
    return papers.topic_transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("event_type").alias("to_type"), "from_topic")


@query("""WITH c AS (SELECT event_type, CAST(floor(epoch(ts) / 1800.0) AS BIGINT) AS cell, median(value) AS y FROM events GROUP BY 1, 2),
g AS (SELECT event_type, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY 1),
f AS (SELECT g.event_type, g.cell, c.y, last_value(CASE WHEN c.y IS NOT NULL THEN g.cell END IGNORE NULLS) OVER b AS ca, last_value(c.y IGNORE NULLS) OVER b AS ya, first_value(CASE WHEN c.y IS NOT NULL THEN g.cell END IGNORE NULLS) OVER a AS cb, first_value(c.y IGNORE NULLS) OVER a AS yb FROM g LEFT JOIN c USING (event_type, cell)
  WINDOW b AS (PARTITION BY event_type ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, cell, round(CASE WHEN y IS NOT NULL THEN y WHEN cb - ca <= 5 THEN ya + (cell - ca) * (yb - ya) / (cb - ca) END, 6) AS y, y IS NULL AS filled FROM f""")
def resampled_series(spark, d):
    return _resampled(table(spark, d, "events"))


def _resampled(events):
    e = events.select("event_type", F.expr("unix_micros(cast(ts as timestamp)) / 1000000.0D").alias("x"), "value")
    return series.resample(e, "event_type", "x", "value", 1800.0)


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 10 <> 3 THEN value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
w AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS l, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER b AS lp, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r, count(*) FILTER (value IS NULL) OVER (PARTITION BY user_id) AS gaps, count(*) OVER (PARTITION BY user_id) AS n
  FROM e WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, coalesce(value, CASE WHEN gaps <= greatest(2, floor(0.2 * n)) THEN coalesce(r + (l - r) / pow(2, p - lp), l, r) END) AS value FROM w""")
def repaired_gaps(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 != 3, F.col("value")).alias("value"))
    return series.repair_gaps(e, "user_id", "event_id", "value")


_TERMS = "t AS (SELECT p_partkey AS doc, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+'))) AS term FROM part)"


def _terms(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit("[a-z0-9]+"), F.lit(0)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.explode(words).alias("term"))


@query(f"""WITH {_TERMS}, n AS (SELECT count(DISTINCT doc) AS docs FROM t), f AS (SELECT term, count(DISTINCT doc) AS df FROM t GROUP BY 1 ORDER BY df DESC, term LIMIT 120),
p AS (SELECT x.term AS a, y.term AS b, count(*) AS count FROM t x JOIN t y ON x.doc = y.doc AND x.term < y.term WHERE x.term IN (SELECT term FROM f) AND y.term IN (SELECT term FROM f) GROUP BY 1, 2)
SELECT a, b, count, round(count / (fa.df + fb.df - count)::DOUBLE, 4) AS jaccard, round(log2(count * docs / (fa.df * fb.df)::DOUBLE), 4) AS pmi FROM p JOIN f fa ON fa.term = a JOIN f fb ON fb.term = b CROSS JOIN n ORDER BY count DESC, jaccard DESC, a, b LIMIT 480""")
def keyword_network(spark, d):
    return pairs.term_network(_terms(spark, d), "doc", "term")


@query("""WITH w AS (SELECT doc_id, term, count(*) AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM w), f AS (SELECT term, count(*) AS df FROM w GROUP BY 1),
r AS (SELECT doc_id, term, round(ln(1 + weight::DOUBLE) * ((ln((n + 1) / (df + 1)::DOUBLE) + 1) * CASE WHEN df / n::DOUBLE > 0.72 THEN 0.18::DOUBLE ELSE 1.0 END), 9) AS w FROM w JOIN f USING (term) CROSS JOIN n),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) <= 48)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM k""")
def tfidf_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("terms"))
    return vectors.tfidf(vectors.term_counts(docs, "doc_id", "terms"), "doc_id").withColumnRenamed("id", "doc_id").select("doc_id", "term", F.round("w", 6).alias("w"))


def _part_vectors(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit("[a-z0-9]+"), F.lit(0)).alias("terms"))
    return durable(vectors.tfidf(vectors.term_counts(docs, "doc", "terms"), "doc"))


@query()
def similarity_links(spark, d):
    return vectors.similarity(_part_vectors(spark, d), "doc")


@query()
def topic_cohesion(spark, d):
    v = _part_vectors(spark, d)
    assigned = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("topic"))
    return vectors.cosine_to_centroid(v, vectors.centroids(v, assigned, "doc", "topic"), assigned, "doc", "topic")


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x::DOUBLE) AS m FROM e GROUP BY 1, 2)
SELECT vec_id, label, round(sum(x::DOUBLE * m) / (sqrt(sum(x::DOUBLE * x::DOUBLE)) * sqrt(sum(m * m))), 5) AS cosine FROM e JOIN c USING (label, i) GROUP BY 1, 2""")
def centroid_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("m"))
    dot = F.sum(F.col("x") * F.col("m")) / (F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("m") * F.col("m"))))
    return e.join(c, ["label", "i"]).groupBy("vec_id", "label").agg(F.round(dot, 5).alias("cosine"))


@query("""WITH w AS (SELECT lang, term, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM documents) GROUP BY 1, 2)
SELECT lang, term, mentions, docs FROM w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY mentions DESC, term) <= 20""")
def word_cloud(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    counted = docs.groupBy("lang", "term").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))
    return pairs.top_per_document(counted, "lang", "term", "mentions", 20)


# graphs over nation, region, customers and suppliers

_GRAPH = """n AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label, 1.0::DOUBLE AS importance, 1.0::DOUBLE AS confidence FROM region
UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, 0.8, 0.9 FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_suppkey % 100 / 100.0, 0.55::DOUBLE + s_suppkey % 45 / 100.0 FROM supplier),
e AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'IN' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'OF' FROM supplier)"""


def _graph(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda t, i, kind, label, imp, conf: t.select(i.alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), imp.alias("importance"), conf.alias("confidence"))
    nodes = (
        node(r, name("r", "r_regionkey"), "region", "r_name", F.lit(1.0), F.lit(1.0))
        .unionByName(node(n, name("n", "n_nationkey"), "nation", "n_name", F.lit(0.8), F.lit(0.9)))
        .unionByName(node(s, name("s", "s_suppkey"), "supplier", "s_name", F.col("s_suppkey") % 100 / 100.0, 0.55 + F.col("s_suppkey") % 45 / 100.0))
    )
    edges = n.select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"), F.lit("IN").alias("type")).unionByName(s.select(name("s", "s_suppkey").alias("source"), name("n", "s_nationkey").alias("target"), F.lit("OF").alias("type")))
    return nodes, edges


@query(f"""WITH RECURSIVE {_GRAPH}, l AS (SELECT source, target FROM e UNION SELECT target, source FROM e), b AS (SELECT 's1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM b JOIN l ON source = id WHERE depth < 7),
m AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1) SELECT m.id, m.depth, (SELECT min(p.id) FROM m p JOIN l ON p.id = l.source AND l.target = m.id WHERE p.depth = m.depth - 1) AS parent FROM m""")
def bfs_levels(spark, d):
    return graphs.bfs(_graph(spark, d)[1], "s1", max_depth=7)


#: Suppliers and the orders that have parts of them as a graph.
_TRADE = "e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'o' || l_orderkey AS target FROM lineitem)"


def _trade(spark, d):
    items = table(spark, d, "lineitem")
    return items.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("target")).distinct()


@query(f"""WITH RECURSIVE {_TRADE}, l AS (SELECT source, target FROM e UNION SELECT target, source FROM e), z AS (SELECT min(source) AS a, max(source) AS b FROM e),
f AS (SELECT a AS id, 0 AS depth FROM z UNION SELECT target, depth + 1 FROM f JOIN l ON source = id WHERE depth < 8), fd AS (SELECT id, min(depth) AS depth FROM f GROUP BY 1),
g AS (SELECT b AS id, 0 AS depth FROM z UNION SELECT target, depth + 1 FROM g JOIN l ON source = id WHERE depth < 8), gd AS (SELECT id, min(depth) AS depth FROM g GROUP BY 1),
o AS (SELECT fd.id, fd.depth FROM fd JOIN gd USING (id) WHERE fd.depth + gd.depth = (SELECT depth FROM fd WHERE id = (SELECT b FROM z))),
w AS (SELECT a AS id, 0 AS position FROM z UNION ALL SELECT (SELECT min(o.id) FROM o JOIN l ON l.target = o.id AND l.source = w.id WHERE o.depth = w.position + 1), position + 1 FROM w WHERE position < (SELECT depth FROM fd WHERE id = (SELECT b FROM z)))
SELECT CAST(position AS INTEGER) AS position, id FROM w WHERE id IS NOT NULL""")
def shortest_path(spark, d):
    """From the first to the last supplier, by name, over the orders that they share with others."""
    edges = durable(_trade(spark, d))
    ends = edges.agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    return graphs.shortest_path(edges, ends["a"], ends["b"])


@query(f"WITH {_GRAPH} SELECT source, target, type FROM e WHERE type = 'OF' AND target = 'n3'")
def relation_filter(spark, d):
    edges = _graph(spark, d)[1]
    return graphs.relation_links(edges, ["of"]).filter("target = 'n3'")


@query("""WITH e AS (SELECT l_orderkey AS source, l_suppkey AS target, CASE l_returnflag WHEN 'R' THEN 'CITES' WHEN 'A' THEN 'AUTHOR_OF' ELSE 'HAS_TOPIC' END AS type FROM lineitem),
m AS (SELECT 'all' AS mode, * FROM e UNION ALL SELECT 'references', * FROM e WHERE type = 'CITES' AND source = 7 UNION ALL SELECT 'cited_by', * FROM e WHERE type = 'CITES' AND target = 7 UNION ALL SELECT 'authors', * FROM e WHERE type = 'AUTHOR_OF' UNION ALL SELECT 'topics', * FROM e WHERE type = 'HAS_TOPIC')
SELECT mode, count(*) AS edges, CAST(sum(source + target) AS BIGINT) AS total FROM m GROUP BY 1""")
def relation_modes(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "CITES").when(F.col("l_returnflag") == "A", "AUTHOR_OF").otherwise("HAS_TOPIC")
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("type"))
    modes = ["all", "references", "cited_by", "authors", "topics"]
    fits = F.array_compact(F.array(*[F.when(graphs.mode_matches(m, 7), F.lit(m)) for m in modes]))
    return e.select("source", "target", F.explode(fits).alias("mode")).groupBy("mode").agg(F.count("*").alias("edges"), F.sum(F.col("source") + F.col("target")).alias("total"))


@query("""WITH n AS (SELECT p_partkey AS id, (36.0::DOUBLE + p_size / 51.0::DOUBLE * 728 - 400) * 1.5::DOUBLE + 400 + 20 AS x, (42.0::DOUBLE + p_partkey % 100 / 100.0::DOUBLE * 508 - 300) * 1.5::DOUBLE + 300 - 10 AS y FROM part)
SELECT id FROM n WHERE x BETWEEN -30 AND 830 AND y BETWEEN -30 AND 630""")
def viewport(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 51.0).alias("x"), (F.col("p_partkey") % 100 / 100.0).alias("y"))
    return n.filter(graphs.in_view(F.col("x"), F.col("y"), 800.0, 600.0, 1.5, 20.0, -10.0, 30.0)).select("id")


@query("""WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem), p AS (SELECT x.i AS a, y.i AS b FROM u x JOIN u y ON x.g = y.g AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 3),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS id, a AS reach FROM l UNION SELECT c.id, l.b FROM c JOIN l ON c.reach = l.a) SELECT id, min(reach) AS component FROM c GROUP BY 1""")
def connected_components(spark, d):
    shared = pairs.shared_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return graphs.components(shared.filter("shared >= 3").select(F.col("a").alias("source"), F.col("b").alias("target")))


@query()
def sampled_betweenness(spark, d):
    return graphs.betweenness(_graph(spark, d)[1], 48)


@query(f"WITH {_GRAPH}, l AS (SELECT source, target FROM e UNION SELECT target, source FROM e) SELECT source AS id, count(*) AS degree FROM l GROUP BY 1")
def adjacency_degrees(spark, d):
    return graphs.degrees(_graph(spark, d)[1])


@query(f"WITH {_GRAPH}, l AS (SELECT target AS id FROM e WHERE source = 'n3' UNION SELECT source FROM e WHERE target = 'n3'), f AS (SELECT n.* FROM n JOIN l USING (id)) SELECT id, type, label, importance, confidence, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 5 AS has_more FROM f ORDER BY importance DESC, label, id LIMIT 3 OFFSET 2")
def neighbour_page(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.neighbour_page(nodes, edges, "n3", 2, 3)


@query(f"WITH {_GRAPH} SELECT type, count(*) AS count FROM n GROUP BY 1")
def node_type_counts(spark, d):
    return graphs.type_counts(_graph(spark, d)[0])


@query(f"WITH {_GRAPH}, k AS (SELECT id FROM n WHERE type IN ('nation', 'region') AND contains(lower(label || ' ' || type), 'a')) SELECT source, target, type FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def induced_subgraph(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.induced(nodes, edges, ["nation", "region"], "a")[1].select("source", "target", "type")


@query(f"WITH {_GRAPH}, k AS (SELECT * FROM n WHERE confidence >= 0.6), x AS (SELECT source, target, unnest([source, target]) AS missing FROM e) SELECT * FROM x WHERE missing NOT IN (SELECT id FROM k)")
def dangling_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return graphs.dangling(nodes.filter(~graphs.needs_review(F.col("confidence"))), edges)


@query("SELECT k AS id, min_by(l, o) AS label FROM (SELECT p_name AS k, p_type AS l, (0, p_type) AS o FROM part WHERE p_size < 10 UNION ALL SELECT p_name, p_brand, (1, p_brand) FROM part) GROUP BY 1")
def merged_graphs(spark, d):
    part = table(spark, d, "part")
    a = part.filter("p_size < 10").select(F.col("p_name").alias("id"), F.col("p_type").alias("label"))
    return graphs.merge_graphs([a, part.select(F.col("p_name").alias("id"), F.col("p_brand").alias("label"))], ["id"])


@query("SELECT DISTINCT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'F'")
def facet_intersection(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = F.array(F.struct(F.lit("segment").alias("facet"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("status").alias("facet"), F.col("o_orderstatus").alias("value")))
    return graphs.facet_visible(x.select(F.col("o_orderkey").alias("id"), F.explode(facts).alias("f")).select("id", "f.*"), {"segment": ["BUILDING", "MACHINERY"], "status": ["F"]})


@query(f"WITH {_GRAPH}, l AS (SELECT source, target FROM e UNION SELECT target, source FROM e), a AS (SELECT 'r1' AS id UNION SELECT target FROM l WHERE source = 'r1') SELECT id FROM a UNION SELECT target FROM l JOIN a ON source = id")
def frontier_expansion(spark, d):
    return graphs.with_neighbours(spark.range(1).select(F.lit("r1").alias("id")), _graph(spark, d)[1], 2)


#: A view of the parts: zoomed in and moved, so that some are out of sight.
_SEEN = {"width": 1000, "height": 700, "scale": 1.2, "pan_x": 500}
_PINS, _PINNED = ["part:7", "part:11"], ["7:3", "12:2"]
_TYPES = "CASE p_partkey % 9 WHEN 0 THEN 'Paper' WHEN 1 THEN 'method' WHEN 2 THEN 'dataset' WHEN 3 THEN 'claim' WHEN 4 THEN 'author' WHEN 5 THEN 'limitation' WHEN 6 THEN 'table' ELSE p_type END"
_GROUP = " ".join(f"WHEN lower(type) IN ({', '.join(repr(t) for t in types)}) THEN '{name}'" for name, types in detail.GROUPS.items())
_LOD = f"""n AS (SELECT 'part:' || p_partkey AS id, {_TYPES} AS type, p_name || ' ' || p_partkey AS label, p_size / 51.0::DOUBLE AS x, p_partkey % 100 / 100.0::DOUBLE AS y, (37 * p_partkey) % 100 / 100.0::DOUBLE AS importance, CASE WHEN p_partkey % 50 = 3 THEN 0.0 ELSE 0.55 + (17 * p_partkey) % 45 / 100.0::DOUBLE END AS confidence, p_size % 3 AS evidence, p_size % 7 = 0 AS needs_review FROM part),
l AS (SELECT l_orderkey || ':' || row_number() OVER o AS id, 'part:' || l_partkey AS source, 'part:' || lead(l_partkey) OVER o AS target, lower(flag) AS type, l_quantity / 50.0::DOUBLE AS confidence FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS flag FROM lineitem) WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
e AS (SELECT * FROM l WHERE target IS NOT NULL), d AS (SELECT id, least(1000, count(*)) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY 1),
c AS (SELECT n.*, coalesce(degree, 0) AS degree, id IN ('part:7', 'part:11') AS pinned, CASE {_GROUP} ELSE 'concept' END AS g, least(5, CAST(floor(x * 6) AS INTEGER)) AS cx, least(3, CAST(floor(y * 4) AS INTEGER)) AS cy FROM n LEFT JOIN d USING (id)
  WHERE (SELECT count(*) FROM n) <= 180 OR id IN ('part:7', 'part:11') OR ((36 + x * 928 - 500) * 1.2 + 500 + 500 BETWEEN -120 AND 1120 AND (42 + y * 608 - 350) * 1.2 + 350 BETWEEN -120 AND 820)),
b AS (SELECT CASE WHEN (SELECT count(*) FROM n) <= 180 THEN greatest(1, (SELECT count(*) FROM n)) ELSE 480 END AS budget),
r AS (SELECT c.*, row_number() OVER (ORDER BY pinned DESC, lower(type) = 'paper' DESC, importance DESC, degree DESC, evidence DESC, confidence DESC, lower(label) DESC, id DESC) AS rk, count(*) OVER () AS found, budget, least(32, greatest(8, budget // 8)) AS reserve FROM c, b),
w AS (SELECT *, found <= budget OR rk <= greatest(budget - reserve, count(*) FILTER (pinned) OVER ()) AS drawn FROM r),
s AS (SELECT g, cx, cy, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g, cx, cy) AS nth, min(reserve) AS reserve FROM w WHERE NOT drawn GROUP BY g, cx, cy),
k AS (SELECT * FROM s WHERE nth <= reserve),
f AS (SELECT s.g, s.cx, s.cy, k.g AS kg, k.cx AS kx, k.cy AS ky FROM s, k QUALIFY row_number() OVER (PARTITION BY s.g, s.cx, s.cy ORDER BY CASE WHEN s.nth <= s.reserve AND s.nth <> k.nth THEN 1 ELSE 0 END, CASE WHEN s.g = k.g THEN 0 ELSE 10 END + abs(s.cx - k.cx) + abs(s.cy - k.cy), k.g, k.cx, k.cy) = 1),
p AS (SELECT w.*, CASE WHEN drawn THEN id ELSE 'cluster:' || kg || ':' || kx || ':' || ky END AS target, kg FROM w LEFT JOIN f USING (g, cx, cy))"""
_NAMED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detail.LABELS.items())


def _view(spark, d):
    n = table(spark, d, "part").selectExpr(
        "concat('part:', p_partkey) AS id", f"{_TYPES} AS type", "concat_ws(' ', p_name, p_partkey) AS label", "p_size / 51.0D AS x", "p_partkey % 100 / 100.0D AS y", "(37 * p_partkey) % 100 / 100.0D AS importance",
        "CASE WHEN p_partkey % 50 = 3 THEN NULL ELSE 0.55D + (17 * p_partkey) % 45 / 100.0D END AS confidence", "p_size % 3 AS evidence", "p_size % 7 = 0 AS needs_review",
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    links = table(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", F.row_number().over(w)).alias("id"), F.concat(F.lit("part:"), "l_partkey").alias("source"), F.concat(F.lit("part:"), F.lead("l_partkey").over(w)).alias("target"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.lower("l_returnflag")).alias("type"), (F.col("l_quantity") / 50.0).alias("confidence"),
    )
    return detail.project(n, links.filter("target IS NOT NULL"), _PINS, _PINNED, **_SEEN)


@query(f"""WITH {_LOD} SELECT id, type, label, false AS aggregate, 1 AS members, importance, confidence, needs_review, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE drawn
UNION ALL SELECT target, 'cluster', (CASE kg {_NAMED} END) || ' · ' || count(*), true, count(*), max(importance), avg(confidence), bool_or(needs_review), round(avg(x), 6), round(avg(y), 6) FROM p WHERE NOT drawn GROUP BY target, kg""")
def level_of_detail(spark, d):
    return _view(spark, d).nodes.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query(f"""WITH {_LOD}, m AS (SELECT e.*, a.target AS s, b.target AS t FROM e JOIN p a ON a.id = e.source JOIN p b ON b.id = e.target WHERE a.target <> b.target),
u AS (SELECT source, target, type, false AS aggregate, 1 AS count, confidence, CASE WHEN id IN ('7:3', '12:2') THEN 0 ELSE 1 END AS o, confidence AS v, id FROM m WHERE s = source AND t = target
  UNION ALL SELECT s, t, upper(coalesce(nullif(type, ''), 'RELATED_TO')), true, count(*), avg(confidence), 2, count(*), NULL FROM m WHERE NOT (s = source AND t = target) GROUP BY s, t, upper(coalesce(nullif(type, ''), 'RELATED_TO')))
SELECT source, target, type, aggregate, count, round(confidence, 9) AS confidence FROM u ORDER BY o, v DESC, source, target, type, id LIMIT (SELECT greatest(400, 3 * budget) FROM b)""")
def level_of_detail_links(spark, d):
    return _view(spark, d).edges.withColumn("confidence", F.round("confidence", 9))


@query("SELECT a.p_partkey AS id FROM part a WHERE p_size BETWEEN 10 AND 20")
def windowed_subgraph(spark, d):
    return _parts(spark, d).filter(F.col("year").between(2000, 2010)).select("id")


@query("SELECT p_name AS key, count(DISTINCT p_brand) AS records, min(p_brand) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def shared_labels(spark, d):
    return compare.shared_nodes(table(spark, d, "part").withColumnRenamed("p_name", "key"), "p_brand", "key")


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?。！？]')) AS ends, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS compact FROM documents")
def text_metrics(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.sentence_ends(t).cast("long").alias("ends"), text.compact_length(t).cast("long").alias("compact"))
