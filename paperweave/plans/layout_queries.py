"""Layout elements of papers that are made from the parts and line items: scores, captions, matches, fusion, comparison, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..storage import table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# scores

_LATEX = ["E = mc^2", "x", "\\frac{a}{b} = c (12)", "the sum of all terms with care is taken from this", "", "Some words that end in a full stop at last."]
_PICK = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LATEX)) + " END"


def _columns(array: str) -> dict[str, str]:
    """An element's columns by expressions that hold in both engines but for how an array is written."""
    a = (lambda *x: f"array({', '.join(x)})") if array == "array" else (lambda *x: f"[{', '.join(x)}]")
    d = "D" if array == "array" else "::DOUBLE"
    text = "STRING" if array == "array" else "VARCHAR"
    cells = f"CASE p_partkey % 5 WHEN 1 THEN {a(a(repr('A')))} WHEN 2 THEN {a(a(repr('a'), repr('b')), a(repr(' '), repr('')), a(repr(''), repr('')))} WHEN 3 THEN {a(a(repr('Name'), repr('Capacity')), a('p_name', repr('5 mAh')), a('p_brand', repr('7 cm')))} WHEN 4 THEN {a(a(repr('a'), repr('b')), a(repr('c')))} END"
    x, y = f"(p_size * 8.0{d} - 20.0{d})", f"(p_partkey % 60 * 12.0{d})"
    return {
        "kind": "CASE p_size % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'chart' WHEN 3 THEN 'formula' ELSE 'table' END",
        "box": f"CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {a(x, y, f'{x} + 2.0{d} + p_size * 9.0{d}', f'{y} + 5.0{d} + p_partkey % 7 * 90.0{d}')} END",
        "page_size": f"CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE {a(f'400.0{d}', f'600.0{d}')} END",
        "caption": "CASE WHEN p_partkey % 3 = 0 THEN 'Table 1' ELSE '' END",
        "png": "CASE WHEN p_partkey % 2 = 0 THEN 'x.png' END",
        "latex": _PICK.replace("\\", "\\\\") if array == "array" else _PICK,
        "cells": cells,
        "engines": f"CASE WHEN p_partkey % 4 = 0 THEN {a(repr('pymupdf'), repr('mineru'))} ELSE {a(repr('pymupdf'))} END",
        "flags": f"CASE WHEN p_partkey % 17 = 0 THEN {a(repr('duplicate_of_table'))} ELSE CAST({a()} AS {'array<string>' if array == 'array' else 'VARCHAR[]'}) END",
        "evidence": f"CASE WHEN p_size % 4 < 2 THEN p_size / 50.0{d} END",
        "match": f"CASE WHEN p_size % 4 = 3 THEN p_size / 50.0{d} END",
        "text_strategy": "p_partkey % 13 = 0",
        "number": f"CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS {text}) END",
        "manual": "p_partkey % 19 = 0",
    }


def _elements(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS doc", "0 AS page", "p_partkey AS pos", "CAST(p_partkey AS STRING) AS id", *[f"{e} AS {c}" for c, e in _columns("array").items()])


_FLAG = lambda test, name: f"CASE WHEN {test} THEN '{name}' END"
_FLAGS = lambda *tests: f"list_filter([{', '.join(_FLAG(t, n) for t, n in tests)}], lambda x: x IS NOT NULL)"
_B = lambda test, value: f"CASE WHEN {test} THEN {value} ELSE 0 END"
_OUT = ("outside", "bbox_out_of_page")
_QUALITY = f"""e AS (SELECT p_partkey AS doc, 0 AS page, CAST(p_partkey AS VARCHAR) AS id, {', '.join(f'{e} AS {c}' for c, e in _columns('list').items())} FROM part), m AS (
  SELECT *, coalesce(box[3] > box[1] AND box[4] > box[2], false) AS boxed, caption <> '' AS captioned, CASE WHEN page_size IS NULL OR box IS NULL THEN 0 ELSE greatest(0, (box[3] - box[1]) * (box[4] - box[2])) / greatest(1, page_size[1] * page_size[2]) END AS area,
    coalesce(page_size IS NOT NULL AND (box[1] < 0 OR box[2] < 0 OR box[3] > page_size[1] OR box[4] > page_size[2]), false) AS outside, coalesce(box[4] < page_size[2] * 0.08 OR box[2] > page_size[2] * 0.92, false) AS margin,
    len(engines) = 2 AS pair, coalesce(len(cells), 0) AS nrows, coalesce(list_max(list_transform(cells, lambda r: len(r))), 0) AS ncols,
    coalesce(len(list_filter(flatten(cells), lambda c: trim(c) <> '')) / len(flatten(cells)), 0) AS share, trim(latex) AS tex FROM e
), t AS (
  SELECT *, nrows <= 1 OR ncols <= 1 AS weak, text_strategy AND NOT captioned AS loose, list_contains(flags, 'duplicate_of_table') AS again, tex LIKE '%)' AND contains(right(tex, 8), '(') OR coalesce(number, '') <> '' AS numbered,
    len(regexp_extract_all(tex, '[A-Za-z]{{3,}}')) >= 6 AND (list_has_any(list_transform(regexp_extract_all(tex, '[A-Za-z]{{3,}}'), lambda w: lower(w)), string_split('the and with from this that where when for into were was', ' ')) OR regexp_matches(tex, '[.!?]$')) AS noise FROM m
), s AS (
  SELECT *, CASE WHEN kind = 'table' THEN 0.35 + {_B('nrows >= 2', 0.15)} + {_B('ncols >= 2', 0.15)} + {_B('share >= 0.6', 0.12)} + {_B('captioned', 0.08)} + {_B('boxed', 0.08)} - {_B('weak', 0.18)} + {_B('pair', 0.12)} + coalesce(greatest(-0.08, least(0.10, (evidence - 0.58) * 0.25)), 0) - {_B('loose', 0.3)} - {_B('area > 0.58', 0.24)}
    WHEN kind = 'formula' THEN 0.35 + {_B("tex <> ''", 0.22)} + CASE WHEN boxed THEN 0.18 ELSE -0.12 END - {_B('length(tex) <= 2', 0.18)} + {_B("regexp_matches(tex, '=|\\\\frac|\\^|_|\\\\sum|\\\\int')", 0.12)} + {_B('numbered', 0.05)} + {_B('pair', 0.1)} + coalesce(greatest(-0.08, least(0.08, (match - 0.35) * 0.20)), 0) - {_B('noise', 0.16)}
    ELSE 0.45 + CASE WHEN NOT boxed THEN -0.15 WHEN area < 0.01 THEN -0.12 ELSE 0.08 END + {_B('captioned', 0.12)} + {_B('png IS NOT NULL', 0.1)} - {_B('again', 0.2)} - {_B('margin', 0.12)} + {_B('pair', 0.08)} END::DOUBLE AS score,
    CASE WHEN kind = 'table' THEN {_FLAGS(('NOT boxed', 'missing_bbox'), ('weak', 'weak_table_shape'), ('evidence < 0.45', 'weak_table_evidence'), ('share < 0.35 AND nrows >= 2 AND ncols >= 2', 'sparse_table_cells'), ('loose', 'unanchored_text_table'), ('area > 0.58', 'page_sized_table'), _OUT)}
    WHEN kind = 'formula' THEN {_FLAGS(('NOT boxed', 'missing_bbox'), ('length(tex) <= 2', 'short_latex'), ('NOT pair', 'single_engine_formula'), ('match < 0.35', 'weak_formula_match'), ('noise', 'sentence_like_formula'), _OUT)}
    ELSE {_FLAGS(('NOT boxed', 'missing_bbox'), ('boxed AND area < 0.01', 'small_figure'), ('again', 'duplicate_of_table'), ('margin', 'page_margin'), _OUT)} END AS added FROM t
), q AS (
  SELECT * REPLACE (list_concat(flags, list_filter(added, lambda f: NOT list_contains(flags, f))) AS flags), round(greatest(0.05, least(0.99, score)), 3) AS confidence FROM s
)"""


@query(f"WITH {_QUALITY} SELECT doc, kind, confidence, array_to_string(flags, ' ') AS flags, confidence < 0.65 OR len(flags) > 0 AS needs_review FROM q")
def element_scores(spark, d):
    judged = layout.quality(layout.elements_of(_elements(spark, d)))
    return judged.select("doc", "kind", "confidence", F.array_join("flags", " ").alias("flags"), "needs_review")


_LACKS = "array_to_string(list_filter(CASE WHEN kind = 'table' THEN [CASE WHEN nrows = 0 THEN 'cells' END, 'json', 'csv', CASE WHEN png IS NULL THEN 'png' END] WHEN kind = 'formula' THEN [CASE WHEN tex = '' THEN 'latex' END, CASE WHEN png IS NULL THEN 'png' END] ELSE [CASE WHEN png IS NULL THEN 'png' END] END, lambda x: x IS NOT NULL), ' ')"
_ODDS = f"array_to_string(list_sort(list_filter(flags, lambda f: f IN ({', '.join(map(repr, layout.CONFLICTS))}))), ' ')"


@query(f"""WITH {_QUALITY}, i AS (SELECT doc, kind, 'review' AS issue, array_to_string(flags, ' ') AS detail, confidence < 0.65 OR len(flags) > 0 AS has FROM q
UNION ALL SELECT doc, kind, 'low_confidence', 'x', confidence < 0.65 FROM q
UNION ALL SELECT doc, kind, 'engine_conflict', {_ODDS}, {_ODDS} <> '' OR (pair AND (coalesce(match < 0.55, false) OR coalesce(evidence < 0.55, false))) FROM q
UNION ALL SELECT doc, kind, 'missing_artifacts', {_LACKS}, {_LACKS} <> '' FROM q UNION ALL SELECT doc, kind, 'manual_override', '', manual FROM q)
SELECT doc, kind, issue, detail FROM i WHERE has""")
def quality_issues(spark, d):
    judged = layout.quality(layout.elements_of(_elements(spark, d)))
    found = layout.quality_issues(judged)
    return found.select("doc", "kind", "issue", F.when(F.col("issue") == "low_confidence", "x").otherwise(F.col("detail")).alias("detail"))


@query(f"WITH {_QUALITY} SELECT doc % 10 AS doc, CASE kind WHEN 'table' THEN 'tables' WHEN 'formula' THEN 'formulas' ELSE 'figures' END AS bucket, count(*) AS count, count(*) FILTER (confidence < 0.65 OR len(flags) > 0) AS needs_review FROM q GROUP BY 1, 2")
def quality_summary(spark, d):
    judged = layout.quality(layout.elements_of(_elements(spark, d)))
    return layout.quality_summary(judged.withColumn("doc", F.col("doc") % 10))


# captions, matches, fusion


def _boxes(spark, d, shift: float = 0.0, where: str = "true"):
    """Line items as elements on pages of orders; those of half of the suppliers are tables, a third of the others formulas without a place."""
    x, y = F.col("l_quantity") + shift, F.col("l_partkey") % 5 * 4.0 + shift
    kind = F.when(F.col("l_suppkey") % 2 == 0, "table").when(F.col("l_suppkey") % 3 == 0, "formula").otherwise("figure")
    id_ = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    # rows of one page and id become one while they are narrow
    rows = table(spark, d, "lineitem").filter(where).select("l_orderkey", id_.alias("_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").dropDuplicates(["l_orderkey", "_id"])
    return rows.select(
        F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("_id").alias("id"), kind.alias("kind"),
        F.when((kind != "formula") | (F.col("l_partkey") % 4 == 0), F.array(x, y, x + 12.0, y + 9.0)).alias("box"), F.array(F.lit(70.0), F.lit(40.0)).alias("page_size"),
        F.when(kind == "formula", F.concat(F.lit("x_"), (F.col("l_partkey") % 3).cast("string"), F.lit(" = "), (F.col("l_quantity") % 2).cast("int").cast("string"))).alias("latex"),
        F.when(kind == "table", F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("l_tax").cast("string"), F.lit("")))).alias("cells"),
    )


@query()
def greedy_matches(spark, d):
    a, b = layout.elements_of(_boxes(spark, d, 0.0, "l_partkey % 2 = 0")), layout.elements_of(_boxes(spark, d, 1.0, "l_partkey % 3 = 0"))
    return layout.match_engines(a, b).select("page", "family", F.col("e.id").alias("id"), F.col("a.id").alias("match"), "score")


def _fused(spark, d):
    blocks = table(spark, d, "lineitem").select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block"), F.concat(F.lit("Table "), F.col("l_linenumber").cast("string")).alias("text"), F.array(F.col("l_quantity"), F.lit(30.0), F.col("l_quantity") + 9.0, F.lit(33.0)).alias("box"))
    return layout.fuse(_boxes(spark, d, 0.0, "l_partkey % 2 = 0"), _boxes(spark, d, 1.0, "l_partkey % 3 = 0"), blocks)


@query()
def fused_elements(spark, d):
    return _fused(spark, d).elements.select("page", "kind", "id", F.size("engines").alias("engines"), "caption", "confidence", F.array_join("flags", " ").alias("flags"), "needs_review")


@query()
def fusion_report(spark, d):
    return _fused(spark, d).report


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS page, l_linenumber || '-' || l_partkey AS id, l_quantity AS x0, l_partkey % 40 * 3.0::DOUBLE AS y0, l_tax < 0.04 AS e, CASE WHEN l_suppkey % 2 = 0 THEN 'table' ELSE 'chart' END AS kind,
  CASE l_suppkey % 4 WHEN 0 THEN 'Fig. ' || l_linenumber || 'a' WHEN 1 THEN ' table ' || l_linenumber WHEN 2 THEN repeat('word ', 50) ELSE 'Some words' END AS text FROM lineitem),
p AS (SELECT e.page, e.id, e.kind, c.id AS block, trim(c.text) AS text, greatest(least(e.x0 + 12, c.x0 + 8) - greatest(e.x0, c.x0), 0) / 8 AS o, c.y0 - e.y0 - 9 AS below, e.y0 - c.y0 - 4 AS above FROM l e JOIN l c ON e.page = c.page AND e.e AND NOT c.e),
s AS (SELECT *, CASE WHEN below >= 0 THEN below WHEN above >= 0 THEN above END AS gap, CASE kind WHEN 'table' THEN regexp_matches(text, '(?i)^\\s*table\\s*\\d+') ELSE regexp_matches(text, '(?i)^\\s*fig(ure)?\\.?\\s*\\d+') END AS m FROM p),
g AS (SELECT *, CASE WHEN m THEN 0.5 ELSE 0.15 END + CASE WHEN (kind = 'table' AND above >= 0) OR (kind = 'chart' AND below >= 0) THEN 0.2 ELSE 0 END + least(0.25, o * 0.25) + greatest(0, 0.2 - gap / 12 * 0.2) AS score FROM s WHERE o >= 0.25 AND gap <= 12 AND (m OR length(text) <= 180))
SELECT page, id, kind, text[1:300] AS caption, round(score, 3)::DOUBLE AS score FROM g QUALIFY row_number() OVER (PARTITION BY page, id, kind ORDER BY round(score, 9) DESC, gap, block, text) = 1""")
def captions(spark, d):
    """Line items as elements or blocks of text on pages of orders, 100 high."""
    x, y = F.col("l_quantity"), F.col("l_partkey") % 40 * 3.0
    n = F.col("l_linenumber").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("Fig. "), n, F.lit("a")), F.concat(F.lit(" table "), n), F.repeat(F.lit("word "), F.lit(50)), F.lit("Some words")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("doc"), F.col("l_orderkey").alias("page"), F.concat_ws("-", n, F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "table").otherwise("chart").alias("kind"), x.alias("x"), y.alias("y"), text.alias("text"), (F.col("l_tax") < 0.04).alias("e")).distinct()
    seen = rows.filter("e").select("doc", "page", F.struct("id", "kind", "x", "y", "text").alias("id"), "kind", F.expr("array(x, y, x + 12.0D, y + 9.0D)").alias("box"), F.array(F.lit(100.0), F.lit(100.0)).alias("page_size"))
    blocks = rows.filter("NOT e").select("doc", "page", F.struct("id", F.trim("text").alias("t")).alias("block"), "text", F.expr("array(x, y, x + 8.0D, y + 4.0D)").alias("box"))
    return layout.nearest_caption(seen, blocks).select("page", F.col("id.id").alias("id"), F.col("id.kind").alias("kind"), "caption", "score").distinct()


# comparison

_KIND = "CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'chart' ELSE 'formula' END"
#: Parts as expected and actual elements, five a document; equal ids match, as no other boxes or texts are alike.
_HELD = f"""w AS (SELECT p_partkey AS k, p_partkey // 5 AS doc, p_partkey % 5 AS pos, {_KIND} AS kind, p_size AS z FROM part WHERE p_partkey % 7 <> 0),
h AS (SELECT p_partkey AS k, p_partkey // 5 AS doc, CASE WHEN p_size % 10 = 0 THEN 9 - p_partkey % 5 ELSE p_partkey % 5 END AS pos, CASE WHEN p_partkey % 23 = 0 THEN 'table' ELSE {_KIND} END AS kind FROM part WHERE p_partkey % 6 <> 0),
b AS (SELECT w.*, h.pos AS place FROM w JOIN h USING (k, doc, kind)),
n AS (SELECT doc, kind, count(DISTINCT w.k) AS expected, count(DISTINCT h.k) AS actual, count(DISTINCT b.k) AS matched FROM (SELECT doc, kind FROM w UNION SELECT doc, kind FROM h) LEFT JOIN w USING (doc, kind) LEFT JOIN h USING (doc, kind) LEFT JOIN b USING (doc, kind) GROUP BY 1, 2),
i AS (SELECT doc, kind, 'bbox_mismatch' AS code, k AS expected, k AS actual FROM b WHERE k % 3 > 0
  UNION ALL SELECT doc, kind, 'needs_review_mismatch', k, k FROM b WHERE z % 5 = 1 AND z % 2 = 0 UNION ALL SELECT doc, kind, 'caption_mismatch', k, k FROM b WHERE z % 6 = 0
  UNION ALL SELECT doc, kind, 'table_shape_mismatch', k, k FROM b WHERE kind = 'table' AND k % 2 = 0 UNION ALL SELECT doc, kind, 'latex_mismatch', k, k FROM b WHERE kind = 'formula' AND z % 8 = 3
  UNION ALL SELECT doc, kind, 'formula_number_mismatch', k, k FROM b WHERE kind = 'formula' AND k % 4 = 1
  UNION ALL SELECT doc, kind, 'missing_element', k, NULL FROM w WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT doc, kind, 'unexpected_element', NULL, k FROM h WHERE k NOT IN (SELECT k FROM b)
  UNION ALL SELECT doc, kind, 'count_mismatch', NULL, NULL FROM n WHERE expected <> actual
  UNION ALL SELECT DISTINCT doc, NULL, 'reading_order_mismatch', NULL, NULL FROM (SELECT doc, place < lag(place) OVER (PARTITION BY doc ORDER BY pos) AS back FROM b) WHERE back)"""


def _evaluation(spark, d):
    p = table(spark, d, "part")
    base = ["CAST(floor(p_partkey / 5) AS LONG) AS doc", "0 AS page", "CAST(p_partkey AS STRING) AS id"]
    want = p.filter("p_partkey % 7 != 0").selectExpr(
        *base, "p_partkey % 5 AS pos", f"{_KIND} AS kind", "array(10.0D, p_partkey % 5 * 100.0D, 60.0D, p_partkey % 5 * 100.0D + 40.0D) AS box", "concat('C', p_partkey, 'x') AS caption", "concat('a', p_partkey) AS latex",
        "CASE WHEN p_size % 5 = 1 THEN true END AS needs_review", f"CASE WHEN {_KIND} = 'table' THEN array(2, 2) END AS shape", "'3' AS number",
    )
    have = p.filter("p_partkey % 6 != 0").selectExpr(
        *base, "CASE WHEN p_size % 10 = 0 THEN 9 - p_partkey % 5 ELSE p_partkey % 5 END AS pos", f"CASE WHEN p_partkey % 23 = 0 THEN 'table' ELSE {_KIND} END AS kind",
        "array(10.0D + p_partkey % 3 * 20, p_partkey % 5 * 100.0D, 60.0D + p_partkey % 3 * 20, p_partkey % 5 * 100.0D + 40.0D) AS box", "CASE WHEN p_size % 6 = 0 THEN 'other' ELSE concat('C', p_partkey, 'x') END AS caption",
        "CASE WHEN p_size % 8 = 3 THEN concat('b', p_partkey) ELSE concat('a', p_partkey) END AS latex", "p_size % 2 = 1 AS needs_review",
        "CASE WHEN p_partkey % 2 = 0 THEN array(array('a')) ELSE array(array('a', 'b'), array('c', 'd')) END AS cells", "CASE WHEN p_partkey % 4 = 1 THEN '4' ELSE '3' END AS number",
    )
    return layout.evaluate(want, have)


@query(f"WITH {_HELD} SELECT doc, kind, code, CASE WHEN code = 'unexpected_element' THEN 'warning' ELSE 'error' END AS severity, CAST(expected AS VARCHAR) AS expected, CAST(actual AS VARCHAR) AS actual FROM i")
def evaluation_issues(spark, d):
    return _evaluation(spark, d).issues.drop("page")


@query(f"WITH {_HELD} SELECT doc, kind, expected, actual, matched FROM n")
def expected_and_actual(spark, d):
    return _evaluation(spark, d).by_kind


@query(f"""WITH {_HELD}, o AS (SELECT doc, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(matched) AS BIGINT) AS matched FROM n GROUP BY 1), c AS (SELECT doc, count(*) FILTER (code <> 'unexpected_element') AS errors, count(*) FILTER (code = 'unexpected_element') AS warnings, count(*) FILTER (code = 'missing_element') AS missing FROM i GROUP BY 1)
SELECT doc, o.expected, o.actual, o.matched, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(missing, 0) AS missing, coalesce(warnings, 0) AS unexpected, coalesce(errors, 0) = 0 AS passed FROM o LEFT JOIN c USING (doc)""")
def evaluation_summary(spark, d):
    return _evaluation(spark, d).summary.drop("overlap")
