"""Layout elements of two engines: captions, scores of quality, matching, fusion, comparison with expected elements, reports.

An element has doc, page, pos (its place in the engine's list), id, kind and, as
far as known, box and page_size (arrays of four and two numbers), text, latex,
caption, cells (rows of cells), html, png, json and csv (paths), engines and
flags (arrays of text), confidence, needs_review, number (of a formula),
text_strategy, manual, and the scores evidence (of a table) and match (of a
formula). `elements_of` fills in what a table lacks. A page's elements are
folded in order, as what is taken depends on what was taken before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import box_of, iou, token_overlap
from ..storage import durable

#: Engines whose agreement counts: that of locations, and that of structure (fixed values).
FIRST, SECOND = "pymupdf", "mineru"
#: Engines by trust in their formulas (fixed values).
TRUST = {SECOND: 3, "paddleocr_vl": 2, FIRST: 1}
#: Least scores of a match of two engines by kind; a formula's must be greater (fixed values).
TABLE_MATCH, FIGURE_MATCH, FORMULA_MATCH = 0.55, 0.45, 0.35
#: From these overlaps on a figure repeats a table, and two elements are one (fixed values).
ON_TABLE, SAME = 0.4, 0.82
#: Below these an element needs review, and a table or formula disagrees (fixed values).
REVIEW, DISAGREE = 0.65, 0.55
#: What a comparison asks for (fixed values).
LEAST = {"box": 0.50, "caption": 0.55, "latex": 0.65}
COMPARED = ("chart", "figure", "formula", "table")
FIGURES = ("figure", "chart")
CORNERS = ("x0", "y0", "x1", "y1")
#: Beginnings of captions by kind (fixed values).
CAPTION = {
    "figure": r"^\s*(fig(?:ure)?\.?\s*\d+[A-Za-z]?|图\s*\d+)", "chart": r"^\s*(fig(?:ure)?\.?\s*\d+[A-Za-z]?|图\s*\d+)",
    "table": r"^\s*(table\s*\d+[A-Za-z]?|表\s*\d+)", "formula": r"^\s*(eq(?:uation)?\.?\s*\d+[A-Za-z]?|公式\s*\d+)",
}
#: Cells that hold numbers or units (fixed values).
MEASURED = r"(?i)[-+]?\d|%|mAh|mg|cm|kg|mol|V|A|Wh|°C|K\b"
#: Flags that tell of engines at odds (fixed values).
CONFLICTS = ("weak_formula_match", "weak_table_evidence", "duplicate_of_table", "bbox_clipped", "bbox_out_of_page")

_CELLS = "array<array<string>>"
DEFAULTS = {
    "box": "array<double>", "page_size": "array<double>", "text": "string", "latex": "string", "caption": "string", "cells": _CELLS, "html": "string", "png": "string", "json": "string", "csv": "string",
    "engines": "array<string>", "flags": "array<string>", "confidence": "double", "needs_review": "boolean", "number": "string", "text_strategy": "boolean", "manual": "boolean", "evidence": "double", "match": "double",
}


def elements_of(df: DataFrame, engine: str | None = None) -> DataFrame:
    """The table with all of an element's columns; missing ones are null, missing engines the given one."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in DEFAULTS.items() if c not in df.columns})
    own = F.array(F.lit(engine)) if engine else F.array().cast("array<string>")
    filled = out.withColumns({"engines": F.coalesce("engines", own), "flags": F.coalesce("flags", F.array().cast("array<string>")), "id": F.col("id").cast("string"), "page": F.coalesce("page", F.lit(0))})
    return filled.select("doc", "page", "pos", "id", "kind", *DEFAULTS)


# parts of scores


def _said(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def valid_box(box: Column) -> Column:
    x0, y0, x1, y1 = box_of(box)
    return F.coalesce((F.size(box) >= 4) & (x1 > x0) & (y1 > y0), F.lit(False))


def _overlap(a: Column, b: Column) -> Column:
    return F.when(valid_box(a) & valid_box(b), iou(box_of(a), box_of(b))).otherwise(F.lit(0.0))


def _place(box: Column) -> Column:
    """A box's corners as a struct, null without a valid box: what pairs are compared by."""
    return F.when(valid_box(box), F.struct(*[x.alias(n) for x, n in zip(box_of(box), CORNERS, strict=True)]))


def _shared(a: Column, b: Column) -> Column:
    """The overlap of two places, 0 if one is null."""
    wide = lambda p, q: F.greatest(F.least(a[q], b[q]) - F.greatest(a[p], b[p]), F.lit(0.0))
    area = lambda p: (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])
    both = wide("x0", "x1") * wide("y0", "y1")
    return F.coalesce(both / (area(a) + area(b) - both), F.lit(0.0))


def table_shape(cells: Column) -> tuple[Column, Column]:
    rows = F.coalesce(F.size(cells), F.lit(0))
    return F.greatest(rows, F.lit(0)), F.coalesce(F.array_max(F.transform(cells, lambda r: F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))), F.lit(0))


def filled_share(cells: Column) -> Column:
    """The share of cells with text; 0 for none."""
    flat = F.flatten(F.filter(cells, lambda r: r.isNotNull()))
    share = lambda c: F.when(F.size(c) > 0, F.size(F.filter(c, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")) / F.size(c))
    return F.coalesce(_let(flat, share), F.lit(0.0))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once; a column by itself would be computed again for each use and each element of a list."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bonus(when: Column, value: float) -> Column:
    return F.when(when, F.lit(value)).otherwise(F.lit(0.0))


def table_evidence(cells: Column, caption: Column, html: Column, box: Column) -> Column:
    """How much speaks for a candidate of a table: shape, even rows, filled cells, numbers and units, caption, markup, place; 0 without cells."""
    rows, columns = table_shape(cells)
    most = lambda ws: F.array_max(F.transform(F.array_distinct(ws), lambda w: F.struct(F.size(F.filter(ws, lambda x: x == w)).alias("n"), (-F.array_position(ws, w)).alias("p"), w.alias("w"))))
    even = lambda ws: _let(most(ws), lambda m: F.when(m["w"] > 0, m["n"] / F.greatest(F.lit(1), F.size(ws))))
    widths = F.transform(F.filter(cells, lambda r: r.isNotNull()), F.size)
    numbers = F.size(F.filter(F.flatten(F.filter(cells, lambda r: r.isNotNull())), lambda c: F.coalesce(c, F.lit("")).rlike(MEASURED)))

    def score(shape):
        rows, columns = shape["rows"], shape["columns"]
        own = F.least(F.lit(0.22), rows / 8.0 * 0.22) + F.least(F.lit(0.18), columns / 6.0 * 0.18) + F.coalesce(_let(widths, even), F.lit(0.0)) * 0.18 + filled_share(cells) * 0.18
        own = own + F.least(F.lit(0.14), numbers / F.greatest(F.lit(1), rows * columns) * 0.28)
        own = own + _bonus(F.coalesce(caption, F.lit("")) != "", 0.06) + _bonus(F.contains(F.lower(F.coalesce(html, F.lit(""))), F.lit("<table")), 0.1) + _bonus(valid_box(box), 0.04)
        return F.when((rows == 0) | (columns == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), own)))

    return _let(F.struct(rows.alias("rows"), columns.alias("columns")), score)


def _noise(text: Column, words: int, common: str, ends: int) -> Column:
    """Whether a formula reads like a sentence."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))
    return ((F.size(found) >= words) & text.rlike(rf"(?i)\b({common})\b")) | ((F.size(found) >= ends) & text.rlike(r"[.!?]\s*$"))


def formula_evidence(text: Column, latex: Column, box: Column, engine: str) -> Column:
    """How much speaks for a formula's text: length, signs, markup, number, place, engine; less if it reads like a sentence."""
    trust = TRUST.get(engine, 0)
    score = F.least(F.lit(0.30), F.length(text) / 80.0 * 0.30) + _bonus(text.rlike(r"=|\\frac|\\sum|\\int|\^|_|[+\-*/]"), 0.28) + _bonus(F.coalesce(latex, F.lit("")) != "", 0.12)
    score = score + _bonus(text.rlike(r"\(\s*\d+[A-Za-z]?\s*\)\s*$"), 0.06) + _bonus(valid_box(box), 0.08) + trust * 0.03
    return score - _bonus(_noise(text, 8, "the|and|with|from|this|that|where|when|for", 5), 0.18)


def _parts(text: Column) -> Column:
    """Signs and words of a formula or text, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|\\[A-Za-z]+|[=+\-*/^_]"), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """Shared signs and words of two formulas or texts over those of the longer one."""
    return token_overlap(_parts(a), _parts(b))


def loose_likeness(a: Column, b: Column) -> Column:
    """The same in lower case, with Greek letters, brackets and commands as words."""
    parts = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"\\[a-z]+|[a-z0-9]+|[\u0370-\u03ff]+|[=+\-*/^_()]"), F.lit(0)))
    return token_overlap(parts(a), parts(b))


def quality(e: DataFrame) -> DataFrame:
    """Elements with confidence, flags and needs_review by what speaks for them and against them.

    Kinds other than table, figure, chart and formula keep their confidence, 0.5 without one. Flags are added to those there.
    """
    box, kind, size = F.col("box"), F.col("kind"), F.col("page_size")
    known = F.array_contains(F.array(*map(F.lit, TRUST)), F.when(F.size("engines") == 1, F.get("engines", F.lit(0))))
    rows, columns = table_shape(F.col("cells"))
    latex = F.trim(F.coalesce(F.nullif("latex", F.lit("")), "text", F.lit("")))
    # what the tests ask for is computed once a row, and of a kind only where it is asked
    parts = {**{f"_{n}": v for n, v in zip(CORNERS, box_of(box), strict=True)}, "_width": F.get(size, F.lit(0)).cast("double"), "_height": F.get(size, F.lit(1)).cast("double"), "_boxed": valid_box(box)}
    parts |= {"_four": F.coalesce(F.size(box) >= 4, F.lit(False)), "_captioned": F.coalesce("caption", F.lit("")) != "", "_pair": F.array_contains("engines", FIRST) & F.array_contains("engines", SECOND)}
    parts |= {"_rows": F.when(kind == "table", rows), "_columns": F.when(kind == "table", columns), "_share": F.when(kind == "table", filled_share(F.col("cells"))), "_latex": F.when(kind == "formula", latex)}
    x0, y0, x1, y1, width, height, boxed, four, captioned, pair, rows, columns, share, latex = (F.col(c) for c in parts)
    area = F.when(four & (F.size(size) >= 2), F.greatest(F.lit(0.0), (x1 - x0) * (y1 - y0)) / F.greatest(F.lit(1.0), width * height)).otherwise(F.lit(0.0))
    paged = F.coalesce(four & (width > 0) & (height > 0), F.lit(False))
    words = F.transform(F.regexp_extract_all(latex, F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower)
    common = F.array(*map(F.lit, "the and with from this that where when for into were was".split()))
    more = {"_area": F.coalesce(area, F.lit(0.0)), "_outside": paged & ((x0 < 0) | (y0 < 0) | (x1 > width) | (y1 > height)), "_words": F.when(kind == "formula", words)}
    area, outside, words = (F.col(c) for c in more)
    sentence = (F.size(words) >= 6) & (F.arrays_overlap(words, common) | latex.rlike(r"[.!?]$"))
    last = {"_sentence": F.when(kind == "formula", sentence), "_weak": (rows <= 1) | (columns <= 1), "_bare": F.coalesce("text_strategy", F.lit(False)) & ~captioned, "_repeat": F.array_contains("flags", "duplicate_of_table")}
    last |= {"_margin": F.coalesce(four & (height > 0) & ((y1 < height * 0.08) | (y0 > height * 0.92)), F.lit(False))}
    sentence, weak, bare_text, repeat, margin = (F.col(c) for c in last)
    flagged = lambda *tests: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))
    out_flag = (outside, "bbox_out_of_page")
    evidence = F.coalesce(F.greatest(F.lit(-0.08), F.least(F.lit(0.10), (F.col("evidence") - 0.58) * 0.25)), F.lit(0.0))
    table = 0.35 + _bonus(rows >= 2, 0.15) + _bonus(columns >= 2, 0.15) + _bonus(share >= 0.6, 0.12) + _bonus(captioned, 0.08) + _bonus(boxed, 0.08) - _bonus(weak, 0.18) + _bonus(pair, 0.12) + evidence - _bonus(bare_text, 0.3) - _bonus(area > 0.58, 0.24)
    table_flags = flagged((~boxed, "missing_bbox"), (weak, "weak_table_shape"), (F.col("evidence") < 0.45, "weak_table_evidence"), ((share < 0.35) & (rows >= 2) & (columns >= 2), "sparse_table_cells"), (bare_text, "unanchored_text_table"), (area > 0.58, "page_sized_table"), out_flag)
    figure = 0.45 + F.when(~boxed, -0.15).when(area < 0.01, -0.12).otherwise(0.08) + _bonus(captioned, 0.12) + _bonus(F.coalesce("png", F.lit("")) != "", 0.1) - _bonus(repeat, 0.2) - _bonus(margin, 0.12) + _bonus(pair, 0.08)
    figure_flags = flagged((~boxed, "missing_bbox"), (boxed & (area < 0.01), "small_figure"), (repeat, "duplicate_of_table"), (margin, "page_margin"), out_flag)
    signs = latex.rlike(r"=|\\frac|\^|_|\\sum|\\int")
    numbered = (F.endswith(latex, F.lit(")")) & F.contains(F.right(latex, F.lit(8)), F.lit("("))) | (_said("number") != "")
    match = F.coalesce(F.greatest(F.lit(-0.08), F.least(F.lit(0.08), (F.col("match") - 0.35) * 0.20)), F.lit(0.0))
    formula = 0.35 + _bonus(latex != "", 0.22) + F.when(boxed, 0.18).otherwise(-0.12) - _bonus(F.length(latex) <= 2, 0.18) + _bonus(signs, 0.12) + _bonus(numbered, 0.05) + _bonus(pair, 0.1) + match - _bonus(sentence, 0.16)
    formula_flags = flagged((~boxed, "missing_bbox"), (F.length(latex) <= 2, "short_latex"), (~pair & known, "single_engine_formula"), (F.col("match") < 0.35, "weak_formula_match"), (sentence, "sentence_like_formula"), out_flag)
    figured = kind.isin(*FIGURES)
    other = F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))))
    added = F.when(kind == "table", table_flags).when(figured, figure_flags).when(kind == "formula", formula_flags).otherwise(F.array().cast("array<string>"))
    scored = e.withColumns(parts).withColumns(more).withColumns(last).withColumns({"_score": F.when(kind == "table", table).when(figured, figure).when(kind == "formula", formula), "_added": added})
    held = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), F.col("_score"))), 3)
    score = F.when(figured | kind.isin("table", "formula"), held).otherwise(other)
    out = scored.withColumns({"confidence": score, "flags": F.array_distinct(F.concat("flags", "_added"))}).drop(*parts, *more, *last, "_score", "_added")
    return out.withColumn("needs_review", F.coalesce("needs_review", F.lit(False)) | (F.col("confidence") < REVIEW) | (F.size("flags") > 0))


# captions


def _told(text: Column) -> Column:
    return F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))


def _starts(text: Column, kind: str) -> Column:
    return text.rlike(f"(?iU){CAPTION[kind]}")


def _captioned(box: Column) -> Column:
    """Whether a caption is looked for at a box."""
    return valid_box(box) | (F.size(box) >= 4) & F.exists(box, lambda v: v != 0)


def _height(page_size: Column) -> Column:
    return F.coalesce(F.nullif(F.get(page_size, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def _nearness(e: list[Column], b: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Of an element's corners and a block's: overlap sideways, gap, and how far the block is below and above."""
    overlap = F.greatest(F.lit(0.0), F.least(e[2], b[2]) - F.greatest(e[0], b[0])) / F.greatest(F.lit(1.0), F.least(e[2] - e[0], b[2] - b[0]))
    below, above = b[1] - e[3], e[1] - b[3]
    return overlap, _gap(below, above), below, above


def _gap(below: Column, above: Column) -> Column:
    return F.when(below >= 0, below).when(above >= 0, above)


def _caption_score(kind: Column, starts: Column, overlap: Column, gap: Column, below: Column, above: Column, reach: Column) -> Column:
    side = F.when(kind.isin(*FIGURES), below >= 0).otherwise(above >= 0)
    return F.when(starts, 0.5).otherwise(0.15) + _bonus(side, 0.2) + F.least(F.lit(0.25), overlap * 0.25) + F.greatest(F.lit(0.0), 0.2 - gap / reach * 0.2)


def nearest_caption(elements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, id, caption, caption_box, score): the block of the page that most looks like each element's caption.

    A block overlaps the element sideways by a quarter of the narrower one and
    lies above or below it within 12 % of the page's height; one that overlaps
    it is none. The score is 0.5 for a caption's beginning (0.15 for other text
    of at most 180 characters), 0.2 below figures and above other kinds, up to
    0.25 for the overlap and 0.2 for nearness; the nearer wins a tie, then the
    first block. blocks (doc, page, block, text, box).
    """
    placed = elements.filter(_captioned(F.col("box"))).select("doc", "page", "id", "kind", F.col("box").alias("e"), _height(F.col("page_size")).alias("height"))
    said = blocks.select("doc", "page", "block", _told(F.col("text")).alias("text"), F.col("box").alias("b")).filter((F.col("text") != "") & (F.size("b") >= 4))
    overlap, gap, below, above = _nearness(box_of(F.col("e")), box_of(F.col("b")))
    reach = F.col("height") * 0.12
    starts = F.lit(False)
    for kind in CAPTION:
        starts = F.when(F.col("kind") == kind, _starts(F.col("text"), kind)).otherwise(starts)
    starts = F.when(F.col("kind").isin(*CAPTION), starts).otherwise(_starts(F.col("text"), "figure"))
    near = placed.join(said, ["doc", "page"]).withColumns({"overlap": overlap, "gap": gap, "starts": starts}).filter((F.col("overlap") >= 0.25) & (F.col("gap") <= reach) & (F.col("starts") | (F.length("text") <= 180)))
    score = _caption_score(F.col("kind"), F.col("starts"), F.col("overlap"), F.col("gap"), below, above, reach)
    best = F.min_by(F.struct(F.substring("text", 1, 300).alias("caption"), F.col("b").alias("caption_box"), F.round("score", 3).alias("score")), F.struct(-F.col("score"), "gap", "block"))
    return near.withColumn("score", score).groupBy("doc", "page", "id").agg(best.alias("c")).select("doc", "page", "id", "c.*")


# matching


def take_in_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, e, a, score): each e, in the order of e_pos, takes the a of its pairs with the highest score that is still free, the first by a_pos in a tie.

    pairs (keys, e, e_pos, a, a_pos, score); those below a floor are left out before.
    """
    listed = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("e_pos", (-F.col("score")).alias("s"), "a_pos", "e", "a"))).alias("all"))
    kind = pairs.schema
    out_type = f"array<struct<e:{kind['e'].dataType.simpleString()},a:{kind['a'].dataType.simpleString()},score:double>>"

    return listed.select(*keys, F.explode(_taken(F.col("all"), out_type)).alias("m")).select(*keys, "m.*")


def _taken(listed: Column, kind: str) -> Column:
    """Of sorted pairs (s: the negative score, e, a) those whose e and a no pair before has taken, as an array of this kind."""

    def step(done, p):
        taken = F.exists(done, lambda d: d["e"].eqNullSafe(p["e"]) | d["a"].eqNullSafe(p["a"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(F.struct(p["e"].alias("e"), p["a"].alias("a"), (-p["s"]).alias("score"))).cast(kind)))

    return F.aggregate(listed, F.array().cast(kind), step)


PAGE = ["doc", "page"]
#: What elements are matched by.
MATCHED = ("box", "text", "latex")


def _pages(first: DataFrame, second: DataFrame, columns, blocks: DataFrame | None = None) -> DataFrame:
    """(doc, page, f, s, b): elements of both engines with these columns, and blocks, as one row a page; all go through one shuffle."""
    given = [c for c in DEFAULTS if c in columns and (c in first.columns or c in second.columns)]

    def side(df, of_second):
        held = [(F.col(c) if c in df.columns else F.lit(None).cast(DEFAULTS[c])).alias(c) for c in given]
        return df.select("doc", F.coalesce("page", F.lit(0)).alias("page"), "pos", F.col("id").cast("string").alias("id"), "kind", *held, F.lit(of_second).alias("_second"))

    both = side(first, False).unionByName(side(second, True)).select(*PAGE, "_second", F.struct("pos", "id", "kind", *given).alias("x"))
    if blocks is not None:
        text = _told(F.col("text"))
        said = blocks.select(*PAGE, "block", text.alias("text"), F.col("box").alias("b")).filter((F.col("text") != "") & (F.size("b") >= 4))
        begins = F.struct(*[_starts(F.col("text"), k).alias(k) for k in ("table", "figure")])
        said = said.select(*PAGE, F.struct("block", F.substring("text", 1, 300).alias("text"), *[c.alias(n) for c, n in zip(box_of(F.col("b")), CORNERS, strict=True)], begins.alias("begins")).alias("w"))
        both = both.unionByName(said, allowMissingColumns=True)
    # places and parts are computed once a row, after the shuffle
    dealt = both.repartition(*PAGE).withColumn("x", F.when(F.col("x").isNotNull(), _seen(F.col("x"), given)))
    lists = [F.collect_list(F.when(~F.col("_second"), F.col("x"))).alias("f"), F.collect_list(F.when(F.col("_second"), F.col("x"))).alias("s")]
    return dealt.groupBy(*PAGE).agg(*lists, *([F.collect_list("w").alias("b")] if blocks is not None else []))


def _field(e: Column, c: str, given) -> Column:
    return e[c] if c in given else F.lit(None).cast(DEFAULTS[c])


def _inside(box: Column, size: Column) -> Column:
    """The place of a box inside its page."""
    cut, inside = _held(box, size)
    return _let(F.when(cut, inside).otherwise(box), _place)


def _seen(e: Column, given) -> Column:
    """An element with what it is matched by: family, place, place inside the page, parts of a formula's text."""
    family = F.when(e["kind"].isin(*FIGURES), "figure").when(e["kind"].isin("table", "formula"), e["kind"])
    box = _field(e, "box", given)
    parts = F.when(e["kind"] == "formula", _parts(F.coalesce(F.nullif(_field(e, "text", given), F.lit("")), _field(e, "latex", given))))
    return F.struct(F.struct(e["pos"].alias("pos"), e["id"].alias("id")).alias("key"), family.alias("family"), _place(box).alias("at"), _inside(box, _field(e, "page_size", given)).alias("held"), parts.alias("parts"), e.alias("x"))


def _fusion_score(x: Column, y: Column) -> Column:
    n = F.greatest(F.size(x["parts"]), F.size(y["parts"]))
    alike = F.when(n > 0, F.size(F.array_intersect(x["parts"], y["parts"])) / n).otherwise(F.lit(0.0))
    return F.greatest(_shared(x["at"], y["at"]), F.when(x["family"] == "formula", alike))


def _matches(fs: Column, ss: Column, key: str) -> Column:
    """Array of (e, a, score), e and a keys of this type: elements of a page's first list, in order, with the best free one of their family in the second."""

    def pair(x, y):
        return F.struct(x["key"]["pos"].alias("e_pos"), (-_fusion_score(x, y)).alias("s"), y["key"]["pos"].alias("a_pos"), x["key"].alias("e"), y["key"].alias("a"), x["family"].alias("family"))

    least = lambda f: F.when(f == "table", TABLE_MATCH).when(f == "figure", FIGURE_MATCH).otherwise(math.nextafter(FORMULA_MATCH, 1.0))
    pairs = F.flatten(F.transform(fs, lambda x: F.transform(F.filter(ss, lambda y: y["family"] == x["family"]), lambda y: pair(x, y))))
    return _taken(F.sort_array(F.filter(pairs, lambda p: -p["s"] >= least(p["family"]))), f"array<struct<e:{key},a:{key},score:double>>")


def _key_type(pages: DataFrame) -> str:
    return f"struct<pos:{pages.schema['f'].dataType.elementType['key'].dataType['pos'].dataType.simpleString()},id:string>"


def match_engines(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc, page, family, e, a, score): elements of the first engine, in order, with the second's best free one of the page.

    Tables match by overlap from 0.55, figures and charts from 0.45, formulas by
    overlap or likeness of their texts above 0.35.
    """
    pages = _pages(first, second, MATCHED)
    f = F.col("f")
    family = lambda m: F.get(F.filter(f, lambda x: x["key"] == m["e"]), F.lit(0))["family"]
    found = F.transform(_matches(f, F.col("s"), _key_type(pages)), lambda m: F.struct(family(m).alias("family"), m["e"].alias("e"), m["a"].alias("a"), m["score"].alias("score")))
    return pages.filter("doc IS NOT NULL").select(*PAGE, F.explode(found).alias("m")).select(*PAGE, "m.*")


# fusion


@dataclass
class Fusion:
    """elements of both engines as one list (`ids`, `engines` of each and what it was made from), and report (doc, page, kind, first, second, state); each is computed when it is read, with the columns it needs."""

    elements: DataFrame
    report: DataFrame


def _or(*values: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _held(box: Column, size: Column) -> tuple[Column, Column]:
    """Whether a box leaves its page, and the part inside."""
    paged = F.coalesce((F.size(box) >= 4) & (F.get(size, F.lit(0)) > 0) & (F.get(size, F.lit(1)) > 0) & F.exists(box, lambda v: v != 0), F.lit(False))
    inside = F.array(*[F.greatest(F.lit(0.0), F.least(F.get(size, F.lit(i % 2)), F.get(box, F.lit(i)))) for i in range(4)])
    return paged & (inside != F.slice(box, 1, 4)), inside


def _clipped(e: DataFrame) -> DataFrame:
    box = F.col("box")
    cut, inside = _held(box, F.col("page_size"))
    more = F.array_distinct(F.concat("flags", F.array(F.lit("bbox_out_of_page"), F.lit("bbox_clipped"))))
    return e.withColumns({"flags": F.when(cut, more).otherwise(F.col("flags")), "box": F.when(cut, inside).otherwise(box)})


def _placed(kind: Column, box: Column, size: Column, other_box: Column, other_size: Column) -> tuple[Column, Column]:
    """Box and page size of two matched elements: the first engine's if it has a place; figures keep it whatever it is."""
    own = valid_box(box) | ~valid_box(other_box)
    return F.when(kind.isin(*FIGURES) | own, box).otherwise(other_box), F.when(own, size).otherwise(F.coalesce(other_size, size))


def _page_lists(pages: DataFrame, f) -> DataFrame:
    """A row (doc, page, b, m) for each entry of the list that f makes of a page's seen elements, its matches (of tables and others), its fused tables (key, at), its first elements that are no repeats of tables, and what the second has alone."""
    given, key = pages.schema["f"].dataType.elementType["x"].dataType.fieldNames(), _key_type(pages)
    fs, ss = F.col("f"), F.col("s")

    def final(x, o):
        """The place inside the page of an element and its match: the first engine's, else the second's."""
        size = F.coalesce(_field(o["x"], "page_size", given), _field(x["x"], "page_size", given))
        return F.when(x["at"].isNotNull() | o["at"].isNull() | (x["family"] == "figure"), x["held"]).otherwise(_inside(_field(o["x"], "box", given), size))

    def other(x, matches):
        """The match of x: the element of the second engine, and the score."""
        return _let(F.get(F.filter(matches, lambda m: m["e"] == x["key"]), F.lit(0)), lambda m: F.struct(F.get(F.filter(ss, lambda y: y["key"] == m["a"]), F.lit(0)).alias("o"), m["score"].alias("score")))

    def fused(xs, matches):
        return F.transform(xs, lambda x: _let(other(x, matches), lambda p: F.struct(x["key"].alias("key"), x["x"].alias("x"), p["o"]["x"].alias("o"), p["score"].alias("score"), final(x, p["o"]).alias("at"))))

    def rest(own):
        repeat = lambda x: (x["family"] == "figure") & F.exists(own, lambda t: (t["key"]["pos"] < x["key"]["pos"]) & (_shared(t["at"], x["at"]) > ON_TABLE))
        return F.filter(fs, lambda x: (x["x"]["kind"] != "table") & ~F.coalesce(repeat(x), F.lit(False)))

    def others(tables, own):
        return _let(rest(own), lambda kept: _let(F.concat(tables, _matches(kept, ss, key)), lambda matches: _let(F.filter(ss, lambda y: ~F.exists(matches, lambda m: m["a"] == y["key"])), lambda alone: f(fs, matches, own, fused(kept, matches), alone))))

    is_table = lambda x: x["family"] == "table"
    rows = _let(_matches(F.filter(fs, is_table), ss, key), lambda tables: _let(fused(F.filter(fs, is_table), tables), lambda own: others(tables, own)))
    return pages.select(*PAGE, *(["b"] if "b" in pages.columns else []), F.explode(rows).alias("m"))


def _fused_list(fs, matches, own, kept, alone) -> Column:
    """What a page keeps of fused, first and second elements: of those of a kind that overlap by more than 0.82 the first by order and place."""
    none = lambda x: F.when(F.lit(False), x)
    chart = lambda x, o: F.when(o.isNotNull() & x["kind"].isin(*FIGURES), F.when(o["kind"] == "chart", "chart").otherwise("figure")).otherwise(x["kind"])
    mine = F.transform(F.concat(own, kept), lambda p: F.struct(F.lit(0).alias("order"), p["key"].alias("key"), p["x"].alias("x"), p["o"].alias("o"), p["score"].alias("score"), F.lit(False).alias("doubled"), chart(p["x"], p["o"]).alias("kind"), p["at"].alias("at")))
    on = lambda y, ts, test: F.exists(ts, lambda t: test(t) & (_shared(t["at"], y["at"]) > ON_TABLE))
    doubled = lambda y: y["family"].isin("table", "figure") & F.coalesce(on(y, own, lambda t: F.lit(True)) | on(y, F.filter(alone, lambda t: t["family"] == "table"), lambda t: t["key"]["pos"] < y["key"]["pos"]), F.lit(False))
    theirs = F.transform(alone, lambda y: F.struct(F.lit(1).alias("order"), y["key"].alias("key"), y["x"].alias("x"), none(y["x"]).alias("o"), F.lit(None).cast("double").alias("score"), doubled(y).alias("doubled"), y["x"]["kind"].alias("kind"), y["held"].alias("at")))
    listed = F.filter(F.sort_array(F.concat(mine, theirs)), lambda m: m["kind"].isNotNull())
    # places in the list of what stays, as their type is known
    kind = "array<struct<i:int,kind:string,at:struct<x0:double,y0:double,x1:double,y1:double>>>"
    fold = lambda done, x: F.when(F.exists(done, lambda k: (k["kind"] == x["kind"]) & (_shared(k["at"], x["at"]) > SAME)), done).otherwise(F.concat(done, F.array(x)).cast(kind))
    spots = lambda every: F.transform(every, lambda m, i: F.struct(i.alias("i"), m["kind"].alias("kind"), m["at"].alias("at")))
    return _let(listed, lambda every: F.transform(F.aggregate(spots(every), F.array().cast(kind), fold), lambda k: F.get(every, k["i"])))


def _report_list(fs, matches, own, kept, alone) -> Column:
    none = F.lit(None).cast("string")
    line = lambda kind, first, second, state: F.struct(kind.alias("kind"), first.alias("first"), second.alias("second"), F.lit(state).alias("state"))
    both = F.transform(matches, lambda m: line(F.get(F.filter(fs, lambda x: x["key"] == m["e"]), F.lit(0))["family"], m["e"]["id"], m["a"]["id"], "matched"))
    left = F.filter(fs, lambda x: x["family"].isNotNull() & ~F.exists(matches, lambda m: m["e"] == x["key"]))
    return F.concat(both, F.transform(left, lambda x: line(x["x"]["kind"], x["key"]["id"], none, "first_only")), F.transform(alone, lambda y: line(y["x"]["kind"], none, y["key"]["id"], "second_only")))


def fuse(first: DataFrame, second: DataFrame, blocks: DataFrame | None = None) -> Fusion:
    """One list of elements from two engines' lists.

    Matches become one element: the location of the first engine if it has one;
    of tables the cells with more evidence; of formulas the text with more; the
    second's captions and kinds of figures first. Figures of the first engine
    that repeat a fused table before them go, what the second has alone is
    added, flagged if it repeats a table. Captions are looked for in blocks
    (doc, page, block, text, box), boxes are held inside their pages, quality
    is judged anew, and of elements of one kind that overlap by more than 0.82
    the first stays. Null boxes and texts match nothing.

    Elements and blocks meet once, as one row a page, where they are matched and
    listed; what stays is merged row by row.
    """
    rows = _page_lists(_pages(first, second, DEFAULTS, blocks), _fused_list)
    judged = quality(_clipped(_merged(rows, blocks is not None)))
    report = _page_lists(_pages(first, second, ("box", "page_size", "text", "latex")), _report_list).select(*PAGE, "m.*")
    return Fusion(judged, report)


def _merged(rows: DataFrame, captions: bool) -> DataFrame:
    """Elements of the rows (m), with the values of both engines where they are matched, and a caption from the page's blocks (b) where there is none."""
    m = rows.schema["m"].dataType
    have = lambda at: {c: F.col(f"m.{at}.{c}") if c in m[at].dataType.fieldNames() else F.lit(None).cast(t) for c, t in DEFAULTS.items()}
    x, o = have("x"), F.struct(F.col("m.o.id").alias("id"), F.col("m.o.kind").alias("kind"), *[v.alias(c) for c, v in have("o").items()])
    x["engines"] = F.coalesce(x["engines"], F.array(F.when(F.col("m.order") == 0, FIRST).otherwise(SECOND)))
    x["flags"] = F.coalesce(x["flags"], F.array().cast("array<string>"))
    x["flags"] = F.when(F.col("m.doubled"), F.array_union(x["flags"], F.array(F.lit("duplicate_of_table")))).otherwise(x["flags"])
    own = [F.col("m.order").alias("order"), F.col("m.key.pos").alias("pos"), F.col("m.key.id").alias("id"), F.col("m.x.kind").alias("kind")]
    pairs = rows.select(*PAGE, *own, *[v.alias(c) for c, v in x.items()], o.alias("o"), F.col("m.o").isNotNull().alias("_both"), F.col("m.score").alias("_score"), *(["b"] if captions else []))
    o, table, formula = F.col("o"), F.col("kind") == "table", F.col("kind") == "formula"
    values, scores = _table_values()
    pairs = pairs.withColumns({c: F.when(F.col("_both") & table, v) for c, v in scores.items()}).withColumn("_second", F.when(F.col("_both") & table, _second_table()))
    mine, theirs = F.trim(_or(F.col("latex"), F.col("text"))), F.trim(_or(o["latex"], o["text"]))
    a, b = (F.when(t != "", formula_evidence(t, e, box, n)) for t, e, box, n in ((mine, F.col("latex"), F.col("box"), FIRST), (theirs, o["latex"], o["box"], SECOND)))
    pairs = pairs.withColumns({"_mine": F.when(F.col("_both") & formula, F.struct(mine.alias("told"), a.alias("s"))), "_theirs": F.when(F.col("_both") & formula, F.struct(theirs.alias("told"), b.alias("s")))})
    told = F.when(F.col("_mine.s").isNull() | (F.col("_theirs.s") >= F.col("_mine.s")), F.col("_theirs.told")).otherwise(F.col("_mine.told"))
    chart = F.when(o["kind"] == "chart", "chart").otherwise("figure")
    figure = {"kind": chart, "caption": _or(o["caption"], F.col("caption")), "text": _or(o["text"], F.col("text")), "png": _or(F.col("png"), o["png"])}
    equation = {"text": told, "latex": told, "match": F.round("_score", 3)}
    place, size = _placed(F.col("kind"), F.col("box"), F.col("page_size"), o["box"], o["page_size"])
    every = {"box": place, "page_size": size, "engines": F.array(F.lit(FIRST), F.lit(SECOND))}
    out = {}
    for c in ("kind", *DEFAULTS):
        one = lambda of, c=c: of.get(c, F.col(c))
        if c in every:
            out[c] = F.when(F.col("_both"), every[c]).otherwise(F.col(c))
        elif c in values or c in equation or c in figure:
            out[c] = F.when(F.col("_both"), F.when(table, one(values)).when(formula, one(equation)).otherwise(one(figure))).otherwise(F.col(c))
    out["ids"] = F.when(F.col("_both"), F.array("id", "o.id")).otherwise(F.array("id"))
    merged = pairs.withColumns(out).drop("o", "_both", "_score", "_a", "_b", "_second", "_mine", "_theirs")
    return _with_captions(merged).drop("b") if captions else merged


def _table_values() -> tuple[dict[str, Column], dict[str, Column]]:
    """Values of two matched tables: of the one with more evidence (_second: the other engine's), and the evidence of both (_a, _b)."""
    o = F.col("o")
    scores = {"_a": table_evidence(F.col("cells"), F.col("caption"), F.col("html"), F.col("box")), "_b": table_evidence(o["cells"], o["caption"], o["html"], o["box"])}
    pick = lambda c: F.when(F.col("_second"), o[c]).otherwise(F.col(c))
    lines = F.array_join(F.transform(pick("cells"), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")
    evidence = F.when(F.col("_second"), F.col("_b")).otherwise(F.col("_a"))
    values = {"cells": pick("cells"), "text": _or(pick("text"), lines, F.col("text"), o["text"]), "evidence": F.round(evidence, 3), "caption": _or(o["caption"], F.col("caption"))}
    values |= {c: _or(pick(c), F.col(c), o[c]) for c in ("csv", "json", "html")}
    values["flags"] = F.when(evidence < 0.58, F.array_union("flags", F.array(F.lit("weak_table_evidence")))).otherwise(F.col("flags"))
    return values, scores


def _second_table() -> Column:
    o = F.col("o")
    marked = lambda html: F.contains(F.lower(F.coalesce(html, F.lit(""))), F.lit("<table"))
    rank = lambda s, html, box, cells: F.struct(s.alias("s"), marked(html).alias("m"), valid_box(box).alias("b"), table_shape(cells)[0].alias("n"))
    return rank(F.col("_b"), o["html"], o["box"], o["cells"]) > rank(F.col("_a"), F.col("html"), F.col("box"), F.col("cells"))


def _with_captions(e: DataFrame) -> DataFrame:
    """Tables and figures without a caption with that of the page's blocks (b) that `nearest_caption` finds."""
    bare = F.col("kind").isin("table", *FIGURES) & (F.coalesce("caption", F.lit("")) == "")
    # a fused table is held inside its page before, other elements after
    cut, inside = _held(F.col("box"), F.col("page_size"))
    at = F.when((F.col("order") == 0) & (F.col("kind") == "table") & cut, inside).otherwise(F.col("box"))
    e = e.withColumn("_at", at).withColumns({**{f"_{n}": c for n, c in zip(CORNERS, box_of(F.col("_at")), strict=True)}, "_reach": _height(F.col("page_size")) * 0.12, "_wanted": bare & _captioned(F.col("_at"))})

    def near(w):
        overlap, gap, below, above = _nearness([F.col(f"_{c}") for c in CORNERS], [w[c] for c in CORNERS])
        starts = F.when(F.col("kind") == "table", w["begins"]["table"]).otherwise(w["begins"]["figure"])
        return F.struct(overlap.alias("overlap"), gap.alias("gap"), below.alias("below"), above.alias("above"), starts.alias("starts"), w["block"].alias("block"), w["text"].alias("text"))

    # most blocks are too far up or down to look further
    level = F.filter("b", lambda w: _gap(w["y0"] - F.col("_y1"), F.col("_y0") - w["y1"]) <= F.col("_reach"))
    close = F.filter(F.transform(level, near), lambda n: (n["overlap"] >= 0.25) & (n["starts"] | (F.length(n["text"]) <= 180)))
    score = lambda n: _caption_score(F.col("kind"), n["starts"], n["overlap"], n["gap"], n["below"], n["above"], F.col("_reach"))
    best = F.array_min(F.transform(close, lambda n: F.struct((-score(n)).alias("s"), n["gap"].alias("gap"), n["block"].alias("block"), n["text"].alias("text"))))
    return e.withColumn("caption", F.when(F.col("_wanted"), F.coalesce(best["text"], "caption")).otherwise(F.col("caption"))).drop("_at", "_reach", "_wanted", *[f"_{c}" for c in CORNERS])


# comparison with expected elements


@dataclass
class Evaluation:
    """matches (doc, page, kind, expected, actual, score, overlap), issues (doc, page, kind, code, severity, expected, actual), and per doc and kind or in all the counts."""

    matches: DataFrame
    issues: DataFrame
    by_kind: DataFrame
    summary: DataFrame


def evaluate(expected: DataFrame, actual: DataFrame, least: dict[str, float] | None = None) -> Evaluation:
    """Actual elements held against expected ones, document by document.

    An expected element, in order, takes the free actual one of its page and
    kind with the best score: 1 for an equal id, the boxes' overlap, or 0.92 of
    the texts' likeness; 0.5 at least, 0.65 for formulas expected without a
    box. Matched ones are compared in box, review mark, caption, table shape,
    text and number; counts per kind and the order of matches count too.
    expected may have `shape`, an array of rows and columns. Only tables,
    figures, charts and formulas count.
    """
    floor = LEAST | (least or {})
    # all sides grow with the documents: none goes through the driver to be broadcast while its file is small
    grows = lambda df: df.hint("merge")
    shape = F.col("shape").cast("array<int>") if "shape" in expected.columns else F.lit(None).cast("array<int>")
    shaped = expected.select("doc", F.coalesce("page", F.lit(0)).alias("page"), "pos", F.col("id").cast("string").alias("id"), shape.alias("shape"))
    want = elements_of(expected).filter(F.col("kind").isin(*COMPARED)).join(grows(shaped), [*PAGE, "pos", "id"], "left")
    want, have = durable(want), durable(elements_of(actual).filter(F.col("kind").isin(*COMPARED)))
    told = lambda v: _or(v["latex"], v["text"])
    formula = F.col("kind") == "formula"
    seen = F.struct(_place(F.col("box")).alias("at"), F.when(formula, _or(F.col("latex"), F.col("text"))).otherwise(F.col("text")).alias("told"), F.when(~formula, F.col("caption")).alias("caption"), F.nullif(F.trim("id"), F.lit("")).alias("id"))
    x = want.select(*PAGE, "kind", F.col("pos").alias("e_pos"), F.struct("pos", "id").alias("e"), seen.alias("x"))
    y = have.select(*PAGE, "kind", F.col("pos").alias("a_pos"), F.struct("pos", "id").alias("a"), seen.alias("y"))
    X, Y = F.col("x"), F.col("y")
    alike = F.greatest(loose_likeness(X["caption"], Y["caption"]), loose_likeness(X["told"], Y["told"]))
    scored = x.join(grows(y), [*PAGE, "kind"]).withColumn("score", F.greatest(F.when(X["id"] == Y["id"], 1.0), _shared(X["at"], Y["at"]), alike * 0.92))
    need = F.when(formula & X["at"].isNull(), floor["latex"]).otherwise(floor["box"])
    pairs = scored.filter(F.col("score") >= F.greatest(need, F.lit(math.ulp(0.0))))
    taken = durable(take_in_order(pairs.select(*PAGE, "kind", "e", "e_pos", "a", "a_pos", "score"), [*PAGE, "kind"]))
    whole = lambda df, name, at: df.select(*PAGE, "kind", F.struct("pos", "id").alias(at), F.struct(*[c for c in df.columns if c not in ("doc", "page", "kind")]).alias(name))
    both = grows(taken).join(grows(whole(want, "w", "e")), [*PAGE, "kind", "e"]).join(grows(whole(have, "h", "a")), [*PAGE, "kind", "a"])
    W, H = F.col("w"), F.col("h")
    rows, columns = table_shape(H["cells"])
    own_rows, own_columns = table_shape(W["cells"])
    asked = F.coalesce(F.when(F.size(W["shape"]) >= 2, F.slice(W["shape"], 1, 2)), F.array(own_rows, own_columns))
    near = _overlap(W["box"], H["box"])
    tests = [
        ("bbox_mismatch", valid_box(W["box"]) & (near < floor["box"])),
        ("needs_review_mismatch", W["needs_review"].isNotNull() & (W["needs_review"] != F.coalesce(H["needs_review"], F.lit(False)))),
        ("caption_mismatch", (F.trim(_or(W["caption"])) != "") & (loose_likeness(W["caption"], H["caption"]) < floor["caption"])),
        ("table_shape_mismatch", (F.col("kind") == "table") & (asked != F.array(F.lit(0), F.lit(0))) & (asked != F.array(rows, columns))),
        ("latex_mismatch", (F.col("kind") == "formula") & (F.trim(told(W)) != "") & (loose_likeness(told(W), told(H)) < floor["latex"])),
        ("formula_number_mismatch", (F.col("kind") == "formula") & (F.trim(_or(W["number"])) != "") & (F.trim(_or(W["number"])) != F.trim(_or(H["number"])))),
    ]
    codes = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests])))
    none = F.lit(None).cast("string")
    issues = both.select(*PAGE, "kind", codes.alias("code"), F.lit("error").alias("severity"), F.col("e.id").alias("expected"), F.col("a.id").alias("actual"))
    missing = want.withColumn("e", F.struct("pos", "id")).join(grows(taken), [*PAGE, "kind", "e"], "left_anti")
    extra = have.withColumn("a", F.struct("pos", "id")).join(grows(taken), [*PAGE, "kind", "a"], "left_anti")
    issues = issues.unionByName(missing.select(*PAGE, "kind", F.lit("missing_element").alias("code"), F.lit("error").alias("severity"), F.col("id").alias("expected"), none.alias("actual")))
    issues = issues.unionByName(extra.select(*PAGE, "kind", F.lit("unexpected_element").alias("code"), F.lit("warning").alias("severity"), none.alias("expected"), F.col("id").alias("actual")))
    count = lambda df, name: df.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias(name))
    by_kind = grows(count(want, "expected")).join(grows(count(have, "actual")), ["doc", "kind"], "full").join(grows(count(taken, "matched")), ["doc", "kind"], "left").fillna(0, ["expected", "actual", "matched"])
    uneven = by_kind.filter("expected != actual").select("doc", F.lit(None).cast(want.schema["page"].dataType).alias("page"), "kind", F.lit("count_mismatch").alias("code"), F.lit("error").alias("severity"), none.alias("expected"), none.alias("actual"))
    w = Window.partitionBy("doc").orderBy("e.pos")
    back = taken.withColumn("_before", F.lag("a.pos").over(w)).filter(F.col("a.pos") < F.col("_before")).select("doc").distinct()
    unordered = back.select("doc", F.lit(None).cast(want.schema["page"].dataType).alias("page"), none.alias("kind"), F.lit("reading_order_mismatch").alias("code"), F.lit("error").alias("severity"), none.alias("expected"), none.alias("actual"))
    issues = durable(issues.unionByName(uneven).unionByName(unordered))
    matches = both.select(*PAGE, "kind", F.col("e.id").alias("expected"), F.col("a.id").alias("actual"), F.round("score", 3).alias("score"), F.round(near, 3).alias("overlap"))
    told_of = issues.groupBy("doc").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("code") == "missing_element").alias("missing"), F.count_if(F.col("code") == "unexpected_element").alias("unexpected"))
    totals = by_kind.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("expected", "actual", "matched")])
    overlap = matches.groupBy("doc").agg(F.round(F.avg("overlap"), 3).alias("overlap"))
    summary = totals.join(grows(told_of), "doc", "left").fillna(0, ["errors", "warnings", "missing", "unexpected"]).join(grows(overlap), "doc", "left").withColumn("passed", F.col("errors") == 0)
    return Evaluation(matches, issues, by_kind, summary)


# reports


def quality_issues(elements: DataFrame) -> DataFrame:
    """(doc, page, id, kind, issue, detail) of judged elements: review, low_confidence, engine_conflict, missing_artifacts, manual_override.

    The detail is the flags, the confidence, the flags at odds, or the missing fields.
    """
    e = elements_of(elements)
    sure = F.coalesce("confidence", F.lit(0.0))
    odds = F.array_sort(F.array_intersect(F.array_distinct("flags"), F.array(*map(F.lit, CONFLICTS))))
    apart = (F.size(F.array_distinct("engines")) > 1) & (F.coalesce(F.col("match") < DISAGREE, F.lit(False)) | F.coalesce(F.col("evidence") < DISAGREE, F.lit(False)))
    lacks = lambda c: F.when(_said(c) == "", F.lit(c))
    no_cells = F.when(F.coalesce(F.size("cells"), F.lit(0)) <= 0, F.lit("cells"))
    no_latex = F.when(_or(F.col("latex"), F.col("text")) == "", F.lit("latex"))
    missing = F.when(F.col("kind") == "table", F.array(no_cells, lacks("json"), lacks("csv"), lacks("png"))).when(F.col("kind") == "formula", F.array(no_latex, lacks("png"))).when(F.col("kind").isin(*FIGURES), F.array(lacks("png")))
    missing = F.coalesce(F.array_compact(missing), F.array().cast("array<string>"))
    said = lambda test, name, detail: F.when(test, F.struct(F.lit(name).alias("issue"), detail.cast("string").alias("detail")))
    found = F.array(
        said(F.coalesce("needs_review", F.lit(False)) | (F.size("flags") > 0) | (sure < REVIEW), "review", F.array_join("flags", " ")),
        said(F.col("confidence") < REVIEW, "low_confidence", F.col("confidence")),
        said((F.size(odds) > 0) | apart, "engine_conflict", F.array_join(odds, " ")),
        said(F.size(missing) > 0, "missing_artifacts", F.array_join(missing, " ")),
        said(F.coalesce("manual", F.lit(False)), "manual_override", F.lit("")),
    )
    return e.select(*PAGE, "id", "kind", F.explode(F.array_compact(found)).alias("i")).select(*PAGE, "id", "kind", "i.*")


def quality_summary(elements: DataFrame) -> DataFrame:
    """(doc, bucket, count, needs_review) of tables, figures (charts among them) and formulas."""
    bucket = F.when(F.col("kind") == "table", "tables").when(F.col("kind").isin(*FIGURES), "figures").when(F.col("kind") == "formula", "formulas")
    return elements.withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("doc", "bucket").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("needs_review"))
