"""Layout elements: matches, fusion, comparison, captions and scores, against plain Python and told cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paperweave.operators import layout

SCHEMA = "doc int, page int, pos int, id string, kind string, box array<double>, page_size array<double>, text string, latex string, caption string, cells array<array<string>>, html string, png string, confidence double, needs_review boolean, number string, shape array<int>"
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def element(id_, kind, box, **more):
    return {"doc": 1, "page": 0, "pos": 0, "id": id_, "kind": kind, "box": box and [float(x) for x in box], "page_size": [400.0, 600.0]} | more


def frame(spark, elements):
    return spark.createDataFrame([tuple((e | {"pos": i}).get(f) for f in FIELDS) for i, e in enumerate(elements)], SCHEMA)


def iou(a, b):
    if not a or not b or a[2] <= a[0] or a[3] <= a[1] or b[2] <= b[0] or b[3] <= b[1]:
        return 0.0
    both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def tokens(text):
    return set(re.findall(r"[A-Za-z0-9]+|\\[A-Za-z]+|[=+\-*/^_]", text or ""))


def some_elements(rng, name, n):
    out = []
    for i in range(n):
        x, y = rng.randrange(0, 60), rng.randrange(0, 40)
        box = None if rng.random() < 0.2 else [x, y, x + rng.randrange(10, 30), y + rng.randrange(10, 20)]
        out.append(element(f"{name}{i}", rng.choice(["table", "figure", "chart", "formula", "formula", "text"]), box, latex=rng.choice([None, "E = mc^2", "x_1 + y", "a b c = d"])) | {"page": rng.randrange(2)})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_engines_match_greedily(spark, seed):
    rng = random.Random(seed)
    one, two = some_elements(rng, "a", 40), some_elements(rng, "b", 40)
    used, want = set(), set()
    family = lambda e: "figure" if e["kind"] in ("figure", "chart") else e["kind"]
    for e in one:
        best = None
        for o in two:
            if o["id"] in used or o["page"] != e["page"] or family(o) != family(e) or family(e) == "text":
                continue
            score = iou(e["box"], o["box"])
            if e["kind"] == "formula":
                p, q = tokens(e["latex"]), tokens(o["latex"])
                score = max(score, len(p & q) / max(len(p), len(q)) if p and q else 0.0)
            good = score > 0.35 if e["kind"] == "formula" else score >= (0.55 if e["kind"] == "table" else 0.45)
            if good and (best is None or score > best[0]):
                best = (score, o["id"])
        if best:
            used.add(best[1])
            want.add((e["id"], best[1], round(best[0], 9)))
    got = layout.match_engines(layout.elements_of(frame(spark, one)), layout.elements_of(frame(spark, two))).collect()
    assert {(r.e.id, r.a.id, round(r.score, 9)) for r in got} == want and want


def fused(spark, one, two, blocks=None):
    out = layout.fuse(frame(spark, one), frame(spark, two), blocks)
    return {r.id: r for r in out.elements.collect()}, {(r.kind, r["first"], r.second, r.state) for r in out.report.collect()}


def test_tables_are_fused(spark):
    a = element("p", "table", [10, 20, 200, 120], cells=[["A"]])
    b = element("m", "table", [12, 22, 198, 118], cells=[["A", "B"], ["1", "2"]])
    got, report = fused(spark, [a], [b])
    assert got["p"].box == a["box"] and got["p"].cells == b["cells"] and got["p"].engines == ["pymupdf", "mineru"] and got["p"].ids == ["p", "m"] and got["p"].confidence > 0.75
    assert report == {("table", "p", "m", "matched")} and got["p"].text == "A\tB\n1\t2"
    a = element("p", "table", [10, 20, 240, 150], cells=[["Material", "Capacity", "Unit"], ["Sulfur", "1672", "mAh g-1"], ["Carbon", "420", "mAh g-1"]], caption="Table 1")
    got, _ = fused(spark, [a], [element("m", "table", [12, 22, 238, 148], cells=[["Material"], [""]])])
    assert got["p"].cells == a["cells"] and not got["p"].needs_review
    a = element("p", "table", [10, 20, 240, 150], cells=[["Header", "Value"], ["truncated", "1"]], caption="Table 1")
    b = element("m", "table", [12, 22, 238, 148], cells=[["Complete header", "Value"], ["full text", "1"]], caption="Table 1 Complete caption", html="<table><tr><td>Complete header</td></tr></table>")
    got, _ = fused(spark, [a], [b])
    assert got["p"].cells == b["cells"] and got["p"].box == a["box"] and got["p"].caption == b["caption"]


def test_formulas_and_figures_are_fused(spark):
    a, b = element("p", "formula", [120, 200, 280, 230], text="E = mc^2"), element("m", "formula", None, latex="E = mc^2")
    got, _ = fused(spark, [a], [b])
    assert got["p"].box == a["box"] and got["p"].latex == "E = mc^2" and got["p"].match >= 0.9 and not got["p"].needs_review
    # a figure on a table goes; the other engine's is kept and flagged
    table = element("t", "table", [10, 20, 200, 120], cells=[["A", "B"], ["1", "2"]])
    got, report = fused(spark, [table, element("f", "figure", [12, 22, 198, 118], png="x.png")], [element("g", "chart", [12, 22, 198, 118])])
    assert set(got) == {"t", "g"} and "duplicate_of_table" in got["g"].flags and ("figure", "f", None, "first_only") in report
    blocks = spark.createDataFrame([(1, 0, 0, "Figure 2. Model architecture", [110.0, 250.0, 290.0, 270.0])], "doc int, page int, block int, text string, box array<double>")
    got, _ = fused(spark, [element("p", "figure", [100, 100, 300, 240], png="x.png")], [element("m", "figure", [-5, 320, 500, 390])], blocks)
    assert got["p"].caption == "Figure 2. Model architecture" and "bbox_clipped" in got["m"].flags and got["m"].needs_review and got["m"].box == [0.0, 320.0, 400.0, 390.0]
    # two elements of one kind in one place are one
    got, _ = fused(spark, [element("p", "figure", [100, 100, 300, 240]), element("q", "figure", [101, 100, 300, 240])], [])
    assert set(got) == {"p"}
    assert fused(spark, [], []) == ({}, set())


def evaluated(spark, want, have):
    out = layout.evaluate(frame(spark, want), frame(spark, have))
    return {r.code for r in out.issues.collect()}, out.summary.collect()


def test_comparison_with_expected_elements(spark):
    table = element("gt", "table", [10, 20, 180, 100], caption="Table 1 Capacity summary", shape=[3, 2], needs_review=False)
    formula = element("gf", "formula", [120, 160, 260, 190], latex="E = mc^2", needs_review=False)
    good = [
        element("at", "table", [12, 22, 178, 98], caption="Table 1 Capacity summary", cells=[["Material", "Capacity"], ["Sulfur", "1672"], ["Carbon", "420"]], needs_review=False),
        element("af", "formula", [120, 160, 260, 190], latex="E = mc^2", text="E = mc^2", needs_review=False),
    ]
    codes, summary = evaluated(spark, [table, formula], good)
    assert codes == set() and summary[0].passed and summary[0].matched == 2 and summary[0].overlap > 0.9
    bad = [
        element("at", "table", [10, 20, 180, 100], caption="Table 1 Capacity summary", cells=[["Material"], ["Sulfur"]], needs_review=True),
        element("af", "formula", [120, 160, 260, 190], latex="a / b", needs_review=True),
        element("x", "table", [250, 260, 350, 320], cells=[["Noise", "1"]]),
    ]
    codes, summary = evaluated(spark, [table, formula | {"latex": "\\frac{a}{b} = c"}], bad)
    assert codes == {"table_shape_mismatch", "latex_mismatch", "needs_review_mismatch", "unexpected_element", "count_mismatch"} and not summary[0].passed and summary[0].warnings == 1
    first, second = element("f", "formula", [10, 20, 100, 40], latex="x = 1"), element("t", "table", [10, 80, 180, 140], shape=[2, 2])
    codes, _ = evaluated(spark, [first, second], [element("at", "table", [10, 80, 180, 140], cells=[["A", "B"], ["1", "2"]]), element("af", "formula", [10, 20, 100, 40], latex="x = 1")])
    assert codes == {"reading_order_mismatch"}
    codes, _ = evaluated(spark, [element("f", "formula", None, latex="E = mc^2", number="2")], [element("a", "formula", [], latex="E = mc^2", number="1")])
    assert codes == {"formula_number_mismatch"}
    codes, summary = evaluated(spark, [element("f", "formula", None, latex="x = 1")], [])
    assert codes == {"missing_element", "count_mismatch"} and summary[0].missing == 1


def test_captions_by_score(spark):
    """The kind's beginning outweighs nearness, and the usual side outweighs the other."""
    blocks = [(0, "Some words near by", [100.0, 242.0, 300.0, 250.0]), (1, "Fig. 3 far below", [100.0, 290.0, 300.0, 300.0]), (2, "Figure 4 above", [100.0, 80.0, 300.0, 98.0]), (3, "On it", [100.0, 150.0, 300.0, 160.0]), (4, "w " * 100, [100.0, 241.0, 300.0, 250.0])]
    df = spark.createDataFrame([(1, 0, *b) for b in blocks], "doc int, page int, block int, text string, box array<double>")
    rows = frame(spark, [element("f", "figure", [100, 100, 300, 240]), element("t", "table", [100, 100, 300, 240]), element("n", "figure", None), element("z", "figure", [0, 0, 0, 0]), element("w", "figure", [310, 100, 400, 240])])
    assert {r.id: (r.caption, r.score) for r in layout.nearest_caption(rows, df).collect()} == {"f": ("Fig. 3 far below", round(0.5 + 0.2 + 0.25 + 0.2 - 50 / 72 * 0.2, 3)), "t": ("Figure 4 above", round(0.15 + 0.2 + 0.25 + 0.2 - 2 / 72 * 0.2, 3))}


def test_evidence_of_tables(spark):
    cases = [(None, 0.0), ([], 0.0), ([[]], 0.0), ([["A"]], 0.22 / 8 + 0.18 / 6 + 0.18 + 0.18 + 0.14), ([["x", "y"], ["1"], ["", "2"]], 3 / 8 * 0.22 + 2 / 6 * 0.18 + 2 / 3 * 0.18 + 4 / 5 * 0.18 + min(0.14, 2 / 6 * 0.28))]
    df = spark.createDataFrame([(c, w) for c, w in cases], "cells array<array<string>>, want double")
    none = F.lit(None).cast("string")
    for r in df.select("want", layout.table_evidence(F.col("cells"), none, none, F.lit(None).cast("array<double>")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)
