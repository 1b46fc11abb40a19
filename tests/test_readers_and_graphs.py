"""Readers of captured files, HTML tables, folding, references and built graphs, on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random

from paperweave.functions import text
from paperweave.operators import elements, extract, graphs, lookup, segments
from paperweave.plans import graph_build
from paperweave.sources import readers
from pyspark.sql import functions as F

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
<entry><id>http://arxiv.org/abs/1</id><published>2020-02-03T00:00:00Z</published><title>A &lt;b&gt;title&lt;/b&gt;
 of it</title><summary>Text</summary><arxiv:doi>10.1/x</arxiv:doi><author><name>Ann</name></author><author><name>Bob</name></author>
<link href="http://l/1" rel="alternate"/><link href="http://p/1" rel="related" title="pdf"/></entry>
<entry><id>http://arxiv.org/abs/2</id><published>2022-01-01T00:00:00Z</published><title>Late</title><summary>S</summary><author><name>C</name></author><link href="http://l/2" rel="alternate"/></entry></feed>"""


def test_atom_pages(spark):
    pages = spark.createDataFrame([(ATOM,), (None,), ("<html>no</html>",)], "page string")
    rows = {r["id"]: r for r in readers.atom_hits(pages, "page").collect()}
    one = rows["http://arxiv.org/abs/1"]
    assert len(rows) == 2 and one["title"] == "A title of it" and one["doi"] == "10.1/x" and one["publication_year"] == "2020"
    assert [a["author"]["display_name"] for a in one["authorships"]] == ["Ann", "Bob"]
    assert one["primary_location"]["pdf_url"] == one["open_access"]["oa_url"] == "http://p/1" and rows["http://arxiv.org/abs/2"]["open_access"]["oa_url"] == "http://l/2"
    dated = readers.atom_hits(pages, "page", first="2020-01-01", last="2020-12-31")
    assert [r["id"] for r in dated.collect()] == ["http://arxiv.org/abs/1"]
    assert readers.to_records(dated).first()["title"] == "A title of it"


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('\ufeffjournal_title,issn,impact_factor,metric_year\n"Cells, and\nmore",1234-567X;12345678,"1,204.5",2020\n,,,\nBare,,x,\n')
    rows = {r["journal_title"]: r for r in readers.read_metrics(spark, str(tmp_path / "m.csv")).collect()}
    assert set(rows) == {"Cells, and\nmore", "Bare"}
    assert rows["Cells, and\nmore"]["issn"] == ["1234-567X", "1234-5678"] and rows["Cells, and\nmore"]["issn_l"] == "1234-567X" and rows["Cells, and\nmore"]["impact_factor"] == 1204.5
    assert rows["Bare"]["impact_factor"] is None and rows["Bare"]["source"] == "local_csv" and rows["Bare"]["metric_name"] == "impact_factor"
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "a.json").write_text(json.dumps({"version": 3, "records": [{"id": "x", "cited_by_count": 4}, None]}))
    (cache / "b.json").write_text(json.dumps({"version": 2, "records": [{"id": "old"}]}))
    (cache / "c.json").write_text(json.dumps([1, 2]))
    assert [(r["id"], r["cited_by_count"]) for r in readers.read_versioned_cache(spark, str(cache), 3).collect()] == [("x", 4)]
    found = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in readers.file_digests(spark, str(cache)).collect()}
    assert found == {f.name: (len(f.read_bytes()), hashlib.sha256(f.read_bytes()).hexdigest()) for f in cache.iterdir()}
    assert {r["path"].rsplit("/", 1)[1] for r in readers.list_files(spark, str(cache)).collect()} == set(found)
    store = tmp_path / "graphs"
    store.mkdir()
    for k in "ab":
        (store / f"{k}.json").write_text(json.dumps({"cacheKey": k, "recordId": f"r{k}", "nodes": [{"id": "n", "type": "t", "label": "l"}], "edges": [{"source": "n", "target": "m"}]}))
    nodes, edges = readers.graph_tables(readers.read_graphs(spark, str(store), ["a"], 10_000))
    assert [(r["record"], r["id"]) for r in nodes.collect()] == [("ra", "n")] and [(r["source"], r["target"]) for r in edges.collect()] == [("n", "m")]
    assert readers.read_graphs(spark, str(store), max_bytes=10).count() == 0


def test_html_tables(spark):
    table = """<table><tr><th rowspan="2">A &amp; B</th><th colspan=2>wide</th></tr><tr><td>x<br>y</td><td><b>z</b></td></tr><tr><td> </td></tr>
<tr><td>1</td><td rowspan='3'>2</td></tr><tr><td>3</td></tr></table>"""
    rows = [["A & B", "wide", ""], ["A & B", "x y", "z"], ["1", "2"], ["3", "2"]]
    df = spark.createDataFrame([(1, table, "k"), (2, None, "k"), (3, "no table", "k"), (4, "<td>9", "k")], "id int, markup string, rows string")
    assert {r["id"]: r["rows"] for r in elements.html_rows(df, "markup").collect()} == {1: rows, 2: [], 3: [], 4: []}


def test_folding(spark):
    values = ["ﬁne ２０２０ — α／β", None, "a\u00a0b…", "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r["f"] for r in df.orderBy("i").select(text.fold(F.col("v")).alias("f")).collect()] == ["fine 2020 - alpha/beta", "", "a b...", "plain"]
    heads = spark.createDataFrame([("2. 材料与方法",), ("Future research:",), ("Other",)], "t string")
    assert [r[0] for r in heads.select(extract.heading(F.col("t"))).collect()] == ["Method", "Future Work", None]


def test_containment(spark, monkeypatch):
    """Random pieces of texts, of any length and from the middle of words, in one block and in several."""
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("abcd é") for _ in range(rng.randrange(0, 120)))) for i in range(40)] + [(99, None)]
    said = [""] + [t[a : a + rng.randrange(1, 60)] for _, t in texts[:-1] for a in (rng.randrange(0, 40),)] + ["zz", None]
    passages = list(enumerate(said))
    want = {(k, i) for k, p in passages if p for i, t in texts if t and p in t}
    t, p = spark.createDataFrame(texts, "tid int, t string"), spark.createDataFrame(passages, "pid int, p string")
    for block in (200_000, 7):
        got = lookup.containments(t, p, "tid", "t", "pid", "p", block=block)
        assert {tuple(r) for r in got.collect()} == want
    once = {k: i for k, i in want if sum(x == k for x, _ in want) == 1}
    assert {r["pid"]: r["tid"] for r in lookup.unique_containment(t, p, "tid", "t", "pid", "p").collect()} == once and once


def test_references(spark):
    papers = spark.createDataFrame([(1, ["doi:1", ""], "a long title of a paper"), (2, ["doi:2"], "another title of some length"), (3, ["doi:3"], "title of some"), (4, ["doi:4"], "a long title of a paper")], "id int, aliases array<string>, title string")
    refs = [(1, "doi:2", "a long title of a paper"), (2, "none", "a long title of a paper"), (3, "", "see a long title of a paper, 2020"), (4, "", "of some length and"), (5, None, "title"), (6, "", "another title of some"), (7, "", "x" * 20)]
    got = {r["source"]: (r["target"], r["tier"]) for r in lookup.resolve_references(spark.createDataFrame(refs, "source int, identifier string, title string"), papers).collect()}
    assert got == {1: (2, "alias"), 2: (1, "title"), 3: (1, "containment"), 4: (None, "none"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none")}


def test_nearest(spark):
    rng = random.Random(3)
    points = [(g, float(rng.randrange(30))) for g in "ab" for _ in range(20)] + [("c", 1.0)]
    targets = [(g, float(rng.randrange(30)), rng.randrange(9)) for g in "ab" for _ in range(6)]
    want = []
    for g, x in points:
        near = sorted((abs(t - x), t, v) for h, t, v in targets if h == g)
        if near:
            want.append((g, x, near[0][1], near[0][2]))
    got = lookup.nearest(spark.createDataFrame(points, "g string, x double"), spark.createDataFrame(targets, "g string, t double, v int"), ["g"], "x", "t", "v")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_warnings_and_modes(spark):
    rows = [(1, "one two three four five six", "one two three four five six", True), (2, "one two three four five", "一二三四五六七八九十", True), (3, "one two three four five", "", True), (4, "a b c d e", "a b c d e", False)]
    df = spark.createDataFrame(rows, "sid int, text string, result string, translate boolean")
    assert [tuple(r) for r in segments.warning_report(df).collect()] == [(1, "1: possible untranslated English remains: one two three four five six")]
    assert [r["sid"] for r in segments.warning_report(df, "en").collect()] == [2]
    place = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5)], "x double, y double")
    assert [r[0] for r in place.select(graphs.in_view(F.col("x"), F.col("y"), 400.0, 300.0, 4.0)).collect()] == [False, False, True]


def test_built_graph(spark):
    records = spark.createDataFrame([(1, "T", ["Li ion", "li  ION", ""], ["Ann"], "J", 2020, "abs"), (2, None, None, None, "", None, None)], "record int, title string, keywords array<string>, authors array<string>, journal string, year int, abstract string")
    said = ["Abstract", "Nothing here.", "Methods", "We propose a new method for the growing of cells. It was then run on a dataset of many kinds.", "Results", "Yields improved by 20 percent with this method here. A limitation of it is the cost of the glass. Future work on it will help to lower this.", "References", "We propose nothing of any kind in this list of works."]
    blocks = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(said)], "record int, page int, block int, text string")
    parts = spark.createDataFrame([(1, "Figure", "f1", None), (1, "table", "t1", "Cap"), (1, "other", "o", "x")], "record int, kind string, id string, caption string")
    g = graph_build.build_graph(records, blocks, parts)
    nodes = {(r["record"], r["id"]): (r["type"], r["label"]) for r in g.nodes.collect()}
    assert nodes[1, "keyword:li ion"] == ("keyword", "Li ion") and nodes[2, "paper:2"] == ("paper", "Untitled") and nodes[1, "figure:1:f1"] == ("figure", "Figure 1") and nodes[1, "table:1:t1"] == ("table", "Cap")
    assert sum(r == 2 for r, _ in nodes) == 1
    edges = {(r["source"], r["target"], r["type"]) for r in g.edges.collect()}
    ids = {i for _, i in nodes}
    assert all(a in ids and b in ids for a, b, _ in edges)
    kinds = {k for _, i in nodes if (k := nodes.get((1, i), ("",))[0]) in extract.ROOT}
    assert {"contribution", "method", "dataset", "limitation", "futurework", "figure", "table"} <= kinds
    assert any(t == "USES_METHOD" for *_, t in edges) and any(t == "PROPOSES" and a.startswith("contribution") for a, _, t in edges)
    evidence = g.evidence.collect()
    assert {r["node"] for r in evidence} <= ids and not any("nothing" in r["text"] for r in evidence) and {r["section"] for r in evidence if r["section"]} == {"Method", "Results"}
