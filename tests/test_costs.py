"""What a step costs, read from its plan: nothing is computed twice, nothing spreads over few tasks or sends tables to the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from paperweave.functions import text
from paperweave.operators import compare, elements, extract, graphs, layout, lookup, pairs, papers, vectors


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_tried_once(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "We propose the AlphaNet method for cells of all kinds.")], "record int, page int, block int, text string")
    plan = plan_of(extract.mentions(blocks))
    assert plan.count("(?iU)" + extract.KINDS["contribution"]) == 1
    assert plan.count("(?i)" + extract.KINDS["contribution"]) == 1


def test_folding_reads_the_text_only_where_it_has_to(spark):
    said = ["Result · plain", "a b", "ﬁne — α", "Ａ１", "…", "x  y", "naïve  text", None]
    got = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.fold(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got == ["Result · plain", "a b", "fine - alpha", "A1", "...", "x y", "naïve text", ""]
    changed = re.compile(text.FOLDED[text.FOLDED.index("&&") + 2 : -1])
    for code in range(0x80, 0x10000):
        form = "" if 0xD800 <= code < 0xE000 else unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and (len(form) == 1 or form and form.isascii()):
            assert changed.fullmatch(chr(code))
    assert not changed.search("· ïé本文。")


def test_opposite_results_of_copies_stay_few(spark, monkeypatch):
    """2,000 copies of one claim are no four million pairs, and the first pairs are those of brute force."""
    rows = [(i, i % 7, "both" if i % 3 == 0 else "up" if i % 3 == 1 else "down", ["alpha", "beta", "gamma"]) for i in range(2000)]
    rows += [(3000 + i, 8, "up", ["alpha", "beta", "gamma", "delta", f"word{i}"]) for i in range(20)]
    up = [r for r in rows if r[2] != "down"]
    down = [r for r in rows if r[2] != "up"]
    want = sorted((-1.0, a[0], b[0]) for a in up[:60] for b in down if a[3] == b[3] and a[1] != b[1] and (a[2] != "both" or b[2] != "both" or a[0] < b[0]))[:40]
    stored = []
    monkeypatch.setattr(compare, "durable", lambda df: stored.append(df) or df)
    claims = spark.createDataFrame(rows, "id long, record long, polarity string, terms array<string>").repartition(2)
    got = [(-r["likeness"], r["a"], r["b"]) for r in compare.opposite_results(claims).collect()]
    assert got == want
    assert max(d.count() for d in stored[1:2]) <= 3 * 80 + 80


def test_pairs_are_dealt_once(spark):
    """Pairs go through one shuffle, without a table of them before it, and nothing joins them afterwards."""
    rows = spark.createDataFrame([(g, i) for g in range(20) for i in range(g % 5 + 2)], "g long, i long")
    plan = pairs.shared_pairs(rows, "g", "i", 80)._jdf.queryExecution().optimizedPlan().toString()
    last = plan.split("RepartitionByExpression")[0]
    assert "Join" not in last and last.count("Aggregate") == 1
    assert "RepartitionByExpression" in papers.collaboration(rows, "g", "i")._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): (r["shared"], r["score"]) for r in pairs.shared_pairs(rows, "g", "i", 80).collect()}
    assert got[(0, 1)] == (20, 1.0) and got[(4, 5)] == (4, 0.5)


def test_codes_make_no_pairs(spark):
    """Metrics are one row a code before records join them; the first by order over all codes stays."""
    records = spark.createDataFrame([(1, ["x", "y"], "n"), (2, ["z"], "n"), (3, [""], "m")], "id long, codes array<string>, name string")
    metrics = spark.createDataFrame([(["x"], "n", 5, 50.0), (["y", "x"], "k", 3, 30.0), (["x"], "n", 4, 40.0), ([""], "q", 1, 10.0)], "codes array<string>, name string, ord long, value double")
    out = lookup.two_tier(records, metrics, "id", "codes", "name", "ord", "value")
    assert sorted((r["id"], r["value"], r["match"]) for r in out.collect()) == [(1, 30.0, "code"), (2, 40.0, "name"), (3, None, "none")]
    assert plan_of(out).count("Aggregate [_c#") == 1


def test_texts_that_records_share_are_looked_at_once(spark):
    """Kinds, headings, names and cues of equal texts are computed on distinct texts, and mentions are those of each record by itself."""
    said = [(0, "1. Methods"), (1, "We propose the AlphaNet method for cells of all kinds. Accuracy improved by 5 points with it."), (2, "We propose the AlphaNet method for cells of all kinds.")]
    rows = [(r, 1, b, t) for r in range(40) for b, t in said]
    blocks = spark.createDataFrame(rows, "record int, page int, block int, text string")
    found = extract.mentions(blocks)
    plan = plan_of(found)
    told = plan[plan.index("(?i)" + extract.KINDS["contribution"]) :]
    assert "Aggregate [text#" in told or "Aggregate [raw#" in told
    own = lambda df: sorted(tuple(r[c] for c in df.columns if c != "record") for r in df.collect())
    one = own(extract.mentions(blocks.filter("record = 7")))
    assert one and own(found) == sorted(one * 40)


def test_keyword_candidates_are_computed_once(spark):
    """Words of a title are looked for once a row, however many candidates there are."""
    rows = spark.createDataFrame([(["b", "A"], ["a"], "Deep deep sea cold sea")], "e array<string>, m array<string>, t string")
    out = rows.select(text.keyword_candidates(F.col("e"), F.col("m"), F.col("t")).alias("k"))
    assert out.first()["k"] == ["b", "A", "deep sea cold", "deep sea", "sea cold"]
    assert plan_of(out).count("regexp_extract_all") == 1


def test_weights_are_counted_once(spark):
    """Terms are looked for once, not again for documents, for terms and for weights."""
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"])], "id long, terms array<string>")
    assert "Generate" not in plan_of(vectors.tfidf(vectors.term_counts(docs, "id", "terms"), "id"))


def test_axes_are_dealt_and_tried_together(spark):
    rows = [(a, float(8 * i), float(2 * i + 1 if i % 3 else 40 + a)) for a in range(30) for i in range(6 + a % 2)]
    out = elements.robust_line(spark.createDataFrame(rows, "axis long, x double, y double"), "axis", "x", "y")
    assert "RepartitionByExpression" in plan_of(out)
    assert sorted((r["axis"], r["slope"], r["intercept"], r["inliers"]) for r in out.collect()) == [(a, 0.25, 1.0, 4) for a in range(30)]


def test_paths_stop_at_their_end(spark):
    line = spark.createDataFrame([(i, i + 1) for i in range(12)], "source long, target long")
    assert max(r["depth"] for r in graphs.bfs(line, 0, local=0, goal=3).collect()) == 3
    assert [r["id"] for r in graphs.shortest_path(line, 0, 3, local=0).orderBy("position").collect()] == [0, 1, 2, 3]


def test_rounds_of_lines_follow_their_length(spark, monkeypatch):
    """Pointers double until the lines end, whatever their number; papers on a ring and behind it come last."""
    rings = [(5001, 5000), (5000, 5001), (5002, 5001)]
    links = spark.createDataFrame([(10 * i + k + 1, 10 * i + k) for i in range(300) for k in range(3)] + rings, "source long, target long")
    every = spark.createDataFrame([(i, 2000) for i in [*range(3000), 5000, 5001, 5002]], "id long, year int")
    stored = []
    real = papers.durable
    monkeypatch.setattr(papers, "durable", lambda df: stored.append(df) or real(df))
    got = {(r["from"], r["id"]) for r in papers.causal_links(links, every).collect()}
    assert got == {(10 * i + k, 10 * i + k + 1) for i in range(300) for k in range(3)} | {(5000, 5001), (5001, 5002)}
    assert len(stored) <= 12


def test_comparison_broadcasts_nothing(spark):
    row = spark.createDataFrame([(1, 0, 0, "a", "table")], "doc long, page int, pos int, id string, kind string")
    e = layout.evaluate(row, row)
    for df in (e.matches, e.by_kind, e.summary):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_fusion_meets_once(spark):
    """Elements and blocks are dealt by page once; nothing joins, sorts or stores them between matching and the list."""
    one = spark.createDataFrame([(1, 0, 0, "a", "table", [0.0, 0.0, 9.0, 9.0])], "doc long, page int, pos int, id string, kind string, box array<double>")
    blocks = spark.createDataFrame([(1, 0, 0, "Table 1", [0.0, 10.0, 9.0, 11.0])], "doc long, page int, block int, text string, box array<double>")
    out = layout.fuse(one, one, blocks)
    for df in (out.elements, out.report):
        plan = plan_of(df)
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    assert "Table 1" not in plan_of(out.report) and "nearest" not in plan_of(out.report)


def test_references_pass_papers_once(spark, monkeypatch):
    """Papers are no query set: titles that lie in a reference's are found by a join, and papers are shuffled as digests."""
    papers = spark.createDataFrame([(i, [f"doi:{i}"], f"title {i % 50:02d} of a paper") for i in range(100)] + [(200, [], "p" * 31), (201, [], "q"), (202, [], "p" * 33)], "id int, aliases array<string>, title string")
    refs = [(1, "", "see title 07 of a paper in full"), (2, "", "both title 01 of a paper, title 02 of a paper"), (3, "", "p" * 32), (4, "", "a q at the middle of it")]
    asked = []
    real = lookup._hits
    monkeypatch.setattr(lookup, "_hits", lambda texts, passages, *a, **k: asked.append(passages.count()) or real(texts, passages, *a, **k))
    got = lookup.resolve_references(spark.createDataFrame(refs, "source int, identifier string, title string"), papers)
    assert {r["source"]: (r["target"], r["tier"]) for r in got.collect()} == {1: (7, "containment"), 2: (None, "none"), 3: (None, "none"), 4: (201, "containment")}
    assert asked == [4]
    known = spark.createDataFrame([(i, "z" * i) for i in range(1, 40)], "id int, t string")
    assert sorted(r["id"] for r in lookup._within(known, spark.createDataFrame([("y" + "z" * 33,)], "t string"), "t").collect()) == list(range(1, 34))


def test_quality_computes_its_parts_once(spark):
    row = spark.createDataFrame([(1, 0, 0, "a", "table", [["x", "y"], ["1", ""]])], "doc long, page int, pos int, id string, kind string, cells array<array<string>>")
    assert plan_of(layout.quality(layout.elements_of(row))).count("array_max(") == 1


def test_betweenness_of_a_long_line_takes_few_rounds(spark, monkeypatch):
    """A line of 60 papers and a ring of 5: few stored tables, not two a step, and the scores of the rounds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(59)] + [(100 + i, 100 + (i + 1) % 5) for i in range(5)], "source long, target long")
    stored = []
    real = graphs.durable
    monkeypatch.setattr(graphs, "durable", lambda df: stored.append(df) or real(df))
    ends = [i for k, i in enumerate([*range(60), *range(100, 105)]) if k % 22 == 0]
    got = {r["id"]: r["score"] for r in graphs.betweenness(edges, 3).collect()}
    assert len(stored) <= 12
    # on a line a paper lies between a source and all behind it; no source is on the ring
    assert ends == [0, 22, 44]
    behind = {i: sum(59 - i if s < i else i if s > i else 0 for s in ends) for i in range(60)}
    top = max(behind.values())
    want = {i: round(n / top, 6) for i, n in behind.items()} | dict.fromkeys(range(100, 105), 0.0)
    assert got == want
    few = edges.filter("source < 9 OR source >= 100")
    assert sorted(graphs.betweenness(few, 15).collect()) == sorted(graphs.betweenness(few, 15, local=0).collect())
    assert sorted(graphs.betweenness(few, 15, 3).collect()) == sorted(graphs.betweenness(few, 15, 3, local=0).collect())
    # the ring's 10 links stay in one task, the line's 18 go by rounds
    assert sorted(graphs.betweenness(few, 15, local=12).collect()) == sorted(graphs.betweenness(few, 15).collect())
