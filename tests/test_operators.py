"""Operators on small fixtures against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import statistics
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from paperweave.functions import geo, ids, text
from paperweave.operators import compare, detail, elements, extract, graphs, papers, relevance, segments, series, vectors
from paperweave.sources import readers, sinks
from paperweave.storage import durable
from paperweave.streaming import changes, limits


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "want"),
    [(" https://doi.org/10.1/ABC ", "10.1/abc"), ("DOI: 10.2/x", "10.2/x"), ("http://dx.doi.org/10.3/y", "10.3/y"), ("", None), (None, None)],
)
def test_doi(spark, given, want):
    assert one(spark, ids.normalize_doi(F.col("x")), x=given) == want


@pytest.mark.parametrize(("given", "want"), [("arXiv:2101.00001v3", "2101.00001"), ("https://arxiv.org/abs/hep-th/9901001v1", "hep-th/9901001"), ("none", None)])
def test_arxiv(spark, given, want):
    assert one(spark, ids.normalize_arxiv_id(F.col("x")), x=given) == want


def test_title_key(spark):
    key = ids.title_year_key(F.col("t"), F.col("y"))
    a = one(spark, key, t="A Study of Lithium-Sulfur Cells", y=2020)
    assert a == one(spark, key, t="a study of  lithium sulfur cells!", y=2020) and a.startswith("titleyear:2020:") and len(a) == 15 + 16
    assert one(spark, key, t="Too short", y=2020) is None


def test_urls(spark):
    u = ids.normalize_url(F.col("x"))
    assert one(spark, u, x="http://Example.COM/a?b=1&amp;c=2#f") == "https://example.com/a?b=1&c=2"
    assert one(spark, u, x="//host.org/p") == "https://host.org/p" and one(spark, u, x="javascript:void(0)") is None
    assert one(spark, ids.normalize_issn(F.col("x")), x="1234567x") == "1234-567X" and one(spark, ids.normalize_issn(F.col("x")), x="123") == ""


def test_terms(spark):
    assert one(spark, text.search_terms(F.col("x")), x="Batteries of Li and glasses") == ["battery", "of", "lithium", "and", "glasse"]
    assert one(spark, text.keyword_match(F.col("k"), F.col("x")), k="solid electrolyte battery", x="a battery with a solid part and electrolyte")
    assert not one(spark, text.keyword_match(F.col("k"), F.col("x")), k="solid electrolyte", x="a solid part")


def test_sentences(spark):
    got = one(spark, text.sentences(F.col("x")), x="As shown by Smith et al. in their paper it works. Short. This is the second sentence of the text!")
    assert got == ["As shown by Smith et al. in their paper it works.", "This is the second sentence of the text!"]


def test_iou(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), ([0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0]), (None, [0.0, 0.0, 1.0, 1.0])], "a array<double>, b array<double>")
    got = [r["r"] for r in rows.select(geo.iou(geo.box_of(F.col("a")), geo.box_of(F.col("b"))).alias("r")).collect()]
    assert got == [pytest.approx(1 / 7), 0.0, 0.0]


# graphs

@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)}
    return edges, spark.createDataFrame(sorted(edges), "source long, target long")


def near(edges):
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def test_bfs_and_components(net):
    edges, df = net
    links = near(edges)
    start = min(links)
    depth, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in links[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                queue.append(w)
    got = {r["id"]: r for r in graphs.bfs(df, start).collect()}
    assert {k: r["depth"] for k, r in got.items()} == depth
    assert all(r["parent"] == min(w for w in links[k] if depth[w] == depth[k] - 1) for k, r in got.items() if k != start)
    far = max(depth, key=lambda k: (depth[k], k))
    path = [r["id"] for r in graphs.shortest_path(df, start, far).orderBy("position").collect()]
    ways = [[start]]
    while ways[0][-1] != far:
        ways = [[*w, x] for w in ways for x in links[w[-1]] if depth[x] == len(w)]
        ways = [w for w in ways if w[-1] == far] or ways
    assert path == min(ways)
    assert graphs.shortest_path(df, start, 999).count() == 0
    low = {}
    for v in links:
        seen, stack = {v}, [v]
        while stack:
            for w in links[stack.pop()] - seen:
                seen.add(w)
                stack.append(w)
        low[v] = min(seen)
    assert {r["id"]: r["component"] for r in graphs.components(df).collect()} == low


def test_betweenness(net):
    edges, df = net
    links = near(edges)
    score = dict.fromkeys(links, 0.0)
    for s in links:
        order, pred, sigma, dist = [], defaultdict(list), defaultdict(float), {s: 0}
        sigma[s], queue = 1.0, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in links[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    top = max(score.values())
    got = {r["id"]: r["score"] for r in graphs.betweenness(df, 1000).collect()}
    assert got == {k: pytest.approx(v / top, abs=1e-5) for k, v in score.items()}


def plain_chains(year, key, links):
    """Papers by year, within a year in the order of their links, those of cycles last; then the best chain into each."""
    good = {(b, a) for a, b in links if a != b and a in year and b in year and year[a] is not None and year[b] is not None and year[b] <= year[a]}
    order = []
    for y in sorted({v for v in year.values() if v is not None}):
        left = sorted(i for i in year if year[i] == y)
        own = {(u, v) for u, v in good if year[u] == year[v] == y}
        while ready := [v for v in left if not any(w == v and u in left for u, w in own)]:
            order.append(ready[0])
            left.remove(ready[0])
        order += left
    best, kept = {}, set()
    for v in order:
        base = round(1 + 0.35 * key[v], 6)
        into = [(round(best[u][0] + base + min(0.6, 0.04 * (year[v] - year[u])), 6), best[u][1] + 1, u) for u, w in good if w == v and u in best]
        kept |= {(u, v) for _, _, u in into}
        best[v] = max(into) if into else (base, 0, None)
    return best, kept


def test_longest_paths(spark):
    """Random links with cycles inside a year, chains of single links, and papers without a year."""
    for seed, n, m in ((10, 30, 45),):
        rng = random.Random(seed)
        year = {i: rng.choice([2000, 2001, 2001, 2003, None]) for i in range(n)}
        key = {i: round(rng.random(), 2) for i in range(n)}
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        best, kept = plain_chains(year, key, links)
        df, p = spark.createDataFrame(sorted(links), "source long, target long"), spark.createDataFrame([(i, year[i], key[i]) for i in year], "id long, year int, key double")
        assert {(r["from"], r["id"]) for r in papers.causal_links(df, p).collect()} == kept
        got = {r["id"]: (r["score"], r["length"], r["parent"]) for r in papers.longest_paths(df, p).collect() if year[r["id"]] is not None}
        assert {i: (pytest.approx(s, abs=2e-5), length) for i, (s, length, _) in best.items()} == {i: x[:2] for i, x in got.items()}
        used = {u for u, _ in kept}
        ends = sorted((-best[i][0], -best[i][1], i) for i in best if best[i][1] and i not in used)
        chains = []
        for *_, i in ends:
            path = [i]
            while got[path[-1]][2] is not None:
                path.append(got[path[-1]][2])
            if len(chains) < 6 and all(len(set(path) & set(c)) <= 0.72 * len(set(path) | set(c)) for c in chains):
                chains.append(path[::-1])
        rows = papers.key_paths(df, p, pool=2).collect()
        found = [[r["id"] for r in sorted(rows, key=lambda r: r["position"]) if r["path"] == k] for k in range(len(chains))]
        assert found == chains


def test_ten_thousand_links_of_one_year(spark):
    n = 10_000
    links = spark.range(1, n).selectExpr("id AS source", "id - 1 AS target")
    p = spark.range(n).selectExpr("id", "2020 AS year", "0.5D AS key")
    rows = papers.key_paths(links, p)
    assert rows.count() == n and rows.filter("position != id").count() == 0
    ring = links.union(spark.createDataFrame([(0, n - 1)], "source long, target long"))
    assert papers.causal_links(ring, p).count() == n - 1


def test_paths_of_any_length(spark):
    """A line of ten thousand links, in one task and by rounds; statuses of path queries."""
    n = 10_000
    line = spark.range(n).selectExpr("id AS source", "id + 1 AS target")
    assert graphs.shortest_path(line, 0, n).filter("position != id").count() == 0
    assert graphs.bfs(line, 0).agg(F.max("depth")).first()[0] == n
    short = spark.range(5).selectExpr("id AS source", "id + 1 AS target")
    assert [r["id"] for r in graphs.shortest_path(short, 0, 5, local=0).orderBy("position").collect()] == list(range(6))


def test_path_status(spark):
    rows = [("e1", "a", "c", "CITES"), ("e2", "a", "b", "cites"), ("e3", "b", "d", "CITES"), ("e4", "d", "c", "USES"), ("e5", "x", "y", "CITES"), ("e6", "b", "d", "ABOUT"), ("e7", "d", "z", "CITES"), ("e8", "d", "q", "CITES")]
    edges = spark.createDataFrame([(*r, 0.123456) for r in rows], "id string, source string, target string, type string, confidence double")
    nodes = spark.createDataFrame([(c,) for c in "abcdxyq"], "id string")
    for local in (1000,):
        ask = lambda *a, **k: graphs.path_status(nodes, edges, *a, local=local, **k)  # noqa: B023, E731
        assert ask("a", "nowhere")["status"] == "invalid" and ask("a", "z")["status"] == "invalid"
        assert ask("a", "a") == {"status": "ready", "length": 0, "steps": None}
        assert ask("a", "x")["status"] == "no_path"
        found = ask("a", "d")  # over b, the lesser id of the two ways
        assert found["status"] == "ready" and found["length"] == 2
        steps = sorted(map(tuple, found["steps"].select("position", "source_id", "target_id", "edge_id", "relation", "forward", "confidence").collect()))
        assert steps == [(0, "a", "b", "e2", "CITES", True, 0.1235), (1, "b", "d", "e6", "ABOUT", True, 0.1235)]
        back = ask("c", "a", relations=["cites"])
        assert [tuple(r) for r in back["steps"].select("edge_id", "forward").collect()] == [("e1", False)]
        assert ask("c", "a", directed=True)["status"] == "no_path"
        assert ask("a", "q", most_visited=2)["status"] == "too_large"


def test_components_by_rounds(net):
    _, df = net
    one = {r["id"]: r["component"] for r in graphs.components(df).collect()}
    assert {r["id"]: r["component"] for r in graphs.components(df, local=0).collect()} == one
    got = {r["id"]: r["depth"] for r in graphs.bfs(df, min(one), local=0).collect()}
    assert got == {r["id"]: r["depth"] for r in graphs.bfs(df, min(one)).collect()}


def lod(spark, n):
    """A grid of nodes of eight kinds and a paper, chained and linked over 17 places."""
    kinds = ["method", "dataset", "result", "concept", "author", "limitation", "figure", "citation"]
    nodes = [(f"node:{i}", "paper" if i == 0 else kinds[i % 8], f"Node {i}", (i % 100) / 100, (i // 100 % 10) / 10, (37 * i) % 100 / 100, 0.55 + (17 * i) % 45 / 100, 1, False) for i in range(n)]
    edges = [(f"chain:{i}", f"node:{i - 1}", f"node:{i}", "uses", 0.8) for i in range(1, n)] + [(f"skip:{i}", f"node:{i - 17}", f"node:{i}", None, 0.5) for i in range(17, n)]
    if n > 1000:
        nodes[456] = (*nodes[456][:5], None, *nodes[456][6:])
    return spark.createDataFrame(nodes, "id string, type string, label string, x double, y double, importance double, confidence double, evidence int, needs_review boolean"), spark.createDataFrame(edges, "id string, source string, target string, type string, confidence double")


def test_view_within_its_budget(spark):
    nodes, edges = lod(spark, 5000)
    view = detail.project(nodes, edges, ["node:4321", "node:4999"], ["chain:4999"], width=1000, height=700, scale=0.5)
    drawn, links = view.nodes.collect(), view.edges.collect()
    ids = {r["id"] for r in drawn}
    groups = [r for r in drawn if r["aggregate"]]
    assert {"node:4321", "node:4999", "node:0"} <= ids and len(drawn) <= detail.BUDGETS["overview"] and 0 < len(groups) <= 30
    assert sum(r["members"] for r in drawn) == view.status["candidates"] == 5000
    assert len(links) <= 720 and all(r["source"] in ids and r["target"] in ids and r["source"] != r["target"] for r in links)
    assert all(r["label"].endswith(f" · {r['members']}") for r in groups) and {r["type"] for r in links if r["aggregate"]} <= {"USES", "RELATED_TO"}
    # the largest cells are kept: no cell that went to another was larger than one that stayed
    assert min(r["members"] for r in groups) >= 1


def test_view_of_small_and_zoomed_graphs(spark):
    nodes, edges = lod(spark, 100)
    view = detail.project(nodes, edges, scale=0.3)
    assert view.nodes.count() == 100 and view.nodes.filter("aggregate").count() == 0 and view.status["level"] == "detail"
    nodes, edges = lod(spark, 1000)
    near = {"width": 900, "height": 600, "scale": 3.0, "overscan": 20}
    first, moved = (detail.project(nodes, edges, **near, pan_x=x) for x in (0, 700))
    assert first.status["culled"] > 0 and {r["id"] for r in first.nodes.collect()} != {r["id"] for r in moved.nodes.collect()}
    whole = detail.project(nodes, edges, spatial=False, **near)
    assert whole.status["candidates"] == 1000 and whole.nodes.count() <= detail.BUDGETS["detail"]
    assert [detail.render_level(s, n) for s, n in ((0.1, 100), (2.0, 500), (1.0, 500), (0.5, 500))] == ["detail", "detail", "normal", "overview"]
    empty = detail.project(nodes.filter("false"), edges)
    assert empty.nodes.count() == 0 and empty.edges.count() == 0
    assert detail.view_settings(scale="x", width=float("nan"), overscan=9e9) == {"width": 960.0, "height": 640.0, "scale": 1.0, "pan_x": 0.0, "pan_y": 0.0, "overscan": 800.0}


def test_cells_go_to_the_nearest_kept_one():
    sizes = [(9, "method", 0, 0), (5, "result", 5, 3), (1, "method", 4, 3), (1, "result", 0, 0), (1, "concept", 5, 2)]
    got = {tuple(x[:3]): tuple(x[3:]) for x in detail._nearest(sizes, 2)}
    assert got == {("method", 0, 0): ("method", 0, 0), ("result", 5, 3): ("result", 5, 3), ("method", 4, 3): ("method", 0, 0), ("result", 0, 0): ("result", 5, 3), ("concept", 5, 2): ("result", 5, 3)}


# elements

def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return i / (area(a) + area(b) - i)


def boxes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        x, y = rng.random() * 30, rng.random() * 30
        rows.append((0, i % 4, i, rng.choice(["table", "figure"]), [x, y, x + 10, y + 10], rng.random()))
    return rows, spark.createDataFrame(rows, "doc int, page int, id long, kind string, box array<double>, score double")


def test_overlap_suppression(spark):
    rows, df = boxes(spark, 1)
    kept = []
    for r in sorted(rows, key=lambda r: r[2]):
        if not any(k[1] == r[1] and k[3] == r[3] and overlap(k[4], r[4]) > 0.3 for k in kept):
            kept.append(r)
    assert {r["id"] for r in elements.suppress_overlaps(df, ["id"], 0.3).collect()} == {r[2] for r in kept}


def test_tables_and_lines(spark):
    rows = one(spark, elements.markdown_rows(F.col("x")), x="| a | b |\n|---|---|\n| 1 |  |\n")
    assert rows == [["a", "b"], ["1", ""]]
    points = spark.createDataFrame([("p", float(x), 2.0 * x + 1 + (50 if x == 3 else 0)) for x in range(8)], "axis string, x double, y double")
    r = elements.robust_line(points, "axis", "x", "y").first()
    assert (r["slope"], r["intercept"], r["inliers"]) == (2.0, 1.0, 7)


def test_robust_lines_are_plain(spark):
    """All pairs of ticks in plain Python, for short axes and one of 150 ticks."""
    import math

    rng = random.Random(6)
    axes = {}
    for a in range(40):
        n = 150 if a == 0 else rng.randrange(0, 12)
        slope, start = rng.choice([-0.5, 0.1, 2.0]), rng.uniform(-5, 5)
        xs = sorted(round(i * rng.uniform(6, 9) + rng.random(), 2) for i in range(n))
        axes[a] = sorted((x, start + slope * x + (rng.uniform(-40, 40) if rng.random() < 0.3 else rng.uniform(-0.1, 0.1))) for x in xs)
    want = {}
    for a, p in axes.items():
        gaps = sorted(b[0] - c[0] for c, b in itertools.pairwise(p))
        spacing = statistics.median(gaps) if gaps else 1.0
        best = None
        for i, j in itertools.combinations(range(len(p)), 2):
            dx = p[j][0] - p[i][0]
            m = (p[j][1] - p[i][1]) / dx if dx else 0.0
            if len(p) < 3 or abs(dx) < max(4.0, 0.6 * spacing) or abs(m) < 1e-12:
                continue
            error = [abs(y - (m * (x - p[i][0]) + p[i][1])) for x, y in p]
            near = [k for k, e in enumerate(error) if e <= max(0.18, abs(m) * spacing * 0.18)]
            if len(near) >= max(3, math.ceil(0.45 * len(p))):
                rank = (len(near), -round(sum(error[k] for k in near) / len(near), 12), -abs(m))
                if best is None or rank > best[0]:
                    best = (rank, near)
        if best:
            x, y = ([p[k][c] for k in best[1]] for c in (0, 1))
            fit = statistics.linear_regression(x, y)
            want[a] = (pytest.approx(fit.slope, abs=1e-5), pytest.approx(fit.intercept, abs=1e-4), len(x))
    rows = [(a, x, y) for a, p in axes.items() for x, y in p] + [(1, None, 2.0), (1, 3.0, None)]
    got = elements.robust_line(spark.createDataFrame(rows, "axis int, x double, y double"), "axis", "x", "y").collect()
    assert 0 in want and {r["axis"]: (r["slope"], r["intercept"], r["inliers"]) for r in got} == want


def test_chart_rows(spark):
    schema = "record_id string, element_id string, subplots array<struct<series:array<struct<name:string,points:array<struct<x:double,y:double>>>>>>"
    rows = elements.chart_rows(spark.createDataFrame([("r", "e", [([("s", [(1.0, 2.0), (None, 3.0)])],)])], schema)).collect()
    assert [(r["subplot"], r["series"], r["series_name"], r["point"], r["x"], r["y"]) for r in rows] == [(0, 0, "s", 0, 1.0, 2.0), (0, 0, "s", 1, None, 3.0)]


# extraction and comparison

def test_sections(spark):
    at = lambda y: [0.0, y, 100.0, y + 10.0]
    blocks = [("r", p, 0, "Running head", at(5.0)) for p in range(1, 5)] + [("r", 1, 1, "Said before.", None), ("r", 1, 2, "1. Introduction", None), ("r", 1, 3, "Some  text.", None), ("r", 2, 1, "2 Methods", None), ("r", 2, 2, "We do.", None)]
    blocks += [("r", 4, 1, "References", None), ("r", 4, 2, "[1] A.", None), ("r", 5, 1, "IV. Conclusions:", None), ("r", 5, 2, "So.", None)] + [("r", p, 9, "In the middle", at(400.0)) for p in range(1, 4)]
    df = spark.createDataFrame([(*b, 800.0) for b in blocks], "record string, page int, block int, text string, bbox array<double>, height double")
    got = {(r["text"], r["section"]) for r in extract.sections(df).collect()}
    assert got == {("Said before.", None), ("Some text.", "Introduction"), ("We do.", "Method"), ("So.", "Conclusion"), ("In the middle", "Introduction"), ("In the middle", "Method")}


def said_of(spark, *texts, **more):
    blocks = [("p1", 1, i, t, [1.0, 2.0, 3.0, 4.0] if len(t) > 20 else None, 800.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(blocks, "record string, page int, block int, text string, bbox array<double>, height double")
    found = durable(extract.with_nodes(extract.mentions(df, **more)))
    nodes = durable(extract.entities(found))
    return found.collect(), nodes.collect(), extract.root_relations(found, nodes).unionByName(extract.pair_relations(found, nodes)).collect()


def test_relation_contexts(spark):
    *_, said = said_of(spark, "Methods", "We use the AtlasNet model on the OpenImages dataset.")
    assert {(r["source"], r["target"]) for r in said if r["type"] == "USES_DATASET" and r["method"] == "same_sentence"} >= {("model:p1:atlasnet", "dataset:p1:ontheopenimagesdataset")}
    *_, said = said_of(spark, "Methods", "We propose the AtlasNet method. The same paragraph evaluates AtlasNet on the OpenImages dataset.")
    assert any(r["type"] == "USES_DATASET" and r["method"] == "same_block" for r in said)
    *_, said = said_of(spark, "Methods", "We use a temporal transformer model for prediction.", "The OpenImages dataset contains labels.")
    assert not any(r["type"] == "USES_DATASET" and r["method"] == "same_section" for r in said)
    *_, said = said_of(spark, "Results", "Results show accuracy improved by 12%.")
    assert [(r["source"][:7], r["target"], r["confidence"]) for r in said if r["type"] == "EVALUATED_BY" and r["method"] == "same_sentence"] == [("result:", "metric:p1:accuracy", 0.71)]


def test_relations_of_a_section(spark):
    """Without a block in common the nearest source of the section is taken, with a cue, and with 0.58 at most."""
    texts = ["Methods", "Our AtlasNet model is of some interest.", "The BorealNet model is trained for long here.", "The OpenImages dataset contains labels."]
    *_, said = said_of(spark, *texts)
    assert [(r["source"], r["confidence"], r["needs_review"]) for r in said if r["method"] == "same_section"] == [("method:p1:borealnet", 0.58, True)]
    *_, said = said_of(spark, "Methods", texts[2], "Results", texts[3])
    assert not any(r["method"] == "same_section" for r in said)


def test_statements_by_ordered_rules(spark):
    found, nodes, said = said_of(
        spark, "Results", "Results show F1 = 0.91 and accuracy improved by 12%.", "Methods", "We use the model for several prediction tasks.", "Limitations", "A limitation is that the method cannot improve recall on small cohorts."
    )
    kinds = {(r["kind"], r["label"]) for r in found}
    assert ("model", "model") in kinds and ("method", "model") in kinds and not any(k == "result" and "cannot" in r["text"] for r in found for k in [r["kind"]])
    generic = [r for r in nodes if r["kind"] == "model"]
    assert generic[0]["needs_review"] and generic[0]["review"] == ["generic_label", "low_confidence"] and generic[0]["confidence"] == 0.55
    # a sentence told twice: the result comes once, and then the model, which the result kept out
    told = "Results show the model is good for all of the cells."
    found, nodes, _ = said_of(spark, "Results", told, "Some words between the two of them here.", told)
    assert [(r["kind"], r["block_id"]) for r in sorted(found, key=lambda r: r["ordinal"])] == [("result", "page-1-block-1"), ("model", "page-1-block-3"), ("method", "page-1-block-3")]
    found, nodes, said = said_of(spark, "Discussion", "We extend Smith et al. 2020 and improve on their method here.")
    assert {"EXTENDS", "IMPROVES_ON", "CITES"} <= {r["type"] for r in said} and "Smith et al. 2020" in {r["label"] for r in found}


def test_mentions_of_metadata_and_elements(spark):
    metadata = spark.createDataFrame([("p1", "In conclusion the approach works for all.", None)], "record string, abstract string, summary string")
    elements_ = spark.createDataFrame([("p1", "f1", "Chart", 1, "Figure of results", None, 0.9), ("p1", "f2", "formula", 0, "", "x = 1", None), ("p1", "f3", "photo", 1, "no", None, 1.0)], "record string, id string, kind string, page int, caption string, text string, confidence double")
    found, nodes, said = said_of(spark, "Results", "Results show the accuracy of all of it.", metadata=metadata, elements=elements_)
    by = {r["kind"]: r for r in found}
    assert by["conclusion"]["origin"] == "metadata" and by["conclusion"]["section"] == "Abstract" and by["figure"]["section"] == "Results" and by["equation"]["section"] is None and by["equation"]["label"] == "Equation f2"
    assert [(r["type"], r["confidence"]) for r in said if r["method"] == "caption" and r["source"].startswith("figure") and r["target"].startswith("result")] == [("SUPPORTS", round(min(0.9, 0.81) * 0.88, 3))]
    assert {(r["source"], r["method"]) for r in said if r["target"].startswith("conclusion")} == {("paper:p1", "metadata")}
    empty = said_of(spark, "", " ")
    assert empty == ([], [], [])


def test_labels_and_sentences(spark):
    rows = [("", "empty_label"), (None, "empty_label"), ("ab", "label_too_short"), ("法", None), ("1 2-3", "non_semantic_label"), ("Models", "generic_label"), ("results", "generic_label"), ("data", None), ("a graph", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", text.invalid_label(F.col("t")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    names = [("f1-score / Accuracy / F1", "metric", "F1 / Accuracy"), ("Large Language Models", "method", "LLM"), ("Graph Neural Net (GNN)", "model", "GNN"), ("A  b", "dataset", "A b")]
    got = spark.createDataFrame(names, "t string, k string, want string").select("want", text.canonical_label(F.col("t"), F.col("k")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    long = spark.createDataFrame([("Seen by Smith et al. in a hyphen- ated paper of 0.91 and more of it! 本文提出一种图神经网络方法。短。",)], "t string")
    assert long.select(text.sentences(F.col("t"))).head()[0] == ["Seen by Smith et al. in a hyphenated paper of 0.", "本文提出一种图神经网络方法。"]


def test_opposite_results(spark):
    rng = random.Random(2)
    rows = [(i, i % 5, rng.choice(["up", "down"]), [f"w{int(rng.random() ** 2 * 30)}" for _ in range(rng.randrange(2, 9))]) for i in range(120)]
    want = []
    for x, y in itertools.product(rows, rows):
        if x[2] == "up" and y[2] == "down" and x[1] != y[1]:
            a, b = set(x[3]), set(y[3])
            j = round(len(a & b) / len(a | b), 4)
            if j >= 0.2:
                want.append((x[0], y[0], j))
    got = compare.opposite_results(spark.createDataFrame(rows, "id long, record long, polarity string, terms array<string>"), limit=100_000)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_similarity(spark):
    rng = random.Random(3)
    docs = {i: {f"t{rng.randrange(25)}" for _ in range(6)} for i in range(40)}
    vec = {i: {t: 1 / math.sqrt(len(s)) for t in s} for i, s in docs.items()}
    rows = [(i, t, w) for i, v in vec.items() for t, w in v.items()]
    scores = {(a, b): round(sum(w * vec[b].get(t, 0) for t, w in vec[a].items()), 4) for a in docs for b in docs if a < b}
    best = set()
    for d in docs:
        mine = sorted((-s, b if a == d else a) for (a, b), s in scores.items() if d in (a, b) and s >= 0.1)[:5]
        best |= {(min(d, o), max(d, o)) for _, o in mine}
    got = {(r["a"], r["b"]): r["score"] for r in vectors.similarity(spark.createDataFrame(rows, "id long, term string, w double"), "id", neighbours=5).collect()}
    assert set(got) == best and all(abs(got[k] - scores[k]) < 2e-4 for k in got)


# relevance, segments, changes, limits

def test_scores(spark):
    s = relevance.topic_score(F.col("t"), F.col("a"), ["solid electrolyte"])
    assert [one(spark, s, t="Solid electrolytes", a="x"), one(spark, s, t="x", a="a solid electrolyte"), one(spark, s, t="x", a="solid"), one(spark, s, t="x", a="y")] == [10, 8, 2, 0]
    due = relevance.retry_due(F.col("k"), F.col("n"), F.lit(None).cast("timestamp"), F.current_timestamp())
    assert one(spark, due, k="transient", n=7) and not one(spark, due, k="terminal", n=1) and not one(spark, due, k="other", n=0)


def test_size_batches(spark):
    rows = [("a", i, n) for i, n in enumerate([10, 50, 50, 200, 1, 1, 1, 1])] + [("b", 0, 5)]
    got = segments.size_batches(spark.createDataFrame(rows, "d string, p int, n int"), "d", "p", F.col("n"), 3, 100).orderBy("d", "p").collect()
    assert [r["batch"] for r in got] == [0, 0, 1, 2, 3, 3, 3, 4, 0]
    assert got[0].asDict().keys() == {"d", "p", "n", "batch"}


def test_pairs_of_texts(spark):
    s = segments.suspicious_pair(F.col("a"), F.col("b"))
    assert one(spark, s, a="x" * 100, b="y" * 5) and one(spark, s, a="One. Two. Three.", b="one two three") and not one(spark, s, a="Hello there.", b="Hallo.")
    u = segments.probably_untranslated(F.col("a"), F.col("b"))
    assert one(spark, u, a="this is the text to translate", b="this is the text to translate") and not one(spark, u, a="this is the text to translate", b="这是要翻译的文本")
    assert one(spark, segments.replace_variants(F.col("a"), "SEI", ["sei layer", "s.e.i"]), a="The SEI layer and seismic") == "The SEI and seismic"


def test_changes(spark):
    log = spark.createDataFrame([("r", 1, 0), ("r", 2, 0), ("r", 3, 1), ("q", 4, 1), ("q", 5, 0)], "res string, cur int, base int")
    got = {r["cur"]: (r["state"], r["revision"]) for r in changes.apply_changes(log, "res", "cur", "base").collect()}
    assert got == {1: ("applied", 1), 2: ("conflict", 1), 3: ("applied", 2), 4: ("conflict", 0), 5: ("applied", 1)}
    assert log.columns == ["res", "cur", "base"]
    page = changes.pull(log, "cur", 1, 2).collect()
    assert [r["cur"] for r in page] == [2, 3] and all(r["has_more"] for r in page)
    c = spark.createDataFrame([(1, "mine", "theirs")], "id int, local string, remote string")
    assert {tuple(r) for r in changes.resolve_conflicts(c, "copy_local").collect()} == {("1", "theirs"), ("1-copy", "mine")}


def test_limits(spark):
    rng = random.Random(8)
    times = sorted(rng.random() * 3000 for _ in range(300))
    rows = [(i, "k" if i % 3 else "j", float(t)) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "id int, key string, ts double")
    log, want = defaultdict(list), {}
    anchor, fixed = {}, {}
    for i, k, t in rows:
        log[k] = [x for x in log[k] if x > t - 60]
        want[i] = len(log[k]) < 3
        if want[i]:
            log[k].append(t)
        if k not in anchor or t - anchor[k][0] >= 60:
            anchor[k] = [t, 0]
        anchor[k][1] += 1
        fixed[i] = anchor[k][1] <= 3
    assert {r["id"]: r["admitted"] for r in limits.sliding_log(events, "key", ["ts", "id"], "ts", 3).collect()} == want
    assert {r["id"]: r["admitted"] for r in limits.anchored_window(events, "key", ["ts", "id"], "ts", 3, 60.0).collect()} == fixed


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 3}", f"2024-01-01 00:{i % 60:02d}:00") for i in range(50)], "id int, key string, at string").withColumn("ts", F.to_timestamp("at"))
    sinks.append_json_lines(rows, str(tmp_path / "in"))
    stream = readers.change_stream(spark, str(tmp_path / "in"), "id int, key string, ts timestamp", 1)
    for _ in range(2):  # a restart reads nothing twice
        sinks.write_stream(limits.first_seen_stream(stream, ["key"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    counts = {}
    sinks.for_each_batch(stream, lambda b, i: counts.setdefault(i, b.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(counts.values()) == 50
    assert {(r["key"], r["count"]) for r in limits.windowed_counts(rows, "key", "ts").collect()} == {("k0", 17), ("k1", 17), ("k2", 16)}


# sources and sinks

def test_records(spark, tmp_path):
    lines = [
        '{"id":"https://x.org/W12","doi":"https://doi.org/10.1/A","title":"A <i>b</i> &amp; c","publication_year":"2020","abstract_inverted_index":{"world":[1],"hello":[0]},"literature_source":"openalex","authorships":[{"author":{"display_name":"N N"}},{"author":{}}],"primary_location":{"source":{"display_name":"J","issn":["1234567X"],"issn_l":"1234-567X"}},"open_access":{"is_oa":true}}',
        "no record",
        '{"literature_source":"arxiv","source_record_id":"2101.00001v2","title":"t"}',
    ]
    (tmp_path / "hits.jsonl").write_text("\n".join(lines))
    hits = readers.read_json_lines(spark, str(tmp_path / "hits.jsonl"))
    assert [r["_corrupt_record"] for r in hits.collect() if r["_corrupt_record"]] == ["no record"]
    a, b = (r.asDict() for r in readers.to_records(hits.filter("_corrupt_record IS NULL")).orderBy("record_key").collect())
    assert a["record_key"] == "arxiv:2101.00001v2" and a["canonical_key"] == "arxiv:2101.00001"
    assert (b["record_key"], b["title"], b["abstract"], b["year"], b["authors"], b["issns"], b["is_open"]) == ("doi:10.1/a", "Ab & c", "hello world", 2020, ["N N"], ["1234-567X"], True)


def test_glossary_and_digest(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# terms\ncell => Zelle\n// none\nbad line\n=> x\n")
    (tmp_path / "g.tsv").write_text("source\ttarget\nanode\tAnode\nbad line\nion => Ion\n")
    (tmp_path / "g.csv").write_text('\ufeffEnglish,zh\n"a, b","c ""d"""\nx,\n')
    (tmp_path / "g.json").write_text('{"k": "v", "": "w"}')
    (tmp_path / "h.json").write_text('[{"en": "p", "zh": "q"}, "r => s", {"term": "t"}, "u"]')
    read = lambda name: {tuple(r) for r in readers.read_glossary(spark, str(tmp_path / name)).collect()}
    assert [read(n) for n in ("g.txt", "g.tsv", "g.csv", "g.json", "h.json")] == [{("cell", "Zelle")}, {("anode", "Anode"), ("ion", "Ion")}, {("a, b", 'c "d"')}, {("k", "v")}, {("p", "q"), ("r", "s")}]
    rows = sinks.with_digest(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), ["a", "b"])
    assert sinks.broken(rows, ["a", "b"]).count() == 0 and sinks.broken(rows.withColumn("b", F.lit("y")), ["a", "b"]).count() == 2
    nodes = spark.createDataFrame([("n", "method", "L", 0.5, ["t"])], "id string, type string, label string, confidence double, tags array<string>")
    sinks.write_graph(nodes, spark.createDataFrame([("n", "m", "USES")], "source string, target string, type string"), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g/nodes"), header=True).first()["tags"] == '["t"]'
    assert sinks.markdown_lines(nodes).first()["value"] == "- **method** L (0.50)"


def test_repaired_gaps(spark):
    """Values are repaired one after the other, each from the last known or repaired one and the next known one."""
    rng = random.Random(6)
    rows = [(g, i, None if rng.random() < (0.15 if g % 2 else 0.4) else float(rng.randrange(50))) for g in range(30) for i in range(rng.randrange(1, 25))]
    want = {}
    for g in range(30):
        y = [v for h, _, v in rows if h == g]
        missing = [i for i, v in enumerate(y) if v is None]
        if len(missing) <= max(2, int(len(y) * 0.2)):
            for i in missing:
                near = [v for v in (next((v for v in y[i - 1 :: -1] if v is not None), None) if i else None, next((v for v in y[i + 1 :] if v is not None), None)) if v is not None]
                y[i] = sum(near) / len(near) if near else None
        want |= {(g, i): v for i, v in enumerate(y)}
    got = series.repair_gaps(spark.createDataFrame(rows, "g int, i int, y double"), "g", "i", "y").collect()
    assert {(r["g"], r["i"]): r["y"] and round(r["y"], 9) for r in got} == {k: v and round(v, 9) for k, v in want.items()}


def test_reading_path(spark):
    rows = [(i, core, bridge, cited, 0, 2000 + i, i == 3) for i, (core, bridge, cited) in enumerate([(0.5, 0.1, 0), (0.1, 0.2, 0), (0.0, 0.0, 0), (0.9, 0.0, 5), (0.1, 0.1, 2), (0.0, 0.13, 0)])]
    best = papers.recommendations(spark.createDataFrame(rows, "id int, core_score double, bridge_score double, citations_in int, cross_links int, year int, archived boolean"))
    got = {r["id"]: (r["stage"], r["score"]) for r in best.collect()}
    recent = {3: 0.06, 4: 0.06, 5: 0.06}
    assert got == {i: ({0: "foundation", 4: "foundation", 1: "bridge", 5: "bridge", 2: "frontier"}[i], round(0.3 * c + 0.2 * b + recent.get(i, 0), 4)) for i, c, b, *_ in rows if i != 3}
    links = spark.createDataFrame([(4, 0), (4, 5), (9, 2)], "source int, target int")
    topics = spark.createDataFrame([(5, "a"), (1, "b"), (2, "b")], "id int, topic string")
    path = papers.reading_path(best, links, topics).orderBy("step").collect()
    assert [(r["id"], r["transition"]) for r in path] == [(0, "start"), (4, "cites_previous"), (5, "cited_by_previous"), (1, "cross_topic"), (2, "shared_topic")]
