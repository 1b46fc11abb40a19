"""Queries without SQL take every row of their tables: small tables with ids above the former limits, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re
import statistics
from collections import Counter, defaultdict

import pytest
from paperweave import bindings
from paperweave.operators import pairs, papers
from pyspark.sql import functions as F

RUN = bindings.queries()


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("parts")), random.Random(6)
    rows = [(i, f"{rng.choice('abcdefgh') * 3} {rng.choice('ijklmnop') * 3}", rng.choice(["PROMO", "ECONOMY", "NONE"]), f"Brand#{i % 4}") for i in range(380, 440)]
    put(spark, folder, "part", rows, "p_partkey long, p_name string, p_type string, p_brand string")
    words = {i: Counter(re.findall("[a-z0-9]+", " ".join(r).lower())) for i, *r in rows}
    df = Counter(w for c in words.values() for w in c)
    idf = {w: (math.log((len(rows) + 1) / (n + 1)) + 1) * (0.18 if n / len(rows) > 0.72 else 1) for w, n in df.items()}
    raw = {i: {w: round(math.log1p(n) * idf[w], 9) for w, n in c.items()} for i, c in words.items()}
    return folder, {i: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in raw.items()}, {i: b for i, _, _, b in rows}


def test_similarity_links(spark, parts):
    folder, vec, _ = parts
    total = Counter()
    for t in {t for v in vec.values() for t in v}:
        held = sorted(i for i in vec if t in vec[i])
        # lists of over 30 papers (0.4 of 60, at least 30) link each with the next two
        pairs = itertools.combinations(held, 2) if len(held) <= 30 else [(a, b) for k, a in enumerate(held) for b in held[k + 1 : k + 3]]
        for a, b in pairs:
            total[a, b] += vec[a][t] * vec[b][t]
    scores = {k: round(s, 4) for k, s in total.items()}
    assert any(sum(t in v for v in vec.values()) > 30 for t in {t for v in vec.values() for t in v})
    got = {(r["a"], r["b"]): r["score"] for r in RUN["similarity_links"](spark, folder).collect()}
    assert all(abs(s - scores[k]) < 2e-4 for k, s in got.items())
    for d in vec:  # ties at the twelfth place aside, each part has its best
        mine = sorted((s for k, s in scores.items() if d in k and s >= 0.1), reverse=True)[:12]
        assert sum(d in k for k in got) >= len(mine)
        assert all(k in got for k, s in scores.items() if d in k and mine and s > mine[-1] + 2e-4)
    assert {i for k in got for i in k} == set(vec)


def test_citations_add_to_similarity(spark):
    from paperweave.operators import vectors

    v = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "a", 0.6), (3, "c", 0.8)], "doc int, term string, w double")
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (2, 9), (2, 2)], "source int, target int")
    assert {tuple(r) for r in vectors.similarity(v, "doc", links=links).collect()} == {(1, 2, 0.22), (1, 3, 0.82)}


def test_topic_cohesion(spark, parts):
    folder, vec, topic = parts
    total = defaultdict(Counter)
    for i, v in vec.items():
        for w, x in v.items():
            total[topic[i]][w] += x
    want = {i: sum(x * total[topic[i]][w] for w, x in v.items()) / math.sqrt(sum(y * y for y in total[topic[i]].values())) for i, v in vec.items()}
    assert {r["doc"]: r["cosine"] for r in RUN["topic_cohesion"](spark, folder).collect()} == {i: pytest.approx(c, abs=2e-4) for i, c in want.items()}


def test_box_overlaps(spark, tmp_path):
    rng = random.Random(7)
    rows = [(o, n, rng.randrange(1, 500), float(rng.randrange(1, 40)), 0.02, 0.05) for o in range(1990, 2030) for n in range(rng.randrange(1, 7))]
    put(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_tax double, l_discount double")
    want = {}
    for x, y in itertools.product(rows, rows):
        a, b = (r[1] * 100_000 + r[2] for r in (x, y))
        i = max(12 - abs(x[3] - y[3]), 0) * max(9 - abs(x[2] % 5 - y[2] % 5) * 4, 0)
        if x[0] == y[0] and a < b and i > 0:
            want[x[0], a, b] = pytest.approx(i / (216 - i), abs=1e-4)
    assert max(k[0] for k in want) >= 2000
    assert {(r["page"], r["a"], r["b"]): r["iou"] for r in RUN["box_overlaps"](spark, str(tmp_path)).collect()} == want


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of more parts than the former 80, whose parts behind the 80th alone make the links between some parts; repeated rows and nulls."""
    folder, rng = str(tmp_path_factory.mktemp("orders")), random.Random(9)
    rows = [(o, p) for o in range(3) for p in range(130)] + [(10 + o, p) for o in range(3) for p in [*range(1000, 1090), 2000]]
    rows += [(20 + o, rng.randrange(90, 300)) for o in range(60) for _ in range(rng.randrange(1, 7))]
    rows += rows[::5] + [(None, 5), (None, 129), (1, None), (None, None)]
    rng.shuffle(rows)
    put(spark, folder, "lineitem", rows, "l_orderkey long, l_partkey long")
    held, groups = defaultdict(set), defaultdict(set)
    for o, p in rows:
        held[p].add(o)
        if None not in (o, p):
            groups[o].add(p)
    shared = Counter(k for g in groups.values() for k in itertools.combinations(sorted(g), 2))
    return folder, shared, {p: len(o) for p, o in held.items()}


@pytest.mark.parametrize("block", [16, 1000])
def test_cocitation_of_large_orders(spark, orders, monkeypatch, block):
    """Every part of an order pairs with every other, in one piece or in blocks that meet two by two."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    folder, shared, n = orders
    want = {(a, b): (s, pytest.approx(s / (n[a] + n[b] - s), abs=6e-5)) for (a, b), s in shared.items()}
    rows = RUN["cocitation"](spark, folder).collect()
    assert len(rows) == len(want)
    assert {(r["a"], r["b"]): (r["shared"], r["score"]) for r in rows} == want
    assert (100, 129) in want and (1089, 2000) in want


@pytest.mark.parametrize("block", [16, 1000])
def test_components_of_large_orders(spark, orders, monkeypatch, block):
    """Parts that only meet behind the 80th part of their orders are linked as well."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    folder, shared, _ = orders
    links = [k for k, n in shared.items() if n >= 3]
    least = {i: i for k in links for i in k}
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert least[129] == 0 and least[2000] == 1000
    rows = RUN["connected_components"](spark, folder).collect()
    assert len(rows) == len(least) and {r["id"]: r["component"] for r in rows} == least


def test_large_groups_are_cut(spark, monkeypatch):
    """A group of 100 items spreads over many cells, none of which holds more than two blocks of it; a small group stays in one."""
    monkeypatch.setattr(pairs, "BLOCK", 10)
    links = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(7)], "g long, i long")
    cells = Counter((r["g"], r["_x"], r["_y"]) for r in pairs.blocks(links, "g", "i").collect())
    assert cells[2, 0, 0] == 7 and len([c for c in cells if c[0] == 2]) == 1
    large = {c: n for c, n in cells.items() if c[0] == 1}
    assert len(large) == 55 and max(large.values()) < 50 and sum(large.values()) == 1000


def test_opposite_results_all(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(40):
        said = ["The yield increased", "The yield decreased", "The yield stayed"][rng.randrange(3)]
        words = [rng.choice(["lithium", "anode", "cathode", "sodium", "glass", "solid"]) + rng.choice("xyz") for _ in range(150 if i % 2 else 5)]
        rows.append((i, " ".join([said, *words]), "en" if i % 3 else "de"))
    put(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    terms = {i: set(re.findall("[a-z]{5,}", t.lower())) for i, t, _ in rows}
    up, down = ({i for i, t, _ in rows if w in t} for w in ("increased", "decreased"))
    likes = {(a, b): round(len(terms[a] & terms[b]) / len(terms[a] | terms[b]), 4) for a in up for b in down}
    want = sorted((-s, *k) for k, s in likes.items() if s >= 0.2)[:40]
    assert any(len(rows[i][1]) >= 700 for _, *k in want for i in k)
    assert [(-r["likeness"], r["a"], r["b"]) for r in RUN["opposite_results_all"](spark, str(tmp_path)).collect()] == want


def test_turning_points(spark, tmp_path):
    put(spark, tmp_path, "customer", [(i, "S" + str(i % 2)) for i in range(30, 60)], "c_custkey long, c_mktsegment string")
    put(spark, tmp_path, "orders", [(i, c, f"{y}-03-01", 1.0) for i, (c, y) in enumerate([(31, 1992), (51, 1993), (53, 1993), (55, 1993), (57, 1994), (50, 1995)])], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double")
    got = {(r["topic"], r["year"], r["kind"]) for r in RUN["turning_points"](spark, str(tmp_path)).collect()}
    assert got == {("S1", 1992, "emergence"), ("S1", 1993, "expansion"), ("S1", 1995, "decline"), ("S0", 1995, "emergence"), ("S0", 1994, "decline")}


def test_resampled_series(spark, tmp_path):
    rows = [(u, "view", 1800 * c + k, float(u + k)) for k, (u, c) in enumerate([(1, 0), (9, 0), (9, 2), (70, 4)])]
    spark.createDataFrame(rows, "user_id long, event_type string, at long, value double").withColumn("ts", F.timestamp_seconds("at")).write.parquet(f"{tmp_path}/events.parquet")
    at = {c: statistics.median(v) for c, v in {0: [1.0, 10.0], 2: [11.0], 4: [73.0]}.items()}
    want = {c: at.get(c, (at.get(c - 1, 0) + at.get(c + 1, 0)) / 2) for c in range(5)}
    assert {r["cell"]: r["y"] for r in RUN["resampled_series"](spark, str(tmp_path)).collect()} == want


def test_chains_of_any_length(spark, tmp_path):
    orders = [(5 * i + 1, 300, "1995-01-01") for i in range(230)] + [(5 * i + 2, 7, f"{1992 + i}-01-01") for i in range(4)]
    put(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_orderdate string")
    want = {5 * i + 1: (1.0 + i, i, 5 * i - 4 if i else None) for i in range(230)} | {5 * i + 2: (pytest.approx(1 + 1.04 * i), i, 5 * i - 3 if i else None) for i in range(4)}
    assert {r["id"]: (r["score"], r["length"], r["parent"]) for r in RUN["citation_paths"](spark, str(tmp_path)).collect()} == want


def test_lines_between_joints(spark):
    """Long lines that part and meet again: scores, lengths and parents of all papers."""
    rng, edges, last = random.Random(3), set(), 0
    for _ in range(4):
        ends, start = [], last
        for n in (rng.randrange(1, 5), rng.randrange(1, 5), 3):
            at = start
            for _ in range(n):
                last += 1
                edges.add((last, at))
                at = last
            ends.append(at)
        last += 1
        edges |= {(last, e) for e in ends}
    key = {i: rng.randrange(4) / 4 for i in range(last + 1)}
    best = {}
    for v in range(last + 1):
        best[v] = max([(round(best[u][0] + 1 + 0.35 * key[v], 6), best[u][1] + 1, u) for w, u in edges if w == v], default=(1 + 0.35 * key[v], 0, None))
    got = papers.longest_paths(spark.createDataFrame(sorted(edges), "source long, target long"), spark.createDataFrame([(i, 2000, k) for i, k in key.items()], "id long, year int, key double"))
    assert {r["id"]: (r["score"], r["length"], r["parent"]) for r in got.collect()} == {v: (pytest.approx(s, abs=1e-5), n, p) for v, (s, n, p) in best.items()}


@pytest.mark.parametrize("block", [16, 1000])
def test_people_have_all_their_partners(spark, tmp_path, monkeypatch, block):
    """More than 40 people of a paper and more than 600 pairs: partners, scores and links are those of all of them."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = random.Random(3)
    rows = [(1, p) for p in range(60)] + [(k, rng.randrange(90)) for k in range(2, 60) for _ in range(4)] + [(99, 200)]
    items = [(o, 7, s, float(1 + i % 9), "ANR"[i % 3], f"199{i % 8}-01-02") for i, (o, s) in enumerate(rows)]
    frame = spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, day string")
    frame.withColumn("l_shipdate", F.to_date("day")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    held = defaultdict(set)
    for o, s in rows:
        held[o].add(s)
    met = defaultdict(list)
    for o in sorted(held):
        for k in itertools.combinations(sorted(held[o]), 2):
            met[k].append(o)
    assert len(met) > 600
    near = Counter(p for k in met for p in k)
    own = {p: [x for x in items if x[2] == p] for _, p in rows}
    told = {p: (len({x[0] for x in v}), sum(int(x[3]) for x in v), near[p], len({x[4] for x in v})) for p, v in own.items()}
    top = [max(1, max(x)) for x in zip(*told.values(), strict=True)]
    got = {r["person"]: r for r in RUN["research_people"](spark, str(tmp_path)).collect()}
    assert {p: (r["papers"], r["citations"], r["partners"], r["topics"]) for p, r in got.items()} == told
    for p, x in told.items():
        assert got[p]["score"] == pytest.approx(sum(w * n / m for w, n, m in zip((0.36, 0.30, 0.20, 0.14), x, top, strict=True)), abs=1e-4)
    members = spark.createDataFrame(rows, "paper long, person long")
    links = papers.collaboration(members, "paper", "person", cap=None, limit=None).collect()
    assert {(r["a"], r["b"]): (r["count"], r["evidence"]) for r in links} == {k: (len(v), ",".join(map(str, v[:12]))) for k, v in met.items()}


@pytest.mark.parametrize("kind, lane, held", [("long", 512, 2_000_000), ("long", 3, 40), ("int", 7, 1), ("string", 512, 40)])
def test_capped_pairs_travel_as_lists(spark, monkeypatch, kind, lane, held):
    """Pairs of whole numbers are shuffled as bytes of lists, without joins, and are those of plain Python: negative and distant ids, repeats, nulls, large groups, an item of many groups."""
    from paperweave.operators import packed

    for name, value in (("LANE", lane), ("HELD", held), ("BYTES", held)):
        monkeypatch.setattr(packed, name, value)
    rng = random.Random(4)
    far = [-(2**31), 2**31 - 1] if kind == "int" else [-(2**63), 2**63 - 1, -(2**40), 2**62]
    ids = [*range(-20, 40), *far]
    rows = [(g, rng.choice(ids)) for g in range(60) for _ in range(rng.randrange(1, 30))] + [(g, 5) for g in range(50)] + [(None, 5), (None, 6), (3, None), (3, None)]
    rows += [(99, i) for i in ids]
    rows = [(g, str(i) if kind == "string" and i is not None else i) for g, i in rows]
    frame = spark.createDataFrame(rows, f"g int, i {kind}")
    got = pairs.shared_pairs(frame, "g", "i", 12)
    assert dict(got.dtypes) == {"a": frame.schema["i"].dataType.simpleString(), "b": frame.schema["i"].dataType.simpleString(), "shared": "bigint", "score": "double"}
    assert kind == "string" or "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    n = Counter(i for _, i in set(rows) if i is not None)
    shared = Counter()
    for g in {g for g, _ in rows if g is not None}:
        shared.update(itertools.combinations(sorted({i for h, i in rows if h == g and i is not None})[:12], 2))
    found = got.collect()
    assert len(found) == len(shared) and {(r["a"], r["b"]): r["shared"] for r in found} == shared
    assert all(r["score"] == pytest.approx(r["shared"] / (n[r["a"]] + n[r["b"]] - r["shared"]), abs=5.1e-5) for r in found)
