"""Near-duplicates, suffix arrays, repeated strings, the classifier and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from paperweave.llm import neardup, quality_model, secrets, suffix_dedup
from paperweave.llm.common import table
from paperweave.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    of = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            of[g].add(i)
    pairs = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def edited(spark):
    """Chains of documents, each edited a little from the one before, around the threshold."""
    rng, rows = random.Random(4), []
    for _ in range(25):
        w = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows) + 1, " ".join(w)))
            w = list(w)
            for _ in range(rng.randrange(0, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = f"t{rng.randrange(3000)}"
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates(spark, small, edited):
    for docs in (edited, table(spark, small, "documents")):
        want = plain_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == len(want)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_ids_with_several_texts(spark):
    """Every row is linked by its own text, whichever text of its id is the greater one."""
    rng = random.Random(8)
    texts = []
    for _ in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(58)]
        texts += [" ".join(w), " ".join([*w[:-2], "other", "end"])]
    rows = [(rng.randrange(1, 25), t) for t in texts] + [(1, "a " + texts[0]), (1, "zz " + texts[3]), (2, texts[1]), (None, texts[0])]
    numbered = plain_classes([(k, t) for k, (i, t) in enumerate(rows) if i is not None])
    least = {}
    for k, (_, c) in numbered.items():
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    want = sorted([(rows[k][0], n, least[c]) for k, (n, c) in numbered.items()] + [(None, 54, None)], key=str)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_near_duplicates_odd(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 4, None))
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert neardup.near_duplicates(none).count() == 0


def test_sketches_merge_and_estimate():
    a, b = np.arange(1, 4001, dtype=np.uint64), np.arange(1001, 5001, dtype=np.uint64)
    a, b = neardup.mix(a * neardup.MIX_A), neardup.mix(b * neardup.MIX_A)
    sa, sb, both = neardup.registers([a, b, np.union1d(a, b)])
    assert (neardup.merge(sa, sb) == both).all()
    est = neardup.jaccard_estimate(*(np.array([x]) for x in ((sa > sb).sum(), (sa < sb).sum(), (sa == sb).sum(), 4000.0, 4000.0)))
    assert est[0] == pytest.approx(3000 / 5000, abs=0.08)


def test_components(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {x: find(x) for x in up}
    for at_once in (neardup.EDGES_AT_ONCE, 0):  # in one task, and by labels that pass between tasks
        monkeypatch.setattr(neardup, "EDGES_AT_ONCE", at_once)
        got = neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
        assert {r["id"]: r["component"] for r in got.collect()} == want


# suffix arrays and repeated strings

def test_suffix_array():
    rng = np.random.default_rng(3)
    cases = [rng.integers(0, k, n) for k in (1, 2, 4, 200) for n in (1, 2, 3, 17, 400)] + [np.array([1, 0] * 60), np.array([2, 1, 2, 1, 2, 0, 2, 1])]
    for x in cases:
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert np.asarray(suffix_array(np.asarray(x, np.int64))).tolist() == want


def plain_removal(rows):
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    seen, out = {}, {}
    for i, t in texts:
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def spliced(spark):
    rng = random.Random(11)
    piece = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [piece(n) for n in (45, 49, 50, 51, 60, 130, 400)] + ["ab" * 40, "x" * 90, "é" * 30]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(piece(rng.randrange(0, 120)))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(0, 5)
                parts.append(s[a : len(s) - rng.randrange(0, 5)])
        rows.append((i, "".join(parts)))
    rows += [(500, rows[3][1]), (501, rows[3][1] + "tail"), (502, None), (503, ""), (504, "x" * 300), (505, "x" * 70)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def removed(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in rows.collect()}


def test_suffix_dedup(spark, small, spliced):
    for docs in (spliced, table(spark, small, "documents")):
        want = plain_removal([(r["doc_id"], r["text"]) for r in docs.collect()])
        got = removed(suffix_dedup.deduplicate(docs))
        assert got == want


def test_hot_anchors(spark, small, spliced, monkeypatch):
    """Strings of hot anchors are dealt by their digests: the same bytes go, with few and with all anchors hot."""
    for docs, hot in ((spliced, 3), (spliced, 0), (table(spark, small, "documents"), 2)):
        monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
        docs = docs.repartition(5)
        assert removed(suffix_dedup.deduplicate(docs)) == plain_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_TEXTS, 1])
def test_runs_of_one_byte(spark, monkeypatch, hot):
    """Periodic texts: the bytes that go, and one context for each run."""
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    rows = []
    for i in range(24):
        period = rng.choice(["x", "-", "ab", "xyz", "0123456789", noise(30), noise(40)])
        n = rng.choice([30, 49, 50, 51, 90, 200, 3000])
        rows.append((i, noise(rng.randrange(0, 60)) + (period * n)[:n] + noise(rng.randrange(0, 60)) + (period * 80)[: rng.randrange(0, 80)]))
    rows += [(50, "=" * 300_000), (51, "a" + "=" * 200_000 + "b"), (52, "=" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removed(suffix_dedup.deduplicate(docs)) == plain_removal(rows)
    data = np.frombuffer(b"\0" * 34 + b"=" * 100_000 + b"\0" * 68, np.uint8)
    text, at, h = suffix_dedup.anchors([b"=" * 100_000])
    sent, more = suffix_dedup.periodic(data, 34 + at, text, h)
    assert len(at) > 99_000 and sent.sum() < 100 and (more + 1).sum() == len(at)


def test_repeated_ids(spark):
    """Texts of one id are one document: each is judged against smaller ids, and larger ids against all of them."""
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("abcdef") for _ in range(120)) for _ in range(3))
    rows = [(1, a + "1"), (1, b + "2"), (1, a + "1"), (2, "x" + a), (3, "y" + b + c), (4, c + "z")]
    got = sorted((r["doc_id"], r["n_removed"], bytes(r["kept"]).decode()) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted([(1, 0, a + "1"), (1, 0, b + "2"), (1, 0, a + "1"), (2, 120, "x"), (3, 120, "y" + c), (4, 120, "z")])


def test_suffix_dedup_odd(odd, none):
    got = suffix_dedup.deduplicate(odd)
    rows = got.collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_bytes"] == by[2]["n_bytes"] == 0 and by[7]["n_removed"] == 0
    assert by[8]["n_removed"] == by[7]["n_bytes"] and by[9]["n_removed"] == 0
    assert suffix_dedup.deduplicate(none).count() == 0


# classifier

def test_quality_model(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality_model.op7_quality_model(spark, folder).collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    import zlib

    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_model_odd(spark, odd, none, small):
    labels = table(spark, small, "labels")
    model = quality_model.fit_quality_model(table(spark, small, "documents"), labels)
    rows = quality_model.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.score_quality(none, model).count() == 0
    flat = quality_model.fit_quality_model(none, labels.filter("false"))
    assert {r["score"] for r in quality_model.score_quality(odd, flat).collect()} == {0.5}


def test_scores_are_plain(spark, small):
    """The network, its temperature and the pooled features of some texts, read one word at a time."""
    import math

    model = quality_model.fit_quality_model(table(spark, small, "documents"), table(spark, small, "labels"))
    texts = ["some words of a text, with 12 numbers and 3 more", "one", "", "a a a b", "Éa bÉ"]
    got = [r["score"] for r in sorted(quality_model.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect(), key=lambda r: r["doc_id"])]
    w1, b1, w2, b2 = model.layers
    for text, score in zip(texts, got, strict=True):
        features = []
        for (slots, _), v in zip(quality_model._slots([text.encode()]), model.vectors, strict=True):
            rows = [v[s].astype(float) for s in slots]
            n = len(rows)
            mean = [sum(r[k] for r in rows) / n if n else 0.0 for k in range(quality_model.DIM)]
            square = [sum(r[k] * r[k] for r in rows) / n if n else 0.0 for k in range(quality_model.DIM)]
            dots = [sum(a * b) for a, b in zip(rows, rows[1:])]
            features += [*mean, *(math.sqrt(max(0.0, s - m * m)) for s, m in zip(square, mean, strict=True))]
            features += [sum(dots) / n if n else 0.0, sum(d > 0.999 for d in dots) / n if n else 0.0]
        features.append(math.log1p(n) / 10)
        z = [(f - c) / s for f, c, s in zip(features, model.center, model.scale, strict=True)]
        hidden = [math.tanh(sum(z[i] * w1[i][j] for i in range(len(z))) + b1[j]) for j in range(len(b1))]
        logit = (sum(h * w2[j][0] for j, h in enumerate(hidden)) + b2[0]) / model.temperature
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=2e-4)


def test_calibrated(spark):
    """Among rows held out, the mean score is near the share of good ones, overall and in halves by score."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect() if r["quality"] is not None}
    rows = sorted((r["score"], labels[r["doc_id"]]) for r in quality_model.op7_quality_model(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels)
    half = len(rows) // 2
    for part in (rows, rows[:half], rows[half:]):
        assert np.mean([s for s, _ in part]) == pytest.approx(np.mean([y for _, y in part]), abs=0.12)


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "a b c"), (1, None), (2, "x y")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, 1), (1, 1), (2, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r["doc_id"]: r["held_out"] for r in quality_model.op7_quality_model(spark, str(tmp_path)).collect()}
    assert rows[None] is False and set(rows) == {None, 1, 2}


# pipeline

def test_stages_keep_columns(spark, odd, small):
    """Columns of the input with names that operators use come out of every stage but the last with their values."""
    import corpus_pipeline as p

    from .test_text_operators import assert_values_stay, with_clashes

    docs = with_clashes(odd)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert_values_stay(out.collect())
        assert stage(spark, docs.filter("false"), small).count() == 0
    assert p.STAGES[-1][1](spark, docs, small).count() == odd.count()


def test_pipeline_stages(spark, small, tmp_path):
    import corpus_pipeline as p

    docs = table(spark, small, "documents")
    seen = [docs]
    for name, stage in p.STAGES:
        out = stage(spark, seen[-1], small)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
    good, unique, clean, mixed, tokens = seen[1:]
    assert all(x.columns == docs.columns for x in (good, unique, clean, mixed))
    classes = plain_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in unique.collect()} == {c for _, c in classes.values()} and unique.count() == len({c for _, c in classes.values()})
    assert clean.count() == unique.count()
    assert not any(list(secrets.secret_spans(clean).filter("size(spans) > 0").collect()))
    ids = Counter(r["doc_id"] for r in mixed.collect())
    assert set(ids) <= {r["doc_id"] for r in clean.collect()} and max(ids.values()) <= 2
    assert Counter(r["doc_id"] for r in tokens.collect()) == ids
    text = {r["doc_id"]: r["text"] or "" for r in clean.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in tokens.collect())


def test_pipeline_runs(spark, small):
    import corpus_pipeline as p

    assert p.run(spark, small).count() > 0
