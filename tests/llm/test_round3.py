"""Line bitmaps, exact clustering and conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from paperweave.llm import centroids, conversations, line_dedup
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# lines


def line_key(line: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in line.strip(WS))


def plain_lines(rows, least, min_chars=1, keep_first=False):
    """(n_lines, n_dropped, kept text) of each (doc_id, text); rows without an id are told apart by their text."""
    named = [((i, None) if i is not None else (None, t), (t or "").split("\n")) for i, t in rows]
    docs = defaultdict(set)
    for name, lines in named:
        for line in lines:
            docs[line_key(line)].add(name)
    out = []
    for _, lines in named:
        keep = [len(line_key(x)) < min_chars or len(docs[line_key(x)]) < least for x in lines]
        out.append((len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k)))
    return out


def spark_lines(df, **options):
    marked = line_dedup.line_bitmaps(df, **options)
    return marked.withColumn("kept_text", line_dedup.kept_text(F.col("text"), F.col("bitmap")))


def test_lines_match_plain_python(spark):
    rng = random.Random(4)
    pool = ["", "  ", "Line A", " line a\t", "LINE É", "line é", "x" * 300, "b.", "\x0bB.", "ß", "SS", "😀 End"]
    rows = [(rng.choice([None, *range(30)]), "\n".join(rng.choice([*pool, f"own {i} {j}"]) for j in range(rng.randrange(1, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n line A"), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, chars in ((3, 1), (10, 2), (1, 1), (1000, 1)):
        got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.kept_text) for r in spark_lines(df, min_docs=least, min_chars=chars).collect())
        assert got == Counter((i, t, *p) for (i, t), p in zip(rows, plain_lines(rows, least, chars)))


def test_first_lines_stay(spark):
    rows = [(3, "a\nb\na"), (1, "c\nA\na"), (2, "b\nd"), (None, "d\nz")]
    got = {r.doc_id: r.kept_text for r in spark_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=1, keep_first=True).collect()}
    assert got == {None: "d\nz", 1: "c\nA", 2: "b", 3: ""}


def test_lines_of_a_long_text_and_a_hot_line(spark):
    long = "\n".join("same" if i % 3 else f"line {i}" for i in range(200_000))
    rows = [(0, long)] + [(i, "same\nend") for i in range(1, 400)]
    got = {r.doc_id: r for r in spark_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 133_333 and got[0].kept_text == "\n".join(f"line {i}" for i in range(0, 200_000, 3))
    assert got[7].kept_text == "" and got[7].n_dropped == 2
    words = [w.word for w in got[0].bitmap]
    assert words == sorted(words) and len(words) == 3125


def test_lines_on_odd_tables(odd, none):
    out = line_dedup.line_bitmaps(odd.withColumn("bitmap", F.lit(1)).withColumn("_t", F.lit(2)), min_docs=2)
    assert out.count() == odd.count() and line_dedup.line_bitmaps(none).count() == 0
    assert {r.n_lines for r in out.filter("text IS NULL").collect()} == {1}


def test_lines_are_dealt_once(spark, small):
    """The windows use the ranges: no second exchange by hash, no Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    plan = line_dedup.first_lines(line_dedup.occurrences(docs, 1).withColumn("block", F.pmod("doc_id", F.lit(8))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "rangepartitioning" in text and "Python" not in text and "Arrow" not in text


# clusters


def plain_lloyd(vectors, k, rounds):
    import math

    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    held = [q for _, q in sorted(kept, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(held))

    for _ in range(rounds):
        of = defaultdict(list)
        for _, q in kept:
            of[near(q)[1]].append(q)
        held = [[sum(x) // len(of[j]) for x in zip(*of[j])] if j in of else c for j, c in enumerate(held)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=str), held


@pytest.mark.parametrize("k", [1, 3, 500])
def test_clusters_match_plain_python(spark, k):
    rng = random.Random(k)
    vectors = [(i, [rng.choice([-2.0, 0.3, 1e3, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(150)]
    vectors += [(1, vectors[0][1]), (None, [0.0] * 4), (None, [0.0] * 4), (7, None), (8, []), (9, [1.0] * 5), (10, [None, 1.0, 1.0, 1.0]), (11, [float("nan")] * 4), (12, [float("-inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*v, 5) for v in vectors], "vec_id long, embedding array<double>, cluster int").repartition(5)
    got, held = centroids.lloyd(df, width=4, k=k)
    want, center = plain_lloyd(vectors, k, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got.collect()), key=str) == want and held == center
    rows = centroids.with_inertia(got, held).collect()
    assert {r.inertia for r in rows} == {sum(d for _, _, d in want)}
    assert all(r.centroid_sha256 == sha(",".join(map(str, center[r.cluster]))) for r in rows)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    schema = "vec_id long, embedding array<float>"
    got, held = centroids.lloyd(spark.createDataFrame([(1, [1.0])], schema))
    assert got.count() == 0 and centroids.with_inertia(got, held).count() == 0
    got, _ = centroids.lloyd(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], schema), k=1, rounds=0)
    assert max(r.distance for r in got.collect()) <= 64 * (2**28) ** 2


# conversations


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The cheapest edits by trying all of them, over rows (turn, role, text) in order."""
    kinds, best = faults(rows), None
    todo = [(0, "", 0, [])]
    limit = 3 * len(rows)
    while todo:
        i, audit, cost, out = todo.pop()
        if cost > limit:
            continue
        initials = "".join(r[:1] or "?" for r, _ in out)
        body = initials[1:] if initials[:1] == "s" else initials
        if any(c != "ua"[j % 2] for j, c in enumerate(body)) or "s" in body:
            continue
        if i == len(rows) and (not initials or (body and len(body) % 2 == 0)):
            if best is None or (cost, audit) < best[:2]:
                best, limit = (cost, audit, out), cost
        for role in ("user", "assistant"):
            todo.append((i, audit + "I", cost + 2, [*out, (role, "")]))
        if i < len(rows):
            _, role, text = rows[i]
            todo.append((i + 1, audit + "D", cost + 3, out))
            if kinds[i] not in ("blank", "duplicate"):
                cut = kinds[i] == "truncated"
                todo.append((i + 1, audit + "K", cost + cut, [*out, (role, text)]))
                todo += [(i + 1, audit + "R", cost + 2 + cut, [*out, (r, text)]) for r in ("user", "assistant")]
    return best


def plain_report(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    kinds = Counter(faults(rows))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = plain_repair(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def some_conversations(seed, n, most):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"], ["Yes.", "no", " ", "", None, "Why?\n", "é!", "a.b", "x", "So it is."]
    return {c: [(rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{i}.") for i in range(rng.randrange(1, most))] for c in range(n)}


@pytest.mark.parametrize("long_rows", [4096, 2, 0])
def test_repairs_match_a_search(spark, long_rows):
    told = some_conversations(7, 60, 6)
    rows = [(c, *r, 1) for c, x in told.items() for r in x]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int").repartition(3)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.repair_reports(df, long_rows=long_rows).collect()}
    assert got == {c: plain_report(x) for c, x in told.items()}


def test_chunks_give_what_one_pass_gives(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_BITS", 2)
    told = some_conversations(9, 25, 60)
    df = spark.createDataFrame([(c or None, *r) for c, x in told.items() for r in x], "conv_id long, turn long, role string, text string").repartition(4)
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(conversations.repair_reports(df, long_rows=9)) == order(conversations.repair_reports(df))
    assert order(conversations.repaired_rows(df, long_rows=9)) == order(conversations.repaired_rows(df))
    assert order(conversations.repair_reports(df, long_bytes=40)) == order(conversations.repair_reports(df))


def test_repaired_rows_follow_the_grammar(spark, small):
    import re

    df = conversations.damaged(spark.read.parquet(f"{small}/conversations.parquet"))
    by = defaultdict(list)
    for r in conversations.repaired_rows(df).collect():
        by[r.conv_id].append((r.place, r.role, r.text))
    for r in conversations.repair_reports(df).collect():
        told = sorted(by.get(r.conv_id, []))
        assert re.fullmatch("(s?(ua)+)?", "".join(x[1][:1] for x in told))
        assert r.repaired_sha256 == sha("\n".join(f"{role}:{text}" for _, role, text in told))


def test_op13_matches_plain_python(spark, small):
    told = defaultdict(list)
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        rows = told[r.conv_id]
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in r.text if c not in ".!?") if kind == 2 else r.text
        rows += [] if kind == 0 else [(r.turn, "user" if kind == 4 else r.role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in conversations.op13_conversation_repair(spark, small).collect()}
    assert got == {c: plain_report(x) for c, x in told.items()}


def test_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_reports(spark.createDataFrame([], schema)).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "x", True)], schema + ", gone boolean")
    assert tuple(conversations.repair_reports(gone).head()) == (5, 0, 0, 0, 0, 0, 0, "", sha(""))
    damaged = conversations.damaged(spark.createDataFrame([(None, None, None, None)], schema)).collect()
    assert zlib.crc32(b" : ") % 20 not in (0, 1, 3, 4) or damaged
    assert all(r.role in (" ", "user") and r.text in (" ", "") for r in damaged)
