"""Mixing, extraction, encoding, secrets, rules, licences and media against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperweave.llm import bpe, html_extract, media, mixing, quality_rules, secrets
from paperweave.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# mixing

def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark, small):
    docs = table(spark, small, "documents")
    rows = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(words(r["text"]))
        sizes[r["source"]] += r["size"]
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.2)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_plan(docs).collect()))
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


CLASH = {"spans": "s", "size": 7, "score": "sc", "kept": 9, "name": "nm", "bucket": "bk", "key": 3, "component_id": "cc", "words": 4, "ids": 8}
MORE = {"Source_Size": 1, "target": "t", "rate": "r", "copies": "c", "taken": "k", "_copy": "y", "_source": "z", "_key": "u", "_kinds": "v", "_gaps": "w", "predicted": "p", "_place": "q"}


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(k) for k, v in MORE.items()])


def assert_values_stay(rows):
    for r in rows:
        assert {k: r[k] for k in CLASH} == CLASH and {k: r[k] for k in MORE} == MORE


def test_values_of_clashing_columns(odd):
    """Mixing and redacting give the input's columns back with the input's values."""
    docs = with_clashes(odd)
    for found in (mixing.mix(docs), secrets.redact(docs)):
        assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
        assert_values_stay(found.collect())
    assert secrets.redact(docs).count() == odd.count()
    spans = secrets.secret_spans(docs)
    assert sorted(spans.columns) == sorted(docs.columns)
    for r in spans.collect():
        assert {k: r[k] for k in MORE} == MORE and [tuple(x) for x in r["spans"]] == plain_spans(r["text"])


def test_mixing_odd(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count() and all(r["target"] is not None for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(none).count() == 0


# extraction

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home, sweet</a></li></ul></nav><header><h1>Site</h1></header><div class="ad">Buy, now, please, this thing.</div>
<article><h2>A &amp; B</h2><p>First  paragraph, with commas,
 and enough text to count as a paragraph of its own.</p><p>Second one &eacute;&#233;&#x1F600;, with more, and more, and more text.<br>Next line, of some length.</p></article>
<div class="comments"><p>A reader says, this is great, really, really great stuff, yes.</p></div><footer>Copyright, all, rights.</footer></body></html>"""


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "   "), (5, "x", "<p>" * 3000 + "deep text, that is long enough to count")], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in html_extract.extract_main_text(rows).collect()}
    text = found[1]["text"]
    assert text.startswith("A & B\nFirst paragraph, with commas, and enough text to count as a paragraph of its own.\nSecond one éé😀, with more")
    for gone in ("Home", "Buy", "reader", "Copyright", "Site", "var a"):
        assert gone not in text
    assert found[2]["text"] == found[3]["text"] == found[4]["text"] == ""
    assert "deep text" in found[5]["text"]


def test_extraction_of_the_pages(spark, small):
    from paperweave.llm.html_extract import op2_html_text

    rows = op2_html_text(spark, small).collect()
    pages = {r["page_id"]: r["html"] for r in table(spark, small, "pages").collect()}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("<script" in r["text"] for r in rows) and sum(r["n_chars"] > 0 for r in rows) > 0.8 * len(rows)


# encoding

def test_encoding(spark, small, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    own = spark.createDataFrame([(1, "<|endoftext|>a<|endoftext|>"), (2, "aaaaaaa  \n\n\t x  ''s 'll 12 34é"), (3, " ​퟿\U0001f600" * 3), (4, "   "), (5, "I'LL don't\r\n\r\n  z")], "doc_id long, text string")
    for docs in (table(spark, small, "documents").select("doc_id", "text"), own, odd.select("doc_id", "text")):
        source = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)
        got = sorted(((r["doc_id"], r["text"] or "", list(r["ids"]), r["decoded"]) for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()), key=str)
        want = t.encode_batch([x for _, x in source], add_special_tokens=False)
        assert [(a, b) for a, b, *_ in got] == source
        for (_, _, ids, decoded), e in zip(got, want, strict=True):
            assert ids == e.ids and decoded == t.decode(e.ids, skip_special_tokens=False)
    assert set(odd.columns) == set(bpe.bpe_encode(odd).columns)
    assert bpe.token_digests(bpe.bpe_decode(bpe.bpe_encode(none))).count() == 0


# secrets

def plain_spans(text, rules=secrets.RULES):
    out = []
    for no, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), no, r.kind, m.end()))
    return sorted(out)


def test_secrets(spark, small, odd, none):
    for docs in (table(spark, small, "documents"), odd):
        for r in secrets.secret_spans(docs).collect():
            source = r["text"] or ""
            assert [tuple(s) for s in r["spans"]] == plain_spans(source)
    rows = secrets.redact(odd).collect()
    assert len(rows) == odd.count() and secrets.redact(odd).columns == odd.columns
    clean = next(r for r in rows if r["doc_id"] == 10)
    assert clean["text"].startswith("[SECRET] and [SECRET] é 😀 ".replace("[SECRET] and", '[SECRET]" and')) and "AKIA" not in clean["text"] and clean["n_chars"] == len(clean["text"])
    assert secrets.secret_spans(none).count() == 0


def test_trigram_queries_are_necessary():
    samples = ["password=abcdefghijkl", "API_KEY : 'abcdefghijklmnop'", "apikey=abcdefghijkl", "Token=abcdefghijkl", "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "eyJaaaaaaaaaaa.eyJaaaaaaaaaaa.aaaaaaaaaaa", "AIza" + "a" * 35]
    for s in samples:
        held = {s.lower()[i : i + 3] for i in range(len(s) - 2)}
        for r in secrets.RULES:
            if re.search(r.pattern, s):
                assert any(c <= held for c in secrets.trigram_query(r.pattern))
    assert secrets.trigram_query("[0-9a-f]{16,}") == secrets.ANY


# quality rules

def plain_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def spark_buckets(text, buckets):
    """Buckets of words and of neighbouring words, with xxHash64 of seed 42 as Spark chains it."""
    import xxhash

    h = lambda x, seed=42: xxhash.xxh64(x.encode(), seed=seed % (1 << 64)).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = words(text.lower())
    return [signed(h(x)) % buckets for x in w] + [signed(h(b, h(a))) % buckets for a, b in zip(w, w[1:])]


def quartile(values, q):
    at = (len(values) - 1) * q
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("bound", [quality_rules.BROADCAST_IDS, -1])
def test_quality_rules(spark, small, monkeypatch, bound):
    """Counts, scores, the fence and verdicts of the query, all in plain Python; with and without the broadcast."""
    import math

    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", bound)
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}
    trusted = {r["doc_id"] for r in table(spark, small, "labels").collect() if r["quality"] == 1}
    n = quality_rules.BUCKETS
    grams = {i: spark_buckets(t, n) for i, t in docs.items()}
    raw, good = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            good.update(g)
    weight = [math.log((good[b] + 1) / (sum(good.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n)) for b in range(n)]
    score = {i: sum(weight[b] for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    ranked = sorted(round(score[i], 4) for i in trusted if grams.get(i))
    least = quartile(ranked, 0.25) - 3 * (quartile(ranked, 0.75) - quartile(ranked, 0.25))
    rows = quality_rules.op6_quality_rules(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        c = plain_counts(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == c
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        assert r["base_failed"] == failed and r["score"] == pytest.approx(score[r["doc_id"]], abs=1e-9)
        assert abs(score[r["doc_id"]] - least) < 1e-6 or r["kept"] == (not failed and score[r["doc_id"]] >= least)
    assert {r["kept"] for r in rows} == {True, False}


def test_quality_rules_odd(spark, odd, none):
    more = odd.selectExpr("*", "'a' AS _low", "7 AS n_words", "'w' AS words2")
    for r in quality_rules.quality_verdicts(quality_rules.quality_scores(more, [0.5] * 64), 0.0).collect():
        n = plain_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert (r["_low"], r["words2"], r["key"], r["name"]) == ("a", "w", 3, "nm")
        assert r["score"] == pytest.approx(0.5 if n[0] else 0.0) and r["kept"] == (not r["base_failed"])
    assert quality_rules.quality_scores(none, [0.0] * 64).count() == 0
    assert quality_rules.ngram_weights(none, odd.select("doc_id").limit(0)) == [0.0] * quality_rules.BUCKETS
    assert quality_rules.trusted_fence(quality_rules.quality_scores(odd, [0.0] * 64), none) == float("-inf")


def test_ngram_scores_by_hand(spark):
    """The ratio of a bucket, counted in plain Python with the same hash."""
    import math

    rows = [(1, "a b a"), (2, "b c"), (3, None), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(spark_buckets(t or "", 64))
        if i in (1, 4):
            good.update(spark_buckets(t or "", 64))
    want = [math.log((good[b] + 1) / (sum(good.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64)) for b in range(64)]
    trusted = spark.createDataFrame([(1,), (4,)], "doc_id long")
    assert quality_rules.ngram_weights(docs, trusted, 64) == pytest.approx(want)


# media

def test_media(spark, small, odd, none):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}
    for r in media.op9_media(spark, small).collect():
        data = docs[r["doc_id"]].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert r["n_bytes"] == len(data) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64
    assert media.text_to_avi(odd).count() == odd.count()
    assert media.text_to_avi(none).count() == 0


def test_frames_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for samples in (rng.integers(0, 256, (5, 576), dtype=np.uint8), np.zeros((3, 576), np.uint8), np.tile(np.array([0, 255], np.uint8), (2, 288))):
        images = media.encode_frames(samples)
        back = media.read_avi(media.write_avi(images))
        assert back == images
        assert (np.stack(media.decode_frames(back)).reshape(samples.shape) == samples).all()
        assert all((media._samples(media.parse_frame(x)).ravel() == s).all() for x, s in zip(images, samples, strict=True))  # code by code


def plain_jpeg(x, predictor):
    """A lossless JPEG by the rules of the format, one sample after the other, with a table of five-bit codes."""
    h, w = len(x), len(x[0])
    bits = ""
    for i in range(h):
        for j in range(w):
            a, b, c = (x[i][j - 1] if j else 0), (x[i - 1][j] if i else 0), (x[i - 1][j - 1] if i and j else 0)
            guess = 128 if not i and not j else a if not i else b if not j else [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
            d = x[i][j] - guess
            n = abs(d).bit_length()
            bits += f"{n:05b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    table = bytes([0x01]) + bytes([0, 0, 0, 0, 17] + [0] * 11) + bytes(range(17))
    head = seg(0xE0, b"JFIF\0") + seg(0xC3, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    return b"\xff\xd8" + head + seg(0xC4, table) + seg(0xDA, bytes([1, 1, 0x10, predictor, 0, 0])) + data + b"\xff\xd9"


def test_other_lossless_frames():
    """Frames of other sizes, tables and predictors, and images that are no such frames."""
    import random

    rng = random.Random(4)
    for predictor in range(1, 8):
        x = [[rng.randrange(256) for _ in range(13)] for _ in range(7)]
        assert media.decode_frames([plain_jpeg(x, predictor)])[0].tolist() == x
    good = plain_jpeg(x, 1)
    for bad in (b"", b"GIF89a", good[:20], good.replace(b"\xff\xc3", b"\xff\xc0"), b"\xff\xd8\xff\xd9", good[:-30]):
        with pytest.raises(ValueError):
            media.decode_frames([bad])
    for bad in (b"", b"RIFF    WAVE", media.write_avi([good])[:60]):
        with pytest.raises(ValueError):
            media.read_avi(bad)


def plain_shots(frames):
    """Cuts where a histogram difference is over the floor and over the mean and deviations of the ones before it."""
    hist = [Counter(v >> 4 for v in f) for f in frames]
    diff = [sum(abs(a[k] - b[k]) for k in range(16)) / (2 * len(f)) for a, b, f in zip(hist, hist[1:], frames)]
    cuts = []
    for i, d in enumerate(diff):
        last = diff[max(0, i - media.WINDOW) : i]
        mean = sum(last) / max(1, len(last))
        spread = max(0.0, sum(x * x for x in last) / max(1, len(last)) - mean * mean) ** 0.5
        if d > media.FLOOR and d > mean + media.SPREAD * spread:
            cuts.append(i + 1)
    return list(zip([0, *cuts], [*cuts, len(frames)]))


def test_clips(spark, small, odd):
    """Shots and their times against plain Python, one row a shot; structure of the files."""
    import struct

    docs = table(spark, small, "documents").select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("doc_id", -F.col("doc_id")))
    made = media.text_to_avi(docs).withColumn("clips", F.lit("x")).withColumn("note", F.lit("n"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    files = {r["doc_id"]: r["media"] for r in made.collect()}
    want = []
    for i, t in text.items():
        data = media.frames_of(t.encode())
        frames = [data[k : k + 576] for k in range(0, len(data), 576)]
        m = files[i]
        assert m[:4] == b"RIFF" and struct.unpack("<I", m[4:8])[0] == len(m) - 8 and m.count(b"idx1") >= 1 and len(media.read_avi(m)) == len(frames)
        want += [(i, k, a, b, a / 25, b / 25) for k, (a, b) in enumerate(plain_shots(frames))]
    rows = media.clip_rows(made)
    assert sorted(tuple(r[c] for c in ("doc_id", "shot", "first_frame", "end_frame", "start_s", "end_s")) for r in rows.collect()) == sorted(want)
    assert {r["note"] for r in rows.collect()} == {"n"}


def test_null_and_broken_media(spark):
    docs = spark.createDataFrame([(i, "some text " * (30 * i + 1)) for i in range(6)], "doc_id long, text string")
    good = {r["doc_id"]: bytes(r["media"]) for r in media.text_to_avi(docs).collect()}
    whole = good[5]
    bad = [None, b"", b"RIFF", whole[: len(whole) // 2], whole[:-20], b"\x00" * 500, whole.replace(b"\xff\xd8", b"\x00\x00")]
    df = spark.createDataFrame([(i, m) for i, m in good.items()] + [(100 + k, m) for k, m in enumerate(bad)] + [(0, good[0])], "doc_id long, media binary").coalesce(1)
    got = media.avi_clips(df).collect()
    assert len(got) == 14 and {r["state"] for r in got if r["doc_id"] < 100} == {"read"}
    lost = {r["doc_id"]: r for r in got if r["doc_id"] >= 100}
    assert lost[100]["state"] == "none" and lost[100]["media_bytes"] is None and all(r["state"] == "broken" for i, r in lost.items() if i in (101, 102, 103, 105, 106))
    assert all(r["payload_sha256"] is None and r["clips"] == [] for r in lost.values() if r["state"] != "read")
    assert {r["doc_id"] for r in media.clip_rows(df).collect()} <= {*range(6), 104}
    assert media.avi_clips(df.filter("false")).count() == 0


def test_long_pieces():
    """Pieces without spaces: as the tokenizers library does, in time that grows with their length."""
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    rng = random.Random(2)
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "abcdefghijklmnopqrstuvwxyzABCDEFGH", "的一是不了人我在有他") for n in (900, 1001, 5000)] + ["a" * 20_000]
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    began = time.perf_counter()
    ids = v.encode(texts + ["x" + texts[1] * 6])
    assert time.perf_counter() - began < 10
    assert [x.tolist() for x in ids[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts]
