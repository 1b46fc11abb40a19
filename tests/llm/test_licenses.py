"""Licence scans against plain Python: cosine of windows, and the nearest directory."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from paperweave.llm import licenses
from paperweave.llm.common import table

TEMPLATES = licenses.default_templates()


def plain_words(text):
    return re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", (text or "").lower())


def plain_headers(texts, named):
    """Words within the longest template's reach of a cue word, in runs; all of a licence file."""
    vocabulary = {w for _, t in TEMPLATES for w in plain_words(t)}
    cue = {w for w in vocabulary if any(c in w for c in licenses.CUES)}
    reach = max(len(plain_words(t)) for _, t in TEMPLATES)
    out = []
    for text, whole in zip(texts, named, strict=True):
        w = plain_words(text)
        near = [whole or any(x in cue for x in w[max(0, i - reach + 1) : i + reach + 1]) for i in range(len(w))]
        out.append([x if n else None for x, n in zip(w, near, strict=True)])
    return out, vocabulary, cue


def plain_scan(files):
    texts, paths = [f[2] for f in files], [f[1] for f in files]
    named = [bool(re.match(r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[.-].*)?$", (p or "").split("/")[-1])) for p in paths]
    headers, vocabulary, cue = plain_headers(texts, named)
    held = [h for h, n in zip(headers, named, strict=True) if n or any(x in cue for x in h if x)]
    n = len(held)
    df = Counter(x for h in held for x in {y for y in h if y in vocabulary})
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    other = max(idf.values()) * math.log(2)

    def vector(words):
        return {w: math.log1p(k) * idf[w] for w, k in Counter(words).items()}

    sides = [(k, plain_words(t), vector(plain_words(t))) for k, t in TEMPLATES]
    length = [math.sqrt(sum(v * v for v in vec.values())) for _, _, vec in sides]
    own = []
    for h, text in zip(headers, texts, strict=True):
        windows = {(i - o, len(t)) for _, t, _ in sides for o, w in enumerate(t) if w in cue for i, x in enumerate(h) if x == w}
        best = (0.0, 0, "")
        for start, size in windows:
            part = [x for x in h[max(0, start) : start + size] if x is not None]
            known = vector([x for x in part if x in vocabulary])
            rest = sum(x not in vocabulary for x in part)
            norm = math.sqrt(sum(v * v for v in known.values()) + rest * other * other)
            dots = [sum(v * vec[w] for w, v in known.items() if w in vec) for _, _, vec in sides]
            cos = [round(d / length[k] / norm, 6) if norm else 0.0 for k, d in enumerate(dots)]
            top = max(cos)
            names = {sides[k][0] for k, c in enumerate(cos) if c == top}
            if top >= licenses.LEAST and None not in names:
                best = min(best, (top, len(part), min(names)), key=lambda x: (-x[0], -x[1], x[2]))
        words = len(plain_words(text))
        own.append((best[2] or None, best[0], best[1] / words if words else 0.0))
    given = {}
    for (name, score, share), p, is_file in zip(own, paths, named, strict=True):
        if name and p is not None and (is_file or share >= 0.5):
            folder = p.rpartition("/")[0]
            given[folder] = max(given.get(folder, (0.0, "")), (score, name))
    out = []
    for (name, score, _), (i, p, _) in zip(own, files, strict=True):
        above = None
        if name is None and p is not None:
            folder = p.rpartition("/")[0]
            while folder not in given and folder:
                folder = folder.rpartition("/")[0]
            above = folder if folder in given else None
        out.append((i, p, name, round(score, 5), above, name or (given[above][1] if above is not None else None)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:3], round(r[3], 5), *r[4:]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def files():
    rng = random.Random(2)
    passages = [t for _, t in TEMPLATES]
    word = lambda: rng.choice(["alpha", "beta", "the", "license", "copyright", "version", "software", "gamma", "2.0", "under", "é"])
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.choice([0, 3, 40, 130])))]
        if rng.random() < 0.7:
            t = rng.choice(passages).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = word()
            parts.append(rng.choice([" ", "\n# "]).join(t))
            parts.append(" ".join(word() for _ in range(rng.choice([0, 5, 130]))))
        folder = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4)))
        name = rng.choice(["LICENSE", "COPYING.txt", f"f{i}.py", f"g{i}.c", f"h{i}.md"])
        rows.append((i, f"{folder}/{name}" if folder else name, rng.choice(["\n", " "]).join(parts)))
    return rows


@pytest.fixture(scope="module")
def wanted(files):
    return plain_scan(files)


def test_scan_is_plain(spark, files, wanted):
    assert got(licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"))) == wanted


def test_without_broadcast(spark, files, wanted, monkeypatch):
    """The way of many directories: salted keys instead of a broadcast."""
    monkeypatch.setattr(licenses, "BROADCAST_FOLDERS", -1)
    assert got(licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"))) == wanted


def test_variants_and_unnamed(spark):
    """Versions and variants are told apart; words about licences that name none are no licence; long lines and texts count whole."""
    filler = " ".join(f"w{i}" for i in range(30_000))
    cases = [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        (filler + " Released under the MIT License. " + filler, "MIT"),
        ("a driver needs a license and a license plate", None),
        ("licensed under the Foo License", None),
        ("Released under the license.", None),
        ("SPDX-License-Identifier: Foo-1.0", None),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("Copyright 2020 Someone. All rights reserved.", None),
        ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + dict(licenses.PASSAGES)["MIT"], "MIT"),
        (next(t for k, t in licenses.PASSAGES if k == "MIT"), "MIT"),
        (next(t for k, t in licenses.PASSAGES if k == "BSD-2-Clause"), "BSD-2-Clause"),
        (next(t for k, t in licenses.PASSAGES if k == "BSD-3-Clause"), "BSD-3-Clause"),
    ]
    df = spark.createDataFrame([(i, None, t) for i, (t, _) in enumerate(cases)], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.license_scan(df).collect()} == {i: k for i, (_, k) in enumerate(cases)}


def test_odd_rows(spark, odd, none):
    """Null texts and paths, repeated rows, clashing names and empty tables."""
    from pyspark.sql import functions as F

    rows = odd.withColumn("path", F.when(F.col("doc_id") != 3, F.concat(F.lit("a/"), F.col("doc_id").cast("string")))).withColumn("license", F.lit(5)).withColumn("near", F.lit("x"))
    found = licenses.license_scan(rows)
    assert found.columns == ["doc_id", "path", "license", "license_score", "inherited_from", "effective_license"]
    assert got(found) == plain_scan([(r["doc_id"], r["path"], r["text"]) for r in rows.collect()])
    own = licenses.own_licenses(rows)
    assert [r["near"] for r in own.collect()] == ["x"] * odd.count() and set(own.columns) >= set(rows.columns) - {"text"}
    assert licenses.license_scan(rows.filter("false")).count() == 0


def test_query_is_plain(spark, small):
    docs = table(spark, small, "documents").collect()
    paths = {r["doc_id"]: f"{r['source'] or 'none'}/{r['lang'] or 'none'}/{r['doc_id'] // 1000}/{r['doc_id']}.txt" for r in docs}
    assert got(licenses.op8_license_scan(spark, small)) == plain_scan([(r["doc_id"], paths[r["doc_id"]], r["text"]) for r in docs])
