"""License scans: sparse tf-idf cosine to templates, and inheritance along directories.

Templates are passages of licences: short statements, notices and the texts of
the shorter licences. Wherever a text has a template's cue word, the window of
the template's length that puts the two words on each other is compared, by the
cosine of tf-idf vectors over the templates' words, with all templates, among
them statements that name no licence; where one of those is the best, the window
says nothing. Document counts are taken over the headers (what lies around cue
words) of all files. A file without a licence of its own inherits from the
licence file of the nearest directory above it, found by joining directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release_memory, salted_left_join, sliced_batches, table, with_broadcast_if_small

#: Names of licences as statements give them (fixed values).
NAMES = (
    ("MIT", "the MIT License"),
    ("ISC", "the ISC License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "the Eclipse Public License, version 2.0"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("Zlib", "the zlib License"),
    ("Unlicense", "the Unlicense"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
#: What statements speak of without naming a licence.
UNNAMED = ("the license", "a license", "this license", "the general public license", "the public license", "the software license", "a Creative Commons license", "a proprietary license", "version 2.0", "CC 4.0")
#: Forms of statements.
FORMS = ("released under {}", "licensed under {}", "this work is licensed under {}", "distributed under the terms of {}", "under the terms of {}")
#: Notices and texts (fixed values, from the licences' public texts).
PASSAGES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (None, "all rights reserved copyright"),
    (None, "copyright notice and license information"),
)
#: Words that start a comparison contain one of these.
CUES = ("licen", "lizenz", "copyright", "redistribut", "permission", "cc0", "unencumbered")
TOKEN = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE_NAMES = r"(?i)^(?:licen[sc]e|copying|notice|unlicense)(?:[.-].*)?$"
#: A licence is recognised from this cosine on; a file is a licence file by its name, or if so much of its words lie in the recognised window.
LEAST, MOSTLY = 0.8, 0.5
#: Rows of directories broadcast at most, and the copies of larger sides for salted joins.
BROADCAST_FOLDERS, SALTS = 100_000, 16
SLICE = 1_000_000


def default_templates() -> tuple[tuple[str | None, str], ...]:
    """(licence, passage); a licence of None marks passages that name none."""
    made = [(k, form.format(name)) for k, name in NAMES for form in FORMS]
    made += [(k, f"SPDX-License-Identifier: {k}") for k in dict.fromkeys(k for k, _ in NAMES)]
    made += [(k, f"SPDX-License-Identifier: {k}{more}") for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for more in ("-only", "-or-later")]
    made += [(None, form.format(name)) for name in UNNAMED for form in FORMS] + [(None, "SPDX-License-Identifier:")]
    return (*made, *PASSAGES)


def _is_cue(word: str) -> bool:
    return any(c in word for c in CUES)


class Templates:
    """The words of the templates, and for each cue word the templates' places that hold it."""

    def __init__(self, templates=None):
        pairs = [(k, TOKEN.findall(t.lower())) for k, t in (templates or default_templates())]
        self.names = [k for k, _ in pairs]
        self.tokens = [t for _, t in pairs]
        self.words = sorted({w for t in self.tokens for w in t})
        self.of = {w: i for i, w in enumerate(self.words)}
        self.longest = max(map(len, self.tokens))
        places = {(self.of[w], o, len(t)) for t in self.tokens for o, w in enumerate(t) if _is_cue(w)}
        self.places: dict[int, list[tuple[int, int]]] = {}
        for word, o, n in sorted(places):
            self.places.setdefault(word, []).append((o, n))

    def vectors(self, idf: np.ndarray) -> np.ndarray:
        """Unit tf-idf vectors, one column a template."""
        out = np.zeros((len(self.words), len(self.tokens)))
        for k, t in enumerate(self.tokens):
            for w, n in Counter(t).items():
                out[self.of[w], k] = math.log1p(n) * idf[self.of[w]]
        return out / np.linalg.norm(out, axis=0)


def header_words(text: str, templates: Templates, whole: bool) -> np.ndarray | None:
    """Numbers of the words around cue words, as far as a template reaches (-1: in no template, -2: a gap); null without any.

    With `whole` all words of the text are taken.
    """
    low = text.lower()
    if not whole and not any(c in low for c in CUES):
        return None
    words = TOKEN.findall(low)
    ids = np.fromiter((templates.of.get(w, -1) for w in words), np.int16, len(words))
    cues = np.flatnonzero(np.isin(ids, list(templates.places)))
    if whole:
        return ids
    if not len(cues):
        return None
    near = np.zeros(len(ids) + 1, np.int64)
    np.add.at(near, np.maximum(cues - templates.longest, 0), 1)
    np.add.at(near, np.minimum(cues + templates.longest, len(ids)), -1)
    inside = np.cumsum(near[:-1]) > 0
    inside[cues] = True
    edge = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    at = np.flatnonzero(inside)
    return np.insert(ids[at], np.searchsorted(at, edge), -2)


def best_window(ids: np.ndarray, templates: Templates, idf: np.ndarray, vectors: np.ndarray, least: float) -> tuple[str | None, float, int]:
    """The licence of the best window, its cosine, and the window's words; (None, 0, 0) if none reaches `least`.

    A window is cut at gaps and at the ends of the text. Words in no template
    weigh as the rarest ones, each by itself. Of equal cosines the longest
    window counts, then the licence's name.
    """
    found = set()
    for word, places in templates.places.items():
        for at in np.flatnonzero(ids == word).tolist():
            found |= {(at - o, n) for o, n in places}
    gaps = np.flatnonzero(ids == -2)
    other = float(idf.max()) * math.log(2)
    best: tuple = (0.0, 0, "")
    windows = sorted(found)
    for i in range(0, len(windows), 1024):
        tf = np.zeros((len(windows[i : i + 1024]), len(templates.words)))
        rest, sizes = np.zeros(len(tf)), []
        for row, (start, n) in enumerate(windows[i : i + 1024]):
            a, b = max(start, 0), min(start + n, len(ids))
            if len(gaps):
                # the part between two gaps that holds the cue
                k = np.searchsorted(gaps, max(a, 0), "left")
                inner = gaps[k:][gaps[k:] < b]
                if len(inner):
                    parts = np.split(ids[a:b], inner - a)
                    part = max(parts, key=len)
                    part = part[part != -2]
                else:
                    part = ids[a:b]
            else:
                part = ids[a:b]
            known = part[part >= 0]
            tf[row] = np.bincount(known, minlength=tf.shape[1])
            rest[row] = len(part) - len(known)
            sizes.append(len(part))
        tf = np.log1p(tf) * idf
        norm = np.sqrt((tf * tf).sum(1) + rest * other * other)
        cosine = np.round(tf @ vectors / np.maximum(norm, 1e-12)[:, None], 6)
        for row in np.flatnonzero(cosine.max(1) >= least):
            top = cosine[row].max()
            names = {templates.names[k] for k in np.flatnonzero(cosine[row] == top)}
            if None not in names:
                name = min(names)
                rank = (top, sizes[row], name)
                if (rank[0], rank[1]) > (best[0], best[1]) or ((rank[0], rank[1]) == (best[0], best[1]) and name < best[2]):
                    best = rank
    return (best[2], float(best[0]), best[1]) if best[1] else (None, 0.0, 0)


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def license_headers(files: DataFrame, templates: Templates) -> DataFrame:
    """Files (text left out) with named, n_words, header (packed word numbers; null without cue words) and terms (its distinct numbers)."""
    import pyarrow as pa

    base = files.withColumn("named", _file_name(F.col("path")).rlike(FILE_NAMES))
    keep = [c for c in base.columns if c != "text"]
    schema = T.StructType([base.schema[c] for c in keep]).add("n_words", "long").add("header", "binary").add("terms", T.ArrayType(T.IntegerType()))

    def run(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            n, header, terms = [], [], []
            for text, whole in zip(batch.column("text").to_pylist(), batch.column("named").to_pylist(), strict=True):
                ids = header_words(text or "", templates, bool(whole))
                n.append(0 if ids is None else len(TOKEN.findall(text.lower())) if text else 0)
                header.append(None if ids is None else ids.astype("<i2").tobytes())
                terms.append(None if ids is None else np.unique(ids[ids >= 0]).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(header, pa.binary()), pa.array(terms, pa.list_(pa.int32()))], schema.names)
        release_memory()

    return base.mapInArrow(run, schema)


def inverse_frequencies(headers: DataFrame, templates: Templates) -> np.ndarray:
    """ln((N+1)/(df+1))+1 of each template word over all headers; as many numbers as the templates have words."""
    held = headers.filter("header IS NOT NULL")
    n = held.count()
    out = np.full(len(templates.words), math.log(n + 1) + 1)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        out[r["term"]] = math.log((n + 1) / (r["count"] + 1)) + 1
    return out


def own_licenses(files: DataFrame, least: float = LEAST, mostly: float = MOSTLY, templates=None) -> DataFrame:
    """Files (text left out) with license, license_score, license_share and is_license_file.

    The licence is that of the best window of the whole text, from `least` on;
    license_share is the share of the text's words in that window. Null and
    empty texts, and texts without cue words, have none. Repeated rows stay
    repeated and are judged alike; a long text costs its number of words. An
    empty table gives an empty table.
    """
    import pyarrow as pa

    known = Templates(templates)
    headers = materialize(license_headers(files.select(*[c for c in files.columns if c not in ("license", "license_score", "license_share", "is_license_file", "named", "n_words", "header", "terms")]), known))
    idf = inverse_frequencies(headers, known)
    vectors = known.vectors(idf)
    keep = [c for c in headers.columns if c not in ("n_words", "header", "terms")]
    schema = T.StructType([headers.schema[c] for c in keep]).add("license", "string").add("license_score", "double").add("license_share", "double")

    def run(batches):
        for batch in batches:
            rows = []
            for packed, n in zip(batch.column("header").to_pylist(), batch.column("n_words").to_pylist(), strict=True):
                if packed is None:
                    rows.append((None, 0.0, 0.0))
                    continue
                name, score, size = best_window(np.frombuffer(packed, "<i2"), known, idf, vectors, least)
                rows.append((name, score, size / n if n else 0.0))
            name, score, share = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], schema.names)

    found = headers.select(*keep, "header", "n_words").mapInArrow(run, schema)
    return found.withColumn("is_license_file", F.col("named") | (F.col("license_share") >= mostly)).drop("named")


def directories(folder: Column) -> Column:
    """A directory and all above it, the nearest first; the root is the empty text."""
    parts = F.split(folder, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))


def inherit(own: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Rows of own_licenses to (id, path, license, license_score, inherited_from, effective_license).

    Directories are joined, not files: the distinct ones that need a licence with
    those that have one. The result goes to the files by broadcast if it is
    small, else by a join in which each directory is spread over SALTS keys, so
    one that holds a third of all files is no task of its own. Files without a
    path take no part in the joins.
    """
    own = materialize(own.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")))
    given = own.filter("is_license_file AND license IS NOT NULL AND path IS NOT NULL").groupBy("folder").agg(F.max_by("license", F.struct("license_score", F.col("license"))).alias("given"))
    given = with_broadcast_if_small(materialize(given), BROADCAST_FOLDERS)
    missing = own.filter("license IS NULL AND path IS NOT NULL").select("folder").distinct()
    above = missing.select(F.col("folder").alias("below"), F.posexplode(directories(F.col("folder"))).alias("up", "folder")).join(given, "folder")
    near = materialize(above.groupBy(F.col("below").alias("folder")).agg(F.min_by(F.struct("folder", "given"), "up").alias("near")))
    placed = salted_left_join(own.filter("path IS NOT NULL"), near, "folder", BROADCAST_FOLDERS, SALTS)
    out = placed.unionByName(own.filter("path IS NULL").withColumn("near", F.lit(None).cast(near.schema["near"].dataType)))
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(
        id_,
        "path",
        "license",
        "license_score",
        F.when(inherited, F.col("near.folder")).alias("inherited_from"),
        F.coalesce("license", "near.given").alias("effective_license"),
    )


def license_scan(files: DataFrame, id_: str = "doc_id", least: float = LEAST, templates=None) -> DataFrame:
    """(id, path, license, license_score, inherited_from, effective_license) of every row of files (id, path, text).

    A file without a licence of its own takes that of the nearest directory, its
    own or one above it, with a recognised licence file; of several in one
    directory the best scored, then the greatest name. A null path has no
    directories. Null and empty texts have no licence of their own. Repeated
    rows stay repeated; other columns of the input are left out. An empty table
    gives an empty table.
    """
    return inherit(own_licenses(files.select(id_, "path", "text"), least, templates=templates), id_)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files of the directories source/lang/thousands of ids; a document that is mostly a licence statement is its directory's licence file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    none = F.lit("none")
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), none), F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit(".txt")))
    return license_scan(docs.select("doc_id", path.alias("path"), "text"))
