"""Statistics and verdicts that take every row of the corpus."""

from __future__ import annotations

import numpy as np
from paperweave.llm import quality_model as q


def test_word_vectors_of_all_documents(spark):
    """Words of documents without labels have their neighbours too."""
    texts = [f"plain words of document {i} are here" for i in range(12)] + ["unheard zebra quagga okapi", None, "", "zebra quagga"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = q.fit_quality_model(docs, labels)
    for k, (slots, offsets) in enumerate(q._slots([(t or "").encode() for t in texts])):
        r = q.index_vectors(5 + k)
        total = 1e-3 * r
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for i in range(a, b):
                for j in range(max(a, i - q.REACH), min(b, i + q.REACH + 1)):
                    if j != i:
                        total[slots[i]] += r[slots[j]]
        assert np.allclose(model.vectors[k], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9), atol=1e-4)
    assert q.FIT_ROWS == 12_000


def test_repeated_rows_become_one(spark, small):
    """Verdicts are of id and text: copies of a row go, and a row of a kept id whose own text belongs to a smaller id."""
    import corpus_pipeline as p

    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "y"), (1, a, "x"), (1, a, "x"), (2, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (None, b, "x"), (None, b, "x"), (6, None, "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = p.drop_near_duplicates(spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "x"), (5, b, "x"), (None, b, "x"), (None, b, "x"), (6, None, "x")], key=str)
