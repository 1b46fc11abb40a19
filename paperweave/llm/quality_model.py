"""A quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every hashed word, and every hashed word shape, has a sparse random index
vector; its word vector sums the index vectors of its neighbours over all
documents. A document is the mean and the deviation of its
words' vectors and of its shapes' vectors, with the likeness of neighbouring
words. A two-layer network scores it, and
its logits are divided by a temperature fitted on rows kept from the training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, release_memory, sliced_batches, table, text_bytes, word_hashes

#: The model is fitted on at most so many labelled rows, those with the least hashed ids.
FIT_ROWS = 12_000
#: Hashed words and shapes, the vectors' length, entries other than 0 in an index vector, and neighbours on each side.
SLOTS, DIM, ENTRIES, REACH = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 3e-3, 1e-4
#: Documents are predicted to be good from this score on.
GOOD = 0.7
SLICE = 1_000_000
#: Features of a document.
WIDTH = 4 * DIM + 5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def _shapes(texts: list[bytes]) -> list[bytes]:
    """Texts with letters and digits made alike and runs of a character, but not of spaces, cut to one."""
    out = []
    for t in texts:
        x = _SHAPE[np.frombuffer(t, np.uint8)]
        if len(x):
            space = (x == 32) | ((x >= 9) & (x <= 13))
            x = x[np.append(True, (x[1:] != x[:-1]) | space[1:])]
        out.append(x.tobytes())
    return out


def _slots(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots of the words and of the word shapes, each with the texts' offsets."""
    both = []
    for t in (texts, _shapes(texts)):
        h, offsets = word_hashes(t, lower=False)
        both.append(((h % np.uint64(SLOTS)).astype(np.int32), offsets))
    return both


def index_entries(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ENTRIES numbers of each slot's index vector."""
    rows = np.arange(SLOTS, dtype=np.uint64)
    h = [mix(rows * np.uint64(2 * seed + 1) + np.uint64(k + 1)) for k in range(ENTRIES)]
    return np.stack([(x % np.uint64(DIM)).astype(np.int64) for x in h], 1), np.stack([np.where(x >> np.uint64(40) & np.uint64(1), 1.0, -1.0) for x in h], 1)


def index_vectors(seed: int) -> np.ndarray:
    """A sparse vector of a few plus and minus ones for each slot."""
    r = np.zeros((SLOTS, DIM), np.float32)
    for place, sign in zip(*(x.T for x in index_entries(seed)), strict=True):
        r[np.arange(SLOTS), place] += sign
    return r


def context_sums(slots: np.ndarray, offsets: np.ndarray, entries: tuple[np.ndarray, np.ndarray], total: np.ndarray) -> None:
    """Adds to each slot's row of total the index vectors of its neighbours within each text; whole numbers, so order does not matter.

    Only the few numbers of an index vector are added, all of a slice in one count.
    """
    places, signs = entries
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for d in range(1, REACH + 1):
        near = text[d:] == text[:-d]
        left, right = slots[:-d][near].astype(np.int64), slots[d:][near].astype(np.int64)
        for a, b in ((left, right), (right, left)):
            if len(a):
                at = (a * DIM)[:, None] + places[b]
                total += np.bincount(at.ravel(), signs[b].ravel(), SLOTS * DIM).reshape(SLOTS, DIM)


def unit_vectors(total: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors of the slots from their sums; a slot that was never seen keeps its index vector's direction."""
    v = (total + index_vectors(seed) * 1e-3).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def word_vectors(docs: DataFrame, seed: int) -> list[np.ndarray]:
    """Vectors of the words' and of the shapes' slots, from the neighbours in all documents.

    Each task adds up its own documents, Spark the tasks' sums; the driver holds
    SLOTS x DIM numbers of each kind, however many documents there are.
    """
    import pyarrow as pa

    names = ["kind", "slot", *[f"v{k}" for k in range(DIM)]]

    def run(batches):
        entries = [index_entries(seed + k) for k in range(2)]
        total = [np.zeros((SLOTS, DIM)) for _ in range(2)]
        for batch in sliced_batches(batches, "text", SLICE):
            for k, (s, o) in enumerate(_slots(text_bytes(batch.column("text")))):
                context_sums(s, o, entries[k], total[k])
        for k in range(2):
            seen = np.flatnonzero(total[k].any(1))
            for i in range(0, len(seen), 4096):
                at = seen[i : i + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), *[pa.array(np.ascontiguousarray(c, np.int64)) for c in total[k][at].T.astype(np.int64)]], names)

    parts = docs.select("text").mapInArrow(run, "kind int, slot int, " + ", ".join(f"{c} long" for c in names[2:]))
    sums = parts.groupBy("kind", "slot").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()
    total = np.zeros((2, SLOTS, DIM), np.int64)
    kind, slot = sums.column("kind").to_numpy(), sums.column("slot").to_numpy()
    for k, c in enumerate(names[2:]):
        total[kind, slot, k] = sums.column(c).to_numpy()
    return [unit_vectors(t, seed + k) for k, t in enumerate(total)]


def pooled(texts: list[bytes], vectors: list[np.ndarray]) -> np.ndarray:
    """A row of features for each text: means and deviations of its vectors, how alike neighbours are, and its length. All 0 without words."""
    parts = []
    for (slots, offsets), v in zip(_slots(texts), vectors, strict=True):
        n = np.diff(offsets)
        has = n > 0
        mean, mean2, alike = np.zeros((len(n), DIM)), np.zeros((len(n), DIM)), np.zeros((len(n), 2))
        if has.any():
            x = v[slots]
            first = offsets[:-1][has]
            mean[has] = np.add.reduceat(x, first, axis=0) / n[has, None]
            mean2[has] = np.add.reduceat(x * x, first, axis=0) / n[has, None]
            dot = np.append(np.einsum("ij,ij->i", x[1:], x[:-1]), 0)
            dot[offsets[1:][has] - 1] = 0  # a text's last word has no next one
            alike[has, 0] = np.add.reduceat(dot, first) / n[has]
            alike[has, 1] = np.add.reduceat((dot > 0.999).astype(float), first) / n[has]
        parts += [mean, np.sqrt(np.maximum(mean2 - mean * mean, 0)), alike]
    return np.hstack([*parts, np.log1p(n)[:, None] / 10])


@dataclass
class Model:
    vectors: list[np.ndarray]
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((x - self.center) / self.scale @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of label 1; a text without words has the score of the fitted net at zero features."""
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)) / self.temperature, -30, 30)))


def train(x: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], seed: int = 5) -> Model:
    """A model of labels 0 and 1 over rows of features. Without rows of both, its score is the mean label (0.5 without any)."""
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    width = WIDTH
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    model = Model(vectors, x.mean(0) if len(x) else np.zeros(width), x.std(0) + 1e-3 if len(x) else np.ones(width), layers, 1.0)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        model.layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.array([30.0 if share == 1 else -30.0 if len(y) else 0.0])]
        return model
    order = rng.permutation(len(x))
    tune, fit = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - model.center) / model.scale
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    step = 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), 64):
            b = fit[i : i + 64]
            w1, b1, w2, b2 = layers
            h = np.tanh(z[b] @ w1 + b1)
            p = 1 / (1 + np.exp(-np.clip((h @ w2 + b2)[:, 0], -30, 30)))
            g = ((p - y[b]) / len(b))[:, None]
            back = g @ w2.T * (1 - h * h)
            grads = [z[b].T @ back + DECAY * w1, back.sum(0), h.T @ g + DECAY * w2, g.sum(0)]
            step += 1
            for k, (param, grad) in enumerate(zip(layers, grads, strict=True)):
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                param -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(tune):
        logit = model.logits(x[tune])

        def loss(t: float) -> float:
            s = np.clip(logit / t, -30, 30)
            return float(np.mean(np.logaddexp(0, s) - y[tune] * s))

        model.temperature = min(np.geomspace(0.5, 10, 60).tolist(), key=loss)
    return model


def remainder():
    """crc32 of the id as text, mod 4: rows of remainder 2 are held out. A null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def labelled_features(texts: DataFrame, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled texts (doc_id, text, _label), pooled in tasks: WIDTH numbers a row come to the driver, no texts."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            x = pooled(text_bytes(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "_label", "x"])
        release_memory()

    rows = texts.mapInArrow(run, "doc_id long, _label double, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), float).reshape(-1, WIDTH)
    return x, rows.column("_label").to_numpy()


def fit_quality_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """A model of labels.quality from at most `fit_rows` labelled rows that are not held out, over word vectors from all documents.

    Rows with a null id or label take no part. Of repeated labels of an id the
    greatest counts, and of documents with equal ids the greatest text; null and
    empty texts are texts without words. Long texts are pooled whole. Without
    labelled rows every score is one half.
    """
    vectors = word_vectors(docs, seed)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(remainder() != 2)
    sample = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    once = texts.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "_label")).alias("r")).select("doc_id", "r.*")
    return train(*labelled_features(once, vectors), vectors, seed)


def score_quality(docs: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """Documents with score and predicted added (replaced if present). Equal texts have equal scores, repeated rows among them.

    Null and empty texts have the score of a text without words; long texts are
    scored whole; other columns pass through. An empty table gives an empty table.
    """
    import pyarrow as pa

    base = docs.drop("score", "predicted")
    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in sliced_batches(batches, "text", SLICE):
            s = np.round(m.scores(text_bytes(batch.column("text"))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= good).astype(np.int32), pa.int32())], schema.names)
        release_memory()

    return base.mapInArrow(run, schema)


def op7_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (remainder() == 2).alias("held_out"), "score", "predicted")
