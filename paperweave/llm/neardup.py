"""Near-duplicates by SetSketch registers.

A document is its set of five-word shingles. Its sketch holds, for each
register, the least of exponentially distributed values of the set's elements,
truncated to exponentially spaced steps, so that sketches of unions merge by
minimum. Bands of register values name buckets; similarity of a bucket's members
is first estimated from both sketches by maximum likelihood, and what may reach
the threshold is verified on the full sets.

Documents with equal sets are one class. Within a bucket every member is first
compared to one hub. Only buckets that then still span several components are
compared further, block against block, members of one component never; each
round takes more partners a member, the last all of them. So large groups of
copies cost their size, and no link between different texts is lost to a cap.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, MIX_C, materialize, mix, release_memory, slices, sliced_batches, table, text_bytes, with_broadcast_if_small, word_hashes

WORDS, PERCENT = 5, 75
#: Registers of a sketch; of these, BANDS x ROWS make the bands: at similarity 0.75 all bands miss with probability (1 - 0.75^4)^32 = 5e-6.
REGISTERS, BANDS, ROWS = 512, 32, 4
BAND_BITS = (1 << (BANDS - 1).bit_length()) - 1
#: The step of the truncated values, and an offset that keeps them positive.
STEP, OFFSET = 1.001, 10_000
#: Pairs whose estimate is under this are not verified: four deviations, (0.75 x 0.25 / 512)^0.5 each, below the threshold.
ESTIMATE = 0.673
#: Members of a bucket that meet in one task, and partners a member in each round (0: all).
BLOCK, PARTNERS = 512, (1, 0)
#: Contracted edges up to this number are finished in one task; beyond, labels are passed between all tasks.
EDGES_AT_ONCE = 1_000_000
#: Classes broadcast at most (24 bytes each).
BROADCAST_IDS = 500_000
SLICE, PAIRS_AT_ONCE = 1_000_000, 16_000


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; fewer words than a shingle's count as one, none as no shingle."""
    h, offsets = word_hashes(texts)
    s = h.copy()
    for k in range(1, WORDS):
        s = mix(s[: len(h) - k] * MIX_A + h[k:]) if len(h) > k else s[:0]
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= WORDS:
            out.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = mix(x * MIX_C + h[k : k + 1])
            out.append(x)
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of the sets, one row each.

    An element is a Poisson process over the registers: ascending times, each at
    a random register. A register's least time over the set is then exponential
    with the set's size as its rate, independent of the others, and elements
    whose next time is past the sketch's largest register are done.
    """
    n = len(sets)
    least = np.full(n * REGISTERS, np.inf)
    e = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    time, drawn = np.zeros(len(e)), np.uint64(0)
    while len(e):
        k = int(max(1, min(256, 300_000 // len(e))))
        r = mix(e[:, None] + (np.arange(1, k + 1, dtype=np.uint64) + drawn) * MIX_A)
        drawn += np.uint64(k)
        steps = -np.log1p(-((r >> np.uint64(11)).astype(float) * 2.0**-53))
        steps[:, 0] += time
        times = np.cumsum(steps, axis=1)
        np.minimum.at(least, (owner[:, None] * REGISTERS + (r & np.uint64(REGISTERS - 1)).astype(np.int64)).ravel(), times.ravel())
        time = times[:, -1]
        live = time < least.reshape(n, REGISTERS).max(axis=1)[owner]
        e, owner, time = e[live], owner[live], time[live]
    with np.errstate(divide="ignore"):
        value = np.floor(-np.log(least) / np.log(STEP)) + OFFSET
    return np.clip(value, 0, 65535).astype("<u2").reshape(n, REGISTERS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets (values grow as times shrink)."""
    return np.maximum(a, b)


def jaccard_estimate(above, below, equal, size_a, size_b) -> np.ndarray:
    """The similarity of greatest likelihood, given counts of registers where a is above, below or equal to b, and both sizes."""
    u = size_a / (size_a + size_b)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (STEP - 1) / STEP) / np.log(STEP)

    def likelihood(j):
        hi, lo = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return above * np.log(hi + tiny) + below * np.log(lo + tiny) + equal * np.log(np.maximum(1 - hi - lo, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) > likelihood(b)
        high, low = np.where(left, b, high), np.where(left, low, a)
    return (low + high) / 2


def _estimates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return jaccard_estimate((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), nx.astype(float), ny.astype(float))


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def sketches(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, t, n_shingles, digest, signature) of every document, and its binary column `key` if given.

    The digest names the set, equal sets equally; t is a hash of the text.
    """
    import pyarrow as pa

    extra = [key] if key else []

    def run(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            sets = shingle_sets(text_bytes(batch.column("text")))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            signature = [row.tobytes() for row in registers(sets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("t"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(signature, pa.binary()), *[batch.column(k) for k in extra]], ["doc_id", "t", "n_shingles", "digest", "signature", *extra]
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"), *extra).mapInArrow(run, "doc_id long, t long, n_shingles long, digest binary, signature binary" + "".join(f", {k} binary" for k in extra))


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id): the buckets of each class, one a band; the lowest bits of a key are its band."""
    keys = [F.expr(f"(xxhash64({b}, substring(signature, {2 * ROWS * b + 1}, {2 * ROWS})) & ~{BAND_BITS}L) | {b}L") for b in range(BANDS)]
    return classes.select("id", F.explode(F.array(*keys)).alias("key"))


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sizes allow the threshold and whose estimate is near or over it."""
    import pyarrow as pa

    x = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    y = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    sized = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    joined = pairs.join(x, "a").join(y, "b").filter(sized)

    def run(batches):
        for batch in batches:
            est = _estimates(_signatures(batch.column("sa")), _signatures(batch.column("sb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            keep = pa.array(est >= ESTIMATE)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with `linked`, from the full shingle sets of texts (id, text)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ta, tb = text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))
            for a, b in slices([len(x) + len(y) for x, y in zip(ta, tb, strict=True)], SLICE):
                known: dict[bytes, int] = {}
                for t in ta[a:b] + tb[a:b]:
                    known.setdefault(t, len(known))
                sets = shingle_sets(list(known))
                linked = []
                for x, y in zip(ta[a:b], tb[a:b], strict=True):
                    x, y = sets[known[x]], sets[known[y]]
                    both = np.concatenate((x, y))
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    linked.append(100 * common >= PERCENT * (len(both) - common))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked)], ["a", "b", "linked"])
        release_memory()

    x, y = (texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids in edges (a, b): the least id that each reaches.

    Edges are first contracted within partitions. If few remain, one task
    finishes; else labels pass along the rest and jump to their labels' labels
    until they rest. Ids without edges are not in the result.
    """
    import pyarrow as pa

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ids = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], ["a", "b"])

    near = materialize(edges.select("a", "b").mapInArrow(contract, "a long, b long"))
    if near.count() <= EDGES_AT_ONCE:
        return materialize(near.coalesce(1).mapInArrow(contract, "a long, b long").toDF("id", "component"))
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    total = None
    while True:
        at = labels.select(F.col("id").alias("b"), F.col("component").alias("c"))
        least = both.join(at, "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("to"))
        labels = materialize(least.join(jump, "component").select("id", F.least("component", "to").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def further_pairs(members: DataFrame, partners: int) -> DataFrame:
    """Likely pairs between different components within blocks.

    members (key, p, q, part, id, component, n, signature) are grouped by (key,
    p, q). A pair is looked at in the first band that its members share, and
    there where their two parts meet, so it is found once. With `partners` each
    member of a group names at most so many, the likeliest first.
    """
    import pyarrow as pa

    columns = ["key", "p", "q", "part", "id", "component", "n", "signature"]

    def found(rows):
        ids, comp, n, part = (rows.column(c).to_numpy() for c in ("id", "component", "n", "part"))
        split = rows.column("p").to_numpy() != rows.column("q").to_numpy()
        band = rows.column("key").to_numpy() & BAND_BITS
        sig = _signatures(rows.column("signature"))
        # the registers of a band as one number: what pairs share is found on these, and only pairs that first meet here are compared whole
        bands = np.ascontiguousarray(sig[:, : BANDS * ROWS]).view(np.uint64)
        group = np.unique(np.column_stack([rows.column(c).to_numpy() for c in ("key", "p", "q")]), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(group, kind="stable")
        ids, comp, n, sig, bands, group, part, split, band = (x[order] for x in (ids, comp, n, sig, bands, group, part, split, band))
        left, right, est = [], [], []
        for d in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero((group[d:] == group[:-d]) & (comp[d:] != comp[:-d]) & ~(split[d:] & (part[d:] == part[:-d])))
            j = i + d
            fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            for k in range(0, len(i), PAIRS_AT_ONCE):
                x, y = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                first = (bands[x] == bands[y]).argmax(1) == band[x]
                x, y = x[first], y[first]
                good = (sig[x] == sig[y]).sum(1) >= 0.6 * REGISTERS  # below what the estimate needs
                x, y = x[good], y[good]
                s = _estimates(sig[x], sig[y], n[x], n[y])
                left.append(x[s >= ESTIMATE]), right.append(y[s >= ESTIMATE]), est.append(s[s >= ESTIMATE])
        if not left:
            return None
        a, b, s = np.concatenate(left), np.concatenate(right), np.concatenate(est)
        if partners and len(a):
            own, other, s2 = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
            order = np.lexsort((ids[other], -s2, own))
            own, other = own[order], other[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            a, b = own[rank < partners], other[rank < partners]
        a, b = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        if len(a):
            a, b = np.unique(np.column_stack((a, b)), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            keys = [rows.column(c).to_numpy() for c in ("key", "p", "q")]
            last = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut and (out := found(rows.slice(0, cut))) is not None:
                yield out
            held = rows.slice(cut)
        if held is not None and len(held) and (out := found(held)) is not None:
            yield out
        release_memory()

    dealt = members.select(*columns).repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents, and its binary column `key` if given.

    Null and empty texts have no shingles and are linked with nothing. Rows
    without doc_id are linked with nothing either; their component_id is null,
    and they are kept. Of rows that repeat a doc_id with different texts, each is
    a member of its own text's class, whose links are those of that text; the
    least doc_id among a component's rows names it. An empty table gives an
    empty result.
    """
    extra = [key] if key else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)
    all_ = materialize(sketches(docs, key))
    with_set = all_.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class is named by a number of its own, as an id may have several texts; `least` tells the text that stands for it
    grouped = with_set.groupBy("digest").agg(F.min(F.struct("doc_id", "t")).alias("least"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(grouped.withColumn("id", F.monotonically_increasing_id()))
    bands = band_rows(classes)
    # written first: so the join shares no shuffle with the counting, and Spark may split a hot key's members over tasks
    buckets = materialize(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).filter("size > 1"))
    members = materialize(bands.join(buckets, "key"))
    named = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", F.col("least.doc_id").alias("doc_id"), F.col("least.t").alias("t"))
    told = docs.withColumn("t", F.xxhash64("text")).join(with_broadcast_if_small(materialize(named), BROADCAST_IDS), ["doc_id", "t"])
    texts = materialize(told.groupBy("id").agg(F.max("text").alias("text")))
    hubs = members.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    tested = materialize(verified(likely(hubs, classes), texts))
    edges = tested.filter("linked")
    for partners in PARTNERS:
        found = components(edges)
        own = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
        parts = F.ceil(F.col("size") / BLOCK).cast("int")
        open_ = own.join(mixed, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        spread = open_.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "id", "component")
        pairs = further_pairs(spread.join(classes.select("id", "n", "signature"), "id"), partners)
        more = materialize(verified(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), texts))
        tested = tested.unionByName(more)
        edges = tested.filter("linked")
    found = components(edges)
    owned = classes.select("digest", "id", F.col("least.doc_id").alias("doc_id")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = owned.groupBy("component").agg(F.min("doc_id").alias("least"))
    reps = owned.join(least, "component").select("digest", "least")
    with_own = all_.join(reps, "digest", "left").withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("least")).otherwise(F.col("doc_id")))
    return with_own.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *extra)


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
