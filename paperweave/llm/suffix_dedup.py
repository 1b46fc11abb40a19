"""Removal of long byte strings that an earlier document holds, by suffix arrays.

A string of LENGTH bytes is looked for without shuffling every position. Winnowing
picks anchors, short grams of least hash, such that equal strings of LENGTH bytes
hold equal anchors at equal places. Anchors meet by hash in small packed rows;
those of two documents or more send the bytes around them, as far as a string of
LENGTH bytes with that anchor reaches. Equal contexts are decided by their
earliest document; the remaining ones of a task are laid end to end, their suffix
array is built by linear grouping, and suffixes that are neighbours with LENGTH
equal bytes share one string, whose earliest document keeps it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_A, _powers_upto, discard, materialize, mix, sliced_batches, table
from .suffix_array import suffix_array

#: Bytes of a string that is removed, of an anchor, and windows that share one.
LENGTH, GRAM = 50, 16
WINDOWS = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
WIDTH = GRAM + 2 * SIDE
#: Bytes of a block of a context, and whole blocks that any string of LENGTH bytes has.
BLOCK = 12
FULL = (LENGTH - BLOCK + 1) // BLOCK
#: Bytes of text handled at once in a task, and anchors that one bucket is meant to hold.
SLICE, BUCKET_ANCHORS = 4_000_000, 200_000
#: An anchor that more texts hold is hot, and at most so many are (8 bytes each on the driver and in a task): its strings
#: are dealt one by one over all tasks, by a digest of 128 bits, instead of meeting as contexts in one.
HOT_TEXTS, HOT_ANCHORS = 20_000, 1_000_000


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """The least or greatest of each `width` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the text and hash of each anchor.

    Of the grams that start in any WINDOWS neighbouring places, those with the
    least hash are anchors, all of them if several share it.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    up, down = _powers_upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1] * MIX_A)
    del total
    text = np.repeat(np.arange(len(texts)), sizes)
    # windows that cross from one text to the next name no anchor
    least = _sliding(h, WINDOWS, np.minimum)
    n = len(least)
    inside = text[:n] == text[LENGTH - 1 : LENGTH - 1 + n]
    least[~inside] = 0
    padded = np.concatenate((np.zeros(WINDOWS - 1, np.uint64), least, np.zeros(WINDOWS - 1, np.uint64)))
    at = np.flatnonzero((_sliding(padded, WINDOWS, np.maximum) == h) & (h != 0))
    return text[at], at - first[text[at]], h[at]


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    if not len(keys[0]):
        return []
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    edge = np.flatnonzero(np.concatenate(([True], new, [True]))).tolist()
    return list(zip(edge, edge[1:], strict=False))


def _cut(batches, keys: list[str]):
    """Tables of one or more whole groups from batches that are sorted by the keys."""
    import pyarrow as pa

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = np.logical_and.reduce([(c := rows.column(k).to_numpy()) == c[-1] for k in keys])
        cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut)
    if held is not None and len(held):
        yield held


def _unpack(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def repeated_anchors(docs: DataFrame, buckets: int, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """(doc_id, name, hashes): for each text of a document, by its digest, the packed hashes of its anchors that another text may hold too.

    The upper bits of a hash choose the bucket and the lower 32 are compared
    there. A chance equality only costs a context that the next step refutes.
    Rows without doc_id have the hashes of anchors that more than hot_texts texts
    hold.
    """
    import pyarrow as pa

    def pack(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_numpy().astype("<i8")
            text, _, h = anchors(texts)
            name = int.from_bytes(hashlib.blake2b(ids.tobytes() + bytes(str([len(t) for t in texts]), "ascii"), digest_size=8).digest(), "little", signed=True)
            rows = [(-1, name, ids.tobytes(), b"".join(hashlib.md5(t).digest() for t in texts))]
            bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            low = h.astype(np.uint32)
            order = np.lexsort((text, low, bucket))
            bucket, low, text = bucket[order], low[order], text[order]
            new = np.append(True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (text[1:] != text[:-1])) if len(low) else np.zeros(0, bool)
            bucket, low, text = bucket[new], low[new], text[new]
            for a, b in _runs(bucket):
                rows.append((int(bucket[a]), name, low[a:b].astype("<u4").tobytes(), text[a:b].astype("<u4").tobytes()))
            b, n, low_, own = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(low_, pa.binary()), pa.array(own, pa.binary())], ["bucket", "batch", "low", "own"])

    def meet(batches):
        for rows in _cut(batches, ["bucket"]):
            bucket, batch = rows.column("bucket").to_numpy(), rows.column("batch").to_numpy()
            low, own = _unpack(rows.column("low"), "<u4"), _unpack(rows.column("own"), "<u4")
            row = np.repeat(np.arange(len(low)), [len(x) for x in low])
            low, own = np.concatenate(low), np.concatenate(own)
            key = (bucket[row].astype(np.uint64) << np.uint64(32)) | low
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(key), bool)
            again[order] = np.append(same, False) | np.append(False, same)
            at = np.flatnonzero(np.append(True, ~same))
            many = np.diff(np.append(at, len(key))) > hot_texts
            out = [(-2, -1, key[order][at[many]].astype("<u8").tobytes(), b"")] if many.any() else []
            row, low, own = row[again], low[again], own[again]
            for a, b in _runs(row):
                out.append((int(bucket[row[a]]), int(batch[row[a]]), low[a:b].tobytes(), own[a:b].tobytes()))
            if out:
                b, n, low_, own_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(low_, pa.binary()), pa.array(own_, pa.binary())], ["bucket", "batch", "low", "own"])

    def hand_back(batches):
        ids, names, got = None, b"", None

        def rows_of(batch):
            keys = np.concatenate([np.uint64(b) << np.uint64(32) | x for b, x, _ in got]) if got else np.zeros(0, np.uint64)
            own = np.concatenate([o for _, _, o in got]) if got else np.zeros(0, np.uint32)
            order = np.argsort(own, kind="stable")
            keys, own = keys[order], own[order]
            parts = [(int(ids[k := int(own[a])]), names[16 * k : 16 * k + 16], keys[a:b].astype("<u8").tobytes()) for a, b in _runs(own)]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "name", "hashes"])

        name = None
        for batch in batches:
            for b, n, low, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "batch", "low", "own")), strict=True):
                if b == -2:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([low], pa.binary())], ["doc_id", "name", "hashes"])
                    continue
                if n != name:
                    if got:
                        yield rows_of(name)
                    name, got = n, []
                if b < 0:
                    ids, names = np.frombuffer(low, "<i8"), own
                else:
                    got.append((b, np.frombuffer(low, "<u4").astype(np.uint64), np.frombuffer(own, "<u4")))
        if got:
            yield rows_of(name)

    schema = "bucket long, batch long, low binary, own binary"
    packed = materialize(docs.select("doc_id", "text").mapInArrow(pack, schema))
    met = packed.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, schema)
    back = met.union(packed.filter("bucket < 0").dropDuplicates(["batch"])).repartition("batch").sortWithinPartitions("batch", "bucket")
    found = materialize(back.mapInArrow(hand_back, "doc_id long, name binary, hashes binary"), sweep=True)
    discard(packed)
    return found


def periodic(data: np.ndarray, place: np.ndarray, text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors (as a mask) that are sent, and for these how much further the strings of the ones after them reach.

    In a run of one byte, or of any period within WINDOWS, each anchor has the
    context of the one before it. Their strings overlap, so the first one's
    answer, stretched to the last one, is that of all. `place` is that of the
    anchors in the padded data.
    """
    gap = np.append(0, place[1:] - place[:-1])
    alike = np.append(False, (text[1:] == text[:-1]) & (key[1:] == key[:-1])) & (gap <= WINDOWS)
    same = np.zeros(len(place), bool)
    for g in np.unique(gap[alike]).tolist():
        mine = np.flatnonzero(alike & (gap == g))
        equal = np.append(0, np.cumsum(data[:-g] == data[g:], dtype=np.int32))
        begin = place[mine] - g - SIDE
        same[mine] = equal[begin + WIDTH] - equal[begin] == WIDTH
    first = np.flatnonzero(~same)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    return ~same, place[last] - place[first]


#: Two values of each byte, for two independent polynomial hashes of a string.
BYTE_VALUES = mix(np.arange(1, 513, dtype=np.uint64).reshape(2, 256) * MIX_A)


def hot_strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, text: np.ndarray, at: np.ndarray, more: np.ndarray):
    """Strings around hot anchors: (asked, told), each (digest 1, digest 2, doc_id, start, more).

    Of equal strings of a batch the least document asks; the others are told at
    once that theirs goes. `begin` is where each text begins in the data.
    """
    start = (at[:, None] - SIDE + np.arange(WINDOWS)).ravel()
    text, more = np.repeat(text, WINDOWS), np.repeat(more, WINDOWS)
    real = (start >= 0) & (start + LENGTH <= size[text])
    text, start, more = text[real], start[real], more[real]
    order = np.lexsort((-more, start, text))
    text, start, more = text[order], start[order], more[order]
    once = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1])) if len(text) else np.zeros(0, bool)
    text, start, more = text[once], start[once], more[once]
    up, down = _powers_upto(len(data) + 1)
    digests = []
    for values in BYTE_VALUES:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        place = begin[text] + start
        digests.append(mix((total[place + LENGTH] - total[place]) * down[place]).astype(np.int64))
    doc = ids[text]
    order = np.lexsort((start, doc, digests[1], digests[0]))
    rows = [x[order] for x in (*digests, doc, start, more)]
    lead = np.zeros(len(doc), np.int64)
    for a, b in _runs(rows[0], rows[1]):
        lead[a:b] = rows[2][a]
    mine = rows[2] == lead
    return [x[mine] for x in rows], [x[~mine] for x in rows]


def contexts(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Rows of packed contexts by bucket, from documents with their repeated anchors' hashes.

    Strings around hot anchors are rows of their own: in bucket -2 those that ask
    for an earlier document, by their digests, in -3 those that have one.

    Within a batch only the least doc_id sends a context; the others say at once
    that all of its strings go (bucket -1). Of a periodic run one context goes,
    with how much `more` it stands for.
    """
    import pyarrow as pa

    names = ["bucket", "key", "context", "front", "back", "doc_id", "at", "more"]
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_numpy()
            text, at, h = anchors(texts)
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            key = (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            known = _unpack(batch.column("hashes"), "<u8")
            first = np.searchsorted(text, np.arange(len(texts) + 1))
            hit = np.concatenate([np.isin(key[first[i] : first[i + 1]], known[i]) for i in range(len(texts))]) if len(text) else np.zeros(0, bool)
            text, at, key, bucket = text[hit], at[hit], key[hit], bucket[hit].astype(np.int64)
            if not len(text):
                continue
            data = np.frombuffer(b"\0" * SIDE + (b"\0" * (2 * SIDE)).join(texts) + b"\0" * (2 * SIDE), np.uint8)
            size = np.array([len(t) for t in texts], np.int64)
            begin = np.cumsum(size + 2 * SIDE) - (size + 2 * SIDE)  # of the padding in front of each text
            sent, more = periodic(data, begin[text] + SIDE + at, text, key)
            text, at, key, bucket = text[sent], at[sent], key[sent], bucket[sent]
            warm = np.isin(key, shared.value) if len(shared.value) else np.zeros(len(key), bool)
            if warm.any():
                for own, (one, two, doc, start, far) in zip((-2, -3), hot_strings(data, begin + SIDE, size, ids, text[warm], at[warm], more[warm]), strict=True):
                    n, zero = len(doc), pa.array(np.zeros(len(doc), np.int32))
                    out = [pa.array(np.full(n, own)), pa.array(one), pa.array([x.tobytes() for x in two.astype("<i8")], pa.binary()), zero, zero, pa.array(doc), pa.array(start.astype(np.int32)), pa.array(far.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(out, names)
                text, at, key, bucket, more = text[~warm], at[~warm], key[~warm], bucket[~warm], more[~warm]
            if not len(text):
                continue
            ctx = data[(begin[text] + at)[:, None] + np.arange(WIDTH)]
            front, back = np.maximum(0, SIDE - at), np.maximum(0, at + GRAM + SIDE - size[text])
            doc = ids[text]
            whole = np.column_stack((key.astype("<u8").view(np.uint8).reshape(-1, 8), front.astype(np.uint8), back.astype(np.uint8), ctx))
            names_ = np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel()
            ranks = np.unique(names_, return_inverse=True)[1]
            order = np.lexsort((at, doc, ranks))
            lead = np.append(True, ranks[order][1:] != ranks[order][:-1])
            leader = doc[order][np.flatnonzero(lead)][np.cumsum(lead) - 1]
            same = doc[order] == leader  # the document's own repeats of a context go on with it
            send = order[same]
            gone = order[~same]
            out = [pa.array(bucket[send]), pa.array(key[send].astype(np.int64)), pa.array([c.tobytes() for c in ctx[send]], pa.binary()), pa.array(front[send].astype(np.int32)), pa.array(back[send].astype(np.int32)), pa.array(doc[send]), pa.array(at[send].astype(np.int32)), pa.array(more[send].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names)
            if len(gone):
                n = len(gone)
                out = [pa.array(np.full(n, -1)), pa.array(key[gone].astype(np.int64)), pa.nulls(n, pa.binary()), pa.array(front[gone].astype(np.int32)), pa.array(back[gone].astype(np.int32)), pa.array(doc[gone]), pa.array(at[gone].astype(np.int32)), pa.array(more[gone].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text", "hashes").mapInArrow(run, "bucket long, key long, context binary, front int, back int, doc_id long, at int, more int")


def _equal_strings(c: np.ndarray, real: np.ndarray):
    """(place, rows, groups, number of groups): rows whose strings of LENGTH bytes at a place share a group are equal there.

    The suffix array is that of the contexts' blocks. A string at any place has
    FULL whole blocks; neighbours in the array that share so many, and the few
    bytes that the string has before and after them, are equal.
    """
    n = len(c)
    blocks = np.ascontiguousarray(c.reshape(n, WIDTH // BLOCK, BLOCK)).view(f"V{BLOCK}")[:, :, 0]
    symbols = np.unique(blocks.ravel(), return_inverse=True)[1].reshape(n, -1) + 1
    per = symbols.shape[1] + 1
    order = suffix_array(np.column_stack((symbols, np.zeros(n, np.int64))).ravel())
    row, block = order // per, order % per
    good = block + FULL < per
    row, block = row[good], block[good]
    same = np.ones(max(len(row) - 1, 0), bool)
    for k in range(FULL):
        x = symbols[row, block + k]
        same &= x[1:] == x[:-1]
    group = np.cumsum(np.append(True, ~same)) - 1 if len(row) else row
    padded = np.column_stack((c, np.zeros((n, LENGTH), np.uint8)))
    for place in range(WINDOWS):
        at = -(-place // BLOCK)
        mine = np.flatnonzero((block == at) & real[row, place])
        if not len(mine):
            continue
        r = row[mine]
        before = padded[r, place : at * BLOCK]
        after = padded[r, (at + FULL) * BLOCK : place + LENGTH]
        key = np.ascontiguousarray(np.column_stack((group[mine].astype("<i8").view(np.uint8).reshape(-1, 8), before, after)))
        names = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True)[1]
        yield place, r, names, int(names.max()) + 1


def shared_strings(ctx: np.ndarray, front: np.ndarray, back: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context and each of its WINDOWS strings, whether a smaller doc_id holds it too.

    Contexts are (n, WIDTH) bytes with their padding and anchors' keys. Equal
    contexts differ in nothing but their documents, so one stands for all. Those
    that share too little around the anchor with every other context of it can
    share no string. The rest goes through the suffix array.
    """
    n = len(ctx)
    out = np.zeros((n, WINDOWS), bool)
    real = (np.arange(WINDOWS) >= front[:, None]) & (np.arange(WINDOWS) + LENGTH <= WIDTH - back[:, None])
    whole = np.ascontiguousarray(np.column_stack((key.astype("<u8").view(np.uint8).reshape(-1, 8), front.astype(np.uint8), back.astype(np.uint8), ctx)))
    _, one, of = np.unique(whole.view(f"V{whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
    earliest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(earliest, of, doc)
    out |= (earliest[of] < doc)[:, None]
    c, k = ctx[one], key[one]

    def shares(among: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(np.column_stack((k[among].astype("<u8").view(np.uint8).reshape(-1, 8), part)))
        ranks, counts = np.unique(x.view(f"V{x.shape[1]}").ravel(), return_inverse=True, return_counts=True)[1:]
        return counts[ranks] > 1

    # a string reaches l bytes to the left of its anchor and SIDE - l to the right: half of SIDE on one side at least,
    # and for l between two steps at least the lower step's bytes there and the upper step's rest here
    half, step = SIDE // 2, 4
    rest = np.arange(len(one))
    rest = rest[shares(rest, c[:, half:SIDE]) | shares(rest, c[:, SIDE + GRAM : SIDE + GRAM + SIDE - half])]
    likely = np.zeros(len(rest), bool)
    for left in range(0, SIDE + 1, step):
        right = max(0, SIDE - left - step + 1)
        likely |= shares(rest, c[rest, SIDE - left : SIDE + GRAM + right])
    rest = rest[likely]
    if len(rest):
        first = np.full((len(one), WINDOWS), np.iinfo(np.int64).max)
        for place, row, group, count in _equal_strings(c[rest], real[one[rest]]):
            least = np.full(count, np.iinfo(np.int64).max)
            np.minimum.at(least, group, earliest[rest[row]])
            first[rest[row], place] = least[group]
        out |= first[of] < doc[:, None]
    return out & real


def removals(packed: DataFrame) -> DataFrame:
    """(doc_id, starts): packed places in documents at which a string begins that an earlier document holds."""
    import pyarrow as pa

    def run(batches):
        for rows in _cut(batches, ["bucket"]):
            front, back, doc, at, more = (rows.column(c).to_numpy().astype(np.int64) for c in ("front", "back", "doc_id", "at", "more"))
            bucket = rows.column("bucket").to_numpy()
            told = np.flatnonzero(bucket == -3)
            if len(ask := np.flatnonzero(bucket == -2)):
                one, two = rows.column("key").to_numpy()[ask], np.frombuffer(b"".join(rows.column("context").take(ask).to_pylist()), "<i8")
                order = np.lexsort((doc[ask], two, one))
                one, two, ask = one[order], two[order], ask[order]
                told = np.concatenate([told, *[ask[a:b][doc[ask[a:b]] > doc[ask[a]]] for a, b in _runs(one, two) if b - a > 1]])
            if len(told):
                yield spans_of(doc[told], at[told], at[told] + LENGTH + more[told])
            if bucket[-1] < -1:
                continue
            other = np.flatnonzero(bucket >= -1)
            if len(other) < len(bucket):
                rows = rows.take(other)
                front, back, doc, at, more, bucket = (x[other] for x in (front, back, doc, at, more, bucket))
            hit = (np.arange(WINDOWS) >= front[:, None]) & (np.arange(WINDOWS) + LENGTH <= WIDTH - back[:, None])
            sent = np.flatnonzero(bucket >= 0)
            if len(sent):
                ctx = np.frombuffer(b"".join(x for x in rows.column("context").to_pylist() if x is not None), np.uint8).reshape(-1, WIDTH)
                hit[sent] = shared_strings(ctx, front[sent], back[sent], rows.column("key").to_numpy()[sent], doc[sent])
            r, w = np.nonzero(hit)
            yield spans_of(doc[r], at[r] - SIDE + w, at[r] - SIDE + w + LENGTH + more[r])

    def spans_of(own, start, end):
        """Runs of neighbouring starts of a document as spans; a stretched one ends its run."""
        order = np.lexsort((start, own))
        start, own, end = start[order], own[order], end[order]
        new = np.append(True, (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1) | (end[:-1] > start[:-1] + LENGTH) | (end[1:] > start[1:] + LENGTH)) if len(own) else np.zeros(0, bool)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(own)) - 1 if len(a) else a
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(start[a].astype(np.int32)), pa.array(end[b].astype(np.int32))], ["doc_id", "start", "end"])

    by = F.when(F.col("bucket") == -2, F.xxhash64("key", "context")).when(F.col("bucket") < 0, F.pmod(F.xxhash64("doc_id"), F.lit(4096))).otherwise(F.lit(0))
    dealt = packed.repartition("bucket", by)
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, start int, end int")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text) of every row of documents.

    A null text is empty. Rows without doc_id are left whole and count as no
    document; rows that repeat a doc_id are judged against smaller ids alike. A
    text that a smaller id holds whole goes whole if it has LENGTH bytes. An
    empty table gives an empty result.
    """
    import pyarrow as pa

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = base.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("name")).filter(f"doc_id IS NOT NULL AND n >= {LENGTH}")
    texts = materialize(named.groupBy("name").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")))
    size = texts.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, size // (BUCKET_ANCHORS * WINDOWS // 2))
    usable = base.filter(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}")
    found = repeated_anchors(usable, buckets, max(HOT_TEXTS, size // (WINDOWS // 2 * HOT_ANCHORS)))
    hot = np.array(sorted({k for r in found.filter("doc_id IS NULL").collect() for k in np.frombuffer(r["hashes"], "<u8").tolist()}), np.uint64)
    hashes = found.filter("doc_id IS NOT NULL")
    # of each text its least document; where an id repeats, each of its texts by its name
    leads = texts.select(F.col("least").alias("doc_id"), F.unhex("name").alias("name")).join(hashes.groupBy("doc_id", "name").agg(F.max("hashes").alias("hashes")), ["doc_id", "name"])
    spans = materialize(removals(contexts(usable.withColumn("name", F.unhex(F.md5("text"))).join(leads, ["doc_id", "name"]), buckets, hot)), sweep=True)
    # an earlier document's whole text goes by its name, so that texts are shuffled once, with the spans
    copies = named.join(texts.select("name", "least"), "name").filter("least < doc_id").select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), "name").distinct()
    all_spans = spans.withColumn("name", F.lit(None).cast("string")).unionByName(copies)
    own = all_spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "name")).alias("spans"))
    joined = base.join(own, "doc_id", "left")

    def cut(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                names = {x["name"] for x in found or () if x["name"]}
                if names and hashlib.md5(data).hexdigest() in names:
                    out.append((len(data), len(data), 1, b""))
                    continue
                kept, at, gone, runs, edge = [], 0, 0, 0, -1
                for s, e in sorted((x["start"], x["end"]) for x in found or () if not x["name"]):
                    if s > edge:
                        runs += 1
                    if s > at:
                        kept.append(data[at:s])
                    if e > at:
                        gone += e - max(s, at)
                        at = e
                    edge = max(edge, e)
                kept.append(data[at:])
                out.append((len(data), gone, runs, b"".join(kept)))
            n, gone, runs, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
