"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct pieces of a batch lie end to end in one flat array of symbols. In
each round every neighbouring pair is looked up by binary search among the
sorted pair keys of the vocabulary, each piece's lowest-ranked pair is found by
a segmented minimum, and all its occurrences are merged at once. A bounded table
of encoded pieces is kept between the batches of a task.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, release_memory, sliced_batches, slices

#: How byte-level BPE of this family cuts a text into pieces before merging (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text handled at once in a task, and pieces kept in its table.
SLICE, KEPT_PIECES = 500_000, 100_000
#: Pieces of more bytes than this (unspaced scripts, encoded data) are merged pair by pair through a heap: rounds over them would cost their length each.
LONG_PIECE = 1000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = [""] * 256
    for b in plain:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


class Vocabulary:
    """A byte-level vocabulary file in the arrays that encoding and decoding use."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        of_symbol = {c: b for b, c in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        content = [b""] * size
        for token, i in ids.items():
            content[i] = bytes(of_symbol[c] for c in token) if all(c in of_symbol for c in token) else token.encode()
        for token, i in self.special.items():
            content[i] = token.encode()
        self.content = np.frombuffer(b"".join(content), np.uint8)
        self.length = np.fromiter(map(len, content), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.of_byte = np.array([ids[c] for c in symbols], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        self.find = regex.compile(PIECES).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.table: dict[str, bytes] = {}
        self.pairs: dict[int, tuple[int, int]] | None = None

    def merge(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        raw = [p.encode() for p in pieces]
        long = {i: self.merge_long(r) for i, r in enumerate(raw) if len(r) > LONG_PIECE}
        if long:
            rest = iter(self.merge_rounds([r for i, r in enumerate(raw) if i not in long]))
            return [long[i] if i in long else next(rest) for i in range(len(raw))]
        return self.merge_rounds(raw)

    def merge_long(self, raw: bytes) -> np.ndarray:
        """The ids of one piece: the lowest pair, the first of equal ones, merges next; pairs that are gone are passed over."""
        if self.pairs is None:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged.tolist(), strict=True), strict=True))
        sym = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, k) for i in range(n - 1) if (found := self.pairs.get(k := sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or (sym[i] << 32 | sym[j]) != k:
                continue
            sym[i], sym[j] = self.pairs[k][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (found := self.pairs.get(k := sym[a] << 32 | sym[after[a]])):
                    heapq.heappush(heap, (found[0], a, k))
        return np.array([x for x in sym if x >= 0], np.int32)

    def merge_rounds(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of many pieces: in each round the lowest pairs of every piece merge."""
        sym = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        piece = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1 << 60)
        while len(sym):
            key = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where((self.key[at] == key) & (piece[1:] == piece[:-1]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, np.diff(np.append(first, len(sym))))
            hit = np.flatnonzero((rank == best) & (rank < none))
            if len(hit):
                # of a run of overlapping hits (a a a) the first, third and so on merge
                run = np.flatnonzero(np.append(True, np.diff(hit) != 1))
                nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[nth % 2 == 0]
                at = np.searchsorted(self.key, (sym[hit] << 32) | sym[hit + 1])
                sym = sym.copy()
                sym[hit] = self.merged[at]
                keep = np.ones(len(sym), bool)
                keep[hit + 1] = False
                rest = best < none  # pieces without a pair are finished
                done.append((piece[~rest], sym[~rest]))
                sym, piece = sym[keep & rest], piece[keep & rest]
            else:
                done.append((piece, sym))
                break
        if not done or not raw:
            return [np.zeros(0, np.int32)] * len(raw)
        piece, sym = np.concatenate([p for p, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(piece, kind="stable")
        return np.split(sym[order].astype(np.int32), np.searchsorted(piece[order], np.arange(1, len(raw))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become their ids."""
        pieces: list[str] = []
        ends = []
        for t in texts:
            if self.cut and any(s in t for s in self.special):
                for part in self.cut(t):
                    pieces += [part] if part in self.special else self.find(part)
            else:
                pieces += self.find(t)
            ends.append(len(pieces))
        if len(self.table) > KEPT_PIECES:
            self.table.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.table]
        if new:
            self.table.update((p, x.tobytes()) for p, x in zip(new, self.merge(new), strict=True))
            self.table.update((p, np.array([i], np.int32).tobytes()) for p, i in self.special.items())
        get, at, out = self.table.__getitem__, 0, []
        for end in ends:
            out.append(np.frombuffer(b"".join(map(get, pieces[at:end])), np.int32))
            at = end
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of flat ids cut at `ends`; broken UTF-8 becomes the replacement character."""
        size = self.length[ids]
        total = np.cumsum(size)
        shift = np.repeat(self.start[ids] - (total - size), size)
        data = self.content[np.arange(len(shift)) + shift].tobytes()
        bounds = np.append(0, total)[np.append(0, ends)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:], strict=False)]


def _load(path: str | None) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """Documents with `ids` array<int> added (replaced if present); null text encodes as the empty text.

    Whole texts are encoded, in time that grows with their length; repeated rows
    stay repeated and an empty table gives an empty table.

    With `decode` the ids are decoded again in the same task, as `decoded`.

    `vocabulary` is the path of a byte-level BPE file that each executor can
    open; by default the public 50k one. All other columns pass through.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    base = docs.drop("ids", *["decoded"] * decode)
    schema = T.StructType([*base.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("decoded", T.StringType())] * decode])

    def run(batches):
        v = _load(vocabulary)
        for batch in sliced_batches(batches, "text", SLICE):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            ids = v.encode(texts)
            offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, flat)
            more = [pa.array(v.decode(flat.to_numpy().astype(np.int64), offsets.to_numpy()[1:]), pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *more], schema.names)
        release_memory()

    return base.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows with `ids` array<int> to the same rows with `decoded` string added; null ids decode as the empty text."""
    import pyarrow as pa

    base = encoded.drop("decoded")
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        v = _load(vocabulary)
        for batch in batches:
            lists = batch.column("ids")
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            for a, b in slices(size.tolist(), SLICE):
                part = batch.slice(a, b - a)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                texts = v.decode(ids.astype(np.int64), np.cumsum(size[a:b]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])
        release_memory()

    return base.mapInArrow(run, schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe_encode(docs, decode=True))


def token_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
