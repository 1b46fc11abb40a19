"""Texts stored losslessly as AVI motion-JPEG clips, read back, and cut into shots.

Each 576-byte block of a text is one 24 x 24 grey frame, coded as a lossless
JPEG (the predictive process, left predictor). Its Huffman table gives the
category of c bits a code of 9 - c bits, so every sample takes nine bits and
frames are coded and decoded by array operations. The RIFF file has the usual
header lists, one `00dc` chunk a frame and an `idx1` index, from which the
frames are found again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, sliced_batches

SIDE, FRAME, FPS = 24, 576, 25
#: Padding of a payload to whole frames.
PAD = b"\xff"
#: A shot begins where a histogram difference is over FLOOR and over the mean of the WINDOW differences before it by SPREAD deviations.
BINS, FLOOR, SPREAD, WINDOW = 16, 0.35, 3.0, 8
SLICE = 1_000_000


def _jpeg_tables() -> tuple[bytes, bytes]:
    counts = bytes([1] * 9 + [0] * 7)  # one code of each length from 1 to 9, for the categories 8 down to 0
    dht = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + counts + bytes(range(8, -1, -1))
    sof = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0])
    sos = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 1, 0, 0])
    return b"\xff\xd8" + sof + dht + sos, b"\xff\xd9"


HEAD, TAIL = _jpeg_tables()


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The nine bits of each difference (at difference + 255), and the difference of each nine bits."""
    code, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        low = d if d >= 0 else d + (1 << c) - 1
        # the code of category c: 8 - c ones and a zero, then c bits of the difference
        code[d + 255] = ((((1 << (9 - c)) - 2) << c) | low) & 0x1FF
        back[code[d + 255]] = d
    return code, back


CODE, BACK = _codes()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """(n, 576) samples to n lossless JPEG images."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    code = CODE[diff.reshape(-1, 8) + 255]  # eight samples are nine bytes
    out = np.empty((len(code), 9), np.uint8)
    out[:, 0] = code[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (code[:, k - 1] << (8 - k)) | (code[:, k] >> (k + 1))
    out[:, 8] = code[:, 7]
    data = out.tobytes()
    step = FRAME // 8 * 9
    return [HEAD + data[i : i + step].replace(b"\xff", b"\xff\x00") + TAIL for i in range(0, len(data), step)]


@dataclass(frozen=True)
class Frame:
    """A lossless grey JPEG: its size, predictor, Huffman table (codes of each length, their categories), and coded samples."""

    height: int
    width: int
    predictor: int
    counts: bytes
    categories: bytes
    data: bytes


def parse_frame(image: bytes) -> Frame:
    """The segments of a lossless JPEG of one 8-bit component. Raises ValueError for other images."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, size, tables = 2, None, {}
    while at + 4 <= len(image) and image[at] == 0xFF:
        marker, n = image[at + 1], int.from_bytes(image[at + 2 : at + 4])
        body = image[at + 4 : at + 2 + n]
        if len(body) < n - 2 or n < 8 and marker == 0xDA:
            raise ValueError("a segment that is cut off")
        at += 2 + n
        if marker == 0xC3:
            if body[0] != 8 or body[5] != 1:
                raise ValueError("not one component of 8 bits")
            size = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a lossless intra frame")
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xDA:
            if size is None or body[0] != 1 or body[2] >> 4 not in tables or body[5] & 15 or not 1 <= body[3] <= 7:
                raise ValueError("not a scan of one component without a point transform")
            end = image.rfind(b"\xff\xd9")
            return Frame(*size, body[3], *tables[body[2] >> 4], image[at : end if end >= at else len(image)].replace(b"\xff\x00", b"\xff"))
    raise ValueError("a JPEG without a scan")


def _canonical(frame: Frame) -> dict[tuple[int, int], int]:
    """The category of each (length, code) of a frame's table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(frame.counts, 1):
        for _ in range(n):
            out[length, code] = frame.categories[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _differences(frame: Frame) -> np.ndarray:
    """The differences of a frame's samples, one code after the other."""
    codes = _canonical(frame)
    bits = np.unpackbits(np.frombuffer(frame.data, np.uint8)).tolist()
    out, at = [], 0
    for _ in range(frame.height * frame.width):
        length = code = 0
        while (length, code) not in codes:
            if length == 16 or at >= len(bits):
                raise ValueError("a broken code")
            length, code, at = length + 1, code << 1 | bits[at], at + 1
        c = codes[length, code]
        if c == 16:
            out.append(32768)
            continue
        value = int("".join(map(str, bits[at : at + c])) or "0", 2)
        at += c
        out.append(value if not c or value >> (c - 1) else value - (1 << c) + 1)
    return np.array(out, np.int64).reshape(frame.height, frame.width)


def _samples(frame: Frame) -> np.ndarray:
    """The samples of any lossless grey frame: the first row is predicted from the left, the first column from above, the rest as the predictor says."""
    d, x = _differences(frame), np.zeros((frame.height, frame.width), np.int64)
    ways = {1: lambda a, b, c: a, 2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}
    x[0] = (np.cumsum(d[0]) + 128) & 0xFFFF
    for i in range(1, frame.height):
        x[i, 0] = (x[i - 1, 0] + d[i, 0]) & 0xFFFF
        for j in range(1, frame.width):
            x[i, j] = (ways[frame.predictor](int(x[i, j - 1]), int(x[i - 1, j]), int(x[i - 1, j - 1])) + d[i, j]) & 0xFFFF
    return x.astype(np.uint8)


def _even_table(frame: Frame) -> bool:
    """Whether a frame's codes are those of CODE, nine bits a sample in whole bytes, so that arrays can decode it."""
    own = {(int(k), (1 << int(k)) - 2 if k < 9 else 0x1FE): 9 - int(k) for k in range(1, 9)} | {(9, 0x1FE): 0}
    return frame.predictor == 1 and (frame.height, frame.width) == (SIDE, SIDE) and _canonical(frame) == own and len(frame.data) == FRAME // 8 * 9


def decode_frames(images: list[bytes]) -> list[np.ndarray]:
    """Lossless grey JPEG images to arrays of samples, of any size, predictor and table.

    Frames whose codes all take nine bits are decoded together by array
    operations, others code by code. Raises ValueError for images of other forms.
    """
    frames = [parse_frame(x) for x in images]
    known: dict[tuple, bool] = {}
    even = [known[k] if (k := (f.height, f.width, f.predictor, f.counts, f.categories, len(f.data))) in known else known.setdefault(k, _even_table(f)) for f in frames]
    fast = iter(_decode_even([f.data for f, e in zip(frames, even, strict=True) if e]))
    return [next(fast) if e else _samples(f) for f, e in zip(frames, even, strict=True)]


def _decode_even(parts: list[bytes]) -> np.ndarray:
    b = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 9).astype(np.uint16)
    code = np.empty((len(b), 8), np.uint16)
    code[:, 0] = (b[:, 0] << 1) | (b[:, 1] >> 7)
    for k in range(1, 7):
        code[:, k] = ((b[:, k] << (k + 1)) & 0x1FF) | (b[:, k + 1] >> (7 - k))
    code[:, 7] = ((b[:, 7] & 1) << 8) | b[:, 8]
    diff = BACK[code].reshape(-1, SIDE, SIDE).astype(np.int32)
    diff[:, 0, 0] += 128
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1)
    return np.cumsum(diff, axis=2).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(images: list[bytes]) -> bytes:
    """Motion-JPEG images to a RIFF AVI file with an index."""
    most = max(map(len, images))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(images), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(images), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body, index, at = [], [], 4
    for image in images:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        body.append(_chunk(b"00dc", image))
        at += len(body[-1])
    movi = _chunk(b"LIST", b"movi" + b"".join(body))
    return _chunk(b"RIFF", b"AVI " + hdrl + movi + _chunk(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> list[bytes]:
    """The images of an AVI file, by its index. Raises ValueError where there is no RIFF AVI or index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = (at + 8, size)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    entries = struct.iter_unpack("<4sIII", media[index[0] : index[0] + index[1]])
    return [media[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in entries if name == b"00dc"]


def frames_of(data: bytes) -> bytes:
    """The payload of a text: its bytes and padding up to a positive multiple of a frame."""
    return data + PAD * (-len(data) % FRAME if data else FRAME)


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """First and one-past-last frame of each shot, by adaptive histogram differences. Frames are of one size."""
    n = len(samples)
    samples = samples.reshape(n, -1)
    flat = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])
    cuts = []
    if len(diff):
        one, two = np.append(0, np.cumsum(diff)), np.append(0, np.cumsum(diff * diff))
        i = np.arange(len(diff))
        a = np.maximum(0, i - WINDOW)
        k = np.maximum(i - a, 1)
        mean = (one[i] - one[a]) / k
        spread = np.sqrt(np.maximum((two[i] - two[a]) / k - mean * mean, 0))
        cuts = (np.flatnonzero((diff > FLOOR) & (diff > mean + SPREAD * spread)) + 1).tolist()
    bounds = [0, *cuts, n]
    return list(zip(bounds, bounds[1:], strict=False))


def text_to_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media binary of every document; a null or empty text is one frame of padding.

    Equal texts give equal files. Repeated rows stay repeated; a long text is a
    long clip. Other columns are left out. An empty table gives an empty table.
    """
    import pyarrow as pa

    schema = "doc_id long, n_bytes long, media binary"

    def run(batches):
        for batch in sliced_batches(batches, "text", SLICE):
            raw = [b"" if t is None else t.encode() for t in batch.column("text").to_pylist()]
            payloads = [frames_of(r) for r in raw]
            images = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
            media, at = [], 0
            for p in payloads:
                n = len(p) // FRAME
                media.append(write_avi(images[at : at + n]))
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


#: What a broken file raises.
BROKEN = (ValueError, IndexError, KeyError, struct.error)


def _all_samples(files: list[bytes]) -> list[np.ndarray | None]:
    """The frames of each file as one array, None for a file that cannot be read; all files are decoded at once unless one is broken."""
    images = []
    for m in files:
        try:
            images.append(read_avi(m) or None)
        except BROKEN:
            images.append(None)
    try:
        samples = decode_frames([i for own in images if own for i in own])
        at, out = 0, []
        for own in images:
            out.append(np.stack(samples[at : at + len(own)]) if own else None)
            at += len(own or ())
        return out
    except BROKEN:
        return [None] if len(files) == 1 else [s for m in files for s in _all_samples([m])]


def avi_clips(media: DataFrame) -> DataFrame:
    """Rows with `media` to those rows with payload digests and `clips`, an array of timed shots.

    Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    clips array<struct<first_frame, end_frame, start_s, end_s>> and state.
    `media` is dropped, columns of these names are replaced, the others pass
    through; repeated rows stay, an empty table gives an empty table. A clip
    without cuts is one shot. The state is `read`, `broken` for a file that is
    no such AVI, which has no payload and no clips, or `none` for null, which
    has no bytes either.
    """
    import pyarrow as pa

    own = {"media", "state", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"}
    keep = [f for f in media.schema.fields if f.name.lower() not in own]
    clip = T.StructType([T.StructField("first_frame", T.IntegerType()), T.StructField("end_frame", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
    long, string = T.LongType(), T.StringType()
    added = [("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("clips", T.ArrayType(clip)), ("state", string)]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in added)])
    arrow_clips = pa.list_(pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), arrow_clips, pa.string()]

    def run(batches):
        for batch in batches:
            files = batch.column("media").to_pylist()
            for a, b in slices([len(m or b"") for m in files], SLICE):
                rows = []
                for m, frames in zip(files[a:b], _all_samples([m or b"" for m in files[a:b]]), strict=True):
                    if frames is None:
                        rows.append((None, None, None, None, None, [], "none") if m is None else (None, None, None, len(m), hashlib.sha256(m).hexdigest(), [], "broken"))
                        continue
                    data = frames.tobytes()
                    found = [{"first_frame": s, "end_frame": e, "start_s": s / FPS, "end_s": e / FPS} for s, e in shots(frames)]
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(m), hashlib.sha256(m).hexdigest(), found, "read"))
                part = batch.slice(a, b - a)
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *new], schema.names)

    return media.mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row per shot: the rows' other columns with shot, first_frame, end_frame, start_s and end_s.

    Null and broken media have no shots and so no rows; repeated rows, long
    clips and empty tables are as in avi_clips.
    """
    found = avi_clips(media)
    return found.select(*(c for c in found.columns if c != "clips"), F.posexplode("clips").alias("shot", "clip")).select("*", "clip.*").drop("clip")


def op9_media(spark, sf_dir: str) -> DataFrame:
    """A row a document; `feature` has its shots by frames, `clips` by seconds."""
    from .common import table

    found = avi_clips(text_to_avi(table(spark, sf_dir, "documents"))).drop("state")
    cuts = F.transform("clips", lambda c: F.concat(c["first_frame"].cast("string"), F.lit("-"), c["end_frame"].cast("string")))
    times = F.transform("clips", lambda c: F.format_string("%.2f-%.2f", c["start_s"], c["end_s"]))
    return found.withColumn("feature", F.concat(F.size("clips").cast("string"), F.lit(":"), F.array_join(cuts, ","))).withColumn("clips", F.array_join(times, ","))
