"""ISO base media files: write bytes as 8-bit samples, walk nested boxes, decode sample tables.

The walker reads box headers and sample tables only. Codec, duration and the byte ranges of key frames come from
them; sample payloads are neither decoded nor copied. `read_samples` copies payload bytes where the caller wants them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import lean, ship, without

#: Bytes of a sample, samples of a chunk (its first one is the key frame), and samples a second.
BLOCK, PER_CHUNK, RATE = 64, 64, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

#: Boxes stand in so many others at most.
DEPTH = 32


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """The data with bytes 0 up to a positive multiple of BLOCK."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def build(payload: bytes) -> bytes:
    """A one-track file of 8-bit unsigned mono sound; the payload's length is a positive multiple of BLOCK."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload must be a positive multiple of the block")
    n = len(payload) // BLOCK
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = n * BLOCK
    stsd = _full(b"stsd", 0, 0, struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)))
    runs = ([(1, PER_CHUNK, 1)] if chunks > 1 or last == PER_CHUNK else []) + ([(chunks, last, 1)] if last != PER_CHUNK else [])
    stsc = _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs))
    stsz = _full(b"stsz", 0, 0, struct.pack(">II", BLOCK, n))
    stts = _full(b"stts", 0, 0, struct.pack(">III", 1, n, BLOCK))
    stss = _full(b"stss", 0, 0, struct.pack(">I", chunks), (np.arange(chunks, dtype=np.uint32) * PER_CHUNK + 1).astype(">u4").tobytes())

    def head(first: int) -> bytes:
        offsets = np.arange(chunks, dtype=np.uint64) * (BLOCK * PER_CHUNK) + np.uint64(first)
        wide = first + len(payload) >= 2**32
        stco = _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
        stbl = _box(b"stbl", stsd, stts, stss, stsc, stsz, stco)
        dinf = _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1)))
        minf = _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, RATE, duration, 0x55C4, 0)), _full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"soun"), b"sound\0"), minf)
        tkhd = _full(b"tkhd", 1, 7, struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = _full(b"mvhd", 1, 0, struct.pack(">QQIQIH10x", 0, 0, RATE, duration, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
        big = 16 if len(payload) >= 2**32 - 8 else 8
        moov = _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2"), moov, big

    ftyp, moov, big = head(0)
    ftyp, moov, big = head(len(ftyp) + len(moov) + big)
    return ftyp + moov + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte of the body, end) of each box, depth first. A size that does not fit raises ValueError, and so
    does nesting beyond DEPTH."""
    open_boxes: list[tuple[tuple[bytes, ...], int]] = [((), len(data))]
    start = 0
    while open_boxes:
        path, end = open_boxes[-1]
        if start >= end:
            open_boxes.pop()
            continue
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} has a size that does not fit")
        here = (*path, kind)
        yield here, body, start + size
        if kind in NESTED:
            if len(here) > DEPTH:
                raise ValueError("boxes are nested too deep")
            open_boxes.append((here, start + size))
            start = body
        else:
            start += size


@dataclass
class Track:
    """What the sample tables of a track, and its fragments, say. offsets, sizes, times: of each sample; keys: numbers of the key
    frames from 0."""

    number: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: How long the last sample of the tables lasts.
    last: int = 0

    def key_ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of the key frames."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


#: What a box says of the fragment it stands in: flag, number of bytes. Of tfhd before the defaults, and of a trun's samples.
TFHD, TRUN = ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4)), ((0x100, 4), (0x200, 4), (0x400, 4), (0x800, 4))
#: Set in the flags of a sample that is no key frame.
NO_KEY = 0x10000


class _Reader:
    """Sample tables of one file. Every count is held against the file's size before anything is made of it."""

    def __init__(self, data: bytes):
        self.data = data
        self.tracks: list[Track] = []
        self.raw: dict[bytes, np.ndarray] = {}
        self.defaults: dict[int, tuple[int, int, int]] = {}
        #: Of fragments: (track number, offsets, sizes, durations, key or not).
        self.parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def need(self, body: int, end: int, n: int) -> None:
        if body + n > end:
            raise ValueError("a box is cut off")

    def table(self, body: int, end: int, kind: str, columns: int, skip: int = 4) -> np.ndarray:
        self.need(body, end, skip + 4)
        (n,) = struct.unpack_from(">I", self.data, body + skip)
        if body + skip + 4 + n * columns * int(kind[-1]) > end:
            raise ValueError("a sample table is cut off")
        found = np.frombuffer(self.data, kind, n * columns, body + skip + 4)
        if kind == ">u8" and n and int(found.max()) > len(self.data):
            raise ValueError("a sample lies outside the file")
        return found.astype(np.int64).reshape(n, columns)

    def read(self) -> list[Track]:
        moof, base = 0, {}
        for path, body, end in walk(self.data):
            kind = path[-1]
            if path == (b"moov", b"trak"):
                self.finish()
                self.tracks.append(Track(len(self.tracks) + 1))
            elif path[:2] == (b"moov", b"trak") and self.tracks:
                self.of_track(kind, body, end)
            elif path == (b"moov", b"mvex", b"trex"):
                self.need(body, end, 24)
                number, _, duration, size, flags = struct.unpack_from(">5I", self.data, body + 4)
                self.defaults[number] = duration, size, flags
            elif path == (b"moof",):
                moof = body - 8
            elif path == (b"moof", b"traf"):
                base = {"at": moof, "next": None}
            elif path == (b"moof", b"traf", b"tfhd"):
                self.fragment(base, moof, body, end)
            elif path == (b"moof", b"traf", b"trun"):
                self.run(base, body, end)
        self.finish()
        for number, offsets, sizes, lasts, keys in self.parts:
            t = next((t for t in self.tracks if t.number == number), None)
            if t is None:
                raise ValueError("a fragment is of no track")
            t.keys = np.concatenate([t.keys, len(t.sizes) + np.flatnonzero(keys)])
            start = int(t.times[-1]) + t.last if len(t.times) else 0
            t.times = np.concatenate([t.times, start + np.cumsum(lasts) - lasts])
            t.last = int(lasts[-1]) if len(lasts) else t.last
            t.offsets, t.sizes = np.concatenate([t.offsets, offsets]), np.concatenate([t.sizes, sizes])
            t.duration = max(t.duration, start + int(lasts.sum()))
        for t in self.tracks:
            if len(t.sizes) and (int(t.sizes.min()) < 0 or int(t.offsets.min()) < 0 or int((t.offsets + t.sizes).max()) > len(self.data)):
                raise ValueError("a sample lies outside the file")
            if int(t.sizes.sum()) > len(self.data):
                raise ValueError("the samples do not fit in the file")
        return self.tracks

    def of_track(self, kind: bytes, body: int, end: int) -> None:
        t, data = self.tracks[-1], self.data
        if kind == b"tkhd":
            self.need(body, end, 24)
            (t.number,) = struct.unpack_from(">I", data, body + (20 if data[body] == 1 else 12))
        elif kind == b"mdhd":
            wide = self.need(body, end, 20) or data[body] == 1
            self.need(body, end, 32 if wide else 20)
            t.timescale, t.duration = struct.unpack_from(">IQ", data, body + 20) if wide else struct.unpack_from(">II", data, body + 12)
            t.duration = min(t.duration, 2**63 - 1)
        elif kind == b"hdlr":
            self.need(body, end, 12)
            t.handler = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stsd":
            self.need(body, end, 16)
            t.codec = data[body + 12 : body + 16].decode("latin-1")
        elif kind in (b"stts", b"stss", b"stsc"):
            self.raw[kind] = self.table(body, end, ">u4", {b"stts": 2, b"stss": 1, b"stsc": 3}[kind])
        elif kind in (b"stco", b"co64"):
            self.raw[b"chunks"] = self.table(body, end, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
        elif kind == b"stsz":
            self.need(body, end, 12)
            size, n = struct.unpack_from(">II", data, body + 4)
            if size * n > len(data):
                raise ValueError("the samples do not fit in the file")
            self.raw[b"sizes"] = np.full(n, size, np.int64) if size else self.table(body, end, ">u4", 1, 8)[:, 0]
        elif kind == b"stz2":
            self.need(body, end, 12)
            bits, n = struct.unpack_from(">II", data, body + 4)
            if (bits := bits & 255) not in (4, 8, 16) or body + 12 + (n * bits + 7) // 8 > end:
                raise ValueError("a sample table is cut off")
            if bits == 4:
                found = np.frombuffer(data, np.uint8, (n + 1) // 2, body + 12)
                self.raw[b"sizes"] = np.stack([found >> 4, found & 15], axis=1).ravel()[:n].astype(np.int64)
            else:
                self.raw[b"sizes"] = np.frombuffer(data, ">u1" if bits == 8 else ">u2", n, body + 12).astype(np.int64)

    def finish(self) -> None:
        """Put the tables of the last track together."""
        raw, self.raw = self.raw, {}
        if not self.tracks or not raw:
            return
        t = self.tracks[-1]
        t.sizes = raw.get(b"sizes", t.sizes)
        n = len(t.sizes)
        chunk_at, stsc, stts = raw.get(b"chunks", np.zeros(0, np.int64)), raw.get(b"stsc", np.zeros((0, 3), np.int64)), raw.get(b"stts", np.zeros((0, 2), np.int64))
        first = np.append(stsc[:, 0], len(chunk_at) + 1)
        if len(stsc) and (first[0] != 1 or (np.diff(first) < 0).any()):
            raise ValueError("the runs of chunks are out of order")
        if int((stsc[:, 1].astype(float) * np.diff(first)).sum() if len(stsc) else 0) != n:
            raise ValueError("the chunks do not hold as many samples as there are")
        if int(stts[:, 0].sum()) != n:
            raise ValueError("the times are not of as many samples as there are")
        per = np.repeat(stsc[:, 1], np.diff(first)) if len(stsc) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(t.sizes) - t.sizes
        begin = (np.cumsum(per) - per)[owner]
        t.offsets = chunk_at[owner] + before - before[begin] if n else t.offsets
        lasts = np.repeat(stts[:, 1], stts[:, 0])
        t.times, t.last = np.cumsum(lasts) - lasts, int(lasts[-1]) if n else 0
        t.keys = raw[b"stss"][:, 0] - 1 if b"stss" in raw else np.arange(n)
        if len(t.keys) and (int(t.keys.min()) < 0 or int(t.keys.max()) >= n):
            raise ValueError("a key frame has a number that no sample has")

    def fragment(self, base: dict, moof: int, body: int, end: int) -> None:
        self.need(body, end, 8)
        flags, number = struct.unpack_from(">II", self.data, body)
        at, found = body + 8, {}
        for flag, width in TFHD:
            if flags & flag:
                self.need(at, end, width)
                found[flag] = int.from_bytes(self.data[at : at + width], "big")
                at += width
        duration, size, kind = self.defaults.get(number, (0, 0, 0))
        base |= {"number": number, "at": found.get(0x1, moof), "duration": found.get(0x8, duration), "size": found.get(0x10, size), "flags": found.get(0x20, kind)}

    def run(self, base: dict, body: int, end: int) -> None:
        if "number" not in base:
            raise ValueError("a run of samples is of no track")
        self.need(body, end, 8)
        flags, n = struct.unpack_from(">II", self.data, body)
        at, start, first = body + 8, base["next"] if base["next"] is not None else base["at"], None
        if flags & 0x1:
            self.need(at, end, 4)
            start = base["at"] + struct.unpack_from(">i", self.data, at)[0]
            at += 4
        if flags & 0x4:
            self.need(at, end, 4)
            (first,) = struct.unpack_from(">I", self.data, at)
            at += 4
        columns = [flag for flag, _ in TRUN if flags & flag]
        self.need(at, end, 4 * len(columns) * n)
        if not columns and n * max(1, base["size"]) > len(self.data):
            raise ValueError("the samples do not fit in the file")
        found = np.frombuffer(self.data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns)) if columns else np.zeros((n, 0), np.int64)
        column = lambda flag, default: found[:, columns.index(flag)] if flag in columns else np.full(n, default, np.int64)
        lasts, sizes, kinds = column(0x100, base["duration"]), column(0x200, base["size"]), column(0x400, base["flags"]).copy()
        if first is not None and n:
            kinds[0] = first
        if start > len(self.data):
            raise ValueError("a sample lies outside the file")
        self.parts.append((base["number"], start + np.cumsum(sizes) - sizes, sizes, lasts, (kinds & NO_KEY) == 0))
        base["next"] = start + int(sizes.sum())


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file, with the samples of its tables and fragments; broken files raise ValueError."""
    return _Reader(data).read()


def read_samples(data: bytes, track: Track) -> bytes:
    """The payload: the samples' bytes in their order."""
    if not len(track.sizes):
        return b""
    # samples that follow each other in the file are copied together
    breaks = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    first = np.concatenate([[0], breaks])
    ends = np.concatenate([breaks, [len(track.sizes)]]) - 1
    return b"".join(data[track.offsets[a] : track.offsets[b] + track.sizes[b]] for a, b in zip(first.tolist(), ends.tolist(), strict=True))


def pack(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a media file (binary) that holds each whole text in UTF-8, padded; null counts as empty. A clashing column is replaced;
    repeated rows are treated alike, and an empty table gives an empty result."""
    df = without(df, out)
    ship(df.sparkSession)
    schema, at = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                made = pa.array([build(padded(t or b"")) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return df.mapInArrow(lean(run), schema)


KEY_RANGES = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
#: Columns that unpack() adds, with their types.
FEATURES = [
    ("codec", T.StringType()), ("handler", T.StringType()), ("timescale", T.LongType()), ("duration", T.LongType()), ("n_samples", T.LongType()),
    ("key_ranges", KEY_RANGES),
    ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("error", T.StringType()),
    ("tracks", T.ArrayType(T.StructType([T.StructField("codec", T.StringType()), T.StructField("handler", T.StringType()), T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("key_ranges", KEY_RANGES)]))),
]


def inspect(data: bytes | None) -> dict:
    """The features of a file: of its first track, and of each in `tracks`. Null, broken and trackless files have an error and
    nulls; no file raises."""
    row: dict = dict.fromkeys(n for n, _ in FEATURES)
    try:
        if data is None:
            raise ValueError("no file")
        found = tracks(data)
        if not found:
            raise ValueError("no track")
        payload = read_samples(data, found[0])
        each = [{"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "key_ranges": [{"offset": a, "length": n} for a, n in t.key_ranges()]} for t in found]
    except (ValueError, struct.error) as e:
        return row | {"error": str(e) or type(e).__name__}
    return row | each[0] | {
        "payload_bytes": len(payload), "payload_sha256": sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]), "media_bytes": len(data), "media_sha256": sha256(data).hexdigest(), "tracks": each,
    }


def unpack(df: DataFrame, media: str = "media") -> DataFrame:
    """Replace the media column by the features of the stored bytes (see FEATURES); clashing columns are replaced.

    A null, empty or broken file gives a row with `error`; files of any length are read whole, and repeated rows are treated
    alike. An empty table gives an empty result.
    """
    df = without(df, *(n for n, _ in FEATURES))
    ship(df.sparkSession)
    at = df.columns.index(media)
    kept = [f for i, f in enumerate(df.schema.fields) if i != at]
    schema = T.StructType([*kept, *(T.StructField(n, k) for n, k in FEATURES)])
    told = [("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("key_ranges", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]
    kinds = pa.schema([*told, ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("error", pa.string()), ("tracks", pa.list_(pa.struct(told)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = pa.RecordBatch.from_pylist([inspect(x.as_py()) for x in b.column(at)], schema=kinds)
                rest = [j for j in range(b.num_columns) if j != at]
                yield pa.RecordBatch.from_arrays([*(b.column(j) for j in rest), *found.columns], names=[*(b.schema.names[j] for j in rest), *found.schema.names])

    return df.mapInArrow(lean(run), schema)
