"""Fill-in-the-middle examples by rank and select over packed boundary bitvectors.

The bytes of many texts stand side by side. One bitvector marks where units (tokens) begin, another where code points begin;
each is packed, with a two-level directory of popcounts. A text's number of units is the difference of two ranks; the byte
where its k-th unit begins is one select. No list of tokens is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import lean, ship, slices, without

#: The marks before prefix, suffix and middle. None may be a part of another, or begin with what another ends with.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text handled at once, unless one text has more.
SLICE_BYTES = 4_000_000
#: Bytes classified at once, a multiple of eight, so that masks stay small beside a very long text.
STEP = 1 << 20
BLOCK_WORDS = 8
#: Class of each byte: 1 for A-Z and a-z, 2 for a byte that continues a code point, else 0.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[0x80:0xC0] = 2


class Bitvector:
    """Packed bits with popcounts before each block of eight words, and before each word within its block."""

    def __init__(self, packed: np.ndarray):
        whole = np.zeros(-(-(len(packed) + 1) // (8 * BLOCK_WORDS)) * 8 * BLOCK_WORDS, np.uint8)  # a byte more: rank at the end
        whole[: len(packed)] = packed
        self.words = whole.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK_WORDS).astype(np.int64)
        self.blocks = np.concatenate([[0], np.cumsum(counts.sum(axis=1))])
        self.inner = (np.cumsum(counts, axis=1) - counts).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word // BLOCK_WORDS] + self.inner.reshape(-1)[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the bit before which k bits are set."""
        block = np.searchsorted(self.blocks, k, side="right") - 1
        left = k - self.blocks[block]
        word = (self.inner[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inner[block, word]
        word = block * BLOCK_WORDS + word
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1) == (left + 1)[:, None]).argmax(axis=1)


def boundaries(data: np.ndarray, starts: np.ndarray) -> tuple[Bitvector, Bitvector]:
    """(units, code points): where they begin in the bytes of texts that begin at `starts`, in order."""
    units, points, last = [], [], 0
    for i in range(0, len(data), STEP):
        kind = CLASS[data[i : i + STEP]]
        before = np.concatenate([[last], kind[:-1]])
        point = kind != 2
        unit = point & ((kind != 1) | (before != 1))
        a, b = np.searchsorted(starts, [i, i + len(kind)])
        unit[starts[a:b] - i] = True  # a unit never spans two texts
        last = kind[-1]
        units.append(np.packbits(unit, bitorder="little"))
        points.append(np.packbits(point, bitorder="little"))
    none = np.zeros(0, np.uint8)
    return Bitvector(np.concatenate([none, *units])), Bitvector(np.concatenate([none, *points]))


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, byte where the middle begins, byte where the suffix begins, code points of prefix, of middle) of each text."""
    units, points = boundaries(data, starts[ends > starts])
    first = units.rank(starts)
    n = units.rank(ends) - first
    one, two = h1 % (n + 1), h2 % (n + 1)
    at = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        place, inside = ends.copy(), k < n
        place[inside] = units.select((first + k)[inside])
        at.append(place)
    ranks = [points.rank(x) for x in (starts, *at)]
    return n, at[0], at[1], ranks[1] - ranks[0], ranks[2] - ranks[1]


def draws(key: Column | str, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first groups of eight hex digits of sha256("seed:key"). A null key is empty."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


OUT = T.StructType([T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, change_percent: int = 90, suffix_first_percent: int = 20) -> DataFrame:
    """Add (n_units, form, prefix_chars, middle_chars, output) to each row.

    Units are runs of A-Z and a-z, or any other single code point. Two draws of the key cut the text between units; a third
    leaves some texts plain; a fourth puts the suffix first ("spm") in some and the prefix first ("psm") in the rest. Empty
    texts and texts that hold a mark are plain. A null text counts as empty. Rows alike in key and text get the same
    output; a null key draws as an empty one. Texts of any length are handled whole; clashing columns are replaced; an
    empty table stays empty.
    """
    df = without(df, *(f.name for f in OUT.fields))
    ship(df.sparkSession)
    drawn = [f"__draw{i}" for i in range(4)]
    fields, at = df.schema.fields, df.columns.index(text)
    fed = df.select("*", *[c.alias(name) for c, name in zip(draws(key, seed), drawn, strict=True)])
    mark = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))).encode())
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            sizes = np.diff(_offsets(column))
            for part in slices([range(x) for x in sizes.tolist()], SLICE_BYTES):
                yield examples(batch.slice(part.start, part.stop - part.start), column.slice(part.start, part.stop - part.start))

    def examples(batch: pa.RecordBatch, column: pa.LargeBinaryArray) -> pa.RecordBatch:
        offsets = _offsets(column)
        raw = column.buffers()[2]
        view = memoryview(raw if raw is not None else b"")[int(offsets[0]) : int(offsets[-1])]
        offsets = offsets - offsets[0]
        starts, ends = offsets[:-1], offsets[1:]
        h1, h2, h3, h4 = (batch.column(len(fields) + i).to_numpy() for i in range(4))
        n, one, two, before, middle = cuts(np.frombuffer(view, np.uint8), starts, ends, h1, h2)
        marked = np.fromiter((mark.search(view, a, b) is not None for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), bool, len(n))
        plain = (n == 0) | marked | (h3 % 100 >= change_percent)
        suffix_first = h4 % 100 < suffix_first_percent
        forms, made = [], []
        for a, x, y, b, same, flip in zip(starts.tolist(), one.tolist(), two.tolist(), ends.tolist(), plain.tolist(), suffix_first.tolist(), strict=True):
            forms.append("plain" if same else "spm" if flip else "psm")
            parts = (view[a:b],) if same else (s, view[y:b], p, view[a:x], m, view[x:y]) if flip else (p, view[a:x], s, view[y:b], m, view[x:y])
            made.append(b"".join(parts))
        new = [pa.array(n), pa.array(forms), pa.array(before, mask=plain), pa.array(middle, mask=plain), pa.array(made, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *new], names=[f.name for f in [*fields, *OUT.fields]])

    return fed.mapInArrow(lean(run), T.StructType([*fields, *OUT.fields]))


def _offsets(column: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)


def restore(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """Add the text that an output was made of. It holds each mark once, for texts with a mark are left plain. Nulls stay null."""
    o, f = F.col(output), F.col(form)
    p, s, m = (F.instr(o, x) for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda at, mark, end: F.substring(o, at + len(mark), end - at - len(mark))
    end = F.length(o) + 1
    psm = F.concat(after(p, PREFIX, s), after(m, MIDDLE, end), after(s, SUFFIX, m))
    spm = F.concat(after(p, PREFIX, m), after(m, MIDDLE, end), after(s, SUFFIX, p))
    return without(df, out).withColumn(out, F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o))
