"""Benchmark decontamination with an FM-index over words, one index per training shard.

A shard's words become symbols: those of the phrases get numbers, all others are one separator. The index has the
Burrows-Wheeler transform of the shard in a wavelet matrix, and every SAMPLE-th suffix position. Phrases are searched
backward through wavelet ranks, all at once; occurrences are located by walking back to sampled positions; their word
ranges are merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, lean, ship, without

#: Words of a shard at most, unless one text has more.
SHARD_WORDS = 700_000
#: Every such position of a shard keeps its suffix position.
SAMPLE = 8
#: Bytes of phrase texts that one pass broadcasts, about; more phrases take more passes. Windows are under a byte's half as many
#: and 13 numbers of four bytes each, so that a pass holds some 25 bytes for each byte of phrases at most.
PASS_BYTES = 4_000_000
#: Occurrences that are located at once.
LOCATE = 1 << 20

_table = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _table[_c] = _c
for _c in range(26):
    _table[65 + _c] = 97 + _c
WORD_TABLE = bytes(_table)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of characters beyond ASCII. Null has none."""
    return text.translate(WORD_TABLE).split() if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; after the first rounds only groups of equal rank are sorted again."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable").astype(np.int64)
    s = seq[sa]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    # A suffix's rank is the place of its group's first suffix.
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    slot = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(slot):
        at = sa[slot]
        ahead = at + step
        nxt = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        own = rank[at]
        order = np.lexsort((nxt, own))
        at, nxt, own = at[order], nxt[order], own[order]
        sa[slot] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[at] = slot[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slot = slot[~(new & np.append(new[1:], True))]
        step *= 2
    return sa


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.ones = int(counts.sum())
        self.zeros = n - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet matrix: a level per bit of the symbols, the highest first, each sorted stably by that bit."""

    def __init__(self, symbols: np.ndarray):
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[Bits] = []
        for k in range(self.depth - 1, -1, -1):
            bits = (symbols >> k) & 1 == 1
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is before each position."""
        start, i = np.zeros_like(i), i.copy()
        for k, level in enumerate(self.levels):
            up = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = level.rank(start), level.rank(i)
            start = np.where(up, level.zeros + a, start - a)
            i = np.where(up, level.zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it is before it."""
        start, i = np.zeros_like(i), i.copy()
        symbol = np.zeros_like(i)
        for level in self.levels:
            up = level.at(i)
            a, b = level.rank(start), level.rank(i)
            start = np.where(up, level.zeros + a, start - a)
            i = np.where(up, level.zeros + b, i - b)
            symbol = symbol << 1 | up
        return symbol, i - start


class FMIndex:
    """Index of a sequence of symbols from 1 up, with 0 as separator. Inside, symbols are one more, and 0 ends the text."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        seq = np.append(seq + 1, 0)
        n = len(seq)
        sa = suffix_array(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=alphabet + 2))])
        bwt = seq[sa - 1]  # the sequence counts as a ring
        self.wavelet = Wavelet(bwt)
        sampled = sa % SAMPLE == 0
        self.marks, self.samples, self.n = Bits(sampled), sa[sampled], n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the phrases: rows of symbols, right-aligned."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(width - 1, -1, -1):
            live = live[(hi[live] > lo[live]) & (lengths[live] >= width - k)]
            if not len(live):
                break
            c = phrases[live, k] + 1
            known = c >> self.wavelet.depth == 0
            base = self.first[c]
            a, b = self.wavelet.rank(c, lo[live]), self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = np.where(known, base + a, 0), np.where(known, base + b, 0)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back until a sampled one."""
        out, todo, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.marks.at(at)
            if done.any():
                out[todo[done]] = self.samples[self.marks.rank(at[done])] + steps
                todo, at = todo[~done], at[~done]
                if not len(todo):
                    break
            c, r = self.wavelet.access_rank(at)
            at, steps = self.first[c] + r, steps + 1
        return out


class Phrases:
    """Windows of the items' words: `width` in a row; an item of fewer, but not none, is one window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        parts, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for name, ws in items:
            if not ws:
                continue
            seq = np.fromiter((self.symbols.setdefault(w, len(self.symbols) + 1) for w in ws), np.int32, len(ws))
            seq = np.concatenate([np.zeros(max(0, width - len(seq)), np.int32), seq])  # right-aligned
            parts.append(np.lib.stride_tricks.sliding_window_view(seq, width))
            owners.append(np.full(len(parts[-1]), number[name]))
        rows = np.ascontiguousarray(np.concatenate(parts))
        _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * width))).ravel(), return_index=True, return_inverse=True)
        self.windows = rows[first]
        self.lengths = (self.windows > 0).sum(axis=1)
        # The items that own each window, flat, for many-to-many look-ups.
        both = np.unique(which.ravel() * max(1, len(self.names)) + np.concatenate(owners))
        self.owner_flat = both % max(1, len(self.names))
        self.owner_at = np.searchsorted(both // max(1, len(self.names)), np.arange(len(first) + 1))


def symbols(text: bytes | None, p: Phrases) -> np.ndarray:
    """A text's words as the phrases' symbols, 0 for other words."""
    ws = words(text)
    return np.fromiter(map(p.symbols.get, ws, repeat(0)), np.int32, len(ws))


def shard_hits(docs: list[np.ndarray], p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the documents of a shard, as symbols: (start, end) of hit words in the shard's words, merged, and the (document, item) pairs
    with an occurrence, as document * number of items + item."""
    none = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    # A separator after each document; runs of separators count as one.
    ends = np.zeros(total + 1, bool)
    ends[bounds[1:]] = True
    word = np.arange(total)
    keep = (flat != 0) | (np.concatenate([[1], flat[:-1]]) != 0)
    gap = np.flatnonzero(ends[1:total]) + 1  # a document ends before this word
    seq, pos = flat[keep], word[keep]
    put = np.searchsorted(pos, gap)
    seq, pos = np.insert(seq, put, 0), np.insert(pos, put, -1)
    if not seq.any() or not len(p.windows):
        return *none[0], none[1]
    index = FMIndex(seq, len(p.symbols))
    lo, hi = index.search(p.windows, p.lengths)
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    delta = np.zeros(total + 1, np.int32)
    pairs: list[np.ndarray] = []
    before = np.concatenate([[0], np.cumsum(counts)])
    for s in range(0, int(before[-1]), LOCATE):
        k = np.arange(s, min(s + LOCATE, int(before[-1])))
        which = np.searchsorted(before, k, side="right") - 1
        window = found[which]
        at = pos[index.locate(lo[window] + k - before[which])]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + p.lengths[window], -1)
        doc = np.searchsorted(bounds, at, side="right") - 1
        dw = np.unique(doc * len(p.windows) + window)
        d, w = dw // len(p.windows), dw % len(p.windows)
        n = p.owner_at[w + 1] - p.owner_at[w]
        each = np.repeat(np.arange(len(w)), n)
        item = p.owner_flat[p.owner_at[w][each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
        pairs.append(np.unique(d[each] * len(p.names) + item))
    hit = np.cumsum(delta[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, end, np.unique(np.concatenate(pairs)) if pairs else none[1]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """Add to each row: n_words (long), hit_spans (array of [start, end) word ranges, merged), hit_items (sorted strings).

    Null and empty texts have no words; a text of any length is searched whole, and repeated rows are treated alike. Items that are null or have no words are never hit; rows of one item_id count as
    one item. Columns with the new names are replaced. Phrases are broadcast in passes of PASS_BYTES at most; each pass
    goes over all rows, and their spans are merged. An empty item table gives no hits, an empty table an empty result.
    """
    docs = without(docs, "n_words", "hit_spans", "hit_items")
    spark = docs.sparkSession
    ship(spark)
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0])
    passes = max(1, -(-size // PASS_BYTES))
    scratch, held = Scratch(spark) if passes > 1 else None, None
    for k in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k)
        docs = _find(docs, [(r.i, words(r.t.encode())) for r in part.toLocalIterator()], text, width, first=k == 0)
        if scratch is not None:
            docs = scratch.keep(docs, f"pass{k}")
            if held is not None:
                scratch.drop(held)
            held = docs
    return docs


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _find(docs: DataFrame, items: list[tuple[str, list[bytes]]], text: str, width: int, first: bool) -> DataFrame:
    added = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *added]) if first else docs.schema
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(items, width))

    def flush(held: list[pa.RecordBatch], parsed: list[np.ndarray], p: Phrases) -> Iterator[pa.RecordBatch]:
        start, end, pairs = shard_hits(parsed, p)
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in parsed])]).astype(np.int64)
        doc_of = np.searchsorted(bounds, start, side="right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        # Touching hits of neighbouring documents are one run of words: cut it at the documents' bounds.
        for a, b, d in zip(start.tolist(), end.tolist(), doc_of.tolist(), strict=True):
            while a < b:
                if bounds[d + 1] > a:
                    spans.setdefault(d, []).append((a - int(bounds[d]), min(b, int(bounds[d + 1])) - int(bounds[d])))
                a, d = max(a, int(bounds[d + 1])), d + 1
        named: dict[int, list[str]] = {}
        for d, i in zip((pairs // max(1, len(p.names))).tolist(), (pairs % max(1, len(p.names))).tolist(), strict=True):
            named.setdefault(d, []).append(p.names[i])
        base = 0
        for b in held:
            new_spans = [spans.get(base + i, []) for i in range(b.num_rows)]
            new_names = [named.get(base + i, []) for i in range(b.num_rows)]
            counts = [len(d) for d in parsed[base : base + b.num_rows]]
            base += b.num_rows
            old = b.columns
            if not first:
                *old, _, s0, n0 = old
                new_spans = [_merge([*((x["start"], x["end"]) for x in s), *t]) for s, t in zip(s0.to_pylist(), new_spans, strict=True)]
                new_names = [sorted({*x, *y}) for x, y in zip(n0.to_pylist(), new_names, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array(counts, pa.int64()), pa.array([[{"start": x, "end": y} for x, y in s] for s in new_spans], kind), pa.array(new_names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*old, *made], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        held: list[pa.RecordBatch] = []
        parsed: list[np.ndarray] = []
        count = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                ws = [symbols(t, p) for t in b.column(at).cast(pa.binary()).to_pylist()]
                n = sum(map(len, ws))
                if held and count + n > SHARD_WORDS:
                    yield from flush(held, parsed, p)
                    held, parsed, count = [], [], 0
                held.append(b)
                parsed += ws
                count += n
        if held:
            yield from flush(held, parsed, p)

    return docs.mapInArrow(lean(run), schema)


def verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Add n_hit (hit words), n_items and contaminated: n_hit > 0 and share * n_hit >= n_words."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return without(found, "n_hit", "n_items", "contaminated").withColumn("n_hit", n_hit).withColumn("n_items", F.size("hit_items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))

