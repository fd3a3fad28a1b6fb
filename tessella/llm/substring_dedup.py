"""Substring de-duplication by recompression of word sequences.

Words get 64-bit names. Runs of one word are named first; then each round splits all symbols into left and right ones by
a bit of their names and replaces each pair of a left and a right symbol by a new symbol. A name is a hash of what the
symbol stands for, so naming is global: every executor gives equal strings equal names without an exchange of names.
Whether two symbols merge depends on them alone, so equal word sequences hold equal interior symbols. For each symbol the
parser keeps the range of words that settled it. A symbol whose range lies within a window occurs in every equal window
at the same place, and the window's anchor is picked among its highest such symbols: equal windows have equal anchors.

Spark then counts the anchors. Those that occur once end there. Occurrences of a shared anchor are grouped by the words
around them that their windows cover: groups of two or more are repeats as a whole. The rest, at the edges of repeats,
are settled by a comparison of their windows, in which one member stands for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, lean, ship, without

#: Words parsed at once, unless one text has more.
PARSE_WORDS = 120_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def names(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


class Rolling:
    """Hashes of word ranges: sums of names times powers of an odd base, brought to the range's start."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h)
        up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(base)) * np.multiply.accumulate(up)[:-1])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))


BASES = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Symbols:
    """Symbols of one level: name, first word, end, and the range [low, high) of words that settled each."""

    def __init__(self, name, start, end, low, high):
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high

    def pick(self, at) -> Symbols:
        return Symbols(self.name[at], self.start[at], self.end[at], self.low[at], self.high[at])


def runs(h: np.ndarray, doc: np.ndarray, cap: int) -> Symbols:
    """Name the runs of one word; longer ones than cap stay single words. A run is settled by the words beside it."""
    n = len(h)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    long = end - start > cap
    if long.any():  # each of its words is a symbol, settled by the whole run
        size = np.where(long, end - start, 1)
        owner = np.repeat(np.arange(len(start)), size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        s, e = np.where(long[owner], start[owner] + inner, start[owner]), np.where(long[owner], start[owner] + inner + 1, end[owner])
        low, high = start[owner] - 1, end[owner] + 1
    else:
        s, e, low, high = start, end, start - 1, end + 1
    count = (e - s).astype(np.uint64)
    name = np.where(count == 1, h[s], mix(h[s] + count * M1))
    return Symbols(name, s, e, low, high)


def pairs(x: Symbols, doc: np.ndarray, level: int, cap: int) -> Symbols:
    """One round: name the pairs of a left and a right symbol. A left symbol left alone is settled by its right neighbour,
    a right one by its left neighbour; one at the document's edge by a range that reaches outside."""
    n = len(x.name)
    left = (mix(x.name + np.uint64(level * int(M1) % 2**64)) >> np.uint64(40)) & np.uint64(1) == 1
    d = doc[x.start]
    same = d[1:] == d[:-1]
    merge = np.zeros(n, bool)
    merge[:-1] = left[:-1] & ~left[1:] & same & (x.end[1:] - x.start[:-1] <= cap)
    second = np.concatenate([[False], merge[:-1]])
    low, high = x.low.copy(), x.high.copy()
    i = np.flatnonzero(merge)
    alone = ~merge & ~second
    a = np.flatnonzero(alone & left)
    inside = np.zeros(len(a), bool)
    inside[a < n - 1] = same[a[a < n - 1]]
    nxt = np.minimum(a + 1, n - 1)
    high[a] = np.maximum(high[a], np.where(inside, x.high[nxt], x.end[a] + 1))
    b = np.flatnonzero(alone & ~left)
    inside = np.zeros(len(b), bool)
    inside[b > 0] = same[b[b > 0] - 1]
    prv = np.maximum(b - 1, 0)
    low[b] = np.minimum(low[b], np.where(inside, x.low[prv], x.start[b] - 1))
    name, end = x.name.copy(), x.end.copy()
    name[i] = mix(x.name[i] * M1 + mix(x.name[i + 1] ^ M2) + np.uint64(level))
    end[i] = x.end[i + 1]
    low[i], high[i] = np.minimum(x.low[i], x.low[i + 1]), np.maximum(x.high[i], x.high[i + 1])
    keep = ~second
    return Symbols(name[keep], x.start[keep], end[keep], low[keep], high[keep])


def anchors(h: np.ndarray, sizes: np.ndarray, window: int, rounds: int, cap: int) -> tuple[np.ndarray, ...]:
    """(name, hash of words, first word, end) of the anchor occurrences of a batch of documents, in order.

    Consecutive windows with one anchor are one occurrence; [first word, end) are the words that they cover.
    """
    total = len(h)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    w = np.arange(total)
    w = w[w + window <= ends[doc]]  # where windows start
    if not len(w):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    words = Symbols(h, np.arange(total), np.arange(total) + 1, np.arange(total), np.arange(total) + 1)
    levels = [words, runs(h, doc, cap)]
    for k in range(rounds):
        levels.append(pairs(levels[-1], doc, k, cap))
    chosen_level, chosen, name = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), np.uint64)
    todo = np.arange(len(w))
    for k in range(len(levels) - 1, -1, -1):
        x, at = levels[k], w[todo]
        f = np.searchsorted(x.low, at)
        t = np.searchsorted(x.high, at + window, side="right") - 1
        good = np.flatnonzero(f <= t)
        f, t = f[good], t[good]
        # The longest, for long strings are seldom shared by chance; then by a hash of the name.
        longest = np.uint64(255) - np.minimum(x.end - x.start, 255).astype(np.uint64)
        key = longest << np.uint64(56) | mix(x.name ^ M3) >> np.uint64(8)
        best, arg = key[f] if len(f) else np.zeros(0, np.uint64), f.copy()
        more, step = np.flatnonzero(t > f), 1
        while len(more):
            c = f[more] + step
            lower = key[c] < best[more]
            hit = more[lower]
            best[hit], arg[hit] = key[c[lower]], c[lower]
            step += 1
            more = more[t[more] >= f[more] + step]
        who = todo[good]
        chosen_level[who], chosen[who], name[who] = k, arg, x.name[arg]
        todo = np.delete(todo, good)
        if not len(todo):
            break
    new = np.concatenate([[True], (w[1:] != w[:-1] + 1) | (doc[w[1:]] != doc[w[:-1]]) | (chosen[1:] != chosen[:-1]) | (chosen_level[1:] != chosen_level[:-1])])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(w)) - 1
    lo, hi = w[s], w[e] + window
    return mix(name[s] + chosen_level[s].astype(np.uint64)), Rolling(h, BASES[0]).of(lo, hi), lo, hi


def _groups(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    start = count = 0
    for i, t in enumerate(texts):
        if i > start and count + len(t) > PARSE_WORDS:
            yield start, i
            start, count = i, 0
        count += len(t)
    if texts:
        yield start, len(texts)


def _split(column: pa.Array) -> list[list[bytes]]:
    return [t.split() if t else [] for t in column.cast(pa.binary()).to_pylist()]


#: Rows sent to a worker's parser at once.
ROWS = 256
OCCURRENCE = "array<struct<name:long,span:long,lo:int,hi:int>>"


def _parse(docs: DataFrame, window: int, rounds: int, cap: int) -> DataFrame:
    """(k, h, occ): a document's key, its text's hash, and its anchor occurrences."""
    kind = pa.list_(pa.struct([("name", pa.int64()), ("span", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(0, whole.num_rows, ROWS):
                b = whole.slice(r, ROWS)
                texts = _split(b.column(2))
                for s, e in _groups(texts):
                    sizes = np.array([len(t) for t in texts[s:e]], np.int64)
                    h = names([x for t in texts[s:e] for x in t])
                    name, span, lo, hi = anchors(h, sizes, window, rounds, cap)
                    base = np.cumsum(sizes) - sizes
                    owner = np.searchsorted(np.cumsum(sizes), lo, side="right")
                    flat = pa.StructArray.from_arrays([pa.array(name.view(np.int64)), pa.array(span.view(np.int64)), pa.array((lo - base[owner]).astype(np.int32)), pa.array((hi - base[owner]).astype(np.int32))], fields=list(kind.value_type))
                    offsets = np.searchsorted(owner, np.arange(e - s + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.ListArray.from_arrays(pa.array(offsets), flat, type=kind)], names=["k", "h", "occ"])

    schema = T.StructType([docs.schema["k"], docs.schema["h"], T.StructField("occ", T._parse_datatype_string(OCCURRENCE))])
    return docs.select("k", "h", "text").mapInArrow(lean(run), schema)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(w1, w2, k, h, at, weight) of each window of the listed word ranges."""
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), rows.schema["k"], rows.schema["h"], T.StructField("at", T.IntegerType()), T.StructField("weight", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(0, whole.num_rows, 64):
                b = whole.slice(r, 64)
                texts = _split(b.column(2))
                sizes = np.array([len(t) for t in texts], np.int64)
                base = np.cumsum(sizes) - sizes
                h = names([x for t in texts for x in t])
                todo = b.column(3)
                flat, owner = todo.flatten(), np.repeat(np.arange(len(texts)), todo.value_lengths().to_numpy())
                lo, hi, weight = (flat.field(i).to_numpy() for i in range(3))
                n = (hi - lo - window + 1).astype(np.int64)
                each = np.repeat(np.arange(len(lo)), n)
                at = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                a = base[owner[each]] + at
                w1, w2 = (Rolling(h, x).of(a, a + window).view(np.int64) for x in BASES)
                row = pa.array(owner[each])
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(0).take(row), b.column(1).take(row), pa.array(at.astype(np.int32)), pa.array(weight[each])], names=schema.fieldNames())

    return rows.mapInArrow(lean(run), schema)


def repeats(scratch: Scratch, docs: DataFrame, window: int, rounds: int, cap: int) -> DataFrame:
    """(k, h, spans): the word ranges [lo, hi) covered by windows whose words also start elsewhere."""
    table = scratch.table
    parsed = table(_parse(docs, window, rounds, cap), "anchors")
    occ = parsed.select("k", "h", F.explode("occ").alias("o")).select("k", "h", "o.*")
    # Count anchors; sums go before the shuffle. Counts are tables before rows are joined to them: with nothing else between
    # a shuffle and a join, the planner can split the join where a key is hot.
    shared = table(occ.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "shared")
    cand = table(occ.join(shared, "name"), "candidates")
    scratch.drop(parsed, shared)
    groups = table(cand.groupBy("name", "span").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "lo", "hi")).alias("one")), "groups")
    repeated = table(groups.where("n > 1").select("name", "span"), "repeated")
    whole = cand.join(repeated, ["name", "span"]).select("k", "h", "lo", "hi")
    mixed = groups.groupBy("name").agg(F.count("*").alias("g"), F.count_if(F.col("n") == 1).alias("singles")).where("g > 1 and singles > 0").select("name")
    mixed = table(mixed, "mixed")
    edge = groups.join(mixed, "name").select("one.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    todo = edge.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("todo"))
    d = docs.select("k", "h", "text").alias("d")
    t = todo.alias("t")
    with_text = d.join(t, F.col("d.k").eqNullSafe(F.col("t.k")) & (F.col("d.h") == F.col("t.h"))).select("d.k", "d.h", "d.text", "t.todo")
    # A row that is there twice has groups of two at least: its windows come twice, with the weight of a group.
    wins = table(_windows(with_text, window), "windows")
    scratch.drop(groups, mixed)
    twice = table(wins.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    fine = wins.where("weight = 1").join(twice, ["w1", "w2"]).select("k", "h", F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    # Rows alike in key and text have the same spans: these meet before and in the shuffle, so a document's spans are as many as its
    # windows at most, however often it is there.
    spans = table(whole.unionByName(fine).distinct(), "ranges")
    return scratch.keep(spans.groupBy("k", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def _remove(rows: DataFrame, names: list[str], text: int, out: list[str]) -> DataFrame:
    """rows: columns to be called `names`, of which number `text` is the text, then the spans."""
    n = len(names)
    kept = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(names, rows.schema.fields[:n], strict=True)]
    schema = T.StructType([*kept, T.StructField(out[0], T.LongType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.StringType())])

    def one(words: list[bytes], lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, bytes]:
        if not len(lo):
            return len(words), 0, b" ".join(words)
        delta = np.bincount(lo, minlength=len(words) + 1) - np.bincount(hi, minlength=len(words) + 1)
        gone = np.cumsum(delta[:-1]) > 0
        return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(0, whole.num_rows, ROWS):
                b = whole.slice(r, ROWS)
                spans = b.column(n)
                flat, ends = spans.flatten(), np.cumsum(spans.value_lengths().fill_null(0).to_numpy())
                lo, hi = (flat.field(i).to_numpy() for i in range(2))
                got = [one(w, lo[e - m : e], hi[e - m : e]) for w, e, m in zip(_split(b.column(text)), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)]
                made = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema.fieldNames())

    return rows.mapInArrow(lean(run), schema)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, rounds: int = 6, cap: int = 24) -> DataFrame:
    """Add n_words, n_removed (longs) and kept_text: the text's words, runs of bytes other than ASCII white space, without
    those covered by a window of `window` words whose sequence also starts anywhere else, in any row; joined by a space.

    Windows are judged on the input. Null and empty texts have no words and keep "". Rows repeated in key and text count
    as occurrences of their own, so they repeat each other. Null keys are allowed; texts of any length are read whole. Columns
    with the new names are replaced, all others stay, whatever their names. An empty table gives an empty result.
    """
    df = without(df, "n_words", "n_removed", "kept_text")
    ship(df.sparkSession)
    names, inner = df.columns, [f"__{i}" for i in range(len(df.columns))]
    at, df = names.index(text), df.toDF(*inner)
    h = F.xxhash64(F.coalesce(F.col(inner[at]), F.lit("")))
    k = F.col(inner[names.index(key)])
    with Scratch(df.sparkSession) as scratch:
        found = repeats(scratch, df.select(k.alias("k"), h.alias("h"), F.col(inner[at]).alias("text")), window, rounds, cap)
    j = df.withColumn("own", h).join(found, k.eqNullSafe(F.col("k")) & (F.col("own") == F.col("h")), "left")
    return _remove(j.select(*inner, "spans"), names, at, ["n_words", "n_removed", "kept_text"])
