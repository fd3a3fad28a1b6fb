"""Near-duplicates by b-bit MinHash: banded candidates, estimates from packed low bits, links confirmed on full shingle sets.

A text's set of word shingles has one minimum under each of BANDS * ROWS hashes. Whole minima are used once, for a key of each
band; then only their low BITS bits stay, as packed bit planes. Texts with equal sets are one class, and classes that share a band's
key are candidates. Of these, the number of equal low parts, a popcount, gives an estimate of their similarity once it is
corrected for parts that are equal by chance; far estimates go, and the rest is confirmed on the sets themselves.

Large groups are not compared pair by pair. First each member of a bucket is held against the bucket's least class, and what is
linked is one component. Only buckets that still hold two components are searched further: there, members with a candidate
in another component meet in blocks, sets and all, and a block stops once its members are one component.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, lean, ship
from tessella.llm.components import components

#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: all but 3e-8 of the pairs at 0.85.
BANDS, ROWS = 30, 5
MINIMA = BANDS * ROWS
#: Low bits that are kept of each minimum; words of 64 bits of each bit plane.
BITS = 4
WORDS = -(-MINIMA // 64)
#: How rarely an estimate may turn down a pair that is similar enough.
MISS = 1e-9
#: Members of a bucket, and shingles of theirs, that meet at once; a larger bucket is dealt out as pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 4_000_000
#: Bytes of a text split at once, and shingles hashed at once.
PIECE, STEP = 4_000_000, 512
SPACE = re.compile(rb"[ \t\n\x0b\f\r]")


def _odd(n: int, seed: int) -> np.ndarray:
    """n 64-bit numbers from a counter, well spread."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


TIMES, PLUS, FOLD = _odd(MINIMA, 1)[:, None], _odd(MINIMA, 2)[:, None], _odd(ROWS, 3)


def shingles(text: bytes, words: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words the whole sequence is one, without words none."""
    from xxhash import xxh64_intdigest

    found, parts, at = [], [], 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        parts += text[at:end].lower().split()
        at = end
        n = len(parts) - words + 1
        if n > 0:
            whole = b" ".join(parts)
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])[:n]
            hashes = map(xxh64_intdigest, (whole[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)))
            found.append(np.fromiter(hashes, np.uint64, n))
            parts = parts[n:]
    if not found:
        return np.array([xxh64_intdigest(b" ".join(parts))] if parts else [], np.uint64)
    return np.unique(np.concatenate(found))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), STEP):
        np.minimum(low, (hashes[i : i + STEP] * TIMES + PLUS).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys from (n, MINIMA) minima."""
    x = (low.reshape(-1, BANDS, ROWS) * FOLD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def pack(low: np.ndarray) -> np.ndarray:
    """(n, BITS * WORDS) bit planes of the low bits of (n, MINIMA) minima."""
    planes = np.zeros((len(low), BITS, WORDS * 64), np.uint8)
    for p in range(BITS):
        planes[:, p, :MINIMA] = (low >> np.uint64(p)) & np.uint64(1)
    return np.packbits(planes, axis=2, bitorder="little").view("<u8").reshape(len(low), BITS * WORDS)


def equal_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many low parts are equal, for packed signatures that broadcast against each other."""
    differ = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1], np.uint16)
    for w in range(WORDS):
        x = a[..., w] ^ b[..., w]
        for p in range(1, BITS):
            x = x | (a[..., p * WORDS + w] ^ b[..., p * WORDS + w])
        differ += np.bitwise_count(x)
    return MINIMA - differ


def similarity(equal: float) -> float:
    """The estimate of a similarity: parts that are equal by chance, one of 2 ** BITS, taken out."""
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def least_equal(percent: int) -> int:
    """Equal parts of which a pair of that similarity has fewer with probability MISS at most."""
    chance = 2.0**-BITS
    p = percent / 100 * (1 - chance) + chance
    if p >= 1:
        return MINIMA
    below, m = 0.0, 0
    while True:
        below += math.comb(MINIMA, m) * p**m * (1 - p) ** (MINIMA - m)
        if below > MISS:
            return m
        m += 1


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(rows.reshape(-1).view(np.int64)))


def sketches(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """Replace a text column by (n, id, low, bands): size of the shingle set, a 128-bit hash of it, packed low bits, band keys.

    Null texts and texts without words have n 0 and empty lists. Very long texts are split by pieces and hashed whole.
    """
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in rest]).add("n", T.LongType()).add("id", T.BinaryType()).add("low", T.ArrayType(T.LongType())).add("bands", T.ArrayType(T.LongType()))
    at, keep = df.columns.index(text), [df.columns.index(c) for c in rest]
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            sizes, ids, lows = [], [], np.zeros((b.num_rows, MINIMA), np.uint64)
            for i, t in enumerate(b.column(at).cast(pa.large_binary())):
                s = shingles(t.as_py() or b"", words)
                sizes.append(len(s))
                ids.append(xxh3_128_digest(s.tobytes()))
                if len(s):
                    lows[i] = minima(s)
            made = [pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(pack(lows)), _lists(band_keys(lows))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *made], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, n, set) of the wanted classes: one document of each is read again, found by its key and its text's hash. So copies of a text
    are dealt out by their keys, and only rows alike in both meet."""
    one = wanted.select(F.col("pick.key").alias("k"), F.col("pick.h").alias("t"))
    texts = docs.join(one, (F.col("h") == F.col("t")) & F.col("key").eqNullSafe(F.col("k")), "left_semi").groupBy("h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            for t in b.column(1).cast(pa.large_binary()):
                s = shingles(t.as_py() or b"", words)
                yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s.tobytes())], pa.binary()), pa.array([len(s)]), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], names=["id", "n", "set"])

    made = texts.select("h", "text").mapInArrow(lean(run), "id binary, n long, set array<long>")
    return made.join(wanted.select("id").distinct(), "id", "left_semi")


def _tasks(batches: Iterator[pa.RecordBatch], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one task (first column; rows come sorted by it), whole tasks of at least `most` rows together at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= most:
            task = b.column(0).to_numpy()
            other = np.flatnonzero(task != held[-1].column(0)[-1].as_py())
            cut = int(other[0]) if len(other) else len(task)
            held.append(b.slice(0, cut))
            if cut < len(task):
                yield from run(pa.Table.from_batches(held))
                held, rows = [b.slice(cut)], len(task) - cut
            continue
        held.append(b)
        rows += b.num_rows
    if held:
        yield from run(pa.Table.from_batches(held))


def _runs(task: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True)


def _flagged(table: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """(task, side, id, component) of members that have a candidate in another component whose first common band is this one."""
    task, side, band = (table.column(c).to_numpy() for c in ("task", "side", "band"))
    group = np.unique(np.array(table.column("component").to_pylist(), object), return_inverse=True)[1]
    matrix = lambda c, k: table.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, k)
    low, keys = matrix("low", BITS * WORDS), matrix("bands", BANDS)
    hit = np.zeros(len(task), bool)
    for s, e in _runs(task):
        for i in range(s, e, 64):
            j = min(i + 64, e)
            near = (equal_parts(low[i:j, None], low[None, s:e]) >= least) & (group[i:j, None] != group[None, s:e])
            near &= (side[i:j, None] < 0) | (side[i:j, None] != side[None, s:e])
            a, b = np.nonzero(near)
            first = (keys[i + a] == keys[s + b]).argmax(axis=1) == band[s]
            hit[i + a[first]] = hit[s + b[first]] = True
    if hit.any():
        yield from table.select(["task", "side", "id", "component"]).filter(pa.array(hit)).to_batches()


def _joined(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components of a task's members, enough to join those that their sets link."""
    task = table.column("task").to_numpy()
    names = table.column("component").to_pylist()
    groups = np.unique(np.array(names, object), return_inverse=True)[1]
    sets = table.column("set").combine_chunks()
    offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    for s, e in _runs(task):
        pairs = _links(flat[offsets[s] : offsets[e]], np.diff(offsets[s : e + 1]), groups[s:e], percent)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([names[s + i] for i, _ in pairs], pa.binary()), pa.array([names[s + j] for _, j in pairs], pa.binary())], names=["a", "b"])


def _links(flat: np.ndarray, sizes: np.ndarray, groups: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs that join the groups of sets, by exact sizes of intersections: each set's shingles call up the sets that hold them."""
    n = len(sizes)
    _, value = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(value, kind="stable")
    holders, begins = owner[order], np.concatenate([[0], np.cumsum(np.bincount(value))])
    ends = np.cumsum(sizes)
    label, out = groups.copy(), []
    for i in range(n):
        if (label == label[0]).all():
            break
        mine = value[ends[i] - sizes[i] : ends[i]]
        counts = np.zeros(n, np.int64)
        for k in range(0, len(mine), 4096):
            a, b = begins[mine[k : k + 4096]], begins[mine[k : k + 4096] + 1]
            spread = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
            counts += np.bincount(holders[spread], minlength=n)
        for j in np.flatnonzero(100 * counts >= percent * (sizes + sizes[i] - counts)).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and low bits allow the similarity."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("low").alias(f"low{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    differ = " + ".join("bit_count(" + " | ".join(f"(lowa[{p * WORDS + w}] ^ lowb[{p * WORDS + w}])" for p in range(BITS)) + ")" for w in range(WORDS))
    return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {MINIMA} - ({differ}) >= {least_equal(percent)}").select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the full sets link."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("set").alias(f"set{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("both", F.size(F.array_intersect("seta", "setb")).cast("long"))
    return both.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component): the size of each row's shingle set and the smallest key reachable by links, itself included.

    Rows link where 100 * intersection >= percent * union of their shingle sets. Texts are lower-cased in A-Z; words are runs of
    characters other than ASCII white space. Null texts and texts without words have an empty set and link with nothing.
    Rows are told apart by their sets, so repeated rows and copies are one class; null keys count in no minimum, and a
    component of null keys alone is null. Very long texts are read whole; other columns are not looked at; an empty table gives
    an empty result. `percent` below 70 would need more bands.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
        marked = scratch.keep(sketches(docs, "text", words), "sketches")
        classes = scratch.table(marked.where("n > 0").groupBy("id").agg(F.min("key").alias("owner"), F.first("n").alias("n"), F.min(F.struct("key", "h")).alias("pick"), F.first("low").alias("low"), F.first("bands").alias("bands")), "classes")
        links, members, sets = _star_links(scratch, docs, classes, words, percent)
        stars = components(links, "a", "b")
        more = _other_links(scratch, docs, classes, members, sets, stars, words, percent)
        owned = classes.select("id", "owner").join(stars.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        if more is not None:  # links between components: a far smaller graph
            joined = components(more, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
            owned = owned.join(joined, "component", "left").select("id", "owner", F.coalesce("whole", "component").alias("component"))
        owned = scratch.table(owned, "owners")
        least = owned.groupBy("component").agg(F.min("owner").alias("least"))
        labelled = scratch.keep(owned.join(least, "component").select("id", "least"), "labelled")
    out = marked.select("key", "n", "id").join(labelled, "id", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component"))


def _star_links(scratch: Scratch, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of classes with the least class of a bucket that they are in; the members of all buckets; the sets that were looked up."""
    dealt = classes.select("id", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = scratch.table(dealt.groupBy("bucket", "band").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = scratch.table(dealt.join(buckets, ["bucket", "band"]).select("bucket", "band", "id", "n", "least"), "members")
    pairs = members.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.table(_estimated(pairs, classes, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes.select("id", "pick"), "id")
    sets = scratch.table(_sets(docs, wanted, words), "sets")
    return scratch.table(_confirmed(pairs, sets, percent), "links"), members, sets


def _other_links(scratch: Scratch, docs: DataFrame, classes: DataFrame, members: DataFrame, sets: DataFrame, stars: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) between components of stars that share a bucket, or None where there are none to look for."""
    spark = docs.sparkSession
    told = scratch.table(members.join(stars.select(F.col("node").alias("id"), "component"), "id", "left").select("bucket", "band", "id", "n", F.coalesce("component", "id").alias("component")), "told")
    mixed = told.groupBy("bucket", "band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES).alias("blocks")).where("low <> high")
    mixed = scratch.table(mixed.select("bucket", "band", F.ceil("blocks").cast("int").alias("parts")), "mixed")
    if mixed.first() is None:
        return None
    here = told.join(mixed, ["bucket", "band"]).withColumn("part", F.expr("cast(pmod(xxhash64(id, 7), parts) as int)"))
    dealt = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(
        F.xxhash64("bucket", "band", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        F.when(F.col("part") == F.col("other"), -1).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"), "band", "id", "component",
    )
    fed = scratch.table(dealt.join(classes.select("id", "low", "bands"), "id").select("task", "side", "band", "component", "low", "bands", "id"), "blocks")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fed.count() // (8 * BLOCK)))
    least = least_equal(percent)
    flagged = fed.repartition(n, "task").sortWithinPartitions("task").mapInArrow(lean(lambda bs: _tasks(bs, lambda t: _flagged(t, least), BLOCK)), "task long, side int, id binary, component binary")
    flagged = scratch.table(flagged, "flagged")
    if flagged.first() is None:
        return None
    fresh = flagged.select("id").distinct().join(sets.select("id"), "id", "left_anti").join(classes.select("id", "pick"), "id")
    fresh = scratch.table(_sets(docs, fresh, words), "more_sets")
    whole = flagged.join(sets.select("id", "set").unionByName(fresh.select("id", "set")), "id").select("task", "component", "set")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-flagged.count() // (8 * BLOCK)))
    found = whole.repartition(n, "task").sortWithinPartitions("task").mapInArrow(lean(lambda bs: _tasks(bs, lambda t: _joined(t, percent), 1)), "a binary, b binary")
    return scratch.table(found, "more_links")
