"""SimHash near-duplicates by a binary trie self-join.

Fingerprints stand in a binary trie. The join goes down the trie with pairs of nodes, adds up differing bits, and drops
a pair once they exceed the error budget. To spread it over tasks it runs once for each of `errors + 1` rotations: two
fingerprints with at most `errors` differing bits agree in one of `errors + 1` blocks of bits, so in that rotation the
budget of the leading block is zero and its subtries are joined apart from each other. A pair is kept in the first such
rotation only. Copies of a text and equal fingerprints meet before the join; each task returns a spanning forest of its
links, which keeps every component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, lean, ship, without
from tessella.llm.components import components

BITS = 64
#: A leading block of more fingerprints than this is dealt out by its next bits, as many as make parts of this size.
BLOCK_ROWS = 50_000
#: Next bits at most.
MOST_BITS = 12
#: Rows that a task loads, about.
TASK_ROWS = 400_000
#: Node pairs that a task expands at once.
FRONTIER = 1 << 20


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text (UTF-8): see fingerprints()."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    whole = b" ".join(parts)
    if n == 1:
        return xxh64_intdigest(whole, seed)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1)[:n].tolist()
    hashes = np.fromiter((xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 4096):
        block = hashes[i : i + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3, seed: int = 42) -> DataFrame:
    """Add the fingerprint as a long (the unsigned 64 bits as two's complement).

    Texts are lower-cased in A-Z; words are runs of bytes other than ASCII white space. Shingles of that many words,
    repeats included, are hashed with XXH64; with fewer words the whole sequence is one shingle. No words, empty and
    null texts have fingerprint zero. Texts of any length are read whole. A clashing column is replaced.
    """
    df = without(df, out)
    ship(df.sparkSession)
    schema, at = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t or b"", words, seed) for t in b.column(at).cast(pa.binary()).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made)], names=[*b.schema.names, out])

    return df.mapInArrow(lean(run), schema)


def _rotated(values: np.ndarray, by: int) -> np.ndarray:
    return values if not by else (values << np.uint64(by)) | (values >> np.uint64(BITS - by))


def trie_pairs(keys: np.ndarray, errors: int, exact: int, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted distinct 64-bit keys that agree in the first `exact` bits and differ in at most `errors`.

    A node is a range of the sorted keys; its children are the two halves that the next bit makes. Node pairs go down
    together, and a pair of two leaves is compared at once.
    With sides (0 or 1 for each key) only pairs of different sides count.
    """
    n = len(keys)
    if n < 2:
        return
    # The nodes at depth `exact`, each paired with itself.
    top = keys >> np.uint64(BITS - exact) if exact else np.zeros(n, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    last = np.append(first[1:], n)
    many = last - first > 1
    stack = [(exact, np.stack([first[many], last[many], first[many], last[many], np.zeros(many.sum(), np.int64)]))]
    while stack:
        depth, work = stack.pop()
        if work.shape[1] > FRONTIER:
            stack += [(depth, work[:, i : i + FRONTIER]) for i in range(0, work.shape[1], FRONTIER)]
            continue
        a0, a1, b0, b1, used = work
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            good = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= errors)
            if sides is not None:
                good &= sides[i] != sides[j]
            if good.any():
                yield i[good], j[good]
            a0, a1, b0, b1, used = (x[~leaf] for x in work)
        if depth == BITS or not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        below = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        # keys[x] & below is the node's prefix; its upper child starts at prefix | bit
        am = np.clip(np.searchsorted(keys, (keys[a0] & below) | bit), a0, a1)
        bm = np.clip(np.searchsorted(keys, (keys[b0] & below) | bit), b0, b1)
        own = a0 == b0
        cross = ~own
        parts = [
            np.stack([a0, am, b0, bm, used]), np.stack([am, a1, bm, b1, used]), np.stack([a0, am, bm, b1, used + 1]),
            np.stack([am[cross], a1[cross], b0[cross], bm[cross], used[cross] + 1]),
        ]
        down = np.concatenate(parts, axis=1)
        keep = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= errors)
        keep &= ~((down[0] == down[2]) & (down[1] - down[0] == 1))  # one key with itself
        if keep.any():
            stack.append((depth + 1, down[:, keep]))


class Forest:
    """Union-find over indices, fed with arrays of pairs; yields those that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        up, out = self.up, []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(a), root(b)
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((a, b))
        return out


def links(fps: DataFrame, errors: int = 3, col: str = "fp") -> DataFrame:
    """Links (a, b) among the distinct values of a long column at Hamming distance `errors` or less: for each group of
    values that links join, enough links to join it. An empty table gives none; nulls are left out.
    """
    spark = fps.sparkSession
    ship(spark)
    blocks = errors + 1
    width = BITS // blocks
    base = fps.select(F.col(col).alias("fp")).where("fp is not null").distinct()
    turned = base.select("fp", F.explode(F.array(*[F.lit(r) for r in range(blocks)])).alias("rot")).select(
        "fp", "rot", F.when(F.col("rot") == 0, F.col("fp")).otherwise(F.expr(f"shiftleft(fp, rot * {width}) | shiftrightunsigned(fp, {BITS} - rot * {width})")).alias("key")
    )
    turned = turned.withColumn("block", F.expr(f"shiftrightunsigned(key, {BITS - width})"))
    # A large block: a task for each unordered pair of parts whose numbers, the next bits, are within the budget; the smaller part
    # is side 0. A block of n rows is dealt out by log2(n / BLOCK_ROWS) bits, so rows are copied as often as its size asks for.
    sizes = turned.groupBy("rot", "block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    sizes = sizes.select("rot", "block", F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.col("n") / BLOCK_ROWS)).cast("int")).alias("bits"))
    sizes = sizes.withColumn("masks", F.expr(f"filter(sequence(0, shiftleft(1, bits) - 1), m -> bit_count(m) <= {errors})"))
    sized = turned.join(sizes, ["rot", "block"], "left").withColumn("part", F.expr(f"coalesce(cast(shiftrightunsigned(key, {BITS - width} - bits) & (shiftleft(1, bits) - 1) as int), 0)"))
    dealt = sized.select("fp", "rot", "block", "key", "part", F.explode(F.coalesce("masks", F.array(F.lit(-1)))).alias("mask")).select(
        "fp", "key", "rot",
        F.when(F.col("mask") < 0, F.xxhash64("rot", "block")).otherwise(F.xxhash64("rot", "block", F.least(F.col("part"), F.expr("part ^ mask")), "mask")).alias("task"),
        F.when(F.col("mask") <= 0, F.lit(-1)).otherwise((F.col("part") > F.expr("part ^ mask")).cast("int")).alias("side"),
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks * base.count() // TASK_ROWS))
    dealt = dealt.repartition(n, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        fp, key, rot, task, side = (whole.column(c).to_numpy() for c in ("fp", "key", "rot", "task", "side"))
        fp, key = fp.view(np.uint64), key.view(np.uint64)
        order = np.lexsort((key, task))
        fp, key, rot, task, side = (x[order] for x in (fp, key, rot, task, side))
        starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
        # Tasks of one rotation without sides are disjoint subtries, so they are joined in one descent.
        for r in range(blocks):
            pick = np.flatnonzero((rot == r) & (side < 0))
            pick = pick[np.argsort(key[pick], kind="stable")]
            yield from emit(key[pick], fp[pick], None, r)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(task)], strict=True):
            if side[s] >= 0:
                yield from emit(key[s:e], fp[s:e], side[s:e], int(rot[s]))

    def emit(keys: np.ndarray, values: np.ndarray, sides: np.ndarray | None, r: int) -> Iterator[pa.RecordBatch]:
        forest = Forest(len(keys))
        for i, j in trie_pairs(keys, errors, width, sides):
            x = values[i] ^ values[j]
            fresh = np.ones(len(i), bool)
            for earlier in range(r):  # rotation r starts with block r, counted from the top
                fresh &= (x >> np.uint64(BITS - (earlier + 1) * width)) & np.uint64((1 << width) - 1) != 0
            edges = forest.add(i[fresh], j[fresh])
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(values[e[:, 0]].view(np.int64)), pa.array(values[e[:, 1]].view(np.int64))], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", errors: int = 3) -> DataFrame:
    """(key, fp, component): the fingerprint and the smallest key reachable by links, for each row of the table.

    Keys may be of any type that has an order, structs included. Null keys stay, with component null unless their fingerprint has another row. Ties and repeated rows are kept as
    they are. An empty table gives an empty result.
    """
    with Scratch(df.sparkSession) as scratch:
        marked = scratch.keep(fingerprints(df.select(F.col(key).alias("node"), F.col(text).alias("text"))).select("node", "fp"), "fingerprints")
        owner = scratch.table(marked.groupBy("fp").agg(F.min("node").alias("owner")), "owners")
        found = scratch.table(links(owner, errors), "links")
        # Links between fingerprints become links between the smallest keys that have them.
        named = found.join(owner.select(F.col("fp").alias("a"), F.col("owner").alias("x")), "a").join(owner.select(F.col("fp").alias("b"), F.col("owner").alias("y")), "b")
        groups = components(named.where("x is not null and y is not null"), "x", "y")
        # Components are a table, so rows of a frequent fingerprint can be split where they are joined to it.
        labelled = scratch.keep(owner.join(groups, owner["owner"] == groups["node"], "left").select("fp", F.coalesce("component", "owner").alias("component")), "labelled")
    return marked.join(labelled, "fp").select(F.col("node").alias(key), "fp", "component")
