"""b-bit MinHash: signatures against counting, estimates against true similarities, components against all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import minhash, queries
from tests.conftest import SF


def plain_set(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({" ".join(w)} if w else set())


def plain_components(rows, percent=85, words=3):
    """(key, size, least key reachable) of each row, by all pairs."""
    sets = [frozenset(plain_set(t, words)) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in holders[x]:
                both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(root(i), []).append(k)
    return [(k, len(s), min((x for x in least[root(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def result(df, **how):
    return sorted(map(tuple, minhash.near_duplicates(df, **how).collect()), key=str)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=900), st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=900))
def test_packed_parts_count_as_plain_ones(a, b):
    low = np.stack([minhash.minima(np.array(sorted(s), np.uint64)) for s in (a, b)])
    for s, row in zip((a, b), low, strict=True):
        t, p = int(minhash.TIMES[3, 0]), int(minhash.PLUS[3, 0])
        assert int(row[3]) == min((x * t + p) % 2**64 for x in s)
    packed = minhash.pack(low)
    assert minhash.equal_parts(packed[0], packed[1]) == int(((low[0] ^ low[1]) % (1 << minhash.BITS) == 0).sum())


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(3)
    for true in (0.0, 0.5, 0.85):
        found = []
        for _ in range(60):
            x = rng.integers(0, 2**64 - 1, 900, np.uint64)
            n = int(600 * true)  # of 600 in the union
            a, b = x[:300 + n // 2], np.concatenate([x[:n], x[300 + n // 2 : 600]])
            low = minhash.pack(np.stack([minhash.minima(a), minhash.minima(b)]))
            found.append(minhash.similarity(int(minhash.equal_parts(low[0], low[1]))))
        assert abs(np.mean(found) - true) < 0.02
    assert minhash.similarity(minhash.least_equal(85)) > 0.6


@pytest.mark.parametrize("piece", [1, 7, 4_000_000])
def test_pieces_do_not_change_sets(monkeypatch, piece):
    monkeypatch.setattr(minhash, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(50):
        text = "".join(rng.choice(["A", "bc", " ", "  \t", "\n", "é ", "d"]) for _ in range(rng.randrange(40)))
        got = minhash.shingles(text.encode())
        assert len(got) == len(plain_set(text)) and (np.diff(got.astype(float)) >= 0).all()


def copies(rng, n):
    """Bases and copies of them with words changed at random, so that similarities lie on both sides of the threshold."""
    rows = []
    while len(rows) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 3, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((rng.choice([None, *range(10 * n)]) if rng.random() < 0.05 else len(rows), rng.choice([" ", "\n", "  "]).join(w)))
    return rows


def test_components_by_all_pairs(spark):
    rng = random.Random(11)
    rows = copies(rng, 900) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a"), (5004, "A"), (5005, "a b"), (5005, "a b"), (5006, "b a")]
    rows += [(6000, " ".join(f"v{i % 30_011}" for i in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("N", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("id", F.lit(2))
    assert result(df) == sorted(plain_components(rows), key=str)
    assert result(df.withColumnsRenamed({"doc_id": "k", "text": "t"}), key="k", text="t", words=5, percent=80) == sorted(plain_components(rows, 80, 5), key=str)


def test_a_dense_group_below_the_threshold_and_blocks(spark, monkeypatch):
    """Copies of one base that link with it alone, in buckets of several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(42)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(3, 39)] = f"x{i}"
        if i % 3:
            w[rng.randrange(3, 39)] = f"y{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == sorted(plain_components(rows), key=str)
    rows.append((999, " ".join(base)))
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == sorted(plain_components(rows), key=str)


def test_links_stop_at_one_component():
    a = np.arange(100, dtype=np.int64)
    flat, sizes = np.concatenate([a, a[:90], a[:50], a[45:95]]), np.array([100, 90, 50, 50])
    assert minhash._links(flat, sizes, np.arange(4), 85) == [(0, 1)]
    assert sorted(minhash._links(flat, sizes, np.arange(4), 50)) == [(0, 1), (0, 2), (0, 3)]
    assert minhash._links(flat, sizes, np.array([0, 0, 0, 0]), 50) == []


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert minhash.near_duplicates(none).count() == 0


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op11_minhash(spark, SF).collect()), key=str)
    assert got == sorted(plain_components(rows), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in queries.op11_minhash(spark, SF).collect())
