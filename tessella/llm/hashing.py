"""Hashed word n-grams and the bounded labelled sample that the text classifiers learn from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import lean, ship

#: Words (ASCII letters, digits, underscore, characters beyond ASCII) and runs of other marks.
TOKENS = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\sA-Za-z0-9_\x80-\xff]+")

#: Bytes of text of a labelled sample at most.
SAMPLE_BYTES = 32_000_000


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(key, text, y) of labelled documents to learn from: at most `most`, half of each class where there are as many, and of these
    as many as have `most_bytes` bytes of text together, taken by turns from the classes in the order of a hash of the key.

    Texts are whole: a document of more than what is left is passed over. A key with several labels gets their rounded mean, one
    with several documents gives the one whose text has the smallest hash; null labels and keys do not count. Only numbers of the
    chosen documents, `most` rows at most, come to the driver.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    half = [ids.where(F.col("y") == y).orderBy(F.xxhash64(F.col(key)), key).limit(most // 2) for y in (0, 1)]
    ids = half[0].unionByName(half[1])
    told = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(ids.select(key, "y")), key)
    told = told.withColumn("h", F.xxhash64("text")).withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)))
    rows = told.groupBy(key, "y").agg(F.min(F.struct("h", "n")).alias("t")).select(F.col(key), F.col("y"), "t.h", "t.n", F.xxhash64(key).alias("o")).collect()
    turns = [(i, r) for y in (0, 1) for i, r in enumerate(sorted((r for r in rows if r.y == y), key=lambda r: (r.o, r[key])))]
    left, taken = most_bytes, []
    for _, r in sorted(turns, key=lambda t: (t[0], t[1].y)):
        if r.n <= left:
            left -= r.n
            taken.append((r[key], r.h))
    picked = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("h", T.LongType())]))
    return told.join(F.broadcast(picked.withColumnRenamed("h", "__hash")), (F.col(key) == F.col("__key")) & (F.col("h") == F.col("__hash"))).select(key, "text", "y").dropDuplicates([key])


def collect_features(rows: DataFrame, features: Callable[[bytes], tuple[np.ndarray, np.ndarray]], key: str = "doc_id") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of a bounded sample, worked out by the executors: (y, indices, second array), in the order of the keys' hashes."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32).tobytes() for x, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["k", "y", "x", "v"])

    made = rows.select(F.xxhash64(key).alias("k"), F.col("y"), "text").mapInArrow(lean(run), "k long, y int, x binary, v binary").toArrow()
    out = []
    for b in made.to_batches():
        arrays = [_parts(b.column(2), np.int32), _parts(b.column(3), np.float32)]
        out += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *arrays, strict=True)
    out.sort(key=lambda r: (r[0], r[1], r[2].tobytes()[:64]))
    return [r[1:] for r in out]


def _parts(column: pa.BinaryArray, kind: type) -> list[np.ndarray]:
    """The numbers in each value, as views of the column's bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).tolist()
    data = column.buffers()[2]
    return [np.frombuffer(data, kind, (b - a) // 4, a) if b > a else np.zeros(0, kind) for a, b in zip(ends, ends[1:], strict=False)]
