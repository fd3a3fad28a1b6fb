"""Toxicity by multiple-instance learning: a document's score is the noisy-or of its sentences' scores.

Only documents have labels. A sentence's score is a logistic function of its hashed words and word pairs; a document is
toxic unless each of its sentences fails to be: P = 1 - prod(1 - p). The weights are trained through that product, and
afterwards the sentences' own scores locate what offends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.llm.common import lean, ship, slices, without
from tessella.llm.hashing import collect_features, pair_hashes, sample, token_hashes

#: Weights, as a power of two.
WIDTH = 20
#: Labelled documents to learn from at most.
SAMPLE_ROWS = 6000
#: A feature counts if so many documents of the sample have it.
LEAST_DOCS = 4
#: Lengths of the words' beginnings that count, in bytes.
STEMS = (4, 5)
#: Bytes of text that are scored together, unless one text has more.
GROUP_BYTES = 1 << 20
#: What a byte is part of: white space 0, a word 1, other marks 2.
KIND = np.full(256, 2, np.uint8)
KIND[list(b" \t\n\r\f\v")] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
STOP = np.isin(np.arange(256), list(b".!?"))


class Sentences:
    """The sentences of some texts, and their features.

    A sentence is a run of bytes other than stops (full stop, exclamation and question mark) and line feeds, with the stops after
    it; one of white space and stops alone does not count. Its tokens are words in lower case and runs of other marks. Its
    features are its tokens, their first four and first five bytes (so that other endings of a stem count), and pairs of
    neighbouring tokens, hashed; each counts once.
    """

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        #: Where texts begin, and the last one's end.
        self.bounds = np.concatenate([[0], np.cumsum(size)])
        self.raw = b = np.frombuffer(b"".join(texts), np.uint8)
        n = len(b)
        begins = np.zeros(n + 1, bool)
        begins[self.bounds] = True
        begins = begins[:n]
        stop = STOP[b]
        body = ~stop & (b != 10)
        start = body.copy()
        start[1:] &= ~body[:-1] | begins[1:]
        # Stops belong to a sentence if a run of them follows its body in the same text.
        run = np.flatnonzero(np.concatenate([[True], (stop[1:] != stop[:-1]) | begins[1:]])) if n else np.zeros(0, np.int64)
        led = np.zeros(len(run), bool)
        led[1:] = body[run[1:] - 1] & ~begins[run[1:]]
        tail = stop & np.repeat(led, np.diff(np.append(run, n)))
        owner = np.cumsum(start) - 1
        inside = body | tail
        kind = KIND[b]
        full = np.bincount(owner[body & (kind > 0)], minlength=int(start.sum())) > 0
        #: First byte and end of each sentence that counts.
        self.start = np.flatnonzero(start)[full]
        self.end = self.start + np.bincount(owner[inside], minlength=len(full))[full]
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        keep = inside & (kind > 0)
        keep[keep] = full[owner[keep]]
        number = np.cumsum(full) - 1
        at = np.flatnonzero(keep)
        of, what = number[owner[at]], kind[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (what[1:] != what[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        low = b[at]
        low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint8)
        tokens = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(at)).astype(np.int32)), pa.py_buffer(low.tobytes())]).dictionary_encode()
        self.owner, self.token = of[first], tokens.indices.to_numpy()
        self.words = tokens.dictionary.to_pylist()

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices, distinct within a sentence and in sentence order, and how many each sentence has."""
        h = token_hashes(self.words)
        starts = [(token_hashes([w[:n] for w in self.words]) * np.uint64(2 * n + 1))[self.token] for n in STEMS]
        h = h[self.token]
        inside = self.owner[1:] == self.owner[:-1]
        hashed = np.concatenate([h, *starts, pair_hashes(h)[inside]])
        of = np.concatenate([self.owner] * (1 + len(STEMS)) + [self.owner[1:][inside]])
        both = np.sort(of << WIDTH | (hashed >> np.uint64(64 - WIDTH)).astype(np.int64))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return both & ((1 << WIDTH) - 1), np.bincount(both >> WIDTH, minlength=len(self.start))

    def points(self, at: np.ndarray) -> np.ndarray:
        """Places in bytes as places in code points of their texts."""
        before = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        return before[at] - before[self.bounds[np.searchsorted(self.bounds, at, side="right") - 1]]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sentences of one text: see Sentences."""
    return Sentences([text]).features()


def score_texts(texts: list[bytes], w: np.ndarray, cut: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores, and the sentences that score `cut` or more, of each text."""
    found = Sentences(texts)
    x, counts = found.features()
    s = np.bincount(np.repeat(np.arange(len(counts)), counts), w[x], minlength=len(counts)) + w[-1]
    whole = -np.expm1(-np.bincount(found.doc, np.logaddexp(0, s), minlength=len(texts)))
    p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    spans: list[list[dict]] = [[] for _ in texts]
    hot = np.flatnonzero(p >= cut)
    if len(hot):
        last = found.end[hot]
        # The end of a text is not the start of the next one.
        ends = found.points(last - 1) + 1
        for d, a, z, v in zip(found.doc[hot].tolist(), found.points(found.start[hot]).tolist(), ends.tolist(), p[hot].tolist(), strict=True):
            spans[d].append({"start": a, "end": z, "score": v})
    return whole, spans


def noisy_or(s: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(s)); no sentence: 0."""
    return float(-np.expm1(-np.logaddexp(0, s).sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS, epochs: int = 12, rate: float = 0.3, seed: int = 7) -> np.ndarray:
    """Weights learned from at most `most` labelled documents; the last one is the bias. Without any, every score is near 0."""
    rows = collect_features(sample(docs, labels, label, most, key, text), features, key)
    df = np.zeros(1 << WIDTH, np.int32)
    for _, x, _ in rows:
        df[np.unique(x)] += 1
    kept = df >= LEAST_DOCS
    # Of each document: its features that count, where they stand, and the sentences of these.
    known = []
    for y, x, counts in rows:
        if len(x):
            use = kept[x]
            at, where = np.unique(x[use], return_inverse=True)
            owner = np.repeat(np.arange(len(counts)), counts.astype(np.int32))[use]
            known.append((y, at, where.astype(np.min_scalar_type(len(at))), owner.astype(np.min_scalar_type(len(counts))), len(counts)))
    del rows
    w, square, bias, bias_square = np.zeros(1 << WIDTH), np.full(1 << WIDTH, 1e-2), -6.0, 1e-2
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(known)).tolist():
            y, at, where, owner, n = known[i]
            now = w[at]
            s = np.bincount(owner, now[where], minlength=n) + bias
            p = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
            whole = min(max(noisy_or(s), 1e-9), 1.0)
            g = p if not y else -p * (1 - whole) / whole  # of the loss by each sentence's sum
            grad = np.bincount(where, g[owner], minlength=len(at)) + 1e-4 * now
            add = square[at] + grad * grad
            square[at] = add
            w[at] = now - rate * grad / np.sqrt(add)
            b = float(g.sum())
            bias_square += b * b
            bias = min(-3.0, bias - 0.1 * rate * b / np.sqrt(bias_square))  # most sentences offend nobody
    return np.append(np.where(kept, w, 0.0), bias).astype(np.float32)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score", spans: str = "offending", cut: float = 0.5) -> DataFrame:
    """Add the document's score (double, 0 to 1) and the sentences that score `cut` or more: start and end in code points.

    Null and empty texts score 0 and have no sentence; a text of any length is scored whole. Rows are scored each by itself, so
    repeated rows and null keys are like any other, and an empty table gives an empty result. Columns with the new names are
    replaced.
    """
    docs = without(docs, out, spans)
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(weights)  # of a fixed width
    schema, at = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(spans, SPANS)]), docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)

        for whole in batches:
            texts = [t or b"" for t in whole.column(at).cast(pa.binary()).to_pylist()]
            for part in slices(texts, GROUP_BYTES):
                got, spans = score_texts(texts[part], w, cut)
                b = whole.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64()), pa.array(spans, kind)], names=schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)
