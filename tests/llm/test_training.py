"""The noisy-or trainer against a plain one: dictionaries, one sentence and one feature at a time."""

import math
import random

import numpy as np
import pytest

from tessella.llm import hashing, toxicity


def plain_train(rows, epochs, rate, seed):
    """(weight by feature, bias). rows: (label, features, features of each sentence)."""
    docs, count = [], {}
    for _, x, _ in rows:
        for f in set(x.tolist()):
            count[f] = count.get(f, 0) + 1
    for y, x, sizes in rows:
        if len(x):
            sentences, at = [], 0
            for n in sizes.astype(int).tolist():
                sentences.append([f for f in x[at : at + n].tolist() if count[f] >= toxicity.LEAST_DOCS])
                at += n
            docs.append((y, sentences))
    w, square, bias, bias_square = {}, {}, -6.0, 1e-2
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(docs)).tolist():
            y, sentences = docs[i]
            p = [1 / (1 + math.exp(-(sum(w.get(f, 0.0) for f in s) + bias))) for s in sentences]
            safe = 1.0
            for v in p:
                safe *= 1 - v
            whole = min(max(1 - safe, 1e-9), 1.0)
            # The loss is -ln(1 - safe) for a toxic document, -ln(safe) for another.
            g = [v if not y else -v * (1 - whole) / whole for v in p]
            grad = {}
            for s, v in zip(sentences, g, strict=True):
                for f in s:
                    grad[f] = grad.get(f, 0.0) + v
            for f, v in grad.items():
                v += 1e-4 * w.get(f, 0.0)
                square[f] = square.get(f, 1e-2) + v * v
                w[f] = w.get(f, 0.0) - rate * v / math.sqrt(square[f])
            b = sum(g)
            bias_square += b * b
            bias = min(-3.0, bias - 0.1 * rate * b / math.sqrt(bias_square))
    return w, bias


def test_weights_equal_a_plain_trainer(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(25)]
    rows, labels = [], []
    for i in range(120):
        toxic = i % 3 == 0
        sentences = [" ".join(rng.choices(words, k=rng.randrange(2, 7))) for _ in range(rng.randrange(1, 6))]
        if toxic:
            sentences.insert(rng.randrange(len(sentences) + 1), "you utter " + rng.choice(["fool", "fools", "foolish one"]))
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    rows += [(200, None), (201, ""), (7, "a second text of one key")]
    labels += [(200, 1), (201, 0), (None, 1), (3, None)]
    docs, told = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.train(docs, told, epochs=5)
    sample = hashing.collect_features(hashing.sample(docs, told, "toxic", toxicity.SAMPLE_ROWS), toxicity.features)
    w, bias = plain_train(sample, 5, 0.3, 7)
    want = np.zeros(len(got), np.float64)
    want[list(w)] = list(w.values())
    want[-1] = bias
    assert np.count_nonzero(got[:-1]) > 40 and np.allclose(got, want, atol=1e-4)
    # What it learned is what was planted: a sentence with the insult scores high, one of plain words low.
    score = dict(toxicity.score(spark.createDataFrame([(1, "you utter fools"), (2, "word1 word2 word3")], "doc_id bigint, text string"), got).select("doc_id", "score").collect())
    assert score[1] > 0.5 > score[2]


def test_no_labels_and_no_rows_learn_nothing(spark):
    docs, none = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, toxic int")
    for d in (docs, docs.limit(0)):
        w = toxicity.train(d, none, epochs=1)
        assert not w[:-1].any() and w[-1] == pytest.approx(-6.0)
