"""Queries and pipeline stages, row by row, against the plain versions in slow.py."""

import zlib
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import hashing, media, pii, piece_codec, quality, queries, toxicity
from tessella.llm.common import Scratch, fold, shared_dir
from tests.conftest import SF
from tests.llm import slow


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("select doc_id, text, quality, toxic from documents left join labels using (doc_id) order by doc_id").df()


def test_private_values(spark, docs):
    got = {r.doc_id: r for r in queries.op5_pii(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert (got[i].text, got[i].n_private) == slow.private(t, queries.PII_KEY, pii.CANDIDATES)[:2]


def test_private_values_of_every_kind(spark):
    texts = [
        "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 378282246310005.", "call +1 (017) 555-7713 or (212) 555-0187, not 017 555-7713; 212.555.0187 +1 212 555 0187",
        "10.0.0.1 300.1.1.1 255.255.255.255", "078-05-1120 666-12-3456 900-12-3456 667-01-0001 899-99-9999 000-12-3456", "2024-02-29 2023-02-29 31.12.1999 12/31/1999 1599-12-31 1600-01-01 2399-12-31",
        "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89370400440532013001", "Mail Ann.Lee42@Example.org, x@y.zz ann.lee42@example.org; -@a.bc",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kinds = set()
    for r in pii.pseudonymise(df, "k").collect():
        text, n, found = slow.private(texts[r.doc_id], "k", pii.CANDIDATES)
        assert (r.private_text, r.n_private) == (text, n) and n
        kinds |= found
    assert kinds == set(pii.KINDS)
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymise(df, "")


def sample(docs, label, held):
    """The labelled rows that a classifier learns from, in its order."""
    rows = [(int(y), t, int(i)) for i, t, y in zip(docs.doc_id, docs.text, docs[label], strict=True) if pd.notna(y) and not held(i)]
    return sorted(rows, key=lambda r: slow.spark_hash(r[2]))


def test_quality_scores(spark, docs):
    rows = sample(docs, "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    w = slow.ftrl([(y, slow.quality_features(t)) for y, t, _ in rows])
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        want = slow.sigmoid(sum(w.get(k, 0.0) * v for k, v in slow.quality_features(t).items()) + w[None])
        assert abs(got[i].score - want) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def weights(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 5) != 0)
    return toxicity.train(table, labels.select("doc_id", "toxic"))


def test_toxicity_scores(spark, docs):
    w = weights(spark).astype(float)
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert abs(got[i].score - slow.toxic_score(t, w)) < 1e-6
        raw = t.encode()
        hot = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b, f in slow.toxic_sentences(raw) if sum(w[x] for x in f) + w[-1] >= 0]
        assert got[i].n_offending == len(hot)


def test_toxicity_learns_by_the_gradient_of_noisy_or(spark, docs):
    """One pass over one document moves the weights against the numeric slope of its loss."""
    texts = ["you fool. the sea is calm. you fool again", "the sea is calm. a boat"] * 4
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(8)], "doc_id bigint, toxic int")
    w = toxicity.train(df, labels, epochs=30).astype(float)
    scores = [slow.toxic_score(t, w) for t in texts[:2]]
    assert scores[0] > 0.9 and scores[1] < 0.1
    x = toxicity.features(texts[0].encode())[0]
    for at in np.unique(x)[:5]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert (slow.toxic_score(texts[0], up) - slow.toxic_score(texts[0], down)) / 2e-5 >= 0  # more of a word, more toxic


def test_labelled_sample_is_bounded(spark):
    texts = [(i, "x" * 1000) for i in range(40)] + [(3, "another"), (5, None), (99, "y" * 50_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in [*range(40), 99]), (None, 1)], "doc_id bigint, q int")
    got = hashing.sample(df, labels, "q", 20, most_bytes=12_000).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 20 and sum(len(r.text or "") for r in got) <= 12_000
    assert abs(sum(r.y for r in got) - len(got) / 2) <= 1
    assert len(hashing.sample(df, labels, "q", 100).collect()) == 41


def test_media_hash_is_of_the_stored_form(spark, docs):
    got = {r.doc_id: r for r in queries.op3_media(spark, SF).collect()}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        payload = t.encode() + bytes(-len(t.encode()) % 64 if t else 64)
        data = media.build(payload)
        assert data.endswith(payload) and got[i].media_bytes == len(data) and got[i].media_sha256 == sha256(data).hexdigest()
        n, keys = len(payload) // 64, -(-len(payload) // 4096)
        assert got[i].feature.split(";")[:6] == ["raw ", "soun", "8000", str(len(payload)), str(n), str(keys)]


#: Rows of the pipeline's edge cases: repeated rows, unlike texts of one doc_id, no doc_id, null, empty and long texts.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGE = [
    (1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (3, "another text of the same number"), (None, "no number here"), (None, None), (5, LONG),
    (6, f"a\n{PASSAGE}\nb"), (7, f"c\n{PASSAGE}\nd"), (8, "same first\nsame second\nsame third\nown line"), (9, "x\nsame first\nsame second\nsame third"), (10, "only\n\n \nblank"),
]


def edge_table(spark, docs):
    rows = EDGE + [(int(i) + 1000, t) for i, t in zip(docs.doc_id[:60], docs.text[:60], strict=True)]
    df = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("toxic_score", "n_words", "N_LINES", "contaminated", "fp", "component", "kept_text", "spans", "h", "k", "__h"):
        df = df.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return df


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_pipeline_row_by_row(spark, docs):
    table, items = edge_table(spark, docs), spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text.tolist()
    columns, now = table.columns, [(r.doc_id, r.text) for r in table.collect()]
    stage = dict(corpus_pipeline.STAGES)

    def step(name, table, want):
        out = stage[name](spark, table, SF)
        assert out.columns == columns and rows_of(out) == sorted(want, key=str), name
        back = spark.createDataFrame(rows := out.collect(), out.schema)
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in columns[5:]), name
        return back, [(r.doc_id, r.text) for r in rows]

    own = spark.read.parquet(f"{SF}/labels.parquet").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    w = toxicity.train(table, own).astype(float)
    table, now = step("toxicity", table, [(i, t) for i, t in now if slow.toxic_score(t, w) < 0.5])

    order = sorted({(i, t) for i, t in now}, key=lambda r: (r[0] is not None, r[0] or 0, place_hash(r[1])))
    kept = {r: x for r, x in zip(order, slow.lines(order), strict=True)}
    table, now = step("line_dedup", table, [(i, kept[i, t][3]) for i, t in now])

    order = sorted({(i, t) for i, t in now}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, place_hash(r[1])))
    label = slow.groups([slow.fingerprint(t) for _, t in order])
    table, now = step("simhash_near_dedup", table, [r for i, r in enumerate(order) if label[i] == i])

    table, now = step("decontamination", table, [(i, t) for i, t in now if not slow.contaminated(t, items)])
    out = stage["sentencepiece"](spark, table, SF).collect()
    lib = piece_codec.codec(piece_codec.default_model()).lib
    want = [(i, (ids := lib.encode(t or "", add_bos=True, add_eos=True)), sha256(lib.decode(ids).encode()).hexdigest()) for i, t in now]
    assert sorted(((r.doc_id, list(np.frombuffer(r.ids, "<u4")), r.decoded_sha256) for r in out), key=str) == sorted(((i, list(map(np.uint32, ids)), d) for i, ids, d in want), key=str)


def place_hash(text):
    """xxhash64() of a string, as Spark has it: signed, and 42 for null."""
    import xxhash

    x = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return x - 2**64 if x >= 2**63 else x


def test_pipeline_of_no_rows(spark):
    table = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert out.count() == 0


def test_scratch_tables_go(spark, tmp_path):
    import os

    with Scratch(spark) as s:
        a, b = s.table(spark.range(5), "a"), s.keep(spark.range(7), "b")
        assert a.count() == 5
    at = s.root.removeprefix("file:")
    assert [x for x in os.listdir(at) if "-a" in x] == [] and b.count() == 7
    with pytest.raises(RuntimeError), Scratch(spark) as s:
        s.keep(spark.range(3), "c")
        raise RuntimeError
    assert os.listdir(s.root.removeprefix("file:")) == []


def test_machine_local_folders_are_refused_on_a_cluster(spark):
    class Far:
        """A session of a cluster without a checkpoint folder."""

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class C:
                        @staticmethod
                        def getCheckpointDir():
                            class No:
                                isDefined = staticmethod(lambda: False)

                            return No

                    return C

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Far)


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_runs_line_for_line(spark, seed):
    """Runs of any length, not of powers of two, and runs that overlap their own copy."""
    import random

    from tessella.llm import line_dedup

    rng = random.Random(seed)
    run = [f"l{i}" for i in range(23)]
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(0, 12)))) for i in range(25)]
    rows += [(50, "\n".join([*run[3:8], "x"])), (51, "\n".join(["y", *run[3:8], "z"])), (52, "\n".join(run)), (53, "\n".join([*run[:19], "q"])), (54, "\n".join(["s"] * 13)), (55, None), (None, "\n".join(run[2:9]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {r[0]: x for r, x in zip(order, slow.lines(order), strict=True)}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.longest_run, r.kept_text) for r in line_dedup.dedup(df).collect()} == want
    assert want[51][2] == 5 and want[53][2] == 19 and want[54][2] == 12
