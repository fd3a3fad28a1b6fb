"""Fill-in-the-middle: rank and select against counting, and whole rows against a plain version."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import fill_middle


def plain(doc_id, text):
    """(n, form, prefix characters, middle characters, output) by a list of tokens."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=2000))
def test_rank_and_select_count_bits(bits):
    bits = np.array(bits, bool)
    v = fill_middle.Bitvector(np.packbits(bits, bitorder="little"))
    at = np.arange(len(bits) + 1)
    assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    assert (v.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


@pytest.mark.parametrize("step", [8, 16, 64, 1 << 20])
def test_boundaries_do_not_depend_on_steps(monkeypatch, step):
    monkeypatch.setattr(fill_middle, "STEP", step)
    texts = ["ab", "cd é天x", "", "zz\n\n", "q", "é"]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    starts = ends - [len(r) for r in raw]
    zero = np.zeros(len(raw), np.int64)
    n, *_ = fill_middle.cuts(np.frombuffer(b"".join(raw), np.uint8), starts, ends, zero, zero)
    assert n.tolist() == [len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)) for t in texts]


LONG = "Wörter, words 12 — 天地玄黃\n" * 60_000
ROWS = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no key at all"), (5, LONG), (6, "a <P> mark"), (7, "almost <P marks < S> <M"), (8, "<"), (9, "😀é\r\n\x00z")]


def test_rows_against_a_plain_version(spark, monkeypatch):
    rows = ROWS + [(100 + i, f"<{'ab ' * (i % 7)}<S<é{i}>" * (i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for c in ("FORM", "output", "restored", "n_units", "n", "__other"):
        df = df.withColumn(c, F.lit("clash"))
    out = fill_middle.restore(fill_middle.transform(df))
    assert sorted(out.columns) == sorted(["doc_id", "text", "n", "__other", "n_units", "form", "prefix_chars", "middle_chars", "output", "restored"])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "") and r.n == "clash"


def test_an_empty_table_stays_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fill_middle.restore(fill_middle.transform(none)).count() == 0


def test_parameters(spark):
    df = spark.createDataFrame([(i, "some words to cut here") for i in range(50)], "doc_id bigint, text string")
    assert {r.form for r in fill_middle.transform(df, change_percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(df, change_percent=100, suffix_first_percent=100).collect()} == {"spm"}
    one, two = (dict(fill_middle.transform(df, seed=s).select("doc_id", "output").collect()) for s in (1, 2))
    assert one != two
