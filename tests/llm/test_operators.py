"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import components, decontaminate, line_dedup, media, pii, piece_codec, quality, simhash, substring_dedup, toxicity, warc

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (None, "lost key"), (5, LONG), (6, "ends\nwith\n\nlines\n"), (7, "ends\nwith\n\nlines\n")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, a long text, and columns that clash with what operators add."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for c in ("ids", "decoded", "media", "codec", "score", "offending", "fp", "n_words", "hit_spans", "hit_items", "n_removed", "kept_text", "n_lines", "private_text", "component"):
        df = df.withColumn(c.upper() if c == "fp" else c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_pieces(spark, odd, none):
    out = piece_codec.roundtrip(odd).collect()
    assert len(out) == len(ROWS) and all((r.text or "") == r.decoded for r in out)
    assert piece_codec.roundtrip(none).count() == 0
    df = piece_codec.decode(piece_codec.encode(odd.select("doc_id", "text")))
    assert all((r.text or "") == r.decoded for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_pieces_equal_the_library(text):
    c = piece_codec.codec(piece_codec.default_model())
    flat, sizes = c.encode_all([text, text + text])
    c.check([text, text + text], flat, sizes, [c.decode(c.encode(t)) for t in (text, text + text)])


def test_heaps_and_matrices_agree():
    c = piece_codec.codec(piece_codec.default_model())
    for chunk in ("▁international", "▁▁▁▁▁", "▁naïveté", "▁天地玄黃", "▁" + "ab" * 19):
        assert c.agenda(chunk) == c.encode_chunks(pa.array([chunk]))[0].tolist()


@pytest.mark.parametrize("at", [0, 1, 2])
def test_piece_check_finds_a_wrong_merge_in_any_text(at):
    c = piece_codec.PieceCodec(piece_codec.default_model())
    texts = ["plain words", "more of them", "and the last"]
    texts[at] = "the wrong way"
    slot = c.merges._find(*(np.array([c.merges.of_char[ord(x)]]) for x in "wr"))
    c.merges.ranks[slot] = 0  # this pair merges before all others
    c.merges.made[slot] = c.merges.of_char[ord("w")]
    flat, sizes = c.encode_all(texts)
    with pytest.raises(AssertionError, match="ids differ"):
        c.check(texts, flat, sizes, texts)


def test_piece_check_finds_a_wrong_decoded_text():
    c = piece_codec.codec(piece_codec.default_model())
    texts = ["plain words", "more of them"]
    with pytest.raises(AssertionError, match="decoded"):
        c.check(texts, *c.encode_all(texts), ["plain words", "more of then"])


def test_media(odd, none):
    out = media.unpack(media.pack(odd)).collect()
    assert len(out) == len(ROWS) and all(r.error is None and r.codec == "raw " for r in out)
    assert media.unpack(media.pack(none)).count() == 0
    for n in (1, 63, 64, 65, 4096, 4097, 9000):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        f = media.build(media.padded(data))
        (t,) = media.tracks(f)
        assert media.read_samples(f, t)[:n] == data and t.duration == len(media.padded(data))
        assert all(f[a : a + s] == media.padded(data)[i * 4096 : i * 4096 + 64] for i, (a, s) in enumerate(t.key_ranges()))
    assert media.inspect(b"\0\0\0\x40moov")["error"] and media.inspect(None)["error"] and media.inspect(b"")["error"]


def test_archive(spark, odd):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "u\r\nX: y", None), (4, "u", ""), (4, "u", ""), (5, "u", "other")], "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    a = warc.write(pages)
    rows = {r.record_key: r for r in warc.digests(spark, a).collect()}
    assert rows[1].record_type == "revisit" and rows[1].refers_to == 2 and rows[2].record_type == "response"
    assert rows[3].record_type == "revisit" and rows[3].refers_to == 4 and rows[4].payload_bytes == 0
    assert warc.digests(spark, a).count() == 6 and warc.payloads(spark, a).count() == 3
    record = warc.reconstruct(spark, a).where("record_key = 5").first().record
    assert bytes(record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(record).endswith(b"\r\n\r\nother\r\n\r\n")
    high = warc.write(pages, min_bytes=5)
    assert {r.record_type for r in warc.digests(spark, high).where("record_key < 5").collect()} == {"response"}
    assert warc.digests(spark, warc.write(pages.limit(0))).count() == 0
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, data binary").write.mode("append").parquet(a.payloads)
    with pytest.raises(Exception, match="stored bytes"):
        warc.payloads(spark, a).collect()


def test_quality(odd, none):
    labels = odd.sparkSession.createDataFrame([(3, 1), (6, 0), (5, None), (99, 1)], "doc_id bigint, quality int")
    w = quality.train(odd, labels)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, w).collect())
    assert quality.score(none, w).count() == 0 and not quality.train(none, labels).any()


def test_toxicity_finds_sentences(spark, odd, none):
    rows = [(i, f"Plain words number {i} here. " * 3 + ("You are a brute today. " if i % 2 else "") + "More plain words follow.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 50")
    w = toxicity.train(docs, labels)
    out = toxicity.score(docs, w).where("doc_id >= 50").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in out)
    hit = next(r for r in out if r.doc_id % 2)
    assert any("brute" in hit.text[s.start : s.end] for s in hit.offending)
    assert [r.score for r in toxicity.score(odd, w).where("text is null or text = ''").collect()] == [0.0, 0.0]
    assert toxicity.score(none, w).count() == 0


def test_private(spark, odd, none):
    rows = ["4041894974608795 or 4041 8949 7460 8795", "4041894974608796", "300.1.1.1", "2023-02-29", "000-12-3456", "31.12.1999", "DE89 3704 0044 0532 0130 00", "x@y.example", "Ünï@cödé"]
    out = [r.private_text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), "public test key").orderBy("doc_id").collect()]
    a, b = out[0].split(" or ")
    assert b.replace(" ", "") == a and a != rows[0][:16] and len(b) == 19
    assert out[1:5] == rows[1:5] and out[5] != rows[5] and out[6][:2] == "DE" and out[7].endswith("@y.example") and out[8] == rows[8]
    done = pii.pseudonymise(odd, "k").collect()
    assert len(done) == len(ROWS) and {r.doc_id: r.private_text for r in done}[1] is None
    assert pii.pseudonymise(none, "k").count() == 0
    other = pii.pseudonymise(spark.createDataFrame([(1, rows[0])], "doc_id int, text string"), key="another").first().private_text
    assert other != out[0]


def test_feistel_is_a_bijection(spark):
    df = spark.range(100).select(F.array((F.col("id") / 10).cast("int"), (F.col("id") % 10).cast("int")).alias("v"))
    out = df.select(pii.feistel(F.col("v"), F.array(F.lit(10), F.lit(10)), "k", "t").alias("w")).collect()
    assert len({tuple(r.w) for r in out}) == 100


def test_decontaminate(spark, odd, none):
    items = spark.createDataFrame([("a", "Two, three"), ("a", "lost key"), ("b", ""), (None, "one"), ("c", None), ("d", "four")], "item_id string, text string")
    out = {(r.doc_id, r.text): r for r in decontaminate.verdict(decontaminate.find(odd, items)).collect()}
    r = out[3, "one two three four"]
    assert r.n_words == 4 and [(s.start, s.end) for s in r.hit_spans] == [(1, 4)] and r.hit_items == ["a", "d"] and r.contaminated
    assert out[1, None].n_words == 0 and not out[1, None].contaminated and out[None, "lost key"].n_hit == 2
    assert decontaminate.find(none, items).count() == 0 and decontaminate.find(odd, items.limit(0)).where("size(hit_items) > 0").count() == 0


def test_decontaminate_in_passes(spark, odd, monkeypatch):
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(["two three", "three four", "lost", "ends with", "w1x1"])], "item_id string, text string")
    cols = ["doc_id", "n_words", "hit_spans", "hit_items"]
    key = lambda r: str(r)
    one = sorted(decontaminate.find(odd, items).select(*cols).collect(), key=key)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 40)
    assert sorted(decontaminate.find(odd, items).select(*cols).collect(), key=key) == one


def test_fm_index_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        s = np.append(rng.integers(0, 4, rng.integers(1, 150)), 0)
        assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        f = decontaminate.FMIndex(s, 5)
        for n in (1, 2, 4):
            p = rng.integers(1, 6, (15, n))
            lo, hi = f.search(p, np.full(15, n))
            for q, a, b in zip(p, lo, hi, strict=True):
                assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s)) if s[i : i + n].tolist() == q.tolist()]


def test_simhash(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ROWS) and {r.component for r in out if r.fp == 0} == {1}
    same = [r.component for r in out if r.doc_id in (6, 7)]
    assert same == [6, 6] and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("big", [20_000, 10])
def test_trie_join_by_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", big)
    rng = np.random.default_rng(2)
    v = [int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64)]
    v += [x ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))) for x in v for _ in range(2)]
    v += [0xABCD << 48 | int(x) for x in rng.integers(0, 2**12, 100)]  # one crowded block
    keys = sorted(set(v))
    df = spark.createDataFrame([(int(np.uint64(k).astype(np.int64)),) for k in keys], "fp bigint")
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in simhash.links(df).collect():
        a, b = (int(np.int64(x).astype(np.uint64)) for x in (r.a, r.b))
        assert (a ^ b).bit_count() <= 3
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 3 and want[a] != want[b]:
                x, y = want[a], want[b]
                want = {k: min(x, y) if c in (x, y) else c for k, c in want.items()}
    assert {k: root(k) for k in keys} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 21), (21, 22), (22, 23), (23, 24)], "a bigint, b bigint")
    assert {r.node: r.component for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}


def slow_lines(rows, m):
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for k, t in order:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for j in range(len(at) - m + 1):
            run = tuple(lines[i] for i in at[j : j + m])
            if run in seen:
                gone |= set(at[j : j + m])
            seen.setdefault(run, (k, j))
        out.append((k, None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_line_dedup_by_brute_force(spark, m):
    rng = random.Random(m)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d"]) for _ in range(rng.randrange(1, 14)))) for i in range(40)] + [(99, None)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_lines=m).collect()
    assert sorted((r.doc_id, r.kept_text) for r in out if r.doc_id != 99) == sorted(x for x in slow_lines(rows, m) if x[0] != 99)


def test_line_dedup(odd, none):
    out = line_dedup.dedup(odd).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[6].kept_text == ROWS[6][1] and by[7].kept_text == "\n" and by[7].n_removed == 3 and by[1].kept_text is None
    assert [r.n_removed for r in out if r.doc_id == 3] == [0, 0] and line_dedup.dedup(none).count() == 0


def test_line_dedup_of_one_line_passages(spark):
    """A repeated line between differing neighbours goes if it is of passage length, its first copy and short lines stay."""
    long, short = " ".join(f"w{i}" for i in range(5)), "w0 w1 w2 w3"
    rows = [(i, f"a{i}\n{long}\nb{i}\n{short}\nc{i}") for i in range(4)] + [(9, f"{long}\n\n{long}"), (None, f" x\n{long}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.dedup(df, passage_words=5).collect()}
    assert out == {None: (0, f" x\n{long}"), 9: (2, "")} | {i: (1, f"a{i}\nb{i}\n{short}\nc{i}") for i in range(4)}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup(df).collect()} == {None: 0, 9: 0} | dict.fromkeys(range(4), 0)


def test_pipeline_deletes_one_line_passages(spark):
    line = " ".join(f"w{i}" for i in range(50))
    rows = [(i, f"a{i}\n{line}\nb{i}", "en", "s", 1) for i in range(3)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(0, rows[0][1], 1), (1, "a1\nb1", 5), (2, "a2\nb2", 5)]


def slow_windows(texts, w):
    words = [(t or "").encode().split() for t in texts]
    seen = {}
    for d, x in enumerate(words):
        for i in range(len(x) - w + 1):
            seen.setdefault(tuple(x[i : i + w]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + w))
    return [(len(x), len(g), b" ".join(v for i, v in enumerate(x) if i not in g).decode()) for x, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize(("w", "letters"), [(2, 3), (3, 2), (5, 2), (8, 4), (12, 2)])
def test_substring_dedup_by_brute_force(spark, w, letters):
    rng = random.Random(w)
    texts = [" ".join(rng.choice("abcdefg"[:letters]) for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    texts += [texts[0], texts[1] + " q " + texts[2], "a " * 80, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = substring_dedup.dedup(df, window=w, rounds=3, cap=6).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept_text) for r in out] == slow_windows(texts, w)


def test_substring_dedup_of_many_equal_rows(spark):
    """Time grows with the rows, and each document has the spans of one: some equal in key and text, some in text alone."""
    import time

    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(80))
    rows = [(7, text)] * 5000 + [(None, text)] * 3000 + [(i, text) for i in range(100, 600)] + [(8, other), (9, other[:200] + " end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    substring_dedup.dedup(df.limit(10)).collect()
    began = time.perf_counter()
    got = substring_dedup.dedup(df).select("doc_id", "n_words", "n_removed").collect()
    assert time.perf_counter() - began < 40 and len(got) == len(rows)
    assert all(r.n_removed == 60 == r.n_words for r in got if r.doc_id not in (8, 9))
    whole = [w for w, v in zip(other.split(), (other[:200] + " end").split(), strict=False) if w == v]
    assert {r.n_removed for r in got if r.doc_id in (8, 9)} == {len(whole)}


def test_substring_dedup(odd, none):
    out = substring_dedup.dedup(odd, window=3).collect()
    assert len(out) == len(ROWS) and [r.n_removed for r in out if r.doc_id == 3] == [4, 4]
    assert {r.doc_id: r.n_removed for r in out}[1] == 0 and substring_dedup.dedup(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=5), st.integers(2, 9), st.integers(0, 5), st.integers(1, 20))
def test_equal_windows_have_equal_anchors(seqs, w, rounds, cap):
    h = substring_dedup.names([str(x).encode() for s in seqs for x in s])
    name, _, lo, hi = substring_dedup.anchors(h, np.array([len(s) for s in seqs]), w, rounds, cap)
    flat, found = [x for s in seqs for x in s], {}
    for a, b, c in zip(name.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for i in range(b, c - w + 1):
            assert found.setdefault(tuple(flat[i : i + w]), a) == a


def media_file(text=b"words " * 3000):
    return media.build(media.padded(text))


def test_media_tells_of_every_broken_file():
    """Cuts and changed bytes anywhere give features or an error, and never more samples than the file has bytes."""
    good, rng = media_file(), random.Random(5)
    head = len(good) - len(media.padded(b"words " * 3000))
    cases = [good[:n] for n in range(0, head + 40, 7)] + [None, b"", good + b"\0\0\0"]
    for _ in range(1500):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(head)] = rng.choice([0, 1, 127, 255, rng.randrange(256)])
        cases.append(bytes(b))
    told = [media.inspect(c) for c in cases]
    assert all((r["error"] is None) != (r["payload_sha256"] is None) for r in told)
    assert all(r["error"] is not None or r["n_samples"] <= len(c) for r, c in zip(told, cases, strict=True))


def patched(data, kind, at, value):
    i = data.index(kind) + 4 + at
    return data[:i] + value + data[i + len(value) :]


def test_media_checks_tables():
    good = media_file()
    wrong = {
        "key frame": patched(good, b"stss", 8, b"\0\0\xff\xff"), "outside": patched(good, b"stco", 8, b"\x7f\0\0\0"), "fit": patched(good, b"stsz", 8, b"\xff\xff\xff\xff"),
        "times": patched(good, b"stts", 8, b"\0\0\0\1"), "order": patched(good, b"stsc", 8, b"\0\0\0\2"),
    }
    for word, data in wrong.items():
        assert word in media.inspect(data)["error"]
    deep = good
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    assert "deep" in media.inspect(deep)["error"]


def test_media_reads_all_tracks_and_fragments():
    """A second track without tables has its samples in two fragments, one with sizes of its own and one with defaults."""
    import struct

    pay = [b"A" * 10, b"B" * 30, b"C" * 20, b"D" * 20]
    hdlr = media._full(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"vide"), b"v\0")
    mdhd = media._full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0))
    stsd = media._full(b"stsd", 0, 0, struct.pack(">I", 1), media._box(b"avc1", bytes(78)))
    trak = lambda n: media._box(b"trak", media._full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, n, 0, 0)), media._box(b"mdia", mdhd, hdlr, media._box(b"minf", media._box(b"stbl", stsd))))
    moov = media._box(b"moov", trak(1), trak(2), media._box(b"mvex", media._full(b"trex", 0, 0, struct.pack(">5I", 2, 1, 40, 20, media.NO_KEY))))

    def moof(offset):
        one = media._full(b"trun", 0, 0x1 | 0x200 | 0x400, struct.pack(">IiIIII", 2, offset, 10, 0, 30, media.NO_KEY))
        two = media._full(b"trun", 0, 0x4, struct.pack(">II", 2, 0))
        return media._box(b"moof", media._box(b"traf", media._full(b"tfhd", 0, 0x20000, struct.pack(">I", 2)), one, two))

    size = len(moof(0))
    data = moov + moof(size + 8) + media._box(b"mdat", *pay)
    first, second = media.tracks(data)
    assert len(first.sizes) == 0 and media.read_samples(data, second) == b"".join(pay)
    assert second.sizes.tolist() == [10, 30, 20, 20] and second.times.tolist() == [0, 40, 80, 120] and second.duration == 160
    assert second.keys.tolist() == [0, 2] and second.codec == "avc1" and second.handler == "vide"
    assert [t["n_samples"] for t in media.inspect(data)["tracks"]] == [0, 4]


def test_phrases_are_arrays_of_bounded_size():
    """Windows, owners and symbols of a pass stay within some tens of bytes for each byte of phrases."""
    rng = random.Random(2)
    items = [(f"i{k}", [b"%x" % rng.randrange(5000) for _ in range(rng.randrange(1, 60))]) for k in range(3000)]
    size = sum(len(w) + 1 for _, ws in items for w in ws)
    p = decontaminate.Phrases(items, 13)
    held = p.windows.nbytes + p.lengths.nbytes + p.owner_flat.nbytes + p.owner_at.nbytes
    assert held < 30 * size and len(p.symbols) <= 5000
    assert not any(isinstance(v, (list, tuple)) and len(v) > len(items) for v in vars(p).values())

