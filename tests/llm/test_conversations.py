"""Conversation repair against a plain search over all edits, and its parts against whole conversations."""

import random
import re
import zlib
from functools import cache
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import conversations, queries
from tests.conftest import SF

DONE = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    """(conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            row = (conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            out += [row] * (2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2][:16].encode(), r[3][:48].encode()))


def plain(rows):
    """The report on one conversation's sorted (turn, role, text), by a recursion over whole strings of letters."""
    faults, said = [], set()
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in said else "truncated" if words[-1] not in ".!?" else "")
        said.add((role, text))

    @cache
    def best(i, tail):
        """(cost, letters, turns) from row i on; tail: 0 nothing yet, 1 s, 2 ends in u, 3 ends in a."""
        if i == len(rows):
            return (0, "", ()) if tail in (0, 3) else (3, "I", (("assistant", ""),)) if tail == 2 else (6, "II", (("user", ""), ("assistant", "")))
        found = []

        def go(extra, letter, turn, j, then):
            cost, letters, turns = best(j, then)
            found.append((cost + extra, letter + letters, (*([turn] if turn else []), *turns)))

        _, role, text = rows[i]
        go(4, "D", None, i + 1, tail)
        consume(i, tail, faults[i], role, text, go)
        for n in (1, 2):  # inserts before the row
            t, put = tail, []
            for _ in range(n):
                put.append("assistant" if t == 2 else "user")
                t = 3 if t == 2 else 2

            def later(extra, letter, turn, j, then, n=n, put=put):
                cost, letters, turns = best(j, then)
                found.append((cost + extra + 3 * n, "I" * n + letter + letters, (*((p, "") for p in put), *([turn] if turn else []), *turns)))

            later(4, "D", None, i + 1, t)
            consume(i, t, faults[i], role, text, later)
        return min(found)

    def consume(i, tail, fault, role, text, go):
        if fault in ("blank", "duplicate"):
            return
        more = 3 if fault == "truncated" else 0
        ok = {"s": tail == 0, "u": tail in (0, 1, 3), "a": tail == 2}.get(role[:1], False)
        if ok:
            go(more, "K", (role, text), i + 1, {"s": 1, "u": 2, "a": 3}[role[0]])
        go(3 + more, "R", ("assistant" if tail == 2 else "user", text), i + 1, 3 if tail == 2 else 2)

    cost, audit, turns = best(0, 0)
    assert DONE.match("".join(r[:1] for r, _ in turns))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def reports(rows):
    """The query's result by the plain version."""
    out = {c: [] for c, *_ in rows}
    for conv, *row in damaged(rows):
        out[conv].append(tuple(row))
    return {c: plain(r) for c, r in out.items()}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def odd(seed, convs=60, most=9):
    rng = random.Random(seed)
    texts = ["", " \t", "Yes.", "No", "why?", "é…", "ends. ", None, "Stop!\n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"]
    rows = [(c, rng.choice([None, *range(2 * most)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(convs)] for _ in range(rng.randrange(1, most))]
    return rows + rows[:40]


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_query_against_the_plain_version(spark, monkeypatch, chunk):
    whole = conversations.report
    monkeypatch.setattr(conversations, "report", lambda df: whole(df, chunk=chunk))
    rows = odd(chunk, 150)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    monkeypatch.setattr(queries, "read", lambda *_: df.repartition(3))
    got = queries.op12_conversations(spark, "").collect()
    want = reports(rows)
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[c] for c in FIELDS) for r in got} == want


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversations(spark, SF).collect()
    assert {r.conv_id: tuple(r[c] for c in FIELDS) for r in got} == reports(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([i | f << 2 for i in range(4) for f in range(4)]), min_size=1, max_size=12), st.integers(1, 5))
def test_digests_of_parts_tell_the_whole(symbols, size):
    whole = np.array(symbols, np.uint8)
    (inserted, letters, last), = conversations.edits([whole], [0], [0])
    parts = [whole[i : i + size] for i in range(0, len(whole), size)]
    told = conversations.digests(parts)
    after, ends = 0, []
    for d in reversed(told):
        ends.insert(0, after)
        after = d[after]
    starts, state = [], 0
    for d, v in zip(told, ends, strict=True):
        starts.append(state)
        state = d[len(conversations.VECTORS) + 4 * v + state]
    found = conversations.edits(parts, ends, starts)
    assert state == last == found[-1][2]
    assert np.concatenate([f[1] for f in found]).tolist() == letters.tolist()
    assert np.concatenate([f[0] for f in found]).tolist() == inserted.tolist()


def test_one_long_conversation_is_dealt_over_ranges(spark):
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"say {i}.", f"cut {i}", "again."])) for i in range(6000)] + [(c, 0, "user", "hi.") for c in range(10, 40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {r.conv_id: r for r in conversations.report(df).collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    (inserted, letters, last), = conversations.edits([np.array([conversations.INITIAL[r[0]] | conversations.fault(t, False) << 2 for _, r, t in _marked(by[7])], np.uint8)], [0], [0])
    audit = "".join("I" * i + chr(x) for i, x in zip(inserted.tolist(), letters.tolist(), strict=True)) + conversations.CLOSING[last]
    assert got[7].audit == audit and got[10].audit == "KI" and len(got) == 31
    turns = conversations.repair(df).where("conv_id = 7").orderBy("position").collect()
    assert [t.position for t in turns] == list(range(got[7].n_repaired))
    assert sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got[7].repaired_sha256
    assert "".join(t.edit for t in turns) == audit.replace("D", "")


def _marked(turns):
    """Duplicates as blanks: both must go."""
    said = set()
    for i, role, text in turns:
        yield i, role, "" if (role, text) in said else text
        said.add((role, text))


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.report(none).count() == 0 and conversations.repair(conversations.damage(none)).count() == 0
    df = spark.createDataFrame([("a", 1, "user", "x.", 1, 2), ("a", 2, "assistant", "y" * 100_000 + ".", 3, 4)], "conv_id string, turn int, role string, text string, kind int, conv int")
    (r,) = conversations.report(df).collect()
    assert (r.conv_id, r.audit, r.cost) == ("a", "KK", 0)
