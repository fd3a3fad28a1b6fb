"""Repair of the structure of conversations by a time-major dynamic programme over turns.

A repaired conversation has the role initials (s?(ua)+)?. Four states tell how far a prefix of it has come; keeping, re-roling
or deleting a turn, and inserting one before it, moves between them at a cost. Conversations (or parts of long ones) of one
length are the columns of a tensor: a step goes back over one turn of all of them at once and stores each state's cost to
the end, and the cheapest edits are then traced forward, again for all columns at once.

Turns are sorted by range, so a conversation of any length is dealt over tasks. There it is cut into parts of CHUNK turns.
Backward costs, less their least, take few different values (VECTORS). A part tells for each of them at its end which one
its beginning has, and in which state each start ends: from these digests alone follow the costs and the start of every part.
Only the audit string and the hash of a whole conversation, single values by nature, are put together in one task, from
a row for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import Scratch, lean, ship

#: Turns, and characters of text, of a part; one turn at least.
CHUNK, CHUNK_CHARS = 256, 1_000_000
#: Numbers in a cost tensor at most.
TENSOR = 8_000_000
START, SYSTEM, USER, ASSISTANT = range(4)
#: A turn's symbol: its role's initial (s, u, a, other) and four times its fault.
INITIAL = {"s": 0, "u": 1, "a": 2}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
FAR = 1 << 28
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
WITH_TRUNCATED = 3
#: Cost to finish from each state when no turn is left, and how.
END, CLOSING = np.array([0, 2 * INSERT, INSERT, 0], np.int32), ("", "II", "I", "")
#: Where an inserted or re-roled turn leads from each state, and its role.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
SPACE = " \t\n\x0b\f\r"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By state and symbol: where a kept turn leads, what it costs; by symbol: what a re-roled one costs."""
    to, cost, again = np.zeros((4, 16), np.int64), np.full((4, 16), FAR, np.int32), np.full(16, FAR, np.int32)
    for symbol in range(16):
        initial, fault = symbol & 3, symbol >> 2
        if fault in (BLANK, DUPLICATE):
            continue
        more = WITH_TRUNCATED if fault == TRUNCATED else 0
        again[symbol] = REROLE + more
        for state in range(4):
            if (state, initial) in LEGAL:
                to[state, symbol], cost[state, symbol] = LEGAL[state, initial], KEEP + more
    return to, cost, again


KEPT_TO, KEPT_COST, AGAIN_COST = _tables()


def _back(after: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Costs to the end before a turn, from those after it: (4, n) from (4, n)."""
    at = np.arange(after.shape[1])
    best = np.empty_like(after)
    for s in range(4):
        best[s] = np.minimum(after[s] + DELETE, after[KEPT_TO[s, symbol], at] + KEPT_COST[s, symbol])
        np.minimum(best[s], after[AFTER[s]] + AGAIN_COST[symbol], out=best[s])
    user = np.minimum(best[USER], best[ASSISTANT] + INSERT)
    best[ASSISTANT] = np.minimum(best[ASSISTANT], best[USER] + INSERT)
    best[USER] = user
    for s in (START, SYSTEM):
        best[s] = np.minimum(best[s], user + INSERT)
    return best


def backward(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(t + 1, 4, n) costs to the end, for symbols (t, n) and costs (4, n) after the last turn."""
    costs = np.empty((len(symbols) + 1, *ends.shape), np.int32)
    costs[-1] = ends
    for t in range(len(symbols) - 1, -1, -1):
        costs[t] = _back(costs[t + 1], symbols[t])
    return costs


def trace(costs: np.ndarray, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(turns inserted before each turn (t, n), letter of each turn (t, n), last state (n)): the cheapest edits whose letters
    are least. A state and a letter tell the next state, so the least letter at each step is the least string."""
    n = symbols.shape[1]
    at, after = np.arange(n), np.array(AFTER)
    inserted, letters = np.zeros(symbols.shape, np.uint8), np.empty(symbols.shape, np.uint8)
    for t, symbol in enumerate(symbols):
        now, then = costs[t], costs[t + 1]
        for _ in range(2):  # three inserts would come back to where one leads
            put = (then[state, at] + DELETE != now[state, at]) & (now[after[state], at] + INSERT == now[state, at])
            inserted[t] += put
            state = np.where(put, after[state], state)
        want = now[state, at]
        gone = then[state, at] + DELETE == want
        kept_to = KEPT_TO[state, symbol]
        kept = then[kept_to, at] + KEPT_COST[state, symbol] == want
        letters[t] = np.where(gone, ord("D"), np.where(kept, ord("K"), ord("R")))
        state = np.where(gone, state, np.where(kept, kept_to, after[state]))
    return inserted, letters, state


def _vectors() -> tuple[np.ndarray, np.ndarray]:
    """All values that costs, less their least, can take before any turns; and the number of each by its four digits."""
    known, every = [tuple(END.tolist())], np.arange(16)
    for v in known:
        made = _back(np.repeat(np.array(v, np.int32)[:, None], 16, axis=1), every)
        known += [w for w in dict.fromkeys(map(tuple, (made - made.min(axis=0)).T.tolist())) if w not in known]
    vectors = np.array(known, np.int32)
    number = np.zeros(1 << 16, np.uint8)
    number[_digits(vectors.T)] = np.arange(len(vectors))
    return vectors, number


def _digits(vectors: np.ndarray) -> np.ndarray:
    return vectors[0] | vectors[1] << 4 | vectors[2] << 8 | vectors[3] << 12


VECTORS, NUMBER = _vectors()


def _by_length(parts: list[np.ndarray], copies: int = 1) -> Iterator[tuple[list[int], np.ndarray]]:
    """(which, symbols (t, n)) for parts of one length each, as many as a tensor holds in so many copies."""
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    i = 0
    while i < len(order):
        size = len(parts[order[i]])
        most = max(1, TENSOR // (4 * copies * (size + 1)))
        j = i + 1
        while j < len(order) and j - i < most and len(parts[order[j]]) == size:
            j += 1
        yield order[i:j], np.stack([parts[k] for k in order[i:j]], axis=1).astype(np.int64)
        i = j


def digests(parts: list[np.ndarray]) -> list[bytes]:
    """For each part and each vector after it: the vector before it, and the state in which each start state ends."""
    v = len(VECTORS)
    out = [b""] * len(parts)
    for which, symbols in _by_length(parts, 4 * v):
        n = len(which)
        wide = np.repeat(symbols, v, axis=1)
        costs = backward(wide, np.tile(VECTORS.T, n))
        before = NUMBER[_digits(costs[0] - costs[0].min(axis=0))].reshape(n, v)
        ends = np.stack([trace(costs, wide, np.full(n * v, s))[2] for s in range(4)], axis=1).reshape(n, v * 4).astype(np.uint8)
        for k, i in enumerate(which):
            out[i] = before[k].tobytes() + ends[k].tobytes()
    return out


def edits(parts: list[np.ndarray], ends: list[int], starts: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(inserts, letters, last state) of each part, given the number of the vector after it and its start state."""
    out: list = [None] * len(parts)
    for which, symbols in _by_length(parts):
        costs = backward(symbols, VECTORS[[ends[i] for i in which]].T)
        inserted, letters, last = trace(costs, symbols, np.array([starts[i] for i in which]))
        for k, i in enumerate(which):
            out[i] = inserted[:, k], letters[:, k], int(last[k])
    return out


def fault(text: str, duplicate: bool) -> int:
    """A turn's first fault."""
    told = text.rstrip(SPACE)
    return BLANK if not told else DUPLICATE if duplicate else TRUNCATED if told[-1] not in ".!?" else NONE


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults by crc32("conv:turn") modulo 20: 0 drops a turn, 1 empties it, 2 takes its marks
    . ! ? away, 3 repeats it, 4 gives it the role user. Nulls in role, text and in the hashed string are one space; a null
    conv or turn stays null. Rows alike are damaged alike; no rows give none."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn, role, text)]
    how = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20
    made = df.select(F.col(conv), F.col(turn), F.when(how == 4, F.lit("user")).otherwise(said[2]).alias(role), F.when(how == 1, F.lit("")).when(how == 2, F.translate(said[3], ".!?", "")).otherwise(said[3]).alias(text), how.alias("__how"))
    twice = F.when(F.col("__how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return made.where("__how <> 0").withColumn("__copy", F.explode(twice)).drop("__how", "__copy")


def _parts(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int) -> DataFrame:
    """Rows (conv, kind, part, idx, digest, turns, roles, texts, symbols): for each part of a conversation one with its turns
    (kind 1), and one with its digest (kind 0) where the conversation may have other parts."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    said = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    named = said.withColumn("h", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).withColumn("copy", F.monotonically_increasing_id())
    rows = scratch.keep(named, "turns")
    # Only what a conversation says twice is looked up; a table on that side lets the planner split a frequent saying.
    seen = rows.groupBy("conv", "h").agg(F.min(F.struct("turn", "copy")).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = scratch.keep(seen.select(F.col("conv").alias("c"), F.col("h").alias("s"), F.col("first.copy").alias("first")), "sayings")
    told = rows.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("s")), "left")
    told = told.select("conv", "turn", "role", "text", (F.col("first").isNotNull() & (F.col("first") != F.col("copy"))).alias("again"), "h", "copy")
    order = [F.col("conv"), F.col("turn"), F.substring("role", 1, 16), F.substring("text", 1, 48), F.col("h"), F.col("copy")]
    kind = df.schema[conv].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.IntegerType()) for c in ("kind", "part", "idx")), T.StructField("digest", T.BinaryType())])
    schema = schema.add("turns", T.ArrayType(T.LongType())).add("roles", T.ArrayType(T.StringType())).add("texts", T.ArrayType(T.StringType())).add("symbols", T.BinaryType())
    return told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "again").mapInArrow(lean(lambda batches: _cut(batches, chunk)), schema)


def _cut(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns of one range into parts."""
    part = TaskContext.get().partitionId()
    conv, idx, begun, size = None, 0, False, 0
    alone = False  # the conversation began in this range, after another one
    turns: list = []
    done: list = []

    def close(ends: bool) -> None:
        nonlocal turns, size, idx
        done.append((conv, idx, alone and ends and idx == 0, turns))
        turns, size, idx = [], 0, idx + 1

    def flush(names) -> pa.RecordBatch:
        codes = [np.array([INITIAL.get(role[:1], 3) | fault(text, again) << 2 for _, role, text, again in t], np.uint8) for *_, t in done]
        shared = [i for i, d in enumerate(done) if not d[2]]
        told = digests([codes[i] for i in shared])
        rows = [(done[i][0], 0, part, done[i][1], d, None, None, None, None) for i, d in zip(shared, told, strict=True)]
        rows += [(c, 1, part, i, None, *([x[k] for x in t] for k in range(3)), s.tobytes()) for (c, i, _, t), s in zip(done, codes, strict=True)]
        done.clear()
        columns = list(zip(*rows, strict=True))
        types = [names, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv", "kind", "part", "idx", "digest", "turns", "roles", "texts", "symbols"])

    names, held = None, 0
    for b in batches:
        names = b.schema.field(0).type
        for c, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if not begun or c != conv:
                if begun:
                    close(True)
                alone, conv, idx, begun = begun, c, 0, True
            elif len(turns) >= chunk or size >= CHUNK_CHARS:
                close(False)
            turns.append(row)
            size += len(row[2])
            held += len(row[2])
            if held > 4 * CHUNK_CHARS and done:
                yield flush(names)
                held = 0
        if done:
            yield flush(names)
            held = 0
    if begun:
        close(False)
        yield flush(names)


class _Report:
    """What is known of one conversation while its parts come by."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.n = conv, sha256(), [], 0
        self.faults, self.illegal, self.cost = np.zeros(4, np.int64), 0, 0
        self.low = self.high = self.last = None
        self.distinct = 0

    def add(self, turns: list, symbols: np.ndarray, inserted: np.ndarray, letters: np.ndarray, closing: str) -> None:
        initials = symbols & 3 if self.last is None else np.concatenate([[self.last], symbols & 3])
        self.illegal += int(np.sum(~np.isin(initials[:-1] * 4 + initials[1:], (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))))
        self.last = int(initials[-1])
        self.faults += np.bincount(symbols >> 2, minlength=4)
        for t in turns:  # sorted, nulls first
            if t is not None and t != self.high:
                self.low, self.high, self.distinct = t if self.low is None else self.low, t, self.distinct + 1
        self.cost += int(INSERT * (inserted.sum() + len(closing)) + DELETE * (letters == ord("D")).sum() + REROLE * (letters == ord("R")).sum() + WITH_TRUNCATED * ((symbols >> 2 == TRUNCATED) & (letters != ord("D"))).sum())
        self.audit.append("".join("I" * i + chr(x) for i, x in zip(inserted.tolist(), letters.tolist(), strict=True)) + closing)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, int(self.faults.sum()), self.n, gaps, *self.faults[1:].tolist(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


LONG, STRING = (T.LongType(), pa.int64()), (T.StringType(), pa.string())
REPORT = {"n_turns": LONG, "n_repaired": LONG, "gaps": LONG, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "cost": LONG, "audit": STRING, "repaired_sha256": STRING}
TURNS = {"position": LONG, "turn": LONG, "role": STRING, "text": STRING, "edit": STRING}


def _repaired(state: int, turns: list, roles: list, texts: list, inserted: np.ndarray, letters: np.ndarray, closing: str) -> Iterator[tuple]:
    """(turn, role, text, letter) of the repaired part."""

    def put(n: int) -> Iterator[tuple]:
        nonlocal state
        for _ in range(n):
            state = AFTER[state]
            yield None, ROLE[state], "", "I"

    for turn, role, text, n, letter in zip(turns, roles, texts, inserted.tolist(), letters.tolist(), strict=True):
        yield from put(n)
        if letter == ord("K"):
            state = LEGAL[state, INITIAL[role[0]]]
            yield turn, role, text, "K"
        elif letter == ord("R"):
            state = AFTER[state]
            yield turn, ROLE[state], text, "R"
    yield from put(len(closing))


def _walk(batches: Iterator[pa.RecordBatch], whole_turns: bool) -> Iterator[pa.RecordBatch]:
    """Parts in order into reports, or into repaired turns."""
    fields, names = TURNS if whole_turns else REPORT, None
    report, begun, now = None, False, None
    told: list[bytes] = []  # digests of the conversation's parts
    plan: list[tuple[int, int]] = []  # vector after each part, start state of each part
    at = 0

    def planned() -> None:
        """Vectors from the last part to the first, then states from the first to the last."""
        plan.clear()
        size, after, state = len(VECTORS), 0, START
        for d in reversed(told):
            plan.append((after, 0))
            after = d[after]
        plan.reverse()
        for i, d in enumerate(told):
            v = plan[i][0]
            plan[i] = v, state
            state = d[size + 4 * v + state]
        told.clear()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [names, *(t for _, t in fields.values())], strict=True)], names=["conv", *fields])

    for b in batches:
        names = b.schema.field(0).type
        rows = list(zip(*(x.to_pylist() for x in b.columns), strict=True))
        # First what each part of the batch is given, then all of them at once.
        given, heads = [], []
        for conv, kind, digest, *_, symbols in rows:
            if not begun or conv != report:
                report, begun, at = conv, True, 0
                told.clear()
                plan.clear()
                heads.append(True)
            else:
                heads.append(False)
            if kind == 0:
                told.append(digest)
                continue
            if told:
                planned()
            v, s = plan[at] if plan else (0, START)
            last = not plan or at == len(plan) - 1
            at += 1
            given.append((np.frombuffer(symbols, np.uint8).astype(np.int64), v, s, last))
        found = iter(zip(edits([g[0] for g in given], [g[1] for g in given], [g[2] for g in given]), given, strict=True))
        out: list[tuple] = []
        for (conv, kind, _, turns, roles, texts, _), head in zip(rows, heads, strict=True):
            if head:
                if now is not None and not whole_turns:
                    out.append(now.row())
                now = _Report(conv)
            if kind == 0:
                continue
            (inserted, letters, end), (symbols, _, start, last) = next(found)
            closing = CLOSING[end] if last else ""
            now.add(turns, symbols, inserted, letters, closing)
            for turn, role, text, letter in _repaired(start, turns, roles, texts, inserted, letters, closing):
                now.hash.update(("\n" * (now.n > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                if whole_turns:
                    out.append((conv, now.n, turn, role, text, letter))
                now.n += 1
        if out:
            yield batch(out)
    if now is not None and not whole_turns:
        yield batch([now.row()])


def _run(df: DataFrame, conv: str, turn: str, role: str, text: str, chunk: int, whole_turns: bool) -> DataFrame:
    parts = _parts(df, conv, turn, role, text, chunk).repartition("conv").sortWithinPartitions("conv", "kind", "part", "idx")
    schema = T.StructType([T.StructField("conv", df.schema[conv].dataType), *(T.StructField(c, t) for c, (t, _) in (TURNS if whole_turns else REPORT).items())])
    fed = parts.select("conv", "kind", "digest", "turns", "roles", "texts", "symbols")
    return fed.mapInArrow(lean(lambda batches: _walk(batches, whole_turns)), schema).withColumnRenamed("conv", conv)


def report(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of the table: turns, faults, cost and letters of the cheapest edits, hash of the repaired text.

    Turns stand by turn (nulls first), then by role, text and their hash. Null roles and texts count as one space; null convs are
    one conversation; other columns are not looked at; an empty table gives an empty result. A role is known by its first
    character. Ties between edits go to the least string of letters.
    """
    return _run(df, conv, turn, role, text, chunk, False)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv, position, turn, role, text, edit): the turns of each repaired conversation in order; edit is K, R or I (turn null).

    Orders, nulls and empty tables as in report(); a conversation of which nothing is left has no rows.
    """
    return _run(df, conv, turn, role, text, chunk, True)
