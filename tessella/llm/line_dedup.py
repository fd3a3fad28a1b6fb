"""Line de-duplication by a suffix array over line numbers, built by distributed prefix doubling.

Only DataFrame functions run. Lines that occur once cannot be part of a repeated run, so the rounds start from the
others. Round k holds the suffixes that share their first 2^k lines with another suffix, ranked in their sort order: equal
ranks are the intervals of suffixes whose longest common prefix is 2^k lines at least. A pair of ranks, of a suffix and of
the one 2^k lines further, is the key of the next round; suffixes whose key is alone leave, for they share fewer lines
with any other.

The rounds then give each suffix its longest common prefix with an earlier suffix, line for line: the highest round whose
interval has an earlier member bounds it between 2^k and 2^(k+1), and a binary search settles it, for two ranks of round k
name the interval of any depth between. These lengths are the maximal runs that repeat something before them, and their
lines go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, without


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _place() -> Column:
    """Where a suffix starts; its order says which of two is earlier."""
    return F.struct("k", "h", "seq")


def _ranked(scratch: Scratch, keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """Number distinct keys in their sort order: rising within and across the ranges of the sort."""
    return scratch.table(keys.orderBy(*cols).withColumn("rank_new", F.monotonically_increasing_id()), name)


def suffix_rounds(scratch: Scratch, lines: DataFrame) -> list[DataFrame]:
    """Rounds k = 0, 1, ...: (k, h, seq, rank, later) of the suffixes that share 2^k lines with another; later: an earlier one
    does. Only the first one can be empty.

    lines: (k, h, seq, id) with seq rising by one along a document's lines.
    """
    shared = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").select("id", "first")
    # A table of ranks, so that the planner can split the join where a line is hot.
    ranks = _ranked(scratch, shared, ["id"], "rank0")
    now = scratch.table(lines.join(ranks, "id").select("k", "h", "seq", F.col("rank_new").alias("rank"), (~_place().eqNullSafe(F.col("first"))).alias("later")), "round0")
    rounds, step = [now], 1
    scratch.drop(ranks)
    while True:
        ahead = F.expr(f"first_value(rank) over (partition by k, h order by seq range between {step} following and {step} following)")
        pairs = scratch.table(now.select("k", "h", "seq", "rank", ahead.alias("next")).where("next is not null"), f"pairs{step}")
        keys = pairs.groupBy("rank", "next").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").select("rank", "next", "first")
        ranks = _ranked(scratch, keys, ["rank", "next"], f"rank{2 * step}")
        if ranks.isEmpty():
            break
        now = scratch.table(pairs.join(ranks, ["rank", "next"]).select("k", "h", "seq", F.col("rank_new").alias("rank"), (~_place().eqNullSafe(F.col("first"))).alias("later")), f"round{2 * step}")
        scratch.drop(pairs, ranks)
        rounds.append(now)
        step *= 2
    return rounds


def longest_prefixes(scratch: Scratch, rounds: list[DataFrame], least: int = 1) -> DataFrame:
    """(k, h, seq, run, first): the longest common prefix of a suffix with an earlier one, in lines, and the earliest place of
    so long a prefix; of suffixes for which it is `least` lines or more.

    A suffix stands at the highest round k in which it has an earlier partner, as one to be settled (open), and at the rounds
    above as a partner of others. A step of the search asks of all suffixes at once whether they share 2^m more lines: (rank
    at the start, rank 2^k lines before the end) names the interval. Those with an earlier member go on there, and that
    member goes on beside them as a partner; it and the rest stay where they were too.
    """
    top, low = len(rounds) - 1, least.bit_length() - 1
    every = reduce(DataFrame.unionByName, [r.withColumn("level", F.lit(k)) for k, r in enumerate(rounds)][low:] or [rounds[0].where("false").withColumn("level", F.lit(0))])
    highest = F.expr("max(if(later, level, -1)) over (partition by k, h, seq)")
    stand = every.withColumn("highest", highest).where("level >= highest")
    run = F.expr("shiftleft(1L, level)")
    start = scratch.table(stand.select("k", "h", "seq", "level", (F.col("level") == F.col("highest")).alias("open"), run.alias("run"), F.col("rank").alias("a"), F.col("rank").alias("b")), "search")
    end = every.select(F.col("k").alias("rk"), F.col("h").alias("rh"), F.col("seq").alias("rs"), F.col("level").alias("rl"), F.col("rank").alias("c"))
    keys, done = ["level", "run", "a", "c"], None
    for m in range(top - 1, -1, -1):
        # What round m + 1 bounds has its first step here.
        now = start.where(F.col("level") == m + 1)
        now = now if done is None else done.unionByName(now)
        at = F.expr(f"seq + run + {1 << m} - shiftleft(1, level)")
        # Null keys are one key, and a hash stands for one text.
        asked = now.withColumn("at", at).join(end.where(F.col("rl") > m), F.col("k").eqNullSafe(F.col("rk")) & (F.col("h") == F.col("rh")) & (F.col("at") == F.col("rs")) & (F.col("level") == F.col("rl")), "left")
        asked = scratch.table(asked.select("k", "h", "seq", "level", "open", "run", "a", "b", "c"), f"asked{m}")
        firsts = asked.where("c is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.min(_place()).alias("first"), F.max("open").alias("wanted")).where("n > 1 and wanted").select(*keys, "first")
        firsts = scratch.table(firsts, f"firsts{m}")
        stay = F.struct("open", "run", "b")
        go = F.struct((F.col("open") & ~_place().eqNullSafe(F.col("first"))).alias("open"), (F.col("run") + (1 << m)).alias("run"), F.col("c").alias("b"))
        to = F.when(F.col("first").isNull(), F.array(stay)).when(_place().eqNullSafe(F.col("first")), F.array(stay, go)).otherwise(F.array(go))
        met = asked.join(firsts, keys, "left").select("k", "h", "seq", "level", "a", F.explode(to).alias("to"))
        before, done = done, scratch.table(met.select("k", "h", "seq", "level", "a", "to.*"), f"search{m}")
        scratch.drop(asked, firsts, *([] if before is None else [before]))
    # Round 0 has nothing to be asked.
    rest = start.where(F.col("level") == 0) if low == 0 else None
    now = rest if done is None else done if rest is None else done.unionByName(rest)
    now = start if now is None else now
    keys = ["level", "run", "a", "b"]
    firsts = scratch.table(now.groupBy(*keys).agg(F.min(_place()).alias("first"), F.max("open").alias("wanted")).where("wanted").select(*keys, "first"), "earliest")
    return now.where("open").join(firsts, keys).select("k", "h", "seq", "run", "first").where(F.col("run") >= least)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 2, passage_words: int | None = 50) -> DataFrame:
    """Delete later copies of repeated runs of `min_lines` lines or more; with `passage_words`, also those of repeated single lines
    of so many words or more, whatever their neighbours. Adds n_lines, n_removed, longest_run (longs) and kept_text.

    Lines end at line feeds. Blank lines (white space only) are not part of runs, which go on across them, and they stay.
    The first copy is that of the smallest key, then of the earliest line; nulls come first. Of each suffix of lines the longest
    prefix that also starts earlier is a repeated run; its lines go if they are min_lines or more. Rows alike in key and text
    count as one document and are treated alike; rows of one key and other texts are ordered by a hash of the text. longest_run is
    the number of lines of the longest run of min_lines or more that starts in the document and also starts elsewhere, else 0.
    kept_text joins what is left; null texts stay null, and a text all of whose lines go is "". Texts of any length are split
    whole. Columns with the new names are replaced. An empty table gives an empty result.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    if passage_words is not None and passage_words < 1:
        raise ValueError("passage_words must be positive")
    df = without(df, "n_lines", "n_removed", "longest_run", "kept_text")
    names, inner = df.columns, [f"__{i}" for i in range(len(df.columns))]  # no column of the input can clash with one in here
    df = df.toDF(*inner)
    key, text = inner[names.index(key)], inner[names.index(text)]
    with Scratch(df.sparkSession) as scratch:
        found = scratch.keep(_found(scratch, df, key, text, min_lines, passage_words), "found")
    # The lines are split below the join, once for each row; above it they are a column like any other.
    split = df.select(*[c for c in inner if c != text], F.when(F.col(text).isNotNull(), _lines(F.col(text))).alias("lines"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own"))
    # What was found has no size bound, so it is never broadcast: the join is the same at every size.
    joined = split.join(found.hint("merge"), F.col(key).eqNullSafe(F.col("k")) & (F.col("own") == F.col("h")), "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(rest, lambda i: F.element_at(F.col("lines"), i + 1)), "\n")
    whole = F.array_join("lines", "\n")
    return joined.select(
        *[whole.alias(name) if c == text else F.col(c).alias(name) for name, c in zip(names, inner, strict=True)],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        F.when(F.col("gone").isNull(), whole).otherwise(kept).alias("kept_text"),
    )


def _found(scratch: Scratch, df: DataFrame, key: str, text: str, min_lines: int, passage_words: int | None) -> DataFrame:
    """(k, h, longest, gone): of the documents with a repeated run, its most lines, and the places of the lines that go."""
    base = df.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    # pos counts all lines of a document, seq those that are not blank.
    filled = F.filter(F.transform(_lines(F.col("t")), lambda x, i: F.struct(x.alias("x"), i.alias("pos"))), lambda s: s["x"].rlike("\\S"))
    singles = passage_words is not None and min_lines > 1
    # A line of n words or more has a word and n - 1 times white space with a word after it.
    fields = lambda s: [F.unhex(F.md5(s["x"])).alias("id"), s["pos"].alias("pos")] + ([s["x"].rlike(rf"^\s*+\S++(?:\s++\S++){{{passage_words - 1}}}").alias("passage")] if singles else [])
    exploded = base.select("k", "h", F.posexplode(F.transform(filled, lambda s: F.struct(*fields(s)))).alias("seq", "s")).select("k", "h", "seq", "s.*")
    lines = scratch.table(exploded, "lines")
    # Repeated rows have each place twice; their first lines tell.
    if not lines.where("seq = 0").groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        lines = scratch.table(lines.distinct(), "lines_once")
    rounds = suffix_rounds(scratch, lines.select("k", "h", "seq", "id"))
    runs = scratch.table(longest_prefixes(scratch, rounds, min_lines), "runs")
    # Ends never fall along a document's lines, so a run gives the lines after the end of the one before it.
    before = F.expr("lag(seq + run) over (partition by k, h order by seq)")
    fresh = runs.withColumn("from", F.greatest("seq", F.coalesce(before, F.col("seq")))).where(F.col("from") < F.col("seq") + F.col("run"))
    later = fresh.select("k", "h", F.explode(F.sequence(F.col("from").cast("int"), (F.col("seq") + F.col("run") - 1).cast("int"))).alias("seq"))
    if singles:
        passages = lines.where("passage").select("k", "h", "seq", "id")
        begun = scratch.table(passages.groupBy("id").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1"), "passages")
        later = later.unionByName(passages.join(begun, "id").where(~_place().eqNullSafe(F.col("first"))).select("k", "h", "seq"))
    at = lines.select(F.col("k").alias("lk"), F.col("h").alias("lh"), F.col("seq").alias("ls"), "pos")
    placed = later.distinct().join(at, F.col("k").eqNullSafe(F.col("lk")) & (F.col("h") == F.col("lh")) & (F.col("seq") == F.col("ls")))
    gone = placed.groupBy("k", "h").agg(F.collect_list("pos").alias("gone"))  # a document's own lines at most
    # A run starts in both documents: in the later one and in the first.
    both = runs.select("k", "h", "run").unionByName(runs.select("first.k", "first.h", "run"))
    longest = both.groupBy("k", "h").agg(F.max("run").alias("longest")).withColumnsRenamed({"k": "lk", "h": "lh"})
    same = F.col("k").eqNullSafe(F.col("lk")) & (F.col("h") == F.col("lh"))
    return gone.join(longest, same, "full").select(F.when(F.col("h").isNull(), F.col("lk")).otherwise(F.col("k")).alias("k"), F.coalesce("h", "lh").alias("h"), "longest", "gone")
