"""Text operators, all as expressions. A null text counts as empty, so counts are 0."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.registry import Fitted, OperatorError, builds, declare, register, spread

# The stop words of the English fallback list.
STOP_WORDS = """
a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both
each few more most other some such no nor not only own same so than too very s t can will just don should now i me my
myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing would could should ought i'm you're he's she's it's we're they're i've you've we've they've i'd you'd he'd
she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't
didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's
why's how's
""".split()

# The words of the two sentiment lists.
POSITIVE = """
good great excellent amazing wonderful fantastic terrific outstanding superb awesome best happy love like positive beautiful
perfect joy grateful impressive easy useful
""".split()
NEGATIVE = """
bad awful terrible horrible worst poor negative hate dislike disappointed disappointing difficult useless ugly hard problem
issues complaint fail failure wrong error
""".split()


#: Words that may tie with the last of the most frequent ones, before groups of all words are counted.
FEW = 1000


def text(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise OperatorError(f"{column!r} is not a text")
    return _plain(column)


def _plain(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def tokens(t: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(t, "\\s+"), lambda w: w != "")


def regex_words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?U)\\b\\w+\\b"), F.lit(0))


def _op(name: str, rule) -> None:
    declare("text", name, lambda columns, s, **params: rule(_plain(columns[0]), **params), check=lambda df, columns: text(df, columns[0]))


def _count_in(words: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(wanted)))


def _stop_words(t: Column, language: str = "english", words: list[str] | None = None) -> Column:
    """English has a fixed list; other languages take Spark's."""
    if words is None and language != "english":
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords(language)
    return _count_in(tokens(F.lower(t)), words if words is not None else STOP_WORDS)


def _sentiment(t: Column) -> Column:
    words = regex_words(F.lower(t))
    pos, neg = _count_in(words, POSITIVE), _count_in(words, NEGATIVE)
    return F.coalesce(F.try_divide(pos.cast("double"), (pos + neg).cast("double")), F.lit(0.5))


def _readability(t: Column) -> Column:
    sentences = F.filter(F.split(t, "[.!?]+"), lambda s: F.length(F.regexp_replace(s, "(?U)\\s", "")) > 0)
    # Words of the sentences are the words of the text: the marks that end sentences are in no word.
    words = regex_words(t)
    n, m = F.size(words), F.size(sentences)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    hard = F.try_divide(letters.cast("double"), n.cast("double")) * 0.1 + F.try_divide(n.cast("double"), m.cast("double")) * 0.05
    return F.coalesce(1.0 - F.least(F.lit(1.0), hard), F.lit(0.5))


def _embedding(t: Column) -> Column:
    words = tokens(F.lower(t))
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.pmod(spread(w), F.lit(1000)))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(words).cast("double")) / 1000, F.lit(0.0))


_op("word_count", lambda t: F.size(tokens(t)))
_op("char_count", F.length)
_op("stop_word_count", _stop_words)
_op("unique_word_count", lambda t: F.size(F.array_distinct(tokens(F.lower(t)))))
_op("unique_char_count", lambda t: F.size(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))))
_op("uppercase_count", lambda t: F.regexp_count(t, F.lit("\\p{Lu}")))
_op("lowercase_count", lambda t: F.regexp_count(t, F.lit("\\p{Ll}")))
_op("punctuation_count", lambda t: F.regexp_count(t, F.lit("\\p{Punct}")))
_op("word_embeddings", _embedding)
_op("sentiment_score", _sentiment)
_op("readability_score", _readability)


def vocabulary(df: DataFrame, column: str, most: int, stop: list[str] | None = None, ngrams: int = 1) -> tuple[list[tuple[str, int]], int]:
    """The `most` most frequent terms of two or more word characters (ties: lowest first), in alphabetical order, with the
    number of rows that have each; and the number of rows."""
    t = text(df, column)
    top = _top(df, _terms(t, stop, 1), most + (FEW if ngrams > 1 else 0))
    if ngrams > 1:
        # No group of words is more frequent than its words: those below the last of the most frequent words are in none that counts.
        least = top[most - 1].n if len(top) >= most > 0 else 0
        only = [r.t for r in top if r.n >= least]
        known = least > 0 and len(only) < most + FEW
        words = _terms(t, stop, 1)
        top = top + _top(df, _let(words, lambda ws: _ngrams(ws, ngrams, only if known else None, single=False)), most)
    top = sorted(top, key=lambda r: (-r.n, r.t.encode()))[:most]
    return sorted((r.t, r.d) for r in top), df.count()


def _top(df: DataFrame, terms: Column, most: int) -> list:
    """(t, n, d): the most frequent terms, their number and the rows that have them. They are summed where they stand: a row's are not
    shuffled by row, only each task's distinct ones by term."""
    told = _let(terms, lambda ts: F.concat(F.transform(ts, lambda t: F.struct(t.alias("t"), F.lit(1).alias("n"), F.lit(0).alias("d"))), F.transform(F.array_distinct(ts), lambda t: F.struct(t.alias("t"), F.lit(0).alias("n"), F.lit(1).alias("d")))))
    return df.select(F.inline(told)).groupBy("t").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).orderBy(F.desc("n"), "t").limit(most).collect()


def _terms(t: Column, stop: list[str] | None, ngrams: int) -> Column:
    words = F.regexp_extract_all(F.lower(t), F.lit("(?U)\\b\\w\\w+\\b"), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return words if ngrams == 1 else _let(words, lambda found: _ngrams(found, ngrams))


def _ngrams(words: Column, most: int, only: list[str] | None = None, single: bool = True) -> Column:
    """The words and their neighbours joined, up to `most`; with `only`, groups of these words alone."""
    out = words if single else F.array().cast("array<string>")
    for n in range(2, most + 1):
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        if only is not None:
            places = F.filter(places, lambda i: reduce(Column.__and__, [F.get(words, i + (j - 1)).isin(only) for j in range(n)]))  # noqa: B023
        out = F.concat(out, _joined(words, places, n))
    return out


def _joined(words: Column, places: Column, n: int) -> Column:
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: within a lambda an outer expression would run for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def term_counts(t: Column, terms: list[str], stop: list[str] | None = None, ngrams: int = 1) -> Column:
    """How often each of the terms is in a text, as an array."""
    if not terms:
        return F.array().cast("array<int>")
    wanted = F.array(*[F.lit(x) for x in terms])
    return _let(_terms(t, stop, ngrams), lambda found: F.transform(wanted, lambda x: F.size(F.filter(found, lambda w: w == x))))


def tfidf_array(t: Column, vocab: tuple[list[tuple[str, int]], int], stop: list[str] | None = None, ngrams: int = 1) -> Column:
    """Count times ln((1 + rows) / (1 + rows with the term)) + 1 for each term, at length one, as an array."""
    found, n = vocab
    idf = F.array(*[F.lit(math.log((1 + n) / (1 + d)) + 1) for _, d in found]) if found else F.array().cast("array<double>")
    raw = F.zip_with(term_counts(t, [x for x, _ in found], stop, ngrams), idf, lambda c, i: c * i)
    zero = F.lit(0.0)
    return _let(raw, lambda r: _let(F.sqrt(F.aggregate(r, zero, lambda a, x: a + x * x)), lambda size: F.transform(r, lambda x: F.coalesce(F.try_divide(x, size), zero))))


def tfidf_columns(df: DataFrame, column: str, most: int = 10, stop: list[str] | None = None, ngrams: int = 1) -> tuple[DataFrame, list[str]]:
    """Add a column term_0, term_1, ... for each of the most frequent terms, with its TF-IDF; and the terms."""
    vocab = vocabulary(df, column, most, stop, ngrams)
    wide = df.withColumn("__terms", tfidf_array(text(df, column), vocab, stop, ngrams))
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__terms")[i].alias(f"term_{i}") for i in range(len(vocab[0]))]), [t for t, _ in vocab[0]]


def count_columns(df: DataFrame, column: str, most: int = 100, stop: list[str] | None = None, ngrams: int = 1) -> tuple[DataFrame, list[str]]:
    """Add a column term_0, term_1, ... for each of the most frequent terms, with its count; and the terms."""
    terms = [t for t, _ in vocabulary(df, column, most, stop, ngrams)[0]]
    wide = df.withColumn("__terms", term_counts(text(df, column), terms, stop, ngrams))
    return wide.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__terms")[i].alias(f"term_{i}") for i in range(len(terms))]), terms


@register("text")
def tfidf(df: DataFrame, column: str, out: str | None = None, max_features: int = 10) -> Fitted:
    """The TF-IDF of the alphabetically first of the most frequent terms; tfidf_columns() has all."""
    vocab = vocabulary(df, column, max_features)
    return Fitted("tfidf", [column], out or f"tfidf({column})", state={"vocabulary": vocab[0], "rows": vocab[1]})


@builds("tfidf")
def _first_term(columns: list[str], s: dict) -> Column:
    return tfidf_array(_plain(columns[0]), ([tuple(x) for x in s["vocabulary"]], s["rows"]))[0] if s["vocabulary"] else F.lit(0.0)
