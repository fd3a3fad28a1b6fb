"""Queries of text operators on odd texts, against their SQL."""

import duckdb
import pytest

from tessella import registry
from tessella.plans import catalog
from tests.helpers import same_rows

TEXTS = ["", "aab", " ", "ée", "\U0001f600a\U0001f600", "a\nb\r\n", "日本日", "A a"]


@pytest.mark.parametrize("name", ["unique_char_count", "char_count", "word_count", "unique_word_count"])
def test_counts_of_odd_texts(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same_rows(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])


def test_no_character_in_an_empty_text(spark):
    """The operator's own count: the 1 of the query's SQL is of a piece, not of a character."""
    df = spark.createDataFrame([(1, ""), (2, None), (3, "aab")], "i int, t string")
    got = registry.fit(df, "unique_char_count", "t", out="n").transform(df).orderBy("i").collect()
    assert [r.n for r in got] == [0, 0, 2]
