"""Edge rows from FIXTURES.md §3 that the driver tables do not reach."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import lexicon as lx
from ledgerlens.operators import retrieval as rt
from ledgerlens.operators import stats


def _vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, ticker string, section string, filing_date date, "
                                       "embedding array<float>")


def test_topk_ties_short_lists_and_empty_year(spark):
    import datetime as dt

    d = dt.date(2020, 1, 1)
    corpus = _vecs(spark, [(3, "A", "MD&A", d, [1.0, 0.0]), (1, "A", "MD&A", d, [1.0, 0.0]),
                           (2, "B", "MD&A", dt.date(2021, 1, 1), [0.0, 1.0])])
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    r = [(x["rank"], x.id) for x in rt.vector_topk(q, corpus, 5).orderBy("rank").collect()]
    assert r == [(1, 1), (2, 3), (3, 2)]  # equal distances break on id; fewer than k candidates
    none = rt.vector_topk_overfetch_year(q, corpus, 2, year=1999, overfetch=3)
    assert none.count() == 0
    few = rt.vector_topk_overfetch_year(q, corpus, 2, year=2021, overfetch=1)
    assert few.count() == 0  # the 2021 row is third, beyond k * overfetch = 2: fewer than k is possible
    pre = rt.vector_topk_overfetch_year(q, corpus, 2, year=2021, mode="prefilter")
    assert [x.id for x in pre.collect()] == [2]
    assert rt.filter_equal_all(corpus, {}).count() == 3


@pytest.mark.parametrize("rows,expected", [
    ([(1.0, 2.0), (2.0, 4.0)], 1.0),
    ([(1.0, 2.0), (2.0, 1.0), (3.0, 0.0)], -1.0),
    ([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], None),
    ([(1.0, None), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], 1.0),
])
def test_correlation_extremes(spark, rows, expected):
    df = spark.createDataFrame(rows, "x double, y double")
    r = stats.pearson(df, "x", "y").collect()[0].r
    s = stats.spearman(df, "x", "y", partitions=2).collect()[0].r
    if expected is None:
        assert r is None and s is None
    else:
        assert r == pytest.approx(expected) and s == pytest.approx(expected)


def test_substantive_and_preview_boundaries(spark):
    a100, a101 = "a" * 100, "a" * 101
    ctx50 = "b" * 43 + "context" + "c" * 60          # 'context' ends at char 50
    ctx51 = "b" * 44 + "context" + "c" * 60          # ends at char 51: cut by the 50-char window
    df = spark.createDataFrame([(a100,), (a101,), (ctx50,), (ctx51,), ("CONTEXT" + "x" * 200,)], "t string")
    flags = [r.f for r in df.select(lx.substantive_answer(F.col("t")).alias("f")).collect()]
    assert flags == [False, True, False, True, False]
    p = spark.createDataFrame([("x" * 300,), ("y" * 301,)], "t string").select(rt.text_preview(F.col("t")).alias("p"))
    got = [r.p for r in p.collect()]
    assert got[0] == "x" * 300 and got[1] == "y" * 300 + "..."


def test_numeric_entity_patterns(spark):
    df = spark.createDataFrame([("Revenue of $1,234.5M rose 12% to 3.5B dollars; 7 earnings and 10k profit",)],
                               "t string")
    got = df.select(lx.numeric_entities(F.col("t")).alias("e")).collect()[0].e
    import re

    from ledgerlens.constants import NUMERIC_ENTITY_PATTERNS

    exp = [m for p in NUMERIC_ENTITY_PATTERNS for m in re.findall(p, df.first().t, re.IGNORECASE)]
    assert got == exp and len(got) >= 4


def test_sentiment_counts_each_word_once(spark):
    df = spark.createDataFrame([("growth growth decline",), ("nothing",), ("strong risk loss",)], "t string")
    got = [r.s for r in df.select(lx.sentiment_score(F.col("t")).alias("s")).collect()]
    assert got == [0.0, 0.0, pytest.approx(-1 / 3)]
