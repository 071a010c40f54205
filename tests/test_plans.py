"""Plan shapes that matter at scale (checked on sf0.001 plans; the shapes do not depend on size)."""

from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as rt
from ledgerlens.operators import stats
from ledgerlens.plans import bindings as b
from tests.conftest import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_topk_has_no_pairwise_join(spark):
    q = b.table(spark, SF001, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = _plan(rt.keyword_topk(q, b.table(spark, SF001, "documents"), 5))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # documents meet the queries' terms in their scan tasks; at most k hits per query and task are shuffled
    assert "MapInArrow" in p and "hashpartitioning(_q" not in p and "hashpartitioning(_term" not in p


def test_filtered_vector_search_has_no_nested_loop_and_pushes_the_year(spark):
    q = b.vector_queries(spark, SF001).withColumn("ticker", F.lit("T1"))
    corpus = b.vector_corpus(spark, SF001)
    p = _plan(rt.vector_topk(q, corpus, 5, match_cols=["ticker"]))
    assert "NestedLoop" not in p and "CartesianProduct" not in p and "hashpartitioning(id" not in p


def test_year_filter_is_a_pushed_range(spark, tmp_path):
    spark.sql("SELECT id, date_add(DATE '2019-01-01', CAST(id AS INT)) AS filing_date FROM range(2000)").write.parquet(str(tmp_path / "d"))
    df = rt.filter_year_contains(spark.read.parquet(str(tmp_path / "d")), 2020)
    assert "GreaterThanOrEqual(filing_date,2020-01-01)" in _plan(df) and df.count() == 366


def test_containment_has_no_all_pairs_test(spark):
    p = _plan(rt.containment_pairs(b.table(spark, SF001, "benchmark"), b.table(spark, SF001, "documents"), max_item_bytes=4000))
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "hashpartitioning" not in p


def test_order_statistics_window_within_value_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    p = _plan(stats.exact_quantiles(df, "v", [0.5]))
    assert "hashpartitioning(_b" in p and "MapInPandas" not in p
    r = stats.exact_quantiles(df, "v", [0.5]).collect()[0]
    assert r.q_0 == 18.0
