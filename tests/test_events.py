"""Event study: as-of windows against a pandas brute force of the reference rule."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import events as ev


def brute(filings, prices, n):
    out = []
    for _, f in filings.iterrows():
        if pd.isna(f["filing_date"]):
            continue
        p = prices[prices["ticker"] == f["ticker"]].sort_values(["ts", "tie"])
        pre = p[p["ts"] < f["filing_date"]].tail(n)
        post = p[p["ts"] >= f["filing_date"]].head(n)
        if pre.empty or post.empty:
            continue
        pc, qc = pre["close"].mean(), post["close"].mean()
        pv, qv = pre["volume"].mean(), post["volume"].mean()
        chg = (qc - pc) / pc * 100 if pc else None
        vchg = (qv - pv) / pv * 100 if pv else None
        out.append((f["ticker"], f["filing_date"], pc, qc, chg, vchg,
                    "up" if chg is not None and not math.isnan(chg) and chg > 0 else "down"))
    return out


def _rows(df):
    return sorted((r.ticker, r.earnings_date, r.pre_price, r.post_price, r.price_change_pct, r.volume_change_pct,
                   r.direction) for r in df.collect())


def _close(a, b):
    if a is None or b is None or (isinstance(a, float) and math.isnan(a)):
        return (a is None or (isinstance(a, float) and math.isnan(a))) == (b is None or (isinstance(b, float) and math.isnan(b)))
    if isinstance(a, float):
        return abs(a - b) < 1e-9
    return a == b


@pytest.mark.parametrize("bucket", [None, 3600, 86400, 7 * 86400])
def test_edge_rows_match_bruteforce(spark, bucket):
    ts = pd.Timestamp
    prices = pd.DataFrame({
        "ticker": ["A"] * 7 + ["B"],
        "ts": [ts("2024-01-01 10:00"), ts("2024-01-01 10:00"), ts("2024-01-02"), ts("2024-01-03"),
               ts("2024-01-05"), ts("2024-01-09"), ts("2024-01-20"), ts("2024-01-02")],
        "tie": [1, 2, 3, 4, 5, 6, 7, 8],
        "close": [10.0, 11.0, 12.0, float("nan"), 14.0, 15.0, 16.0, 5.0],
        "volume": [0.0, 0.0, 100.0, 50.0, 60.0, 70.0, 80.0, 1.0],
    })
    filings = pd.DataFrame({
        "ticker": ["A", "A", "A", "A", "A", "B", "B", "A"],
        "filing_date": [ts("2024-01-02"), ts("2023-12-31"), ts("2024-02-01"), ts("2024-01-01 10:00"),
                        ts("2024-01-09"), ts("2024-01-02"), ts("2024-01-03"), pd.NaT],
        "filing_type": ["10-K"] * 8,
    })
    sp = spark.createDataFrame(prices.rename(columns={"tie": "tie"}))
    sp = sp.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sf = spark.createDataFrame(filings).withColumn("filing_date", F.col("filing_date").cast("timestamp_ntz"))
    got = _rows(ev.price_reaction(sf, sp, tie="tie", bucket_seconds=bucket))
    exp = sorted(brute(filings, prices, 2), key=lambda r: (r[0], r[1]))
    assert len(got) == len(exp)
    for g, e in zip(got, exp):
        assert g[0] == e[0] and pd.Timestamp(g[1]) == e[1]
        for a, b in zip(g[2:], e[2:]):
            assert _close(a, b), (g, e)


@pytest.mark.parametrize("bucket", [3600, 86400])
def test_events_table_matches_bruteforce(spark, bucket):
    from tests.conftest import SF001
    from ledgerlens.plans import bindings as b

    f = b.event_filings(spark, SF001)
    p = b.event_prices(spark, SF001)
    got = _rows(ev.price_reaction(f, p, tie="event_id", bucket_seconds=bucket))
    fp = f.toPandas()
    pp = p.toPandas().rename(columns={"event_id": "tie"})
    exp = sorted(brute(fp, pp, 2), key=lambda r: (r[0], r[1]))
    assert len(got) == len(exp) > 10
    for g, e in zip(got, exp):
        for a, b2 in zip(g[2:], e[2:]):
            assert _close(a, b2)


def test_asof_moves_rows_by_bucket(spark):
    from tests.conftest import SF001
    from ledgerlens.plans import bindings as b

    f = b.event_filings(spark, SF001).select("ticker", F.col("filing_date").alias("t"))
    w = ev.asof_windows(f, b.event_prices(spark, SF001), key="ticker", event_time="t", price_time="ts",
                        value_cols=["close"], n=2, bucket_seconds=86400)
    plan = w._jdf.queryExecution().executedPlan().toString()
    # the same exchange of rows by key and time bucket in every branch, none by the key alone
    assert 1 <= plan.count("Exchange hashpartitioning(_k") <= 6
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pct_change_and_direction(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 1.0), (2.0, 2.0), (None, 1.0)], "pre double, post double")
    r = df.select(ev.pct_change(F.col("post"), F.col("pre")).alias("c")).select("c", ev.direction(F.col("c")).alias("d"))
    rows = r.collect()
    assert rows[0].c == 100.0 and rows[0].d == "up"
    assert rows[1].c is None and rows[1].d == "down"
    assert rows[2].c == 0.0 and rows[2].d == "down"
    assert rows[3].c is None and rows[3].d == "down"


def test_hot_key_with_a_third_of_rows(spark):
    """One ticker holds a third of all rows: results stay exact and the key spreads over buckets."""
    from tests.conftest import SF001
    from ledgerlens.plans import bindings as b

    hot = F.when(F.col("ticker") % 3 == 0, F.lit(0)).otherwise(F.col("ticker"))
    f = b.event_filings(spark, SF001).withColumn("ticker", hot)
    p = b.event_prices(spark, SF001).withColumn("ticker", hot)
    share = p.where(F.col("ticker") == 0).count() / p.count()
    assert share > 0.25
    got = _rows(ev.price_reaction(f, p, tie="event_id", bucket_seconds=3600))
    exp = sorted(brute(f.toPandas(), p.toPandas().rename(columns={"event_id": "tie"}), 2), key=lambda r: (r[0], r[1]))
    assert len(got) == len(exp)
    for g, e in zip(got, exp):
        for a, b2 in zip(g[2:], e[2:]):
            assert _close(a, b2)
    buckets = p.where(F.col("ticker") == 0).select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
                                                   .alias("b")).distinct().count()
    assert buckets > 20  # the hot key's rows are hashed over many (key, bucket) groups
