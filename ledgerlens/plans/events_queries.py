"""Driver queries for the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import stats
from . import bindings as b
from .registry import register
from ..session import materialize

# Shared oracle fragments: price rows numbered per ticker, filings, and the
# as-of positions found with DuckDB's ASOF JOIN (an independent formulation).
_PX = f"""
px AS (
  SELECT user_id AS ticker, ts, event_id, value AS close,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE event_type <> '{b.EVENT_FILING_TYPE}'),
fl AS (
  SELECT user_id AS ticker, ts AS earnings_date, event_type AS filing_type
  FROM events WHERE event_type = '{b.EVENT_FILING_TYPE}'),
bk AS (
  SELECT fl.*, p.rn AS last_before FROM fl ASOF LEFT JOIN px p
  ON fl.ticker = p.ticker AND fl.earnings_date > p.ts),
pos AS (
  SELECT bk.*, p.rn AS first_after FROM bk ASOF LEFT JOIN px p
  ON bk.ticker = p.ticker AND bk.earnings_date <= p.ts),
pre AS (
  SELECT pos.ticker, pos.earnings_date, avg(px.close) AS pre_price, avg(px.volume) AS pre_volume,
         count(*) AS pre_n
  FROM pos JOIN px ON px.ticker = pos.ticker AND px.rn BETWEEN pos.last_before - {{n}} + 1 AND pos.last_before
  GROUP BY ALL),
post AS (
  SELECT pos.ticker, pos.earnings_date, avg(px.close) AS post_price, avg(px.volume) AS post_volume,
         count(*) AS post_n
  FROM pos JOIN px ON px.ticker = pos.ticker AND px.rn BETWEEN pos.first_after AND pos.first_after + {{n}} - 1
  GROUP BY ALL),
rx AS (
  SELECT pos.ticker, pos.earnings_date, pos.filing_type, pre.pre_price, post.post_price,
         (post.post_price - pre.pre_price) / NULLIF(pre.pre_price, 0) * 100 AS price_change_pct,
         (post.post_volume - pre.pre_volume) / NULLIF(pre.pre_volume, 0) * 100 AS volume_change_pct
  FROM pos JOIN pre USING (ticker, earnings_date) JOIN post USING (ticker, earnings_date))
"""


def _px(n: int = 2) -> str:
    return _PX.replace("{n}", str(n))


def _reaction(spark, sf_dir):
    return ev.price_reaction(
        b.event_filings(spark, sf_dir), b.event_prices(spark, sf_dir),
        tie="event_id", bucket_seconds=b.EVENT_BUCKET_SECONDS,
    )


@register("price_reaction", f"""WITH {_px()}
SELECT ticker, earnings_date, filing_type, round(pre_price, 6) AS pre_price, round(post_price, 6) AS post_price,
       round(price_change_pct, 6) AS price_change_pct, round(volume_change_pct, 6) AS volume_change_pct,
       CASE WHEN price_change_pct > 0 THEN 'up' ELSE 'down' END AS direction
FROM rx""")
def q_price_reaction(spark, sf_dir):
    """#58: pre/post means over 2 rows each side, percent changes and direction."""
    return _reaction(spark, sf_dir)


@register("asof_backward", f"""WITH {_px()}
SELECT pos.ticker, pos.earnings_date, round(px.close, 6) AS prev_close, round(px.volume, 6) AS prev_volume
FROM pos LEFT JOIN px ON px.ticker = pos.ticker AND px.rn = pos.last_before""")
def q_asof_backward(spark, sf_dir):
    """#33: last price row strictly before each filing."""
    f = b.event_filings(spark, sf_dir).select("ticker", F.col("filing_date").alias("earnings_date"))
    return ev.asof_backward(f, b.event_prices(spark, sf_dir), key="ticker", event_time="earnings_date",
                            price_time="ts", value_cols=["close", "volume"], tie="event_id",
                            bucket_seconds=b.EVENT_BUCKET_SECONDS)


@register("asof_forward", f"""WITH {_px()}
SELECT pos.ticker, pos.earnings_date, round(px.close, 6) AS next_close, round(px.volume, 6) AS next_volume
FROM pos LEFT JOIN px ON px.ticker = pos.ticker AND px.rn = pos.first_after""")
def q_asof_forward(spark, sf_dir):
    """#32: first price row at or after each filing (equal time counts as after)."""
    f = b.event_filings(spark, sf_dir).select("ticker", F.col("filing_date").alias("earnings_date"))
    return ev.asof_forward(f, b.event_prices(spark, sf_dir), key="ticker", event_time="earnings_date",
                           price_time="ts", value_cols=["close", "volume"], tie="event_id",
                           bucket_seconds=b.EVENT_BUCKET_SECONDS)


def _means(spark, sf_dir, n=2):
    f = b.event_filings(spark, sf_dir).select("ticker", F.col("filing_date").alias("earnings_date"))
    return ev.window_means(f, b.event_prices(spark, sf_dir), key="ticker", event_time="earnings_date",
                           price_time="ts", value_cols=["close"], n=n, tie="event_id",
                           bucket_seconds=b.EVENT_BUCKET_SECONDS)


@register("pre_window_mean", f"""WITH {_px(3)}
SELECT pos.ticker, pos.earnings_date, round(pre.pre_price, 6) AS pre_close, coalesce(pre.pre_n, 0) AS pre_rows_n
FROM pos LEFT JOIN pre USING (ticker, earnings_date)""")
def q_pre_window_mean(spark, sf_dir):
    """#56: mean close of the last 3 rows before each filing (partial windows averaged)."""
    m = _means(spark, sf_dir, 3)
    return m.select("ticker", "earnings_date", "pre_close", F.col("pre_rows_n").cast("long").alias("pre_rows_n"))


@register("post_window_mean", f"""WITH {_px(3)}
SELECT pos.ticker, pos.earnings_date, round(post.post_price, 6) AS post_close,
       coalesce(post.post_n, 0) AS post_rows_n
FROM pos LEFT JOIN post USING (ticker, earnings_date)""")
def q_post_window_mean(spark, sf_dir):
    """#57: mean close of the first 3 rows at or after each filing."""
    m = _means(spark, sf_dir, 3)
    return m.select("ticker", "earnings_date", "post_close", F.col("post_rows_n").cast("long").alias("post_rows_n"))


@register("filings_prices_equi", f"""
SELECT f.user_id AS ticker, f.ts AS filing_date, p.n_price_rows, p.first_price, p.last_price FROM events f
JOIN (SELECT user_id, count(*) AS n_price_rows, min(ts) AS first_price, max(ts) AS last_price FROM events
      WHERE event_type <> '{b.EVENT_FILING_TYPE}' GROUP BY 1) p USING (user_id)
WHERE f.event_type = '{b.EVENT_FILING_TYPE}'""")
def q_filings_prices_equi(spark, sf_dir):
    """#34: every filing matched to its ticker's series by key (co-partitioned, no pairs)."""
    f = b.event_filings(spark, sf_dir).select("ticker", "filing_date")
    return ev.filings_prices_equi(f, b.event_prices(spark, sf_dir))


@register("pct_change", f"""WITH {_px()}
SELECT ticker, earnings_date, round(price_change_pct, 6) AS price_change_pct,
       round(volume_change_pct, 6) AS volume_change_pct FROM rx""")
def q_pct_change(spark, sf_dir):
    """#77: percent change with a zero base giving NULL (k = 0 volumes)."""
    return _reaction(spark, sf_dir).select("ticker", "earnings_date", "price_change_pct", "volume_change_pct")


@register("direction", f"""WITH {_px()}
SELECT CASE WHEN volume_change_pct > 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS n
FROM rx GROUP BY 1""")
def q_direction(spark, sf_dir):
    """#78: 'up' only for a positive change; zero and NULL changes are 'down' (volume change)."""
    r = _reaction(spark, sf_dir)
    return r.groupBy(ev.direction(F.col("volume_change_pct")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@register("nlargest", f"""WITH {_px()}
SELECT ticker, earnings_date, round(price_change_pct, 6) AS price_change_pct FROM rx
ORDER BY price_change_pct DESC, ticker, earnings_date LIMIT 5""")
def q_nlargest(spark, sf_dir):
    """#64: top 5 reactions by change (ties by ticker, date)."""
    return stats.nlargest(_reaction(spark, sf_dir), "price_change_pct", 5, ["ticker", "earnings_date"]).select(
        "ticker", "earnings_date", "price_change_pct")


@register("nsmallest", f"""WITH {_px()}
SELECT ticker, earnings_date, round(price_change_pct, 6) AS price_change_pct FROM rx
ORDER BY price_change_pct ASC, ticker, earnings_date LIMIT 5""")
def q_nsmallest(spark, sf_dir):
    """#64: bottom 5 reactions by change."""
    return stats.nsmallest(_reaction(spark, sf_dir), "price_change_pct", 5, ["ticker", "earnings_date"]).select(
        "ticker", "earnings_date", "price_change_pct")


@register("describe", f"""WITH {_px()}
SELECT count(price_change_pct) AS count, round(avg(price_change_pct), 6) AS mean,
       round(stddev_samp(price_change_pct), 6) AS std, round(min(price_change_pct), 6) AS min,
       round(quantile_cont(price_change_pct, 0.25), 6) AS p25, round(quantile_cont(price_change_pct, 0.5), 6) AS p50,
       round(quantile_cont(price_change_pct, 0.75), 6) AS p75, round(max(price_change_pct), 6) AS max
FROM rx""")
def q_describe(spark, sf_dir):
    """#51: count, mean, std, min, exact quartiles (linear interpolation), max."""
    # One row per filing, read by the moments and the quantiles: written once.
    r = materialize(_reaction(spark, sf_dir).select("price_change_pct"))
    return stats.describe(r, "price_change_pct")
