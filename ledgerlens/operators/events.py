"""Event study: price rows around filing dates (as-of windows).

For every event the reference takes the last ``n`` price rows strictly before the
event time and the first ``n`` rows at or after it (rows, not days), averages
close and volume on both sides and reports the percent changes.

Spark plan (no pairwise join, skew-safe):

1. Events and prices are united with a ``kind`` column and hash-partitioned on
   ``(key, bucket)`` where ``bucket`` is a coarse slice of time.  A hot key is
   therefore spread over as many tasks as it has buckets.
2. Inside a bucket, running windows carry the ``n`` nearest price rows to every
   event (``last(..., ignorenulls)`` over an unbounded-preceding frame, once
   ascending for the rows before and once descending for the rows after).
3. A bucket summary (first and last ``n`` rows of each bucket, bounded size)
   is carried across buckets with the same window trick at bucket granularity,
   so events near a bucket edge still see rows from neighbouring buckets.
4. Both carries are concatenated and cut to ``n``.

All steps after the single exchange keep the ``(key, bucket)`` partitioning; the
bucket-level table has one row per non-empty bucket, never one per price row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PRICE_WINDOW_ROWS

DEFAULT_BUCKET_SECONDS = 7 * 86400


def _bucket(ts: Column, bucket_seconds: int | None) -> Column:
    if not bucket_seconds:
        return F.lit(0).cast("long")
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(int(bucket_seconds) * 1_000_000)).cast("long")


def _last_n(arr: Column, n: int) -> Column:
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), n)


def _array_mean(arr: Column, field: str) -> Column:
    """Mean of the non-null ``field`` values of an array of structs (NULL if none)."""
    acc = F.aggregate(
        arr,
        F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c")),
        lambda a, x: F.when(
            x[field].isNull(), a
        ).otherwise(F.struct((a["s"] + x[field]).alias("s"), (a["c"] + 1).alias("c"))),
    )
    return F.when(acc["c"] > 0, acc["s"] / acc["c"])


def clean_double(c: Column) -> Column:
    """NaN becomes NULL so that means skip it, as pandas does."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def asof_windows(
    events: DataFrame,
    prices: DataFrame,
    *,
    key: str,
    event_time: str,
    price_time: str,
    value_cols: list[str],
    n: int = PRICE_WINDOW_ROWS,
    tie: str | None = None,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Attach ``pre_rows`` / ``post_rows`` (arrays of up to ``n`` price structs) to each event.

    ``pre_rows``: the last ``n`` price rows with time strictly before the event.
    ``post_rows``: the first ``n`` price rows with time at or after the event.
    Rows with a NULL key or time are dropped on both sides.  ``tie`` orders price
    rows that share a timestamp (defaults to none, i.e. arbitrary but stable).
    """
    if n < 1:
        raise ValueError("window must hold at least one row")
    ev_cols = events.columns
    px_struct = F.struct(*[F.col(c).alias(c) for c in value_cols])
    px_type = prices.select(px_struct.alias("p")).schema["p"].dataType
    tie_col = F.col(tie) if tie else F.lit(0).cast("long")

    ev = (
        events.where(F.col(key).isNotNull() & F.col(event_time).isNotNull())
        .select(
            F.col(key).alias("_k"),
            F.col(event_time).cast("timestamp_ntz").alias("_t"),
            F.lit(0).alias("_kind"),
            F.lit(0).cast("long").alias("_tie"),
            F.struct(*[F.col(c) for c in ev_cols]).alias("_ev"),
            F.lit(None).cast(px_type).alias("_px"),
        )
    )
    px = (
        prices.where(F.col(key).isNotNull() & F.col(price_time).isNotNull())
        .select(
            F.col(key).alias("_k"),
            F.col(price_time).cast("timestamp_ntz").alias("_t"),
            F.lit(1).alias("_kind"),
            tie_col.cast("long").alias("_tie"),
            F.lit(None).cast(ev.schema["_ev"].dataType).alias("_ev"),
            px_struct.alias("_px"),
        )
    )
    u = ev.unionByName(px).withColumn("_b", _bucket(F.col("_t"), bucket_seconds))
    # Rows are clustered by (key, bucket) once per branch below (rows, bucket summary, event buckets); no branch
    # clusters rows by the key alone.
    u = u.repartition("_k", "_b")

    by_kind = Window.partitionBy("_k", "_b", "_kind").orderBy("_t", "_tie")
    is_px = F.col("_kind") == 1
    u = u.withColumn(
        "_pre_here", F.when(is_px, F.collect_list("_px").over(by_kind.rowsBetween(-(n - 1), 0)))
    ).withColumn(
        "_post_here", F.when(is_px, F.collect_list("_px").over(by_kind.rowsBetween(0, n - 1)))
    )
    asc = Window.partitionBy("_k", "_b").orderBy("_t", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    desc = (
        Window.partitionBy("_k", "_b")
        .orderBy(F.col("_t").desc(), F.col("_kind").desc(), F.col("_tie").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    u = u.withColumn("_pre_in", F.last("_pre_here", ignorenulls=True).over(asc)).withColumn(
        "_post_in", F.last("_post_here", ignorenulls=True).over(desc)
    )

    # Bucket summaries: first and last n price rows of each non-empty bucket.
    order_key = F.struct("_t", "_tie")
    summary = (
        u.where(is_px)
        .groupBy("_k", "_b")
        .agg(
            F.max_by("_pre_here", order_key).alias("_tail"),
            F.min_by("_post_here", order_key).alias("_head"),
        )
    )
    by_bucket = Window.partitionBy("_k").orderBy("_b")
    summary = summary.select(
        "_k",
        "_b",
        F.lit(1).alias("_kind"),
        _last_n(F.flatten(F.collect_list("_tail").over(by_bucket.rowsBetween(-(n - 1), 0))), n).alias("_tail_upto"),
        F.slice(F.flatten(F.collect_list("_head").over(by_bucket.rowsBetween(0, n - 1))), 1, n).alias("_head_from"),
    )
    ev_buckets = u.where(~is_px).select("_k", "_b").distinct().select(
        "_k", "_b", F.lit(0).alias("_kind"),
        F.lit(None).cast(summary.schema["_tail_upto"].dataType).alias("_tail_upto"),
        F.lit(None).cast(summary.schema["_head_from"].dataType).alias("_head_from"),
    )
    bucket_rows = summary.unionByName(ev_buckets)
    b_asc = Window.partitionBy("_k").orderBy("_b", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    b_desc = Window.partitionBy("_k").orderBy(F.col("_b").desc(), F.col("_kind").asc()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    carries = (
        bucket_rows.withColumn("_prev_tail", F.last("_tail_upto", ignorenulls=True).over(b_asc))
        .withColumn("_next_head", F.last("_head_from", ignorenulls=True).over(b_desc))
        .where(F.col("_kind") == 0)
        .select("_k", "_b", "_prev_tail", "_next_head")
    )

    empty = F.array().cast(summary.schema["_tail_upto"].dataType)
    out = (
        u.where(~is_px)
        .select("_k", "_b", "_ev", "_pre_in", "_post_in")
        .join(carries, ["_k", "_b"], "left")
        .select(
            "_ev.*",
            _last_n(F.concat(F.coalesce("_prev_tail", empty), F.coalesce("_pre_in", empty)), n).alias("pre_rows"),
            F.slice(F.concat(F.coalesce("_post_in", empty), F.coalesce("_next_head", empty)), 1, n).alias("post_rows"),
        )
    )
    return out


def asof_backward(events: DataFrame, prices: DataFrame, *, key: str, event_time: str, price_time: str,
                  value_cols: list[str], tie: str | None = None,
                  bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Last price row strictly before each event (NULL columns when none)."""
    w = asof_windows(events, prices, key=key, event_time=event_time, price_time=price_time,
                     value_cols=value_cols, n=1, tie=tie, bucket_seconds=bucket_seconds)
    return w.select(*events.columns, *[F.get(F.col("pre_rows"), 0)[c].alias(f"prev_{c}") for c in value_cols])


def asof_forward(events: DataFrame, prices: DataFrame, *, key: str, event_time: str, price_time: str,
                 value_cols: list[str], tie: str | None = None,
                 bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """First price row at or after each event; an equal time counts as after."""
    w = asof_windows(events, prices, key=key, event_time=event_time, price_time=price_time,
                     value_cols=value_cols, n=1, tie=tie, bucket_seconds=bucket_seconds)
    return w.select(*events.columns, *[F.get(F.col("post_rows"), 0)[c].alias(f"next_{c}") for c in value_cols])


def pct_change(new: Column, base: Column) -> Column:
    """(new - base) / base * 100; a zero or NULL base gives NULL."""
    return F.try_divide(new - base, base) * F.lit(100.0)


def direction(change: Column) -> Column:
    """'up' when the change is positive; zero, NaN and NULL are 'down'."""
    return F.when(change > 0, F.lit("up")).otherwise(F.lit("down"))


def window_means(
    events: DataFrame,
    prices: DataFrame,
    *,
    key: str,
    event_time: str,
    price_time: str,
    value_cols: list[str],
    n: int = PRICE_WINDOW_ROWS,
    tie: str | None = None,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
) -> DataFrame:
    """Per event: ``pre_<c>`` / ``post_<c>`` means and ``pre_rows_n`` / ``post_rows_n`` counts."""
    w = asof_windows(events, prices, key=key, event_time=event_time, price_time=price_time,
                     value_cols=value_cols, n=n, tie=tie, bucket_seconds=bucket_seconds)
    cols = [F.col(c) for c in events.columns]
    for c in value_cols:
        cols.append(_array_mean(F.col("pre_rows"), c).alias(f"pre_{c}"))
        cols.append(_array_mean(F.col("post_rows"), c).alias(f"post_{c}"))
    cols += [F.size("pre_rows").alias("pre_rows_n"), F.size("post_rows").alias("post_rows_n")]
    return w.select(*cols)


def price_reaction(
    filings: DataFrame,
    prices: DataFrame,
    *,
    key: str = "ticker",
    filing_date: str = "filing_date",
    filing_type: str = "filing_type",
    price_time: str = "ts",
    close: str = "close",
    volume: str = "volume",
    window: int = PRICE_WINDOW_ROWS,
    tie: str | None = None,
    bucket_seconds: int | None = DEFAULT_BUCKET_SECONDS,
    lookback_days: int | None = None,
) -> DataFrame:
    """Price reaction around each filing.

    Output: ticker, earnings_date, filing_type, pre_price, post_price,
    price_change_pct, volume_change_pct, direction.  Filings without a price row
    on either side are skipped; a NULL filing date is dropped.
    """
    f = filings.select(
        F.col(key).alias("ticker"),
        F.col(filing_date).alias("earnings_date"),
        F.col(filing_type).alias("filing_type"),
    )
    p = prices.select(
        F.col(key).alias("ticker"),
        F.col(price_time).alias("_pt"),
        clean_double(F.col(close)).alias("close"),
        clean_double(F.col(volume)).alias("volume"),
        *([F.col(tie).alias("_tie")] if tie else []),
    )
    if lookback_days:
        p = p.where(F.col("_pt") >= F.date_sub(F.current_date(), int(lookback_days)))
    m = window_means(f, p, key="ticker", event_time="earnings_date", price_time="_pt",
                     value_cols=["close", "volume"], n=window, tie="_tie" if tie else None,
                     bucket_seconds=bucket_seconds)
    change = pct_change(F.col("post_close"), F.col("pre_close"))
    return m.where((F.col("pre_rows_n") > 0) & (F.col("post_rows_n") > 0)).select(
        "ticker",
        "earnings_date",
        "filing_type",
        F.col("pre_close").alias("pre_price"),
        F.col("post_close").alias("post_price"),
        change.alias("price_change_pct"),
        pct_change(F.col("post_volume"), F.col("pre_volume")).alias("volume_change_pct"),
        direction(change).alias("direction"),
    )


def filings_prices_equi(filings: DataFrame, prices: DataFrame, *, key: str = "ticker", price_time: str = "ts") -> DataFrame:
    """Each filing matched to its ticker's price series: the filing's columns, n_price_rows, first_price, last_price.

    The series is summarised per key first (map-side partial aggregation) and
    joined on the key, so no pairwise filing x price rows are produced; filings
    without a series are dropped.
    """
    series = prices.groupBy(key).agg(F.count(F.lit(1)).alias("n_price_rows"), F.min(price_time).alias("first_price"),
                                     F.max(price_time).alias("last_price"))
    return filings.join(series, key, "inner")
