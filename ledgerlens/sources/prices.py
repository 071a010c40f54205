"""Landed price series, earnings calendars and fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FUNDAMENTAL_FIELDS


def price_scan(prices: DataFrame, *, ts: str = "ts", start: str | None = None, end: str | None = None,
               trailing_months: int | None = 60, key: str = "ticker") -> DataFrame:
    """Price rows by range when both ends are given (end exclusive), else a trailing period per series.

    The trailing period is measured back from each series' last row.  The last
    row per key is a partially aggregated ``max`` (one row per key) joined back,
    so a hot ticker is never gathered into one task.
    """
    if start and end:
        return prices.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    if trailing_months is None:
        return prices
    last = prices.groupBy(key).agg(F.max(ts).alias("_last"))
    since = last.select(key, F.add_months(F.col("_last").cast("date"), -int(trailing_months))
                        .cast("timestamp_ntz").alias("_since"))
    return prices.join(since, key).where(F.col(ts) >= F.col("_since")).drop("_since")


def earnings_dates_scan(calendar: DataFrame, *, date_col: str, ticker: str = "ticker") -> DataFrame:
    """Calendar rows with the date column named ``earnings_date``."""
    return calendar.withColumnRenamed(date_col, "earnings_date").select(ticker, "earnings_date",
                                                                          *[c for c in calendar.columns
                                                                            if c not in (ticker, date_col)])


def fundamentals_project(info: DataFrame, *, ticker: str = "ticker", json_col: str = "info",
                         fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pick provider fields from a JSON document per ticker; missing fields are NULL."""
    fields = fields or FUNDAMENTAL_FIELDS
    cols = [F.get_json_object(F.col(json_col), f"$.{src}").alias(dst) for src, dst in fields]
    typed = []
    for (src, dst), c in zip(fields, cols):
        typed.append(c if dst in ("sector", "industry") else c.cast("double").alias(dst))
    return info.select(F.col(ticker), *typed)


def price_analyst(prices: DataFrame, fundamentals: DataFrame, *, ticker: str = "ticker", ts: str = "ts",
                  trailing_days: int = 365) -> DataFrame:
    """The price rows of the trailing window (from the last row of all prices), with each ticker's fundamentals."""
    last_all = prices.agg(F.max(ts).alias("_m"))
    bound = last_all.select((F.col("_m") - F.expr(f"INTERVAL {int(trailing_days)} DAYS")).alias("_since")).scalar()
    return prices.where(F.col(ts) >= bound).join(fundamentals, ticker, "left")
