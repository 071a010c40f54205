"""Statistics: exact quantiles, average ranks, correlation and p-values.

Global order statistics are computed without a single-partition window over the
data: a value's bucket follows from fixed split points (fewer than the shuffle
partitions, kept as literals), a window runs within each bucket, and bucket
totals (one row per bucket) give the offsets.  As the bucket depends on the
value alone, plans that run twice or in part again give the same ranks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


# ------------------------------------------------------------------ ordering
def nlargest(df: DataFrame, col: str, n: int, tie_cols: list[str] | None = None) -> DataFrame:
    """Top ``n`` rows by ``col`` descending; ties by ``tie_cols`` (the reference keeps first)."""
    order = [F.col(col).desc_nulls_last()] + [F.col(c).asc() for c in (tie_cols or [])]
    return df.orderBy(*order).limit(n)


def nsmallest(df: DataFrame, col: str, n: int, tie_cols: list[str] | None = None) -> DataFrame:
    order = [F.col(col).asc_nulls_last()] + [F.col(c).asc() for c in (tie_cols or [])]
    return df.orderBy(*order).limit(n)


def _split_points(df: DataFrame, value: str, partitions: int) -> list[float]:
    """At most ``partitions - 1`` ascending split points of a numeric column, as driver literals."""
    if partitions < 2:
        return []
    got = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / partitions for i in range(1, partitions)], 0.01)
    return sorted(set(got))


def _bucket(c: Column, points: list[float]) -> Column:
    """Number of split points at or below a value: a function of the value alone, so that every execution of a
    plan, and every retried task, agrees."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= c.cast("double")))


def _offsets(rows: DataFrame, weight: Column, n: str) -> DataFrame:
    """Per bucket the weight of the buckets before it, and the total: one row per bucket."""
    totals = rows.groupBy("_b").agg(F.sum(weight).cast("long").alias("_tot"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_b", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"), F.sum("_tot").over(Window.partitionBy()).alias(n))


def _running_weight(df: DataFrame, value: str, weight: str, partitions: int) -> DataFrame:
    """``value, weight, _start`` (weight of all smaller values) and ``_n`` (all weight); values are distinct.

    The table of distinct values is written once: split points, windows and bucket totals read it.
    """
    df = materialize(df.select(value, weight))
    rows = df.withColumn("_b", _bucket(F.col(value), _split_points(df, value, partitions)))
    within = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return rows.join(F.broadcast(_offsets(rows, F.col(weight), "_n")), "_b").select(
        value, weight, (F.col("_off") + F.col("_before")).alias("_start"), "_n")


def average_rank(df: DataFrame, col: str, *, partitions: int | None = None, out: str | None = None) -> DataFrame:
    """Rows of ``df`` with ``out`` = 1-based average rank of ``col`` (ties share the mean rank).

    NULL values get a NULL rank.  Ranks come from the frequency table of distinct
    values, so the range shuffle moves one row per distinct value.
    """
    out = out or f"{col}_rank"
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    freq = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_w"))
    pos = _running_weight(freq, col, "_w", parts)
    ranks = pos.select(col, (F.col("_start") + (F.col("_w") + 1) / 2.0).alias(out))
    return df.join(ranks, col, "left")


def exact_quantiles(df: DataFrame, col: str, probs: list[float], *, partitions: int | None = None) -> DataFrame:
    """One row with ``n`` and ``q_<i>`` = exact quantile (linear interpolation) of the non-null values.

    Same definition as pandas/numpy 'linear' and SQL ``percentile_cont``.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    freq = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_w"))
    pos = _running_weight(freq, col, "_w", parts)
    # Value covers 0-based positions [_start, _start + _w - 1].
    aggs = [F.max("_n").alias("n")]
    for i, q in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        covers = lambda p: (F.col("_start") <= p) & (p <= F.col("_start") + F.col("_w") - 1)
        aggs.append(F.max(F.when(covers(lo), F.col(col))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(covers(hi), F.col(col))).alias(f"_hi{i}"))
        aggs.append(F.max(h - lo).alias(f"_fr{i}"))
    r = pos.agg(*aggs)
    return r.select(
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        *[(F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q_{i}")
          for i in range(len(probs))],
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std (sample), min, p25, p50, p75, max of the non-null values (pandas ``describe``)."""
    moments = df.agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    )
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    # Both sides are single-row aggregates; joining them on a constant keeps one row.
    joined = moments.withColumn("_one", F.lit(1)).join(q.withColumn("_one", F.lit(1)), "_one")
    return joined.select(
        "count", "mean", "std", "min",
        F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"), "max",
    )


# ------------------------------------------------------------------ correlation
def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ``n`` and guarded Pearson ``r`` (NULL when either side is constant or n < 2).

    Rows with a NULL on either side are dropped first.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a = d.agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(x, y).alias("_c"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
    )
    r = F.try_divide(F.col("_c"), F.sqrt(F.col("_vx") * F.col("_vy")))
    r = F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return a.select(F.col("n").cast("long").alias("n"), r.alias("r"))


def spearman(df: DataFrame, x: str, y: str, *, partitions: int | None = None) -> DataFrame:
    """One row: ``n`` and Spearman ``r`` (Pearson of average ranks; ties get the mean rank)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    d = average_rank(d, x, partitions=partitions, out="_rx")
    d = average_rank(d, y, partitions=partitions, out="_ry")
    return pearson(d, "_rx", "_ry")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def corr_p_value(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a correlation under the t distribution with n - 2 degrees of freedom."""
    if r is None or n is None or (isinstance(r, float) and math.isnan(r)) or n < 2:
        return None
    if n == 2:  # any two points lie on a line
        return 1.0
    df = n - 2
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * df / (1.0 - r * r)
    return betainc_reg(df / 2.0, 0.5, df / (df + t2))


@F.pandas_udf(T.DoubleType())
def _p_value_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([corr_p_value(None if pd.isna(a) else float(a), None if pd.isna(b) else int(b))
                      for a, b in zip(r, n)], dtype="float64")


def with_p_value(corr: DataFrame, r: str = "r", n: str = "n", out: str = "p_value") -> DataFrame:
    """Add the two-sided p-value to a (small) correlation result."""
    return corr.withColumn(out, _p_value_udf(F.col(r), F.col(n)))


def macro_mean(c: Column) -> Column:
    """Unweighted mean of per-pair scores (NULL on empty input)."""
    return F.avg(c)


#: sampled keys per bucket for split points of composite keys
SAMPLED_KEYS = 32


def _key_points(df: DataFrame, order_cols: list[str], partitions: int) -> list[Column]:
    """At most ``partitions - 1`` ascending split points of a key of any atomic types, as literal structs."""
    if partitions < 2:
        return []
    keys = df.select(*order_cols)
    some = keys.orderBy(F.rand(7)).limit(SAMPLED_KEYS * partitions).orderBy(*order_cols).collect()  # a bounded sample
    rows = list(dict.fromkeys(tuple(some[len(some) * i // partitions]) for i in range(1, partitions))) if some else []
    types = [keys.schema[c].dataType for c in order_cols]
    return [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, types, order_cols, strict=True)]) for r in rows]


def row_positions(df: DataFrame, order_cols: list[str], *, partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_pos`` (0-based global position by ``order_cols``, NULL first) and ``_n`` (row count).

    Rows are dealt to buckets by their whole key, compared with split points column by column, whatever the
    columns' types; they are numbered there by a window, and a table of one row per bucket supplies the offsets.
    The split points are literals, so that every execution of the plan agrees.
    ``order_cols`` should be a unique key so positions are stable; rows of one key are in one bucket.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _key_points(df, order_cols, parts)
    key = F.struct(*order_cols)
    rows = df.withColumn("_b", F.size(F.filter(F.array(*points), lambda p: p <= key)) if points else F.lit(0))
    rows = rows.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy(*order_cols)) - 1)
    out = rows.join(F.broadcast(_offsets(rows, F.lit(1), "_n")), "_b")
    return out.withColumn("_pos", F.col("_off") + F.col("_local")).drop("_b", "_local", "_off")
