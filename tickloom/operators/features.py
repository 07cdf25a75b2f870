"""The wide reducer: every statistic of each series, from sums and sort-based quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import corr

#: Quantiles, by column name.
QUANTILES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def quantile(place: Column, n: Column, value: Column, q: float) -> Column:
    """An aggregate: the linearly interpolated quantile of rows numbered from 0 in order of value."""
    at = (n - 1) * q
    low = F.floor(at)
    share = at - low
    return F.sum(F.when(place == low, value * (1 - share)).when(place == low + 1, value * share))


def names(lags: int = 1, abs_: bool = False) -> list[str]:
    """Column names of features(), in order."""
    out = ["mean", "median", "std", "skew", "kurt", "max", "min", "range", "p5", "p25", "p75", "p95", "iqr", "cv"]
    for lag in range(1, min(max(1, lags), 3) + 1):
        out += [f"autocorr{lag}", f"autocorr{lag}_abs"]
    out += ["trend", "period_diff", "period_ratio", "mean_above_p90", "mean_below_p10"]
    return out + [f"{c}_abs" for c in ("mean", "median", "std", "skew", "kurt", "max", "min", "p5", "p25", "p75", "p95", "iqr", "cv", "trend", "period_diff", "period_ratio")] * abs_


def features(df: DataFrame, by: list[str], order: list[str], value: str, lags: int = 1, abs_: bool = False) -> DataFrame:
    """By series: n and the columns of names().

    skew and kurt are corrected for bias, std is the sample's, cv is std over |mean| + 1e-8;
    trend is the correlation with the row number, 0 where flat; periods are the first and last
    thirds of the rows; mean_above_p90 and mean_below_p10 are 0 where no value lies beyond.
    Quantiles interpolate between sorted rows, which one sort by value numbers, so no buffer
    holds a series' distinct values. Null values don't count.
    """
    lags = min(max(1, lags), 3)
    series, x = Window.partitionBy(*by), F.col("_x")
    row = series.orderBy(*order)
    d = df.select(*by, *[c for c in order if c not in by], F.col(value).cast("double").alias("_x"))
    d = d.withColumn("_row", F.row_number().over(row)).withColumn("_rows", F.count(F.lit(1)).over(series))
    d = d.select("*", *[F.lag("_x", k).over(row).alias(f"_lag{k}") for k in range(1, lags + 1)])
    d = d.withColumn("_n", F.count("_x").over(series)).withColumn("_place", F.row_number().over(series.orderBy(x.asc_nulls_last())) - 1)
    d = d.withColumn("_c", x - F.avg("_x").over(series))
    third, c, n = F.floor(F.col("_rows") / 3), F.col("_c"), F.col("_n")
    q = {k: quantile(F.col("_place"), n, x, p) for k, p in QUANTILES.items()}
    first, last = F.avg(F.when(F.col("_row") <= third, x)), F.avg(F.when(F.col("_row") > F.col("_rows") - third, x))
    a = d.groupBy(*by).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.max("_x").alias("max"), F.min("_x").alias("min"),
        F.sum(c * c).alias("_m2"), F.sum(c * c * c).alias("_m3"), F.sum(c * c * c * c).alias("_m4"), first.alias("_first"), last.alias("_last"),
        F.coalesce(corr("_row", "_x"), F.lit(0.0)).alias("trend"), *[v.alias(k) for k, v in q.items()], *[corr("_x", f"_lag{k}").alias(f"autocorr{k}") for k in range(1, lags + 1)])
    tails = d.join(a.select(*by, "p10", "p90"), by).groupBy(*by).agg(F.avg(F.when(x > F.col("p90"), x)).alias("_above"), F.avg(F.when(x < F.col("p10"), x)).alias("_below"))
    m, k2, k3, k4 = F.col("n").cast("double"), F.col("_m2"), F.col("_m3"), F.col("_m4")
    flat = k2 <= 0
    skew = F.when((m > 2) & ~flat, m * F.sqrt(m - 1) / (m - 2) * k3 / F.pow(k2, 1.5)).when(m > 2, 0.0)
    kurt = F.when((m > 3) & ~flat, m * (m + 1) * (m - 1) * k4 / ((m - 2) * (m - 3) * k2 * k2) - 3 * (m - 1) * (m - 1) / ((m - 2) * (m - 3))).when(m > 3, 0.0)
    out = a.join(tails, by).withColumn("skew", skew).withColumn("kurt", kurt).withColumn("range", F.col("max") - F.col("min")).withColumn("iqr", F.col("p75") - F.col("p25"))
    out = out.withColumn("cv", F.col("std") / (F.abs("mean") + 1e-8)).withColumn("period_diff", F.col("_last") - F.col("_first")).withColumn("period_ratio", F.col("_last") / (F.abs("_first") + 1e-8))
    out = out.withColumn("mean_above_p90", F.coalesce("_above", F.lit(0.0))).withColumn("mean_below_p10", F.coalesce("_below", F.lit(0.0)))
    want = names(lags, abs_)
    have = set(out.columns)
    return out.select(*by, "n", *[F.col(k) if k in have else F.abs(k.removesuffix("_abs")).alias(k) for k in want])
