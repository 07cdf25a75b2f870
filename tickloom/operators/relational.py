"""Joins, ranks, groups and cross-section operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import corr

#: Pairs of a key that one task of a full join makes; keys with more are dealt over several.
PAIRS = 4_000_000


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple = ("_x", "_y")) -> DataFrame:
    """Equi-join; columns that both sides have besides the keys get suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    for c in sorted(both):
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return full_join(left, right, on) if how in ("full", "outer", "fullouter", "full_outer") else left.join(right, on, how)


def full_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A full equi-join as a left join and the right rows without a match; both inputs are read more than once, so they must not change.

    Spark's full join holds all pairs of a key in memory at once. Here a key of over `PAIRS` pairs is
    dealt over slots: its left rows each to one, by a hash of the row, its right rows to all.
    """
    a, b = (x.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for x, n in ((left, "__a"), (right, "__b")))
    keys = a.join(b, on).withColumn("__pairs", F.col("__a").cast("double") * F.col("__b"))
    total, most = keys.agg(F.sum("__pairs"), F.max("__pairs")).first()
    alone = right.join(left.select(*on).distinct(), on, "left_anti")
    if (most or 0) > PAIRS:
        parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PAIRS / 2))
        hot = keys.where(F.col("__pairs") > PAIRS).select(*on, F.least("__a", F.ceil(F.col("__pairs") / PAIRS)).cast("int").alias("__n"))
        row = F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind])
        dealt = left.join(hot, on, "left").withColumn("__slot", F.coalesce(F.pmod(row, F.col("__n")), F.lit(0)).cast("int")).drop("__n")
        copied = right.join(hot, on, "left").withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n") - 1, F.lit(0))))).drop("__n")
        found = dealt.repartition(parts, *on, "__slot").join(copied.repartition(parts, *on, "__slot"), [*on, "__slot"], "left").drop("__slot")
    else:
        found = left.join(right, on, "left")
    return found.unionByName(alone, allowMissingColumns=True)


def rank(df: DataFrame, by: list[str], value: str, method: str = "average", ascending: bool = True, first: str | None = None) -> DataFrame:
    """Column rank within groups; ties by method, rows without a value keep none. 'first' breaks ties by column `first`."""
    order = F.col(value).asc_nulls_last() if ascending else F.col(value).desc_nulls_last()
    w = Window.partitionBy(*by).orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    r = F.rank().over(w)
    out = {"min": r, "max": r + ties - 1, "average": r + (ties - 1) / 2, "dense": F.dense_rank().over(w), "first": F.row_number().over(Window.partitionBy(*by).orderBy(order, *([first] if first else [])))}[method]
    return df.withColumn("rank", F.when(F.col(value).isNotNull(), out.cast("double")))


def factor_grouping(df: DataFrame, by: list[str], factor: str, tie: str, groups: int = 10) -> DataFrame:
    """Quantile group 1..groups by date: groups of round(n / groups), the rest in the last; 0 without a factor."""
    n = F.count(factor).over(Window.partitionBy(*by))
    size = F.greatest(F.lit(1), F.floor(n / groups + 0.5))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(factor).asc_nulls_last(), tie)) - 1
    return df.withColumn("group", F.when(F.col(factor).isNull(), 0).otherwise(F.least(F.lit(groups), F.floor(place / size) + 1)).cast("int"))


def zscore(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Cross-section z-score by population deviation; 0 where all are equal."""
    w = Window.partitionBy(*by)
    s = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when(s > 0, (F.col(value) - F.avg(value).over(w)) / s).otherwise(0.0))


def rank_correlation(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """By group, the correlation of average ranks of x and y; none where either is flat."""
    a = rank(df, [by], x).withColumnRenamed("rank", "_rx")
    b = rank(a, [by], y).withColumnRenamed("rank", "_ry")
    flat = (F.stddev_pop("_rx") == 0) | (F.stddev_pop("_ry") == 0) | (F.count("_rx") < 2)
    return b.groupBy(by).agg(F.when(~flat, corr("_rx", "_ry")).alias("corr"))


def rank_roll(df: DataFrame, date: str, code: str, value: str, days: int) -> DataFrame:
    """Average rank by date, then each code's rolling mean, max, min and std of it over `days` rows, from half of them on."""
    r = rank(df, [date], value)
    w = Window.partitionBy(code).orderBy(date).rowsBetween(1 - days, 0)
    enough = F.count("rank").over(w) >= max(1, days // 2)
    return r.select(date, code, "rank", *[F.when(enough, f("rank").over(w)).alias(n) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def calendar(dates: DataFrame, date: str) -> DataFrame:
    """Trading days with their place, the last one and the next one. One row a day, so one window."""
    w = Window.orderBy(date)
    return dates.select(date).distinct().select(date, F.row_number().over(w).alias("place"), F.lag(date).over(w).alias("last_day"), F.lead(date).over(w).alias("next_day"))


def backtest(df: DataFrame, date: str, factor: str, ret: str, groups: int = 5) -> DataFrame:
    """By date: rank IC, and the return of the top group over the bottom one, groups by ceil(rank / n * groups)."""
    r = rank(rank(df, [date], factor).withColumnRenamed("rank", "_f"), [date], ret).withColumnRenamed("rank", "_r")
    g = r.withColumn("_g", F.ceil(F.col("_f") / F.count(factor).over(Window.partitionBy(date)) * groups))
    out = g.groupBy(date).agg(F.count(factor).alias("n"), F.when((F.stddev_pop("_f") > 0) & (F.stddev_pop("_r") > 0), corr("_f", "_r")).alias("ic"), (F.avg(F.when(F.col("_g") == groups, F.col(ret))) - F.avg(F.when(F.col("_g") == 1, F.col(ret)))).alias("long_short"))
    return out
