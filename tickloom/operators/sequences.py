"""Operators on ordered series: row windows of log returns, trends, runs, tails and neighbours by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import corr


def returns(value: Column, w, lookback: int, interval: int) -> Column:
    """Log returns between each `interval`-th value, from the start of a window of `lookback` rows; none before the window is full."""
    all_ = F.collect_list(value).over(w.rowsBetween(1 - lookback, 0))
    some = F.filter(all_, lambda x, i: i % interval == 0)
    logs = F.transform(F.slice(F.arrays_zip(some.alias("a"), F.slice(some, F.lit(2), F.size(some)).alias("b")), F.lit(1), F.size(some) - 1), lambda p: F.log(p["b"] / p["a"]))
    return F.when(F.size(all_) == lookback, logs)


def rolling_returns(df: DataFrame, by: list[str], order: list[str], value: str, lookback: int, interval: int, min_periods: int = 2, eps: float = 2.2e-16) -> DataFrame:
    """volatility (population deviation), cv (over the absolute mean) and qcv (quartile range over the absolute median) of those returns.

    cv and qcv are none where the mean or median is below eps; all three where samples are fewer than min_periods.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.col("_r")
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    spread = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - F.col("_m")) * (b - F.col("_m"))) / F.nullif(n, F.lit(0)))
    s, q = F.col("_s"), lambda k: F.floor(n * k / 4).cast("int")
    at = lambda k, even: F.when(even, (F.get(s, q(k) - 1) + F.get(s, q(k))) / 2).otherwise(F.get(s, q(k)))
    ok = (n >= max(1, min_periods - 1)) & F.lit((lookback - 1) // interval + 1 >= min_periods)
    a = df.withColumn("_r", returns(F.col(value), w, lookback, interval)).withColumn("_m", F.try_divide(total, n)).withColumn("_s", F.array_sort("_r"))
    a = a.withColumn("_med", at(2, n % 2 == 0)).withColumn("volatility", F.when(ok, spread))
    return (
        a.withColumn("cv", F.when(ok & (F.abs("_m") >= eps), F.col("volatility") / F.abs("_m")))
        .withColumn("qcv", F.when(ok & (F.abs("_med") >= eps), (at(3, n % 4 == 0) - at(1, n % 4 == 0)) / F.abs("_med")))
        .drop("_r", "_m", "_s", "_med")
    )


def rolling_correlation_mean(df: DataFrame, by: list[str], order: list[str], columns: list[str], rows: int) -> DataFrame:
    """Mean of the correlation matrix of `columns`, diagonal included, over the last `rows` rows; none before they are full."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    k = len(columns)
    pairs = sum((corr(a, b, w) for i, a in enumerate(columns) for b in columns[i + 1 :]), F.lit(0.0))
    return df.withColumn("corr_mean", F.when(F.count(F.lit(1)).over(w) >= rows, (k + 2 * pairs) / (k * k)))


def trend(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """By series, the correlation of the values with their index; 0 where flat or of one value. Rows without a value don't count."""
    at = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("double"))
    return at.groupBy(*by).agg(F.when((F.count(value) > 1) & (F.stddev_pop(value) > 0), corr("_i", value)).otherwise(0.0).alias("trend"))


def runs_correlation(df: DataFrame, by: list[str], order: list[str], a: str, b: str, min_length: int) -> DataFrame:
    """Runs in which a > b, or a <= b, of at least min_length rows: (by, run, above, n, corr)."""
    w = Window.partitionBy(*by).orderBy(*order)
    up = df.withColumn("above", F.col(a) > F.col(b))
    cut = up.withColumn("_c", F.when(F.lag("above").over(w) != F.col("above"), 1).otherwise(0))
    runs = cut.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "run", "above").agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), corr(a, b)).alias("corr"))
    return out.where(F.col("n") >= min_length)


def tail_dependence(df: DataFrame, by: list[str], x: str, y: str, q: float) -> DataFrame:
    """By group: share of rows with low y among those with low x, and of high y among high x; thresholds are sorted values at int(q n) and int((1 - q) n)."""
    all_ = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(all_)
    d = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_n", n)
    for c in ("_x", "_y"):
        d = d.withColumn("_p", F.row_number().over(all_.orderBy(c)) - 1)
        for side, share in (("l", q), ("u", 1 - q)):
            place = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
            d = d.withColumn(f"{c}{side}", F.max(F.when(F.col("_p") == place, F.col(c))).over(all_))
    lo, hi = F.col("_x") <= F.col("_xl"), F.col("_x") >= F.col("_xu")
    return d.groupBy(*by).agg(F.avg(F.when(lo, (F.col("_y") <= F.col("_yl")).cast("double"))).alias("lower_tail"), F.avg(F.when(hi, (F.col("_y") >= F.col("_yu")).cast("double"))).alias("upper_tail"))


def id_neighbours(orders: DataFrame, key: str, value: str, reach: int, block: int = 100_000) -> DataFrame:
    """For each order, how many others have ids within `reach`, and their sum of `value`.

    Ids are cut into blocks; those within `reach` of a border go to both blocks, so windows
    run in parallel and no join is needed. `reach` is at most a block.
    """
    if reach > block:
        raise ValueError("reach is longer than a block")
    own, o = F.floor(F.col(key) / F.lit(block)), orders.select(key, F.col(value).alias("_v"))
    near = F.array_distinct(F.array(*[F.floor((F.col(key) + d) / F.lit(block)) for d in (-reach, 0, reach)]))
    w = Window.partitionBy("_b").orderBy(key).rangeBetween(-reach, reach)
    out = o.withColumn("_b", F.explode(near)).withColumn("n_near", F.count(F.lit(1)).over(w) - 1).withColumn("near", F.coalesce(F.sum("_v").over(w), F.lit(0.0)) - F.coalesce("_v", F.lit(0.0)))
    return out.where(F.col("_b") == own).select(key, "n_near", "near")


def gumbel_pdf(u: Column, v: Column, theta: float) -> Column:
    """Density of the Gumbel copula."""
    a, b = -F.log(u), -F.log(v)
    s = F.pow(a, F.lit(theta)) + F.pow(b, F.lit(theta))
    root = F.pow(s, F.lit(1 / theta))
    return F.exp(-root) / (u * v) * F.pow(a * b, F.lit(theta - 1)) * F.pow(s, F.lit(1 / theta - 2)) * (root + theta - 1)
