"""Reducers: correlation, regression, entropy, spectra, sequences, copulas, text."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import corr


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlations, long: (a, b, corr). One pass: a sum row for all pairs, then melted."""
    pairs = list(combinations_with_replacement(columns, 2))
    one = df.agg(*[corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def corrwith(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation by group over rows with both values; none where either is flat."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*by).agg(F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), corr(x, y)).alias("corr"))


def ols(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least squares of y on x with intercept, by group: b0, b1, r2; none where x is flat."""
    n, sx, sy, sxx, sxy, syy = (F.col(f"_{i}") for i in range(6))
    a = df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("_0"), F.sum(x).alias("_1"), F.sum(y).alias("_2"), F.sum(F.col(x) * F.col(x)).alias("_3"), F.sum(F.col(x) * F.col(y)).alias("_4"), F.sum(F.col(y) * F.col(y)).alias("_5"))
    vx, vy, c = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
    b1 = F.when(vx > 1e-9, c / vx)
    return a.select(*by, ((sy - b1 * sx) / n).alias("b0"), b1.alias("b1"), F.when((vx > 1e-9) & (vy > 1e-9), c * c / (vx * vy)).alias("r2"))


def ols_residuals(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Each row's residual of that fit."""
    return df.join(ols(df, by, y, x).drop("r2"), by).withColumn("residual", F.col(y) - F.col("b0") - F.col("b1") * F.col(x)).drop("b0", "b1")


def entropy(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Shannon entropy (natural log) of the values of each group; null is a value. Counted per value first."""
    c = df.groupBy(*by, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy(*by).agg((F.log(F.sum("_c")) - F.sum(F.col("_c") * F.log("_c")) / F.sum("_c")).alias("entropy"))


def binned(df: DataFrame, by: list[str], value: str, bins: int, method: str = "equal_width", tie: str | None = None) -> DataFrame:
    """df with column bin: equal width, or equal frequency by rank; null is bin `bins`."""
    w = Window.partitionBy(*by)
    if method == "equal_width":
        low, high = F.min(value).over(w), F.max(value).over(w)
        b = F.when(high > low, F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / ((high - low) / bins)))).otherwise(0)
    else:
        place = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), *([tie] if tie else []))) - 1
        b = F.least(F.lit(bins - 1), F.floor(place * bins / F.count(value).over(w)))
    return df.withColumn("bin", F.when(F.col(value).isNull(), bins).otherwise(b).cast("int"))


def dct(df: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """First k unnormalised DCT-II coefficients of each array: (key, i, coef), in higher-order functions on the row."""
    n = F.size(values)
    coef = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.aggregate(F.transform(values, lambda v, p: v.cast("double") * F.cos(F.lit(3.141592653589793) * (p + F.lit(0.5)) * i / n)), F.lit(0.0), lambda a, b: a + b))
    return df.select(key, F.posexplode(coef).alias("i", "coef"))


def segments(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Run ids of equal consecutive values; the first row has 0 and the rest of its run 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(value).over(w) != F.col(value), 1).otherwise(0)
    steps = F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_x", change).withColumn("segment", F.when(F.row_number().over(w) == 1, 0).otherwise(steps + 1).cast("long")).drop("_x")


def to_uniform(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Ordinal rank over n + 1."""
    return df.withColumn("u", F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) / (F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1))


def clayton_cdf(u: Column, v: Column, theta: float) -> Column:
    return F.pow(F.pow(u, F.lit(-theta)) + F.pow(v, F.lit(-theta)) - 1, F.lit(-1 / theta))


def clayton_pdf(u: Column, v: Column, theta: float) -> Column:
    s = F.pow(u, F.lit(-theta)) + F.pow(v, F.lit(-theta)) - 1
    return (1 + theta) * F.pow(u * v, F.lit(-theta - 1)) * F.pow(s, F.lit(-2 - 1 / theta))


def gumbel_cdf(u: Column, v: Column, theta: float) -> Column:
    return F.exp(-F.pow(F.pow(-F.log(u), F.lit(theta)) + F.pow(-F.log(v), F.lit(theta)), F.lit(1 / theta)))


def skew0(value: str) -> Column:
    """Population skewness; 0 where the deviation is nil."""
    x = F.col(value)
    m, var = F.avg(x), F.avg(x * x) - F.avg(x) * F.avg(x)
    return F.when(var > 1e-10, (F.avg(x * x * x) - 3 * m * F.avg(x * x) + 2 * m * m * m) / F.pow(var, 1.5)).otherwise(0.0)


def word_set(text: Column, alnum: bool = True) -> Column:
    t = F.regexp_replace(F.lower(text), "[^a-z0-9\\s]", "") if alnum else F.lower(text)
    return F.array_distinct(F.filter(F.split(t, "\\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 for two empty texts."""
    x, y = word_set(a), word_set(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def word_difference(a: Column, b: Column) -> Column:
    """Words that only one of two texts has."""
    x, y = word_set(a, False), word_set(b, False)
    return F.size(F.array_except(x, y)) + F.size(F.array_except(y, x))


def word_counts(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Sentence vectors, long: (key, word, n); lower case, '.' dropped, words between white space."""
    return df.select(*key, F.explode(F.split(F.regexp_replace(F.lower(text), "\\.", ""), "\\s+")).alias("word")).where("word <> ''").groupBy(*key, "word").agg(F.count(F.lit(1)).alias("n"))


def _shares(df: DataFrame, by: list[str], key: str, volume: str, name: str) -> DataFrame:
    """Entropy (natural log) of the keys' shares of the volume, by group."""
    v = df.groupBy(*by, key).agg(F.sum(volume).alias("_v")).where("_v > 0")
    return v.groupBy(*by).agg((F.log(F.sum("_v")) - F.sum(F.col("_v") * F.log("_v")) / F.sum("_v")).alias(name))


def order_entropy(df: DataFrame, by: list[str], order: list[str], key: str, volume: str, index: int, ts: str | None = None, seconds: int = 0) -> DataFrame:
    """By series: entropy of orders' shares of the volume up to row `index` (from 0) and, with `ts`, in the next `seconds` whole seconds."""
    w = Window.partitionBy(*by)
    t = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    keep = F.col("_i") <= index
    if ts:
        second = F.unix_seconds(F.col(ts).cast("timestamp"))
        keep = keep | F.coalesce(second <= F.max(F.when(F.col("_i") == index, second)).over(w) + seconds, F.lit(False))
    return _shares(t.withColumn("_keep", keep).where("_keep"), by, key, volume, "entropy")


def entropy_changes(df: DataFrame, by: list[str], order: list[str], ts: str, key: str, volume: str, price: str, seconds: int, low: bool = False, top: int | None = None) -> DataFrame:
    """At each new high (or low) of the price but the first row: by, the last order column, change of orders' entropy when the next `seconds` whole seconds are added to the rows so far.

    Rows without a later one in that time have none; `top`: only the highest (lowest) so many.
    New highs are few (about the logarithm of a series' rows), so a series is joined with its own.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    p = -F.col(price) if low else F.col(price)
    t = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp"))).withColumn("_p", p)
    t = t.withColumn("_top", F.max("_p").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    highs = t.where("_i = 0 OR _p > _top")
    if top:
        highs = highs.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_p").desc()))).where(F.col("_place") <= top)
    tie = order[-1]
    h = highs.where("_i > 0").select(*by, F.col(tie), F.col("_i").alias("_hi"), F.col("_s").alias("_hs"))
    each = t.select(*by, F.col(key).alias("_key"), F.col(volume).alias("_vol"), "_i", "_s").join(h, by).where(f"_i <= _hi OR _s <= _hs + {seconds}")
    later = each.groupBy(*by, tie).agg(F.max(F.col("_i") > F.col("_hi")).alias("_later")).where("_later").drop("_later")
    before, after = _shares(each.where("_i <= _hi"), [*by, tie], "_key", "_vol", "_b"), _shares(each, [*by, tie], "_key", "_vol", "_a")
    return after.join(before, [*by, tie]).join(later, [*by, tie]).select(*by, tie, (F.col("_a") - F.col("_b")).alias("change"))
