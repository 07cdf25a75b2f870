"""Trade and order operators over trades (code, seq, ts, price, volume, turnover, flag, ask_order, bid_order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.moments import corr


def order_lifetimes(trades: DataFrame, order: str = "ask_order") -> DataFrame:
    """By order: first and last time, trades, distinct times, volume, vwap; time_long where it trades at several times."""
    a = trades.groupBy(order).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))
    return a.withColumn("vwap", F.col("turnover") / F.col("volume")).withColumn("time_long", F.col("last_ts") > F.col("first_ts"))


def cross_section(trades: DataFrame) -> DataFrame:
    """By code: log volume, log count and vwap, each as a z-score over all codes."""
    a = trades.groupBy("code").agg(F.log(F.sum("volume")).alias("log_volume"), F.log(F.count(F.lit(1))).alias("log_count"), (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"))
    cols = ("log_volume", "log_count", "vwap")
    s = a.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    return a.crossJoin(F.broadcast(s)).select("code", *[F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0).alias(c) for c in cols])


def bars(df: DataFrame, by: list[str], ts: str, value: str, seconds: int, seq: str) -> DataFrame:
    """Open, high, low, close, sum and count of each bucket of time."""
    b = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds
    first, last = F.struct(ts, seq, value), F.struct(ts, seq, value)
    a = df.groupBy(*by, b.alias("bucket")).agg(F.min(first).alias("_f"), F.max(last).alias("_l"), F.max(value).alias("high"), F.min(value).alias("low"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return a.select(*by, "bucket", F.col(f"_f.{value}").alias("open"), "high", "low", F.col(f"_l.{value}").alias("close"), "total", "n")


def series_stats(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """By series: mean, std, max, min, range and lag-1 autocorrelation."""
    lagged = df.withColumn("_p", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))
    return lagged.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min"), (F.max(value) - F.min(value)).alias("range"), F.when((F.stddev_pop(F.when(F.col("_p").isNotNull(), F.col(value))) > 0) & (F.stddev_pop("_p") > 0), corr(value, "_p")).alias("autocorr1"))


def non_breakthrough(trades: DataFrame) -> DataFrame:
    """By code and day that has trades: volume at prices that the code's previous such day had too, and at others."""
    day = trades.withColumn("day", F.to_date("ts"))
    at = day.groupBy("code", "day", "price").agg(F.sum("volume").alias("volume"))
    order = Window.partitionBy("code").orderBy("day")
    placed = at.withColumn("place", F.dense_rank().over(order))
    before = placed.select("code", (F.col("place") + 1).alias("place"), "price", F.lit(1).alias("hit"))
    return placed.join(before, ["code", "place", "price"], "left").groupBy("code", "day").agg(F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("volume"))), F.lit(0.0)).alias("seen"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("volume"))), F.lit(0.0)).alias("fresh"))


def contaminated(trades: DataFrame, by: list[str], ts: str, seq: str, order: str, volume: str, top_percent: float, seconds: float) -> DataFrame:
    """trades with near: a small order's row gets the id of the large order nearest in time within `seconds` on either side, ties the earlier row; others keep their own.

    Large orders are those whose volume reaches that of the ceil(n * top_percent / 100)-th. The
    nearest row is the last large one before or the first after in order of time, which windows
    carry, so no range join is needed; of rows of one time and distance the first counts.
    """
    per = trades.groupBy(*by, order).agg(F.sum(volume).alias("_v"))
    share = min(1.0, max(0.01, top_percent / 100))
    w = Window.partitionBy(*by)
    placed = per.withColumn("_place", F.row_number().over(w.orderBy(F.col("_v").desc()))).withColumn("_n", F.count(F.lit(1)).over(w))
    cut = F.min(F.when(F.col("_place") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share)), F.col("_v"))).over(w)
    large = placed.withColumn("_big", F.col("_v") >= cut).select(*by, order, "_big")
    t = trades.join(large, [*by, order]).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    at = Window.partitionBy(*by, "_t").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_here", F.first(F.when(F.col("_big"), F.struct("_t", order)), True).over(at))  # the first large row of an instant stands for it
    before = F.last("_here", True).over(Window.partitionBy(*by).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_here", True).over(Window.partitionBy(*by).orderBy("_t").rangeBetween(0, Window.unboundedFollowing))
    t = t.withColumn("_b", before).withColumn("_a", after)
    far = lambda c: F.abs(F.col(f"{c}._t") - F.col("_t"))
    near = F.when(far("_b") <= F.coalesce(far("_a"), far("_b")), F.col("_b")).otherwise(F.coalesce("_a", "_b"))
    t = t.withColumn("_near", near)
    hit = ~F.col("_big") & (far("_near") <= int(seconds * 1e6))
    return t.withColumn("near", F.when(F.coalesce(hit, F.lit(False)), F.col(f"_near.{order}")).otherwise(F.col(order))).drop("_big", "_t", "_here", "_b", "_a", "_near")


def long_orders(trades: DataFrame, by: list[str], order: list[str], ts: str, key: str, volume: str) -> DataFrame:
    """Orders (key) that trade at several times (time_long) or with others between (count_long): by, key, time_long, count_long, own and other volume, ratio.

    `other` is what other orders trade between the order's first and last row: a running sum
    over the rows, taken at both ends, less its own.
    """
    row = Window.partitionBy(*by).orderBy(*order)
    t = trades.withColumn("_i", F.row_number().over(row)).withColumn("_c", F.sum(volume).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    ends = t.groupBy(*by, key).agg(F.min(F.struct("_i", (F.col("_c") - F.col(volume)).alias("c"))).alias("_a"), F.max(F.struct("_i", F.col("_c").alias("c"))).alias("_z"), F.count(F.lit(1)).alias("_n"), (F.min(ts) != F.max(ts)).alias("time_long"), F.sum(volume).alias("own"))
    out = ends.withColumn("count_long", F.col("_z._i") - F.col("_a._i") + 1 > F.col("_n")).withColumn("other", F.col("_z.c") - F.col("_a.c") - F.col("own"))
    return out.where("_n > 1 AND (time_long OR count_long)").select(*by, key, "time_long", "count_long", "own", "other", F.when(F.col("own") > 0, F.col("other") / F.col("own")).otherwise(0.0).alias("ratio"))


def pooled_long_orders(orders: DataFrame, by: list[str]) -> DataFrame:
    """By series: other over own volume of all time-long, count-long and doubly long orders; 0 where there is none."""
    kinds = {"time_long": F.col("time_long"), "count_long": F.col("count_long"), "both_long": F.col("time_long") & F.col("count_long")}
    return orders.groupBy(*by).agg(*[F.coalesce(F.try_divide(F.sum(F.when(k, F.col("other"))), F.sum(F.when(k, F.col("own")))), F.lit(0.0)).alias(n) for n, k in kinds.items()])
