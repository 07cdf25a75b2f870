"""Time windows that begin or end at a row, with ties in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is micros * 2^41 + the row's place in its instant, as a decimal: 2^40 rows of one instant are told apart, and an edge that is 2^40 - 1 places on takes in a whole instant but none of the next.
PLACES = 1 << 40


def frame_key(df: DataFrame, by: list[str], ts: str, seq: str) -> DataFrame:
    """df with a decimal column _k that orders a series by time, ties by seq."""
    place = F.row_number().over(Window.partitionBy(*by, ts).orderBy(seq)) - 1
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(38,0)")
    return df.withColumn("_k", (micros * F.lit(2 * PLACES).cast("decimal(13,0)") + place).cast("decimal(38,0)"))


def frame(by: list[str], seconds: float, back: bool, current: bool = True) -> str:
    """SQL of the window from a row to `seconds` later (or earlier), both ends included, over _k."""
    far = f"CAST({int(round(seconds * 1e6)) * 2 * PLACES + PLACES - 1} AS DECIMAL(38,0))"
    near = "CURRENT ROW" if current else f"CAST(1 AS DECIMAL(38,0)) {'PRECEDING' if back else 'FOLLOWING'}"
    edge = f"{far} PRECEDING AND {near}" if back else f"{near} AND {far} FOLLOWING"
    return f"(PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY _k RANGE BETWEEN {edge})"


_SIMPLE = {"mean": "avg", "sum": "sum", "max": "max", "min": "min", "count": "count", "first": "first", "last": "last"}


def stat(kind: str, value: str, w: str, time: str = "_t", index: str = "_i") -> Column:
    """One statistic over a frame; flat windows give no std, skew or trend. std is the sample's, skew the population's.

    rank is where the row's value lies among the window's, 0 to 1, ties in their middle (the
    window holds the row itself); trend_time is the correlation with the time, trend_oneton
    with the places 1 to n.
    """
    over = lambda f: f"{f} OVER {w}"
    n, mean = over(f"count({value})"), over(f"avg({value})")
    if kind == "std":
        return F.expr(f"CASE WHEN {n} > 1 THEN {over(f'stddev_samp({value})')} END")
    if kind == "skew":
        two, three = over(f"avg({value} * {value})"), over(f"avg({value} * {value} * {value})")
        var = f"({two} - {mean} * {mean})"
        return F.expr(f"CASE WHEN {n} > 2 AND {var} > 1e-9 THEN ({three} - 3 * {mean} * {two} + 2 * {mean} * {mean} * {mean}) / power({var}, 1.5) END")
    if kind in ("trend_time", "trend_oneton"):
        x = time if kind == "trend_time" else index
        cov, sx, sy = over(f"covar_pop({x}, {value})"), over(f"stddev_pop(CASE WHEN {value} IS NOT NULL THEN {x} END)"), over(f"stddev_pop({value})")
        return F.expr(f"CASE WHEN {n} > 2 AND {sy} > 1e-9 THEN try_divide({cov}, {sx} * {sy}) END")
    if kind == "median":
        return F.expr(over(f"percentile({value}, 0.5)"))
    if kind == "rank":
        values = over(f"collect_list({value})")
        below, same = f"size(filter({values}, x -> x < {value} - 1e-10))", f"size(filter({values}, x -> abs(x - {value}) <= 1e-10))"
        return F.expr(f"CASE WHEN {n} > 1 THEN ({below} + ({same} - 1) / 2) / ({n} - 1) END")
    return F.expr(over(f"{_SIMPLE[kind]}({value})"))


def rolling(df: DataFrame, by: list[str], ts: str, seq: str, value: str, seconds: float, kinds: list[str], back: bool = False, current: bool = True) -> DataFrame:
    """Statistics of the window that begins (or ends) at each row, as columns named by kind; rank always holds the row itself."""
    keyed = frame_key(df, by, ts, seq).withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - 1.6e9)
    keyed = keyed.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("_k")).cast("double"))
    return keyed.select("*", *[stat(k, f"`{value}`", frame(by, seconds, back, current or k == "rank")).alias(k) for k in kinds]).drop("_k", "_t", "_i")


def local_peaks(df: DataFrame, by: list[str], ts: str, seq: str, value: str, seconds: float) -> DataFrame:
    """peak: no later row of the window is higher; the last row of a series is one."""
    w = frame(by, seconds, back=False, current=False)
    return frame_key(df, by, ts, seq).withColumn("peak", F.expr(f"coalesce(max(`{value}`) OVER {w} <= `{value}`, true)")).drop("_k")


def follow_sum(df: DataFrame, by: list[str], ts: str, seq: str, value: str, seconds: float, alone: bool = False) -> DataFrame:
    """follow: the sum of `value` over this row and later ones of its group within the window; none if it stands alone, unless `alone`."""
    w = frame(by, seconds, back=False)
    total = f"sum(`{value}`) OVER {w}"
    return frame_key(df, by, ts, seq).withColumn("follow", F.expr(total if alone else f"CASE WHEN count(`{value}`) OVER {w} > 1 THEN {total} END")).drop("_k")
