"""Queries of the series kernels, and of what SQL can say of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import kernels, microstructure, series, statistics
from tickloom.plans.registry import _ROWS, _TRADES, add, r

_ORDER = ["ts", "seq"]
_DAY = 86400.0


def _timed(t) -> DataFrame:
    return t("trades").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def _kernel(name: str, kernel, out: dict, sql: str | None = None, rows=_timed) -> None:
    """A query of a kernel over each code's trades in order of time."""
    add(name, lambda t: series.by_series(rows(t), ["code"], _ORDER, ["seq"], kernel, out), sql)


_LATER = "a.code = b.code AND (b.ts > a.ts OR b.ts = a.ts AND b.seq >= a.seq) AND b.ts <= a.ts + INTERVAL %d DAY"
_HALF = f"""WITH {_TRADES}, {_ROWS}, p AS (SELECT a.rid, a.seq, a.ts, b.ts AS bts, b.price / a.price - 1 AS move FROM u a JOIN u b ON {_LATER % 30}),
 m AS (SELECT rid, greatest(max(move), 0) AS up, greatest(-min(move), 0) AS down FROM p GROUP BY rid),
 h AS (SELECT any_value(p.seq) AS seq, min(CASE WHEN (up > down AND move >= up / 2) OR (up <= down AND down > 0 AND -move >= down / 2) THEN epoch_us(bts) - epoch_us(ts) END) AS us FROM p JOIN m USING (rid) GROUP BY rid)
 SELECT seq, coalesce(us / 1e6, 2592000.0)::DOUBLE AS half FROM h"""
for _name in ("find_half_extreme_time", "fast_find_half_extreme_time", "super_find_half_extreme_time"):
    add(_name, lambda t: series.by_series(_timed(t), ["code"], _ORDER, ["seq"], lambda p: {"half": series.half_extreme(p.t, p.price, 30 * _DAY)}, {"half": "double"}).select("seq", "half"), _HALF)
add("find_half_energy_time", lambda t: series.by_series(_timed(t), ["code"], _ORDER, ["seq"], lambda p: {"half": series.half_energy(p.t, p.price, 30 * _DAY)}, {"half": "double"}).select("seq", "half"),
    f"""WITH {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) AS i FROM trades),
 f AS (SELECT a.code, a.i, min(b.i) AS j FROM o a JOIN o b ON a.code = b.code AND b.i > a.i AND b.ts >= a.ts + INTERVAL 30 DAY GROUP BY a.code, a.i),
 e AS (SELECT a.code, a.i, a.seq, a.ts, a.price, abs(b.price - a.price) / a.price / 2 AS need FROM o a LEFT JOIN f USING (code, i) LEFT JOIN o b ON b.code = a.code AND b.i = f.j),
 h AS (SELECT e.code, e.i, min(epoch_us(b.ts) - epoch_us(e.ts)) AS us FROM e JOIN o b ON b.code = e.code AND b.i > e.i AND b.ts <= e.ts + INTERVAL 30 DAY AND abs(b.price - e.price) / e.price >= e.need GROUP BY e.code, e.i)
 SELECT e.seq, (CASE WHEN coalesce(need, 0) = 0 THEN 0 ELSE coalesce(us / 1e6, 2592000.0) END)::DOUBLE AS half FROM e LEFT JOIN h USING (code, i)""")  # fmt: skip
for _name, _keys in (("mark_follow_groups", ["price", "volume"]), ("mark_follow_groups_with_flag", ["price", "volume", "flag"])):
    _kernel(_name, lambda p, k=_keys: {"group": series.follow_groups(p.t, list(p[k].itertuples(index=False, name=None)), 90 * _DAY)}, {"group": "long"})
_kernel("calculate_large_order_nearby_small_order_time_gap", lambda p: {"gap": series.nearby_gap(p.volume, p.t, 0.9, 0.3, 3)}, {"gap": "double"},
    f"""WITH {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) AS i, row_number() OVER (PARTITION BY code ORDER BY volume) - 1 AS k, count(*) OVER (PARTITION BY code) AS n FROM trades),
 c AS (SELECT code, max(CASE WHEN k = least(n - 1, ceil(n * 0.9)) THEN volume END) AS high, max(CASE WHEN k = least(n - 1, floor(n * 0.3)) THEN volume END) AS low FROM o GROUP BY code),
 g AS (SELECT a.code, a.i, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap, row_number() OVER (PARTITION BY a.code, a.i, b.i > a.i ORDER BY abs(b.i - a.i)) AS near FROM o a JOIN c USING (code) JOIN o b ON b.code = a.code AND b.i <> a.i AND b.volume <= low WHERE a.volume >= high),
 m AS (SELECT *, row_number() OVER (PARTITION BY code, i ORDER BY gap) AS best FROM g WHERE near <= 3)
 SELECT o.code, o.seq, (SELECT avg(gap) FROM m WHERE m.code = o.code AND m.i = o.i AND best <= 3) AS gap FROM o""")  # fmt: skip
for _name, _alpha in (("rolling_lagged_regression", 0.0), *((f"rolling_lagged_regression_ridge{s}", 1.0) for s in ("", "_fast", "_simd", "_incremental"))):
    _kernel(_name, lambda p, a=_alpha: dict(zip(_LAG, series.lagged_regression(p.volume, 12, 10, a).T)), _LAG := {f"{w}_{k}": "double" for w in ("past", "future") for k in (1, 2, 3)})
for _name in ("", "_optimized", "_simd", "_ultra"):
    add(f"rolling_window_core_feature{_name}", lambda t: series.by_series(t("events"), ["user_id"], ["event_id"], ["event_id"], lambda p: dict(zip(("core", "minor"), series.core_feature(p.value))), {"core": "double", "minor": "double"}))
add("local_correlation", lambda t: series.by_series(t("events").withColumn("one", F.lit(1.0)), ["user_id"], ["event_id"], ["event_id"], lambda p: dict(zip(series.LOCAL_NAMES, series.local_correlation(p.value, p.one, 5).T)), {c: "double" for c in series.LOCAL_NAMES}))
add("rolling_effective_memory_length", lambda t: series.by_series(t("events"), ["user_id"], ["event_id"], ["event_id"], lambda p: {"lag": series.rolling_memory(p.value, 12, 3)}, {"lag": "double"}))
for _name in ("rolling_information_gain", "rolling_information_gain_fast"):
    add(_name, lambda t: series.by_series(t("events"), ["user_id"], ["event_id"], ["event_id"], lambda p: dict(zip(("gain1", "gain2", "gain3"), series.rolling_gain(p.value, 12, 3).T)), {"gain1": "double", "gain2": "double", "gain3": "double"}))
add("rolling_dtw_distance", lambda t: series.by_series(t("events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), ["user_id"], ["ts", "event_id"], ["event_id"], lambda p: {"distance": series.rolling_dtw(p.value, np.sin(np.arange(8.0)), p.t, 7 * _DAY)}, {"distance": "double"}))
_PEAKS = {"row": "long", "n": "long", "sum_ratio": "double", "mean_ratio": "double", "mean_gap": "double", "corr": "double"}
add("trade_peak_analysis", lambda t: series.reduce_series(_timed(t), ["code"], _ORDER, lambda p: series.peaks(p.t, p.volume, p.flag, 0.05, 0.5, 30 * _DAY), _PEAKS).select("code", "row", "n", r("sum_ratio").alias("sum_ratio"), r("mean_gap", 3).alias("mean_gap")),
    f"""WITH {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) - 1 AS i, row_number() OVER (PARTITION BY code ORDER BY volume DESC) - 1 AS k, count(*) OVER (PARTITION BY code) AS m FROM trades),
 c AS (SELECT code, max(CASE WHEN k = least(m - 1, floor(m * 0.05)) THEN volume END) AS high, max(CASE WHEN k = least(m - 1, floor(m * 0.5)) THEN volume END) AS low FROM o GROUP BY code),
 p AS (SELECT a.code, a.i, a.volume, b.volume AS other, b.i AS j, low, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS gap FROM o a JOIN c USING (code) JOIN o b ON b.code = a.code AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 2592000000000 WHERE a.volume >= high),
 s AS (SELECT code, i, volume, max(other) AS top, count(*) FILTER (WHERE j <> i AND other >= low) AS n, sum(other) FILTER (WHERE j <> i AND other >= low) AS total, avg(gap) FILTER (WHERE j <> i AND other >= low) AS gap FROM p GROUP BY ALL)
 SELECT code, i AS "row", n, round(coalesce(total / volume, 0), 6) AS sum_ratio, round(coalesce(gap, 0), 3) AS mean_gap FROM s WHERE top <= volume""")  # fmt: skip


def _each(name: str, kernel, out: dict, sql: str | None = None) -> None:
    """A query of one row for each code."""
    add(name, lambda t: series.reduce_series(_timed(t), ["code"], _ORDER, lambda p: [kernel(p)], out).select("code", *[r(c).alias(c) if k == "double" else F.col(c) for c, k in out.items()]), sql)


_STATES = "d AS (SELECT code, ts, seq, least((row_number() OVER (PARTITION BY code ORDER BY price, ts, seq) - 1) // greatest(1, count(*) OVER (PARTITION BY code) // 3), 2) + 1 AS x, least((row_number() OVER (PARTITION BY code ORDER BY volume, ts, seq) - 1) // greatest(1, count(*) OVER (PARTITION BY code) // 3), 2) + 1 AS y FROM trades), l AS (SELECT code, lag(x) OVER (PARTITION BY code ORDER BY ts, seq) AS x, y FROM d), k AS (SELECT * FROM l WHERE x IS NOT NULL), j AS (SELECT code, x, y, count(*)::DOUBLE AS c FROM k GROUP BY ALL), mx AS (SELECT code, x, count(*)::DOUBLE AS n FROM k GROUP BY ALL), my AS (SELECT code, y, count(*)::DOUBLE AS n FROM k GROUP BY ALL), a AS (SELECT code, count(*)::DOUBLE AS n FROM k GROUP BY ALL)"
_each("transfer_entropy", lambda p: {"te": series.transfer_entropy(p.price, p.volume, 1, 3, safe=False)}, {"te": "double"}, f"WITH {_TRADES}, {_STATES}, yx AS (SELECT code, y AS x, n FROM my) SELECT code, round(sum(c / a.n * log2(c * c / yx.n / my.n)), 6) AS te FROM j JOIN my USING (code, y) JOIN yx USING (code, x) JOIN a USING (code) GROUP BY code")
_each("transfer_entropy_safe", lambda p: {"te": series.transfer_entropy(p.price, p.volume, 1, 3)}, {"te": "double"}, f"WITH {_TRADES}, {_STATES} SELECT code, round(sum(c / a.n * log2(c * c / mx.n / (my.n / a.n))), 6) AS te FROM j JOIN mx USING (code, x) JOIN my USING (code, y) JOIN a USING (code) GROUP BY code")
_each("fractal_dimension_boxcount", lambda p: {"dimension": series.boxes(p.t, p.price)}, {"dimension": "double"},
    f"WITH {_TRADES}, u AS (SELECT code, (epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER w) / greatest(max(epoch_us(ts) / 1e6) OVER w - min(epoch_us(ts) / 1e6) OVER w, 1e-9) AS x, (price - min(price) OVER w) / greatest(max(price) OVER w - min(price) OVER w, 1e-9) AS y FROM trades WINDOW w AS (PARTITION BY code)), b AS (SELECT code, k, count(DISTINCT least(floor(x * k), k - 1) * k + least(floor(y * k), k - 1)) AS n FROM u, (SELECT unnest([2, 4, 8, 16, 32]) AS k) GROUP BY ALL) SELECT code, round(regr_slope(ln(n), ln(k)), 6) AS dimension FROM b GROUP BY code")
_each("hurst_exponent_rs", lambda p: {"hurst": series.hurst_rs(p.price)}, {"hurst": "double"},
    f"WITH {_TRADES}, l AS (SELECT code, ts, seq, ln(price / lag(price) OVER (PARTITION BY code ORDER BY ts, seq)) AS r FROM trades), m AS (SELECT *, r - avg(r) OVER (PARTITION BY code) AS d FROM l WHERE r IS NOT NULL), c AS (SELECT *, sum(d) OVER (PARTITION BY code ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS z FROM m) SELECT code, round(greatest(0, least(1, ln((max(z) - min(z)) / stddev_pop(r)) / ln(count(*) / 2.0))), 6) AS hurst FROM c GROUP BY code")
_IRR = {c: "double" for c in ("i_ord", "permutation_entropy", "normalized_entropy", "forbidden_ratio", "kl_divergence")}
_PAT = "o AS (SELECT code, row_number() OVER w AS i, price AS a, lead(price, 1) OVER w AS b, lead(price, 2) OVER w AS c FROM trades WINDOW w AS (PARTITION BY code ORDER BY ts, seq)), q AS (SELECT code, i, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS p FROM o WHERE c IS NOT NULL)"
add("time_irreversibility_static_detailed", lambda t: series.reduce_series(_timed(t), ["code"], _ORDER, lambda p: [series.irreversibility(p.price, 3)], _IRR).select("code", r("i_ord").alias("i_ord"), r("permutation_entropy").alias("permutation_entropy")),
    f"WITH {_TRADES}, {_PAT}, k AS (SELECT code, p, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY code) AS f FROM q GROUP BY code, p), b AS (SELECT code, reverse(p) AS p, f AS g FROM k), j AS (SELECT coalesce(k.code, b.code) AS code, coalesce(f, 0) AS f, coalesce(g, 0) AS g FROM k FULL JOIN b ON k.code = b.code AND k.p = b.p) SELECT code, round(sum(abs(f - g)) / 2, 6) AS i_ord, round(-sum(CASE WHEN f > 0 THEN f * ln(f) ELSE 0 END), 6) AS permutation_entropy FROM j GROUP BY code")
_TRANS = f"WITH {_TRADES}, {_PAT}, n AS (SELECT code, p AS x, lead(p) OVER (PARTITION BY code ORDER BY i) AS y FROM q), f AS (SELECT code, x, y, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY code) AS f FROM n WHERE y IS NOT NULL GROUP BY code, x, y), act AS (SELECT DISTINCT code, x FROM f), j AS (SELECT a.code, coalesce(u.f, 0) AS f, coalesce(v.f, 0) AS g FROM act a JOIN act b ON a.code = b.code LEFT JOIN f u ON u.code = a.code AND u.x = a.x AND u.y = b.x LEFT JOIN f v ON v.code = a.code AND v.x = b.x AND v.y = a.x) SELECT code, round(sum(abs(f - g)) / 2, 6) AS i_trans FROM j GROUP BY code"
for _name in ("simple", "detailed"):
    add(f"time_irreversibility_transfer_{_name}", lambda t: series.reduce_series(_timed(t), ["code"], _ORDER, lambda p: [series.transfer_irreversibility(p.price, 3)], {"i_trans": "double", "entropy_rate": "double"}).select("code", r("i_trans").alias("i_trans")), _TRANS)
_each("lz_complexity", lambda p: {"lz": kernels.lz_complexity(p.price, quantiles=(1 / 3, 2 / 3))}, {"lz": "double"})
_each("lz_complexity_detailed", lambda p: {"lz": kernels.lz_complexity(p.price, quantiles=(0.5,)), "phrases": kernels.lz_complexity(p.price, False, (0.5,))}, {"lz": "double", "phrases": "double"})

# x_i - x_j has rank two: its eigenvalues are 0 but for a pair of size sqrt(n sum(x^2) - sum(x)^2)
_EIGEN = "SELECT vec_id, round(sqrt(greatest(0, n * s2 - s1 * s1)), 3) AS largest FROM (SELECT vec_id, len(embedding) AS n, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s1, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) AS s2 FROM embeddings)"


def _eigen(t):
    v = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").where("embedding IS NOT NULL").select("vec_id", r(F.sqrt(F.greatest(F.lit(0.0), F.size(v) * total(F.transform(v, lambda x: x * x)) - F.pow(total(v), F.lit(2.0)))), 3).alias("largest"))


for _name in ("", "_optimized", "_safe"):
    add(f"matrix_eigenvalue_analysis{_name}", _eigen, _EIGEN)
for _name in ("", "_ultra"):
    add(f"matrix_eigenvalue_analysis_modified{_name}", lambda t: series.reduce_series(t("embeddings").where("embedding IS NOT NULL"), ["vec_id"], ["vec_id"], lambda p: [{"i": i, "size": float(s)} for v in p.embedding for i, s in enumerate(series.difference_eigenvalues(v, True)[:5])], {"i": "int", "size": "double"}))

# --- entropies of order shares --------------------------------------------------------------

_SEC = "o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) - 1 AS i, epoch_us(ts) // 1000000 AS s FROM trades)"
_ENT = "SELECT code, round(-sum(CASE WHEN v > 0 THEN v / t * ln(v / t) ELSE 0 END), 6) AS entropy FROM (SELECT code, sum(volume) AS v, sum(sum(volume)) OVER (PARTITION BY code) AS t FROM %s GROUP BY code, ask_order) GROUP BY code"
add("calculate_base_entropy", lambda t: statistics.order_entropy(t("trades"), ["code"], _ORDER, "ask_order", "volume", 25).select("code", r("entropy").alias("entropy")), f"WITH {_TRADES}, {_SEC}, w AS (SELECT * FROM o WHERE i <= 25) {_ENT % 'w'}")
add("calculate_window_entropy", lambda t: statistics.order_entropy(t("trades"), ["code"], _ORDER, "ask_order", "volume", 25, "ts", 30 * 86400).select("code", r("entropy").alias("entropy")),
    f"WITH {_TRADES}, {_SEC}, e AS (SELECT code, s + 2592000 AS till FROM o WHERE i = 25), w AS (SELECT o.* FROM o LEFT JOIN e USING (code) WHERE i <= 25 OR s <= till) {_ENT % 'w'}")
for _name, _sign in (("", ""), ("_at_low", "-")):
    add(f"calculate_shannon_entropy_change{_name}", lambda t, low=bool(_sign): statistics.entropy_changes(t("trades"), ["code"], _ORDER, "ts", "ask_order", "volume", "price", 30 * 86400, low).select("code", "seq", r("change").alias("change")),
        f"""WITH {_TRADES}, {_SEC}, h AS (SELECT code, i, s, seq FROM (SELECT *, max({_sign}price) OVER (PARTITION BY code ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o) WHERE i > 0 AND {_sign}price > top),
 p AS (SELECT h.code, h.seq, o.ask_order, sum(o.volume) FILTER (WHERE o.i <= h.i) AS v, sum(o.volume) AS u, count(*) FILTER (WHERE o.i > h.i) AS later FROM h JOIN o ON o.code = h.code AND (o.i <= h.i OR o.s <= h.s + 2592000) GROUP BY ALL),
 q AS (SELECT *, sum(v) OVER w AS tv, sum(u) OVER w AS tu FROM p WINDOW w AS (PARTITION BY code, seq))
 SELECT code, seq, round(-sum(u / tu * ln(u / tu)) + sum(CASE WHEN v > 0 THEN v / tv * ln(v / tv) ELSE 0 END), 6) AS change FROM q GROUP BY code, seq HAVING sum(later) > 0""")  # fmt: skip

# --- orders ---------------------------------------------------------------------------------

_NEAR = f"""WITH {_TRADES}, v AS (SELECT code, %s AS id, sum(volume) AS v FROM trades GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY v DESC) AS place, count(*) OVER (PARTITION BY code) AS n FROM v),
 c AS (SELECT code, min(v) AS cut FROM k WHERE place <= greatest(1, least(n, ceil(n * 0.1))) GROUP BY code), b AS (SELECT code, id FROM v JOIN c USING (code) WHERE v >= cut),
 {_ROWS}, o AS (SELECT t.*, %s AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY code ORDER BY ts, seq) AS i FROM u t), g AS (SELECT o.* FROM o JOIN b USING (code, id)),
 p AS (SELECT o.rid, arg_min(g.id, (abs(g.us - o.us), g.i)) AS near FROM o JOIN g ON g.code = o.code AND abs(g.us - o.us) <= 2592000000000 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.code = o.code AND b.id = o.id) GROUP BY o.rid)
 SELECT %s o.seq, coalesce(p.near, o.id) AS %s FROM o LEFT JOIN p USING (rid)"""
for _name in ("order_contamination", "order_contamination_parallel"):
    add(_name, lambda t: microstructure.contaminated(t("trades"), ["code"], "ts", "seq", "ask_order", "volume", 10.0, 30 * _DAY).select("seq", F.col("near").alias("ask_order")), _NEAR % ("ask_order", "ask_order", "", "ask_order"))
add("order_contamination_bilateral", lambda t: microstructure.contaminated(t("trades"), ["code"], "ts", "seq", "ask_order", "volume", 10.0, 30 * _DAY).withColumnRenamed("near", "ask_near").transform(lambda d: microstructure.contaminated(d, ["code"], "ts", "seq", "bid_order", "volume", 10.0, 30 * _DAY)).select("seq", "ask_near", F.col("near").alias("bid_near")),
    f"SELECT a.seq, a.near AS ask_near, b.near AS bid_near FROM ({_NEAR % ('ask_order', 'ask_order', 'rid,', 'near')}) a JOIN ({_NEAR % ('bid_order', 'bid_order', 'rid,', 'near')}) b USING (rid)")
_LONG = f"""WITH {_TRADES}, o AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY ts, seq) AS i FROM trades), g AS (SELECT flag, bid_order, min(i) AS a, max(i) AS z, count(*) AS n, count(DISTINCT ts) AS times, sum(volume) AS own FROM o GROUP BY ALL),
 l AS (SELECT *, times > 1 AS time_long, z - a + 1 > n AS count_long FROM g WHERE z > a), c AS (SELECT flag, i, sum(volume) OVER (PARTITION BY flag ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum, volume FROM o),
 x AS (SELECT l.*, hi.cum - lo.cum + lo.volume - l.own AS other FROM l JOIN c lo ON lo.flag = l.flag AND lo.i = l.a JOIN c hi ON hi.flag = l.flag AND hi.i = l.z WHERE time_long OR count_long)"""
for _name in ("analyze_long_orders", "analyze_long_orders_python"):
    add(_name, lambda t: microstructure.long_orders(t("trades"), ["flag"], _ORDER, "ts", "bid_order", "volume").select("flag", "bid_order", "time_long", "count_long", r("ratio").alias("ratio")), f"{_LONG} SELECT flag, bid_order, time_long, count_long, round(other / own, 6) AS ratio FROM x")
add("analyze_long_orders_pooled", lambda t: microstructure.pooled_long_orders(microstructure.long_orders(t("trades"), ["flag"], _ORDER, "ts", "bid_order", "volume"), ["flag"]).select("flag", *[r(c).alias(c) for c in ("time_long", "count_long", "both_long")]),
    f"{_LONG} SELECT flag, round(coalesce(sum(other) FILTER (WHERE time_long) / sum(own) FILTER (WHERE time_long), 0), 6) AS time_long, round(coalesce(sum(other) FILTER (WHERE count_long) / sum(own) FILTER (WHERE count_long), 0), 6) AS count_long, round(coalesce(sum(other) FILTER (WHERE time_long AND count_long) / sum(own) FILTER (WHERE time_long AND count_long), 0), 6) AS both_long FROM x GROUP BY flag")
