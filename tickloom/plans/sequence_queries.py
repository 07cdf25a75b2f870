"""Queries of ordered series, kernels with SQL, tails and neighbours by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import kernels, sequences
from tickloom.plans.registry import _LIFE, _TRADES, add, r

_ORDER = ["ts", "seq"]
_ROWS = "OVER (PARTITION BY code ORDER BY ts, seq ROWS BETWEEN %d PRECEDING AND CURRENT ROW)"


def _returns(lookback: int, interval: int) -> str:
    at = range(1, lookback + 1, interval)
    logs = ", ".join(f"ln(a[{j}] / a[{i}])" for i, j in zip(at, at[1:]))
    return f"{_TRADES}, l AS (SELECT seq, list(price) {_ROWS % (lookback - 1)} AS a FROM trades), x AS (SELECT seq, CASE WHEN len(a) = {lookback} THEN list_sort([{logs}]) END AS s FROM l)"


_RETURNS = {
    "rolling_volatility": ("volatility", "list_aggregate(s, 'stddev_pop')"),
    "rolling_cv": ("cv", "CASE WHEN abs(list_avg(s)) >= 1e-9 THEN list_aggregate(s, 'stddev_pop') / abs(list_avg(s)) END"),
    "rolling_qcv": ("qcv", "CASE WHEN abs((s[2] + s[3]) / 2) >= 1e-9 THEN ((s[3] + s[4]) / 2 - (s[1] + s[2]) / 2) / abs((s[2] + s[3]) / 2) END"),
}
for _name, (_col, _sql) in _RETURNS.items():
    add(_name, lambda t, c=_col: sequences.rolling_returns(t("trades"), ["code"], _ORDER, "price", 13, 3, eps=1e-9).select("seq", r(c, 5).alias(c)), f"WITH {_returns(13, 3)} SELECT seq, round({_sql}, 5) AS {_col} FROM x")

_W20 = "(PARTITION BY code ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
add("rolling_correlation_mean", lambda t: sequences.rolling_correlation_mean(t("trades"), ["code"], _ORDER, ["price", "volume", "turnover"], 20).select("seq", r("corr_mean").alias("corr_mean")),
    f"WITH {_TRADES} SELECT seq, CASE WHEN count(*) OVER w >= 20 THEN round((3 + 2 * (corr(price, volume) OVER w + corr(price, turnover) OVER w + corr(volume, turnover) OVER w)) / 9, 6) END AS corr_mean FROM trades WINDOW w AS {_W20}")
add("trend", lambda t: sequences.trend(t("trades"), ["code"], _ORDER, "price").select("code", r("trend").alias("trend")),
    f"WITH {_TRADES}, i AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) AS i FROM trades) SELECT code, round(CASE WHEN count(price) > 1 AND stddev_pop(price) > 0 THEN corr(i, price) ELSE 0 END, 6) AS trend FROM i GROUP BY code")


add("segment_and_correlate", lambda t: sequences.runs_correlation(t("trades").withColumn("level", F.col("price") / 60), ["code"], _ORDER, "volume", "level", 4).select("code", "run", "above", "n", r("corr").alias("corr")),
    f"WITH {_TRADES}, u AS (SELECT *, price / 60 AS level, volume > price / 60 AS above FROM trades), c AS (SELECT *, CASE WHEN lag(above) OVER w <> above THEN 1 ELSE 0 END AS x FROM u WINDOW w AS (PARTITION BY code ORDER BY ts, seq)), g AS (SELECT *, sum(x) OVER (PARTITION BY code ORDER BY ts, seq)::BIGINT AS run FROM c) SELECT code, run, above, count(*) AS n, round(CASE WHEN stddev_pop(volume) > 0 AND stddev_pop(level) > 0 THEN corr(volume, level) END, 6) AS corr FROM g GROUP BY code, run, above HAVING count(*) >= 4")
_TAIL = ", ".join(f"max(CASE WHEN p{c} = floor(n * {q}) THEN {c} END) OVER (PARTITION BY code) AS {c}{s}" for c in ("price", "volume") for s, q in (("l", 0.1), ("u", 0.9)))
add("empirical_tail_dependence", lambda t: sequences.tail_dependence(t("trades"), ["code"], "price", "volume", 0.1).select("code", r("lower_tail").alias("lower_tail"), r("upper_tail").alias("upper_tail")),
    f"WITH {_TRADES}, p AS (SELECT code, price, volume, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY price) - 1 AS pprice, row_number() OVER (PARTITION BY code ORDER BY volume) - 1 AS pvolume FROM trades), h AS (SELECT *, {_TAIL} FROM p) SELECT code, round(avg((volume <= volumel)::INT) FILTER (WHERE price <= pricel), 6) AS lower_tail, round(avg((volume >= volumeu)::INT) FILTER (WHERE price >= priceu), 6) AS upper_tail FROM h GROUP BY code")
add("order_neighborhood_analysis", lambda t: sequences.id_neighbours(t("trades").groupBy("ask_order").agg(F.sum("volume").alias("volume")), "ask_order", "volume", 50),
    f"WITH {_LIFE} SELECT ask_order, count(*) OVER w - 1 AS n_near, sum(volume) OVER w - volume AS near FROM o WINDOW w AS (ORDER BY ask_order RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)")

# --- copulas --------------------------------------------------------------------------------

_UV = "u AS (SELECT p_partkey, (p_size + 1) / 60.0::DOUBLE AS u, (p_partkey % 97 + 1) / 100.0::DOUBLE AS v, 1 + p_size / 10.0::DOUBLE AS h, pow(-ln((p_size + 1) / 60.0::DOUBLE), 2.0) + pow(-ln((p_partkey % 97 + 1) / 100.0::DOUBLE), 2.0) AS s FROM part)"
add("gumbel_copula_pdf", lambda t: t("part").select("p_partkey", r(sequences.gumbel_pdf((F.col("p_size") + 1) / 60.0, (F.col("p_partkey") % 97 + 1) / 100.0, 2.0)).alias("c")),
    f"WITH {_UV} SELECT p_partkey, round(exp(-sqrt(s)) / (u * v) * (ln(u) * ln(v)) * pow(s, -1.5) * (sqrt(s) + 1), 6) AS c FROM u")


def _tail(t, f):
    return t("part").select("p_partkey", r(f(1 + F.col("p_size") / 10.0)).alias("tail"))


add("clayton_lower_tail_dependence", lambda t: _tail(t, lambda h: F.pow(F.lit(2.0), -1 / h)), f"WITH {_UV} SELECT p_partkey, round(pow(2.0, -1 / h), 6) AS tail FROM u")
add("gumbel_upper_tail_dependence", lambda t: _tail(t, lambda h: 2 - F.pow(F.lit(2.0), 1 / h)), f"WITH {_UV} SELECT p_partkey, round(2 - pow(2.0, 1 / h), 6) AS tail FROM u")


def _pairs(t):
    return t("embeddings").withColumn("nxt", F.expr("lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)")).where("embedding IS NOT NULL AND nxt IS NOT NULL")


def _copulas(t):
    tau = F.col("tau")
    return _pairs(t).select("vec_id", kernels.apply_two("kendall_tau", F.col("embedding"), F.col("nxt")).alias("tau")).select(
        "vec_id", r(tau).alias("tau"), r(F.sin(tau * 1.5707963267948966)).alias("gaussian_rho"), r(F.when(tau <= 0, 0.1).otherwise(2 * tau / (1 - tau))).alias("clayton_theta"), r(F.when(tau <= 0, 1.0).otherwise(1 / (1 - tau))).alias("gumbel_theta"))


_TAU = """p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
  x AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b, generate_subscripts(a, 1) AS i FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
  k AS (SELECT x.vec_id, sum(sign(y.a - x.a)::INT * sign(y.b - x.b)) AS s, sum(abs(sign(y.a - x.a))) AS na, sum(abs(sign(y.b - x.b))) AS nb FROM x JOIN x y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY x.vec_id),
  q AS (SELECT vec_id, CASE WHEN na > 0 AND nb > 0 THEN s / sqrt(na * nb) ELSE 0 END AS tau FROM k)"""
add("estimate_all_copulas", _copulas, f"WITH {_TAU} SELECT vec_id, round(tau, 6) AS tau, round(sin(tau * pi() / 2), 6) AS gaussian_rho, round(CASE WHEN tau <= 0 THEN 0.1 ELSE 2 * tau / (1 - tau) END, 6) AS clayton_theta, round(CASE WHEN tau <= 0 THEN 1.0 ELSE 1 / (1 - tau) END, 6) AS gumbel_theta FROM q")
add("copula_kendall_tau", lambda t: _copulas(t).select("vec_id", "tau"), f"WITH {_TAU} SELECT vec_id, round(tau, 6) AS tau FROM q")

# --- kernels that SQL can check -------------------------------------------------------------

_CELLS = "c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings)"
for _name, _kernel, _beats in (("max_range_loop", "max_range", ">"), ("min_range_loop", "min_range", "<")):
    add(_name, lambda t, k=_kernel: t("embeddings").where("embedding IS NOT NULL").select("vec_id", F.posexplode(kernels.apply_series(k, F.col("embedding"))).alias("i", "n")),
        f"WITH {_CELLS} SELECT c.vec_id, (c.i - 1)::INT AS i, (c.i - coalesce(max(d.i), 0))::INT AS n FROM c LEFT JOIN c d ON c.vec_id = d.vec_id AND d.i < c.i AND d.x {_beats} c.x GROUP BY c.vec_id, c.i")
add("find_max_range_product", lambda t: t("embeddings").where("embedding IS NOT NULL").select("vec_id", r(kernels.apply("max_range_product", F.transform("embedding", lambda x: F.abs(x).cast("double"))), 5).alias("best")),
    f"WITH {_CELLS} SELECT c.vec_id, round(max(least(abs(c.x), abs(d.x))::DOUBLE * (d.i - c.i)), 5) AS best FROM c JOIN c d ON c.vec_id = d.vec_id AND d.i > c.i GROUP BY c.vec_id")


def _cov(x: str, y: str):
    return F.array(F.array(F.var_pop(x), F.covar_pop(x, y)), F.array(F.covar_pop(x, y), F.var_pop(y)))


add("compute_max_eigenvalue", lambda t: t("trades").groupBy("code").agg(_cov("price", "volume").alias("m")).select("code", r(kernels.apply("max_eigenvalue", F.col("m")), 3).alias("value")),
    f"WITH {_TRADES}, m AS (SELECT code, var_pop(price) AS a, covar_pop(price, volume) AS b, var_pop(volume) AS d FROM trades GROUP BY code) SELECT code, round((a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b), 3) AS value FROM m")
add("calculate_effective_memory_length", lambda t: t("embeddings").where("embedding IS NOT NULL").select("vec_id", kernels.apply("memory_length", F.col("embedding")).alias("lag")))
add("check_string_proximity", lambda t: t("orders").select("o_orderkey", F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0").alias("a"), F.lpad((F.col("o_orderkey") * 7 % 10000).cast("string"), 4, "0").alias("b")).select("o_orderkey", kernels.apply_two("string_proximity", F.col("a"), F.col("b")).alias("steps")))
