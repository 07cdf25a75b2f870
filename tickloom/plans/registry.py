"""All registered queries and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features, kernels, microstructure, relational, statistics, windows
from tickloom.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, f: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None) -> None:
    """Register f, which gets a reader of tables by name; 'trades' is the trade view of lineitem."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda t: tables.trades(spark, sf_dir) if t == "trades" else tables.read(spark, sf_dir, t))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


_TRADES = """trades AS (SELECT l_suppkey AS code, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS ts, l_extendedprice / l_quantity AS price,
  l_quantity AS volume, l_extendedprice AS turnover, CASE l_returnflag WHEN 'R' THEN 66 WHEN 'A' THEN 83 ELSE 32 END AS flag, l_orderkey AS ask_order, l_partkey AS bid_order FROM lineitem)"""

#: Trades with a number of their own, as seq repeats.
_ROWS = "u AS (SELECT *, row_number() OVER (ORDER BY seq, ts, turnover, bid_order, code) AS rid FROM trades)"

# --- time windows over events by user -------------------------------------------------------

_W = 3600.0 * 24
#: Each row with the rows of its window, found by plain comparison of times.
_PAIRS = """p AS (SELECT a.event_id, a.value AS own, b.value, b.ts, b.event_id AS other, b.i FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND {}),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


def _in_window(back: bool, current: bool = True) -> str:
    least = "b.i <= a.i" if back else "b.i >= a.i"
    edge = "b.ts >= a.ts - INTERVAL 1 DAY" if back else "b.ts <= a.ts + INTERVAL 1 DAY"
    e, p = reversed(_PAIRS.format(f"{least if current else least.replace('=', '')} AND {edge}").split("),\n  "))
    return f"{e}, {p})"


_STAT = {
    "mean": "avg(value)", "sum": "sum(value)", "max": "max(value)", "min": "min(value)", "count": "count(value)", "last": "arg_max(value, i)", "first": "arg_min(value, i)",
    "std": "stddev_samp(value)", "median": "quantile_cont(value, 0.5)", "rank": "CASE WHEN count(value) > 1 THEN (sum((value < own)::INT) + (sum((value = own)::INT) - 1) / 2.0) / (count(value) - 1) END",
    "skew": "CASE WHEN count(value) > 2 AND var_pop(value) > 1e-9 THEN (avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / ((avg(value ** 2) - avg(value) ** 2) ** 1.5) END",
    "trend_time": "CASE WHEN count(value) > 2 AND stddev_pop(value) > 0 THEN corr(epoch_us(ts) / 1e6 - 1.6e9, value) END", "trend_oneton": "CASE WHEN count(value) > 2 AND stddev_pop(value) > 0 THEN corr(i, value) END",
}


def _rolling(kind: str, back: bool, current: bool = True):
    return lambda t: windows.rolling(t("events"), ["user_id"], "ts", "event_id", "value", _W, [kind], back, current).select("event_id", r(F.col(kind) + 1e-9, 4).alias(kind))


for _back, _word in ((False, "future"), (True, "past")):
    for _kind, _sql in _STAT.items():
        if (_kind, _back) != ("first", False):
            add(f"rolling_{_word}_{_kind}", _rolling(_kind, _back), f"WITH {_in_window(_back)} SELECT event_id, round(({_sql}) + 1e-9, 4) AS {_kind} FROM p GROUP BY event_id")
    add(f"rolling_{_word}_mean_without_current", _rolling("mean", _back, False), f"WITH {_in_window(_back, False)} SELECT event_id, round(avg(value) + 1e-9, 4) AS mean FROM p GROUP BY event_id")

add("find_local_peaks_within_window", lambda t: windows.local_peaks(t("events"), ["user_id"], "ts", "event_id", "value", _W).select("event_id", "peak"),
    f"WITH {_in_window(False, False)} SELECT event_id, coalesce(max(value) <= any_value(own), true) AS peak FROM p GROUP BY event_id")
_FOLLOW = f"WITH {_TRADES}, {_ROWS} SELECT a.seq, %s AS follow FROM u a JOIN u b ON a.code = b.code AND a.price = b.price AND a.volume = b.volume%s AND (b.ts > a.ts OR b.ts = a.ts AND b.seq >= a.seq) AND b.ts <= a.ts + INTERVAL 900 DAY GROUP BY a.rid, a.seq"
add("find_follow_volume_sum_same_price", lambda t: windows.follow_sum(t("trades"), ["code", "price", "volume"], "ts", "seq", "volume", _W * 900).select("seq", "follow"), _FOLLOW % ("CASE WHEN count(*) > 1 THEN sum(b.volume) END", ""))
add("find_follow_volume_sum_same_price_and_flag", lambda t: windows.follow_sum(t("trades"), ["code", "price", "volume", "flag"], "ts", "seq", "volume", _W * 900, alone=True).select("seq", "follow"), _FOLLOW % ("sum(b.volume)", " AND a.flag = b.flag"))

# --- joins, ranks, groups -------------------------------------------------------------------

for _how in ("inner", "left", "right", "outer"):
    add(f"fast_{_how}_join", lambda t, how=_how: relational.merge(t("customer").select("c_custkey", F.col("c_nationkey").alias("key")), t("supplier").select("s_suppkey", F.col("s_nationkey").alias("key")).where("key < 12"), ["key"], {"outer": "full"}.get(how, how)),
        f"SELECT key, c_custkey, s_suppkey FROM (SELECT c_custkey, c_nationkey AS key FROM customer) {'FULL' if _how == 'outer' else _how.upper()} JOIN (SELECT s_suppkey, s_nationkey AS key FROM supplier WHERE s_nationkey < 12) USING (key)")
add("fast_merge", lambda t: relational.merge(t("orders").select("o_orderkey", "o_custkey"), t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment"),
    "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
add("semi_join", lambda t: t("customer").join(t("orders").where("o_totalprice > 200000"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
add("resume_anti_join", lambda t: tables.remaining(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")).where("c_custkey % 3 <> 0"), ["c_custkey"]), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)")
_RANKS = {"average": "rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0", "min": "rank() OVER w", "max": "rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1", "dense": "dense_rank() OVER w", "first": "row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)"}
for _m, _sql in _RANKS.items():
    add(f"rank_axis1_{_m}", lambda t, m=_m: relational.rank(t("part"), ["p_brand"], "p_size", m, first="p_partkey").select("p_partkey", "rank"), f"SELECT p_partkey, ({_sql})::DOUBLE AS rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
_MONTH = "o AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS date, o_custkey AS code, o_totalprice AS factor, (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS ret FROM orders)"


def _panel(t) -> DataFrame:
    return t("orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("date"), F.col("o_custkey").alias("code"), F.col("o_totalprice").alias("factor"), ((F.col("o_orderkey") * 37 % 1000) / 1000.0).alias("ret"))


add("factor_grouping", lambda t: relational.factor_grouping(_panel(t), ["date"], "factor", "o_orderkey").select("o_orderkey", "group"),
    f"WITH {_MONTH}, a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, o_orderkey) - 1 AS place, greatest(1, floor(count(factor) OVER (PARTITION BY date) / 10.0 + 0.5)) AS size FROM o) SELECT o_orderkey, least(10, floor(place / size) + 1)::INT AS \"group\" FROM a")
_RANKED = f"{_MONTH}, k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rr, count(*) OVER (PARTITION BY date) AS n FROM o)"
add("factor_correlation_by_date", lambda t: relational.rank_correlation(_panel(t), "date", "factor", "ret").select("date", r("corr").alias("corr")), f"WITH {_RANKED} SELECT date, round(CASE WHEN stddev_pop(rf) > 0 AND stddev_pop(rr) > 0 THEN corr(rf, rr) END, 6) AS corr FROM k GROUP BY date")
add("tail_v2_backtest_block", lambda t: relational.backtest(_panel(t), "date", "factor", "ret").select("date", "n", r("ic").alias("ic"), r("long_short").alias("long_short")),
    f"WITH {_RANKED} SELECT date, count(*) AS n, round(CASE WHEN stddev_pop(rf) > 0 AND stddev_pop(rr) > 0 THEN corr(rf, rr) END, 6) AS ic, round(avg(ret) FILTER (WHERE ceil(rf / n * 5) = 5) - avg(ret) FILTER (WHERE ceil(rf / n * 5) = 1), 6) AS long_short FROM k GROUP BY date")
add("cross_section_zscore", lambda t: relational.zscore(_panel(t), ["date"], "factor").select("o_orderkey", r("z").alias("z")), f"WITH {_MONTH} SELECT o_orderkey, round(CASE WHEN stddev_pop(factor) OVER w > 0 THEN (factor - avg(factor) OVER w) / stddev_pop(factor) OVER w ELSE 0 END, 6) AS z FROM o WINDOW w AS (PARTITION BY date)")


def _daily(t) -> DataFrame:
    return t("trades").groupBy(F.trunc("ts", "month").alias("date"), "code").agg(F.sum("volume").alias("value"))


_DAILY = f"{_TRADES}, d AS (SELECT date_trunc('month', ts)::DATE AS date, code, sum(volume) AS value FROM trades GROUP BY ALL)"
add("tail_v2_rank_roll_factor", lambda t: relational.rank_roll(_daily(t), "date", "code", "value", 6).select("date", "code", "rank", r("mean").alias("mean"), "max", "min"),
    f"WITH {_DAILY}, k AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0)::DOUBLE AS rank FROM d) SELECT date, code, rank, CASE WHEN count(*) OVER w >= 3 THEN round(avg(rank) OVER w, 6) END AS mean, CASE WHEN count(*) OVER w >= 3 THEN max(rank) OVER w END AS max, CASE WHEN count(*) OVER w >= 3 THEN min(rank) OVER w END AS min FROM k WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)")
add("trading_day_calendar", lambda t: relational.calendar(t("orders").select(F.to_date("o_orderdate").alias("date")), "date"),
    "WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) SELECT date, row_number() OVER w::INT AS place, lag(date) OVER w AS last_day, lead(date) OVER w AS next_day FROM d WINDOW w AS (ORDER BY date)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))

# --- reducers -------------------------------------------------------------------------------

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("fast_correlation_matrix", lambda t: statistics.correlation_matrix(t("lineitem"), _NUM).withColumn("corr", r("corr")), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i:]))
add("dataframe_corrwith", lambda t: statistics.corrwith(t("trades"), ["code"], "price", "volume").select("code", r("corr").alias("corr")), f"WITH {_TRADES} SELECT code, round(CASE WHEN stddev_pop(price) > 0 AND stddev_pop(volume) > 0 THEN corr(price, volume) END, 6) AS corr FROM trades GROUP BY code")
add("ols", lambda t: statistics.ols(t("trades"), ["code"], "turnover", "volume").select("code", r("b0", 3).alias("b0"), r("b1", 3).alias("b1"), r("r2").alias("r2")), f"WITH {_TRADES} SELECT code, round(regr_intercept(turnover, volume), 3) AS b0, round(regr_slope(turnover, volume), 3) AS b1, round(regr_r2(turnover, volume), 6) AS r2 FROM trades GROUP BY code HAVING count(*) > 0")
add("ols_residuals", lambda t: statistics.ols_residuals(t("trades"), ["code"], "turnover", "volume").select("seq", r("residual", 3).alias("residual")), f"WITH {_TRADES}, f AS (SELECT code, regr_intercept(turnover, volume) AS b0, regr_slope(turnover, volume) AS b1 FROM trades GROUP BY code) SELECT seq, round(turnover - b0 - b1 * volume, 3) AS residual FROM trades JOIN f USING (code)")
for _name, _col in (("calculate_entropy_1d", "volume"), ("calculate_entropy_discrete_1d", "flag")):
    add(_name, lambda t, c=_col: statistics.entropy(t("trades"), ["code"], F.format_number(c, 10)).select("code", r("entropy").alias("entropy")), f"WITH {_TRADES}, c AS (SELECT code, {_col}, count(*) AS n FROM trades GROUP BY ALL) SELECT code, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY code")
_BIN = {"equal_width": "CASE WHEN max(price) OVER w > min(price) OVER w THEN least(9, floor((price - min(price) OVER w) / ((max(price) OVER w - min(price) OVER w) / 10))) ELSE 0 END", "equal_frequency": "least(9, floor((row_number() OVER (PARTITION BY code ORDER BY price, seq) - 1) * 10 / count(price) OVER w))"}
for _m, _sql in _BIN.items():
    add(f"calculate_binned_entropy_{_m}", lambda t, m=_m: statistics.entropy(statistics.binned(t("trades"), ["code"], "price", 10, m, "seq"), ["code"], F.col("bin")).select("code", r("entropy").alias("entropy")), f"WITH {_TRADES}, b AS (SELECT code, {_sql} AS bin FROM trades WINDOW w AS (PARTITION BY code)), c AS (SELECT code, bin, count(*) AS n FROM b GROUP BY ALL) SELECT code, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM c GROUP BY code")
add("dct_1d", lambda t: statistics.dct(t("embeddings").where("embedding IS NOT NULL"), "vec_id", "embedding", 5).select("vec_id", "i", r("coef", 5).alias("coef")),
    "WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS x, len(embedding) AS n FROM embeddings) SELECT vec_id, i::INT AS i, round(sum(v * cos(pi() * (x + 0.5) * i / n)), 5) AS coef FROM p, range(5) g(i) GROUP BY vec_id, i")
add("identify_segments", lambda t: statistics.segments(t("trades"), ["code"], ["ts", "seq"], "flag").select("seq", "segment"),
    f"WITH {_TRADES}, a AS (SELECT *, CASE WHEN lag(flag) OVER w <> flag THEN 1 ELSE 0 END AS x, row_number() OVER w AS rn FROM trades WINDOW w AS (PARTITION BY code ORDER BY ts, seq)) SELECT seq, CASE WHEN rn = 1 THEN 0 ELSE sum(x) OVER (PARTITION BY code ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) + 1 END::BIGINT AS segment FROM a")
add("to_uniform", lambda t: statistics.to_uniform(t("trades"), ["code"], "price", "seq").select("seq", "u"), f"WITH {_TRADES} SELECT seq, row_number() OVER (PARTITION BY code ORDER BY price, seq) / (count(*) OVER (PARTITION BY code) + 1) AS u FROM trades")
_U = "u AS (SELECT p_partkey, (p_size + 1) / 60.0::DOUBLE AS u, (p_partkey % 97 + 1) / 100.0::DOUBLE AS v FROM part)"
_COPULA = {"clayton_copula_cdf": (statistics.clayton_cdf, "pow(pow(u, -2.0) + pow(v, -2.0) - 1, -0.5)"), "clayton_copula_pdf": (statistics.clayton_pdf, "3.0 * pow(u * v, -3.0) * pow(pow(u, -2.0) + pow(v, -2.0) - 1, -2.5)"), "gumbel_copula_cdf": (statistics.gumbel_cdf, "exp(-pow(pow(-ln(u), 2.0) + pow(-ln(v), 2.0), 0.5))")}
for _name, (_f, _sql) in _COPULA.items():
    add(_name, lambda t, f=_f: t("part").select("p_partkey", r(f((F.col("p_size") + 1) / 60.0, (F.col("p_partkey") % 97 + 1) / 100.0, 2.0)).alias("c")), f"WITH {_U} SELECT p_partkey, round({_sql}, 6) AS c FROM u")
add("skew_numba", lambda t: t("trades").groupBy("code").agg(r(statistics.skew0("price"), 4).alias("skew")), f"WITH {_TRADES} SELECT code, round(CASE WHEN var_pop(price) > 1e-10 THEN (avg(price ** 3) - 3 * avg(price) * avg(price ** 2) + 2 * avg(price) ** 3) / (avg(price ** 2) - avg(price) ** 2) ** 1.5 ELSE 0 END, 4) AS skew FROM trades GROUP BY code")
_SORTED = "o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY code) AS m, lag(volume, 1) OVER w AS l1, lag(volume, 2) OVER w AS l2, lag(volume, 3) OVER w AS l3 FROM trades WINDOW w AS (PARTITION BY code ORDER BY ts, seq)), c AS (SELECT code, quantile_cont(volume, 0.9) AS p90, quantile_cont(volume, 0.1) AS p10 FROM trades GROUP BY code)"
_FEATURES = {
    "mean": "avg(volume)", "median": "median(volume)", "std": "stddev_samp(volume)", "skew": "skewness(volume)", "kurt": "kurtosis(volume)", "max": "max(volume)", "min": "min(volume)", "range": "max(volume) - min(volume)",
    "p5": "quantile_cont(volume, 0.05)", "p25": "quantile_cont(volume, 0.25)", "p75": "quantile_cont(volume, 0.75)", "p95": "quantile_cont(volume, 0.95)", "iqr": "quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25)", "cv": "stddev_samp(volume) / (abs(avg(volume)) + 1e-8)",
    **{f"autocorr{k}{s}": (f"abs(corr(volume, l{k}))" if s else f"corr(volume, l{k})") for k in (1, 2, 3) for s in ("", "_abs")}, "trend": "corr(i, volume)",
    "period_diff": "avg(volume) FILTER (WHERE i > m - m // 3) - avg(volume) FILTER (WHERE i <= m // 3)", "period_ratio": "avg(volume) FILTER (WHERE i > m - m // 3) / (abs(avg(volume) FILTER (WHERE i <= m // 3)) + 1e-8)",
    "mean_above_p90": "coalesce(avg(volume) FILTER (WHERE volume > p90), 0)", "mean_below_p10": "coalesce(avg(volume) FILTER (WHERE volume < p10), 0)",
}
for _name, _abs in (("get_features_factors", False), ("get_features_factors_single", False), ("get_features_factors_with_abs", True)):
    _cols = features.names(3, _abs)
    _said = {k: _FEATURES.get(k) or f"abs({_FEATURES[k.removesuffix('_abs')]})" for k in _cols}
    add(_name, lambda t, a=_abs, cols=_cols: features.features(t("trades"), ["code"], ["ts", "seq"], "volume", 3, a).select("code", "n", *[r(F.col(c) + 1e-9, 4).alias(c) for c in cols]),
        f"WITH {_TRADES}, {_SORTED} SELECT code, count(volume) AS n, " + ", ".join(f"round({q} + 1e-9, 4) AS {c}" for c, q in _said.items()) + " FROM o JOIN c USING (code) GROUP BY code")
add("difference_matrix", lambda t: t("nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("x")).crossJoin(F.broadcast(t("nation").select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("y")))).select("i", "j", (F.col("x") - F.col("y")).alias("d")), "SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_regionkey - b.n_regionkey AS d FROM nation a, nation b")

# --- text -----------------------------------------------------------------------------------

_TURNS = "p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)"
_SET = "list_distinct(list_filter(regexp_split_to_array(%s, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


def _turns(t) -> DataFrame:
    return t("conversations").withColumn("nxt", F.expr("lead(text) OVER (PARTITION BY conv_id ORDER BY turn)")).where("nxt IS NOT NULL")


_A, _B = (_SET % f"regexp_replace(lower({c}), '[^a-z0-9 \\t\\n\\r\\f\\v]', '', 'g')" for c in ("text", "nxt"))
add("jaccard_similarity", lambda t: _turns(t).select("conv_id", "turn", r(statistics.jaccard(F.col("text"), F.col("nxt"))).alias("sim")), f"WITH {_TURNS}, s AS (SELECT conv_id, turn, {_A} AS a, {_B} AS b FROM p WHERE nxt IS NOT NULL) SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0.0), 6) AS sim FROM s")
_A, _B = (_SET % f"lower({c})" for c in ("text", "nxt"))
add("min_word_edit_distance", lambda t: _turns(t).select("conv_id", "turn", statistics.word_difference(F.col("text"), F.col("nxt")).alias("n")), f"WITH {_TURNS}, s AS (SELECT conv_id, turn, {_A} AS a, {_B} AS b FROM p WHERE nxt IS NOT NULL) SELECT conv_id, turn, (len(a) + len(b) - 2 * len(list_intersect(a, b)))::INT AS n FROM s")
add("vectorize_sentences", lambda t: statistics.word_counts(t("benchmark"), ["item_id"], "text"), "WITH w AS (SELECT item_id, unnest(regexp_split_to_array(replace(lower(text), '.', ''), '[ \\t\\n\\r\\f\\v]+')) AS word FROM benchmark) SELECT item_id, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL")

# --- trades and orders ----------------------------------------------------------------------

add("read_trade", lambda t: t("trades").where(F.col("flag") != tables.CANCEL).select("code", "seq", "price", "volume", "flag"), f"WITH {_TRADES} SELECT code, seq, price, volume, flag FROM trades WHERE flag <> 32")
add("adjust_afternoon", lambda t: tables.adjust_afternoon(t("events").select("event_id", "ts")), "WITH e AS (SELECT event_id, ts, hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS s FROM events) SELECT event_id, CASE WHEN s >= 46800 THEN ts - INTERVAL 90 MINUTE ELSE ts END AS ts FROM e WHERE s BETWEEN 34200 AND 41400 OR s BETWEEN 46800 AND 53820")
add("read_market_pair", lambda t: tables.melt_book(t("trades").select("seq", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.col("price") + i * 0.01).alias("p"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.col("volume") * i).alias("v")), ["seq"], "p", "v").withColumn("price", r(F.col("price") + 1e-9, 4)),
    f"WITH {_TRADES} SELECT seq, i::INT AS number, round(price + i * 0.01 + 1e-9, 4) AS price, volume * i AS vol FROM trades, range(1, 11) g(i)")
_LIFE = f"{_TRADES}, o AS (SELECT ask_order, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, sum(volume) AS volume, sum(turnover) AS turnover FROM trades GROUP BY ask_order)"
add("py_cross_section_example", lambda t: microstructure.cross_section(t("trades")).select("code", *[r(c).alias(c) for c in ("log_volume", "log_count", "vwap")]),
    f"WITH {_TRADES}, a AS (SELECT code, ln(sum(volume)) AS log_volume, ln(count(*)) AS log_count, sum(price * volume) / sum(volume) AS vwap FROM trades GROUP BY code) SELECT code, " + ", ".join(f"round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END, 6) AS {c}" for c in ("log_volume", "log_count", "vwap")) + " FROM a")
add("minute_bars", lambda t: microstructure.bars(t("events"), ["event_type"], "ts", "value", 3600, "event_id").withColumn("total", r("total", 4)), "SELECT event_type, (epoch_us(ts) // 3600000000 * 3600)::BIGINT AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY ALL")
add("py_minute_example", lambda t: microstructure.series_stats(t("events"), ["user_id"], "event_id", "value").select("user_id", *[r(c, 4).alias(c) for c in ("mean", "std", "max", "min", "range", "autocorr1")]),
    "WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(max(value), 4) AS max, round(min(value), 4) AS min, round(max(value) - min(value), 4) AS range, round(CASE WHEN stddev_pop(value) FILTER (WHERE p IS NOT NULL) > 0 AND stddev_pop(p) > 0 THEN corr(value, p) END, 4) AS autocorr1 FROM l GROUP BY user_id")
add("compute_non_breakthrough_stats", lambda t: microstructure.non_breakthrough(t("trades")),
    f"WITH {_TRADES}, a AS (SELECT code, ts::DATE AS day, price, sum(volume) AS volume FROM trades GROUP BY ALL), p AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY day) AS place FROM a) SELECT x.code, x.day, coalesce(sum(x.volume) FILTER (WHERE y.code IS NOT NULL), 0.0) AS seen, coalesce(sum(x.volume) FILTER (WHERE y.code IS NULL), 0.0) AS fresh FROM p x LEFT JOIN p y ON x.code = y.code AND x.place = y.place + 1 AND x.price = y.price GROUP BY x.code, x.day")


# --- kernels --------------------------------------------------------------------------------

for _name in ("lz_complexity", "irreversibility"):
    add(f"{_name}_kernel", lambda t, k=_name: t("embeddings").where("embedding IS NOT NULL").select("vec_id", kernels.apply(k, F.col("embedding")).alias("value")))
add("dtw_distance", lambda t: t("embeddings").withColumn("nxt", F.expr("lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)")).select("vec_id", kernels.apply_pair(F.col("embedding"), F.col("nxt"), 8).alias("distance")))

FLAGSHIP = QUERIES["get_features_factors"]

from tickloom.plans import sequence_queries, series_queries, store_queries  # noqa: E402, F401  (add their queries)
