"""Series kernels and the store against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import kernels, series, windows
from tickloom.sources import store, tables

R = np.random.default_rng(3)


def test_window_of_many_rows_of_one_instant(spark):
    rows = [(1, 0, i, 1.0) for i in range(3000)] + [(1, 1, 3000, 1.0)]
    df = spark.createDataFrame(rows, "g long, us long, seq long, v double").selectExpr("g", "timestamp_micros(us) AS ts", "seq", "v")
    got = {r.seq: r["count"] for r in windows.rolling(df, ["g"], "ts", "seq", "v", 0, ["count"]).collect()}
    assert got[0] == 3000 and got[2999] == 1 and got[3000] == 1
    back = {r.seq: r["count"] for r in windows.rolling(df, ["g"], "ts", "seq", "v", 1e-6, ["count"], back=True).collect()}
    assert back[2999] == 3000 and back[3000] == 3001


def test_half_times():
    t, p = np.arange(6.0), np.array([10.0, 10.5, 11.0, 12.0, 9.0, 9.0])
    assert series.half_extreme(t, p, 3).tolist()[:2] == [2.0, 3.0]  # +20 % by 3: half at 11; then the fall to 9 is larger
    assert np.isnan(series.half_extreme(t, p, 3, "neg")[0]) and series.half_extreme(t, p, 3)[5] == 3
    assert series.half_energy(t, p, 3).tolist()[:2] == [2.0, 2.0]  # |12 / 10 - 1| / 2 at 11; |9 / 10.5 - 1| / 2 at 12
    assert series.half_energy(t, p, 3)[5] == 0 and np.isnan(series.half_energy([0, 1], [np.nan, 1], 1)[0])


def test_follow_groups():
    t, p = [1.0, 1.05, 1.08, 1.15, 1.2], [10, 10, 10, 11, 10]
    assert series.follow_groups(t, p, 0.1).tolist() == [1, 1, 1, 2, 3]


def test_lagged_regression():
    x = R.normal(size=60)
    got = series.lagged_regression(x, 12, 10)
    w = x[5:27]
    rows = np.array([[1, *w[i : i + 2][::-1]] for i in range(20)])
    beta = np.linalg.lstsq(rows[:10], w[2:12], rcond=None)[0]
    r2 = lambda y, g: 1 - ((y - g) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.allclose([got[26, 1], got[26, 4]], [r2(w[2:12], rows[:10] @ beta), r2(w[12:], rows[10:] @ beta)])
    assert np.isnan(got[:21]).all() and np.isnan(series.lagged_regression(np.ones(30), 12, 10)).all()
    with pytest.raises(ValueError):
        series.lagged_regression(x, 5, 6)


def test_transfer_entropy_and_patterns():
    x = np.repeat([1.0, 2.0, 3.0], 20)
    y = np.concatenate([[1.0], x[:-1]])
    assert series.transfer_entropy(x, y, 1, 3) > series.transfer_entropy(R.normal(size=60), y, 1, 3)
    assert series.transfer_entropy([1, np.nan], [1, 2], 1, 3) == 0
    up = series.irreversibility(np.arange(9.0), 3)
    assert up["i_ord"] == 1 and up["kl_divergence"] == np.inf and up["permutation_entropy"] == 0
    assert series.transfer_irreversibility([1, 2, 1, 2, 1, 2, 1, 2], 2)["i_trans"] < 0.2


def test_other_kernels():
    a, b = R.normal(size=30), R.normal(size=25)
    d = np.full((31, 26), np.inf)
    d[0, 0] = 0
    for i in range(30):
        for j in range(25):
            if abs(i - j) <= 8:
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert abs(kernels.dtw(a, b, 8) - d[-1, -1]) < 1e-9
    assert np.allclose(series.difference_eigenvalues(a)[:2], np.sqrt(30 * (a**2).sum() - a.sum() ** 2)) and np.allclose(series.difference_eigenvalues(a)[2:], 0, atol=1e-6)
    assert series.hurst_rs(np.full(20, 3.0)) == 0.5 and series.boxes([1, 2], [1, 2]) == 0
    assert kernels.lz_complexity(np.arange(40.0), quantiles=(0.5,)) > 0 and np.isnan(kernels.lz_complexity(np.ones(9), quantiles=(0.5,)))
    x = R.normal(size=24)
    core, minor = series.core_feature(x)
    w = np.lib.stride_tricks.sliding_window_view(x, 5)
    corr = lambda u, v: np.corrcoef(u, v)[0, 1]
    at = [np.sqrt(np.mean([(corr(w[7], w[j]) - corr(np.delete(w[7], m), np.delete(w[j], m))) ** 2 for j in range(20) if j != 7])) for m in range(5)]
    assert core[11] == w[7][np.argmin(at)] and minor[11] == w[7][np.argmax(at)]
    out = series.local_correlation(x, np.ones(24), 5)
    c = [corr(w[6], w[j]) for j in range(7, 20)]
    assert out[10, 0] == out[10, 1] == 1 + np.argmax(c) and out[10, 2] == 1 + np.argmin(c)
    gains = series.rolling_gain([0, 1] * 30, 20, 3, 0.4)
    assert gains[40, 0] > 0.9 and series.rolling_memory([0, 1] * 30, 20, 3, quantile=0.4)[40] == 1 and not gains[:23].any()


def test_store(spark, tmp_path):
    rows = [(20220800 + d, c, *(1000.0 * d + 10 * c + f for f in range(4))) for d in range(5) for c in range(3)]
    df = spark.createDataFrame(rows, "date int, code int, f0 double, f1 double, f2 double, f3 double")
    path = f"{tmp_path}/s"
    store.write(df.where("date < 20220803"), path)
    store.write(df.where("date >= 20220803"), path)
    got = store.read(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert store.read(spark, path, [1, "f3"], [20220801], [2]).collect() == [(20220801, 2, 1021.0, 1023.0)]
    assert {(r.factor, r.place, r.records) for r in store.info(spark, path).collect()} == {(f"f{i}", i, 15) for i in range(4)}
    store.rewrite(spark, path, f"{path}-f", "float", "zstd")
    diff = store.difference(got, store.read(spark, f"{path}-f"), "f2").first()
    assert (diff.records, diff.unmatched, diff.largest) == (15, 0, 0)
    assert store.export(spark, path, f"{path}-w", ["f1"]) == 1
    assert spark.read.parquet(f"{path}-w/f1").where("date = 20220802").first()["2"] == 2021.0


def test_export_of_many_codes_by_files_and_row_groups(spark, tmp_path):
    """No column is lost, whatever the codes' type; a code or a date that is null, a value that is null or NaN, and dates over several files."""
    rows = []
    for d in (1, 2, 3, 4, 6, None):
        for i, c in enumerate((None, *(f"c{k}" for k in range(3000)))):
            if i % 3 or d == 1:
                rows.append((d, c, None if c == "c7" else float("nan") if d == 3 else (d or 9) * 10000.0 + i))
    path = f"{tmp_path}/s"
    store.write(spark.createDataFrame(rows, "date int, code string, f double"), path)
    assert store.export(spark, path, f"{tmp_path}/w", cells=7000) == 1
    out = spark.read.parquet(f"{tmp_path}/w/f")
    assert sorted(out.columns) == sorted(["date", "null", *(f"c{k}" for k in range(3000))]) and len(out.inputFiles()) > 1
    got = out.toArrow().to_pylist()
    want = {(d, str(c) if c else "null"): v for d, c, v in rows}
    assert sorted(map(repr, (r["date"] for r in got))) == sorted(map(repr, (1, 2, 3, 4, 6, None)))
    assert all(repr(v) == repr(want.get((r["date"], c))) for r in got for c, v in r.items() if c != "date")


def test_tasks_resume_and_survive_errors(spark, tmp_path):
    tasks = spark.createDataFrame([(d, c) for d in (1, 2) for c in (3, 4)], "date int, code int")
    path = f"{tmp_path}/t"
    first = store.run_tasks(tasks.where("code = 3"), lambda d, c: [d * c], ["f"], path)
    assert first.count() == 2
    again = store.run_tasks(tasks, lambda d, c: [1 / 0] if d == 2 else [-1.0], ["f"], path)
    assert sorted((r.date, r.code, r.f) for r in again.collect()) == [(1, 3, 3.0), (1, 4, -1.0), (2, 3, 6.0), (2, 4, None)]
    sums = store.run_groups(tasks, ["date"], lambda p: [p.code.sum()], ["s"])
    assert {(r.date, r.s) for r in sums.collect()} == {(1, 7.0), (2, 7.0)}


def test_groups_across_batches(spark):
    """Groups longer and shorter than a batch, keys that are null, NaN or -0.0, and a group without a value."""
    from tickloom.plans.store_queries import _spread

    keys = [(k, c) for k in (None, float("nan"), -0.0, 1.5) for c in (None, "a", "b")]
    rows = [(k, c, None if c == "b" and k == 1.5 or i == 3 else float(i)) for k, c in keys for i in range(30 if c else 2)] + [(0.0, "a", 100.0)]
    df = spark.createDataFrame(rows, "k double, c string, volume double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = store.run_groups(df, ["k", "c"], lambda p: [*_spread(p), len(p), len(p.frame())], ["total", "spread", "n", "m"])
        got = sorted(map(repr, map(tuple, out.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.groupBy("k", "c").agg(F.sum("volume"), F.max("volume") - F.min("volume"), F.count(F.lit(1)).cast("double"), F.count(F.lit(1)).cast("double"))
    assert got == sorted(map(repr, map(tuple, want.collect()))) and len(got) == 12


@pytest.mark.parametrize("together", [False, True])
def test_groups_of_one_hash_and_groups_together(spark, together):
    """Keys with nulls swapped have one hash and lie mixed; values are null, NaN, infinite, -0.0 or absent, in groups of a few rows and of several batches."""
    from tickloom.plans.store_queries import _spread, _spreads

    keys = [(5, None), (None, 5), (6, 7), (7, 6), (None, None), (8, 8), (9, 9)]
    odd = {(9, 9): -0.0, (6, 7): float("nan"), (7, 6): None, (8, 8): float("inf")}
    rows = [(k, c, odd.get((k, c), 0.5 * i) if i % 3 or c == 9 else None if i % 2 else float(i)) for i in range(24) for k, c in keys] + [(100 + i, None, None if i % 2 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, c int, volume double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = store.run_groups(df, ["k", "c"], _spreads if together else _spread, ["total", "spread"], together)
        got = sorted(map(repr, map(tuple, out.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = df.groupBy("k", "c").agg(F.sum("volume"), F.max("volume") - F.min("volume"))
    assert got == sorted(map(repr, map(tuple, want.collect()))) and len(got) == 47


def test_pipeline_v6_takes_groups_together(spark, tmp_path, monkeypatch):
    """Small groups cost no call each, and Spark sorts rows by one number."""
    from tickloom.plans import registry

    n = store.run_groups(spark.range(100).repartition(1), ["id"], lambda p: [np.full(len(p), len(p))], ["n"], True)
    assert n.count() == 100 and n.agg(F.max("n")).first()[0] > 10
    calls = []
    monkeypatch.setattr(store, "run_groups", lambda *a, f=store.run_groups: calls.append(a) or f(*a))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = registry.QUERIES["run_factor_pipeline_v6"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert calls[0][-1] is True and "Sort [_hash" in plan and plan.count("Sort [") == 1


@pytest.mark.parametrize("name", ["run_factor_pipeline", "run_factor_pipeline_v6"])
def test_pipelines_batch_small_groups(spark, tmp_path, name):
    """Groups of a task reach Python together, not one by one; a group without a value is null, as in SQL."""
    from tickloom.plans import registry

    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(500)
    df.withColumn("l_quantity", F.when(F.col("l_suppkey") > 5, F.col("l_quantity"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert rows and all((r.total is None) == (r.code <= 5) == (r.spread is None) for r in rows)


def test_read_trade_csv(spark, tmp_path):
    cols = [c.split()[0].strip("`") for c in tables.TRADE.split(", ")]
    row = dict(zip(cols, ["000001", "x", 20220819, 93000000, 1660872600000000, 0, 1, 12.5, 100.0, 1250.0, 66, "a", "b", 5, 6]))
    pd.DataFrame([row, {**row, "flag": 32}])[cols].to_csv(f"{tmp_path}/t.csv", index=False)
    assert [r.price for r in tables.read_trade_csv(spark, f"{tmp_path}/t.csv").collect()] == [12.5]
    assert tables.read_trade_csv(spark, f"{tmp_path}/t.csv", with_retreat=True).count() == 2
