"""Every registered query that has SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

from tickloom.operators import kernels
from tickloom.plans import registry
from tickloom.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_like_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(registry.SQL[name])
    assert cols == sorted(want.columns)
    assert _plain(got.select(cols).collect()) == _plain(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_kernels():
    r = np.random.default_rng(0)
    a, b = r.normal(size=9), r.normal(size=7)
    d = np.full((10, 8), np.inf)
    d[0, 0] = 0
    for i in range(9):
        for j in range(7):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    assert abs(kernels.dtw(a, b) - d[-1, -1]) < 1e-12 and kernels.dtw(a, a) == 0
    assert kernels.lz_complexity([1, 1, 1, 1, 1, 1], normalize=False) == 2
    assert kernels.max_range([3, 1, 2, 3, 5]) == [1, 1, 2, 4, 5]
    assert kernels.irreversibility([1, 2, 3, 4, 5]) == 0.5
    assert abs(kernels.max_eigenvalue([[2, 0], [0, 1]]) - 2) < 1e-9


def test_stream(spark, tmp_path):
    q = events.windowed(events.read_events(spark, SF)).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_sequence_kernels():
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=40))
    assert abs(kernels.max_range_product(x) - max(min(x[i], x[j]) * (j - i) for i in range(40) for j in range(i + 1, 40))) < 1e-12
    assert kernels.max_range_product([]) == 0
    assert kernels.kendall_tau([1, 2, 3], [3, 2, 1]) == -1 and kernels.kendall_tau([1, 1, 1], [1, 2, 3]) == 0
    assert kernels.memory_length([0, 1] * 20, quantile=0.4) == 1 and kernels.memory_length([1, 1, 1]) == 10 and kernels.memory_length([]) == 10
    assert kernels.memory_length([0, 0, 1, 1] * 20, quantile=0.4) == 2
    assert kernels.string_proximity("aabb", "bbaa") == 1 and kernels.string_proximity("abcd", "badc") == 2
    assert kernels.string_proximity("abcd", "abcd") == 0 and np.isnan(kernels.string_proximity("abcd", "abce"))


def test_near_ids_across_blocks(spark):
    from tickloom.operators import sequences

    ids = [0, 1, 9, 10, 11, 19, 20, 25, 40]
    got = sequences.id_neighbours(spark.createDataFrame([(i, float(i)) for i in ids], "k long, v double"), "k", "v", 5, block=10).collect()
    want = {(i, sum(0 < abs(i - j) <= 5 for j in ids), float(sum(j for j in ids if 0 < abs(i - j) <= 5))) for i in ids}
    assert {tuple(x) for x in got} == want and len(got) == len(ids)


def test_flat_correlations(spark):
    from pyspark.sql import functions as F

    from tickloom.operators import relational, sequences, statistics

    df = spark.createDataFrame([(1, i, 2.0, float(i)) for i in range(4)] + [(2, i, float(i), -float(i)) for i in range(4)] + [(3, 0, 1.0, None)], "g long, i long, x double, y double")
    assert {x.g: x["corr"] and round(x["corr"], 9) for x in statistics.corrwith(df, ["g"], "x", "y").collect()} == {1: None, 2: -1.0}
    assert {x.g: round(x.trend, 9) for x in sequences.trend(df, ["g"], ["i"], "x").collect()} == {1: 0.0, 2: 1.0, 3: 0.0}
    assert {x.g: x["corr"] and round(x["corr"], 9) for x in relational.rank_correlation(df.where("g < 3"), "g", "x", "y").collect()} == {1: None, 2: -1.0}
    assert {x.corr_mean for x in sequences.rolling_correlation_mean(df, ["g"], ["i"], ["x", "y"], 3).where("g = 1").collect()} == {None}
    assert sorted((x.above, x.n) for x in sequences.runs_correlation(df.where("g = 1"), ["g"], ["i"], "x", "y", 2).collect()) == [(False, 2), (True, 2)]


@pytest.mark.parametrize("pairs", [4_000_000, 50])
def test_full_join_deals_hot_keys(spark, monkeypatch, pairs):
    """Keys of many pairs, null and NaN keys, rows without a match on either side, repeated rows: as Spark's full join, but never by it."""
    from tickloom.operators import relational

    monkeypatch.setattr(relational, "PAIRS", pairs)
    nan = float("nan")
    left = spark.createDataFrame([(1.0, i % 25, "l") for i in range(40)] + [(2.0, 7, "l"), (None, 8, None), (nan, 9, "n"), (5.0, 5, "x")], "k double, a long, v string")
    right = spark.createDataFrame([(1.0, i, "r") for i in range(30)] + [(3.0, 1, "r"), (None, 2, "r"), (nan, 3, "n"), (2.0, 4, None)], "k double, b long, v string")
    got = relational.merge(left, right, ["k"], "full")
    want = left.withColumnRenamed("v", "v_x").join(right.withColumnRenamed("v", "v_y"), ["k"], "full")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect()))) and got.count() == 1206
    assert "FullOuter" not in got._jdf.queryExecution().executedPlan().toString()
