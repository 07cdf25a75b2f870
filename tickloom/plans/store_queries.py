"""Queries that write a factor store and read it back."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.registry import _TRADES, add, r
from tickloom.sources import store

_WRITTEN: dict[tuple, str] = {}
_PANEL = f"{_TRADES}, d AS (SELECT strftime(date_trunc('month', ts), '%Y%m%d')::INT AS date, code, sum(volume)::FLOAT AS f0, max(volume)::FLOAT AS f1, count(*)::FLOAT AS f2 FROM trades GROUP BY ALL)"
_DATES, _CODES = [19950101, 19960301], [1, 2, 3]


def _panel(t) -> DataFrame:
    return t("trades").groupBy(F.date_format(F.trunc("ts", "month"), "yyyyMMdd").cast("int").alias("date"), "code").agg(F.sum("volume").cast("float").alias("f0"), F.max("volume").cast("float").alias("f1"), F.count(F.lit(1)).cast("float").alias("f2"))


def folder(spark) -> str:
    """The folder of spark.checkpoint.dir, where stores of queries go; a local one only on a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _store(t) -> tuple:
    """The session, and the path of the panel's store: written once for a session and its files."""
    df = _panel(t)
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, tuple(t("lineitem").inputFiles()))
    if key not in _WRITTEN:
        _WRITTEN[key] = f"{folder(spark)}/store-{uuid.uuid4().hex}"
        store.write(df, _WRITTEN[key])
    return spark, _WRITTEN[key]


def _reads(names: tuple, columns=None, dates=None, codes=None, keys=True, pick="date, code, f0, f1, f2") -> None:
    where = " AND ".join(f"{c} IN ({', '.join(map(str, v))})" for c, v in (("date", dates), ("code", codes)) if v) or "true"
    for name in names:
        add(name, lambda t: store.read(*_store(t), columns, dates, codes, keys), f"WITH {_PANEL} SELECT {pick} FROM d WHERE {where}")


_reads(("query_backup", "factor_store_v5_open"))
_reads(("query_backup_fast",), dates=_DATES, codes=_CODES)
_reads(("query_backup_single_column", "query_backup_single_column_compact_cached", "query_backup_single_column_compact_cached_from_cache_dir", "factor_store_v5_read_factor"), [1], pick="date, code, f1")
_reads(("query_backup_single_column_with_filter",), [1], None, _CODES, pick="date, code, f1")
_reads(("query_backup_columns_range_with_filter",), range(0, 2), _DATES, pick="date, code, f0, f1")
_reads(("query_backup_factor_only", "query_backup_factor_only_ultra_fast"), ["f2"], keys=False, pick="f2")
_reads(("query_backup_factor_only_with_filter",), ["f2"], None, _CODES, False, pick="f2")
for _name in ("query_backup_codebook_cached", "query_backup_codebook_cached_from_cache_dir"):
    add(_name, lambda t: store.codebook(*_store(t)), f"WITH {_PANEL} SELECT DISTINCT 'date' AS kind, date::VARCHAR AS value FROM d UNION ALL SELECT DISTINCT 'code', code::VARCHAR FROM d")
add("factor_store_v5_template", lambda t: store.template(*_store(t)), f"WITH {_PANEL} SELECT DISTINCT 'date' AS kind, date::VARCHAR AS value FROM d UNION ALL SELECT DISTINCT 'code', code || CASE WHEN (code::VARCHAR)[1] IN ('6', '9') THEN '.SH' WHEN (code::VARCHAR)[1] IN ('8', '4') THEN '.BJ' ELSE '.SZ' END FROM d")
add("factor_store_v5_info", lambda t: store.info(*_store(t)), f"WITH {_PANEL} SELECT unnest(['f0', 'f1', 'f2']) AS factor, unnest([0, 1, 2]) AS place, count(*) AS records FROM d")


def _again(t, **how) -> tuple:
    spark, path = _store(t)
    out = f"{path}-again-{'-'.join(f'{k}-{v}' for k, v in sorted(how.items()))}"
    store.rewrite(spark, path, out, **how)
    return spark, path, out


def _compared(t, **how) -> DataFrame:
    spark, path, out = _again(t, **how)
    return store.difference(store.read(spark, path), store.read(spark, out), "f0")


_SAME = f"WITH {_PANEL} SELECT count(*) AS records, 0::BIGINT AS unmatched, 0.0::FLOAT AS largest FROM d"
for _name, _how in (("factor_store_v5_project_v7", {}), ("factor_store_v5_project_only", {}), ("factor_store_v5_verify_online", {}), ("factor_store_v5_verify_scatter_fast", {}), ("factor_store_v5_smoke_proj", {}), ("build_backup_column_block_cache_single_thread", {"compression": "snappy"}), ("factor_store_v5_decompress_inplace", {"compression": "uncompressed"}), ("convert_backup_v3_to_v4", {"compression": "zstd"}), ("convert_backup_v2_to_v3_inplace", {"kind": "float"})):
    add(_name, lambda t, how=_how: _compared(t, **how), _SAME)


def _exported(t) -> DataFrame:
    spark, path = _store(t)
    store.export(spark, path, f"{path}-wide", ["f0"])
    return spark.read.parquet(f"{path}-wide/f0").select("date", *[F.col(f"`{c}`").alias(f"c{c}") for c in _CODES])


add("factor_store_v5_export_factors_parquet", _exported, f"WITH {_PANEL} SELECT date, " + ", ".join(f"max(CASE WHEN code = {c} THEN f0 END) AS c{c}" for c in _CODES) + " FROM d GROUP BY date")

# --- tasks and pipelines --------------------------------------------------------------------


def _square(code):
    return [code, code * code]


for _name in ("run_pools_queue", "run_pools_queue_date_only", "run_pools_simple"):
    add(_name, lambda t: store.run_tasks(t("supplier").select("s_suppkey"), _square, ["a", "b"]), "SELECT s_suppkey, s_suppkey::DOUBLE AS a, (s_suppkey * s_suppkey)::DOUBLE AS b FROM supplier")


def _resumed(t) -> DataFrame:
    tasks = _panel(t).select("date", "code")
    path = f"{folder(tasks.sparkSession)}/tasks-{uuid.uuid4().hex}"
    store.run_tasks(tasks.where("code % 2 = 0"), lambda d, c: [d + c], ["f"], path)
    return store.run_tasks(tasks, lambda d, c: [d + c + (c % 2)], ["f"], path).select("date", "code", "f")


add("run_factor_pipeline_resume", _resumed, f"WITH {_PANEL} SELECT date, code, (date + code + code % 2)::DOUBLE AS f FROM d")


def _spread(p) -> list:
    v = p.known("volume")
    return [v.sum(), v.max() - v.min()] if len(v) else [None, None]


def _spreads(p) -> list:
    """_spread of many groups; a sum of -0.0 is 0.0."""
    return [p.reduce(np.add, "volume") + 0, p.reduce(np.maximum, "volume") - p.reduce(np.minimum, "volume")]


for _name, _keys, _how in (("run_factor_pipeline", ["day", "code"], _spread), ("run_factor_pipeline_v6", ["day", "code"], _spreads), ("run_factor_pipeline_minute", ["day"], _spread), ("run_factor_pipeline_cross_section", ["day"], _spread)):
    add(_name, lambda t, k=_keys, f=_how: store.run_groups(t("trades").select(F.trunc("ts", "month").alias("day"), "code", "volume"), k, f, ["total", "spread"], f is _spreads),
        f"WITH {_TRADES} SELECT {', '.join(c.replace('day', 'date_trunc($$month$$, ts)::DATE AS day') for c in _keys)}, sum(volume) AS total, max(volume) - min(volume) AS spread FROM trades GROUP BY ALL".replace("$$", "'"))
