"""Tables as the data model's inputs; all schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE = "symbol string, datetime string, date int, time int, exchtime long, localtime long, `index` int, price double, volume double, turnover double, flag int, order_type string, func_code string, ask_order long, bid_order long"
#: Trade flags: bought, sold, cancelled.
BUY, SELL, CANCEL = 66, 83, 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades: code, seq, ts, price, volume, turnover, flag, ask_order, bid_order."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("turnover"),
        F.when(F.col("l_returnflag") == "R", BUY).when(F.col("l_returnflag") == "A", SELL).otherwise(CANCEL).alias("flag"), F.col("l_orderkey").alias("ask_order"), F.col("l_partkey").alias("bid_order"))


def read_trade_csv(spark: SparkSession, path: str, with_retreat: bool = False) -> DataFrame:
    """Tick CSV files under the fixed schema; cancelled rows go unless asked for."""
    df = spark.read.schema(TRADE).option("header", True).csv(path)
    return df if with_retreat else df.where(F.col("flag") != CANCEL)


def adjust_afternoon(df: DataFrame, ts: str = "ts", only_inday: bool = True) -> DataFrame:
    """Rows of both sessions, the afternoon moved back by the 90 minutes of the lunch break."""
    sec = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    first, last = (34200, 53820) if only_inday else (32400, 54000)
    morning, noon = (sec >= first) & (sec <= 41400), (sec >= 46800) & (sec <= last)
    return df.where(morning | noon).withColumn(ts, F.when(noon, F.col(ts) - F.expr("INTERVAL 90 MINUTES")).otherwise(F.col(ts)))


def melt_book(df: DataFrame, key: list[str], prices: str, volumes: str) -> DataFrame:
    """Book levels as rows (key, number, price, vol); empty levels go."""
    return df.select(*key, F.posexplode(F.arrays_zip(F.col(prices).alias("price"), F.col(volumes).alias("vol"))).alias("number", "lv")).select(*key, (F.col("number") + 1).alias("number"), F.col("lv.price").alias("price"), F.col("lv.vol").alias("vol")).where("price <> 0")


def remaining(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks whose keys are not in the store yet: how a stopped job goes on."""
    return tasks.join(done.select(keys).distinct(), keys, "left_anti")
