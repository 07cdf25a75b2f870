"""Shared plumbing: staged tables, connected components and chunk plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of bytes other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only where none is set and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A staged table, read anew: columns of its own, for joins with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._staged_path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most `rows` rows from now on in this session: whole texts lie in them, on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    path = getattr(df, "_staged_path", None)
    if path:
        delete(df.sparkSession, path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    A node's label is a node known to hang together with it, at most itself. In a round a node
    takes the smallest of its label's label and its neighbours' labels' labels, and so does the
    node that its label names: labels double their reach, and regions hook on to each other,
    so rounds grow with the logarithm of the longest path. A round is equi-joins and pre-aggregated
    minima; a hot node or label is an ordinary skewed join key, which adaptive execution
    splits. Every round is staged. No edges: no rows.
    """
    both = stage(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).where("src <> dst").distinct(), "links")
    labels = stage(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        jump = labels.select("node", "label").join(again(labels).select(F.col("node").alias("label"), F.col("label").alias("grand")), "label")
        jump = stage(jump.select("node", "label", "grand"), "jumps")
        near = both.join(again(jump).select(F.col("node").alias("dst"), "grand"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("grand").alias("near"))
        one = jump.join(near, "node")
        hook = one.groupBy("label").agg(F.min("near").alias("hook")).select(F.col("label").alias("node"), "hook")
        low = F.least("label", "grand", "near", F.coalesce("hook", "label"))
        two = stage(one.join(hook, "node", "left").select("node", low.alias("label"), (low != F.col("label")).alias("moved")), "labels")
        unstage(labels), unstage(jump)
        labels = two
    unstage(both)
    out = labels.select("node", "label")
    out._staged_path = labels._staged_path
    return out
