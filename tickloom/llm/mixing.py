"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a source that share a slot of the shuffle, on average; more documents mean more slots. Slots in a block.
SLOT, BLOCK = 2048, 4096
SEED = "wfq-1"


def words(text: str = "text"):
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def shuffled():
    """A document's place in the shuffle: a seeded digest of doc_id, or of the text where that is null."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))


def targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, docs, source_size, target) from (source, docs, source_size).

    Sources by code point, null last, weigh `weights` in turn. Targets share `share` times all
    sizes by weight, but none exceeds `most` times its source; the excess is dealt again by
    weight until none does. That fixed point is one water level: sources in order of size to
    weight are capped as long as their cap is at most what the level would give them.
    The windows run over one row per source.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    b = a.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything)).withColumn("mass", F.sum("weight").over(everything))
    b = b.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("mass") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    c = b.withColumn("place", F.row_number().over(level))
    above = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    d = c.withColumn("first", F.min(above).over(everything))  # levels hold up to the first source that isn't capped
    return d.select("source", "docs", "source_size", F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def schedule(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: one row per document.

    Each source's documents are shuffled by a seeded digest of doc_id and offered `most`
    times over. A document's virtual finish time is the source's words up to its end, divided
    by the source's target, so that all sources reach time 1 together, where the budget is
    spent: what finishes by then is taken whole, and what is in service then is truncated, by
    words. Rows: doc_id, source, size, source_size, target, finish (of its first copy), copies
    (whole ones taken), part (words of one more, cut one), taken, and place and slot in the shuffle.

    The texts are read once; sizes and places are staged. The running sums are taken within
    slots of the shuffle, about SLOT documents each, over totals of slots within blocks and of
    blocks, so that a hot source is many tasks. Null text: size 0. Null source: a
    source of its own, last. Null doc_id: shuffled by the text. Repeated rows and ties:
    each row is a document, in any order among equals. Empty table: no row. A source with no
    words: target 0, nothing taken.
    """
    one = common.stage(docs.select("doc_id", "source", words().alias("size"), shuffled().alias("place")), "mix-sizes")
    plan = targets(one.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")), weights, share, most)
    slots = F.ceil(F.col("docs") / F.lit(SLOT))
    two = one.join(plan.withColumnRenamed("source", "_s"), F.expr("source <=> _s")).drop("_s")
    two = two.withColumn("slot", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * slots / F.lit(2**32)).cast("int"))
    sums = two.groupBy("source", "slot").agg(F.sum("size").alias("slot_size")).withColumn("block", F.floor(F.col("slot") / F.lit(BLOCK)))
    blocks = sums.groupBy(F.col("source").alias("_b"), F.col("block").alias("_n")).agg(F.sum("slot_size").alias("_size"))
    before = blocks.withColumn("_before", F.sum("_size").over(Window.partitionBy("_b").orderBy("_n")) - F.col("_size")).drop("_size")
    inner = F.sum("slot_size").over(Window.partitionBy("source", "block").orderBy("slot")) - F.col("slot_size")
    starts = sums.withColumn("_inner", inner).join(before, F.expr("source <=> _b AND block = _n")).select(F.col("source").alias("_s"), F.col("slot").alias("_k"), (F.col("_before") + F.col("_inner")).alias("ahead"))
    three = two.join(starts, F.expr("source <=> _s AND slot = _k")).drop("_s", "_k")
    within = Window.partitionBy("source", "slot").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = three.withColumn("end", F.col("ahead") + F.sum("size").over(within))
    at = lambda words: F.when(F.col("target") > 0, words / F.col("target"))  # noqa: E731  the virtual time when the source has sent so many words
    offers = [(at(F.col("end") + p * F.col("source_size")), at(F.col("end") + p * F.col("source_size") - F.col("size"))) for p in range(math.ceil(most))]
    copies, part = F.lit(0).cast("long"), F.lit(0).cast("long")
    for finish, start in offers:
        whole = F.coalesce((finish <= 1) & (F.col("size") > 0), F.lit(False))
        cut = F.coalesce((start < 1) & (finish > 1), F.lit(False))
        copies, part = copies + whole.cast("long"), part + F.when(cut, F.floor((1 - start) * F.col("target") + 1e-6)).otherwise(0)
    out = end.withColumn("finish", offers[0][0]).withColumn("copies", copies).withColumn("part", part)
    return out.select("doc_id", "source", "size", "source_size", "target", "finish", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "place", "slot")


def take(docs: DataFrame, columns: list[str], weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The columns (doc_id, text, source and others) of documents that the mix takes, with copies (whole ones) and part (words of one more, cut one).

    A source's schedule ends within one document: all before it in the shuffle are served as
    often as it, and once more. So one row per source, with its rounds and the place of that
    end, says what is taken of every document, and texts are never shuffled. Rows that tie at
    the end (repeated ids of one size) share what is left evenly, rounded down. Documents of
    no words are not taken. Nulls and empty tables as in schedule().
    """
    mix = schedule(docs, weights, share, most).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"))
    ties = mix.groupBy("source", "slot", "place", "doc_id", "size", "full").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("taken") - F.col("full") * F.col("size")).alias("served"))
    last = F.max(F.when(F.col("served") > 0, F.struct("place", "doc_id", "size", "n", "served")))
    ends = common.stage(ties.groupBy(F.col("source").alias("_source")).agg(F.max("full").alias("_full"), last.alias("_end")), "mix-ends")
    here, end = F.struct("doc_id", words().alias("size")), F.struct("_end.doc_id", "_end.size")
    before = F.when(F.col("_place") == F.col("_end.place"), here < end).otherwise(F.col("_place") < F.col("_end.place"))
    at = F.when(F.col("_place") == F.col("_end.place"), here == end).otherwise(False)
    each = F.floor(F.col("_end.served") / F.col("_end.n"))
    dealt = docs.select(*columns).where(F.col("text").rlike(common.WORD)).withColumn("_place", shuffled()).join(ends, F.expr("source <=> _source"))
    once = F.coalesce(before | (at & (each == F.col("_end.size"))), F.lit(False))
    part = F.coalesce(F.when(at & (each < F.col("_end.size")), each), F.lit(0)).cast("long")
    return dealt.select(*columns, (F.col("_full") + once.cast("long")).alias("copies"), part.alias("part")).where("copies + part > 0")


def in_order(mix: DataFrame) -> DataFrame:
    """The schedule range-sorted by virtual finish time."""
    return mix.orderBy("finish", "source", "doc_id")


def op5_mix_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = schedule(common.table(spark, sf_dir, "documents"))
    return in_order(mix).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH one AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('wfq-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS place
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM one GROUP BY source),
a AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM src),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS mass,
        coalesce(sum(cap) OVER w, 0) AS used, coalesce(sum(weight) OVER w, 0) AS gone
      FROM a WINDOW w AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (budget - used) / (mass - gone) AS lvl, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM b),
d AS (SELECT *, min(place) FILTER (WHERE cap > lvl * weight) OVER () AS lead FROM c),
t AS (SELECT source, source_size, CASE WHEN place >= lead THEN max(CASE WHEN place = lead THEN lvl END) OVER () * weight ELSE cap END AS target FROM d),
e AS (SELECT o.doc_id, o.size, t.source_size, t.target,
        sum(o.size) OVER (PARTITION BY o.source ORDER BY o.place, o.doc_id, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS fin
      FROM one o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes FROM e)
SELECT doc_id, size, source_size, target,
       passes * size + least(size, greatest(0, floor(target)::BIGINT - passes * source_size - (fin - size))) AS taken
FROM f
"""
