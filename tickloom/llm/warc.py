"""WARC fixity: Merkle trees over records and their ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bits of fan-out: a tree node has 16 children, a leaf 16 record keys, and an archive file, over which offsets run, 256 leaves.
FANOUT, FILE = 4, 8


def records(pages: DataFrame) -> DataFrame:
    """(page_id, leaf, digest, length): a record is its URL, a blank line and its payload; nulls are empty, a null id is -1."""
    body = F.concat(F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    key = F.coalesce(F.col("page_id"), F.lit(-1)).cast("long")
    return pages.select(key.alias("page_id"), F.shiftright(key, FANOUT).alias("leaf"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("length"))


def offsets(record: DataFrame) -> DataFrame:
    """records with file and offset: the bytes before it in its archive file, in order of page_id and digest.

    A running sum within the slot of a page_id, 4096 by digest, over the bytes of the slots
    before, so that the records of a hot id are dealt out.
    """
    filed = record.withColumn("file", F.shiftright("leaf", FILE)).withColumn("slot", F.substring("digest", 1, 3))
    sums = filed.groupBy("file", "page_id", "slot").agg(F.sum("length").alias("all"))
    before = Window.partitionBy("file").orderBy("page_id", "slot").rowsBetween(Window.unboundedPreceding, 0)
    base = sums.select("file", "page_id", "slot", (F.sum("all").over(before) - F.col("all")).alias("base"))
    own = Window.partitionBy("file", "page_id", "slot").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return filed.withColumn("own", F.sum("length").over(own) - F.col("length")).join(base, ["file", "page_id", "slot"]).withColumn("offset", F.col("base") + F.col("own")).drop("slot", "base", "own")


def leaves(record: DataFrame) -> DataFrame:
    """(node, bytes, hash): each range of records, in order of page_id and digest, hashed together.

    Equal records of a key are one line with their count, so copies don't lengthen a leaf; a
    key's records are hashed in 4096 slots by digest first, so a hot key is many tasks.
    """
    lines = record.groupBy("leaf", "page_id", "digest", "length").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws(":", "digest", "length", "n")
    slots = lines.groupBy("leaf", "page_id", F.substring("digest", 1, 3).alias("slot")).agg(F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("hash"))
    entries = F.array_sort(F.collect_list(F.struct("page_id", "slot", "bytes", "hash")))
    each = F.transform(entries, lambda c: F.concat_ws(":", c["page_id"], c["slot"], c["bytes"], c["hash"]))
    return slots.groupBy(F.col("leaf").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws("|", each), 256).alias("hash"))


def parents(level: DataFrame, up: Column) -> DataFrame:
    """The next level: neighbouring nodes, each with the offset range of its bytes from the parent's start, hashed in order."""
    child = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))
    start = lambda i: F.aggregate(F.slice(F.col("child"), 1, i), F.lit(0).cast("long"), lambda a, c: a + c["bytes"])
    lines = F.transform("child", lambda c, i: F.concat_ws(":", c["node"], start(i), start(i) + c["bytes"], c["hash"]))
    return level.groupBy(up.cast("long").alias("node")).agg(F.sum("bytes").alias("bytes"), child.alias("child")).select("node", "bytes", F.sha2(F.concat_ws("|", lines), 256).alias("hash"))


def trees(a: DataFrame, b: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], list[Column]]:
    """Levels of two replicas' trees from the leaves to one root, staged; and how a node's parent is named, for each level but the root.

    Keys below and above 0 shrink to nodes -1 and 0, which the root joins.
    """
    levels, ups = [(common.stage(leaves(a), "merkle"), common.stage(leaves(b), "merkle"))], []
    while True:
        low, high = levels[-1][0].select("node").union(levels[-1][1].select("node")).agg(F.min("node"), F.max("node")).first()
        if low == high:
            return levels, ups
        ups.append(F.lit(0) if -1 <= low and high <= 0 else F.shiftright("node", FANOUT))
        levels.append(tuple(common.stage(parents(x, ups[-1]), "merkle") for x in levels[-1]))


def copies(odd: DataFrame) -> DataFrame:
    """A row for each of surplus copies of (page_id, digest): copy counts them from 0, and k the places within the page_id, in order of digest.

    Places are running sums within and over 256 slots of digests, so the records of a hot id are dealt out.
    """
    slotted = odd.withColumn("slot", F.substring("digest", 1, 2))
    before = Window.partitionBy("page_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("page_id", "slot").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    sums = slotted.groupBy("page_id", "slot").agg(F.sum("surplus").alias("all")).select("page_id", "slot", (F.sum("all").over(before) - F.col("all")).alias("base"))
    placed = slotted.withColumn("start", F.sum("surplus").over(own) - F.col("surplus")).join(sums, ["page_id", "slot"])
    return placed.withColumn("copy", F.explode(F.expr("sequence(0L, surplus - 1)"))).withColumn("k", F.expr("base + start + copy")).drop("slot", "base", "start")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records in which two replicas differ.

    Both are made into trees: a leaf is the ordered records of a range of keys, with their
    lengths, and a node its children with their offset ranges, counted from the node's own
    start, so that a record lost early in a file doesn't make every later range differ.
    Levels are compared from the root down: below a node whose hashes agree nothing is looked
    at, and only ranges that mismatch at every level get their records compared. Rows: page_id, file, offset and length (of the
    primary; null where it lacks the record), digest, replica_digest, state ('changed',
    'missing', 'extra'). Null url or html: empty; null page_id: key -1; repeated records
    are compared by count, a row for each copy that one side has more. Of an id's records
    that differ, the primary's k-th by digest is paired with the replica's k-th, and the rest
    are missing or extra; empty tables: all of the other are missing or extra; other columns
    are ignored.
    """
    a, b = common.stage(records(primary), "warc"), common.stage(records(replica), "warc")
    levels, ups = trees(a, b)
    bads: list[DataFrame] = []
    for i in reversed(range(len(levels))):
        x, y = levels[i]
        if bads:
            x, y = (t.withColumn("up", ups[i].cast("long")).join(bads[-1], "up", "left_semi") for t in (x, y))
        x, y = x.select("node", F.col("hash").alias("p")), y.select("node", F.col("hash").alias("q"))
        bads.append(common.stage(x.join(y, "node", "full").where("NOT (p <=> q)").select(F.col("node").alias("up")), "merkle-bad"))
    bad = bads[-1]
    files = bad.select(F.shiftright("up", FILE).alias("file")).distinct()
    filed = offsets(a.join(files, F.shiftright("leaf", FILE) == files["file"], "left_semi")).join(bad, F.col("leaf") == bad["up"], "left_semi")
    one = filed.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"), F.min("offset").alias("offset"), F.min("length").alias("length"))
    two = b.join(bad, F.col("leaf") == bad["up"], "left_semi").groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("m"))
    odd = common.stage(one.join(two, ["page_id", "digest"], "full").fillna(0, ["n", "m"]).where("n <> m"), "warc-odd")
    left = copies(odd.where("n > m").withColumn("surplus", F.expr("n - m"))).withColumn("offset", F.expr("offset + (m + copy) * length"))
    right = copies(odd.where("m > n").select("page_id", "digest", F.expr("m - n").alias("surplus")))
    out = left.join(right.select("page_id", "k", F.col("digest").alias("replica_digest")), ["page_id", "k"], "full")
    state = F.when(F.col("digest").isNull(), "extra").when(F.col("replica_digest").isNull(), "missing").otherwise("changed")
    out = common.stage(out.select("page_id", "file", "offset", "length", "digest", "replica_digest", state.alias("state")), "warc-differences")
    for t in (a, b, odd, *bads, *(x for pair in levels for x in pair)):
        common.unstage(t)
    return out


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: one page in 11 has a byte flipped, one in 101 is cut short, one in 103 is lost."""
    flip = F.concat(F.lit("~"), F.substring("html", 2, 2**31 - 1))
    cut = F.expr("left(html, cast(length(html) / 2 as int))")
    html = F.when(F.col("page_id") % 101 == 7, cut).when(F.col("page_id") % 11 == 3, flip).otherwise(F.col("html"))
    return pages.where("page_id IS NULL OR page_id % 103 <> 5").select("page_id", "url", html.alias("html"))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP1_SQL = """
WITH a AS (SELECT page_id, page_id // 16 // 256 AS file, coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body FROM pages),
p AS (SELECT page_id, file, sha256(body) AS digest, strlen(body)::BIGINT AS length FROM a),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS "offset" FROM p),
r AS (SELECT page_id, sha256(coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10) || CASE WHEN page_id % 101 = 7 THEN left(html, length(html) // 2) WHEN page_id % 11 = 3 THEN '~' || substr(html, 2) ELSE html END) AS replica_digest
      FROM pages WHERE page_id % 103 <> 5)
SELECT o.page_id, file, "offset", length, digest, replica_digest, CASE WHEN replica_digest IS NULL THEN 'missing' ELSE 'changed' END AS state
FROM o LEFT JOIN r USING (page_id) WHERE digest IS DISTINCT FROM replica_digest
"""
