"""SimHash near-dedup at a similarity of 0.8: wide fingerprints of 5-word shingles, sampled keys, pivots of each cell."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

#: Differing bits of 256 that link: a Jaccard similarity of 0.8 of 5-word shingles makes 38.7 on average, deviation 5.7.
MOST = 44
#: Share of equal bits in 3-word fingerprints that tables are counted for (0.89 on average at a similarity of 0.8; distances scatter), and the share of such pairs that no table may bring together.
AGREE, MISS = 0.875, 0.02
#: Bits of a key beyond the logarithm of the number of fingerprints: unrelated ones seldom meet.
SPARE = 2
#: Reference fingerprints of a cell, taken from its own members.
PIVOTS = 8
CELL = 1 << 12


def _majority(h: np.ndarray) -> np.ndarray:
    """The bits set in over half the rows of h (n, bytes), packed."""
    counts = np.zeros(h.shape[1] * 8, np.int64)
    for i in range(0, len(h), 1 << 13):
        counts += np.unpackbits(h[i : i + (1 << 13)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(h))


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles, repeat(simhash.SEED))), np.uint64).reshape(-1, 2)


def fingerprint(text: bytes) -> tuple[bytes, bytes]:
    """(256 bits of a text's 5-word shingles, 128 bits of its 3-word ones), A-Z lower-cased, repeats counted; no words: zeros."""
    words = text.lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return bytes(32), bytes(16)
    h = _hashes(words, 5)
    mixed = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    wide = np.ascontiguousarray(np.hstack([h, mixed ^ (mixed >> np.uint64(32))]))
    return _majority(wide.view(np.uint8)).tobytes(), _majority(_hashes(words, 3).view(np.uint8)).tobytes()


def _fingerprints(batches):
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            pairs = [fingerprint(t or b"") for t in part.column("text").to_pylist()]
            both = [pa.array([p[x] for p in pairs], pa.binary()) for x in (0, 1)]
            yield pa.record_batch([part.column("doc_id"), part.column("digest"), *both], names=["doc_id", "digest", "fp", "short"])


def plan(n: int) -> tuple[int, int]:
    """(bits of a key, tables) for n fingerprints."""
    bits = min(48, max(16, math.ceil(math.log2(max(n, 2))) + SPARE))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(AGREE**bits)))


def _keys(bits: int, tables: int):
    random = np.random.default_rng(simhash.SEED)
    weights = np.zeros((128, tables))
    for t in range(tables):
        weights[random.choice(128, bits, replace=False), t] = 2.0 ** np.arange(bits)  # sums under 2 ** 48 are exact in doubles

    def run(batches):
        table = np.arange(tables, dtype=np.int64) << 48
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                raw = np.frombuffer(b"".join(part.column("short").to_pylist()), np.uint8).reshape(-1, 16)
                keys = (np.unpackbits(raw, axis=1).astype(np.float64) @ weights).astype(np.int64) | table
                node = np.repeat(part.column("node").to_numpy(), tables)
                yield pa.record_batch([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def close_pairs(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, most: int = MOST, budget: int = 1 << 19):
    """Index pairs that join all rows of one cell at Hamming distance <= most; cell ascends, and rows of one side >= 0 aren't compared.

    The pivots are members of the cell, so distances to them differ widely between groups of
    copies. Rows within most / 2 of the first pivot are within `most` of each other: they are joined to it
    and not compared among themselves, which keeps a large group of copies linear. Other pairs
    whose distances to some pivot differ by more than most go, the rest is verified.
    """
    start, count = np.unique(cell, return_index=True, return_counts=True)[1:]
    begin, size = np.repeat(start, count), np.repeat(count, count)
    coords = np.stack([_distance(fp, fp[begin + k * size // PIVOTS]) for k in range(PIVOTS)])
    tight = coords[0] <= most // 2
    own = np.flatnonzero(tight & (begin != np.arange(len(fp))))
    yield begin[own], own
    key = np.repeat(np.arange(len(start)), count) * 1024 + coords[0]
    order = np.argsort(key, kind="stable")
    key, f, s, coords, tight, begin = key[order], fp[order], side[order], coords[:, order], tight[order], begin[order]
    places = np.arange(len(f))
    low = np.where(tight, np.searchsorted(key, (key // 1024) * 1024 + most // 2, "right"), places + 1)
    n = np.maximum(np.searchsorted(key, key + most, "right") - low, 0)
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(f):
        to = max(at + 1, int(np.searchsorted(total, total[at] + budget, "right")) - 1)
        c = n[at:to]
        i = np.repeat(places[at:to], c)
        j = np.arange(len(i)) - np.repeat(total[at:to] - total[at], c) + low[i]
        keep = (s[i] < 0) | (s[i] != s[j])
        i, j = i[keep], j[keep]
        for column in coords[1:]:
            keep = np.abs(column[i] - column[j]) <= most
            i, j = i[keep], j[keep]
        keep = _distance(f[i], f[j]) <= most
        yield order[i[keep]], order[j[keep]]
        at = to


def _links(batches):
    for b in batches:
        lists, cross = b.column("rows"), b.column("cross").to_numpy(zero_copy_only=False)
        for x in range(0, b.num_rows, 256):
            part = lists.slice(x, 256)
            rows = part.flatten()
            fp = np.frombuffer(b"".join(rows.field("fp").to_pylist()), np.uint64).reshape(-1, 4)
            node, chunk = rows.field("node").to_numpy(), rows.field("chunk").to_numpy()
            cell = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            order = np.lexsort((node, cell))  # a root is its component's smallest node, the same one in many tables
            fp, node, chunk = fp[order], node[order], chunk[order]
            side = np.where(cross[x : x + 256][cell], chunk, -1)
            root = simhash.roots(len(fp), list(close_pairs(fp, cell, side)))
            own = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.record_batch([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) with the connected components of all nodes whose fingerprints meet in a table and differ in at most MOST bits.

    distinct: node, fp, short. A key is a table's seeded choice of bits of short; keys with one
    node go, larger ones are cut into cells of about 2 * CELL that together hold each pair of
    the key. Joins shuffle at every size: both sides grow with the corpus. A node has a link to
    the smallest node of its component in each cell; of these it keeps the least, and the others are linked
    to that one, so a large group has about a link a node, not one for each table.
    """
    bits, tables = plan(distinct.count())
    spread = distinct.select("node", "short").mapInArrow(_keys(bits, tables), "key long, node long")
    many = spread.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    dealt = spread.join(many.hint("merge"), "key").join(distinct.select("node", "fp").hint("merge"), "node")
    dealt = dealt.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    grid = dealt.select("key", "node", "fp", "chunk", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    cells = grid.groupBy("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list(F.struct("node", "fp", "chunk")).alias("rows"))
    return _starred(cells.where("size(rows) > 1").select("rows", (F.col("lo") != F.col("hi")).alias("cross")).mapInArrow(_links, "a long, b long"))


def _starred(found: DataFrame) -> DataFrame:
    """Links (a, b), b < a, with the same components: each a linked to its least b only, and its other b to that one."""
    least = found.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("least"))
    return least.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """Rows (node, doc_id, digest, n, label) for each distinct (doc_id, digest): equal label, one component of near copies; n rows have that pair.

    docs: doc_id, text and digest, a hash of the row's other columns; other columns are ignored.
    Null and blank texts have fingerprint 0 and link like any other; null and repeated ids
    stand for themselves; an empty table gives an empty result.
    """
    marked = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "digest").mapInArrow(_fingerprints, "doc_id long, digest string, fp binary, short binary")
    marked = common.stage(marked.groupBy("fp", "doc_id", "digest").agg(F.min("short").alias("short"), F.count(F.lit(1)).alias("n")), "wide-simhash")
    distinct = common.stage(marked.groupBy("fp").agg(F.min("short").alias("short")).withColumn("node", F.monotonically_increasing_id()), "wide-simhash-distinct")
    labels = common.components(links(distinct))
    named = distinct.join(labels.hint("merge"), "node", "left").select("fp", "node", F.coalesce("label", "node").alias("label"))
    return marked.join(named.hint("merge"), "fp").select("node", "doc_id", "digest", "n", "label")


def representatives(docs: DataFrame) -> DataFrame:
    """One row for each component: (doc_id, digest, n), its smallest pair, null ids last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "n"))
    return classes(docs).groupBy("label").agg(least.alias("rep")).select("rep.doc_id", "rep.digest", "rep.n")
