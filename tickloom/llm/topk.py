"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, SEGMENTS, EVERY = 10, 4, 50
#: Codes of an index shard, on average, whatever the table's size.
SHARD = 1 << 20
#: Queries of a block, on average, and blocks at most: more queries make longer blocks then, as the index is copied to each block.
BLOCK, BLOCKS = 1 << 7, 64


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.uint64)


class Index:
    """Distinct 64-bit codes under SEGMENTS substrings of 16 bits, each with an offset table by value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, 64 // SEGMENTS
        self.rows, self.starts = [], []
        for s in range(SEGMENTS):
            part = (codes >> np.uint64(s * self.bits)) & np.uint64((1 << self.bits) - 1)
            self.rows.append(np.argsort(part, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(part.astype(np.int64), minlength=1 << self.bits)))))
        self.masks: list[np.ndarray] = []

    def search(self, query: np.uint64, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of every code that can hold one of the k nearest rows; room: rows that a code stands for.

        After all segments were searched at radius r, every code within SEGMENTS * (r + 1) - 1
        has been met; the search ends when the k-th row met lies within that.
        """
        met = np.zeros(0, np.int64)
        for r in range(self.bits + 1):
            if r == len(self.masks):
                self.masks.append(_masks(self.bits, r))
            got = [met]
            for s in range(SEGMENTS):
                at = (((query >> np.uint64(s * self.bits)) & np.uint64((1 << self.bits) - 1)) ^ self.masks[r]).astype(np.int64)
                a, n = self.starts[s][at], self.starts[s][at + 1] - self.starts[s][at]
                hit = n > 0
                a, n = a[hit], n[hit]
                got.append(self.rows[s][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
            met = np.unique(np.concatenate(got))
            far = np.bitwise_count(self.codes[met] ^ query).astype(np.int64)
            cover = SEGMENTS * (r + 1) - 1
            sure = np.minimum(room[met[far <= cover]], k).sum()
            if sure >= k or len(met) == len(self.codes):
                break
        order = np.argsort(far, kind="stable")
        enough = np.searchsorted(np.cumsum(np.minimum(room[met[order]], k)), k)
        if enough < len(order):
            order = order[far[order] <= far[order[enough]]]
        return met[order], far[order]


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        codes = index.column("code").to_numpy().view(np.uint64)
        ids = index.column("ids").combine_chunks()
        lists = ids.to_pylist()
        room = np.array([len(x) for x in lists], np.int64)
        out: tuple[list, list, list] = ([], [], [])
        if len(codes):
            find = Index(codes)
            for q, c in zip(queries.column("query_id").to_pylist(), queries.column("code").to_numpy().view(np.uint64)):
                rows, far = find.search(c, k, room)
                best = sorted((d, i) for r, d in zip(rows.tolist(), far.tolist()) for i in lists[r])[:k]
                out[0].extend([q] * len(best)), out[1].extend(i for _, i in best), out[2].extend(d for d, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "distance": pa.array(out[2], pa.int32())})

    return run


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code): bit i of a 64-bit code says that component i is above 0 (null, absent and NaN are not); null vectors and ids go, a vector of over 64 components is an error; other columns are ignored."""
    bits = " + ".join(f"if(coalesce(get(embedding, {i}), 0) > 0, {1 << i}L, 0L)" for i in range(63))
    code = f"({bits}) | if(coalesce(get(embedding, 63), 0) > 0, shiftleft(1L, 63), 0L)"
    whole = f"if(size(embedding) > 64, raise_error('embeddings of over 64 components do not fit a 64-bit code'), {code})"
    return vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", F.expr(whole).cast("long").alias("code"))


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k rows nearest each query by Hamming distance, ties by the smaller id: (query_id, rank, vec_id, distance).

    codes: (vec_id, code); queries: (query_id, code). Rows of one code are kept as their k
    smallest ids, so a hot code is one index entry. Index shards, a hash of the code, meet
    blocks of queries, so the index is copied BLOCKS times at most and a query once for each
    SHARD codes; each search is exact in its shard, and the shards' best are merged. A
    query finds itself if it is in the index. Fewer than k rows: all of them. Empty tables: no
    rows. Repeated rows are one, of codes and of queries.
    """
    distinct, queries = codes.distinct(), queries.select("query_id", "code").distinct()
    n, m = distinct.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), min(BLOCKS, max(1, -(-m // BLOCK)))
    salted = Window.partitionBy("code", F.expr("pmod(xxhash64(vec_id), 64)")).orderBy("vec_id")
    least = distinct.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k)  # Spark limits each group before it sorts
    classes = least.groupBy("code").agg(F.expr(f"slice(sort_array(collect_list(vec_id)), 1, {k})").alias("ids"))
    index = classes.select("code", "ids", F.expr(f"cast(pmod(xxhash64(code), {shards}) as int)").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("query_id", "code", F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    tasks = shards * blocks  # said, so that adaptive execution doesn't join them: codes are small, searches long
    near = index.repartition(tasks, "shard", "block").groupBy("shard", "block").cogroup(asked.repartition(tasks, "shard", "block").groupBy("shard", "block")).applyInArrow(_search(k), "query_id long, vec_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.select("query_id", rank.cast("int").alias("rank"), "vec_id", "distance").where(F.col("rank") <= k)


def op9_topk_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(common.table(spark, sf_dir, "embeddings"))
    return search(codes, codes.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), "code"))


OP9_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id, list_reduce(list_transform(range(64), lambda i: CASE WHEN coalesce(embedding[i + 1], 0) > 0 THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c q JOIN c ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
