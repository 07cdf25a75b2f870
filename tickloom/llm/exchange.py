"""Chunks of whole documents, and sorted hash arrays that chunks and hash buckets send each other.

Row-wise, a k-gram of every word position would move many times the text through the
shuffle. Here a task that holds a chunk of documents sorts the distinct hashes of its k-grams,
cuts them by value into buckets and sends each bucket one packed array. A bucket's task meets
the arrays of all chunks and answers each with one packed array in the same order. A hash
that is hot in the corpus is one entry of a chunk's array, so no task gets more than one entry
for each chunk and hash.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and as many entries as a chunk has words in a bucket, on average.
CHUNK_BYTES = 8 << 20


def pack(u: np.ndarray) -> bytes:
    """A sorted uint64 array as byte planes of its differences."""
    if not len(u):
        return b""
    d = np.diff(u, prepend=u[0])
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<IBQ", len(u), width, int(u[0])) + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    n, width, first = struct.unpack_from("<IBQ", b)
    planes = np.zeros((n, 8), np.uint8)
    low = 13 + n * (width - 1)
    planes[:, : width - 1] = np.frombuffer(b, np.uint8, n * (width - 1), 13).reshape(width - 1, n).T
    planes[:, width - 1] = np.frombuffer(zlib.decompress(b[low:]), np.uint8)
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(first)


def pack_counts(c: np.ndarray) -> bytes:
    kind = "<u1" if not len(c) or c.max() < 256 else "<u4" if c.max() < 2**32 else "<u8"
    return kind[2].encode() + zlib.compress(np.asarray(c).astype(kind).tobytes(), 1)


def unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), f"<u{b[:1].decode()}").astype(np.int64)


def buckets_of(u: np.ndarray, buckets: int) -> np.ndarray:
    """The ends of each bucket's slice of a sorted uint64 array: buckets + 1 positions."""
    edges = np.array([(i << 48) // buckets << 16 for i in range(1, buckets)], np.uint64)  # low bits 0: hashes cut to 48 bits go to the same bucket
    return np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))


def count_chunks(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    return max(1, -(-size // CHUNK_BYTES))


def ordered(docs: DataFrame, text: str = "text", share: float = 1.0) -> tuple[DataFrame, int]:
    """docs with columns chunk and rank, and the number of chunks, each of about `share` CHUNK_BYTES.

    Ranks ascend with doc_id (null last), and rows of one doc_id have one rank. Quantiles of
    doc_id, 8 for each chunk, cut the ids into cells whose bytes are counted, and cells in order
    fill chunks; so far-off ids change nothing. An id that is itself a quantile is a cell of its
    own, and if that holds more than a chunk, it is a rank of several chunks, dealt by a hash of
    the text. The driver sees two numbers for each cell, 16 for each chunk at most.
    """
    limit = max(1, int(share * CHUNK_BYTES))
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    cells = 8 * max(1, -(-size // limit))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 10 * cells)).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    @F.arrow_udf("int")
    def cell(ids: pa.Array) -> pa.Array:
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, x)
        out = 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == x)
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 2 * len(bounds) + 1, out).astype(np.int32))

    marked = docs.withColumn("cell", cell("doc_id"))
    sizes = {r.cell: r.b for r in marked.groupBy("cell").agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("b")).collect()}
    plan, chunks, rank, room = [], 0, -1, 0
    for c in sorted(sizes):
        parts = -(-sizes[c] // limit) if c % 2 else 1
        if parts > 1 or sizes[c] > room:
            chunks, rank, room = chunks + parts, rank + 1, limit if parts == 1 else 0
        room -= sizes[c]
        plan.append((c, chunks - parts, parts, rank))
    table = docs.sparkSession.createDataFrame(plan or [(0, 0, 1, 0)], "cell int, first int, parts int, rank int")
    chunk = F.expr(f"cast(first + pmod(xxhash64({text}), parts) as int)")
    return marked.join(F.broadcast(table), "cell").withColumn("chunk", chunk).drop("cell", "first", "parts"), max(1, chunks)
