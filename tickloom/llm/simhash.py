"""SimHash near-dedup: blocked fingerprints, a pivot distance table in each block, verified links, components."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Reference fingerprints of the pivot table (seeded, so that every task has the same).
PIVOTS = np.random.default_rng(64).integers(0, 2**63, 24, dtype=np.uint64) * np.uint64(2) + (np.arange(24, dtype=np.uint64) & np.uint64(1))
#: Fingerprints in a cell; larger blocks are split into a grid of cells that covers all their pairs.
CELL = 1 << 14


def fingerprint(text: bytes, k: int = 3) -> int:
    """SimHash of a text's k-word shingles (A-Z lower-cased, repeats counted); no words: 0."""
    words = text.lower().split()  # bytes: ASCII white space and letters only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            fp = np.fromiter((fingerprint(t or b"") for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.record_batch([*map(part.column, rest), pa.array(fp.view(np.int64))], names=[*rest, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long. Null and blank texts: 0."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, cell: np.ndarray, side: np.ndarray | None, most: int, budget: int = 1 << 21):
    """Index pairs (i, j) of one cell at Hamming distance <= most, by pivot table.

    The table holds each fingerprint's distance to every pivot. Two fingerprints at distance d
    differ by at most d in every column, so pairs that differ by more in some column go: the
    first column by sorting, the others one after another. What is left is verified.
    """
    first = np.bitwise_count(fp ^ PIVOTS[0]).astype(np.int64)
    key = cell.astype(np.int64) * 256 + first
    order = np.argsort(key, kind="stable")
    key, f, s = key[order], fp[order], None if side is None else side[order]
    coords = np.stack([np.bitwise_count(f ^ p) for p in PIVOTS[1:]]).astype(np.int8)
    after = np.searchsorted(key, key + most, "right")
    n = after - np.arange(len(f)) - 1
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(f):
        to = max(at + 1, int(np.searchsorted(total, total[at] + budget, "right")) - 1)
        c = n[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = np.arange(len(i)) - np.repeat(total[at:to] - total[at], c) + i + 1
        if s is not None:
            keep = (s[i] < 0) | (s[i] != s[j])
            i, j = i[keep], j[keep]
        for column in coords:
            if len(i) == 0:
                break
            keep = np.abs(column[i] - column[j]) <= most
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(f[i] ^ f[j]) <= most
        yield order[i[keep]], order[j[keep]]
        at = to


def roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each index by the pairs."""
    label = np.arange(n)
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _links(most: int):
    def run(batches):
        for b in batches:
            lists, cross = b.column("fps"), b.column("cross").to_numpy(zero_copy_only=False)
            for x in range(0, b.num_rows, 2048):
                part = lists.slice(x, 2048)
                rows = part.flatten()
                fp = rows.field("fp").to_numpy().view(np.uint64)
                chunk = rows.field("chunk").to_numpy()
                cell = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                side = np.where(cross[x : x + 2048][cell], chunk, -1)
                found = list(close_pairs(fp, cell, side, most))
                root = roots(len(fp), found)
                own = np.flatnonzero(root != np.arange(len(fp)))
                if len(own):
                    yield pa.record_batch([pa.array(fp[own].view(np.int64)), pa.array(fp[root[own]].view(np.int64))], names=["a", "b"])

    return run


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that join all fingerprints of column fp at distance <= most, as star edges of each cell.

    Of four blocks of 16 bits one is equal in such a pair, and of four blocks of 12 of the
    other 48 bits one more: 16 keys of 28 bits. Keys with one fingerprint go; larger ones are
    cut into cells of at most 2 * CELL, which together hold each pair of the key. most <= 3.
    """
    if most > 3:
        raise ValueError("the 16 keys cover up to 3 differing bits")
    keys = []
    for i in range(4):
        block = f"(shiftrightunsigned(fp, {16 * i}) & 65535L)"
        low = f"(fp & {2 ** (16 * i) - 1}L)" if i else "0L"
        high = f"shiftleft(shiftrightunsigned(fp, {16 * i + 16}), {16 * i})" if i < 3 else "0L"
        rest = f"({low} | {high})"
        keys += [f"shiftleft({4 * i + j}L, 28) | shiftleft({block}, 12) | (shiftrightunsigned({rest}, {12 * j}) & 4095L)" for j in range(4)]
    spread = distinct.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))
    many = spread.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    dealt = spread.join(many, "key").withColumn("chunk", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    grid = dealt.select("key", "fp", "chunk", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    cells = grid.groupBy("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")).agg(F.collect_list(F.struct("fp", "chunk")).alias("fps"))
    cells = cells.where("size(fps) > 1").select("fps", (F.col("lo") != F.col("hi")).alias("cross"))
    return cells.mapInArrow(_links(most), "a long, b long").distinct()


def labelled(distinct: DataFrame, most: int) -> DataFrame:
    """distinct with label: the smallest fingerprint of fp's component."""
    labels = common.components(links(distinct, most))
    return distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def dedup(docs: DataFrame, most: int = 3) -> DataFrame:
    """SimHash near-duplicates of documents: (doc_id, fp, component_id).

    Fingerprints at most `most` bits apart are linked; component_id is the smallest doc_id
    reachable, the document's own included. Null, empty and blank texts have fingerprint 0 and
    link like any other; repeated rows are copies; a null doc_id takes part and never names a
    component of others; an empty table gives an empty result; other columns are ignored.
    """
    marked = common.stage(fingerprints(docs), "simhash")
    distinct = common.stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    classes = labelled(distinct, most)
    low = classes.groupBy("label").agg(F.min("rep").alias("component_id"))
    return marked.join(classes.select("fp", "label").join(low, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
