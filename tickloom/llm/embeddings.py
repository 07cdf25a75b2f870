"""Embedding near-dedup: randomised-rotation binary codes whose unbiased estimates and bounds decide what is computed exactly."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .simhash import roots

#: Share of pairs at exactly the threshold that should meet in a table; pairs above it meet more often.
RECALL = 0.97
#: Standard errors that the bound of an estimate allows for.
SIGMAS = 4.0
#: Classes of a key in one cell; larger keys are split into a grid of cells.
CELL = 4096
SEED = 20250


@lru_cache(maxsize=256)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, seed)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def tables(dim: int, classes: int, least: float) -> tuple[int, int]:
    """(tables, rotations joined in a key) for so many vectors of a dimension.

    A key names the signed axis nearest a vector under each joined rotation, of 2 * dim; so many
    are joined that keys hold CELL vectors on average at most. The chance p that two vectors at
    cosine `least` share an axis is simulated, and tables follow from it: 1 - (1 - p^joined)^tables >= RECALL.
    """
    joined = max(1, int(np.ceil(np.log(max(1, classes / CELL)) / np.log(2 * dim))))
    r = np.random.default_rng((SEED, dim))
    n = max(500, 2_000_000 // dim // 2)
    x = r.normal(size=(min(n, 20_000), dim))
    y = least * x + np.sqrt(max(0, 1 - least**2)) * r.normal(size=x.shape)
    a, b = np.abs(x).argmax(1), np.abs(y).argmax(1)
    rows = np.arange(len(x))
    p = min(0.999, ((a == b) & (np.sign(x[rows, a]) == np.sign(y[rows, b]))).mean()) ** joined
    return max(1, int(np.ceil(np.log(1 - RECALL) / np.log1p(-max(p, 1e-6))))), joined


def _matrix(lists: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The rows of a list column that all have `size` entries, as a matrix."""
    return lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def _keys(plan: dict):
    """Class rows -> with keys: one for each table, a hash of the signed axes."""

    def run(batches):
        for b in batches:
            v = b.column("vec")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            keys: list = [None] * b.num_rows
            for dim in np.unique(sizes):
                own, (made, joined) = np.flatnonzero(sizes == dim), plan[int(dim)]
                x = _matrix(v, own, int(dim)).astype(np.float64)
                code = np.zeros((len(own), made), np.uint64)
                for t in range(made):
                    for j in range(joined):
                        y = x @ rotation(int(dim), 1 + t * joined + j)
                        axis = np.abs(y).argmax(1)
                        code[:, t] = (code[:, t] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (2 * axis + (y[np.arange(len(own)), axis] > 0)).astype(np.uint64)
                for i, c in zip(own, code.view(np.int64).tolist()):
                    keys[i] = c
            yield pa.record_batch([*b.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*b.schema.names, "keys"])

    return run


class Codes:
    """One-bit codes of unit vectors under a rotation, with what corrects their inner products.

    For a unit vector o rotated to r, the code is sign(r), as the unit vector s = sign(r)/sqrt(D),
    and f = <s, r>. For any unit q, <s, q'> / f is an unbiased estimate of <o, q> over the
    rotation; its standard error is at most sqrt((1 - f^2) / (f^2 (D - 1))).
    """

    def __init__(self, unit: np.ndarray):
        d = unit.shape[1]
        self.rotated = unit @ rotation(d, 0)
        self.sign = np.where(self.rotated > 0, 1.0, -1.0) / np.sqrt(d)
        self.f = np.maximum((self.sign * self.rotated).sum(1), 1e-9)
        self.error = np.sqrt(np.maximum(0, 1 - self.f**2) / (self.f**2 * max(1, d - 1)))

    def upper(self, a, b) -> np.ndarray:
        """The upper confidence bound of the inner products of rows a with rows b."""
        return self.sign[a] @ self.rotated[b].T / self.f[a, None] + SIGMAS * self.error[a, None]


def _cell(least: float):
    """The classes of a cell -> for those with links here, rep, links (rows they link with), and root, the first class they hang together with.

    A cell of one chunk holds all pairs in it, one of two chunks the pairs across.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rep, n, chunk = (t.column(c).to_numpy() for c in ("rep", "n", "chunk"))
        size, dim, table = t.num_rows, t.column("dim")[0].as_py(), t.column("t")[0].as_py()
        vec = _matrix(t.column("vec").chunk(0), np.arange(size), dim).astype(np.float64)
        keys = t.column("keys").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
        norm = np.sqrt((vec**2).sum(1))
        codes, links, pairs = Codes(vec / norm[:, None]), np.zeros(size, np.int64), []
        lo = np.flatnonzero(chunk == t.column("lo")[0].as_py())
        hi = lo if t.column("lo")[0].as_py() == t.column("hi")[0].as_py() else np.flatnonzero(chunk != chunk[lo[0]]) if len(lo) else lo
        for x in range(0, len(lo), 512):
            a = lo[x : x + 512]
            b = lo[x:] if hi is lo else hi
            i, j = np.nonzero(codes.upper(a, b) >= least)
            i, j = a[i], b[j]
            if hi is lo:
                i, j = i[i < j], j[i < j]
            first = (keys[i] == keys[j]).argmax(1) == table  # a pair counts in the first table that has it
            i, j = i[first], j[first]
            dot = np.einsum("ij,ij->i", vec[i], vec[j]) / (norm[i] * norm[j])
            i, j = i[dot >= least], j[dot >= least]
            links += np.bincount(i, n[j], size).astype(np.int64) + np.bincount(j, n[i], size).astype(np.int64)
            root = roots(size, [(i, j)])
            own = np.flatnonzero(root != np.arange(size))
            pairs.append((own, root[own]))
        got, root = np.flatnonzero(links), roots(size, pairs)
        return pa.table({"rep": pa.array(rep[got]), "links": pa.array(links[got]), "root": pa.array(rep[root[got]])})

    return run


def near(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Near-duplicate vectors by cosine: (vec_id, n_links, component_id, kept).

    Equal vectors are one class, whose copies link with each other without being expanded.
    Classes meet in hash tables, a key being the nearest signed axis under joined random
    rotations (see tables: their number follows from the dimension and the number of classes);
    within a key, one-bit codes give unbiased estimates, pairs whose upper confidence bound
    (SIGMAS) is below `least` go, and the rest is computed in double precision, so no link is
    below it. A pair counts in the first table that has it. Keys with many classes are split
    into cells that together hold each of their pairs; cells return counts and star edges.
    Recall is measured against brute force in tests.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor does a row without vec_id; vectors of unlike dimension don't link; repeated
    rows are copies; an empty table gives none; other columns are ignored.
    """
    ok = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)")
    kind = "array<double>" if dict(vectors.dtypes)["embedding"] == "array<double>" else "array<float>"
    vec = F.transform(F.col("embedding").cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1]))  # -0.0 is 0.0
    rows = vectors.select("vec_id", F.when(ok & F.col("vec_id").isNotNull(), vec).alias("vec")).select("vec_id", "vec", F.struct(F.xxhash64("vec"), F.hash("vec")).alias("same"))
    classes = common.stage(rows.where("vec IS NOT NULL").groupBy("same", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("same", "rep", "n", F.size("vec").alias("dim"), "vec"), "vectors")
    plan = {r.dim: tables(r.dim, r["count"], least) for r in classes.groupBy("dim").count().collect()}
    keyed = classes.select("rep", "n", "dim", "vec").mapInArrow(_keys(plan), f"rep long, n long, dim int, vec {kind}, keys array<long>")
    spread = keyed.select("rep", "n", "dim", "vec", "keys", F.posexplode("keys").alias("t", "key"))
    many = keyed.select("dim", F.posexplode("keys").alias("t", "key")).groupBy("dim", "t", "key").count().where("count > 1").select("dim", "t", "key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    dealt = spread.join(many, ["dim", "t", "key"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    grid = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    cells = grid.select("dim", "t", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "rep", "n", "chunk", "vec", "keys").groupBy("dim", "t", "key", "lo", "hi")
    found = common.stage(cells.applyInArrow(_cell(least), "rep long, links long, root long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = common.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    out = common.again(classes).select("same", "rep", "n").join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("same", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    done = rows.select("vec_id", F.when(F.col("vec").isNotNull(), F.col("same")).alias("same")).join(out, "same", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    done = common.stage(done.withColumn("kept", F.expr("vec_id <=> component_id")), "near-vectors")
    for t in (classes, found, labels):
        common.unstage(t)
    return done


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(common.table(spark, sf_dir, "embeddings"))
