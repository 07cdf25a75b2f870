"""Toxicity: a factorization machine over hashed terms, trained in numpy on labelled rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS, FACTORS, SEED = 18, 8, 7
#: Labelled documents that training reads, at most: positive ones up to half, and negative ones up to half.
TRAIN_ROWS = 12_000
#: Terms whose pairs are tested, at most (the most even in the training documents), and terms that pairs choose, at most.
PAIR_TERMS, PAIR_MOST = 1024, 256
_TERM = re.compile(rb"[a-z0-9\x80-\xff]+")


class Terms:
    """Hashed terms of a text: its words, and their first four and five bytes as stems.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A document
    is the set of its terms. Slots of words seen are kept, up to a bound.
    """

    def __init__(self, bits: int = BITS, most: int = 100_000):
        self.mask, self.most, self.seen = (1 << bits) - 1, most, {}

    def _slots(self, w: bytes) -> tuple:
        out = [zlib.crc32(b"w" + w) & self.mask]
        if len(w) > 4:
            out.append(zlib.crc32(b"4" + w[:4]) & self.mask)
        if len(w) > 5:
            out.append(zlib.crc32(b"5" + w[:5]) & self.mask)
        return tuple(out)

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = set(_TERM.findall((text or b"").lower()))
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, out = self.seen, set()
        for w in ws:
            s = seen.get(w)
            if s is None:
                s = seen[w] = self._slots(w)
            out.update(s)
        return np.fromiter(out, np.int32, len(out))


class Machine:
    """logit = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, x_i = 1 for a term that occurs and was selected."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        n = len(docs)
        if not n:
            return np.zeros(0)
        idx = np.concatenate(docs)
        doc = np.repeat(np.arange(n), [len(d) for d in docs])
        keep = self.w[idx] != 0
        idx, doc = idx[keep], doc[keep]
        z = self.w0 + np.bincount(doc, self.w[idx], n)
        for f in range(self.v.shape[1]):
            x = self.v[idx, f]
            z += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(pos: np.ndarray, all_: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Terms whose share of documents differs between the classes by a z-score of 4, of those in 8 documents or more."""
    share = (all_ + 1) / (n1 + n0 + 2)
    z = (pos / n1 - (all_ - pos) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= 4) & (all_ >= 8)


def even(all_: np.ndarray, rows: int) -> np.ndarray:
    """The PAIR_TERMS terms whose occurrence varies most, of those in 8 documents or more; ties by the smaller slot."""
    spread = np.where(all_ >= 8, all_ / rows * (1 - all_ / rows), 0)
    order = np.argsort(-spread, kind="stable")[:PAIR_TERMS]
    return np.sort(order[spread[order] > 0])


def paired(docs: list[np.ndarray], y: np.ndarray, terms: np.ndarray, least: float = 8.0) -> np.ndarray:
    """Terms of pairs whose covariance differs between the classes: those that tell only together, such as one of two words but not both.

    The z-score of a pair is the difference of its covariances over its standard error were
    the terms independent. Of the terms that reach `least`, the PAIR_MOST with the highest.
    """
    place = np.full(1 + max(map(int, terms), default=0), -1)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(docs), len(terms)), np.float32)
    for row, d in zip(x, docs):
        p = place[d[d < len(place)]]
        row[p[p >= 0]] = 1
    cov, var = [], []
    for label in (1, 0):
        own = x[y == label]
        m = own.mean(0)
        cov.append((own.T @ own) / len(own) - np.outer(m, m))
        v = m * (1 - m) + 1 / len(own)
        var.append(np.outer(v, v) / len(own))
    z = np.abs(cov[0] - cov[1]) / np.sqrt(var[0] + var[1])
    np.fill_diagonal(z, 0)
    best = z.max(0, initial=0)
    order = np.argsort(-best, kind="stable")[:PAIR_MOST]
    return terms[order[best[order] >= least]]


def fit(docs: list[np.ndarray], y: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 30, seed: int = SEED) -> Machine:
    """Train a factorization machine on term sets and 0/1 labels.

    Kept are terms whose document counts differ between the classes by a z-score of 4 or more,
    and terms of a pair whose covariance does by 8 or more (see paired): a text has hundreds of
    neutral words, whose small weights would add up with its length. Weights and factors are
    learned by mini-batch AdaGrad on the logistic loss. No rows, or one class only: the base
    rate alone.
    """
    rng, size = np.random.default_rng(seed), 1 << bits
    w, v = np.zeros(size), np.zeros((size, factors))
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Machine(float(np.log(rate / (1 - rate))), w, v)
    idx, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    pos, all_ = np.bincount(idx[y[doc] == 1], minlength=size), np.bincount(idx, minlength=size)
    n1, n0 = y.sum(), len(y) - y.sum()
    chosen = telling(pos, all_, n1, n0)
    chosen[paired(docs, y, even(all_, len(y)))] = True
    picked = [d[chosen[d]] for d in docs]
    v[chosen] = rng.normal(0, 0.05, (chosen.sum(), factors))
    w[chosen] = 1e-6
    w0, gw0, gw, gv = float(np.log(n1 / n0)), 1e-6, np.full(size, 1e-6), np.full((size, factors), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            part = order[at : at + 256]
            i = np.concatenate([picked[p] for p in part])
            d = np.repeat(np.arange(len(part)), [len(picked[p]) for p in part])
            n = len(part)
            sums = np.stack([np.bincount(d, v[i, f], n) for f in range(factors)], 1)
            sq = np.stack([np.bincount(d, v[i, f] ** 2, n) for f in range(factors)], 1)
            zz = w0 + np.bincount(d, w[i], n) + 0.5 * (sums**2 - sq).sum(1)
            err = (1 / (1 + np.exp(-np.clip(zz, -30, 30))) - y[part]) / n
            u, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, err[d], len(u)) + 1e-5 * w[u]
            dv = np.stack([np.bincount(inv, err[d] * (sums[d, f] - v[i, f]), len(u)) for f in range(factors)], 1) + 1e-5 * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            w[u] -= 0.2 * dw / np.sqrt(gw[u])
            v[u] -= 0.05 * dv / np.sqrt(gv[u])
            g = err.sum()
            gw0 += g * g
            w0 -= 0.2 * g / np.sqrt(gw0)
    return Machine(float(w0), w, v)


def _terms(batches):
    terms = Terms()
    for b in batches:
        for i in range(0, b.num_rows, 1024):
            part = b.slice(i, 1024)
            got = [np.sort(terms(t)) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), part.column("toxic"), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])


def _only(may: np.ndarray):
    def run(batches):
        for b in batches:
            got = [np.array(t, np.int32) for t in b.column("terms").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array([g[may[g]].tobytes() for g in got], pa.binary())], names=["doc_id", "toxic", "terms"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most `rows` labelled documents: those first by a digest of doc_id, up to half of them toxic.

    Only rows whose crc32(doc_id) mod 5 is not 0 are used; a doc_id with several label rows
    counts by its largest; of several texts under one doc_id, the one with the least terms in
    order is read. Null labels are left out. The driver gets a count for each slot of terms,
    2^BITS at most, and `rows` documents at most, cut to the terms that can be chosen.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where("crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id")
    chosen = None
    for label in (1, 0):
        part = known.where(F.col("toxic") == label).orderBy(place, "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    each = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_terms, "doc_id long, toxic int, terms array<int>")
    table = common.stage(each.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")), "toxicity-terms")
    n = {r.toxic: r["count"] for r in table.groupBy("toxic").count().collect()}
    counts = table.select("toxic", F.explode("terms").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("pos")).toPandas()
    all_, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    all_[counts.slot], pos[counts.slot] = counts.n, counts.pos
    may = np.zeros(1 << BITS, bool)
    if len(n) == 2:
        may = telling(pos, all_, n[1], n[0])
        may[even(all_, sum(n.values()))] = True
    got = table.select("doc_id", "toxic", "terms").mapInArrow(_only(may), "doc_id long, toxic int, terms binary").collect()
    common.unstage(table)
    got.sort(key=lambda r: r.doc_id)
    return fit([np.frombuffer(r.terms, np.int32) for r in got], np.array([r.toxic for r in got], float))


def _scores(machine):
    def run(batches):
        terms, model = Terms(), Machine(*machine.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                s = model.score([terms(t) for t in part.column("text").to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) of every whole text; null, empty and blank texts get the score of no terms.

    Repeated rows get the same score; an empty table gives no row; labels, language, source
    and id are not looked at; other columns are ignored. The model is a fixed size (2^BITS
    slots), so it is broadcast whatever the data.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scores(sent), "doc_id long, score double")


def op3_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is also true of a null doc_id, which is never learned from."""
    docs = common.table(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(machine):
    def run(batches):
        terms, model = Terms(), Machine(*machine.value)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                text = part.column("text").cast(pa.binary())
                yield part.filter(pa.array(model.score([terms(t) for t in text.to_pylist()]) < 0.5))

    return run


def keep(docs: DataFrame, model: Machine) -> DataFrame:
    """The rows, with all their columns, whose text scores under 0.5; column text must be there.

    Null, empty and blank texts are judged by the score of no terms; repeated rows are judged
    alike; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))
    return docs.mapInArrow(_kept(sent), docs.schema)
