"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays that workers memory-map."""

from __future__ import annotations

import io
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exchange
from .exchange import buckets_of, count_chunks, pack, pack_counts, unpack, unpack_counts
from .textkit import mix, word_hashes

#: Hashes of the marks before and after a text; no word hashes to them but by chance.
BEGIN, END = np.uint64(0x0B0B0B0B5EED0001), np.uint64(0xE0E0E0E05EED0002)
#: Words that follow are told apart by 64 - _CUT bits within one context.
_CUT = np.uint64(16)
_SCHEMA = "kind string, bucket int, a binary, b binary, c binary, d binary"


# --- the model's files ----------------------------------------------------------------------


def _remote(folder: str) -> bool:
    return "://" in folder and not folder.startswith("file:")


def _plain(folder: str) -> str:
    return "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write one array; a task that runs twice replaces its own file by an equal one."""
    if _remote(folder):
        from pyarrow import fs

        at, base = fs.FileSystem.from_uri(folder)
        at.create_dir(base, recursive=True)
        data = io.BytesIO()
        np.save(data, array)
        with at.open_output_stream(f"{base}/{name}.npy") as f:
            f.write(data.getbuffer())
        return
    base = _plain(folder)
    os.makedirs(base, exist_ok=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, f"{base}/{name}.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped: from the shared folder, or a copy of it where that can't be mapped."""
    if not _remote(folder):
        return np.load(f"{_plain(folder)}/{name}.npy", mmap_mode="r")
    from pyarrow import fs

    at, base = fs.FileSystem.from_uri(folder)
    with tempfile.NamedTemporaryFile(suffix=".npy") as f, at.open_input_stream(f"{base}/{name}.npy") as g:
        while data := g.read(1 << 22):
            f.write(data)
        f.flush()
        return np.load(f.name, mmap_mode="r")


class Shards:
    """Sorted hash arrays by bucket, mapped when first asked for."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.open = folder, buckets, {}

    def get(self, kind: str, bucket: int, field: str) -> np.ndarray:
        name = f"{kind}-{bucket}-{field}"
        if name not in self.open:
            self.open[name] = mapped(self.folder, name)
        return self.open[name]

    def find(self, kind: str, fields: tuple, keys: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
        """What the shards hold for sorted keys of each bucket (cut: their ends); 0 for keys that aren't there."""
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        for b in range(self.buckets):
            if cut[b] < cut[b + 1]:
                own, held = keys[cut[b] : cut[b + 1]], self.get(kind, b, "key")
                if len(held):
                    i = np.minimum(np.searchsorted(held, own), len(held) - 1)
                    hit = held[i] == own
                    for x, f in zip(out, fields):
                        x[cut[b] : cut[b + 1]][hit] = self.get(kind, b, f)[i[hit]]
        return out


# --- counting -------------------------------------------------------------------------------


def _chunks(batches):
    """Tables of about CHUNK_BYTES of text; a chunk is what a task counts or scores at once."""
    held, size = [], 0
    for b in batches:
        lengths = np.array([0 if n is None else n for n in pc.binary_length(b.column("text")).to_pylist()], np.int64)
        at = 0
        while at < b.num_rows:
            total = size + np.cumsum(lengths[at:] + 1)
            n = int(np.searchsorted(total, exchange.CHUNK_BYTES, "left")) + 1
            part = b.slice(at, n)
            held.append(part)
            at += part.num_rows
            size = int(total[part.num_rows - 1])
            if size >= exchange.CHUNK_BYTES:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _tokens(texts: list):
    """Token hashes (words, then END, text after text), the contexts before them, and first[i]."""
    h, at = word_hashes([x or b"" for x in texts], lower=True)
    first = at + np.arange(len(at))
    tok = np.empty(first[-1], np.uint64)
    last = first[1:] - 1
    inner = np.ones(len(tok), bool)
    inner[last] = False
    tok[inner], tok[last] = h, END
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[first[:-1]] = BEGIN
    return tok, before, first


def _pair_types(tok: np.ndarray, before: np.ndarray):
    """Distinct bigrams in order of (context, short token): context, token, count, and each position's place."""
    v, vin = np.unique(tok >> _CUT << _CUT, return_inverse=True)
    u, uin = np.unique(before, return_inverse=True)
    g, gin, c = np.unique(uin.astype(np.int64) * len(v) + vin, return_inverse=True, return_counts=True)
    return u[g // max(1, len(v))], v[g % max(1, len(v))], c, gin


def _key(context: np.ndarray, short: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + short)


def _route(context: np.ndarray, key: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each bigram: by its context, or by the whole bigram where the context is hot."""
    edges = np.array([(i << 48) // buckets << 16 for i in range(1, buckets)], np.uint64)
    return np.searchsorted(edges, np.where(np.isin(context, hot), key, context), "right")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[2:]]], names=["kind", "bucket", "a", "b", "c", "d"])


def _count_words(buckets: int):
    def run(batches):
        for t in _chunks(batches):
            v, c = np.unique(_tokens(t.column("text").to_pylist())[0], return_counts=True)
            cut = buckets_of(v, buckets)
            yield _rows([("word", b, pack(v[cut[b] : cut[b + 1]]), pack_counts(c[cut[b] : cut[b + 1]]), None, None) for b in range(buckets) if cut[b] < cut[b + 1]])

    return run


def _add(arrays: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, place = np.unique(np.concatenate([a for a, _ in arrays]), return_inverse=True)
    return k, np.bincount(place, np.concatenate([c for _, c in arrays]), len(k)).astype(np.int64)


def _merge_words(t: pa.Table) -> pa.Table:
    v, c = _add([(unpack(a), unpack_counts(b)) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())])
    return pa.Table.from_batches([_rows([("word", t.column("bucket")[0].as_py(), pack(v), pack_counts(c), None, pack_counts(np.array([c.sum(), len(c)])))])])


def _over(least: float):
    def run(batches):
        for b in batches:
            for keys, counts in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                yield pa.record_batch([pa.array(unpack(keys)[unpack_counts(counts) >= least].view(np.int64))], names=["key"])

    return run


def _count_pairs(buckets: int, hot: np.ndarray):
    def run(batches):
        for t in _chunks(batches):
            tok, before, _ = _tokens(t.column("text").to_pylist())
            u, v, c, _ = _pair_types(tok, before)
            to = _route(u, _key(u, v), hot, buckets)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                own = order[ends[b] : ends[b + 1]]
                if len(own):
                    context, sizes = np.unique(u[own], return_counts=True)
                    six = (v[own] >> _CUT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                    rows.append(("pair", b, pack(context), pack_counts(sizes), six, pack_counts(c[own])))
            yield _rows(rows)

    return run


def _merge_pairs(folder: str, buckets: int, hot: np.ndarray):
    """A bucket of bigrams: its shard is written; hot contexts' part totals, how often each word continues, and counts of counts go on."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        us = [np.repeat(unpack(a), unpack_counts(b)) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())]
        vs = []
        for b in t.column("c").to_pylist():
            wide = np.zeros((len(b) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
            vs.append(wide.reshape(-1).view("<u8") << _CUT)
        u, uin = np.unique(np.concatenate(us), return_inverse=True)
        v, vin = np.unique(np.concatenate(vs), return_inverse=True)
        g, place = np.unique(uin * len(v) + vin, return_inverse=True)
        c = np.bincount(place, np.concatenate([unpack_counts(b) for b in t.column("d").to_pylist()])).astype(np.int64)
        of, word = g // len(v), g % len(v)
        stats = np.stack([np.bincount(of, c, len(u)).astype(np.int64)] + [np.bincount(of[hit], minlength=len(u)) for hit in (c == 1, c == 2, c > 2)])
        key = _key(u[of], v[word])
        order = np.argsort(key, kind="stable")
        small = np.uint16 if c.max() < 65536 else np.uint64
        save(folder, f"pair-{bucket}-key", key[order]), save(folder, f"pair-{bucket}-count", c[order].astype(small))
        is_hot = np.isin(u, hot)
        save(folder, f"context-{bucket}-key", u[~is_hot])
        for name, x in zip(("total", "ones", "twos", "more"), stats):
            save(folder, f"context-{bucket}-{name}", x[~is_hot].astype(np.uint32 if x.max() < 2**32 else np.uint64))
        sums = np.array([(c == n).sum() for n in (1, 2, 3, 4)] + [len(c)])
        rows = [("sums", bucket, None, None, None, pack_counts(sums)), ("hot", bucket, u[is_hot].tobytes(), stats[:, is_hot].tobytes(), None, None)]
        goes = np.bincount(word, minlength=len(v))
        cut = buckets_of(v, buckets)
        rows += [("goes", b, pack(v[cut[b] : cut[b + 1]]), pack_counts(goes[cut[b] : cut[b + 1]]), None, None) for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _finish_words(folder: str):
    """A bucket of words: the shard of counts and numbers of contexts is written; counts of these go on."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        bucket = rows[0]["bucket"]
        (v, c), = [(unpack(r["a"]), unpack_counts(r["b"])) for r in rows if r["kind"] == "word"]
        w, k = _add([(unpack(r["a"]), unpack_counts(r["b"])) for r in rows if r["kind"] == "goes"])
        i = np.minimum(np.searchsorted(w, v >> _CUT << _CUT), len(w) - 1)
        n = np.where(w[i] == v >> _CUT << _CUT, k[i], 0)
        for name, x in (("key", v), ("count", c.astype(np.uint64)), ("contexts", n.astype(np.uint64))):
            save(folder, f"word-{bucket}-{name}", x)
        return pa.Table.from_batches([_rows([("sums", bucket, None, None, None, pack_counts(np.array([*((n == j).sum() for j in (1, 2, 3, 4)), (n > 2).sum(), n.sum()])))])])

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of types with counts 1 to 4; 0.5, 0.75, 0.9 of what can't be estimated."""
    n1, n2, n3, n4 = map(float, n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 0.9
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


# --- scoring --------------------------------------------------------------------------------


def _score(folder: str, buckets: int, hot: np.ndarray, stats: np.ndarray, total: dict):
    big, small = np.array([0, *total["big"]]), np.array([0, *total["small"]])

    def run(batches):
        shards = Shards(folder, buckets)
        edge = np.arange(buckets + 1)
        for t in _chunks(batches):
            tok, before, first = _tokens(t.column("text").to_pylist())
            v, vin = np.unique(tok, return_inverse=True)
            u, uin = np.unique(before, return_inverse=True)
            c, n = shards.find("word", ("count", "contexts"), v, buckets_of(v, buckets)) if total["words"] else np.zeros((2, len(v)), np.int64)
            x, y, _, gin = _pair_types(tok, before)
            gc, sums = np.zeros(len(x), np.int64), np.zeros((4, len(u)), np.int64)
            if total["types"]:
                key = _key(x, y)
                to = _route(x, key, hot, buckets)
                order = np.lexsort((key, to))
                gc[order] = shards.find("pair", ("count",), key[order], np.searchsorted(to[order], edge))[0]
                sums[:] = shards.find("context", ("total", "ones", "twos", "more"), u, buckets_of(u, buckets))
                i = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
                hit = hot[i] == u
                sums[:, hit] = stats[:, i[hit]]
            types = max(1, total["types"])
            spare = (small[1] * total["ones"][0] + small[2] * total["ones"][1] + small[3] * total["ones"][2]) / types
            lower = (n - small[np.minimum(n, 3)]) / types + (spare if total["types"] else 1.0) / (total["words"] + 1)
            seen = np.maximum(sums[0], 1)
            back = np.where(sums[0] > 0, (big[1] * sums[1] + big[2] * sums[2] + big[3] * sums[3]) / seen, 1.0)
            p = (gc - big[np.minimum(gc, 3)])[gin] / seen[uin] + back[uin] * lower[vin]
            base = np.log10((c + 0.1) / (total["tokens"] + 0.1 * (total["words"] + 1)))
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token at least
            yield pa.record_batch([t.column("doc_id").combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(add((c > 0).astype(np.int64)[vin]), pa.int64()), pa.array(add(base[vin])), pa.array(add(np.log10(p)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, learn) -> DataFrame:
    """Scores of all whole texts by a model learned from the rows where `learn` holds.

    Tokens are the words, A-Z lower-cased, then one end. Returns doc_id, n_tokens, n_known
    (tokens that occur in training), train_tokens, base_score (additive unigram, log10) and
    score (log10 probability under the interpolated modified Kneser-Ney bigram model, whose
    lower order counts contexts and falls back to uniform over the training words and one
    unknown).

    Tasks count chunks of text and send each bucket of hashes one packed sorted array; a
    bucket adds them up and writes its shard of the model, sorted arrays of word, context and
    bigram hashes with counts, to the shared folder. Contexts so common that one bucket would
    get more than 4 shares (at most a quarter as many as buckets, and the start of a text) are
    dealt by the whole bigram. Scoring maps the shards and looks up the distinct n-grams
    of a chunk in order; no text is shuffled. The scores are staged, and the model is deleted.

    Null, empty and blank texts are the end alone; repeated rows count again; a null doc_id is
    scored like others; empty table: no rows; nothing to learn from: uniform; other columns
    are ignored. Words that follow a context are told apart by 48 bits of their hash.
    """
    spark, n = docs.sparkSession, count_chunks(docs)
    folder = f"{common.shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    text = F.col("text").cast("binary").alias("text")
    taught = docs.where(F.coalesce(learn, F.lit(False))).select(text)
    words = common.stage(taught.mapInArrow(_count_words(n), _SCHEMA).groupBy("bucket").applyInArrow(_merge_words, _SCHEMA), "lm-words")
    tokens, types = sum((unpack_counts(r.d) for r in words.select("d").collect()), np.zeros(2, np.int64)).tolist()
    common_words = words.select("a", "b").mapInArrow(_over(max(1, 4 * tokens / n)), "key long").collect()
    hot = np.unique(np.array([BEGIN, *(np.uint64(r.key % 2**64) for r in common_words)], np.uint64))
    pairs = common.stage(taught.mapInArrow(_count_pairs(n, hot), _SCHEMA).groupBy("bucket").applyInArrow(_merge_pairs(folder, n, hot), _SCHEMA), "lm-pairs")
    m = sum((unpack_counts(r.d) for r in pairs.where("kind = 'sums'").select("d").collect()), np.zeros(5, np.int64)).tolist()
    stats = np.zeros((4, len(hot)), np.int64)
    for r in pairs.where("kind = 'hot'").select("a", "b").toLocalIterator():
        own = np.frombuffer(r.a, np.uint64)
        stats[:, np.searchsorted(hot, own)] += np.frombuffer(r.b, np.int64).reshape(4, -1)
    done = words.unionByName(pairs.where("kind = 'goes'")).groupBy("bucket").applyInArrow(_finish_words(folder), _SCHEMA)
    w = sum((unpack_counts(r.d) for r in done.select("d").collect()), np.zeros(6, np.int64)).tolist()
    total = {"tokens": tokens, "words": types, "types": m[4], "big": discounts(m[:4]), "small": discounts(w[:4]), "ones": (w[0], w[1], w[4])}
    out = docs.select("doc_id", text).mapInArrow(_score(folder, n, hot, stats, total), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    out = common.stage(out.withColumn("train_tokens", F.lit(tokens).cast("long")), "lm-scores")
    common.unstage(words), common.unstage(pairs), common.delete(spark, folder)
    return out


def op10_lm_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is also true of a null doc_id, which is never learned from."""
    rest = F.crc32(F.col("doc_id").cast("string")) % 10
    out = score(common.table(spark, sf_dir, "documents"), rest != 0)
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(True)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
