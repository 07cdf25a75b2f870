"""Substring dedup: a De Bruijn graph of repeated word k-mers, compacted by joins; source coordinates verify what is removed."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .exchange import buckets_of, ordered, pack, unpack
from .textkit import windows, word_hashes

K = 13
#: Share of an exchange's chunk in a chunk here, which carries answers, walks and asks besides its text.
SHARE = 0.55
#: Bytes of what others ask of one chunk that a task verifies, on average.
ASK_BYTES = 2 << 20
_SENT = "bucket int, chunk int, rank int, edges binary"
_ANSWER = "chunk int, bucket int, seen binary, wanted binary, source binary"
_MARKED = "kind string, chunk int, back int, id long, doc_id long, start long, words string, nodes array<long>, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>"


def _hashes(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Edge hashes, of which the high `bits` bits count."""
    return windows(h, k) >> np.uint64(64 - bits) << np.uint64(64 - bits)


def _edges(t: pa.Table, k: int, bits: int):
    """The chunk's documents in order of doc_id (null last), and its edges: hash and word position of each, document of each word."""
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = [x or b"" for x in t.column("text").to_pylist()]
    h, first = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    w = _hashes(h, k, bits)
    at = np.flatnonzero(doc[: len(w)] == doc[k - 1 :]) if len(w) else np.zeros(0, np.int64)
    return t, texts, h, first, doc, w[at], at


def _send(k: int, bits: int, buckets: int):
    """A chunk's distinct edges, one packed sorted array for each bucket of hashes."""

    def run(t: pa.Table) -> pa.Table:
        chunk, rank = t.column("chunk")[0].as_py(), t.column("rank")[0].as_py()
        u = np.unique(_edges(t, k, bits)[5])
        cut = buckets_of(u, buckets)
        full = [b for b in range(buckets) if cut[b] < cut[b + 1]]
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()), "rank": pa.array([rank] * len(full), pa.int32()), "edges": pa.array([pack(u[cut[b] : cut[b + 1]]) for b in full], pa.binary())})

    return run


def _meet(t: pa.Table) -> pa.Table:
    """A bucket's answer to each chunk, for its edges there: seen, whether a chunk of a smaller rank has the edge, and which first (source); wanted, whether the chunk is that first one for another rank."""
    t = t.sort_by([("rank", "ascending"), ("chunk", "ascending")])
    chunks, ranks = t.column("chunk").to_pylist(), np.array(t.column("rank").to_pylist())
    lists = [unpack(b) for b in t.column("edges").to_pylist()]
    sizes = [len(x) for x in lists]
    of = np.repeat(np.arange(len(lists)), sizes)
    _, first, place, n = np.unique(np.concatenate(lists), return_index=True, return_inverse=True, return_counts=True)
    head = of[first][place]  # the list that has the edge first
    seen = ranks[head] < ranks[of]
    later = np.bincount(place[seen], minlength=len(n)) > 0
    wanted = later[place] & (head == of)
    ends = np.cumsum([0, *sizes])
    out = []
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        s, w = seen[a:b], wanted[a:b]
        if s.any() or w.any():
            source = np.array(chunks, np.int32)[head[a:b][s]]
            out.append((chunks[i], np.packbits(s).tobytes(), np.packbits(w).tobytes(), zlib.compress(source.astype("<i4").tobytes(), 1)))
    bucket = t.column("bucket")[0].as_py()
    cols = list(zip(*out)) if out else [()] * 4
    return pa.table({"chunk": pa.array(cols[0], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32())} | {n: pa.array(c, pa.binary()) for n, c in zip(("seen", "wanted", "source"), cols[1:])})


def _runs(mask: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (inclusive) of the stretches of a mask over which each of `same` goes up by one or stays, as given."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = mask[1:] & mask[:-1]
    for x in same:
        joined &= x
    return np.flatnonzero(mask & ~np.concatenate(([False], joined))), np.flatnonzero(mask & ~np.concatenate((joined, [False])))


def _bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _mark(k: int, bits: int, buckets: int, parts: bool = True):
    """A chunk with its answers -> 'doc' rows; and, if `parts`, 'walk' rows, stretches of edges that it holds first, and 'ask' rows, stretches of repeats with the chunk that holds them first.

    An answer of bucket -1 lists edges whose words were found to differ from their source's.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([])
        chunk = docs.column("chunk")[0].as_py()
        docs, texts, h, first, doc, edges, at = _edges(docs, k, bits)
        u, place, inverse = np.unique(edges, return_index=True, return_inverse=True)
        cut = buckets_of(u, buckets)
        seen, wanted, source, denied = np.zeros(len(u), bool), np.zeros(len(u), bool), np.full(len(u), chunk, np.int32), [np.zeros(0, np.uint64)]
        for a in answers.to_pylist():
            b = a["bucket"]
            if b < 0:
                denied.append(unpack(a["seen"]))
                continue
            s = slice(cut[b], cut[b + 1])
            seen[s], wanted[s] = _bits(a["seen"], cut[b + 1] - cut[b]), _bits(a["wanted"], cut[b + 1] - cut[b])
            source[s][seen[s]] = np.frombuffer(zlib.decompress(a["source"]), "<i4")
        ids = docs.column("doc_id").to_pylist()
        order = np.cumsum([0, *(x != y for x, y in zip(ids, ids[1:]))])[doc[at]] if ids else np.zeros(0, np.int64)
        here = order[place][inverse] < order if len(u) else np.zeros(0, bool)  # a smaller id of this chunk has it
        gone = seen[inverse] | here
        own = np.zeros(len(edges), bool)
        own[place] = ~seen & (wanted | (np.bincount(inverse[here], minlength=len(u)) > 0))
        next_word = np.diff(at) == 1 if len(at) else np.zeros(0, bool)
        next_word &= doc[at][1:] == doc[at][:-1]
        rows, split = [], {}

        def words(i: int, j: int) -> str:
            d = doc[at[i]]
            if d not in split:
                split.clear()
                split[d] = texts[d].split()
            return b" ".join(split[d][at[i] - first[d] : at[j] - first[d] + k]).decode()

        if parts:
            nodes = windows(h, k - 1).view(np.int64)
            for n, (i, j) in enumerate(zip(*_runs(own, next_word))):
                d = doc[at[i]]
                rows.append({"kind": "walk", "chunk": chunk, "id": (chunk << 32) + n, "doc_id": ids[d], "start": int(at[i] - first[d]), "words": words(i, j), "nodes": nodes[at[i] : at[j] + 2].tolist()})
            asked = set()
            holder = source[inverse]
            for i, j in zip(*_runs(gone, next_word, holder[1:] == holder[:-1])):
                ask = int(holder[i]), words(i, j)
                if ask not in asked:
                    asked.add(ask)
                    rows.append({"kind": "ask", "chunk": ask[0], "back": chunk, "words": ask[1]})
        if len(denied) > 1:
            gone &= ~np.isin(edges, np.concatenate(denied))
        turn = np.zeros(first[-1] + 1, np.int64)
        np.add.at(turn, at[gone], 1)
        np.add.at(turn, at[gone] + k, -1)
        cover = np.cumsum(turn[:-1]) > 0
        for i, text in enumerate(texts):
            ws, mine = text.split(), cover[first[i] : first[i + 1]]
            a, b = _runs(mine)
            kept = [w for w, x in zip(ws, mine.tolist()) if not x] if len(a) else ws
            rows.append({"kind": "doc", "chunk": chunk, "doc_id": ids[i], "n_words": len(ws), "n_removed": int(mine.sum()), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "starts": a.tolist(), "ends": (b + 1).tolist()})
        return _table(rows)

    return run


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "boolean": pa.bool_()}


def _table(rows: list[dict], schema: str = _MARKED) -> pa.Table:
    return pa.table({n: pa.array([r.get(n) for r in rows], _KINDS[t]) for n, t in (c.split() for c in schema.split(", "))})


def compact(walks: DataFrame, k: int = K) -> DataFrame:
    """The compacted graph of walks: segments (path, chunk, doc_id, start, words), each a stretch of a document's words.

    walks: id, chunk, doc_id, start, words (joined by a space), nodes (a hash of each k - 1
    words); their k-word windows are the edges, all distinct, between these nodes. Nodes with one edge in and one out don't
    branch. Walks are cut at nodes that do, and segments that meet at a node that doesn't are
    joined: `path` names the nonbranching path that a segment is part of.
    """
    ws = F.split("words", " ", -1)
    node = walks.select("id", (F.size("nodes") - 1).alias("last"), F.posexplode("nodes").alias("i", "node"))
    of = Window.partitionBy("node")
    ins, outs = F.sum((F.col("i") > 0).cast("int")).over(of), F.sum((F.col("i") < F.col("last")).cast("int")).over(of)
    degrees = node.withColumn("ins", ins).withColumn("outs", outs)
    marks = degrees.where("ins > 1 OR outs > 1 OR i = 0 OR i = last").select("id", F.struct("i", "node", F.expr("ins = 1 AND outs = 1").alias("through")).alias("mark"))
    cuts = marks.groupBy("id").agg(F.array_sort(F.collect_list("mark")).alias("m"))
    pieces = cuts.select("id", F.explode(F.expr("transform(sequence(1, size(m) - 1), j -> struct(m[j - 1] as a, m[j] as b))")).alias("p"))
    pieces = common.stage(pieces.select("id", "p.a", "p.b", F.concat_ws(":", "id", "p.a.i").alias("piece")), "pieces-of-paths")
    left = pieces.where("b.through").select(F.col("b.node").alias("node"), F.col("piece").alias("a"))
    right = pieces.where("a.through").select(F.col("a.node").alias("node"), F.col("piece").alias("b"))
    labels = common.components(left.join(right, "node").select("a", "b"))
    named = common.again(pieces).join(labels.withColumnRenamed("node", "piece"), "piece", "left")
    cut = named.join(walks.hint("merge"), "id")
    return cut.select(F.coalesce("label", "piece").alias("path"), "chunk", "doc_id", (F.col("start") + F.col("a.i")).alias("start"), F.array_join(F.slice(ws, F.col("a.i") + 1, F.col("b.i") - F.col("a.i") + (k - 1)), " ").alias("words"))


_SPANS = "chunk int, path string, doc_id long, start long, length long, edges binary"


def _verify(k: int, bits: int):
    """A chunk's segments and what others ask of it -> spans (path, source doc_id, start and length in words), and for each asking chunk the edges whose words are not its source's."""

    def run(segments: pa.Table, asks: pa.Table) -> pa.Table:
        seg, own, asked = segments.to_pylist(), segments.column("words").to_pylist(), asks.column("words").to_pylist()
        back = asks.column("back").to_pylist()
        held, first = word_hashes([w.encode() for w in own])
        of = np.repeat(np.arange(len(own)), np.diff(first))
        w = _hashes(held, k, bits)
        at = np.flatnonzero(of[: len(w)] == of[k - 1 :]) if len(w) else np.zeros(0, np.int64)
        order = np.argsort(w[at], kind="stable")
        keys, at = w[at][order], at[order]
        lists = [s.split(" ") for s in own]
        rows, bad = [], {}
        for text, to in zip(asked, back):
            ws = text.split(" ")
            e = _hashes(word_hashes([text.encode()])[0], k, bits)
            i = np.minimum(np.searchsorted(keys, e), max(0, len(keys) - 1))
            found = keys[i] == e if len(keys) else np.zeros(len(e), bool)
            spot = at[i] if len(keys) else np.zeros(len(e), np.int64)
            s = of[spot] if len(keys) else spot
            ok = np.zeros(len(e), bool)
            for x, y in zip(*_runs(found, np.diff(spot) == 1, s[1:] == s[:-1])):
                off = int(spot[x] - first[s[x]])
                if ws[x : y + k] == lists[s[x]][off : off + y - x + k]:
                    ok[x : y + 1] = True
                    rows.append({"chunk": to, "path": seg[s[x]]["path"], "doc_id": seg[s[x]]["doc_id"], "start": seg[s[x]]["start"] + off, "length": int(y - x + k)})
                else:
                    for z in range(x, y + 1):
                        ok[z] = ws[z : z + k] == lists[s[x]][off + z - x : off + z - x + k]
            if not ok.all():
                bad.setdefault(to, []).append(e[~ok])
        rows += [{"chunk": to, "edges": pack(np.unique(np.concatenate(e)))} for to, e in bad.items()]
        return _table(rows, _SPANS)

    return run


def repeated(docs: DataFrame, k: int = K, bits: int = 64) -> DataFrame:
    """Words covered by a window of k words that also starts in a document with a smaller doc_id.

    Edges are the k-word windows of every document, between nodes of k - 1 words. Chunks hold
    documents by rank, which ascends with doc_id, and exchange their distinct edge hashes with
    buckets: those that occur under two doc_ids are the repeated edges, and the chunk that
    holds one first is its source. Of each repeated edge the first occurrence is in one walk;
    the graph of walks is compacted (see compact), and each repeated stretch of a document is
    laid along the segments of the paths at its source, where all its words are compared (a
    chunk of which much is asked is compared in several tasks).
    Windows whose words differ (edges whose hashes collide) are not removed; a collision may
    also hide a repeat. `bits` of the hash count.

    Rows: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space) and
    the spans' starts and ends in words. Null, empty and blank texts have no words; texts
    under k words keep all; rows with equal doc_id don't remove each other's words; a null
    doc_id is larger than any; empty table: no rows; other columns are ignored.
    """
    source, n = ordered(docs.select("doc_id", F.col("text").cast("binary").alias("text")), share=SHARE)
    answers = source.groupBy("chunk").applyInArrow(_send(k, bits, n), _SENT).groupBy("bucket").applyInArrow(_meet, _ANSWER)
    marked = common.stage(source.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_mark(k, bits, n), _MARKED), "marked")
    segments = compact(common.again(marked).where("kind = 'walk'").select("id", "chunk", "doc_id", "start", "words", "nodes"), k)
    asks = marked.where("kind = 'ask'").select("chunk", "back", "words")
    parts = asks.groupBy("chunk").agg(F.ceil(F.sum(F.octet_length("words")) / ASK_BYTES).cast("int").alias("parts"))
    held = segments.join(common.again(parts := common.stage(parts, "ask-parts")), "chunk").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = asks.join(parts, "chunk").withColumn("part", F.expr("cast(pmod(xxhash64(words), parts) as int)"))
    spans = common.stage(held.groupBy("chunk", "part").cogroup(dealt.groupBy("chunk", "part")).applyInArrow(_verify(k, bits), _SPANS), "spans")
    out = marked.where("kind = 'doc'")
    bad = spans.where("edges IS NOT NULL")
    if bad.limit(1).count():
        deny = bad.select("chunk", F.lit(-1).alias("bucket"), F.col("edges").alias("seen"), F.lit(None).cast("binary").alias("wanted"), F.lit(None).cast("binary").alias("source"))
        again = source.groupBy("chunk").cogroup(answers.unionByName(deny).groupBy("chunk")).applyInArrow(_mark(k, bits, n, parts=False), _MARKED)
        chunks = bad.select("chunk").distinct()
        out = out.join(chunks, "chunk", "left_anti").select(marked.columns).unionByName(again.join(chunks, "chunk", "left_semi").select(marked.columns))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
