"""Cases that a cap, a cut of ids, a collision or a hot key would get wrong, and what the methods add."""

import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import embeddings, exchange, lm, mixing, packing, pii, substring, toxicity, warc

TEXTS = "doc_id long, text string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def removed(rows, k=13):
    first, out = {}, Counter()
    data = sorted(((d, WORD.findall(t)) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    for d, w in data:
        for i in range(len(w) - k + 1):
            first.setdefault(tuple(w[i : i + k]), d)
    for d, w in data:
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] != d for j in range(i, i + k)}
        out[d, len(w), len(gone)] += 1
    return out


def prose(r, n):
    return " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))


def test_substring_far_and_hot_ids(spark, monkeypatch):
    r = np.random.default_rng(6)
    shared = prose(r, 40)
    rows = [(i, prose(r, 30) + " " + shared * (i % 3 == 0)) for i in range(60)]
    rows += [(-(2**63), shared), (2**63 - 1, shared), (10**15, prose(r, 50))] + [(None, prose(r, 20) + " " + shared) for _ in range(40)] + [(7, prose(r, 30)) for _ in range(40)]
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 1500)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], TEXTS)
    chunked, n = exchange.ordered(docs.select("doc_id", "text"))
    sizes = [x.b for x in chunked.groupBy("chunk").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert n > 8 and max(sizes) < 6 * 1500  # no id, near or far, hot or null, takes one chunk
    got = Counter((x.doc_id, x.n_words, x.n_removed) for x in substring.repeated(docs).collect())
    assert got == removed(rows)


def test_substring_collisions_are_not_removed(spark):
    r = np.random.default_rng(7)
    copy = prose(r, 60)
    rows = [(i, prose(r, 60), "s") for i in range(20)] + [(30, copy, "s"), (31, copy, "s")]
    docs = spark.createDataFrame(rows, TEXTS)
    got = {x.doc_id: x.n_removed for x in substring.repeated(docs, bits=9).collect()}  # 960 edges on 512 hashes
    want = {d: n for d, _, n in removed([(i, t) for i, t, _ in rows])}
    assert all(got[i] == 0 for i in range(20)) and got[31] <= want[31] == 60


def test_paths_of_the_graph(spark):
    a, b, c = ([f"{x}{i}" for i in range(20)] for x in "abc")
    walks = [(1, 0, 1, 0, a + b), (2, 0, 2, 0, a[-12:] + c)]  # both leave the node of a's last 12 words
    rows = []
    for i, chunk, d, s, w in walks:
        nodes = [hash(tuple(w[j : j + 12])) for j in range(len(w) - 11)]
        rows.append((i, chunk, d, s, " ".join(w), nodes))
    got = substring.compact(spark.createDataFrame(rows, "id long, chunk int, doc_id long, start long, words string, nodes array<long>")).collect()
    assert Counter((x.doc_id, x.start, x.words) for x in got) == Counter([(1, 0, " ".join(a)), (1, 8, " ".join(a[8:] + b)), (2, 0, " ".join(a[-12:] + c))])
    joined = [(5, 0, 5, 0, a + b[:1]), (6, 1, 6, 3, a[-11:] + b[:8])]  # the second goes on where the first ends
    rows = [(i, h, d, s, " ".join(w), [hash(tuple(w[j : j + 12])) for j in range(len(w) - 11)]) for i, h, d, s, w in joined]
    paths = substring.compact(spark.createDataFrame(rows, "id long, chunk int, doc_id long, start long, words string, nodes array<long>")).collect()
    assert len(paths) == 2 and len({x.path for x in paths}) == 1


def test_interaction_that_no_linear_weight_sees(spark):
    r = np.random.default_rng(2)
    docs, y = [], []
    terms = toxicity.Terms()
    for _ in range(2500):
        a, b = (bool(x < 0.5) for x in r.random(2))
        words = list(r.choice([f"w{i}" for i in range(300)], 25)) + ["fool"] * a + ["they"] * b
        docs.append(terms(" ".join(words).encode()))
        y.append(int(a != b))
    y = np.array(y)
    model = toxicity.fit(docs[:2000], y[:2000])
    assert ((model.score(docs[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    linear = toxicity.Machine(model.w0, model.w, np.zeros_like(model.v))
    assert ((linear.score(docs[2000:]) >= 0.5) == y[2000:]).mean() < 0.8
    again = sum(model.w[t] for t in docs[0]) + model.w0 + sum(model.v[s] @ model.v[t] for i, s in enumerate(docs[0]) for t in docs[0][:i] if model.w[s] and model.w[t])
    assert abs(model.score(docs[:1])[0] - 1 / (1 + np.exp(-np.clip(again, -30, 30)))) < 1e-9


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "copy of a text", "s")] * 500 + [(i, f"text {i}", "s") for i in range(2, 40)], TEXTS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda d, y: seen.append(len(d)) or toxicity.Machine(0.0, np.zeros(2), np.zeros((2, 1))))
    toxicity.train(docs, labels, rows=4)
    assert seen == [4]


def test_viterbi_is_the_best_sequence():
    r = np.random.default_rng(1)
    model = pii.Tagger.fresh(hidden=2)
    model.p["t"] = r.normal(size=model.p["t"].shape).astype(np.float32)
    e = r.normal(size=(4, 2, pii.TAGS)).astype(np.float32)
    got = model.best(e, np.array([4, 3]))
    for n, length in ((0, 4), (1, 3)):
        total = lambda s: sum(e[i, n, x] for i, x in enumerate(s)) + model.p["s"][s[0]] + sum(model.p["t"][a, b] for a, b in zip(s, s[1:]))
        best = max(product(range(pii.TAGS), repeat=length), key=total)
        assert tuple(got[n, :length]) == best


def test_tagger_adds_spans_that_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = pii.fit_tagger(docs)
    r = np.random.default_rng(9)
    carriers = [x.text[:300] for x in docs.where("length(text) > 300").limit(150).collect()]
    hit = planted = extra = 0
    for text in carriers:
        kind, item = pii.made(r)
        while kind is None or pii.base_spans(f" {item} "):
            kind, item = pii.made(r)
        whole = text[:150] + " " + item + " " + text[150:]
        (base, both), = pii.find(model, [whole])
        added = [s for s in both if s not in base]
        planted += 1
        near = [s for s in added if s[0] == kind and s[1] < 151 + len(item) and s[2] > 151]
        hit += bool(near)
        extra += len(added) - len(near)
    print(f"tagger: {hit} of {planted} variants found, {extra} other spans added")
    assert hit > 0.3 * planted and extra < 0.2 * planted


@pytest.mark.parametrize("dim", [64, 128, 256, 768])
def test_recall_at_the_threshold(dim):
    made, joined = embeddings.tables(dim, 10_000, 0.9)
    r = np.random.default_rng(dim)
    x = r.normal(size=(400, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1)[:, None]
    met = np.zeros(400, bool)
    for t in range(made):
        same = np.ones(400, bool)
        for j in range(joined):
            q = embeddings.rotation(dim, 1 + t * joined + j)
            u, v = x @ q, y @ q
            a, b = np.abs(u).argmax(1), np.abs(v).argmax(1)
            same &= (a == b) & (np.sign(u[range(400), a]) == np.sign(v[range(400), b]))
        met |= same
    assert met.mean() >= 0.93


def test_hot_pieces_are_dealt(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "SHARD", 20)
    got = packing.pack(spark.createDataFrame([(None, "same text", "s")] * 200, TEXTS), public.path("word_bpe_49k.json")).collect()
    assert len(got) == 200 and len({x.sequence_id for x in got}) > 4


def test_lm_hot_contexts(spark, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 2000)
    r = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(x for _ in range(40) for x in ("the", f"w{r.integers(400)}")), "s") for i in range(80)], TEXTS)
    split = {x.doc_id: (x.n_known, x.score) for x in lm.score(docs, F.lit(True)).collect()}
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 8 << 20)
    whole = {x.doc_id: (x.n_known, x.score) for x in lm.score(docs, F.lit(True)).collect()}
    assert split.keys() == whole.keys() and all(split[i][0] == whole[i][0] and abs(split[i][1] - whole[i][1]) < 1e-6 for i in whole)


def test_warc_keys_below_and_above_zero(spark):
    schema = "page_id long, url string, html string"
    rows = [(i, "u", f"page {i}") for i in [*range(-40, 40), 2**60, -(2**60), 2**53 + 1]]
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(i, u, "changed" if i in (-3, 2**53 + 1) else h) for i, u, h in rows], schema)
    assert {(x.page_id, x.state) for x in warc.audit(a, b).collect()} == {(-3, "changed"), (2**53 + 1, "changed")}


def test_mixing_follows_from_finish_times(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(90)], TEXTS)
    for x in mixing.schedule(docs).collect():
        period = x.source_size / x.target
        assert x.copies == (sum(x.finish + p * period <= 1 + 1e-12 for p in range(2)) if x.size else 0)
