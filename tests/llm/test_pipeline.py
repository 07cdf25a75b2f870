from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tickloom.llm import mixing, pii, simhash, simhash_wide, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def _least_of_components(rows):
    """The smallest doc_id of each component, by comparing all fingerprints."""
    ids = np.array([r.doc_id for r in rows])
    fp = np.frombuffer(b"".join(simhash_wide.fingerprint((r.text or "").encode())[0] for r in rows), np.uint64).reshape(-1, 4)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= simhash_wide.MOST)
    label = simhash.roots(len(rows), [(a, b)])
    return [int(ids[label == c].min()) for c in np.unique(label)]


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for d, n in ids.items() if d not in bad})
    one = stages["simhash_near_dedup"](spark, kept, SF).cache()
    assert Counter(r.doc_id for r in one.collect()) == Counter(_least_of_components(kept.collect()))
    clean = stages["pii"](spark, one, SF).cache()
    tagger = pii.default_tagger()
    text = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        (_, spans), = pii.find(tagger, [text[r.doc_id] or ""])
        assert r.text == (None if text[r.doc_id] is None else pii.redact(text[r.doc_id], spans))
    mixed = stages["mixing"](spark, clean, SF).cache()
    want = {r.doc_id: r.taken for r in mixing.schedule(clean).collect() if r.taken}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(mixing.words()).alias("n")).collect()}
    assert got == want
    assert all(df.columns == corpus_pipeline.COLUMNS for df in (kept, one, clean, mixed))
    pieces = stages["packing"](spark, mixed, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(want)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "one two three", "en", "a", 13), (2, "one two three", "en", "a", 13), (3, "call +1 (555) 010-9999 now", "en", None, 26)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()


def test_near_dedup_keeps_one_row_of_each_component(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c, d, e, f = (" ".join(f"{x}{i * i}" for i in range(60)) for x in "abcdef")
    cases = [
        ([(None, a), (None, b), (None, c)], [(None, a), (None, b), (None, c)]),  # unrelated texts without an id
        ([(5, a), (5, b)], [(5, a), (5, b)]),  # unrelated texts of one id
        ([(2, b), (5, a), (5, b)], [(2, b), (5, a)]),
        ([(1, a), (None, a), (None, b), (None, b), (None, None), (4, "")], [(1, a), (None, b), (4, "")]),
        ([(7, f), (7, f), (8, f), (3, d), (3, e), (None, e), (None, c)], [(7, f), (3, d), (3, e), (None, c)]),
    ]
    near = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    for rows, want in cases:
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
        assert Counter((r.doc_id, r.text) for r in near(spark, docs, SF).collect()) == Counter(want)


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _similar(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def test_near_dedup_takes_five_words_and_0_8(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    random = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    rows, near, far = [], [], []
    for g in range(150):
        words = random.choice(vocabulary, int(random.integers(120, 600)))
        rows.append((2 * g, " ".join(words), "en", "s", 0))
        other = words.copy()
        share = (0.02, 0.12)[g % 2]  # changed words: a similarity of about 0.82 or of 0.36
        at = random.choice(len(words), max(1, int(share * len(words))), replace=False)
        other[at] = [f"x{g}-{i}" for i in range(len(at))]
        rows.append((2 * g + 1, " ".join(other), "en", "s", 0))
        s = _similar(rows[-2][1], rows[-1][1])
        (near if s >= 0.8 else far if s < 0.6 else []).append(2 * g + 1)
    assert len(near) > 40 and len(far) > 60
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert {2 * g for g in range(150)} <= kept and set(far) <= kept
    assert len(kept & set(near)) <= 0.06 * len(near)


def test_wide_pairs_join_what_brute_force_joins():
    random = np.random.default_rng(5)
    base = random.integers(0, 2, (40, 256), dtype=np.uint8)
    bits = base[random.integers(0, 40, 1500)] ^ (random.random((1500, 256)) < random.choice([0.01, 0.06, 0.12], (1500, 1)))
    fp = np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)
    cell = np.sort(random.integers(0, 12, 1500))
    close = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= simhash_wide.MOST) & (cell[:, None] == cell[None])
    want = simhash.roots(1500, [np.nonzero(close)])
    for budget in (50, 1 << 19):
        pairs = list(simhash_wide.close_pairs(fp, cell, np.full(1500, -1), budget=budget))
        assert all(close[i, j].all() for i, j in pairs)
        assert (simhash.roots(1500, pairs) == want).all()
    side = random.integers(0, 2, 1500)
    both = list(simhash_wide.close_pairs(fp, cell, side))
    each = [p for v in (0, 1) for p in [np.nonzero(close & (side[:, None] == v) & (side[None] == v))]]
    assert all(close[i, j].all() for i, j in both) and (simhash.roots(1500, both + each) == want).all()


def test_keys_bring_pairs_together():
    random = np.random.default_rng(6)
    for n in (1000, 10**6):
        bits, tables = simhash_wide.plan(n)
        short = random.integers(0, 2, (400, 128), dtype=np.uint8)
        pairs = np.stack([short, short ^ (random.random((400, 128)) < 0.11).astype(np.uint8)], 1).reshape(-1, 128)
        batch = pa.record_batch([pa.array(np.arange(800)), pa.array([p.tobytes() for p in np.packbits(pairs, axis=1)], pa.binary())], names=["node", "short"])
        keys = np.concatenate([b.column("key").to_numpy() for b in simhash_wide._keys(bits, tables)([batch])]).reshape(400, 2, tables)
        assert (keys[:, 0] == keys[:, 1]).any(axis=1).mean() > 0.9


def test_links_are_few_and_join_the_same(spark):
    random = np.random.default_rng(8)
    raw = [(int(max(p)), int(min(p))) for p in random.integers(0, 400, (900, 2)) if p[0] != p[1]]
    raw += [(int(a), int(b)) for a in range(1000, 2000) for b in random.integers(900, 920, 12)] + raw[:50]  # a group met in twelve tables
    out = [tuple(r) for r in simhash_wide._starred(spark.createDataFrame(raw, "a long, b long")).collect()]
    join = lambda pairs: simhash.roots(2000, [tuple(np.array(pairs).T)]).tolist()
    assert join(out) == join(raw) and all(a > b for a, b in out) and len(out) == len(set(out))
    assert sum(a >= 900 for a, _ in out) <= 1000 + 20 * 20
    assert simhash_wide._starred(spark.createDataFrame([], "a long, b long")).count() == 0
