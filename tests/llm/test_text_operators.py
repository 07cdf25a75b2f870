import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import exchange, lm, mixing, packing, pii, simhash, substring, textkit, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows(docs):
    return [(r.doc_id, r.text or "", r.source) for r in docs.select("doc_id", "text", "source").collect()]


@given(st.lists(st.text(alphabet="aB é\t\n\x1c x", max_size=30), max_size=6))
@settings(max_examples=60, deadline=None)
def test_word_hashes(texts):
    h, first = textkit.word_hashes([t.encode() for t in texts], block=8)
    words = [WORD.findall(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50, unique=True))
@settings(max_examples=60, deadline=None)
def test_packed_arrays(xs):
    u = np.unique(np.array(xs, np.uint64))
    assert exchange.unpack(exchange.pack(u)).tolist() == u.tolist()
    assert exchange.unpack_counts(exchange.pack_counts(np.array(xs, np.uint64))).tolist() == [int(np.uint64(x).astype(np.int64)) for x in xs]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_simhash(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.dedup(docs).collect()
    data = rows(docs)
    fps = {f: None for _, t, _ in data for f in [brute_simhash(t)]}
    labels = {f: f for f in fps}
    ids = defaultdict(list)
    for d, t, _ in data:
        if d is not None:
            ids[brute_simhash(t)].append(d)
    known, todo = {}, set(fps)
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            f = edge.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 3}
            todo -= near
            edge += near
        low = min((i for f in group for i in ids[f]), default=None)
        known |= dict.fromkeys(group, low)
    want = sorted(((d, brute_simhash(t), known[brute_simhash(t)]) for d, t, _ in data), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == want
    assert simhash.dedup(empty).count() == 0
    assert labels


def test_simhash_cells_cover_all_links(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = int(r.integers(0, 2**63))
    fps = sorted({base ^ sum(1 << int(b) for b in r.choice(64, 2)) for _ in range(300)} | {int(x) for x in r.integers(0, 2**63, 50)})
    monkeypatch.setattr(simhash, "CELL", 16)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for e in simhash.links(df).collect():
        a, b = find(e.a % 2**64), find(e.b % 2**64)
        root[a] = b
    for i, f in enumerate(fps):
        assert all(find(f) == find(g) for g in fps[:i] if (f ^ g).bit_count() <= 3)


def test_substring(docs, empty, monkeypatch):
    data = sorted([(d, WORD.findall(t)) for d, t, _ in rows(docs)], key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for d, w in data:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = []
    for d, w in data:
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] != d:
                gone.update(range(i, i + 13))
        kept = [x for i, x in enumerate(w) if i not in gone]
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    for size in (exchange.CHUNK_BYTES, 20_000):
        monkeypatch.setattr(exchange, "CHUNK_BYTES", size)
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated(docs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.repeated(empty).count() == 0


def brute_kn(train, texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    pairs, follow = Counter(), defaultdict(set)
    for w in train:
        for u, v in zip(["<s>", *w], [*w, "</s>"]):
            pairs[u, v] += 1
    for u, v in pairs:
        follow[v].add(u)
    d = [0, *lm.discounts([sum(c == n for c in pairs.values()) for n in (1, 2, 3, 4)])]
    cont = {v: len(us) for v, us in follow.items()}
    e = [0, *lm.discounts([sum(c == n for c in cont.values()) for n in (1, 2, 3, 4)])]
    total, vocab = sum(cont.values()), len(cont)
    spare = sum(e[min(c, 3)] for c in cont.values()) / total
    ctx = defaultdict(list)
    for (u, _), c in pairs.items():
        ctx[u].append(c)

    def p(u, v):
        low = max(cont.get(v, 0) - e[min(cont.get(v, 0), 3)], 0) / total + spare / (vocab + 1)
        if u not in ctx:
            return low
        c = pairs.get((u, v), 0)
        return (c - d[min(c, 3)]) / sum(ctx[u]) + sum(d[min(x, 3)] for x in ctx[u]) / sum(ctx[u]) * low

    assert abs(sum(p("<s>", v) for v in cont) + p("<s>", "never seen") - 1) < 1e-9
    return [sum(math.log10(p(u, v)) for u, v in zip(["<s>", *w], [*w, "</s>"])) for w in texts]


def test_lm(docs, empty, monkeypatch):
    data = [(d, WORD.findall(lower(t))) for d, t, _ in rows(docs)]
    learn = [w for d, w in data if d is not None and zlib.crc32(str(d).encode()) % 10]
    c = Counter(x for w in learn for x in [*w, None])
    n, v = sum(c.values()), len(c)
    kn = brute_kn(learn, [w for _, w in data])
    want = sorted(((d, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]), s) for (d, w), s in zip(data, kn)), key=lambda r: (str(r[0]), r[1]))
    for size in (exchange.CHUNK_BYTES, 30_000):
        monkeypatch.setattr(exchange, "CHUNK_BYTES", size)
        out = lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()), key=lambda r: (str(r[0]), r[1]))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)
    assert lm.score(empty, F.lit(True)).count() == 0
    assert all(math.isfinite(r.score) for r in lm.score(docs, F.lit(False)).collect())


def test_packing(docs, empty, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "SHARD", 100)
    pieces = packing.pack(docs, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for d, t, _ in rows(docs):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = {(p.start, p.length, p.ids_crc32) for p in by_doc[d]}
        assert {(s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)} == own
    assert len(pieces) == sum(-(-p.doc_tokens // 4096) for p in pieces if p.start == 0)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_finds_the_tightest(sizes):
    bins, room = packing.Bins(64), {}
    for n in sorted(sizes, reverse=True):
        fits = [r for r in room.values() if r >= n]
        b, at = bins.place(n)
        assert at == 64 - room.get(b, 64)
        assert room.get(b, 64) == (min(fits) if fits else 64)
        room[b] = room.get(b, 64) - n


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ <|endoftext|> x<|startoftext|>y", "it's 'sam !'s éa É ﬁ ½ a\x1cb a\x85b a\xa0b", "日本語 テスト abc123 12.5", "Ünï ªº ß ẞ Ĳ"])
def test_chunked_encoding(text):
    public = pytest.importorskip("public_tokenizers")
    enc = packing.Encoder(public.path("word_bpe_49k.json"), chunks=2)
    for _ in range(2):
        assert enc.encode([text.encode()])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def test_encoding_costs_no_call_a_chunk():
    public = pytest.importorskip("public_tokenizers")
    enc = packing.Encoder(public.path("word_bpe_49k.json"))
    stems = [a + b + c for a in ("ta", "né", "or") for b in ("lin", "su", "ßa") for c in ("", "et", "ão")]
    marks = [a + b for a in ("", "(", '"', "[", "-", "$", "¡") for b in ("", ".", ",", ";", ":", "!", "?", ")", "...", "'s", "'LL", "-", "%", "***")]
    chunks = [m.replace("'", f"{w}'") if "'" in m else m[:1] + w + m[1:] for w in [f(t) for t in stems for f in (str, str.title, str.upper)] for m in marks]
    text, calls = "\n".join(chunks), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = enc.encode([text.encode()])[0]
    finally:
        sys.setprofile(None)
    assert got.tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert calls < len(set(chunks)) / 2


def test_encoding_of_every_plain_letter_and_mark():
    public = pytest.importorskip("public_tokenizers")
    enc, r = packing.Encoder(public.path("word_bpe_49k.json")), np.random.default_rng(3)
    odd = ["'", "'s", "'S", "'ll", "'Re", "'ve", "'d", "'m", "'t", "'l", "'v", " ", "\n", "\x0b", "\x1c", "a", "É", "1", "²", ".", "<", "|", "<|endoftext|>", "日", "\u0301", "Ⱥ", "ﬁ", "Σ"]
    texts = [f"ab{chr(c)}Cd{chr(c)}{chr(c)}1{chr(c)}'s {chr(c)}" for c in range(0x300)] + ["".join(r.choice(odd, int(r.integers(0, 12)))) for _ in range(2000)]
    for text, ids in zip(texts, enc.encode([t.encode() for t in texts])):
        assert ids.tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("group", [1, 300, 1 << 30])
def test_pieces_of_groups(texts, group, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "GROUP", group)
    path = public.path("word_bpe_49k.json")
    few = [*texts[:40], None, "", " \n", "x " * 200]
    batch = pa.record_batch([pa.array([None, *range(1, len(few))], pa.int64()), pa.array([t and t.encode() for t in few], pa.binary())], names=["doc_id", "text"])
    want = []
    for i, t in enumerate(few):
        ids = np.array([*packing._encoder(path).tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i or None, s, len(ids[s : s + 16]), zlib.crc32(ids[s : s + 16].tobytes()), len(ids)) for s in range(0, len(ids), 16)]
    assert [tuple(r.values()) for b in packing._cut(path, 16, 2)([batch, batch.slice(0, 0)]) for r in b.to_pylist()] == want


def test_mixing(docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT", 7)
    got = mixing.in_order(mixing.schedule(docs)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect())
    size, take, target = Counter(), Counter(), {}
    for r in got:
        n = r.size
        assert 0 <= r.taken <= 2 * n and r.taken == r.copies * n + r.part
        size[r.source] += n
        take[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in got)
    weights = dict(zip(sorted(target, key=lambda s: (s is None, s or "")), (3, 1, 2, 3, 1, 2)))
    want, left, free = {}, 1.5 * sum(size.values()), set(target)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weights[s] for s in free}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    assert all(abs(want[s] - target[s]) < 1e-6 and 0 <= want[s] - take[s] < 1 for s in target)
    times = [r.finish for r in got if r.finish is not None]
    assert times == sorted(times)
    assert mixing.schedule(empty).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.97, 1.5])
def test_mixing_texts(docs, empty, monkeypatch, share):
    monkeypatch.setattr(mixing, "SLOT", 7)
    # rows that repeat an id may share what is left; all others are taken as scheduled
    want = {(r.doc_id, r.source, r.size): (r.copies, r.part) for r in mixing.schedule(docs, share=share).collect() if r.taken and r.doc_id != 3}
    rows = [r for r in mixing.take(docs, ["doc_id", "text", "source"], share=share).collect() if r.doc_id != 3]
    assert {(r.doc_id, r.source, len(WORD.findall(r.text))): (r.copies, r.part) for r in rows} == want and len(rows) == len(want)
    assert mixing.take(empty, ["doc_id", "text", "source"]).count() == 0


def test_mixing_ties_at_the_end(spark):
    same = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a", "y")], "doc_id long, text string, source string")
    got = mixing.take(same, ["doc_id", "text", "source"], share=0.5).collect()
    scheduled = {r.source: r.t for r in mixing.schedule(same, share=0.5).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * len(r.text.split()) + r.part
    assert len({(r.copies, r.part) for r in got if r.doc_id == 1}) == 1
    assert all(0 <= scheduled[s] - taken[s] < 3 for s in scheduled)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="ab124.@-+ ()%", max_size=70))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii(docs, empty):
    model = pii.default_tagger()
    texts, spans = pii.labelled(300, seed=77)
    found = model.decode(pii.encode(texts, pii.WIDTH))
    gold = np.zeros_like(found)
    for row, own in zip(gold, spans):
        for kind, a, b in own:
            row[a:b] = 1 + pii.KINDS.index(kind)
    assert ((found[gold > 0] + 1) // 2 == gold[gold > 0]).mean() > 0.85
    assert (found[gold == 0] == 0).mean() > 0.97
    assert pii.detect(docs, model).count() == docs.count()
    assert pii.detect(empty, model).count() == 0
    text = "x" * 500 + " a.b@c.example.org, call +1 (555) 010-9999 " + "y 9" * 200 + " from 10.0.0.1"
    (base, both), = pii.find(model, [text])
    assert [k for k, _, _ in base] == ["email", "ip", "phone"] and set(base) <= set(both)
    assert pii.redact(text, base).count("[") == 3


def test_pii_gradients():
    model = pii.Tagger.fresh(hidden=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, 100, (3, 7)).astype(np.uint8), r.integers(0, pii.TAGS, (3, 7))
    _, g = model.step(ids, tags)
    for k in model.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        model.p[k][at] += 1e-2
        up = model.step(ids, tags)[0]
        model.p[k][at] -= 2e-2
        down = model.step(ids, tags)[0]
        model.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-2 * max(1, abs(g[k][at]))


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(2)
    words = ["plain", "word", "other", "thing", "sky", "tree", "house"]
    data, labels = [], []
    for i in range(1200):
        insult, group = r.random() < 0.4, r.random() < 0.4
        w = list(r.choice(words, 30)) + ["fool"] * insult + ["they"] * group
        data.append((i, " ".join(r.permutation(w)), "en", "a", 0))
        labels.append((i, 0, int(insult and group)))
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None), (5, 0, labels[5][2])], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    got = {x.doc_id: x.score for x in toxicity.score(table, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == labels[i][2] for i in held]) > 0.98
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and out.where("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, marks)).count() == 0
