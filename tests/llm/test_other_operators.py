import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common, embeddings, topk, warc

VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 32)).astype(np.float32)
    x[100:200] = x[:100] + r.normal(0, 0.12, (100, 32)).astype(np.float32)
    x[200:230] = x[5]
    x[230:260] = x[6] + r.normal(0, 0.05, (30, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0), (904, [], 0), (905, [float("inf")] + [1.0] * 31, 0), (7, x[7].tolist(), 0), (None, x[8].tolist(), 1), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as rep", "2 as n", "3 as key", "4 as code")


def brute(rows, least=0.9):
    ok = [i for i, r in enumerate(rows) if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding) and r.vec_id is not None]
    links = {i: set() for i in range(len(rows))}
    for a, i in enumerate(ok):
        u = np.array(rows[i].embedding, float)
        for j in ok[:a]:
            v = np.array(rows[j].embedding, float)
            if len(u) == len(v) and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= least:
                links[i].add(j), links[j].add(i)
    return links


def test_embeddings(spark, vectors, monkeypatch):
    rows = vectors.collect()
    want = brute(rows)
    for cell in (512, 8):
        monkeypatch.setattr(embeddings, "CELL", cell)
        got = embeddings.near(vectors).collect()
        assert len(got) == len(rows)
        n = {r.vec_id: r.n_links for r in got}
        brute_n = {r.vec_id: len(want[i]) for i, r in enumerate(rows)}
        assert all(n[k] <= brute_n[k] for k in n)  # nothing below the threshold
        assert sum(n.values()) >= 0.97 * sum(brute_n.values())
        comp = {r.vec_id: r.component_id for r in got}
        assert all(comp[i] == 5 for i in range(200, 230)) and comp[907] == 906 and comp[901] == 901
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near(spark.createDataFrame([], VECTORS)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 64))
    x[150:] = x[:150] + 0.3 * r.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    up = embeddings.Codes(x).upper(slice(None), slice(None))
    assert (up >= x @ x.T).mean() > 0.999


def test_topk(spark, vectors, monkeypatch):
    codes = topk.sign_codes(vectors)
    data = [(r.vec_id, r.code % 2**64) for r in codes.distinct().collect()]
    queries = codes.where("vec_id % 7 = 0").distinct().select(F.col("vec_id").alias("query_id"), "code")
    want = {q: sorted(((c ^ d).bit_count(), i) for i, d in data)[:10] for q, c in data if q % 7 == 0}
    for shard, block in ((1 << 15, 1 << 10), (50, 8)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "BLOCK", block)
        got: dict = {}
        for r in topk.search(codes, queries).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
        assert got == want
    assert topk.search(codes.limit(0), queries).count() == 0
    assert topk.search(codes.where("vec_id < 3"), queries).count() == 3 * len(want)


def test_warc(spark):
    rows = [(i, f"u{i}" if i % 9 else None, f"<p>{i}</p>" * (i % 5 + 1) if i % 13 else None) for i in range(3000)]
    rows += [rows[4], rows[4], (None, "u", "lost id"), (5000, "u", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as node", "2 as hash")
    other = [r for r in rows if r[0] not in (17, 2999)]
    other[100] = (other[100][0], "changed", "x")
    replica = spark.createDataFrame([*other, (9999, "new", "page")], "page_id long, url string, html string")
    got = {r.page_id: r.state for r in warc.audit(pages, replica).collect()}
    assert got == {17: "missing", 2999: "missing", other[100][0]: "changed", 9999: "extra"}
    assert warc.audit(pages, pages).count() == 0
    none = pages.limit(0)
    assert warc.audit(none, none).count() == 0
    assert {r.state for r in warc.audit(pages, none).select("state").collect()} == {"missing"}
    filed = warc.offsets(warc.records(pages)).orderBy("file", "offset").collect()
    at = {}
    for r in filed:
        assert r.offset == at.get(r.file, 0)
        at[r.file] = r.offset + r.length


def test_components(spark):
    r = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_topk_repeated_query_rows(spark, tmp_path):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=64).tolist(), 0) for i in range(120)]
    rows += [rows[50]] * 12 + [rows[100]] * 3 + [rows[7]] * 2
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    code = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v, _ in rows}
    want = {(q, k + 1, i, d) for q in (0, 50, 100) for k, (d, i) in enumerate(sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items())[:10])}
    got = [tuple(x) for x in topk.op9_topk_multi_index(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_warc_reports_every_record_of_an_id(spark):
    schema = "page_id long, url string, html string"
    rows = [(i, "u", f"page {i}") for i in range(40)] + [(3, "u", f"other {i}") for i in range(6)]
    pages = [*rows, *[(8, "u", "twin")] * 4, (None, "u", "kept")]
    lost = [*rows[:40], *[(3, "u", f"new {i}") for i in range(2)], (8, "u", "twin"), (None, "u", "kept"), *[(None, "u", f"extra {i}") for i in range(5)], *[(9, "v", "double")] * 2]
    digest = lambda url, html: hashlib.sha256(f"{url}\r\n\r\n{html}".encode()).hexdigest()
    got = warc.audit(spark.createDataFrame(pages, schema), spark.createDataFrame(lost, schema)).collect()
    assert Counter((r.page_id, r.state) for r in got) == {(3, "changed"): 2, (3, "missing"): 4, (8, "missing"): 3, (-1, "extra"): 5, (9, "extra"): 2}
    assert Counter(r.digest for r in got if r.page_id == 3) == Counter(digest("u", f"other {i}") for i in range(6))
    assert Counter(r.replica_digest for r in got if r.replica_digest) == Counter(digest(u, h) for i, u, h in lost if h.split()[0] in ("new", "extra", "double"))
    offsets = {(r.page_id, r.digest, r.offset) for r in warc.offsets(warc.records(spark.createDataFrame(pages, schema))).collect()}
    mine = [(r.page_id, r.digest, r.offset) for r in got if r.digest]
    assert len(set(mine)) == len(mine) and set(mine) <= offsets


def test_codes_refuse_longer_vectors(spark):
    wide = spark.createDataFrame([(1, [1.0] * 64, 0), (2, [1.0] * 65, 0)], VECTORS)
    assert topk.sign_codes(wide.where("vec_id = 1")).first().code == -1
    with pytest.raises(Exception, match="over 64 components"):
        topk.sign_codes(wide).collect()
