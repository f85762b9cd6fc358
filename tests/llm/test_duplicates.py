from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm import embeddings, simhash, topk
from docloom.llm.common import connected_components


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(180)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e for e in edges if e[0] != e[1])}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}É" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 200))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1004, "one"), (1005, "İ Σ word\xa0x"), (1006, "z " * 30_000)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")
    got = simhash.near_duplicates(df).toPandas()
    fp = {i: slow_fingerprint(t) for i, t in rows}
    assert len(got) == len(rows)
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in got.itertuples())
    ids = sorted(fp)
    want = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fp[a] ^ fp[b]).bit_count() <= 4])
    assert all(want[r.doc_id] == r.component_id for r in got.itertuples())
    assert len(set(want.values())) < len(ids) - 20
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def vectors(rng):
    x = rng.normal(size=(400, 16))
    near = np.repeat(x[:20], 12, axis=0) + rng.normal(scale=0.08, size=(240, 16))
    return np.concatenate((x, near, x[:5], 3 * x[5:9])).astype(np.float32)


def test_embedding_links_against_brute_force(spark):
    x = vectors(np.random.default_rng(1))
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)] + [(5000, None, "l"), (5001, [0.0] * 16, "l"), (5002, [float("nan")] * 16, "l"), (5003, [None] * 16, "l"), (5004, [], "l")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(range(len(x)), zip(*np.nonzero(near), strict=True))
    assert near.sum() > 1000
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), want[i], want[i] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(5000, 5005))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.05]
    rows = [(1, a), (1, b), (2, a), (3, c), (4, None), (4, None), (5, [2.0, 0.0, 0.0]), (6, [0.0, 0.0, 1.0]), (6, [0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (5, 2, 1, False), (6, 1, 6, True), (6, 1, 6, True)]


def test_planted_pairs_are_found_without_links(spark):
    x = np.random.default_rng(8).normal(size=(900, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = embeddings.unit_vectors(df).withColumn("node", F.xxhash64("unit"))
    plants, pairs = embeddings.planted(nodes, 0.95, 64)
    assert plants.count() == len(pairs) == 64
    own = {r.node: np.array(r.unit) for r in nodes.unionByName(plants, allowMissingColumns=True).collect()}
    assert all(0.95 <= own[a] @ own[b] < 0.96 for a, b in pairs.tolist())
    lists = embeddings.start_lists(nodes.select("node", "unit").unionByName(plants), 900, 8, 8, 1, 0.95)
    assert embeddings.planted_recall(lists, pairs, 0.95) > 0.9
    assert embeddings.planted_recall(lists.limit(0), pairs, 0.95) == 0
    assert all((r.n_links, r.kept) == (0, True) for r in embeddings.near_duplicates(df).collect())


def test_embedding_links_between_saturated_groups(spark):
    rng = np.random.default_rng(4)
    base = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    one, two = base[0], 0.955 * base[0] + (1 - 0.955**2) ** 0.5 * base[1]
    groups = [c + rng.normal(scale=0.004, size=(n, 64)) for c, n in ((one, 1500), (two, 1500), (base[2], 40))]
    x = np.concatenate((*groups, rng.normal(size=(300, 64)))).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[:1500, 1500:3000].any() and near[:1500, :1500].sum(axis=1).min() >= 8
    want = components(range(len(x)), [(0, i) for i in range(1, 3000)] + [(3000, i) for i in range(3001, 3040)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert all((got[i].n_links, got[i].component_id) == (near[i].sum(), want[i]) for i in range(len(x)))


@pytest.mark.parametrize("block, chunk", [(256, 4096), (3, 7)])
def test_cross_links_are_exact(spark, block, chunk):
    x = vectors(np.random.default_rng(6)).astype(np.float64)[:640]
    x /= np.linalg.norm(x, axis=1)[:, None]
    group = [i // 4 * 4 for i in range(len(x))]
    near = x @ x.T >= 0.95
    want = {(min(group[i], group[j]), max(group[i], group[j])) for i, j in zip(*np.nonzero(near), strict=True) if group[i] != group[j]}
    df = spark.createDataFrame([(group[i], i, v.tolist()) for i, v in enumerate(x)], "component long, node long, unit array<double>")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in embeddings.cross_links(df, 0.95, block, chunk).collect()}
    assert got == want and want


def test_audit_sees_missed_pairs(spark):
    rng = np.random.default_rng(8)
    dense = rng.normal(size=16) + rng.normal(scale=0.02, size=(100, 16))
    pairs = np.repeat(rng.normal(size=(50, 16)), 2, axis=0) + rng.normal(scale=0.02, size=(100, 16))
    u = np.concatenate((dense, pairs))
    u /= np.linalg.norm(u, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "node long, unit array<double>")
    only_dense = [(i, 0) for i in range(100)]
    all_parts = only_dense + [(i, i // 2 * 2) for i in range(100, 200)]
    assert embeddings.audit(nodes, spark.createDataFrame(only_dense, "node long, component long"), 0.95, 512) < 0.1
    assert embeddings.audit(nodes, spark.createDataFrame(all_parts, "node long, component long"), 0.95, 512) == 1


def test_embedding_links_where_rounds_end_too_early(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(1500, 16)), 2, axis=0) + rng.normal(scale=0.1, size=(3000, 16))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = components(range(len(x)), zip(*np.nonzero(near), strict=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, k=1, tables=1, rounds=1, most_rounds=1).collect()}
    assert all((got[i].n_links, got[i].component_id) == (near[i].sum(), want[i]) for i in range(len(x)))


def test_top_k_against_brute_force(spark):
    from pyspark.sql import functions as F

    x = vectors(np.random.default_rng(2))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5050, [float("inf")] * 16, 1), (5100, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, query_block=4, row_block=90).collect()}
    z = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = {}
    for q in range(0, len(x), 50):
        s = z @ z[q]
        s[q] = -(2**62)
        for n, i in enumerate(np.lexsort((np.arange(len(s)), -s))[:5]):
            want[(q, n + 1)] = (i, s[i])
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2
