"""Louvain's method against a plain one in memory."""

from __future__ import annotations

import random
from collections import defaultdict
from unittest.mock import MagicMock

import pytest

from docloom.operators import analytics, communities

KARATE = "1-2 1-3 1-4 1-5 1-6 1-7 1-8 1-9 1-11 1-12 1-13 1-14 1-18 1-20 1-22 1-32 2-3 2-4 2-8 2-14 2-18 2-20 2-22 2-31 3-4 3-8 3-9 3-10 3-14 3-28 3-29 3-33 4-8 4-13 4-14 5-7 5-11 6-7 6-11 6-17 7-17 9-31 9-33 9-34 10-34 14-34 15-33 15-34 16-33 16-34 19-33 19-34 20-34 21-33 21-34 23-33 23-34 24-26 24-28 24-30 24-33 24-34 25-26 25-28 25-32 26-32 27-30 27-34 28-34 29-32 29-34 30-33 30-34 31-33 31-34 32-33 32-34 33-34"


def karate():
    return {tuple(map(int, e.split("-"))) for e in KARATE.split()}


def ring_of_cliques(n=12, size=5):
    out = set()
    for c in range(n):
        own = [c * size + i for i in range(size)]
        out |= {(a, b) for a in own for b in own if a < b}
        out.add((own[0], ((c + 1) % n) * size + 1))
    return out


def planted(groups=6, size=25, inside=0.3, outside=0.01):
    rng = random.Random(4)
    n = groups * size
    return {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else outside)}


def q(pairs, of):
    m, inside, tot = len(pairs), 0, defaultdict(int)
    for a, b in pairs:
        inside += of[a] == of[b]
        tot[of[a]] += 1
        tot[of[b]] += 1
    return inside / m - sum(t * t for t in tot.values()) / (4 * m * m)


def plain_louvain(pairs, seed):
    rng = random.Random(seed)
    w = defaultdict(lambda: defaultdict(float))
    for a, b in pairs:
        w[a][b] += 1
        w[b][a] += 1
    top = {n: n for n in w}
    total = sum(sum(x.values()) for x in w.values())
    while True:
        of = {n: n for n in w}
        degree = {n: sum(w[n].values()) for n in w}
        tot, moved_any, moved = dict(degree), False, True
        while moved:
            moved = False
            for n in rng.sample(sorted(w), len(w)):
                k = defaultdict(float)
                for x, v in w[n].items():
                    if x != n:
                        k[of[x]] += v
                tot[of[n]] -= degree[n]
                best = max([of[n], *sorted(k)], key=lambda c: (round(k[c] - degree[n] * tot[c] / total, 9), c == of[n]))
                moved |= best != of[n]
                of[n] = best
                tot[best] += degree[n]
            moved_any |= moved
        if len(set(of.values())) == len(w):
            return top
        top = {n: of[c] for n, c in top.items()}
        new = defaultdict(lambda: defaultdict(float))
        for a in w:
            for b, v in w[a].items():
                new[of[a]][of[b]] += v
        w = new


@pytest.mark.parametrize("graph", [karate, ring_of_cliques, planted])
def test_modularity_reaches_the_plain_method(spark, graph):
    pairs = graph()
    edges = spark.createDataFrame([p if i % 2 else p[::-1] for i, p in enumerate(sorted(pairs))] + sorted(pairs)[:3] + [(7, 7)], "a long, b long")
    found = communities.louvain(edges)
    of = {r.node: r.community for r in found.collect()}
    assert set(of) == {n for p in pairs for n in p}
    assert all(c == min(n for n in of if of[n] == c) for c in of.values())
    best = max(q(pairs, plain_louvain(pairs, s)) for s in range(5))
    assert q(pairs, of) >= 0.99 * best, (q(pairs, of), best)
    assert abs(communities.modularity(edges, found) - q(pairs, of)) < 1e-9


def test_graphs_without_communities(spark):
    assert communities.louvain(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []
    two = communities.louvain(spark.createDataFrame([("x", "y"), ("y", "x"), ("u", "v")], "a string, b string"))
    assert {r.node: r.community for r in two.collect()} == {"x": "x", "y": "x", "u": "u", "v": "u"}


def test_a_level_that_does_not_settle_raises(spark):
    edges = spark.createDataFrame(sorted(karate()), "a long, b long")
    with pytest.raises(RuntimeError):
        communities.louvain(edges, most_rounds=2)


def test_names(spark):
    docs = spark.createDataFrame([(1, "b", ["x"]), (2, "a", ["x", "y"]), (3, "c", []), (4, "hub", ["y"]), (5, "d", []), (6, "미분류", []), (7, "미분류", []), (8, "z", ["기타"]), (9, "y", ["기타"]), (10, "lone", ["q"])], "id long, title string, tags array<string>")
    assigned = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 8)], "node long, community long")
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 5), (4, 3), (5, 8), (5, 9), (6, 7), (8, 9)], "src long, dst long")
    got = {r.community: (r.name, r.kind, r.size) for r in analytics.cluster_names(docs, assigned, edges).collect()}
    assert got == {1: ("x", "tagged", 2), 3: ("hub", "community", 3), 6: ("미분류 (문서)", "community", 2), 8: ("기타 (태그)", "tagged", 2)}


def test_a_level_may_need_many_rounds(monkeypatch):
    """Graphs of some thousand nodes have levels of over 200 rounds; modularity still grows in each."""
    done = []
    monkeypatch.setattr(communities, "cut_lineage", lambda df: df)
    monkeypatch.setattr(communities, "moves", lambda level, labels, number, resolution: done.append(number) or labels)
    monkeypatch.setattr(communities, "_modularity", lambda level, marked, resolution: (len(done) / 1000, 250 - len(done)))
    _, reached = communities.settle(MagicMock(), MagicMock(), 1.0)
    assert len(done) == 250 and reached == 0.25


def test_a_level_that_fits_a_task_needs_no_jobs_for_its_rounds(spark, monkeypatch):
    """Hundreds of rounds of small jobs took ten minutes over a graph of 1 GB."""
    monkeypatch.setattr(communities, "moves", lambda *a: pytest.fail("a round as jobs"))
    pairs = karate()
    of = {r.node: r.community for r in communities.louvain(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert q(pairs, of) > 0.4


def string_names():
    return {(f"é{a}", f"z{b}") for a, b in planted(groups=3, size=10)} | {("lone", "pair")}


@pytest.mark.parametrize(("graph", "kind", "resolution"), [(karate, "bigint", 0.7), (string_names, "string", 1.3), (lambda: {(1, 2)}, "int", 1.0)])
def test_one_task_settles_as_all_tasks_do(spark, monkeypatch, graph, kind, resolution):
    edges = spark.createDataFrame(sorted(graph()), f"a {kind}, b {kind}")
    one = communities.louvain(edges, resolution)
    assert dict(one.dtypes) == {"node": kind, "community": kind}
    monkeypatch.setattr(communities, "TASK_ROWS", 0)
    assert sorted(one.collect()) == sorted(communities.louvain(edges, resolution).collect())


def test_one_task_settles_contracted_levels(spark):
    """Weights, loops and a node without edges; from a start that has communities already."""
    nodes = spark.createDataFrame([(1, 8.0, 4.0), (2, 6.0, 2.0), (3, 9.0, 0.0), (4, 3.0, 0.0), (5, 2.0, 2.0)], "node long, d double, loop double")
    half = [(1, 2, 1.0), (1, 3, 3.0), (2, 3, 3.0), (3, 4, 3.0)]
    edges = spark.createDataFrame(half + [(b, a, w) for a, b, w in half], "a long, b long, w double")
    level = communities.Level(nodes, edges, 28.0)
    start = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "node long, community long")
    (one, q_one), (every, q_all) = (f(level, start, 1.0) for f in (communities.settle_in_a_task, communities.settle))
    assert sorted(one.collect()) == sorted(every.collect()) and abs(q_one - q_all) < 1e-12
