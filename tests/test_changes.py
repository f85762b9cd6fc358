"""Idempotent requests, authors from the audit log, and trigram pairs against brute force."""

from __future__ import annotations

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import changes, trigrams

REQUEST = "id long, owner_id string, key string, at timestamp, request_hash string"


def at(hours, micros=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours, microseconds=micros)


def results(df):
    return {r.id: (r.result, r.created_by) for r in df.collect()}


def test_requests_before_at_and_after_expiry(spark):
    rows = [(1, "o", "k", at(0), "a"), (2, "o", "k", at(5), "a"), (3, "o", "k", at(6), "b"), (4, "o", "k", at(24), "a"), (5, "o", "k", at(24, 1), "b"), (6, "o", "k", at(30), "a"), (7, "o", "k", at(48, 1), "b"), (8, "o", "k", at(49), "c"), (9, "o", "other", at(1), "z"), (10, "p", "k", at(1), "z")]
    got = results(changes.idempotent(spark.createDataFrame(rows, REQUEST).repartition(3)))
    assert got == {1: ("created", 1), 2: ("replayed", 1), 3: ("conflict", 1), 4: ("replayed", 1), 5: ("created", 5), 6: ("conflict", 5), 7: ("replayed", 5), 8: ("created", 8), 9: ("created", 9), 10: ("created", 10)}


def test_requests_against_a_fold(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("op"), rng.choice("kl"), at(rng.randint(0, 200)), rng.choice("ab")) for i in range(400)]
    want, state = {}, {}
    for i, o, k, t, h in sorted(rows, key=lambda r: (r[3], r[0])):
        if (o, k) not in state or t - state[o, k][0] > datetime.timedelta(hours=24):
            state[o, k] = t, i, h
        _, first, digest = state[o, k]
        want[i] = ("created" if first == i else "replayed" if h == digest else "conflict", first)
    assert results(changes.idempotent(spark.createDataFrame(rows, REQUEST))) == want
    assert changes.idempotent(spark.createDataFrame([], REQUEST)).collect() == []


def test_authors_come_from_the_row_of_the_same_time(spark):
    versions = spark.createDataFrame([(1, 1, at(0)), (1, 2, at(1)), (1, 3, at(2)), (2, 1, at(0)), (3, 2, at(5))], "document_id long, version long, created_at timestamp")
    audit = [(9, 1, at(0), "document_created", "late", None, "{}"), (5, 1, at(0), "document_created", "ann", None, "{}"), (6, 1, at(1), "text_updated", "bob", "token", '{"version": 2}'), (7, 1, at(2), "text_updated", "eve", None, '{"version": 9}'), (8, 2, at(1), "document_created", "no", None, "{}"), (4, 3, at(5), "text_updated", "x", None, "broken")]
    df = spark.createDataFrame(audit, "id long, document_id long, occurred_at timestamp, action string, actor string, actor_via string, detail string")
    out = changes.backfill_authors(versions, df)
    assert {(r.document_id, r.version): (r.author, r.author_via) for r in out.collect()} == {(1, 1): ("ann", "direct"), (1, 2): ("bob", "token"), (1, 3): (None, None), (2, 1): (None, None), (3, 2): (None, None)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def brute(a, b):
    def grams(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]

    x, y = set(grams(a)), grams(b)
    runs = [set(y[i:j]) for i in range(len(y)) for j in range(i + 1, len(y) + 1)]
    return max((len(x & r) / len(x | r) for r in runs), default=0.0)


def test_similar_titles_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["report", "reports", "rule", "rules", "2021", "2022", "plan", "plans", "Müller", "규정", "a", "the"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(3000)}, key=lambda t: t.encode())
    titles = sorted([*rng.sample(titles, 499), "--"], key=lambda t: t.encode())
    both = {(a, b): (brute(a, b), brute(b, a)) for i, a in enumerate(titles) for b in titles[i + 1 :]}
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    for threshold in (0.4, 0.8):
        got = {(r.a, r.b): (r.ab, r.ba) for r in trigrams.similar(df, threshold, key="title").collect()}
        want = {p: v for p, v in both.items() if max(v) >= threshold - 1e-9}
        assert set(got) == set(want) and all(abs(got[p][i] - want[p][i]) < 1e-9 for p in want for i in (0, 1))


def test_margins_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "word"), (5, "words and more")], "id long, title string")
    pairs = trigrams.similar(df, 0.5)
    assert {(r.a, r.b) for r in pairs.collect()} == {(3, 4), (3, 5), (4, 5)}
    row = trigrams.margins(pairs).first()
    assert row.pairs == 3 and row.below == 1 and len(row.percentiles) == 4
    assert [x for x in trigrams.margins(pairs.where(F.lit(False))).first()][:2] == [0, 0]


def test_numbered_titles_equal_brute_force(spark):
    """Titles that differ by a number share most trigrams with all others."""
    titles = [f"Title {i * 37 + 10_000}" for i in range(2_000)]
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = {(r.a, r.b) for r in trigrams.similar(df, 0.8, key="title").collect()}
    some = titles[::100]
    want = {tuple(sorted((a, b))) for a in some for b in titles if a != b and max(brute(a, b), brute(b, a)) >= 0.8 - 1e-9}
    assert {p for p in got if set(p) & set(some)} == want and want


def test_sets_of_trigrams_are_bounded_and_lose_none():
    assert [trigrams.most_shared(n) for n in (2, 9, 12, 40, 300)] == [2, 4, 3, 1, 1]
    assert trigrams.most_shared(13, 11) == 4 and trigrams.most_shared(2, 1) == 1 and trigrams.most_shared(300, 200) == 1
    h = np.arange(1, 8) * 12345
    assert len(set(trigrams.set_keys(h, 3, 5))) == 35 and set(trigrams.set_keys(h, 3, 5)) == set(trigrams.set_keys(h[::-1].copy(), 3, 5))
    assert not set(trigrams.set_keys(h, 3, 5)) & set(trigrams.set_keys(h, 3, 6))
