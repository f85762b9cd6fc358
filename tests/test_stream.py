"""The stateful change stream against the batch derivation."""

from __future__ import annotations

import random
from unittest.mock import MagicMock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.streaming import changes

SNAPSHOT = "id long, version int, content string, content_hash string, extraction_status string, at_s long"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", changes.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def snapshots(spark, rows):
    return spark.createDataFrame(rows, SNAPSHOT).withColumn("at", F.timestamp_seconds("at_s")).drop("at_s")


def run(spark, folder, batches, stored=None, jobs=()):
    """Feed batches of snapshots one after the other; jobs: (batch number, rows of ended jobs (document_id, kind, at_s))."""
    ended = dict(jobs)
    for i, rows in enumerate(batches):
        snapshots(spark, rows).write.mode("append").parquet(f"{folder}/in")
        own = spark.createDataFrame(ended.get(i, []), "document_id long, kind string, at_s long").withColumn("at", F.timestamp_seconds("at_s")).drop("at_s")
        own.write.mode("append").parquet(f"{folder}/jobs")
        source = spark.readStream.schema(snapshots(spark, []).schema).parquet(f"{folder}/in")
        jobs_source = spark.readStream.schema(own.schema).parquet(f"{folder}/jobs")
        changes.start(changes.events(source, jobs_source), f"{folder}/out", f"{folder}/check", stored).awaitTermination()
    return changes.written(spark, f"{folder}/out")


def of(rows, what):
    return sorted((r.document_id, r.version) if what == "version" else (r.document_id, r.kind) for r in rows.where(F.col("what") == what).collect())


def test_replays_late_and_duplicate_changes_give_the_batch_result(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for doc in range(12):
        for v in range(1, rng.randint(2, 6)):
            targets = " ".join(f"[[T{rng.randint(0, 5)}]]" for _ in range(rng.randint(0, 3)))
            rows.append((doc, v, f"v{v} {targets} ![[no]]", f"h{doc}-{v}", "pending" if rng.random() < 0.1 else "done", 1_704_067_200 + v * 600))
    given = rows + rng.sample(rows, 8)
    rng.shuffle(given)
    stored_v = spark.createDataFrame([(0, 1, "h0-1"), (1, 1, "h1-1")], "document_id long, version int, content_hash string")
    stored_l = spark.createDataFrame([(0, "Old"), (1, "T1")], "document_id long, target string")
    stored_j = spark.createDataFrame([(1, "embed")], "document_id long, kind string")
    out = run(spark, str(tmp_path), [given[:15], given[15:30], given[30:]], changes.stored_state(stored_v, stored_j, stored_l))
    done = {(r[0], r[1]): r for r in rows if r[4] == "done"}
    there = {(0, 1), (1, 1)}
    assert of(out, "version") == sorted(set(done) - there)
    newest = {d: max(v for e, v in done if e == d) for d in {d for d, _ in done}}
    changed = {d for d, v in newest.items() if (d, v) not in there}
    assert of(out, "job") == sorted((d, "embed") for d in changed - {1})
    links = lambda text: {t[2:-2] for t in text.split() if t.startswith("[[")}
    want = {(d, t) for d in changed for t in links(done[d, newest[d]][2])} | {(0, "Old") for _ in range(1) if 0 not in changed} | {(1, "T1") for _ in range(1) if 1 not in changed}
    assert {tuple(r) for r in changes.links_now(out, stored_l).collect()} == want


def test_a_job_waits_until_it_ends(spark, tmp_path):
    at = 1_704_067_200
    change = lambda v, s: (1, v, f"text {v}", f"h{v}", "done", at + s)
    out = run(spark, str(tmp_path), [[change(1, 0)], [change(2, 10)], [change(3, 30)]], jobs=[(2, [(1, "embed", at + 20)])])
    assert of(out, "version") == [(1, 1), (1, 2), (1, 3)]
    assert sorted(r.version for r in out.where("what = 'job'").collect()) == [1, 3]


def test_forgotten_versions_still_count_as_stored(spark, tmp_path):
    day, at = 24 * 3600, 1_704_067_200
    change = lambda doc, v, s: (doc, v, f"text {v}", f"h{v}", "done", at + s)
    batches = [[change(1, 1, 0)], [change(2, 1, 3 * day)], [change(2, 2, 3 * day + 60)], [change(1, 1, 3 * day + 120), change(1, 2, 3 * day + 120)]]
    out = run(spark, str(tmp_path), batches)
    assert of(out, "version") == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_state_is_written_once_for_each_call():
    """Each use of state is a message to the JVM; many versions of a document cost no more writes of its newest one and links."""
    derive = changes.Derive()
    derive.handle, derive.versions, derive.newest, derive.waiting, derive.links = (MagicMock() for _ in range(5))
    derive.newest.get.return_value = derive.links.get.return_value = None
    derive.versions.containsKey.return_value = derive.waiting.containsKey.return_value = False
    at = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame([{"event": "version", "at": at, "version": v, "content": f"c{v}", "content_hash": f"h{v}", "kind": None, "targets": [f"t{v}"]} for v in range(1, 6)])
    out = pd.concat(derive.handleInputRows((7,), iter([rows]), None))
    assert list(out[out.what == "link"].target) == [f"t{v}" for v in range(1, 6)] and list(out[out.what == "unlink"].target) == [f"t{v}" for v in range(1, 5)]
    derive.newest.update.assert_called_once_with((5, "h5", -1))
    derive.links.update.assert_called_once_with((["t5"],))
    assert derive.links.get.call_count == 1
