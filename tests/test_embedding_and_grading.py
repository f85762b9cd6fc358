"""Providers, extraction results, chunk replacement and graded answers on hand-made cases."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, embedding, extraction, verification


def test_the_hash_provider_and_spark_agree(spark):
    texts = ["one two two", "", None, "  \n", "Ünïcode wörds here", "a b c d e f g h " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    got = {r.id: r.embedding for r in embedding.hashed(df, ["id"]).collect()}
    want = embedding.hash_provider()([t or "" for t in texts])
    assert all(len(got[i]) == 64 and max(abs(x - y) for x, y in zip(got[i], w, strict=True)) < 1e-6 for i, w in enumerate(want))
    ran = {r.id: r.embedding for r in embedding.embed(df, embedding.hash_provider(), 64, batch=2).collect()}
    assert all(math.dist(ran[i], w) < 1e-12 for i, w in enumerate(want))


def test_a_provider_that_breaks_its_contract(spark):
    with pytest.raises(ValueError):
        embedding.checked([[1.0, 0.0]], 2)
    for bad in ([[1.0], [0.6, 0.8]], [[2.0, 0.0], [1.0, 0.0]], [[float("nan"), 0.0], [1.0, 0.0]]):
        with pytest.raises(ValueError):
            embedding.checked(bad, 2)
    with pytest.raises(ValueError):
        embedding.checked([[1.0, 0.0]], 1, dimension=3)


def digest(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_extraction_results(spark):
    docs = spark.createDataFrame([(1, digest("same"), 3, "done", None), (2, digest("old"), 3, "done", None), (3, digest(""), 1, "pending", None), (4, "h", 1, "done", 5), (5, "h", 2, "done", None), (6, "h", 1, "done", None)], "id long, content_hash string, version int, extraction_status string, deleted_s long").withColumn("deleted_at", F.timestamp_seconds("deleted_s"))
    results = spark.createDataFrame([(1, "same", False, 1), (2, "early", False, 1), (2, "new", False, 2), (3, "first", False, 1), (4, "x", False, 1), (5, None, True, 1), (6, " \n", False, 1), (9, "none", False, 1)], "document_id long, content string, failed boolean, at long")
    out = extraction.apply_results(docs, results)
    assert {r.document_id: (r.result, r.version) for r in out.collect()} == {1: ("unchanged", 3), 2: ("applied", 4), 3: ("applied", 1), 4: ("skipped", 1), 5: ("failed", 2), 6: ("failed", 1)}
    assert {r.document_id: r.content_hash for r in out.collect()}[2] == digest("new")
    files = spark.createDataFrame([(1,), (2,), (2,), (4,), (5,), (7,)], "document_id long")
    more = docs.unionByName(docs.where("id = 1").withColumn("id", F.lit(7).cast("long")))
    assert {r.result: r.documents for r in extraction.reextraction(more, files, out).collect()} == {"unchanged": 1, "changed": 1, "failed": 1, "awaiting": 1}


def test_chunks_are_replaced_only_for_the_text_they_were_made_from(spark):
    docs = spark.createDataFrame([(1, "h1", 5), (2, "h2", 5)], "id long, content_hash string, version int")
    chunk = "document_id long, chunk_index long, version int, content string"
    old = spark.createDataFrame([(1, 0, 4, "old"), (1, 1, 4, "old"), (2, 0, 4, "old")], chunk)
    made = spark.createDataFrame([(1, 0, 0, "new", "h1"), (2, 0, 0, "stale", "h0"), (3, 0, 0, "gone", "h")], chunk + ", made_from string")
    chunks, results = extraction.finalize(docs, old, made)
    assert sorted((r.document_id, r.chunk_index, r.version, r.content) for r in chunks.collect()) == [(1, 0, 5, "new"), (2, 0, 4, "old")]
    assert {r.document_id: r.result for r in results.collect()} == {1: "ready", 2: "discarded", 3: "discarded"}


def test_preview_rows_and_jobs(spark):
    files = spark.createDataFrame([(1, 1, "a.DOCX"), (1, 2, "a.docx"), (2, 1, "b.pdf"), (3, 1, "c.pptx"), (4, 1, "d.hwp")], "document_id long, file_version int, filename string")
    previews = spark.createDataFrame([(1, 1), (4, 1)], "document_id long, file_version int")
    jobs = spark.createDataFrame([(3, "preview", "pending"), (1, "preview", "done")], "document_id long, kind string, status string")
    rows, added = extraction.preview_work(files, previews, jobs)
    assert sorted((r.document_id, r.file_version) for r in rows.collect()) == [(1, 2), (3, 1)] and [r.document_id for r in added.collect()] == [1]


def test_keys_in_answers(spark):
    cases = [("8.6%", "it is 18.6%", False), ("8.6%", "it is 8.6 %.", True), ("1.21392", "1.213925", False), ("1,234", "1234 units", True), ("12", "in 12.5", False), ("12", "12.", True), ("a b", "AB ab", True), ("12", "1 2", False), ("x+y", "so x + y", True)]
    df = spark.createDataFrame(cases, "key string, said string, want boolean")
    got = df.select("key", "said", "want", answers.holds_all(answers.compact(F.col("said")), F.array("key")).alias("got")).collect()
    assert [(r.key, r.said, r.got) for r in got if r.got != r.want] == []


def test_grading(spark):
    items = spark.createDataFrame([(1, True, "answered", "it is 12 [1]", ["12"], ["99"]), (2, True, "answered", answers.REFUSAL, ["12"], []), (3, False, "no_evidence", None, [], []), (4, False, "answered", "99 [1]", [], ["99"])], "query_id long, answerable boolean, status string, answer string, keys array<string>, absent array<string>")
    sources = spark.createDataFrame([(1, 1, 10, "holds 12", False), (1, 2, 11, "other", False), (2, 1, 12, "has 1", False), (2, 2, 13, "and 12", False)], "query_id long, label long, document_id long, content string, revised boolean")
    relevant = spark.createDataFrame([(1, 10), (2, 13)], "query_id long, document_id long")
    graded = answers.grade(items, answers.cited(items.select("query_id", "answer"), sources), relevant)
    rows = {r.query_id: r for r in graded.collect()}
    assert rows[1].key_hit and rows[1].cited_relevant and not rows[1].refused and rows[1].leaks == 0
    assert rows[2].refused and not rows[2].key_hit and rows[2].keys_in_sources and rows[2].given_relevant and not rows[2].cited_relevant
    assert rows[3].refused and rows[3].key_hit is None and rows[4].leaks == 1
    s = answers.summary(graded).first()
    assert (s.queries, s.key_hits, s.model_misses, s.false_refusals, s.correct_refusals, s.leaks) == (4, 1, 1, 1, 1, 1)


def test_ordered_digest(spark):
    rows = [(i, digest(str(i))[:32]) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, h string").repartition(7)
    assert verification.ordered_digest(df, "id", "h", block=100).first().digest == hashlib.md5("".join(h for _, h in rows).encode()).hexdigest()
    assert verification.ordered_digest(df.limit(0), "id", "h").first().digest == hashlib.md5(b"").hexdigest()
