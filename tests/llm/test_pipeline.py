"""The corpus pipeline on planted documents, stage by stage."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_planted_documents(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(prose(rng.randint(20, 40)) for _ in range(4))
    line, passage = prose(12), prose(70)
    docs = [(i, text()) for i in range(60)] + [(100 + i, "BUY NOW!!! $$$ | | | " * 30) for i in range(30)]
    docs[7] = (7, docs[3][1])  # a copy
    docs[10], docs[11] = (10, f"{text()}\n{line}"), (11, f"{line}\n{text()}")
    docs[20], docs[21] = (20, f"{prose(30)} {passage} {prose(30)}"), (21, f"{prose(90)} {passage} {prose(60)}")
    docs += [(200, None), (201, "")]
    labels = [(i, int(i < 100), 0) for i, _ in docs if i < 200]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, line string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == columns
        seen.append({r.doc_id: r.text for r in now.collect()})
    good, lined, single, cut = seen
    assert set(range(60)) <= set(good) and not set(range(100, 130)) & set(good)
    assert set(lined) == set(good) and line in lined[10] and line not in lined[11] and lined[7] == ""
    assert set(range(60)) - {7} <= set(single) | {7} and len(single) <= len(lined)
    assert passage in cut[20] and passage not in cut[21] and len(cut[21]) < len(single[21]) - 200
    assert all(cut[i] == docs[i][1] for i in range(60) if i not in (7, 11, 21) and i in cut)
    rows = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(cut)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat_an_id(spark, tmp_path):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200))
    a, b = text(), text()
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (6, text(), 4), (None, a, 5), (None, text(), 6), (7, None, 7), (8, "", 8), (9, text() * 300, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.dropped for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9]  # null and empty texts are one group
