"""Repeated ids, ties, very long texts and clashing names of the earlier operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docloom.llm import packing, quality, topk


def test_top_k_with_repeated_ids_ties_and_great_values(spark):
    big = float(1 << 45)
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [big, 1.0]), (4, [big, 1.0]), (5, [-1.0, -1.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got: dict[int, list] = {}
    for r in topk.top_k(df, F.col("vec_id").isin(0, 3), k=5, row_block=2, query_block=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    def want(q, own):
        z = [int(256 * x) for x in q]
        scored = [(i, max(-(1 << 63), min((1 << 63) - 1, sum(a * int(256 * b) for a, b in zip(z, v, strict=True))))) for i, v in rows if i != own]
        return sorted(scored, key=lambda x: (-x[1], x[0]))[:5]
    assert got == {0: want([1.0, 1.0], 0), 3: want([big, 1.0], 3)}


def test_packing_of_repeated_ids_and_a_very_long_text(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "four"), (2, "word " * 30_000), (None, "lost"), (3, None), (3, "")]
    out = packing.pack(spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id long, text string, piece int, sequence_id string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id for r in out if r.doc_id in (1, 3)), key=str) == [1, 1, 1, 3, 3] and sum(r.length for r in out if r.doc_id == 2) > 30_000
    assert sorted(r.start for r in out if r.doc_id == 2) == [4096 * i for i in range(sum(r.doc_id == 2 for r in out))]
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_classifier_scores_each_text_of_a_repeated_id(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    text = lambda good: ("fine words here, and more of them. " if good else "JUNK!! | $$ ") * 20
    rows = [(i, text(i % 2), 0.5, 9) for i in range(60)] + [(100, text(1), 0.1, 1), (100, text(0), 0.2, 2), (None, text(1), 0.3, 3)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int"), labels).collect()
    assert len(out) == len(rows)
    both = sorted(r.score for r in out if r.doc_id == 100)
    assert both[0] < 0.3 <= both[1]
