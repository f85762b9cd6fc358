"""Evidence, passages, previews and identifiers on hand-made cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import answers, passages

PASSAGES = "query_id long, place long, passage long, document_id long, title string, chunk_index long, based_on_version long, current_version long, content string, focus_from long, focus_to long"


def test_budget_fills_matched_chunks_first_then_widens():
    a, b = "x" * 50 + "AAAA" + "x" * 50, "y" * 50 + "BBBB" + "y" * 50
    assert answers.fill([(a, 50, 54), (b, 50, 54)], 8) == [(0, 50, 54), (1, 50, 54)]
    assert answers.fill([(a, 50, 54), (b, 50, 54)], 18) == [(0, 45, 59), (1, 50, 54)]
    assert answers.fill([(a, 50, 54), (b, 50, 54)], 1000) == [(0, 0, 104), (1, 0, 104)]
    assert answers.fill([("z" * 30, 0, 30), (b, 50, 54)], 20) == [(0, 0, 20)]  # the first is cut
    assert answers.fill([(a, 50, 54), ("z" * 30, 0, 30), (b, 50, 54)], 10) == [(0, 49, 55), (2, 50, 54)]  # what does not fit is passed over
    assert answers.fill([("  ", 0, 2), (a, 50, 54), (a + " ", 50, 54)], 4) == [(1, 50, 54)]
    assert answers.fill([("ab   cd", 2, 5)], 10) == [(0, 0, 7)]  # a blank focus takes nothing at first
    assert answers.fill([], 10) == [] and answers.fill([(a, 0, 4)], 0) == []


def test_evidence_labels_and_revisions(spark):
    rows = [(1, 2, 1, 20, "B", 3, 1, 2, "second", None, None), (1, 1, 1, 10, "A", 0, 2, 2, " first ", None, None), (1, 3, 1, 30, "gone", 0, 1, None, "hidden", None, None), (1, 4, 1, 40, "C", 1, 1, 1, "third", None, None), (2, 1, 1, 10, "A", 0, 2, 2, "other query", None, None)]
    out = answers.evidence(spark.createDataFrame(rows, PASSAGES), 100)
    got = {(r.query_id, r.label): (r.document_id, r.revised, r.content) for r in out.collect()}
    assert got == {(1, 1): (10, False, "first"), (1, 2): (20, True, "second"), (1, 3): (40, False, "third"), (2, 1): (10, False, "other query")}
    said = spark.createDataFrame([(1, "so [2], [2] and [99999999999999999999] [x]")], "query_id long, answer string")
    assert {(r.query_id, r.label): r.cited for r in answers.cited(said, out).collect()} == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): False}


def test_place_in_the_earlier_version(spark):
    paragraphs = [" ".join(f"w{p}x{i}." for i in range(120)) for p in range(4)]
    versions = spark.createDataFrame([(1, 1, "\n\n".join(paragraphs)), (2, 1, "")], "document_id long, version long, content string")
    chunks = spark.createDataFrame([(1, 2, 5, "new words " + paragraphs[2]), (1, 2, 6, "nothing alike")], "document_id long, version long, chunk_index long, content string")
    asked = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 1, 6), (3, 2, 1, 0)], "place long, document_id long, version long, chunk_index long")
    got = {r.place: r for r in answers.earlier_places(asked, versions, chunks).collect()}
    assert "w2x60." in got[1].content and got[1].based_on_version == 1
    assert got[2].chunk_index == 0 and set(got) == {1, 2}


def test_passages_merge_touching_contexts(spark):
    texts = {i: f"chunk {i}" for i in range(20) if i != 11}
    chunks = spark.createDataFrame([(1, 1, i, t) for i, t in texts.items()] + [(1, 2, 3, "another version")], "document_id long, version long, chunk_index long, content string")
    found = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 3, 0.2), (1, 1, 8, 0.3), (1, 1, 15, 0.1)], "document_id long, version long, chunk_index long, distance double")
    got = {r.place: r for r in passages.merged_passages(chunks, found).collect()}
    assert [(got[i].chunk_index, got[i].first, got[i].last) for i in (1, 2)] == [(15, 13, 17), (3, 0, 10)] and len(got) == 2
    for r in got.values():
        assert r.content == "\n\n".join(texts[i] for i in range(r.first, r.last + 1)) and r.content[r.focus_from : r.focus_to] == texts[r.chunk_index]
    few = passages.merged_passages(chunks, found, most=1).collect()
    assert [(r.chunk_index, r.score) for r in few] == [(15, 0.9)]


def test_identifiers():
    one = lambda q: text.identifier_pattern(q)
    assert text.identifiers("adr-12, ADR-12 and 제 3 조") == {text.Identifier(True, "12"), text.Identifier(False, "3")}
    assert one("see ADR-12") and one("adr-12 ADR-12") and one("제3조 (목적)") and one("제 3 조의 규정")
    assert one("xADR-1") is None and one("my-ADR-1") is None and one("ADR-1 or ADR-2") is None and one("제3조의2") is None and one("plain 12") is None


def test_identifier_patterns_in_spark(spark):
    df = spark.createDataFrame([("ADR-12",), ("the adr-12.",), ("ADR-123",), ("xADR-12",), ("제 3  조",), ("제3조의 2",), ("제3조",)], "t string")
    hits = lambda q: [r.t for r in df.where(F.col("t").rlike(text.identifier_pattern(q))).collect()]
    assert hits("ADR-12") == ["ADR-12", "the adr-12."] and hits("제3조") == ["제 3  조", "제3조"]


def test_previews(spark):
    table = "intro line\n\n| name | unit |\n|---|---|\n| pump | bar |\n| valve | pascal |\nend"
    long = "\n".join(f"line {i} " + "filler " * 30 for i in range(10)) + "\nthe pascal stands here " + "more " * 100
    hits = spark.createDataFrame([(1, 0, table), (2, 0, long), (3, 0, "nothing"), (4, 0, None), (5, 0, "")], "document_id long, chunk_index long, content string")
    got = {r.document_id: r.preview for r in text.previews(hits, "Pascal valve").collect()}
    assert got[1] is not None and "valve | pascal" in got[1]
    assert got[2].startswith("the pascal") and len(got[2]) <= 300
    assert got[3] is None and got[4] is None and got[5] is None
    row = spark.createDataFrame([(table, "| valve | pascal |\nend"), (table, "| pump | bar |\n| valve | pascal |\nend"), (table, "intro line"), (table, "valve | pascal |")], "content string, chosen string")
    out = [r[0] for r in row.select(text.with_row_before(F.col("content"), F.col("chosen"))).collect()]
    assert out == ["| pump | bar |\n| valve | pascal |", "| pump | bar |\n| valve | pascal |\nend", "intro line", "valve | pascal |"]


def test_hangul_terms(spark):
    df = spark.range(1).select(text.query_terms("교체하면 Do it").alias("t"), text.best_option(F.array(F.lit("없음"), F.lit("교체할수록"), F.lit("교체하면")), "교체하면").alias("b"), text.best_option(F.array(F.lit("a"), F.lit("b")), "zz").alias("n"))
    r = df.first()
    assert sorted(r.t) == sorted(["교체", "체하", "하면", "do", "it"]) and r.b == "교체하면" and r.n is None


def test_where_evidence_gets_lost(spark):
    evidence = spark.createDataFrame([(1, "A", "key  one"), (1, "A", "key two"), (2, "A", "nowhere"), (3, "B", "deep"), (4, "B", "shown"), (5, "B", "passage")], "query long, source string, text string")
    hits = spark.createDataFrame([(1, 1, "A", "has key one and key two"), (2, 1, "A", "x"), (3, 1, "A", "deep but another title"), (3, 2, "B", "x"), (4, 1, "A", "x"), (4, 2, "B", "it is shown"), (5, 1, "B", "x"), (4, 9, "B", "far")], "query long, rank long, title string, content string")
    parts = spark.createDataFrame([(1, 1, "A", "key one"), (5, 1, "B", "the\npassage is"), (3, 9, "B", "deep")], "query long, rank long, title string, content string")
    stored = spark.createDataFrame([("A", "key one key two"), ("B", "deep shown"), ("B", "passage")], "title string, content string")
    got = {r["query"]: (r.required, r.first_excerpt, r.top_passages, r.cause) for r in passages.evidence_grades(evidence, hits, parts, stored).collect()}
    assert got == {1: (2, 2, 1, "complete"), 2: (1, 0, 0, "extraction"), 3: (1, 0, 0, "candidates"), 4: (1, 0, 0, "complete"), 5: (1, 0, 1, "selection")}
