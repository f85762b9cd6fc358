from __future__ import annotations

import io
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import columns, text
from docloom.sources import extract, sinks


def test_chunks():
    assert text.chunk_spans("x" * 2800) == [(0, 1000), (850, 1850), (1700, 2700), (2550, 2800)]
    assert text.chunk_spans(" \n ") == []
    body = "One is here.\n\nTwo is here and goes on\n\n# Head\n\nThree is the last. End"
    spans = text.chunk_spans(body, 45, 5)
    assert spans[0] == (0, 12) and all(not body[:e].rstrip().endswith("Head") for _, e in spans)
    with pytest.raises(ValueError):
        text.chunk_spans("x", 10, 10)


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a" * 1500), (2, None), (3, "  ")], "id long, content string")
    rows = text.chunk_documents(df).collect()
    assert [(r.id, r.chunk_index, r.start, r.end) for r in rows] == [(1, 0, 0, 1000), (1, 1, 850, 1500)]


def test_diff_is_minimal_and_whole():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        out, same = [], 0
        for op, p, q, r, t in text.edit_script(a, b):
            out += b[r:t]
            if op == "equal":
                assert a[p:q] == b[r:t]
                same += q - p
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert out == b and same == table[-1][-1]
    assert text.edit_script(list(map(str, range(900))), list(map(str, range(900, 1800))), budget=1000) is None


def test_identifiers_and_windows():
    assert text.identifier_pattern("ADR-12 and adr-12") is not None
    assert text.identifier_pattern("ADR-1 or ADR-2") is None and text.identifier_pattern("plain") is None
    assert text.smallest_window("a b c a c b", ["a", "b", "c"]) == (0, 5)


def archive(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = archive(**{"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = archive(**{"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row></sheetData></worksheet>'})
PPTX = archive(**{"ppt/slides/slide1.xml": "<sld><sp><txBody><p><r><t>Slide</t></r></p></txBody></sp></sld>", "ppt/notesSlides/notesSlide1.xml": "<n><txBody><p><r><t>Note</t></r></p></txBody></n>"})
HWPX = archive(**{"Contents/section0.xml": "<s><p><run><t>Han</t></run></p></s>"})


def test_files(spark, tmp_path):
    (tmp_path / "in" / ".hid").mkdir(parents=True)
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.pptx": PPTX, "d.hwpx": HWPX, "e.MD": "# é".encode(), "f.txt": b"\xff", "g.pdf": b"%PDF", ".hid/x.txt": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.filename: (r.content, r.extraction_status) for r in extract.read_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.docx": ("One\n\na\tb", "done"), "b.xlsx": ("S\nhi\t\t3", "done"), "c.pptx": ("Slide\n\nNote", "done"), "d.hwpx": ("Han", "done"), "e.MD": ("# é", "done"), "f.txt": (None, "failed"), "g.pdf": (None, "failed")}
    known = extract.read_files(spark, str(tmp_path / "in")).where("filename = 'a.docx'").select("sha256")
    assert extract.read_files(spark, str(tmp_path / "in"), known).count() == 6


def test_front_matter_and_export(spark):
    assert extract.split_front_matter("---\ntitle: T\ntags: [a, b]\nx: 1\n---\nBody") == ({"title": "T", "tags": ["a", "b"]}, "Body")
    assert extract.split_front_matter("Body") == ({}, "Body")
    docs = spark.createDataFrame([(1, "A/b", ["x"], "public", "t1", 1), (2, "a/B", [], "private", "t2", 2), (3, "..", [], "public", "t3", 3)], "id long, title string, tags array<string>, visibility string, content string, created_at long")
    got = {r.id: (r.name, r.body) for r in sinks.markdown(docs).collect()}
    assert got[1][0] == "A_b.md" and got[2][0] == "a_B (2).md" and got[3][0] == "문서.md"
    assert extract.split_front_matter(got[1][1]) == ({"title": "A/b", "tags": ["x"], "visibility": "public"}, "t1")
    hard = spark.createDataFrame([(1, 'a: "b" #c', ["x, y", "]", "# no", "1", "é 한"], "private", "t", 1)], docs.schema)
    assert extract.split_front_matter(sinks.markdown(hard).first().body) == ({"title": 'a: "b" #c', "tags": ["x, y", "]", "# no", "1", "é 한"], "visibility": "private"}, "t")


def test_columns(spark):
    df = spark.createDataFrame([("a.PDF", ["x ", " ", "x"], "😀a", "=1"), ("b", None, None, "ok")], "f string, t array<string>, u string, c string")
    rows = df.select(columns.content_type("f"), columns.media_type("f"), columns.clean_tags("t"), columns.utf16_units("u"), sinks.csv_cell("c")).collect()
    assert [tuple(r) for r in rows] == [("pdf", "application/pdf", ["x"], 3.0, "'=1"), (None, "application/octet-stream", None, None, "ok")]


def test_chunks_leave_in_bounded_batches():
    """Not all chunks of 10,000 documents at once."""
    texts = ["A sentence of some words. " * 400] * 300 + [None, "", " ", "short", "x " * 2_000_000]
    out = list(text.chunk_batches(pa.array(range(len(texts))), pa.array(texts), 1000, 150))
    size = [sum(map(len, columns[4].to_pylist())) for columns in out]
    assert len(out) >= 4 and max(size[:-1]) < 1.3 * text.BATCH_CHARACTERS
    got = [(i, n, s, e, c) for columns in out for i, n, s, e, c in zip(*(x.to_pylist() for x in columns), strict=True)]
    assert got == [(i, n, s, e, t[s:e]) for i, t in enumerate(texts) if t for n, (s, e) in enumerate(text.chunk_spans(t))]
