"""Text of uploaded files. Office files are read with the standard library; types whose engines are absent fail by name."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.columns import content_type

FRONT_MATTER = re.compile(r"\A---\r?\n(.*?)\r?\n---\r?\n?", re.S)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _tab_row(cells: list[str]) -> str:
    return "\t".join(cells).rstrip("\t")


def _paragraphs(parts: list[str]) -> str:
    return "\n\n".join(p for p in parts if p.strip())


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_text(data: bytes) -> str:
    """Paragraphs, tables as tab rows, and text boxes; deleted text is left out, inserted text stays."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))

    def inline(e: ElementTree.Element) -> str:
        kind = _name(e)
        if kind in ("del", "moveFrom", "instrText", "delText", "Fallback"):
            return ""
        if kind == "t":
            return e.text or ""
        if kind in ("tab", "br", "cr"):
            return "\t" if kind == "tab" else "\n"
        return "".join(inline(c) for c in e if _name(c) not in ("pPr", "rPr", "tbl"))

    def blocks(e: ElementTree.Element) -> Iterator[str]:
        for c in e:
            kind = _name(c)
            if kind == "p":
                yield inline(c)
            elif kind == "tbl":
                rows = (r for r in c.iter() if _name(r) == "tr")
                yield "\n".join(filter(None, (_tab_row([" ".join(" ".join(blocks(d)).split()) for d in r if _name(d) == "tc"]) for r in rows)))
            elif kind not in ("sectPr", "del", "moveFrom"):
                yield from blocks(c)

    return _paragraphs(list(blocks(body)))


def xlsx_text(data: bytes) -> str:
    """For each sheet with values its title and tab rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(s) == "sheet"]
        out = []
        for title, part in zip(titles, _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(part)).iter() if _name(r) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = 0
                    for ch in letters[0] if letters else "":
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((v.text or "" for v in c if _name(v) == "v"), "".join(t.text or "" for t in c.iter() if _name(t) == "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                if line := _tab_row(cells):
                    rows.append(line)
            if rows:
                out.append("\n".join([title, *rows]))
    return _paragraphs(out)


def pptx_text(data: bytes) -> str:
    """Slides in order: the text of their shapes, tables as tab rows, then notes."""

    def parts(root: ElementTree.Element) -> Iterator[str]:
        for e in root:
            if _name(e) == "tbl":
                yield "\n".join(_tab_row([" ".join(t.text or "" for t in c.iter() if _name(t) == "t") for c in r if _name(c) == "tc"]) for r in e if _name(r) == "tr")
            elif _name(e) == "txBody":
                yield "\n".join(filter(None, ("".join(t.text or "" for t in p.iter() if _name(t) == "t") for p in e if _name(p) == "p")))
            else:
                yield from parts(e)

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, out = z.namelist(), []
        for slide in _numbered(names, r"ppt/slides/slide(\d+)\.xml"):
            notes = slide.replace("slides/slide", "notesSlides/notesSlide")
            for part in (slide, notes):
                if part in names:
                    out += parts(ElementTree.fromstring(z.read(part)))
    return _paragraphs(out)


def hwpx_text(data: bytes) -> str:
    """Paragraphs of all sections in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for part in _numbered(z.namelist(), r"Contents/section(\d+)\.xml"):
            for p in (e for e in ElementTree.fromstring(z.read(part)).iter() if _name(e) == "p"):
                runs = (r for r in p if _name(r) == "run")
                out.append("".join("".join(t.itertext()) for r in runs for t in r if _name(t) == "t"))
    return _paragraphs(out)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8")


EXTRACTORS: dict[str, Callable[[bytes], str]] = {"txt": plain_text, "md": plain_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "hwpx": hwpx_text}


def extract_text(data: bytes, kind: str | None) -> tuple[str | None, str, str | None]:
    """(text, status, error): done with text, or failed with the reason."""
    if kind not in EXTRACTORS:
        return None, "failed", f"no reader for {kind}"
    try:
        text = EXTRACTORS[kind](data)
    except Exception as e:  # a broken upload fails alone
        return None, "failed", f"{type(e).__name__}: {e}"[:200]
    return (text, "done", None) if text.strip() else (None, "failed", "no text")


def read_files(spark: SparkSession, path: str, skip_hashes: DataFrame | None = None) -> DataFrame:
    """(path, filename, content_type, sha256, content, extraction_status, error) of the files under path, dot files and known originals left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("content").alias("data"))
    files = files.where(~F.col("path").rlike(r"/\.[^/]*(/|$)")).withColumn("content_type", content_type("filename"))
    if skip_hashes is not None:
        files = files.join(skip_hashes.select("sha256"), "sha256", "left_anti")
    schema = T.StructType([*(files.schema[c] for c in ("path", "filename", "content_type", "sha256")), T.StructField("content", T.StringType()), T.StructField("extraction_status", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract_text(d, k) for d, k in zip(b.column("data").to_pylist(), b.column("content_type").to_pylist(), strict=True)]
            text, status, error = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([*(b.column(c) for c in ("path", "filename", "content_type", "sha256")), pa.array(text, pa.string()), pa.array(status, pa.string()), pa.array(error, pa.string())], schema.names)

    return files.select("path", "filename", "content_type", "sha256", "data").mapInArrow(run, schema)


def split_front_matter(text: str) -> tuple[dict[str, object], str]:
    """(title, tags and visibility as given, body). Without front matter the text is the body."""
    m = FRONT_MATTER.match(text)
    if not m:
        return {}, text
    import yaml

    head = yaml.safe_load(m[1]) or {}
    if not isinstance(head, dict):
        raise ValueError("front matter is no mapping")
    tags = head.get("tags") or []
    known = {"tags": [str(t) for t in (tags if isinstance(tags, list) else [tags])]}
    known |= {k: str(head[k]) for k in ("title", "visibility") if head.get(k) is not None}
    return known, text[m.end() :]
