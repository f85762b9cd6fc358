"""Writers: guarded CSV and markdown export."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_cell(value: str | Column) -> Column:
    """A value that spreadsheets take as text: a quote goes before a formula sign."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def write_csv(df: DataFrame, path: str) -> None:
    """Guarded CSV with a header; a byte order mark before it tells spreadsheets that the file is UTF-8."""
    guarded = df.select(*((csv_cell(c) if t == "string" else F.col(c)).alias(c if i else f"\ufeff{c}") for i, (c, t) in enumerate(df.dtypes)))
    guarded.write.option("header", True).option("escape", '"').csv(path)


# What no file name may hold, the longest stem, and the name of a document without one.
UNSAFE, LONGEST, UNNAMED = re.compile(r'[\\/:*?"<>|\x00-\x1f]'), 100, "문서"
_NUMBERED = re.compile(r"(.*) \(([1-9][0-9]*)\)", re.DOTALL)


_EDGES, _BLANKS = re.compile(r"^\s*\.*|\s+$"), re.compile(r"^\s+|\s+$")


def file_stem(title: str | None) -> str:
    """A title as a file name without its ending: no unsafe signs, no blanks around it, no dot before it, and no longer than LONGEST."""
    bare = _EDGES.sub("", UNSAFE.sub("_", title or ""))
    return _BLANKS.sub("", bare[:LONGEST]) or UNNAMED


class Names:
    """The names given so far in one family of stems, as how far the numbers of each stem have come."""

    def __init__(self) -> None:
        self.reached: dict[str, int] = {}

    def _taken(self, stem: str, number: int) -> bool:
        """Whether the name of a stem with a number (1: none) is given, as its own or as the plain name of another stem, or the other way round."""
        if number <= self.reached.get(stem, 0):
            return True
        if number > 1:
            return self.reached.get(f"{stem} ({number})", 0) >= 1
        parts = _NUMBERED.fullmatch(stem)
        return bool(parts) and 1 < int(parts[2]) <= self.reached.get(parts[1], 0)

    def give(self, stem: str) -> int:
        """The number of the next free name of a case-folded stem."""
        number = self.reached.get(stem, 0) + 1
        while self._taken(stem, number):
            number += 1
        self.reached[stem] = number
        return number


def _family(stem: str) -> str:
    """The stem without numbers at its end: only names of one family can collide."""
    while parts := _NUMBERED.fullmatch(stem):
        stem = parts[1]
    return stem


def file_names(docs: DataFrame) -> DataFrame:
    """(id, name): a Markdown file name for each title, free of collisions, case aside: in the order of creation (created_at, id as text) later ones get " (2)", " (3)" and so on.

    Names of a family (a title with and without numbers behind it) are given in one sorted stream, which remembers how far each stem's numbers have come.
    """
    key = docs.schema["id"]
    stems = T.StructType([key, T.StructField("created_at", docs.schema["created_at"].dataType), T.StructField("stem", T.StringType()), T.StructField("family", T.StringType())])

    def stem(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [file_stem(t) for t in b.column("title").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("created_at"), pa.array(own, pa.string()), pa.array([_family(s.casefold()) for s in own], pa.string())], stems.names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, names = None, Names()
        for b in batches:
            out = []
            for of, own in zip(b.column("family").to_pylist(), b.column("stem").to_pylist(), strict=True):
                if of != family:
                    family, names = of, Names()
                number = names.give(own.casefold())
                out.append(f"{own}.md" if number == 1 else f"{own} ({number}).md")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], ["id", "name"])

    dealt = docs.select("id", "created_at", "title").mapInArrow(stem, stems).repartition("family").sortWithinPartitions("family", "created_at", F.col("id").cast("string"))
    return dealt.mapInArrow(name, T.StructType([key, T.StructField("name", T.StringType())]))


def markdown(docs: DataFrame) -> DataFrame:
    """(id, name, body): documents as Markdown with front matter; titles and tags are quoted strings, so that any text comes back."""
    quoted = F.regexp_extract(F.to_json(F.array(F.coalesce("title", F.lit("")))), r"^\[(.*)\]$", 1)
    tags = F.to_json(F.coalesce("tags", F.array().cast("array<string>")))
    head = F.concat(F.lit("---\ntitle: "), quoted, F.lit("\ntags: "), tags, F.lit("\nvisibility: "), F.coalesce("visibility", F.lit("private")), F.lit("\n---\n"))
    return docs.select("id", F.concat(head, F.coalesce("content", F.lit(""))).alias("body")).join(file_names(docs), "id").select("id", "name", "body")


def export(docs: DataFrame, owner: str) -> DataFrame:
    """(id, name, body) of the owner's own documents that have a text."""
    return markdown(docs.where((F.col("owner_id") == owner) & (F.col("extraction_status") == "done")))
