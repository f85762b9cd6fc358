"""Small column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upload types by suffix and their media types (fixed values).
MEDIA_TYPES = {
    "txt": "text/plain; charset=utf-8",
    "md": "text/markdown; charset=utf-8",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "hwp": "application/x-hwp",
    "hwpx": "application/hwp+zip",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
}


def content_type(filename: str | Column) -> Column:
    """The lower-case suffix if it is known, else null."""
    suffix = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return F.when(suffix.isin(*MEDIA_TYPES), suffix)


def media_type(filename: str | Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))), F.lit("application/octet-stream"))


def clean_tags(tags: str | Column) -> Column:
    """Trimmed, without blanks, each once in the order of first use."""
    return F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != ""))


def utf16_units(text: str | Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16LE")) / 2
