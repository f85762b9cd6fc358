"""Markdown files with front matter, read strictly: known keys only, at least one tag, a title from the head or the first heading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of a head, and who may see a document.
KEYS, VISIBILITIES = ("title", "tags", "visibility"), ("public", "private")
#: The head of a file, between two lines of three dashes.
HEAD = r"\A---[ \t]*\r?\n([\s\S]*?\r?\n)?---[ \t]*(?:\r?\n|\z)"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def seed_documents(files: DataFrame, text: str = "text") -> DataFrame:
    """files with title, content, tags, visibility and problem: what is wrong with a file, null for a good one; a bad file's fields are null.

    Lines of the head are key: value; of a repeated key the last counts; tags stand between commas.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    has = whole.rlike(HEAD)
    lines = F.filter(F.split(F.regexp_extract(whole, HEAD, 1), r"\r?\n"), lambda x: x != "")
    entries = F.transform(lines, lambda x: F.struct(_trim(F.substring_index(x, ":", 1)).alias("key"), _trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"), F.contains(x, F.lit(":")).alias("told")))
    value = lambda key: F.try_element_at(F.filter("_entries", lambda e: e["key"] == key), F.lit(-1))["value"]
    read = files.withColumn("_entries", F.when(has, entries)).withColumn("_body", _trim(F.regexp_replace(whole, HEAD, "")))
    tags = F.filter(F.transform(F.split(F.coalesce(value("tags"), F.lit("")), ","), _trim), lambda t: t != "")
    heading = _trim(F.regexp_extract("_body", r"(?m)^# (.*)$", 1))
    told = F.nullif(value("title"), F.lit(""))
    read = read.withColumns({"_tags": tags, "_seen": F.coalesce(value("visibility"), F.lit("public")), "_title": F.coalesce(told, F.when(F.col("_body").rlike(r"(?m)^# "), heading))})
    problem = (
        F.when(~has, "no head")
        .when(F.exists("_entries", lambda e: ~e["told"]), "a line of the head is not key: value")
        .when(F.exists("_entries", lambda e: ~e["key"].isin(*KEYS)), "an unknown key")
        .when(F.size("_tags") == 0, "no tags")
        .when(~F.col("_seen").isin(*VISIBILITIES), "an unknown visibility")
        .when(F.col("_body") == "", "no text")
        .when(F.col("_title").isNull(), "no title")
    )
    fine = lambda c: F.when(problem.isNull(), F.col(c))
    return read.select(*files.columns, fine("_title").alias("title"), fine("_body").alias("content"), fine("_tags").alias("tags"), fine("_seen").alias("visibility"), problem.alias("problem"))
