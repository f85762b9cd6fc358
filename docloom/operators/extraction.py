"""What extraction, embedding and preview work leaves behind: results applied to documents, chunks replaced, texts for previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.files import CONVERTIBLE


def apply_results(docs: DataFrame, results: DataFrame) -> DataFrame:
    """(document_id, result, version, content_hash) of extraction results (document_id, content, failed) for documents.

    The trash is skipped; a failure changes nothing; an equal text is unchanged; the first text of a document keeps its version, any later one raises it.
    Of several results of a document the last by arrival (at) counts.
    """
    last = results.groupBy("document_id").agg(F.max_by(F.struct("content", "failed"), "at").alias("r"))
    met = docs.join(last, F.col("id") == F.col("document_id"))
    fresh = F.sha2(F.encode("r.content", "UTF-8"), 256)
    failed = F.col("r.failed") | F.col("r.content").isNull() | (F.regexp_replace("r.content", r"^[ \t\r\n\f]+", "") == "")
    result = F.when(F.col("deleted_at").isNotNull(), "skipped").when(failed, "failed").when(fresh == F.col("content_hash"), "unchanged").otherwise("applied")
    raised = (result == "applied") & (F.col("extraction_status") == "done")
    return met.select("document_id", result.alias("result"), (F.col("version") + raised.cast("int")).alias("version"), F.when(result == "applied", fresh).otherwise(F.col("content_hash")).alias("content_hash"))


def reextraction(docs: DataFrame, files: DataFrame, applied: DataFrame) -> DataFrame:
    """(result, documents) of extracting all originals again: documents with an original (document_id) by what came of it, or awaiting."""
    own = docs.where("deleted_at is null").join(files.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    met = own.join(applied.select(F.col("document_id").alias("id"), "result"), "id", "left")
    kind = F.when(F.col("result") == "applied", "changed").otherwise(F.coalesce("result", F.lit("awaiting")))
    return met.groupBy(kind.alias("result")).agg(F.count("*").alias("documents"))


def finalize(docs: DataFrame, old: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, results) after embedding: new chunks (document_id, made_from, chunk_index, ...) replace a document's old ones if its text is still the one they were made from.

    results: (document_id, result, chunks). New chunks take the document's version; a document that is gone discards them.
    """
    now = docs.select(F.col("id").alias("document_id"), "content_hash", F.col("version").alias("doc_version"))
    judged = made.groupBy("document_id", "made_from").agg(F.count("*").alias("chunks")).join(now, "document_id", "left")
    judged = judged.withColumn("result", F.when(F.col("made_from").eqNullSafe(F.col("content_hash")) & F.col("content_hash").isNotNull(), "ready").otherwise("discarded"))
    fine = judged.where("result = 'ready'").select("document_id", "made_from", "doc_version")
    columns = [c for c in old.columns if c != "version"]
    fresh = made.join(fine, ["document_id", "made_from"]).select(*columns, F.col("doc_version").alias("version"))
    kept = old.join(fine.select("document_id"), "document_id", "left_anti").select(*columns, "version")
    return kept.unionByName(fresh), judged.select("document_id", "result", "chunks")


def preview_work(files: DataFrame, previews: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, jobs) to add for original files (document_id, file_version, filename): a pending preview for each convertible file without one, and one waiting job a document."""
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    due = files.where(suffix.isin(*CONVERTIBLE)).join(previews.select("document_id", "file_version"), ["document_id", "file_version"], "left_anti")
    rows = due.select("document_id", "file_version", F.lit("pending").alias("status"))
    waiting = jobs.where("kind = 'preview' and status = 'pending'").select("document_id")
    return rows, rows.select("document_id").distinct().join(waiting, "document_id", "left_anti").select("document_id", F.lit("preview").alias("kind"))


def preview_texts(previews: DataFrame, docs: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, file_version, content) of waiting previews (document_id, file_version, text_version, status): the text of their own version, null while there is none; the newest comes from the document."""
    waiting = previews.where("status = 'pending'").select("document_id", "file_version", "text_version")
    now = docs.select(F.col("id").alias("document_id"), F.col("version").alias("doc_version"), F.col("content").alias("now"))
    past = versions.select("document_id", F.col("version").alias("text_version"), F.col("content").alias("past"))
    met = waiting.join(now, "document_id").join(past, ["document_id", "text_version"], "left")
    text = F.when(F.col("text_version").isNull(), F.lit(None).cast("string")).when(F.col("text_version") == F.col("doc_version"), F.col("now")).otherwise(F.col("past"))
    return met.select("document_id", "file_version", text.alias("content"))
