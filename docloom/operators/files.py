"""Original files of documents: same originals, versions, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Suffixes that are shown as they are, and those shown through a converted PDF.
PREVIEWABLE = ("pdf", "png", "jpg", "jpeg")
CONVERTIBLE = ("hwp", "hwpx", "docx", "xlsx", "pptx")


def same_original(uploads: DataFrame, files: DataFrame, docs: DataFrame) -> DataFrame:
    """(upload_id, document_id): the first untrashed document of the owner that has the bytes as any version of its file, else null."""
    owned = docs.where("deleted_at is null").select(F.col("id").alias("document_id"), "owner_id")
    known = files.join(owned, "document_id").groupBy("owner_id", "sha256").agg(F.min("document_id").alias("document_id"))
    return uploads.join(known, ["owner_id", "sha256"], "left").select("upload_id", "document_id")


def originals(files: DataFrame, visible: DataFrame, version: int | None = None) -> DataFrame:
    """(document_id, file_version, filename, sha256): the given or the latest version of the file of each visible document."""
    own = files.join(visible.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    if version is not None:
        return own.where(F.col("file_version") == version).select("document_id", "file_version", "filename", "sha256")
    last = own.groupBy("document_id").agg(F.max_by(F.struct("file_version", "filename", "sha256"), "file_version").alias("f"))
    return last.select("document_id", "f.*")


def previews(found: DataFrame, converted: DataFrame) -> DataFrame:
    """originals with what a preview shows: converted files as the PDF made of them, once it is ready."""
    met = found.join(converted.select("document_id", "file_version", "status", "pdf_sha256"), ["document_id", "file_version"], "left")
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    made = F.when(F.col("status").isin("pending", "failed", "ready"), F.col("status")).otherwise("not_previewable")
    state = F.when(suffix.isin(*CONVERTIBLE), made).when(suffix.isin(*PREVIEWABLE), "ready").otherwise("not_previewable")
    pdf = suffix.isin(*CONVERTIBLE) & (F.col("status") == "ready")
    name = F.when(pdf, F.regexp_replace("filename", r"\.[^.]*$", ".pdf")).otherwise(F.col("filename"))
    return met.select("document_id", "file_version", state.alias("state"), name.alias("filename"), F.when(pdf, F.col("pdf_sha256")).otherwise(F.col("sha256")).alias("sha256"))


def replace_originals(docs: DataFrame, files: DataFrame, uploads: DataFrame) -> DataFrame:
    """(document_id, result, version, file_version, text_version, extraction_status) of uploads (document_id, filename, sha256, content, needs_ocr, client_version) that replace originals.

    Older files stay. An upload of a document that is gone is missing, one made from another version a conflict, the bytes of the latest file change
    nothing, and a file without a text that needs no recognition is unreadable. A new text raises the version; a file to be recognised waits, and
    has no text of its own yet where the document has none. One upload a document.
    """
    latest = files.groupBy("document_id").agg(F.max("file_version").alias("newest"), F.max_by("sha256", "file_version").alias("bytes"))
    state = docs.select(F.col("id").alias("document_id"), "version", "content_hash", "content", F.col("extraction_status").alias("was"))
    met = uploads.select("document_id", "sha256", F.col("content").alias("fresh"), "needs_ocr", "client_version").join(state, "document_id", "left").join(latest, "document_id", "left")
    blank = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+", "") == ""
    result = (
        F.when(F.col("version").isNull(), "missing").when(F.col("version") != F.col("client_version"), "conflict").when(F.col("bytes").eqNullSafe(F.col("sha256")), "unchanged")
        .when(~F.col("needs_ocr") & blank("fresh"), "unreadable").otherwise("replaced")
    )
    done = result == "replaced"
    changed = done & ~F.col("needs_ocr") & (F.sha2(F.encode("fresh", "UTF-8"), 256) != F.col("content_hash"))
    version = F.col("version") + (changed & ~blank("content")).cast("int")
    return met.select(
        "document_id", result.alias("result"), version.alias("version"), F.when(done, F.coalesce("newest", F.lit(0)) + 1).otherwise(F.col("newest")).alias("file_version"),
        F.when(done & ~(F.col("needs_ocr") & blank("content")), version).alias("text_version"), F.when(done, F.when(F.col("needs_ocr"), "pending").otherwise("done")).otherwise(F.col("was")).alias("extraction_status"),
    )
