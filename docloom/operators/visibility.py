"""What a principal may see: one id table per query, for semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

#: Levels of folders, beyond which a recursion counts as a circle and raises an error.
MOST_LEVELS = 64

ANCESTORS = f"""WITH RECURSIVE up(folder_id, ancestor_id, depth) MAX RECURSION LEVEL {MOST_LEVELS} AS (
    SELECT id, id, 0 FROM {{folders}}
    UNION ALL SELECT up.folder_id, f.parent_id, up.depth + 1 FROM up JOIN {{folders}} f ON f.id = up.ancestor_id WHERE f.parent_id IS NOT NULL)
    SELECT folder_id, ancestor_id, depth FROM up"""
BELOW = "SELECT DISTINCT folder_id FROM {closure} WHERE ancestor_id IN (SELECT folder_id FROM {start})"
GRANTED = "(g.user_id = :user OR g.group_id IN (SELECT group_id FROM {members} WHERE user_id = :user))"
OPEN_ROOTS = f"""SELECT id AS folder_id FROM {{folders}} WHERE parent_id IS NULL
    AND (visibility = 'public' OR created_by = :user OR id IN (SELECT g.folder_id FROM {{grants}} g WHERE {GRANTED}))"""
VISIBLE = f"""SELECT id FROM {{docs}} WHERE deleted_at IS NULL AND (coalesce(owner_id = :user, false)
    OR CASE WHEN follows_folder AND folder_id IS NOT NULL THEN folder_id IN (SELECT folder_id FROM {{open}})
    ELSE visibility = 'public' OR id IN (SELECT g.document_id FROM {{grants}} g WHERE {GRANTED}) END)"""
SHARED = """SELECT id FROM {docs} WHERE deleted_at IS NULL AND (folder_id IN (SELECT folder_id FROM {open})
    OR id IN (SELECT document_id FROM {grants} WHERE share_id = :user))"""


def _sql(corpus, text: str, principal: str | None, **tables: DataFrame) -> DataFrame:
    return corpus.spark.sql(text, {"user": principal}, **tables)


def ancestors(folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor_id, depth) of every folder and all above it; depth 0 is the folder itself. A circle raises an error."""
    return folders.sparkSession.sql(ANCESTORS, folders=folders.select("id", "parent_id"))


def closure(corpus) -> DataFrame:
    """The corpus's ancestors as it keeps them, or worked out and written once."""
    if "_closure" not in corpus.__dict__:
        kept = getattr(corpus, "kept_closure", None)
        corpus.__dict__["_closure"] = kept.read() if kept else cut_lineage(ancestors(corpus.folders))
    return corpus.__dict__["_closure"]


def _is_share(principal: str | None) -> bool:
    return bool(principal) and principal.startswith("share:")


def visible_folders(corpus, principal: str | None) -> DataFrame:
    """(folder_id): those whose root is public, the user's own or granted; for a share, those under its folders."""
    if _is_share(principal):
        start = corpus.share_folders.where(F.col("share_id") == principal).select("folder_id")
    else:
        start = _sql(corpus, OPEN_ROOTS, principal, folders=corpus.folders, grants=corpus.folder_grants, members=corpus.members)
    return corpus.spark.sql(BELOW, start=start, closure=closure(corpus))


def hold_visible(corpus, principal: str | None) -> DataFrame:
    """visible_documents, written once for all further uses by this corpus."""
    held = corpus.__dict__.setdefault("_visible", {})
    if principal not in held:
        held[principal] = cut_lineage(visible_documents(corpus, principal))
    return held[principal]


def visible_documents(corpus, principal: str | None) -> DataFrame:
    """(id) of the documents that a user, a share or, with None, anybody sees: one pass over the documents.

    A document that follows its folder has the folder's visibility alone; owners see their own; the trash is hidden from all.
    """
    if principal in corpus.__dict__.get("_visible", {}):
        return corpus.__dict__["_visible"][principal]
    seen = visible_folders(corpus, principal)
    if _is_share(principal):
        return _sql(corpus, SHARED, principal, docs=corpus.documents, open=seen, grants=corpus.document_grants)
    return _sql(corpus, VISIBLE, principal, docs=corpus.documents, open=seen, grants=corpus.document_grants, members=corpus.members)


class NotVisible(LookupError):
    """Some documents asked for are not there or not seen."""


def ensure_visible(corpus, principal: str | None, ids: DataFrame) -> DataFrame:
    """ids (id) if the principal sees all of them; else NotVisible, which names up to ten that are missing or hidden alike."""
    hidden = ids.select("id").distinct().join(visible_documents(corpus, principal), "id", "left_anti").limit(10).collect()
    if hidden:
        raise NotVisible(f"not found: {sorted(r.id for r in hidden)}")
    return ids


def effective_visibility(corpus) -> DataFrame:
    """(id, effective_visibility): the root folder's for documents that follow their folder, else their own."""
    roots = corpus.folders.where("parent_id is null").select(F.col("id").alias("ancestor_id"), F.col("visibility").alias("root_visibility"))
    by_folder = closure(corpus).join(roots, "ancestor_id").select(F.col("folder_id").alias("f"), "root_visibility")
    docs = corpus.documents.select("id", "folder_id", "follows_folder", "visibility").join(by_folder, F.col("folder_id") == F.col("f"), "left")
    return docs.select("id", F.when(F.col("follows_folder") & F.col("folder_id").isNotNull(), F.col("root_visibility")).otherwise(F.col("visibility")).alias("effective_visibility"))


def folder_paths(corpus) -> DataFrame:
    """(folder_id, path): names from the root down, joined by slashes."""
    names = corpus.folders.select(F.col("id").alias("ancestor_id"), "name")
    walk = closure(corpus).join(names, "ancestor_id").groupBy("folder_id").agg(F.sort_array(F.collect_list(F.struct("depth", "name")), False).alias("w"))
    return walk.select("folder_id", F.array_join(F.col("w.name"), "/").alias("path"))
