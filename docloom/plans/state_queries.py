"""Extraction results, job leases, access views, lookups and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import changes, extraction, search, visibility
from docloom.operators.search import Request
from docloom.plans.corpus import with_tables
from docloom.plans.registry import query
from docloom.plans.search_queries import NEAR, WALK

NOW = "TIMESTAMP '1998-01-01 00:00:00'"


def _now():
    return F.to_timestamp(F.lit("1998-01-01 00:00:00"))


@query(with_tables("""SELECT d.rank, d.document_id, p.path, o.owner_id, g.groups FROM direct d JOIN docs o ON o.id = d.document_id
    LEFT JOIN (SELECT c.folder_id, string_agg(f.name, '/' ORDER BY c.depth DESC) AS path FROM closure c JOIN folders f ON f.id = c.ancestor_id WHERE c.folder_id IN (SELECT folder_id FROM visf) GROUP BY 1) p ON p.folder_id = o.folder_id
    LEFT JOIN (SELECT user_id, list(group_id ORDER BY group_id) AS groups FROM members GROUP BY 1) g ON g.user_id = o.owner_id""", near=NEAR, cand=WALK["cand"], direct=WALK["direct"]))
def search_enriched(c):
    """Direct hits with the path of visible folders and the owner's groups."""
    hits = search.direct_hits(c, Request("user1", text="Title 3"), c.query_vector).select("rank", "document_id")
    paths = visibility.folder_paths(c).join(visibility.visible_folders(c, "user1"), "folder_id", "left_semi")
    groups = c.members.groupBy(F.col("user_id").alias("owner_id")).agg(F.array_sort(F.collect_list("group_id")).alias("groups"))
    own = hits.join(c.documents.select(F.col("id").alias("document_id"), "owner_id", "folder_id"), "document_id")
    return own.join(paths, "folder_id", "left").join(groups, "owner_id", "left").select("rank", "document_id", "path", "owner_id", "groups")


@query(with_tables("SELECT a.id, min(b.id) AS same_as FROM docs a JOIN docs b ON a.owner_id = b.owner_id AND a.content_hash = b.content_hash AND a.id > b.id WHERE b.extraction_status = 'done' AND b.deleted_at IS NULL GROUP BY 1"))
def same_text_lookup(c):
    """The first earlier document of the owner with the same text; one grouped minimum, no pairs."""
    known = c.documents.where("extraction_status = 'done' and deleted_at is null").groupBy("owner_id", "content_hash").agg(F.min("id").alias("same_as"))
    return c.documents.join(known, ["owner_id", "content_hash"]).where("id > same_as").select("id", "same_as")


READ = "SELECT conv_id AS document_id, turn AS t, CASE WHEN conv_id % 3 = 0 THEN d.content ELSE c.text END AS content, role = 'system' OR (conv_id % 11 = 5) AS failed FROM conversations c JOIN docs d ON d.id = conv_id WHERE turn < 2"
APPLIED = """SELECT document_id, result, version + CASE WHEN result = 'applied' AND extraction_status = 'done' THEN 1 ELSE 0 END AS version, CASE WHEN result = 'applied' THEN h ELSE content_hash END AS content_hash FROM (SELECT r.document_id, d.version, d.extraction_status, d.content_hash, sha256(r.content) AS h,
    CASE WHEN deleted_at IS NOT NULL THEN 'skipped' WHEN failed OR trim(r.content, E' \\t\\r\\n\\f') = '' THEN 'failed' WHEN sha256(r.content) = content_hash THEN 'unchanged' ELSE 'applied' END AS result
    FROM (SELECT * FROM read QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY t DESC) = 1) r JOIN docs d ON d.id = r.document_id)"""


def _results(c):
    """The first turns of conversations stand for texts that were read from the originals of documents; some are the text that is there, some failed."""
    turns = c.table("conversations").where("turn < 2").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("at"), "text", "role")
    met = turns.join(c.documents.select("id", "content"), F.col("document_id") == F.col("id"))
    return met.select("document_id", "at", F.when(F.col("document_id") % 3 == 0, F.col("content")).otherwise(F.col("text")).alias("content"), ((F.col("role") == "system") | (F.col("document_id") % 11 == 5)).alias("failed"))


@query(with_tables("SELECT * FROM applied", read=READ, applied=APPLIED))
def apply_extraction(c):
    return extraction.apply_results(c.documents, _results(c))


@query(with_tables("SELECT CASE coalesce(a.result, 'awaiting') WHEN 'applied' THEN 'changed' ELSE coalesce(a.result, 'awaiting') END AS result, count(*) AS documents FROM docs d LEFT JOIN applied a ON a.document_id = d.id WHERE deleted_at IS NULL AND content_type <> 'md' GROUP BY 1", read=READ, applied=APPLIED))
def reextraction_summary(c):
    originals = c.documents.where("content_type <> 'md'").select(F.col("id").alias("document_id"))
    return extraction.reextraction(c.documents, originals, extraction.apply_results(c.documents, _results(c)))


@query(with_tables(f"SELECT id, attempts, {NOW} + INTERVAL 60 SECOND AS lease_expires_at FROM jobs WHERE status = 'processing' AND attempts = 1 AND id % 3 = 0"))
def heartbeat_jobs(c):
    """Leases go on only where the worker's number of attempts is still the job's."""
    beats = c.jobs.where("id % 3 = 0").select("id", F.lit(1).alias("attempts"))
    return changes.heartbeat(c.jobs, beats, _now(), 60).select("id", "attempts", "lease_expires_at")


@query(with_tables("SELECT id, 'pending' AS status, greatest(attempts - 1, 0) AS attempts FROM jobs WHERE status = 'processing' AND kind = 'embed'"))
def release_jobs(c):
    embeds = c.jobs.where("kind = 'embed'")
    return changes.release(embeds, embeds.select("id")).select("id", "status", "attempts")


@query(with_tables("""SELECT document_id, chunk_index, version, content FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE id % 4 <> 1 AND id % 2 = 0) UNION ALL
    SELECT k.document_id, k.chunk_index, d.version, '* ' || k.content FROM chunks k JOIN docs d ON d.id = k.document_id WHERE d.id % 4 <> 1 AND d.id % 2 = 0 AND k.chunk_index < 3"""))
def finalize_embeddings(c):
    """New chunks of every second document replace its old ones unless its text changed while they were made."""
    i = F.col("document_id")
    own = c.chunks.select("document_id", "chunk_index", "version", "content")
    made = own.where("document_id % 2 = 0 and chunk_index < 3 or document_id % 4 = 1").withColumn("content", F.concat(F.lit("* "), "content"))
    made = made.join(c.documents.select(F.col("id").alias("document_id"), "content_hash"), "document_id", "left").withColumn("made_from", F.when(i % 4 == 1, "other").otherwise(F.coalesce("content_hash", F.lit("gone")))).drop("content_hash")
    chunks, _ = extraction.finalize(c.documents, own, made)
    return chunks


@query(with_tables("SELECT content_type, count(*) AS wanted FROM docs d WHERE content_type IN ('hwp', 'hwpx', 'docx', 'xlsx', 'pptx') AND deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = d.id AND j.kind = 'preview' AND j.status = 'pending') GROUP BY 1"))
def preview_jobs(c):
    waiting = c.jobs.where("kind = 'preview' and status = 'pending'").select(F.col("document_id").alias("id"))
    due = c.documents.where(F.col("content_type").isin("hwp", "hwpx", "docx", "xlsx", "pptx") & F.col("deleted_at").isNull()).join(waiting, "id", "left_anti")
    return due.groupBy("content_type").agg(F.count("*").alias("wanted"))


@query(with_tables("""SELECT d.id, coalesce(list(DISTINCT user_id ORDER BY user_id) FILTER (user_id IS NOT NULL), []) AS users, coalesce(list(DISTINCT group_id ORDER BY group_id) FILTER (group_id IS NOT NULL), []) AS groups
    FROM docs d LEFT JOIN document_grants g ON g.document_id = d.id WHERE d.owner_id = 'user1' GROUP BY 1"""))
def document_access(c):
    g = c.document_grants.groupBy("document_id").agg(F.array_sort(F.collect_set("user_id")).alias("users"), F.array_sort(F.collect_set("group_id")).alias("groups"))
    none = F.array().cast("array<string>")
    own = c.documents.where("owner_id = 'user1'").select("id").join(g, F.col("id") == F.col("document_id"), "left")
    return own.select("id", F.coalesce("users", none).alias("users"), F.coalesce("groups", none).alias("groups"))


@query(with_tables("SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'processing') AND id <= 20000) AS remaining, count(DISTINCT CASE WHEN status = 'error' THEN document_id END) AS failed_documents FROM jobs WHERE kind = 'edges'"))
def rebuild_progress(c):
    left = F.col("status").isin("pending", "processing") & (F.col("id") <= 20000)
    return c.jobs.where("kind = 'edges'").agg(F.count("*").alias("total"), F.count_if(left).alias("remaining"), F.countDistinct(F.when(F.col("status") == "error", F.col("document_id"))).alias("failed_documents"))


@query(with_tables("""SELECT parent.id AS folder_id, count(DISTINCT d.id) AS documents, count(DISTINCT d.owner_id) AS owners FROM folders parent JOIN closure c ON c.ancestor_id = parent.id LEFT JOIN docs d ON d.folder_id = c.folder_id AND d.deleted_at IS NULL GROUP BY 1"""))
def subtree_counts(c):
    filed = c.documents.where("deleted_at is null").select(F.col("id").alias("d"), "owner_id", F.col("folder_id").alias("f"))
    return visibility.closure(c).join(filed, F.col("folder_id") == F.col("f"), "left").groupBy(F.col("ancestor_id").alias("folder_id")).agg(F.countDistinct("d").alias("documents"), F.countDistinct("owner_id").alias("owners"))


@query(with_tables("SELECT version, count(*) AS documents, count(*) FILTER (author_via = 'assistant') AS by_assistant, round(avg(length(content)), 6) AS mean_chars FROM versions GROUP BY 1"))
def version_statistics(c):
    return c.versions.groupBy("version").agg(F.count("*").alias("documents"), F.count_if(F.col("author_via") == "assistant").alias("by_assistant"), F.round(F.avg(F.length("content")), 6).alias("mean_chars"))
