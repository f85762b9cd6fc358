"""Original files, lists with filters, verification of runs, further change rules and integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import analytics, changes, diffs, extraction, files, listing, passages, search, validators, verification, visibility
from docloom.operators.listing import Filters
from docloom.plans.analytics_queries import BEFORE, USER, _before
from docloom.plans.corpus import with_tables
from docloom.plans.registry import query
from docloom.plans.search_queries import GRAPH, LINKS
from docloom.session import cut_lineage
from docloom.sources import sinks

FILES = """SELECT id AS document_id, v AS file_version, 'f' || id || '.' || CASE WHEN id % 8 = 6 THEN 'PDF' ELSE content_type END AS filename,
    CASE WHEN v = 1 THEN content_hash ELSE sha256(content || 'x') END AS sha256 FROM docs, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR id % 3 = 0"""
CONVERTED = """SELECT document_id, file_version, CASE document_id // 16 % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'unavailable' END AS status,
    CASE WHEN document_id // 16 % 4 = 0 THEN sha256('pdf' || sha256) END AS pdf_sha256 FROM files WHERE document_id % 5 <> 4"""
STORE = {"files": FILES, "converted": CONVERTED}


def _files(c) -> DataFrame:
    both = c.documents.withColumn("file_version", F.explode(F.array(F.lit(1), F.lit(2)))).where("file_version = 1 or id % 3 = 0")
    name = F.concat(F.lit("f"), "id", F.lit("."), F.when(F.col("id") % 8 == 6, "PDF").otherwise(F.col("content_type")))
    return both.select(F.col("id").alias("document_id"), "file_version", name.alias("filename"), F.when(F.col("file_version") == 1, F.col("content_hash")).otherwise(F.sha2(F.encode(F.concat("content", F.lit("x")), "UTF-8"), 256)).alias("sha256"))


def _converted(c) -> DataFrame:
    turn = F.floor(F.col("document_id") / 16) % 4
    status = F.when(turn == 0, "ready").when(turn == 1, "pending").when(turn == 2, "failed").otherwise("unavailable")
    return _files(c).where("document_id % 5 <> 4").select("document_id", "file_version", status.alias("status"), F.when(turn == 0, F.sha2(F.concat(F.lit("pdf"), "sha256").cast("binary"), 256)).alias("pdf_sha256"))


@query(with_tables("SELECT u.id AS upload_id, (SELECT min(d.id) FROM files f JOIN docs d ON d.id = f.document_id WHERE d.deleted_at IS NULL AND d.owner_id = u.owner_id AND f.sha256 = u.content_hash) AS document_id FROM docs u", **STORE))
def same_original(c):
    return files.same_original(c.documents.select(F.col("id").alias("upload_id"), "owner_id", F.col("content_hash").alias("sha256")), _files(c), c.documents)


SHOWN = """SELECT f.document_id, f.file_version, CASE WHEN e IN ('hwp', 'hwpx', 'docx', 'xlsx', 'pptx') THEN CASE WHEN status IS NULL OR status = 'unavailable' THEN 'not_previewable' ELSE status END WHEN e = 'pdf' THEN 'ready' ELSE 'not_previewable' END AS state,
    CASE WHEN e IN ('hwpx', 'docx', 'xlsx') AND status = 'ready' THEN 'f' || f.document_id || '.pdf' ELSE filename END AS filename, CASE WHEN e IN ('hwpx', 'docx', 'xlsx') AND status = 'ready' THEN pdf_sha256 ELSE sha256 END AS sha256
    FROM (SELECT *, lower(split_part(filename, '.', 2)) AS e FROM files WHERE document_id IN (SELECT id FROM vis)) f LEFT JOIN converted p USING (document_id, file_version)"""


@query(with_tables(f"{SHOWN} QUALIFY row_number() OVER (PARTITION BY f.document_id ORDER BY f.file_version DESC) = 1", **STORE))
def original_previews(c):
    return files.previews(files.originals(_files(c), visibility.visible_documents(c, USER)), _converted(c))


@query(with_tables("SELECT document_id, file_version, filename, sha256 FROM files WHERE file_version = 2 AND document_id IN (SELECT id FROM vis)", **STORE))
def original_version(c):
    return files.originals(_files(c), visibility.visible_documents(c, USER), version=2)


@query(with_tables("SELECT document_id, version, content, author_via FROM versions WHERE version = 2 AND document_id IN (SELECT id FROM vis)"))
def past_version(c):
    seen = visibility.visible_documents(c, USER).select(F.col("id").alias("document_id"))
    return c.versions.where("version = 2").join(seen, "document_id", "left_semi").select("document_id", "version", "content", "author_via")


FILTERED = {
    "embedding": (Filters(embedding_status="pending"), "embedding_status = 'pending'"), "extraction": (Filters(extraction_status="failed"), "extraction_status = 'failed'"), "tag": (Filters(tag="en"), "list_contains(tags, 'en')"),
    "title": (Filters(title=" tItLe 1 "), "lower(title) LIKE '%title 1%'"), "literal": (Filters(title="T_tle%"), "false"), "type": (Filters(content_type="md"), "content_type = 'md'"),
    "folder": (Filters(folder_id="n1"), "folder_id = 'n1' AND folder_id IN (SELECT folder_id FROM visf)"), "owned": (Filters(owned=True), "owner_id = 'user1'"), "unfiled": (Filters(unfiled=True), "folder_id IS NULL"),
    "granted": (Filters(granted=True), "owner_id <> 'user1' AND CASE WHEN follows_folder AND folder_id IS NOT NULL THEN (SELECT r.visibility FROM closure c JOIN folders r ON r.id = c.ancestor_id WHERE c.folder_id = docs.folder_id AND r.parent_id IS NULL) ELSE visibility END = 'private'"),
}


@query(with_tables(" UNION ALL ".join(f"SELECT '{n}' AS filter, (SELECT count(*) FROM docs JOIN vis USING (id) WHERE {w}) AS documents" for n, (_, w) in FILTERED.items())))
def filter_counts(c):
    return reduce(DataFrame.unionByName, (listing.listed(c, USER, f).agg(F.count("*").alias("documents")).select(F.lit(n).alias("filter"), "documents") for n, (f, _) in FILTERED.items()))


@query(with_tables("SELECT id, title, updated_at, (SELECT count(*) FROM docs JOIN vis USING (id) WHERE list_contains(tags, 'en')) AS total FROM (SELECT *, created_at + to_hours(id % 97) AS updated_at FROM docs) JOIN vis USING (id) WHERE list_contains(tags, 'en') ORDER BY updated_at DESC, id LIMIT 20 OFFSET 5"))
def list_page(c):
    rows = listing.listed(c, USER, Filters(tag="en")).withColumn("updated_at", F.col("created_at") + F.make_dt_interval(hours=(F.col("id") % 97).cast("int")))
    return listing.page(rows, [F.desc("updated_at"), "id"], 20, 5).select("id", "title", "updated_at", "total")


@query(with_tables("SELECT id, title, content_hash AS stored, content_hash AS computed, version, coalesce((SELECT list(file_version || ':' || sha256 ORDER BY file_version) FROM files f WHERE f.document_id = docs.id), []) AS files FROM docs WHERE title LIKE 'Title 1%'", **STORE))
def ledger_rows(c):
    return verification.ledger_rows(c.documents, _files(c), "Title 1")


@query(with_tables("SELECT action AS kind, count(*) FILTER (value < 5) AS raw_500, count(*) FILTER (value < 10) AS final_failures, coalesce(max(document_id % 4) FILTER (value >= 10), 0) AS error_jobs, count(*) FILTER (value < 10) = 0 AND coalesce(max(document_id % 4) FILTER (value >= 10), 0) = 0 AS sound FROM audit_log GROUP BY 1"))
def event_tally(c):
    v = F.col("value")
    return verification.tally(c.audit_log.select(F.col("action").alias("kind"), F.when(v < 5, 500).otherwise(200).alias("status"), (v >= 10).alias("ok"), (F.col("document_id") % 4).alias("error_jobs")))


@query(with_tables("SELECT action, max(value) AS p90 FROM (SELECT action, value, row_number() OVER (PARTITION BY action ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM audit_log) WHERE i = least(n - 1, floor(0.9 * n)) GROUP BY 1"))
def floor_percentiles(c):
    return verification.floor_percentile(c.audit_log, "action", "value", 0.9, "p90")


@query(with_tables("""SELECT action, count(*) AS requests, count(*) FILTER (value < 5) AS failures, count(*) FILTER (document_id % 7 = 0) AS empty_results, round(quantile_cont(value, 0.5), 6) AS median_ms,
    max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END) AS p95_ms, round(avg(value), 6) AS mean_ms FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY action) AS n FROM audit_log) GROUP BY 1"""))
def request_summary(c):
    r = c.audit_log.select("action", F.col("value").alias("ms"), F.when(F.col("value") < 5, 500).otherwise(200).alias("status"), (F.col("document_id") % 7 == 0).alias("empty"))
    means = verification.observations(r, "action", "ms").select("action", F.round("mean", 6).alias("mean_ms"))
    return verification.request_summary(r, "action").withColumn("median_ms", F.round("median_ms", 6)).join(means, "action")


@query(with_tables("""SELECT (SELECT count(*) FROM jobs j JOIN d ON d.id = j.document_id WHERE status IN ('pending', 'processing')) AS jobs, (SELECT count(*) FROM jobs j JOIN d ON d.id = j.document_id WHERE status = 'error') AS error,
    (SELECT count(DISTINCT k.document_id) FROM chunks k JOIN d ON d.id = k.document_id WHERE k.version <> d.version) AS inconsistent, (SELECT count(*) FROM d WHERE embedding_status <> 'ready') AS not_ready""", d="SELECT * FROM docs WHERE title LIKE 'Title 1%'"))
def unfinished_work(c):
    return verification.unfinished(c.documents, c.jobs, c.chunks, "Title 1")


@query(with_tables("SELECT node, CASE WHEN name = '미분류' OR (SELECT count(*) FROM s) <= 20 OR name IN (SELECT name FROM s WHERE name <> '미분류' ORDER BY size DESC, name LIMIT 18) THEN name ELSE '기타' END AS name FROM a", a="SELECT id AS node, coalesce(folder_id, '미분류') AS name FROM docs", s="SELECT name, count(*) AS size FROM a GROUP BY 1"))
def folded_clusters(c):
    return analytics.fold_clusters(c.documents.select(F.col("id").alias("node"), F.coalesce("folder_id", F.lit(analytics.UNCATEGORIZED)).alias("name")))


@query(with_tables("SELECT id AS document_id, 'extract' AS kind FROM docs d WHERE extraction_status = 'pending' AND NOT EXISTS (SELECT 1 FROM before b WHERE b.id = d.id AND b.extraction_status = 'pending')", before=BEFORE))
def extract_jobs(c):
    return changes.derive_extract_jobs(_before(c), c.documents, c.jobs)


@query(with_tables("SELECT id AS document_id, CASE WHEN extraction_status = 'failed' THEN 'recognition_failed' WHEN extraction_status = 'pending' THEN 'extracting' WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = docs.id AND kind = 'embed' AND status = 'pending') THEN 'waiting' ELSE 'queued' END AS result FROM docs"))
def reembed_requests(c):
    return changes.reembed(c.documents, c.jobs)


@query(with_tables("SELECT document_id, version, CASE WHEN version % 3 <> 0 THEN 'user' || (document_id % 7) END AS author, CASE WHEN version % 3 = 0 THEN 'worker' WHEN version % 3 = 1 THEN author_via ELSE 'direct' END AS author_via FROM versions"))
def version_authors(c):
    turn = F.col("version") % 3
    v = c.versions.select("document_id", "version", F.when(turn == 0, "extraction").alias("source"), F.concat(F.lit("user"), F.col("document_id") % 7).alias("actor"), F.when(turn == 1, F.col("author_via")).alias("via"))
    return changes.version_authors(v)


@query(with_tables("""SELECT document_id, CASE WHEN extraction_status <> 'done' THEN 'not_extracted' WHEN p IS NULL THEN 'no_version' WHEN document_id % 5 = 0 THEN 'conflict' WHEN p = content_hash THEN 'unchanged' ELSE 'applied' END AS result,
    CASE WHEN extraction_status = 'done' AND p IS NOT NULL AND document_id % 5 <> 0 AND p <> content_hash AND trim(content, E' \\t\\r\\n\\f') <> '' THEN 2 ELSE 1 END AS version
    FROM (SELECT d.id AS document_id, d.content, d.extraction_status, d.content_hash, sha256(v.content) AS p FROM docs d LEFT JOIN versions v ON v.document_id = d.id AND v.version = 2)"""))
def restore_requests(c):
    i = F.col("id")
    return changes.restore_results(c.documents, c.versions, c.documents.select(i.alias("document_id"), F.lit(2).alias("wanted"), F.when(i % 5 == 0, 7).otherwise(1).alias("client_version")))


@query(with_tables("""SELECT 'edge_kind_unknown' AS rule, (SELECT count(*) FROM edges WHERE kind NOT IN ('overlaps', 'related') OR (kind = 'overlaps' AND src % 3 = 0)) AS violations
    UNION ALL SELECT 'grantees_not_one', (SELECT count(*) FROM document_grants WHERE CAST(user_id IS NOT NULL AS INT) + CAST(group_id IS NOT NULL AS INT) + CAST(share_id IS NOT NULL AS INT) <> 1)
    UNION ALL SELECT 'preview_ready_without_pdf', (SELECT count(*) FROM converted WHERE (status = 'ready') <> (pdf_sha256 IS NOT NULL AND document_id % 5 <> 0))
    UNION ALL SELECT 'outage_out_of_order', (SELECT count(*) FROM audit_log WHERE NOT (document_id <= value * 10 AND value * 10 <= document_id + 50))
    UNION ALL SELECT 'audit_row_changed', (SELECT count(*) FROM audit_log WHERE id % 50 IN (3, 4))
    UNION ALL SELECT 'department_without_membership', (SELECT count(*) FROM (SELECT 'user' || (c_custkey % 7) AS u, c_mktsegment AS g FROM customer WHERE c_custkey % 3 <> 0) WHERE (u, g) NOT IN (SELECT (user_id, group_id) FROM members))
    UNION ALL SELECT 'department_with_folders', (SELECT count(*) FROM (SELECT 1 FROM folders WHERE right(id, 1) IN ('1', '2') GROUP BY right(id, 1) HAVING count(*) > 1))
    UNION ALL SELECT 'department_folder_below_top', (SELECT count(*) FROM folders WHERE right(id, 1) IN ('1', '2') AND parent_id IS NOT NULL)
    UNION ALL SELECT 'job_without_document', (SELECT count(*) FROM jobs WHERE document_id NOT IN (SELECT id FROM kept))
    UNION ALL SELECT 'edge_without_document', (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM kept)) UNION ALL SELECT 'link_without_document', (SELECT count(*) FROM links WHERE id NOT IN (SELECT id FROM kept))
    UNION ALL SELECT 'file_without_document', (SELECT count(*) FROM files WHERE document_id NOT IN (SELECT id FROM kept)) UNION ALL SELECT 'grant_without_document', (SELECT count(*) FROM document_grants WHERE document_id NOT IN (SELECT id FROM kept))""",
    links=LINKS, kept="SELECT id FROM docs WHERE id % 6 <> 1", **GRAPH, **STORE))
def integrity_violations(c):
    """The rules over tables in which some are broken: every sixth document is gone, and values are changed by id."""
    last = F.substring("id", -1, 1)
    log = c.audit_log.select("id", "actor", "action")
    changed = log.where("id % 50 <> 4").withColumn("actor", F.when(F.col("id") % 50 == 3, "someone else").otherwise(F.col("actor")))
    users = c.table("customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("user"), F.col("c_custkey") % 7).alias("user_id"), F.col("c_mktsegment").alias("group_id"))
    return validators.integrity(
        c.documents.where("id % 6 <> 1"), c.edges.withColumn("kind", F.when((F.col("kind") == "overlaps") & (F.col("src") % 3 == 0), "like").otherwise(F.col("kind"))), c.document_grants,
        _converted(c).withColumn("pdf_sha256", F.when(F.col("document_id") % 5 != 0, F.col("pdf_sha256"))),
        c.audit_log.select(F.col("document_id").alias("last_ok_at"), (F.col("value") * 10).alias("first_failure_at"), (F.col("document_id") + 50).alias("recovered_at")), (log, changed),
        (users, c.members, c.folders.select("id", "parent_id", F.when(last.isin("1", "2"), last).alias("group_id"))),
        {"job": c.jobs, "edge": c.edges.withColumnRenamed("src", "document_id"), "link": search.wikilinks(c.linked_text).withColumnRenamed("id", "document_id"), "file": _files(c), "grant": c.document_grants},
    )


@query(with_tables("SELECT id, CASE WHEN n = 1 THEN stem || '.md' ELSE stem || ' (' || n || ').md' END AS name, length(content) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY created_at, CAST(id AS VARCHAR)) AS n FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'Note_' ELSE 'nOTE_' END || (id % 20) AS stem FROM docs WHERE owner_id = 'user1' AND extraction_status = 'done'))"))
def export_files(c):
    """What an export of one owner's documents writes; titles collide but for case."""
    title = F.concat(F.when(F.col("id") % 3 == 0, " .Note?").otherwise("nOTE/"), F.col("id") % 20)
    out = sinks.export(c.documents.withColumn("title", title), USER)
    return out.select("id", "name", F.length(F.regexp_replace("body", r"(?s)^---\n.*?\n---\n", "")).cast("long").alias("chars"))


@query()
def version_hunks(c):
    """The lines of each version that differ from the one before, with three lines around them."""
    new = c.versions.select(F.struct("document_id", "version").alias("id"), F.col("content").alias("new"))
    old = c.versions.select(F.struct("document_id", (F.col("version") + 1).alias("version")).alias("id"), F.col("content").alias("old"))
    pairs = cut_lineage(new.join(old, "id"))
    return diffs.hunk_lines(diffs.hunks(text.diff_versions(pairs)), pairs).select("id.document_id", "id.version", "hunk", "place", "line", "op", "text")


SENT = "SELECT 'T' || id AS title, id % 13 <> 0 AS ok, content_hash AS sha256, CASE WHEN id % 4 = 0 THEN content_hash END AS file_sha256, id FROM docs WHERE id % 19 <> 6"
KEPT = """SELECT 'T' || id AS title, CASE WHEN id % 17 = 3 THEN 'x' ELSE content_hash END AS stored, sha256(CASE WHEN id % 23 = 8 THEN content || 'x' ELSE content END) AS computed, CASE WHEN id % 31 = 5 THEN 2 ELSE 1 END AS version, id, content_hash, n
    FROM docs, (SELECT unnest([1, 2]) AS n) WHERE id % 9 <> 2 AND (n = 1 OR id % 29 = 3)"""


@query(with_tables("""SELECT 'lost' AS class, title FROM sent WHERE ok AND title NOT IN (SELECT title FROM stored) UNION ALL SELECT DISTINCT 'mismatched', s.title FROM sent s JOIN stored k USING (title) WHERE ok AND (k.stored <> s.sha256 OR k.computed <> s.sha256)
    UNION ALL SELECT DISTINCT 'ghost', s.title FROM sent s JOIN stored USING (title) WHERE NOT ok UNION ALL SELECT 'duplicate', title FROM stored GROUP BY title HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown', title FROM stored WHERE title NOT IN (SELECT title FROM sent)
    UNION ALL SELECT DISTINCT 'file_mismatched', s.title FROM sent s JOIN stored k USING (title) WHERE ok AND file_sha256 IS NOT NULL AND k.id % 8 = 4 UNION ALL SELECT DISTINCT 'version_drift', s.title FROM sent s JOIN stored k USING (title) WHERE ok AND version <> 1""", sent=SENT, stored=KEPT))
def reconcile_ledger(c):
    """A ledger of uploads against stored rows, whose texts are hashed again; some are lost, doubled, changed or refused."""
    i, title = F.col("id"), F.concat(F.lit("T"), "id")
    sent = c.documents.where("id % 19 <> 6").select(title.alias("title"), (i % 13 != 0).alias("ok"), F.col("content_hash").alias("sha256"), F.when(i % 4 == 0, F.col("content_hash")).alias("file_sha256"))
    twice = c.documents.where("id % 9 <> 2").withColumn("n", F.explode(F.when(i % 29 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    file = lambda n: F.struct(F.lit(n).alias("file_version"), F.col("content_hash").alias("stored"), F.col("content_hash").alias("recomputed"))
    stored = twice.select(
        title.alias("title"), F.when(i % 17 == 3, "x").otherwise(F.col("content_hash")).alias("stored"), F.sha2(F.encode(F.when(i % 23 == 8, F.concat("content", F.lit("x"))).otherwise(F.col("content")), "UTF-8"), 256).alias("recomputed"),
        F.when(i % 31 == 5, 2).otherwise(1).alias("version"), F.when(i % 8 == 4, F.array(file(1), file(2))).otherwise(F.array(file(1))).alias("files"),
    )
    return verification.reconcile(sent, stored)


POINTS = {
    "s1": "SELECT id, content_hash AS h, 1 AS v, embedding_status AS e FROM docs WHERE id % 7 <> 0",
    "mid": "SELECT id, CASE WHEN id % 17 = 2 THEN 'x' WHEN id % 2 = 0 THEN 'new' ELSE content_hash END AS h, CASE WHEN id % 19 = 0 THEN 9 ELSE 1 END AS v, embedding_status AS e FROM docs WHERE id % 14 <> 3 UNION ALL SELECT -1, 'h', 1, 'ready'",
    "s2": "SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE content_hash END AS h, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS v, 'ready' AS e FROM docs",
}


@query(with_tables("""SELECT a.id, 'missing' AS problem FROM s1 a JOIN s2 USING (id) WHERE id NOT IN (SELECT id FROM mid) UNION ALL SELECT id, 'extra' FROM mid WHERE id NOT IN (SELECT id FROM s1) AND id NOT IN (SELECT id FROM s2)
    UNION ALL SELECT id, unnest(list_filter([CASE WHEN a.h = b.h AND m.h <> b.h THEN 'content_hash' END, CASE WHEN a.v = b.v AND m.v <> b.v THEN 'version' END, CASE WHEN a.e = b.e AND m.e <> b.e THEN 'embedding_status' END], lambda x: x IS NOT NULL)) FROM s1 a JOIN mid m USING (id) JOIN s2 b USING (id)""", **POINTS))
def snapshot_between(c):
    """Whether a restored state lies between two others, document by document and field by field."""
    i, h = F.col("id"), F.col("content_hash")
    fields = ["content_hash", "version", "embedding_status"]
    changed = F.when(i % 2 == 0, "new").otherwise(h)
    one = c.documents.where("id % 7 <> 0").select("id", *fields)
    back = c.documents.where("id % 14 <> 3").select("id", F.when(i % 17 == 2, "x").otherwise(changed).alias("content_hash"), F.when(i % 19 == 0, 9).otherwise(1).alias("version"), "embedding_status")
    extra = back.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("h").alias("content_hash"), F.lit(1).alias("version"), F.lit("ready").alias("embedding_status"))
    two = c.documents.select("id", changed.alias("content_hash"), F.when(i % 4 == 0, 2).otherwise(1).alias("version"), F.lit("ready").alias("embedding_status"))
    return verification.between(one, back.unionByName(extra), two, fields, key="id")


@query(with_tables("""SELECT id, status FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'done' ELSE a END AS status, a, CASE WHEN id % 3 = 0 THEN 'done' ELSE a END AS b FROM (SELECT id, min(status) AS a FROM jobs GROUP BY 1)) WHERE
    CASE WHEN a IN ('pending', 'processing', 'done') AND b IN ('pending', 'processing', 'done') THEN list_position(['pending', 'processing', 'done'], a) <= list_position(['pending', 'processing', 'done'], b)
        AND NOT coalesce(list_position(['pending', 'processing', 'done'], status) BETWEEN list_position(['pending', 'processing', 'done'], a) AND list_position(['pending', 'processing', 'done'], b), false) ELSE status NOT IN (a, b) END"""))
def restored_jobs(c):
    """Jobs of a restored state whose status is off the path between two others."""
    jobs = c.jobs.groupBy("id").agg(F.min("status").alias("status"))  # an id stands for one job
    state = lambda status: jobs.select("id", status.alias("status"))
    i, own = F.col("id"), F.col("status")
    return verification.jobs_between(state(own), state(F.when(i % 5 == 0, "done").otherwise(own)), state(F.when(i % 3 == 0, "done").otherwise(own)))


UPLOADED = """SELECT id AS document_id, CASE WHEN id % 5 = 0 THEN content_hash WHEN id % 5 = 1 THEN sha256(content || 'x') ELSE 'new' || id END AS sha256, CASE WHEN id % 7 = 2 THEN '  ' WHEN id % 7 = 3 THEN content ELSE content || ' more' END AS fresh, id % 4 = 2 AS needs_ocr, 1 + CASE WHEN id % 9 = 4 THEN 1 ELSE 0 END AS client_version FROM docs
    UNION ALL SELECT -5, 'x', 'x', false, 1"""


@query(with_tables("""SELECT document_id, result, version + CASE WHEN result = 'replaced' AND NOT needs_ocr AND sha256(fresh) <> content_hash AND trim(content, E' \\t\\r\\n') <> '' THEN 1 ELSE 0 END AS version, CASE WHEN result = 'replaced' THEN coalesce(newest, 0) + 1 ELSE newest END AS file_version,
    CASE WHEN result = 'replaced' THEN CASE WHEN needs_ocr THEN 'pending' ELSE 'done' END ELSE extraction_status END AS extraction_status FROM (SELECT u.*, d.version, d.content_hash, d.content, d.extraction_status, f.newest, CASE WHEN d.id IS NULL THEN 'missing' WHEN d.version <> client_version THEN 'conflict'
    WHEN f.bytes IS NOT DISTINCT FROM u.sha256 THEN 'unchanged' WHEN NOT needs_ocr AND trim(fresh) = '' THEN 'unreadable' ELSE 'replaced' END AS result FROM uploaded u LEFT JOIN docs d ON d.id = u.document_id LEFT JOIN (SELECT document_id, max(file_version) AS newest, arg_max(sha256, file_version) AS bytes FROM files GROUP BY 1) f ON f.document_id = u.document_id)""", **STORE, uploaded=UPLOADED))
def replace_originals(c):
    """New files for all documents: some are the bytes that are there, some made from an older version, some blank, some to be recognised."""
    i = F.col("id")
    own = c.documents.select(
        i.alias("document_id"), F.lit("f").alias("filename"), F.when(i % 5 == 0, F.col("content_hash")).when(i % 5 == 1, F.sha2(F.encode(F.concat("content", F.lit("x")), "UTF-8"), 256)).otherwise(F.concat(F.lit("new"), "id")).alias("sha256"),
        F.when(i % 7 == 2, "  ").when(i % 7 == 3, F.col("content")).otherwise(F.concat("content", F.lit(" more"))).alias("content"), (i % 4 == 2).alias("needs_ocr"), (1 + (i % 9 == 4).cast("int")).alias("client_version"),
    )
    gone = own.limit(1).select(F.lit(-5).cast("long").alias("document_id"), F.lit("f").alias("filename"), F.lit("x").alias("sha256"), F.lit("x").alias("content"), F.lit(False).alias("needs_ocr"), F.lit(1).alias("client_version"))
    return files.replace_originals(c.documents, _files(c), own.unionByName(gone)).select("document_id", "result", "version", "file_version", "extraction_status")


@query(with_tables("""SELECT 'row' AS what, document_id, file_version FROM files f WHERE lower(split_part(filename, '.', 2)) IN ('hwp', 'hwpx', 'docx', 'xlsx', 'pptx') AND (document_id, file_version) NOT IN (SELECT (document_id, file_version) FROM converted)
    UNION ALL SELECT DISTINCT 'job', document_id, NULL FROM files f WHERE lower(split_part(filename, '.', 2)) IN ('hwp', 'hwpx', 'docx', 'xlsx', 'pptx') AND (document_id, file_version) NOT IN (SELECT (document_id, file_version) FROM converted) AND document_id NOT IN (SELECT document_id FROM jobs WHERE kind = 'preview' AND status = 'pending')""", **STORE))
def preview_work(c):
    """Preview rows and jobs to add for files that have none."""
    rows, jobs = extraction.preview_work(_files(c), _converted(c), c.jobs)
    return rows.select(F.lit("row").alias("what"), "document_id", "file_version").unionByName(jobs.select(F.lit("job").alias("what"), "document_id", F.lit(None).cast("int").alias("file_version")))


@query(with_tables("SELECT d.id, array_to_string(list_sort(list_distinct([lang, source, 'x'])), ',') AS tags FROM documents JOIN docs d ON d.id = doc_id"))
def cleaned_tags(c):
    """Tags without blanks around them, blank ones and repeats."""
    from docloom.functions.columns import clean_tags

    raw = c.table("documents").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.concat("source", F.lit(" ")), "lang", F.lit("x")).alias("t"))
    return raw.select("id", F.array_join(F.array_sort(clean_tags("t")), ",").alias("tags"))


@query(with_tables("""SELECT 'document' AS what, CAST(id AS VARCHAR) AS id, CASE owner_id WHEN 'user1' THEN 'user2' ELSE owner_id END AS holder FROM docs UNION ALL SELECT 'folder', id, CASE created_by WHEN 'user1' THEN 'user2' ELSE created_by END FROM folders
    UNION ALL SELECT 'grant', CAST(document_id AS VARCHAR), coalesce(user_id, group_id) FROM document_grants g WHERE NOT coalesce(user_id = 'user1', false) AND NOT coalesce(user_id = 'user2' AND EXISTS (SELECT 1 FROM docs d WHERE d.id = g.document_id AND d.owner_id IN ('user1', 'user2')), false)
    UNION ALL SELECT 'member', group_id, user_id FROM members WHERE user_id <> 'user1'"""))
def deleted_user(c):
    """Who holds what after a user is gone and another one has taken over."""
    left = changes.delete_user(c.documents, c.folders, c.document_grants, c.members, "user1", "user2")
    return (
        left["documents"].select(F.lit("document").alias("what"), F.col("id").cast("string").alias("id"), F.col("owner_id").alias("holder")).unionByName(left["folders"].select(F.lit("folder").alias("what"), "id", F.col("created_by").alias("holder")))
        .unionByName(left["grants"].select(F.lit("grant").alias("what"), F.col("document_id").cast("string").alias("id"), F.coalesce("user_id", "group_id").alias("holder"))).unionByName(left["members"].select(F.lit("member").alias("what"), F.col("group_id").alias("id"), F.col("user_id").alias("holder")))
    )


@query(with_tables("""SELECT conv_id AS key, CAST(i AS BIGINT) AS place, k.document_id, k.version, k.chunk_index, k.content FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(range(4)) AS i) JOIN chunks k ON k.document_id = conv_id + i AND k.version = 1 + i AND k.chunk_index = i"""))
def chunks_at(c):
    """The chunks at places that each row names by three arrays."""
    n = F.array(*map(F.lit, range(4)))
    asked = c.table("conversations").select(F.col("conv_id").alias("key")).distinct().select("key", F.transform(n, lambda x: F.col("key") + x).alias("ids"), F.transform(n, lambda x: (x + 1).cast("long")).alias("versions"), F.transform(n, lambda x: x.cast("long")).alias("indexes"))
    return passages.chunks_at(c.chunks, asked).withColumn("place", F.col("place").cast("long"))
