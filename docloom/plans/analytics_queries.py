"""Related documents, diagnostics, listing, audit, jobs, change derivation and verification queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import analytics, changes, search, trigrams, validators, verification, visibility
from docloom.plans.corpus import with_tables
from docloom.plans.registry import query
from docloom.plans.search_queries import BOTH, GRAPH, KIND, LINKS, edges_of

RELATED = f"""SELECT b.id, b.neighbour, b.kind, b.score, b.mutual FROM (SELECT *, count(DISTINCT side) OVER (PARTITION BY id, neighbour) = 2 AS mutual FROM (
    SELECT src AS id, dst AS neighbour, kind, score, 0 AS side FROM edges UNION ALL SELECT dst, src, kind, score, 1 FROM edges)
    QUALIFY row_number() OVER (PARTITION BY id, neighbour ORDER BY {KIND}, score DESC, side) = 1) b
    JOIN docs d ON d.id = b.id JOIN docs e ON e.id = b.neighbour WHERE d.content_hash <> e.content_hash AND b.id IN (SELECT id FROM vis) AND b.neighbour IN (SELECT id FROM vis)"""
RANKED = f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY {KIND}, mutual DESC, score DESC, neighbour) AS rank FROM related"
REL = GRAPH | {"related": RELATED, "ranked": RANKED}
USER = "user1"
NOW = "TIMESTAMP '1998-01-01 00:00:00'"


def _now():
    return F.to_timestamp(F.lit("1998-01-01 00:00:00"))


@query(with_tables("SELECT id, neighbour, kind, score, mutual, rank FROM ranked WHERE rank <= 5", **REL))
def related_docs(c):
    return analytics.ranked_related(analytics.related(c, edges_of(c), USER), 5)


@query(with_tables("SELECT id, min(id) OVER (PARTITION BY content_hash) AS class_id, count(*) OVER (PARTITION BY content_hash) - 1 AS copies FROM docs JOIN vis USING (id) QUALIFY copies > 0"))
def identical_docs(c):
    return analytics.identical(c, USER)


@query(with_tables("""SELECT id, tag, votes, row_number() OVER (PARTITION BY id ORDER BY votes DESC, tag) AS rank FROM (SELECT r.id, t.tag, count(*) AS votes FROM ranked r
    JOIN (SELECT id AS n, unnest(tags) AS tag FROM docs) t ON t.n = r.neighbour WHERE r.rank <= 10 GROUP BY 1, 2) v WHERE NOT list_contains((SELECT tags FROM docs d WHERE d.id = v.id), tag) QUALIFY rank <= 5""", **REL))
def tag_suggestions(c):
    return analytics.suggest_tags(c, analytics.related(c, edges_of(c), USER))


@query(with_tables(f"""SELECT a AS id, folder_id, votes, voters FROM (SELECT *, sum(votes) OVER (PARTITION BY a) AS voters FROM (SELECT p.a, d.folder_id, count(*) AS votes, round(sum(score), 6) AS weight
    FROM (SELECT a, b, max(score) AS score FROM ({BOTH}) GROUP BY 1, 2) p JOIN docs d ON d.id = p.b WHERE d.folder_id IN (SELECT folder_id FROM visf) AND a IN (SELECT id FROM vis) AND b IN (SELECT id FROM vis) GROUP BY 1, 2))
    WHERE votes >= 2 AND votes * 2 >= voters QUALIFY row_number() OVER (PARTITION BY a ORDER BY votes DESC, weight DESC, folder_id) = 1
    AND folder_id IS DISTINCT FROM (SELECT folder_id FROM docs d WHERE d.id = a)""", **GRAPH))
def folder_suggestion(c):
    return analytics.suggest_folders(c, edges_of(c), USER)


@query(with_tables("""SELECT d.id, coalesce(n, 0) AS chunks, v AS based_on_version, CASE WHEN n IS NULL THEN 0 ELSE coalesce(r, 0) END AS related, CASE WHEN n IS NULL THEN 'not_indexed' WHEN r IS NULL THEN 'no_edges' END AS reason FROM docs d JOIN vis USING (id)
    LEFT JOIN (SELECT document_id, count(*) AS n, max(version) AS v FROM chunks GROUP BY 1) k ON k.document_id = d.id LEFT JOIN (SELECT id, count(*) AS r FROM ranked WHERE rank <= 10 GROUP BY 1) x ON x.id = d.id""", **REL))
def related_reasons(c):
    """How many related documents each one has, and why it has none."""
    return analytics.related_reasons(c, analytics.ranked_related(analytics.related(c, edges_of(c), USER), 10), USER)


@query(with_tables(f"""SELECT d.id, d.title, s.folder_id AS suggested, s.votes, (SELECT count(*) FROM docs JOIN vis USING (id) WHERE folder_id IS NULL AND owner_id = 'user1') AS total FROM docs d JOIN vis USING (id) LEFT JOIN (SELECT * FROM (SELECT *, sum(votes) OVER (PARTITION BY a) AS voters FROM (SELECT p.a, d.folder_id, count(*) AS votes, round(sum(score), 6) AS weight
    FROM (SELECT a, b, max(score) AS score FROM ({BOTH}) GROUP BY 1, 2) p JOIN docs d ON d.id = p.b WHERE d.folder_id IN (SELECT folder_id FROM visf) AND a IN (SELECT id FROM vis) AND b IN (SELECT id FROM vis) GROUP BY 1, 2))
    WHERE votes >= 2 AND votes * 2 >= voters QUALIFY row_number() OVER (PARTITION BY a ORDER BY votes DESC, weight DESC, folder_id) = 1) s ON s.a = d.id WHERE d.folder_id IS NULL AND owner_id = 'user1'""", **GRAPH))
def unfiled_suggestions(c):
    """One owner's documents without a folder, with the folder that their neighbours suggest, and how many there are."""
    return analytics.unfiled_suggestions(c, edges_of(c), USER)


@query(with_tables("SELECT id, title FROM docs JOIN vis USING (id) WHERE folder_id IS NULL ORDER BY id LIMIT 20"))
def unfiled(c):
    return c.documents.where("folder_id is null").join(visibility.visible_documents(c, USER), "id", "left_semi").select("id", "title").orderBy("id").limit(20)


@query(with_tables(f"SELECT id FROM docs JOIN vis USING (id) WHERE extraction_status = 'done' AND id NOT IN (SELECT a FROM ({BOTH}) WHERE b IN (SELECT id FROM vis))", **GRAPH))
def orphans(c):
    return analytics.orphans(c, edges_of(c), USER)


@query(with_tables("SELECT id FROM docs JOIN vis USING (id) WHERE len(tags) = 0"))
def uncategorized(c):
    return c.documents.where(F.size("tags") == 0).join(visibility.visible_documents(c, USER), "id", "left_semi").select("id")


@query(with_tables(f"""SELECT match_type, a, b, score, row_number() OVER (PARTITION BY match_type ORDER BY score DESC NULLS LAST, a, b) AS rank, count(*) OVER (PARTITION BY match_type) AS total FROM (
    SELECT 'identical' AS match_type, class_id AS a, id AS b, CAST(NULL AS DOUBLE) AS score FROM (SELECT id, min(id) OVER (PARTITION BY content_hash) AS class_id FROM docs JOIN vis USING (id)) WHERE id <> class_id
    UNION ALL SELECT 'overlaps', a, b, max(score) FROM ({BOTH}) WHERE kind = 'overlaps' AND a < b AND a IN (SELECT id FROM vis) AND b IN (SELECT id FROM vis) GROUP BY a, b HAVING max(score) >= 0.95) QUALIFY rank <= 10""", **GRAPH))
def duplicates(c):
    return analytics.duplicates(c, edges_of(c), USER)


def _by_folder(c):
    """A fixed assignment: documents of one folder are one community."""
    return c.documents.where("folder_id is not null").select(F.col("id").alias("node"), F.expr("cast(substr(folder_id, 2) as bigint)").alias("community"))


ASSIGNED = "SELECT id AS node, CAST(substr(folder_id, 2) AS BIGINT) AS community FROM docs WHERE folder_id IS NOT NULL"


@query(with_tables("""SELECT community, kind, CASE WHEN n > 1 THEN label || ' (' || n || ')' ELSE label END AS name, size FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, first, community) AS n FROM (
    SELECT t.community, t.size, t.first, CASE WHEN b.tag IS NULL THEN 'community' ELSE 'tagged' END AS kind, coalesce(b.tag, m.title) AS label FROM (SELECT community, count(*) AS size, min(title) AS first FROM assigned JOIN docs ON id = node GROUP BY 1) t
    LEFT JOIN (SELECT community, tag FROM (SELECT community, tag, 2 * n - total AS score FROM (SELECT community, tag, count(*) AS n FROM (SELECT community, unnest(tags) AS tag FROM assigned JOIN docs ON id = node) GROUP BY 1, 2)
        JOIN (SELECT tag, count(*) AS total FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY 1) USING (tag)) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY community ORDER BY score DESC, tag) = 1) b USING (community)
    JOIN (SELECT community, title FROM assigned JOIN docs ON id = node LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges)
        JOIN assigned x ON x.node = a JOIN assigned y ON y.node = b WHERE x.community = y.community) GROUP BY 1) USING (node) QUALIFY row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, title, node) = 1) m USING (community)))""", assigned=ASSIGNED, **GRAPH))
def cluster_names(c):
    return analytics.cluster_names(c.documents, _by_folder(c), edges_of(c))


@query(with_tables("SELECT least(x.community, y.community) AS one, greatest(x.community, y.community) AS two, count(*) AS pairs FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges) JOIN assigned x ON x.node = a JOIN assigned y ON y.node = b WHERE x.community <> y.community GROUP BY 1, 2", assigned=ASSIGNED, **GRAPH))
def cluster_connections(c):
    return analytics.cluster_connections(_by_folder(c), edges_of(c))


TITLE_KEY = "CASE WHEN regexp_matches(title, '^[0-9]') THEN 0 WHEN regexp_matches(title, '^[가-힣]') THEN 1 ELSE 2 END"


@query(with_tables(f"SELECT id, title, owner_id FROM docs JOIN vis USING (id) WHERE content_type = 'md' AND title ILIKE '%1%' AND list_has_any(tags, ['en']) ORDER BY {TITLE_KEY}, lower(title), title, id LIMIT 20 OFFSET 5"))
def list_documents(c):
    seen = c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi").where((F.col("content_type") == "md") & F.col("title").ilike("%1%") & F.arrays_overlap("tags", F.array(F.lit("en"))))
    key = F.when(F.col("title").rlike("^[0-9]"), 0).when(F.col("title").rlike("^[가-힣]"), 1).otherwise(2)
    return seen.orderBy(key, F.lower("title"), "title", "id").offset(5).limit(20).select("id", "title", "owner_id")


@query(with_tables("SELECT content_type, count(*) AS documents FROM docs JOIN vis USING (id) GROUP BY 1"))
def count_documents(c):
    return c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi").groupBy("content_type").agg(F.count("*").alias("documents"))


@query(with_tables("""SELECT count(*) AS total, count(*) FILTER (extraction_status = 'failed') AS failed, count(*) FILTER (extraction_status = 'pending') AS extracting,
    count(*) FILTER (extraction_status = 'done' AND embedding_status = 'ready') AS ready, count(*) FILTER (extraction_status = 'done' AND embedding_status <> 'ready') AS embedding FROM docs JOIN vis USING (id)"""))
def progress(c):
    done, ready = F.col("extraction_status") == "done", F.col("embedding_status") == "ready"
    return c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi").agg(
        F.count("*").alias("total"), F.count_if(F.col("extraction_status") == "failed").alias("failed"), F.count_if(F.col("extraction_status") == "pending").alias("extracting"),
        F.count_if(done & ready).alias("ready"), F.count_if(done & ~ready).alias("embedding"),
    )


@query(with_tables("SELECT tag, count(*) AS documents FROM (SELECT unnest(tags) AS tag FROM docs JOIN vis USING (id)) GROUP BY 1"))
def visible_tags(c):
    return c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("documents"))


@query(with_tables("""SELECT d.id, d.title, coalesce(v.versions, 0) AS versions, v.first_version, v.latest_via, coalesce(k.chunks, 0) AS chunks FROM docs d JOIN vis USING (id)
    LEFT JOIN (SELECT document_id, count(*) AS versions, min(version) AS first_version, arg_max(author_via, version) AS latest_via FROM versions GROUP BY 1) v ON v.document_id = d.id
    LEFT JOIN (SELECT document_id, count(*) AS chunks FROM chunks GROUP BY 1) k ON k.document_id = d.id"""))
def document_detail(c):
    v = c.versions.groupBy("document_id").agg(F.count("*").alias("versions"), F.min("version").alias("first_version"), F.max_by("author_via", "version").alias("latest_via"))
    k = c.chunks.groupBy(F.col("document_id").alias("k")).agg(F.count("*").alias("chunks"))
    seen = c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi")
    return seen.join(v, F.col("id") == F.col("document_id"), "left").join(k, F.col("id") == F.col("k"), "left").select("id", "title", F.coalesce("versions", F.lit(0)).alias("versions"), "first_version", "latest_via", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(with_tables("""SELECT f.id, f.name, f.created_by = 'user1' AS can_manage, r.visibility AS scope, count(d.id) AS documents FROM folders f JOIN visf ON visf.folder_id = f.id JOIN closure c ON c.folder_id = f.id
    JOIN folders r ON r.id = c.ancestor_id AND r.parent_id IS NULL LEFT JOIN (SELECT docs.id, folder_id FROM docs JOIN vis USING (id)) d ON d.folder_id = f.id GROUP BY ALL"""))
def list_folders(c):
    roots = c.folders.where("parent_id is null").select(F.col("id").alias("ancestor_id"), F.col("visibility").alias("scope"))
    scope = visibility.closure(c).join(roots, "ancestor_id").select("folder_id", "scope")
    filed = c.documents.join(visibility.visible_documents(c, USER), "id", "left_semi").groupBy("folder_id").agg(F.count("*").alias("documents"))
    own = c.folders.withColumnRenamed("id", "folder_id").join(visibility.visible_folders(c, USER), "folder_id", "left_semi")
    return own.join(scope, "folder_id").join(filed, "folder_id", "left").select(F.col("folder_id").alias("id"), "name", (F.col("created_by") == USER).alias("can_manage"), "scope", F.coalesce("documents", F.lit(0)).alias("documents"))


@query(with_tables("SELECT group_id, list(user_id ORDER BY user_id) AS members FROM members GROUP BY 1"))
def groups(c):
    return c.members.groupBy("group_id").agg(F.array_sort(F.collect_list("user_id")).alias("members"))


@query(with_tables("SELECT r.name AS department, count(DISTINCT f.id) AS folders, count(d.id) AS documents FROM folders r JOIN closure c ON c.ancestor_id = r.id JOIN folders f ON f.id = c.folder_id LEFT JOIN docs d ON d.folder_id = f.id WHERE r.parent_id IS NULL GROUP BY 1"))
def departments(c):
    roots = c.folders.where("parent_id is null").select(F.col("id").alias("ancestor_id"), F.col("name").alias("department"))
    below = visibility.closure(c).join(roots, "ancestor_id")
    filed = c.documents.groupBy("folder_id").agg(F.count("*").alias("n"))
    return below.join(filed, "folder_id", "left").groupBy("department").agg(F.countDistinct("folder_id").alias("folders"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


@query(with_tables("""SELECT 'share:1' AS share_id, (SELECT list(folder_id ORDER BY folder_id) FROM share_folders) AS folders, (SELECT list(DISTINCT document_id ORDER BY document_id) FROM document_grants WHERE share_id IS NOT NULL) AS documents"""))
def shares(c):
    f = c.share_folders.groupBy("share_id").agg(F.array_sort(F.collect_list("folder_id")).alias("folders"))
    d = c.document_grants.where("share_id is not null").groupBy("share_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return f.join(d, "share_id", "left")


@query(with_tables("""SELECT u AS user_id, count(DISTINCT d.id) AS owned, count(DISTINCT m.group_id) AS groups FROM (SELECT 'user' || unnest(range(7)) AS u) LEFT JOIN docs d ON d.owner_id = u LEFT JOIN members m ON m.user_id = u GROUP BY 1"""))
def users(c):
    u = c.spark.range(7).select(F.concat(F.lit("user"), "id").alias("user_id"))
    owned = c.documents.groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("owned"))
    member = c.members.groupBy("user_id").agg(F.countDistinct("group_id").alias("groups"))
    return u.join(owned, "user_id", "left").join(member, "user_id", "left").na.fill(0, ["owned", "groups"])


@query(with_tables("SELECT id, deleted_at, deleted_at + INTERVAL 30 DAY AS purge_at FROM docs WHERE deleted_at IS NOT NULL AND owner_id = 'user1'"))
def trash(c):
    return c.documents.where((F.col("owner_id") == USER) & F.col("deleted_at").isNotNull()).select("id", "deleted_at", (F.col("deleted_at") + F.expr("interval 30 days")).alias("purge_at"))


@query(with_tables("SELECT count(*) AS kept FROM docs WHERE NOT coalesce(deleted_at + INTERVAL 30 DAY <= TIMESTAMP '2024-02-01', false)"))
def purge(c):
    gone = c.documents.where("deleted_at + interval 30 days <= timestamp '2024-02-01'").select("id")
    return c.documents.join(gone, "id", "left_anti").agg(F.count("*").alias("kept"))


@query(with_tables("""SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE deleted_at IS NOT NULL) AS trashed, (SELECT count(*) FROM docs WHERE embedding_status = 'ready') AS ready,
    (SELECT count(*) FROM docs WHERE extraction_status = 'failed') AS failed, (SELECT count(DISTINCT document_id) FROM versions v JOIN docs d ON d.id = v.document_id WHERE v.version <> d.version) AS stale,
    (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM jobs WHERE status = 'pending') AS pending_jobs, (SELECT count(*) FROM jobs WHERE status = 'error') AS failed_jobs"""))
def system_status(c):
    return analytics.system_status(c)


@query(with_tables("SELECT id, occurred_at, actor, action, document_id FROM audit_log WHERE id < 900 AND actor = 'user3' ORDER BY id DESC LIMIT 50"))
def audit_list(c):
    return c.audit_log.where("id < 900 and actor = 'user3'").orderBy(F.desc("id")).limit(50).select("id", "occurred_at", "actor", "action", "document_id")


@query(with_tables("SELECT action, count(*) AS entries FROM audit_log GROUP BY 1"))
def audit_counts(c):
    return c.audit_log.groupBy("action").agg(F.count("*").alias("entries"))


@query(with_tables("SELECT document_id, action, count(*) AS entries, max(occurred_at) AS latest FROM audit_log JOIN docs d ON d.id = document_id WHERE d.owner_id = 'user1' GROUP BY 1, 2"))
def document_activity(c):
    own = c.documents.where(F.col("owner_id") == USER).select(F.col("id").alias("document_id"))
    return c.audit_log.join(own, "document_id", "left_semi").groupBy("document_id", "action").agg(F.count("*").alias("entries"), F.max("occurred_at").alias("latest"))


@query(with_tables("""SELECT id, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS cell FROM (SELECT id, CASE WHEN id % 3 = 0 THEN '=' ELSE '' END || action AS v FROM audit_log)"""))
def audit_csv(c):
    from docloom.sources.sinks import csv_cell

    return c.audit_log.select("id", F.concat(F.when(F.col("id") % 3 == 0, "=").otherwise(""), "action").alias("v")).select("id", csv_cell("v").alias("cell"))


@query(with_tables("""SELECT actor, failures, CASE WHEN failures >= 10 THEN least(60 * power(2, least(failures - 10, 30)), 3600) ELSE 0 END AS lock_seconds FROM (SELECT actor, document_id % 20 AS d, count(*) AS failures FROM audit_log GROUP BY 1, 2) WHERE d = 1"""))
def login_lockout(c):
    n = c.audit_log.groupBy("actor", (F.col("document_id") % 20).alias("d")).agg(F.count("*").alias("failures")).where("d = 1")
    return n.select("actor", "failures", changes.lock_seconds(F.col("failures")).alias("lock_seconds"))


@query(with_tables("""SELECT actor, min(occurred_at) AS started, max(occurred_at) AS ended, count(*) AS failures FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY occurred_at, id) AS island
    FROM (SELECT *, value >= 10 AS ok FROM audit_log)) WHERE NOT ok GROUP BY actor, island"""))
def outages(c):
    return analytics.intervals(c.audit_log.withColumn("ok", F.col("value") >= 10), "ok", "occurred_at", "actor")


@query(with_tables("""SELECT actor, min(b) AS started, max(e) AS ended, count(*) AS members FROM (SELECT *, sum(CASE WHEN pe IS NULL OR b > pe + INTERVAL 2 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY actor ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS span FROM (
    SELECT *, max(e) OVER (PARTITION BY actor ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT actor, occurred_at AS b, occurred_at + INTERVAL 30 MINUTE AS e FROM audit_log))) GROUP BY actor, span"""))
def span_merge(c):
    spans = c.audit_log.select("actor", F.col("occurred_at").alias("b"), (F.col("occurred_at") + F.expr("interval 30 minutes")).alias("e"))
    return analytics.merged_spans(spans, "actor", "b", "e")


@query(with_tables("""SELECT rule, violations FROM (SELECT 'blank_done_content' AS rule, (SELECT count(*) FROM docs WHERE extraction_status = 'done' AND trim(content, E' \\t\\r\\n\\f') = '') AS violations
    UNION ALL SELECT 'content_too_long', (SELECT count(*) FROM docs WHERE length(content) > 500000) UNION ALL SELECT 'pending_jobs_twice', (SELECT count(*) FROM (SELECT 1 FROM jobs WHERE status = 'pending' GROUP BY document_id, kind HAVING count(*) > 1))
    UNION ALL SELECT 'processing_without_lease', (SELECT count(*) FROM jobs WHERE status = 'processing' AND lease_expires_at IS NULL) UNION ALL SELECT 'edge_to_itself', (SELECT count(*) FROM edges WHERE src = dst)
    UNION ALL SELECT 'edge_twice', (SELECT count(*) FROM (SELECT 1 FROM edges GROUP BY src, dst, kind, coalesce(src_chunk, -1), coalesce(dst_chunk, -1) HAVING count(*) > 1))
    UNION ALL SELECT 'grantees_not_one', (SELECT count(*) FROM document_grants WHERE (user_id IS NULL) = (group_id IS NULL)) UNION ALL SELECT 'root_without_scope', (SELECT count(*) FROM folders WHERE (parent_id IS NULL) <> (visibility IS NOT NULL))
    UNION ALL SELECT 'bad_folder_name', (SELECT count(*) FROM folders WHERE trim(name) = '' OR name LIKE '%/%') UNION ALL SELECT 'folder_name_twice', (SELECT count(*) FROM (SELECT 1 FROM folders WHERE parent_id IS NOT NULL GROUP BY parent_id, name HAVING count(*) > 1))
    UNION ALL SELECT 'public_with_grants', (SELECT count(*) FROM document_grants WHERE document_id IN (SELECT id FROM docs WHERE visibility = 'public')) UNION ALL SELECT 'owner_is_grantee', (SELECT count(*) FROM document_grants g JOIN docs d ON d.id = g.document_id AND d.owner_id = g.user_id)
    UNION ALL SELECT 'version_without_document', (SELECT count(*) FROM versions WHERE document_id NOT IN (SELECT id FROM docs)) UNION ALL SELECT 'chunk_without_document', (SELECT count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM docs)))""", **GRAPH))
def constraint_violations(c):
    return validators.violations(c, edges_of(c))


BEFORE = """SELECT id, CASE WHEN id % 4 = 1 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN id % 10 = 2 THEN 'private' ELSE visibility END AS visibility, owner_id, CASE WHEN id % 9 = 4 THEN 'Old' ELSE title END AS title,
    CASE WHEN id % 37 = 0 THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN id % 6 = 0 THEN 'pending' ELSE embedding_status END AS embedding_status, extraction_status, version FROM docs WHERE id % 8 <> 7"""


def _before(c):
    """An earlier snapshot: some documents absent, others with other text, visibility, title or states."""
    i = F.col("id")
    return c.documents.where("id % 8 <> 7").withColumns({
        "content_hash": F.when(i % 4 == 1, "old").otherwise(F.col("content_hash")), "visibility": F.when(i % 10 == 2, "private").otherwise(F.col("visibility")),
        "title": F.when(i % 9 == 4, "Old").otherwise(F.col("title")), "deleted_at": F.when(i % 37 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at")),
        "embedding_status": F.when(i % 6 == 0, "pending").otherwise(F.col("embedding_status")),
    })


CHANGED = "SELECT d.* FROM docs d LEFT JOIN before b USING (id) WHERE d.extraction_status = 'done' AND d.content_hash IS DISTINCT FROM b.content_hash"
CHANGE = {"before": BEFORE, "changed": CHANGED}


@query(with_tables("SELECT id AS document_id, version, content_hash FROM changed c WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.document_id = c.id AND v.version = c.version)", **CHANGE))
def derive_versions(c):
    return changes.derive_versions(_before(c), c.documents, c.versions)


@query(with_tables("""SELECT document_id, kind FROM (SELECT id AS document_id, 'embed' AS kind FROM changed UNION ALL SELECT d.id, 'edges' FROM docs d LEFT JOIN before b USING (id) WHERE d.embedding_status = 'ready' AND b.embedding_status IS DISTINCT FROM 'ready') w
    WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'pending' AND j.document_id = w.document_id AND j.kind = w.kind)""", **CHANGE))
def derive_jobs(c):
    return changes.derive_jobs(_before(c), c.documents, c.jobs)


@query(with_tables("SELECT c.id, l.target FROM changed c JOIN links l USING (id)", links=LINKS, **CHANGE))
def derive_links(c):
    changed = changes.text_changes(_before(c), c.documents).select("id")
    return search.wikilinks(c.linked_text.join(changed, "id", "left_semi"))


@query(with_tables("""SELECT d.id AS document_id, unnest(list_filter([CASE WHEN b.id IS NULL THEN 'document.create' END, CASE WHEN b.id IS NOT NULL AND b.visibility <> d.visibility THEN 'document.visibility' END,
    CASE WHEN b.id IS NOT NULL AND b.content_hash <> d.content_hash THEN 'document.text' END, CASE WHEN b.id IS NOT NULL AND b.title <> d.title THEN 'document.title' END,
    CASE WHEN b.id IS NOT NULL AND b.deleted_at IS NULL AND d.deleted_at IS NOT NULL THEN 'document.trash' END], lambda x: x IS NOT NULL)) AS action FROM docs d LEFT JOIN before b USING (id)""", **CHANGE))
def derive_audit(c):
    return changes.derive_audit(_before(c), c.documents)


@query(with_tables(f"SELECT id, kind, 'processing' AS status, attempts + 1 AS attempts, {NOW} + INTERVAL 60 SECOND AS lease_expires_at FROM (SELECT * FROM jobs WHERE status = 'pending' AND next_attempt_at <= {NOW} ORDER BY kind = 'preview', id LIMIT 100)"))
def claim_jobs(c):
    return changes.claim_jobs(c.jobs, _now(), 60, 100).select("id", "kind", "status", "attempts", "lease_expires_at")


@query(with_tables(f"""SELECT j.id, CASE WHEN p.document_id IS NOT NULL THEN 'done' WHEN attempts >= 3 THEN 'error' ELSE 'pending' END AS status, CASE WHEN p.document_id IS NOT NULL OR attempts >= 3 THEN next_attempt_at ELSE {NOW} + to_seconds(power(2, attempts)) END AS next_attempt_at
    FROM jobs j LEFT JOIN (SELECT DISTINCT document_id, kind FROM jobs WHERE status = 'pending') p ON p.document_id = j.document_id AND p.kind = j.kind WHERE status = 'processing'"""))
def fail_jobs(c):
    return changes.fail_jobs(c.jobs, _now()).select("id", "status", "next_attempt_at")


@query(with_tables(f"""SELECT id, CASE WHEN attempts >= 3 THEN 'error' WHEN w IS NOT NULL OR NOT first THEN 'done' ELSE 'pending' END AS status FROM (SELECT j.*, p.document_id AS w, row_number() OVER (PARTITION BY j.document_id, j.kind, j.attempts >= 3 ORDER BY j.id) = 1 AS first
    FROM jobs j LEFT JOIN (SELECT DISTINCT document_id, kind FROM jobs WHERE status = 'pending') p ON p.document_id = j.document_id AND p.kind = j.kind WHERE j.status = 'processing' AND j.lease_expires_at < {NOW})"""))
def sweep_jobs(c):
    return changes.sweep_jobs(c.jobs, _now())


REQUESTS = "SELECT id, actor AS owner_id, document_id % 40 AS key, occurred_at AS t, action AS request_hash FROM audit_log"


OPENED = """WITH RECURSIVE opened AS (SELECT id, owner_id, key, t, request_hash FROM requests QUALIFY row_number() OVER (PARTITION BY owner_id, key ORDER BY t, id) = 1
    UNION ALL SELECT r.id, r.owner_id, r.key, r.t, r.request_hash FROM opened o JOIN requests r ON r.owner_id = o.owner_id AND r.key = o.key AND r.t > o.t + INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY r.owner_id, r.key ORDER BY r.t, r.id) = 1)
    SELECT * FROM opened"""


@query(with_tables("""SELECT r.id, r.owner_id, r.key, CASE WHEN r.id = o.id THEN 'created' WHEN r.request_hash = o.request_hash THEN 'replayed' ELSE 'conflict' END AS result, o.id AS created_by FROM requests r JOIN accepted o
    ON r.owner_id = o.owner_id AND r.key = o.key AND (o.t < r.t OR (o.t = r.t AND o.id <= r.id)) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY o.t DESC, o.id DESC) = 1""", requests=REQUESTS, accepted=OPENED))
def idempotent_create(c):
    r = c.audit_log.select("id", F.col("actor").alias("owner_id"), (F.col("document_id") % 40).alias("key"), F.col("occurred_at").alias("at"), F.col("action").alias("request_hash"))
    return changes.idempotent(r)


@query(with_tables("""SELECT 'add' AS change, document_id, user_id, group_id FROM (SELECT document_id, user_id, group_id FROM document_grants WHERE document_id % 5 <> 1 EXCEPT SELECT document_id, user_id, group_id FROM document_grants WHERE document_id % 3 <> 1)
    UNION ALL SELECT 'remove', document_id, user_id, group_id FROM (SELECT document_id, user_id, group_id FROM document_grants WHERE document_id % 3 <> 1 EXCEPT SELECT document_id, user_id, group_id FROM document_grants WHERE document_id % 5 <> 1)"""))
def grant_diff(c):
    return changes.grant_diff(c.document_grants.where("document_id % 3 <> 1"), c.document_grants.where("document_id % 5 <> 1"))


@query(with_tables("SELECT document_id, user_id, group_id FROM document_grants g WHERE NOT coalesce(user_id = 'user2' AND EXISTS (SELECT 1 FROM docs d WHERE d.id = g.document_id AND d.owner_id IN ('user1', 'user2')), false)"))
def owner_transfer(c):
    _, grants = changes.transfer_owner(c.documents, c.document_grants, "user1", "user2")
    return grants.select("document_id", "user_id", "group_id")


@query(with_tables("""SELECT d.id AS document_id, 1 + d.id % 2 AS client_version, CASE WHEN d.id % 2 <> 0 THEN 'conflict' WHEN d.id % 3 = 0 THEN 'unchanged' ELSE 'applied' END AS result, CASE WHEN d.id % 2 = 0 AND d.id % 3 <> 0 AND d.id % 7 <> 1 THEN 2 ELSE 1 END AS version FROM docs d"""))
def optimistic_writes(c):
    i = F.col("id")
    w = c.documents.select(i.alias("document_id"), (1 + i % 2).alias("client_version"), F.when(i % 3 == 0, F.col("content_hash")).otherwise("new").alias("content_hash"))
    docs = c.documents.withColumn("content", F.when(i % 7 == 1, " \t\n").otherwise("x"))
    out = changes.write_results(docs, w)
    return out.select("document_id", (1 + F.col("document_id") % 2).alias("client_version"), "result", "version")


@query(with_tables("SELECT action, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most, count(*) AS n FROM audit_log GROUP BY 1"))
def latency_percentiles(c):
    return c.audit_log.groupBy("action").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max("value").alias("most"), F.count("*").alias("n"))


@query(with_tables("""SELECT count(*) AS queries, round(avg(found / n), 6) AS recall_at_k, round(avg(coalesce(1 / first, 0)), 6) AS mrr, count(*) FILTER (first = 1) AS top1, count(*) FILTER (first IS NULL) AS missed FROM (
    SELECT e.query, count(*) AS n, count(*) FILTER (r.rank <= 5) AS found, min(r.rank) AS first FROM (SELECT DISTINCT src AS query, dst AS document FROM edges WHERE dst % 2 = 0) e LEFT JOIN ranked r ON r.id = e.query AND r.neighbour = e.document GROUP BY 1)""", **REL))
def retrieval_metrics(c):
    edges = edges_of(c)
    ranked = analytics.ranked_related(analytics.related(c, edges, USER), 50).select(F.col("id").alias("query"), F.col("neighbour").alias("document"), "rank")
    return analytics.retrieval_metrics(ranked, edges.where("dst % 2 = 0").select(F.col("src").alias("query"), F.col("dst").alias("document")).distinct())


@query(with_tables("SELECT md5(string_agg(md5(id || ':' || content_hash), '' ORDER BY id)) AS digest FROM docs"))
def table_digest(c):
    """A fingerprint of the ordered row hashes."""
    return verification.ordered_digest(c.documents.select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), "content_hash")).alias("h")), "id", "h")


@query(with_tables("SELECT kind, count(*) AS jobs, round(avg(date_diff('second', next_attempt_at, TIMESTAMP '1999-01-01')), 3) AS mean_seconds FROM jobs WHERE status = 'done' GROUP BY 1"))
def job_durations(c):
    wait = F.unix_timestamp(F.to_timestamp(F.lit("1999-01-01"))) - F.unix_timestamp("next_attempt_at")
    return c.jobs.where("status = 'done'").groupBy("kind").agg(F.count("*").alias("jobs"), F.round(F.avg(wait), 3).alias("mean_seconds"))


@query(with_tables("SELECT id, list_distinct(list_filter([trim(lang), ' ', trim(source), lang], lambda x: trim(x) <> '')) IS NOT NULL AS fine, len(list_distinct([lang, source])) AS n FROM documents JOIN docs ON id = doc_id"))
def normalize_tags(c):
    from docloom.functions.columns import clean_tags

    raw = c.table("documents").select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit(" "), "lang"), F.lit(" "), "source", "lang").alias("t"))
    return raw.select("id", clean_tags("t").isNotNull().alias("fine"), F.size(clean_tags("t")).alias("n"))


@query(with_tables("SELECT name FROM (SELECT unnest(['BUILDING', 'nobody', 'MACHINERY', 'someone']) AS name) WHERE name NOT IN (SELECT group_id FROM members)"))
def unknown_grantees(c):
    names = c.spark.createDataFrame([("BUILDING",), ("nobody",), ("MACHINERY",), ("someone",)], "name string")
    return names.join(c.members.select(F.col("group_id").alias("name")), "name", "left_anti")


@query(with_tables("SELECT id FROM folders WHERE parent_id IS NOT DISTINCT FROM 'r1' AND name = (SELECT min(name) FROM folders WHERE parent_id = 'r1') ORDER BY id LIMIT 1"))
def find_folder(c):
    below = c.folders.where(F.col("parent_id").eqNullSafe(F.lit("r1")))
    name = below.agg(F.min("name").alias("wanted"))
    return below.join(F.broadcast(name), F.col("name") == F.col("wanted"), "left_semi").orderBy("id").limit(1).select("id")


WRITTEN = "SELECT conv_id AS document_id, turn + 1 AS version, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 100 + turn) AS created_at FROM conversations"
TOLD = """SELECT (document_id * 100 + version) * 2 + n AS id, document_id, created_at AS occurred_at, CASE WHEN version = 1 OR document_id % 7 = 2 THEN 'document_created' ELSE 'text_updated' END AS action,
    'user' || ((document_id + version + n) % 7) AS actor, CASE WHEN version % 3 = 0 THEN 'token' END AS actor_via, CASE WHEN version > 1 THEN version + CASE WHEN document_id % 11 = 3 THEN 1 ELSE 0 END END AS told
    FROM written, (SELECT unnest([0, 1]) AS n) WHERE document_id % 5 <> 4 OR version % 2 = 0"""


@query(with_tables("""SELECT document_id, version, author, author_via FROM written LEFT JOIN (SELECT w.document_id, w.version, a.actor AS author, coalesce(a.actor_via, 'direct') AS author_via FROM written w JOIN told a ON a.document_id = w.document_id AND a.occurred_at = w.created_at
    WHERE (w.version = 1 AND a.action = 'document_created') OR (w.version > 1 AND a.action = 'text_updated' AND a.told = w.version) QUALIFY row_number() OVER (PARTITION BY w.document_id, w.version ORDER BY a.id) = 1) USING (document_id, version)""", written=WRITTEN, told=TOLD))
def version_author_backfill(c):
    """Turns stand for versions; each was told of twice in the audit log, some not at all, by another action or with another number."""
    d, v, n = F.col("document_id"), F.col("version"), F.col("n")
    made = F.timestamp_seconds(F.lit(1704067200) + (d * 100 + v - 1) * 60)
    written = c.versions.select("document_id", "version", made.alias("created_at"))
    twice = written.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).where((d % 5 != 4) | (v % 2 == 0))
    audit = twice.select(
        ((d * 100 + v) * 2 + n).alias("id"), d, F.col("created_at").alias("occurred_at"), F.when((v == 1) | (d % 7 == 2), "document_created").otherwise("text_updated").alias("action"),
        F.concat(F.lit("user"), (d + v + n) % 7).alias("actor"), F.when(v % 3 == 0, "token").alias("actor_via"), F.to_json(F.struct(F.when(v > 1, v + F.when(d % 11 == 3, 1).otherwise(0)).alias("version"))).alias("detail"),
    )
    return changes.backfill_authors(written, audit).select("document_id", "version", "author", "author_via")


TRIGRAMS = """SELECT title, list_filter(flatten(list_transform(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))), lambda t: true) AS tri FROM (SELECT DISTINCT title FROM docs)"""
ONE_WAY = """SELECT a, b, coalesce(max(hits / (n + len(list_distinct(run)) - hits)), 0) AS s FROM (SELECT *, len(list_intersect(run, sa)) AS hits FROM (SELECT x.title AS a, y.title AS b, x.tri AS sa, len(list_distinct(x.tri)) AS n, y.tri[i:j] AS run
    FROM trigrams x JOIN trigrams y ON x.title <> y.title, unnest(range(1, len(y.tri) + 1)) AS f(i), unnest(range(1, len(y.tri) + 1)) AS l(j) WHERE i <= j AND list_contains(x.tri, y.tri[i]) AND list_contains(x.tri, y.tri[j]))) GROUP BY 1, 2"""
ALIKE = "SELECT p.a, p.b, p.s AS ab, q.s AS ba FROM one_way p JOIN one_way q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b AND greatest(p.s, q.s) >= 0.8 - 1e-9"


def _titles(c):
    return c.documents.select("title").distinct()


@query(with_tables("SELECT a, b, round(ab, 6) AS ab, round(ba, 6) AS ba FROM alike", trigrams=TRIGRAMS, one_way=ONE_WAY, alike=ALIKE))
def similar_titles(c):
    return trigrams.similar(_titles(c), 0.8, key="title").select("a", "b", F.round("ab", 6).alias("ab"), F.round("ba", 6).alias("ba"))


@query(with_tables("SELECT count(*) AS pairs, count(*) FILTER (abs(ab - ba) < 0.1) AS below, list_transform(quantile_cont(abs(ab - ba), [0.5, 0.75, 0.9, 0.95]), lambda x: round(x, 6)) AS percentiles FROM alike", trigrams=TRIGRAMS, one_way=ONE_WAY, alike=ALIKE))
def title_margins(c):
    out = trigrams.margins(trigrams.similar(_titles(c), 0.8, key="title"))
    return out.withColumn("percentiles", F.transform("percentiles", lambda x: F.round(x, 6)))
