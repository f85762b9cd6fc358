"""Audit rows between two snapshots of all watched tables, and what is asked of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import analytics, audit, visibility
from docloom.plans.corpus import with_tables
from docloom.plans.registry import query

SHARED = {"share_name": "Partner", "share_owner": "user1"}


def snapshots(c) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The given tables as they are, but for some rows, and an earlier state made from them: rows are missing and values differ by id."""
    i = F.col("id")
    names = c.folders.select(F.col("id").alias("f"), F.col("name").alias("folder_name"))
    docs = c.documents.select("id", "title", "visibility", "follows_folder", "folder_id", "deleted_at", "owner_id")
    named = lambda df: df.join(names, F.col("folder_id") == F.col("f"), "left").drop("f")
    earlier = docs.where("id % 8 <> 7").withColumns({
        "visibility": F.when(i % 10 == 2, "private").otherwise(F.col("visibility")), "follows_folder": F.when(i % 9 == 1, ~F.col("follows_folder")).otherwise(F.col("follows_folder")),
        "folder_id": F.when(i % 12 == 5, "n0").otherwise(F.col("folder_id")), "owner_id": F.when(i % 13 == 4, "user0").otherwise(F.col("owner_id")), "title": F.concat("title", F.lit(" (old)")),
        "deleted_at": F.when(i % 37 == 0, F.lit(None).cast("timestamp")).when(i % 41 == 1, F.to_timestamp(F.lit("2024-01-01"))).otherwise(F.col("deleted_at")),
    })
    grants = c.document_grants.select("document_id", "user_id", "group_id").distinct()
    shared = c.document_grants.where("share_id is not null").select("document_id", "share_id", *(F.lit(v).alias(k) for k, v in SHARED.items())).distinct()
    folders = c.folders
    odd = F.substring("id", -1, 1).isin("2", "4")
    token = c.table("customer").select(F.col("c_custkey").alias("token_id"), F.concat(F.lit("user"), F.col("c_custkey") % 7).alias("owner"), F.col("c_name").alias("token_name"), F.when(F.col("c_nationkey") % 2 == 0, "read").otherwise("write").alias("scope"), F.when(F.col("c_nationkey") % 3 == 0, "2024-01-01").alias("expires_at"))
    share_token = token.select("token_id", F.lit("share:1").alias("share_id"), *(F.lit(v).alias(k) for k, v in SHARED.items()), "token_name")
    users = c.table("nation").select(F.concat(F.lit("user"), "n_nationkey").alias("username"), F.col("n_name").alias("password_hash"), (F.col("n_nationkey") % 2 == 0).alias("is_admin"), F.concat(F.lit("d"), "n_regionkey").alias("department"), F.col("n_nationkey").alias("n"))
    folder_grants = c.folder_grants.join(names, F.col("folder_id") == F.col("f")).drop("f")
    versions = c.versions.select("document_id", "version")
    before = {
        "documents": named(earlier), "versions": versions.where("document_id % 4 <> 1"), "files": versions.where("version % 2 = 1").withColumnRenamed("version", "file_version"),
        "grants": grants.where("document_id % 3 <> 1"), "shared_documents": shared.where("document_id % 4 <> 3"), "members": c.members.where("user_id <> 'user2'"), "managers": c.members.where("user_id = 'user3'"),
        "folders": folders.where("id <> 'n7'").withColumns({"name": F.when(odd, F.concat(F.lit("Old "), "name")).otherwise(F.col("name")), "visibility": F.when(F.col("visibility") == "private", "public").otherwise(F.col("visibility")), "created_by": F.when(odd, "user9").otherwise(F.col("created_by"))}),
        "folder_grants": folder_grants.where("folder_id <> 'r1'"), "share_folders": c.share_folders.where("false").select("share_id", "folder_id", *(F.lit(v).alias(k) for k, v in SHARED.items()), F.lit("").alias("folder_name")),
        "shares": c.share_folders.select(F.lit("share:0").alias("share_id"), *(F.lit(v).alias(k) for k, v in SHARED.items())), "share_tokens": share_token.where("token_id % 100 = 1"), "tokens": token.where("token_id % 7 <> 1"),
        "users": users.withColumns({"password_hash": F.when(F.col("n") % 5 == 0, "x").otherwise(F.col("password_hash")), "is_admin": F.col("n") % 3 == 0, "department": F.when(F.col("n") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("department"))}),
    }
    after = {
        "documents": named(docs.where("id % 23 <> 9")), "versions": versions, "files": versions.withColumnRenamed("version", "file_version"), "grants": grants.where("document_id % 5 <> 1"), "shared_documents": shared.where("document_id % 6 <> 1"),
        "members": c.members.where("user_id <> 'user5'"), "managers": c.members.where("user_id = 'user4'"), "folders": folders.where("id <> 'n3'"), "folder_grants": folder_grants.where("folder_id <> 'r2'"),
        "share_folders": c.share_folders.join(names, F.col("folder_id") == F.col("f")).select("share_id", "folder_id", *(F.lit(v).alias(k) for k, v in SHARED.items()), "folder_name"),
        "shares": c.share_folders.select("share_id", *(F.lit(v).alias(k) for k, v in SHARED.items())), "share_tokens": share_token.where("token_id % 100 = 2"), "tokens": token.where("token_id % 5 <> 2"), "users": users,
    }
    return before, after


SNAP = {
    "own": "SELECT d.id, title, d.visibility, follows_folder, folder_id, deleted_at, owner_id, f.name AS folder_name FROM docs d LEFT JOIN folders f ON f.id = d.folder_id",
    "was": """SELECT d.*, f.name AS folder_name FROM (SELECT id, title || ' (old)' AS title, CASE WHEN id % 10 = 2 THEN 'private' ELSE visibility END AS visibility, CASE WHEN id % 9 = 1 THEN NOT follows_folder ELSE follows_folder END AS follows_folder,
        CASE WHEN id % 12 = 5 THEN 'n0' ELSE folder_id END AS folder_id, CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 1 THEN TIMESTAMP '2024-01-01' ELSE deleted_at END AS deleted_at, CASE WHEN id % 13 = 4 THEN 'user0' ELSE owner_id END AS owner_id FROM docs WHERE id % 8 <> 7) d LEFT JOIN folders f ON f.id = d.folder_id""",
    "now": "SELECT * FROM own WHERE id % 23 <> 9",
    "g": "SELECT DISTINCT document_id, user_id, group_id FROM document_grants",
    "s": "SELECT DISTINCT document_id, share_id FROM document_grants WHERE share_id IS NOT NULL",
    "fold": "SELECT *, CASE WHEN id <> 'n7' THEN CASE WHEN right(id, 1) IN ('2', '4') THEN 'Old ' || name ELSE name END END AS old_name, CASE WHEN visibility = 'private' THEN 'public' ELSE visibility END AS old_visibility, CASE WHEN right(id, 1) IN ('2', '4') THEN 'user9' ELSE created_by END AS old_created FROM folders",
    "tok": "SELECT c_custkey AS id, 'user' || (c_custkey % 7) AS owner, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'read' ELSE 'write' END AS scope, CASE WHEN c_nationkey % 3 = 0 THEN '2024-01-01' END AS expires_at FROM customer",
    "usr": "SELECT 'user' || n_nationkey AS u, n_nationkey AS n, 'd' || n_regionkey AS dep FROM nation",
    "events_made": """SELECT 'document_created' AS action, id AS document_id, '{}' AS detail FROM now WHERE id NOT IN (SELECT id FROM was)
        UNION ALL SELECT 'document_deleted', id, '{}' FROM was WHERE id NOT IN (SELECT id FROM now)
        UNION ALL SELECT 'access_changed', n.id, json_object('kind', 'visibility', 'before', w.visibility, 'after', n.visibility) FROM now n JOIN was w USING (id) WHERE n.visibility <> w.visibility
        UNION ALL SELECT 'access_changed', n.id, json_object('kind', 'inherit', 'before', CASE WHEN w.follows_folder THEN 'folder' ELSE 'own' END, 'after', CASE WHEN n.follows_folder THEN 'folder' ELSE 'own' END) FROM now n JOIN was w USING (id) WHERE n.follows_folder <> w.follows_folder
        UNION ALL SELECT 'access_changed', n.id, json_object('kind', 'folder', 'before', w.folder_name, 'after', n.folder_name) FROM now n JOIN was w USING (id) WHERE n.follows_folder AND n.folder_id IS DISTINCT FROM w.folder_id
        UNION ALL SELECT 'document_trashed', n.id, '{}' FROM now n JOIN was w USING (id) WHERE w.deleted_at IS NULL AND n.deleted_at IS NOT NULL
        UNION ALL SELECT 'document_restored', n.id, '{}' FROM now n JOIN was w USING (id) WHERE w.deleted_at IS NOT NULL AND n.deleted_at IS NULL
        UNION ALL SELECT 'owner_changed', n.id, json_object('kind', 'document', 'before', w.owner_id, 'after', n.owner_id) FROM now n JOIN was w USING (id) WHERE n.owner_id <> w.owner_id
        UNION ALL SELECT 'text_updated', document_id, json_object('version', version) FROM versions WHERE document_id % 4 = 1 AND version > 1
        UNION ALL SELECT 'original_replaced', document_id, json_object('file_version', version) FROM versions WHERE version % 2 = 0
        UNION ALL SELECT 'access_changed', document_id, json_object('kind', 'grant', 'change', 'added', 'grantee_type', CASE WHEN user_id IS NULL THEN 'group' ELSE 'user' END, 'grantee', coalesce(user_id, group_id)) FROM g WHERE document_id % 5 <> 1 AND document_id % 3 = 1
        UNION ALL SELECT 'access_changed', document_id, json_object('kind', 'grant', 'change', 'removed', 'grantee_type', CASE WHEN user_id IS NULL THEN 'group' ELSE 'user' END, 'grantee', coalesce(user_id, group_id)) FROM g WHERE document_id % 5 = 1 AND document_id % 3 <> 1 AND document_id IN (SELECT id FROM now)
        UNION ALL SELECT 'share_changed', document_id, json_object('change', 'document_added', 'share_id', share_id, 'share_name', 'Partner', 'owner', 'user1') FROM s WHERE document_id % 4 = 3 AND document_id % 6 <> 1
        UNION ALL SELECT 'share_changed', document_id, json_object('change', 'document_removed', 'share_id', share_id, 'share_name', 'Partner', 'owner', 'user1') FROM s WHERE document_id % 4 <> 3 AND document_id % 6 = 1 AND document_id IN (SELECT id FROM now)
        UNION ALL SELECT 'group_member_changed', NULL, json_object('change', CASE user_id WHEN 'user2' THEN 'added' ELSE 'removed' END, 'group', group_id, 'user', user_id) FROM members WHERE user_id IN ('user2', 'user5')
        UNION ALL SELECT 'group_changed', NULL, json_object('change', CASE user_id WHEN 'user4' THEN 'manager_added' ELSE 'manager_removed' END, 'group', group_id, 'user', user_id) FROM members WHERE user_id IN ('user3', 'user4')
        UNION ALL SELECT 'folder_changed', NULL, json_object('change', CASE id WHEN 'n7' THEN 'created' ELSE 'deleted' END, 'folder_id', id, 'folder_name', coalesce(CASE WHEN id = 'n3' THEN old_name END, name), 'parent_id', parent_id) FROM fold WHERE id IN ('n7', 'n3')
        UNION ALL SELECT 'folder_changed', NULL, json_object('change', 'renamed', 'folder_id', id, 'folder_name', name, 'parent_id', parent_id, 'old_name', old_name) FROM fold WHERE id NOT IN ('n7', 'n3') AND old_name <> name
        UNION ALL SELECT 'folder_access_changed', NULL, json_object('kind', 'visibility', 'folder_id', id, 'folder_name', name, 'before', old_visibility, 'after', visibility) FROM fold WHERE visibility <> old_visibility
        UNION ALL SELECT 'owner_changed', NULL, json_object('kind', 'folder', 'folder_id', id, 'folder_name', name, 'before', old_created, 'after', created_by) FROM fold WHERE id NOT IN ('n7', 'n3') AND old_created <> created_by
        UNION ALL SELECT 'folder_access_changed', NULL, json_object('kind', 'grant', 'change', CASE folder_id WHEN 'r1' THEN 'added' ELSE 'removed' END, 'grantee_type', CASE WHEN user_id IS NULL THEN 'group' ELSE 'user' END, 'grantee', coalesce(user_id, group_id), 'folder_id', folder_id, 'folder_name', name)
            FROM folder_grants JOIN folders ON id = folder_id WHERE folder_id IN ('r1', 'r2')
        UNION ALL SELECT 'share_changed', NULL, json_object('change', 'folder_added', 'share_id', share_id, 'share_name', 'Partner', 'owner', 'user1', 'folder_id', folder_id, 'folder_name', name) FROM share_folders JOIN folders ON id = folder_id
        UNION ALL SELECT 'share_changed', NULL, json_object('change', c, 'share_id', i, 'share_name', 'Partner', 'owner', 'user1') FROM (VALUES ('created', 'share:1'), ('deleted', 'share:0')) AS x(c, i)
        UNION ALL SELECT 'share_changed', NULL, json_object('change', CASE id % 100 WHEN 2 THEN 'token_issued' ELSE 'token_revoked' END, 'share_id', 'share:1', 'share_name', 'Partner', 'owner', 'user1', 'token_name', name) FROM tok WHERE id % 100 IN (1, 2)
        UNION ALL SELECT 'token_changed', NULL, json_object('change', CASE WHEN id % 7 = 1 THEN 'issued' ELSE 'revoked' END, 'owner', owner, 'token_name', name, 'scope', scope, 'expires_at', expires_at) FROM tok WHERE (id % 7 = 1) <> (id % 5 = 2)
        UNION ALL SELECT 'password_changed', NULL, json_object('user', u) FROM usr WHERE n % 5 = 0
        UNION ALL SELECT 'user_changed', NULL, json_object('change', CASE WHEN n % 2 = 0 THEN 'admin_granted' ELSE 'admin_revoked' END, 'user', u) FROM usr WHERE (n % 2 = 0) <> (n % 3 = 0)
        UNION ALL SELECT 'user_changed', NULL, json_object('change', 'department_changed', 'user', u, 'from', NULL, 'to', dep) FROM usr WHERE n % 4 = 0""",
    "told_rows": "SELECT e.action, e.document_id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE w.title END AS document_title, CAST(e.detail AS VARCHAR) AS detail FROM events_made e LEFT JOIN now n ON n.id = e.document_id LEFT JOIN was w ON w.id = e.document_id",
}


@query(with_tables("SELECT * FROM told_rows", **SNAP))
def snapshot_audit(c):
    return audit.derive(*snapshots(c))


@query(with_tables("SELECT json_extract_string(detail, '$.kind') AS kind, json_extract_string(detail, '$.change') AS change, action, count(*) AS entries, count(DISTINCT json_extract_string(detail, '$.folder_id')) AS folders FROM told_rows GROUP BY 1, 2, 3", **SNAP))
def audit_details(c):
    """Entries by what their details say."""
    told = audit.derive(*snapshots(c))
    part = lambda name: F.get_json_object("detail", f"$.{name}")
    return told.groupBy(part("kind").alias("kind"), part("change").alias("change"), "action").agg(F.count("*").alias("entries"), F.countDistinct(part("folder_id")).alias("folders"))


@query(with_tables("SELECT DISTINCT action, document_id, document_title, detail FROM told_rows WHERE action IN ('owner_changed', 'folder_changed', 'access_changed') AND (document_title ILIKE '%an%' OR document_title ILIKE '%TLE 12%' OR json_extract_string(detail, '$.folder_name') ILIKE '%an%' OR json_extract_string(detail, '$.folder_name') ILIKE '%TLE 12%')", **SNAP))
def audit_search(c):
    """Rows of some actions whose title or folder holds a text."""
    told = audit.derive(*snapshots(c)).where(F.col("action").isin("owner_changed", "folder_changed", "access_changed"))
    return audit.entries(told, q="an").unionByName(audit.entries(told, q="TLE 12")).select("action", "document_id", "document_title", "detail").distinct()


@query(with_tables("""SELECT id, action, document_id, place FROM (SELECT a.id, a.action, a.document_id, row_number() OVER (PARTITION BY a.document_id ORDER BY a.id DESC) AS place FROM (SELECT id, document_id,
    CASE id % 4 WHEN 0 THEN 'document_created' WHEN 1 THEN 'access_changed' WHEN 2 THEN 'text_updated' ELSE 'folder_changed' END AS action FROM audit_log) a JOIN docs d ON d.id = a.document_id JOIN vis ON vis.id = d.id
    WHERE a.action IN ('document_created', 'text_updated') OR (a.action = 'access_changed' AND d.owner_id = 'user1')) WHERE place <= 20"""))
def document_history(c):
    """The newest entries of each visible document; those about access are for its owner."""
    kind = F.element_at(F.array(*map(F.lit, ("document_created", "access_changed", "text_updated", "folder_changed"))), (F.col("id") % 4 + 1).cast("int"))
    log = c.audit_log.select("id", "document_id", kind.alias("action"))
    seen = c.documents.join(visibility.visible_documents(c, "user1"), "id", "left_semi").select("id", (F.col("owner_id") == "user1").alias("owner"))
    return audit.activity(log, seen).select("id", "action", "document_id", "place")


PROBED = "SELECT id, 'n' || (id % 3) AS node, actor, occurred_at AS t, value >= 8 AS ok, CASE WHEN id % 97 < 50 THEN 1 ELSE 2 END AS timeline FROM audit_log"


@query(with_tables("""SELECT actor, CASE WHEN timeline IS DISTINCT FROM timeline_before THEN 'promotion' ELSE 'interruption' END AS kind, last_ok_at, coalesce(first_failure_at, t) AS first_failure_at, t AS recovered_at, node_before, node AS node_after, timeline_before, timeline AS timeline_after, failed_checks FROM (
    SELECT *, min(t) FILTER (NOT ok) OVER (PARTITION BY actor, stretch) AS first_failure_at, count(*) FILTER (NOT ok) OVER (PARTITION BY actor, stretch) AS failed_checks FROM (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w, 0) AS stretch,
    last_value(CASE WHEN ok THEN t END IGNORE NULLS) OVER w AS last_ok_at, last_value(CASE WHEN ok THEN node END IGNORE NULLS) OVER w AS node_before, last_value(CASE WHEN ok THEN timeline END IGNORE NULLS) OVER w AS timeline_before
    FROM probed WINDOW w AS (PARTITION BY actor ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) WHERE ok AND last_ok_at IS NOT NULL AND (failed_checks >= 2 OR timeline IS DISTINCT FROM timeline_before)""", probed=PROBED))
def outage_log(c):
    """Interruptions and promotions of a database as its probes saw them; events stand for probes."""
    i = F.col("id")
    probes = c.audit_log.select(i, "actor", F.col("occurred_at").alias("at"), (F.col("value") >= 8).alias("ok"), F.concat(F.lit("n"), i % 3).alias("node"), F.when(i % 97 < 50, 1).otherwise(2).alias("timeline"))
    return analytics.outage_log(probes, "actor")


@query(with_tables("""SELECT 'share:1' AS share_id, (SELECT count(*) FROM s JOIN docs d ON d.id = s.document_id WHERE d.deleted_at IS NULL) AS documents, (SELECT string_agg(f.name, ',' ORDER BY f.name) FROM share_folders sf JOIN folders f ON f.id = sf.folder_id) AS folders,
    (SELECT count(*) FROM tok WHERE id % 100 = 2) AS tokens, (SELECT count(*) FROM tok WHERE id % 100 = 2 AND expires_at IS NOT NULL) AS expired, (SELECT string_agg(name, ',' ORDER BY name) FROM tok WHERE id % 100 = 1) AS revoked""", **SNAP))
def share_details(c):
    """What a share opens, its tokens, and those that were revoked."""
    before, after = snapshots(c)
    told = audit.derive({"documents": before["documents"], "share_tokens": before["share_tokens"]}, {"documents": after["documents"], "share_tokens": after["share_tokens"]})
    docs = c.document_grants.where("share_id is not null").select("share_id", F.col("document_id").alias("id")).distinct().join(c.documents.where("deleted_at is null").select("id", "title"), "id")
    folders = c.share_folders.join(c.folders.select(F.col("id").alias("folder_id"), "name"), "folder_id").select("share_id", F.col("folder_id").alias("id"), "name")
    nation = c.table("customer").where("c_custkey % 100 = 2").select(F.lit("share:1").alias("share_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 3 == 0, F.to_timestamp(F.lit("2024-01-01"))).alias("expires_at"))
    out = analytics.share_details(c.share_folders.select("share_id", F.lit("Partner").alias("name")), docs, folders, nation, told, F.to_timestamp(F.lit("2024-06-01")))
    return out.select("share_id", F.size("documents").cast("long").alias("documents"), F.array_join("folders.name", ",").alias("folders"), F.size("tokens").cast("long").alias("tokens"), F.size(F.filter("tokens", lambda t: t["expired"])).cast("long").alias("expired"), F.array_join("revoked", ",").alias("revoked"))
