"""Integrity rules as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(corpus, edges: DataFrame, most_chars: int = 500_000) -> DataFrame:
    """(rule, violations) of every rule, zeros too."""
    docs, jobs, folders, grants = corpus.documents, corpus.jobs, corpus.folders, corpus.document_grants
    one = lambda rule, df: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    public = docs.where("visibility = 'public'").select(F.col("id").alias("document_id"))
    owners = docs.select(F.col("id").alias("document_id"), F.col("owner_id").alias("user_id"))
    ids = docs.select(F.col("id").alias("document_id"))
    found = [
        one("blank_done_content", docs.where("extraction_status = 'done' and btrim(content, ' \\t\\r\\n\\f') = ''")),
        one("content_too_long", docs.where(F.length("content") > most_chars)),
        one("pending_jobs_twice", jobs.where("status = 'pending'").groupBy("document_id", "kind").count().where("count > 1")),
        one("processing_without_lease", jobs.where("status = 'processing' and lease_expires_at is null")),
        one("edge_to_itself", edges.where("src = dst")),
        one("edge_twice", edges.groupBy("src", "dst", "kind", F.coalesce("src_chunk", F.lit(-1)), F.coalesce("dst_chunk", F.lit(-1))).count().where("count > 1")),
        one("grantees_not_one", grants.where("cast(user_id is not null as int) + cast(group_id is not null as int) <> 1")),
        one("root_without_scope", folders.where("(parent_id is null) <> (visibility is not null)")),
        one("bad_folder_name", folders.where("trim(name) = '' or name like '%/%'")),
        one("folder_name_twice", folders.where("parent_id is not null").groupBy("parent_id", "name").count().where("count > 1")),
        one("public_with_grants", grants.join(public, "document_id", "left_semi")),
        one("owner_is_grantee", grants.join(owners, ["document_id", "user_id"], "left_semi")),
        one("version_without_document", corpus.versions.join(ids, "document_id", "left_anti")),
        one("chunk_without_document", corpus.chunks.join(ids, "document_id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, found)


def preview_violations(previews: DataFrame) -> DataFrame:
    """A preview is ready exactly when it has a PDF."""
    return previews.where("(status = 'ready') <> (pdf_sha256 is not null)")


def department_violations(users: DataFrame, members: DataFrame, folders: DataFrame) -> dict[str, DataFrame]:
    """Users (user_id, group_id) of a department without being its member; departments with several folders; department folders (id, parent_id, group_id) below the top."""
    named = folders.where("group_id is not null")
    return {
        "department_without_membership": users.where("group_id is not null").join(members, ["user_id", "group_id"], "left_anti"),
        "department_with_folders": named.groupBy("group_id").count().where("count > 1"),
        "department_folder_below_top": named.where("parent_id is not null"),
    }


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key): rows of an append-only table that are gone or differ in a later snapshot."""
    whole = lambda df, name: df.select(key, F.xxhash64(*before.columns).alias(name))
    return whole(before, "was").join(whole(after, "now"), key, "left").where(~F.col("was").eqNullSafe(F.col("now"))).select(key)


def outage_violations(outages: DataFrame) -> DataFrame:
    """The last good answer comes before the first failure, and that before the recovery."""
    return outages.where("not (last_ok_at <= first_failure_at and first_failure_at <= recovered_at)")


EDGE_KINDS = ("overlaps", "related")


def orphans(children: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Rows of tables (document_id, ...) whose document is gone."""
    ids = documents.select(F.col("id").alias("document_id"))
    return {f"{name}_without_document": df.join(ids, "document_id", "left_anti") for name, df in children.items()}


def integrity(documents: DataFrame, edges: DataFrame, grants: DataFrame, previews: DataFrame, outages: DataFrame, log: tuple[DataFrame, DataFrame], departments: tuple[DataFrame, DataFrame, DataFrame], children: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of the rules over edges, grants, previews, outages, the audit log (before, after), departments (users, members, folders) and children of documents."""
    given = F.col("user_id").isNotNull().cast("int") + F.col("group_id").isNotNull().cast("int") + F.col("share_id").isNotNull().cast("int")
    rules = {
        "edge_kind_unknown": edges.where(~F.col("kind").isin(*EDGE_KINDS) | F.col("kind").isNull()), "grantees_not_one": grants.where(given != 1), "preview_ready_without_pdf": preview_violations(previews),
        "outage_out_of_order": outage_violations(outages), "audit_row_changed": changed_rows(*log), **department_violations(*departments), **orphans(children, documents),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in rules.items()))
