"""Audit rows from two snapshots of the watched tables, by declared rules; and questions to the audit log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Detail = Callable[[Callable[[str], Column]], dict[str, Column]]

#: What is told of a document to all who see it, and what to its owner alone.
PUBLIC_ACTIONS = ("document_created", "text_updated", "original_replaced", "document_trashed", "document_restored", "owner_changed")
OWNER_ACTIONS = ("access_changed", "share_changed", "original_downloaded", "original_previewed")


@dataclass(frozen=True)
class Rule:
    """One kind of audit row. when: added, removed, or the column whose change counts; only: a further condition on old and new values."""

    when: str
    action: str
    detail: Detail = lambda v: {}
    only: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None


@dataclass(frozen=True)
class Watched:
    """A table with its key columns, the rules for it, and which column names the document that its rows belong to."""

    key: tuple[str, ...]
    rules: tuple[Rule, ...]
    document: str | None = None
    columns: tuple[str, ...] = field(default=())


def _change(**more: str) -> dict[str, Column]:
    return {k: F.lit(v) for k, v in more.items()}


def _grantee(v):
    return {"grantee_type": F.when(v("user_id").isNotNull(), "user").otherwise("group"), "grantee": F.coalesce(v("user_id"), v("group_id"))}


def _folder(v):
    return {"folder_id": v("id"), "folder_name": v("name")}


def _share(v):
    return {"share_id": v("share_id"), "share_name": v("share_name"), "owner": v("share_owner")}


def _pair(added: str, removed: str, action: str, detail: Detail, only=None, name: str = "change", first: dict[str, str] | None = None) -> tuple[Rule, Rule]:
    """A rule for rows that come and one for rows that go, told by the value of one field."""
    made = lambda value: lambda v: {**_change(**(first or {})), name: F.lit(value), **detail(v)}
    return Rule("added", action, made(added), only), Rule("removed", action, made(removed), only)


#: Old and new values are told by name in details of changed columns: old.visibility and new.visibility.
RULES: dict[str, Watched] = {
    "documents": Watched(("id",), (
        Rule("added", "document_created"), Rule("removed", "document_deleted"),
        Rule("visibility", "access_changed", lambda v: {"kind": F.lit("visibility"), "before": v("old.visibility"), "after": v("visibility")}),
        Rule("follows_folder", "access_changed", lambda v: {"kind": F.lit("inherit"), "before": F.when(v("old.follows_folder"), "folder").otherwise("own"), "after": F.when(v("follows_folder"), "folder").otherwise("own")}),
        Rule("folder_id", "access_changed", lambda v: {"kind": F.lit("folder"), "before": v("old.folder_name"), "after": v("folder_name")}, lambda old, new: new("follows_folder")),
        Rule("deleted_at", "document_trashed", only=lambda old, new: old("deleted_at").isNull()),
        Rule("deleted_at", "document_restored", only=lambda old, new: new("deleted_at").isNull()),
        Rule("owner_id", "owner_changed", lambda v: {"kind": F.lit("document"), "before": v("old.owner_id"), "after": v("owner_id")}),
    ), "id", ("visibility", "follows_folder", "folder_id", "folder_name", "deleted_at", "owner_id")),
    "versions": Watched(("document_id", "version"), (Rule("added", "text_updated", lambda v: {"version": v("version")}, lambda old, new: new("version") > 1),), "document_id"),
    "files": Watched(("document_id", "file_version"), (Rule("added", "original_replaced", lambda v: {"file_version": v("file_version")}, lambda old, new: new("file_version") > 1),), "document_id"),
    "grants": Watched(("document_id", "user_id", "group_id"), _pair("added", "removed", "access_changed", _grantee, first={"kind": "grant"}), "document_id"),
    "shared_documents": Watched(("document_id", "share_id"), _pair("document_added", "document_removed", "share_changed", _share), "document_id", ("share_name", "share_owner")),
    "members": Watched(("user_id", "group_id"), _pair("added", "removed", "group_member_changed", lambda v: {"group": v("group_id"), "user": v("user_id")})),
    "managers": Watched(("user_id", "group_id"), _pair("manager_added", "manager_removed", "group_changed", lambda v: {"group": v("group_id"), "user": v("user_id")})),
    "folders": Watched(("id",), (
        *_pair("created", "deleted", "folder_changed", lambda v: {**_folder(v), "parent_id": v("parent_id")}),
        Rule("name", "folder_changed", lambda v: {"change": F.lit("renamed"), **_folder(v), "parent_id": v("parent_id"), "old_name": v("old.name")}),
        Rule("visibility", "folder_access_changed", lambda v: {"kind": F.lit("visibility"), **_folder(v), "before": v("old.visibility"), "after": v("visibility")}),
        Rule("created_by", "owner_changed", lambda v: {"kind": F.lit("folder"), **_folder(v), "before": v("old.created_by"), "after": v("created_by")}),
    ), None, ("name", "parent_id", "visibility", "created_by")),
    "folder_grants": Watched(("folder_id", "user_id", "group_id"), _pair("added", "removed", "folder_access_changed", lambda v: {**_grantee(v), "folder_id": v("folder_id"), "folder_name": v("folder_name")}, first={"kind": "grant"}), None, ("folder_name",)),
    "shares": Watched(("share_id",), _pair("created", "deleted", "share_changed", _share), None, ("share_name", "share_owner")),
    "share_folders": Watched(("share_id", "folder_id"), _pair("folder_added", "folder_removed", "share_changed", lambda v: {**_share(v), "folder_id": v("folder_id"), "folder_name": v("folder_name")}), None, ("share_name", "share_owner", "folder_name")),
    "share_tokens": Watched(("token_id",), _pair("token_issued", "token_revoked", "share_changed", lambda v: {**_share(v), "token_name": v("token_name")}), None, ("share_id", "share_name", "share_owner", "token_name")),
    "tokens": Watched(("token_id",), _pair("issued", "revoked", "token_changed", lambda v: {"owner": v("owner"), "token_name": v("token_name"), "scope": v("scope"), "expires_at": v("expires_at")}), None, ("owner", "token_name", "scope", "expires_at")),
    "users": Watched(("username",), (
        Rule("password_hash", "password_changed", lambda v: {"user": v("username")}),
        Rule("is_admin", "user_changed", lambda v: {"change": F.when(v("is_admin"), "admin_granted").otherwise("admin_revoked"), "user": v("username")}),
        Rule("department", "user_changed", lambda v: {"change": F.lit("department_changed"), "user": v("username"), "from": v("old.department"), "to": v("department")}),
    ), None, ("password_hash", "is_admin", "department")),
}


def changes_of(watched: Watched, before: DataFrame, after: DataFrame) -> DataFrame:
    """(action, document_id, removed, detail) of one table: one full join of its keys, which may hold nulls and must be distinct."""
    columns = [*watched.key, *watched.columns]
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in columns), F.lit(True).alias(f"{name}_there"))
    same = None
    for c in watched.key:
        each = F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
        same = each if same is None else same & each
    both = side(before, "old").join(side(after, "new"), same, "full")
    came, went = F.col("old_there").isNull(), F.col("new_there").isNull()
    old, new = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    rows = []
    for rule in watched.rules:
        holds = {"added": came, "removed": went}.get(rule.when)
        if holds is None:
            holds = ~came & ~went & ~old(rule.when).eqNullSafe(new(rule.when))
        if rule.only is not None:
            holds = holds & F.coalesce(rule.only(old, new), F.lit(False))
        value = lambda c, gone=rule.when == "removed": old(c.removeprefix("old.")) if gone or c.startswith("old.") else new(c)
        fields = rule.detail(value)
        detail = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
        rows.append(F.when(holds, F.struct(F.lit(rule.action).alias("action"), F.lit(rule.when == "removed").alias("removed"), detail.alias("detail"))))
    document = F.coalesce(new(watched.document), old(watched.document)).cast("long") if watched.document else F.lit(None).cast("long")
    return both.select(document.alias("document_id"), F.inline(F.array_compact(F.array(*rows))))


def derive(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(action, document_id, document_title, detail): the audit rows between two snapshots of any of the tables in RULES.

    Rows that go with their document tell nothing of their own. Titles are the newer ones, or for a deleted document its last.
    """
    out = None
    for name, watched in RULES.items():
        if name in after:
            own = changes_of(watched, before[name], after[name]).withColumn("own", F.lit(name == "documents"))
            out = own if out is None else out.unionByName(own)
    titles = after["documents"].select(F.col("id").alias("d"), F.col("title").alias("now"))
    past = before["documents"].select(F.col("id").alias("p"), F.col("title").alias("past"))
    told = out.join(titles, F.col("document_id") == F.col("d"), "left").join(past, F.col("document_id") == F.col("p"), "left")
    told = told.where(F.col("own") | F.col("document_id").isNull() | F.col("d").isNotNull() | ~F.col("removed"))
    return told.select("action", "document_id", F.when(F.col("d").isNotNull(), F.col("now")).otherwise(F.col("past")).alias("document_title"), "detail")


def escaped(text: str) -> str:
    """A text as part of a LIKE pattern."""
    return "".join(f"\\{c}" if c in "\\%_" else c for c in text)


def entries(log: DataFrame, actor: str | None = None, action: str | None = None, since: Column | None = None, q: str | None = None, before_id: int | None = None) -> DataFrame:
    """Audit rows that pass all filters given; q is looked for in titles and in folder names of details."""
    if actor is not None:
        log = log.where(F.col("actor") == actor)
    if action is not None:
        log = log.where(F.col("action") == action)
    if since is not None:
        log = log.where(F.col("occurred_at") >= since)
    if q is not None:
        like = f"%{escaped(q)}%"
        log = log.where(F.col("document_title").ilike(like) | F.coalesce(F.get_json_object("detail", "$.folder_name").ilike(like), F.lit(False)))
    return log if before_id is None else log.where(F.col("id") < before_id)


def newest(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(limit)


def activity(log: DataFrame, documents: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows of each document (id, owner: whether the reader owns it): public actions, and for owners the private ones."""
    seen = log.join(documents.select(F.col("id").alias("document_id"), "owner"), "document_id")
    seen = seen.where(F.col("action").isin(*PUBLIC_ACTIONS) | (F.col("owner") & F.col("action").isin(*OWNER_ACTIONS)))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("id")))).where(F.col("place") <= limit)
