"""What changes derive: versions, jobs, audit rows; and the job queue as pure transitions of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3


def text_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after that are new or whose hash changed, extracted ones only."""
    old = before.select("id", F.col("content_hash").alias("old_hash"))
    return after.join(old, "id", "left").where((F.col("extraction_status") == "done") & ~F.col("content_hash").eqNullSafe(F.col("old_hash")))


def derive_versions(before: DataFrame, after: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_id, version, content_hash) rows to add; those already there are skipped."""
    new = text_changes(before, after).select(F.col("id").alias("document_id"), "version", "content_hash")
    return new.join(versions.select("document_id", "version"), ["document_id", "version"], "left_anti")


def derive_jobs(before: DataFrame, after: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, kind) jobs to add: embed on text changes, edges when a document becomes ready; one pending job of a kind for each document."""
    embed = text_changes(before, after).select(F.col("id").alias("document_id"), F.lit("embed").alias("kind"))
    was = before.select("id", F.col("embedding_status").alias("was"))
    ready = after.join(was, "id", "left").where((F.col("embedding_status") == "ready") & ~F.col("was").eqNullSafe(F.lit("ready")))
    wanted = embed.unionByName(ready.select(F.col("id").alias("document_id"), F.lit("edges").alias("kind")))
    return wanted.join(jobs.where("status = 'pending'").select("document_id", "kind"), ["document_id", "kind"], "left_anti")


def derive_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """(document_id, action): what a full outer join of two snapshots shows."""
    cols = ["owner_id", "visibility", "content_hash", "title", "deleted_at"]
    b = before.select("id", *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(True).alias("b_there"))
    a = after.select("id", *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(True).alias("a_there"))
    both = b.join(a, "id", "full")
    there = F.col("a_there").isNotNull() & F.col("b_there").isNotNull()
    differs = lambda c: there & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    actions = F.array(
        F.when(F.col("b_there").isNull(), "document.create"), F.when(F.col("a_there").isNull(), "document.delete"), F.when(differs("visibility"), "document.visibility"),
        F.when(differs("content_hash"), "document.text"), F.when(differs("owner_id"), "document.owner"), F.when(differs("title"), "document.title"),
        F.when(there & F.col("b_deleted_at").isNull() & F.col("a_deleted_at").isNotNull(), "document.trash"), F.when(there & F.col("b_deleted_at").isNotNull() & F.col("a_deleted_at").isNull(), "document.restore"),
    )
    return both.select(F.col("id").alias("document_id"), F.explode(F.array_compact(actions)).alias("action"))


def claim_jobs(jobs: DataFrame, now: Column, lease_seconds: int, limit: int) -> DataFrame:
    """The first due pending jobs (previews last) as they are once claimed: attempts raised, leased."""
    due = jobs.where((F.col("status") == "pending") & (F.col("next_attempt_at") <= now))
    taken = due.orderBy(F.col("kind") == "preview", "id").limit(limit)
    return taken.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds))})


def fail_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Processing jobs after a failure: done if a pending job of the kind waits anyhow, an error at the third attempt, else pending again after 2**attempts seconds."""
    waiting = jobs.where("status = 'pending'").select("document_id", "kind").distinct().withColumn("waits", F.lit(True))
    met = jobs.where("status = 'processing'").join(waiting, ["document_id", "kind"], "left")
    wait = F.make_dt_interval(secs=F.pow(F.lit(2.0), F.col("attempts")).cast("decimal(18,6)"))
    superseded, over = F.col("waits").isNotNull(), F.col("attempts") >= MOST_ATTEMPTS
    out = met.withColumns({"status": F.when(superseded, "done").when(over, "error").otherwise("pending"), "next_attempt_at": F.when(superseded | over, F.col("next_attempt_at")).otherwise(now + wait), "lease_expires_at": F.lit(None).cast("timestamp")})
    return out.select(*jobs.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Jobs whose lease goes on: processing ones whose worker (beats: id, attempts) still holds the same attempt."""
    held = jobs.where("status = 'processing'").join(beats.select("id", "attempts").distinct(), ["id", "attempts"], "left_semi")
    return held.withColumn("lease_expires_at", now + F.make_dt_interval(secs=F.lit(lease_seconds)))


def release(jobs: DataFrame, given_back: DataFrame) -> DataFrame:
    """Processing jobs that a worker gives back unworked (given_back: id): they wait again, and the attempt does not count."""
    held = jobs.where("status = 'processing'").join(given_back.select("id").distinct(), "id", "left_semi")
    return held.withColumns({"status": F.lit("pending"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), "lease_expires_at": F.lit(None).cast("timestamp")})


def lock_seconds(failures: Column, limit: int = 10, first: float = 60.0, most: float = 3600.0) -> Column:
    """How long a login is locked after so many failures: from the limit on twice as long each time."""
    return F.when(failures >= limit, F.least(first * F.pow(F.lit(2.0), F.least(failures - limit, F.lit(30))), F.lit(most))).otherwise(0.0)


def sweep_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """(id, status) of jobs whose lease ran out: error when attempts are used up, done when a pending job of the kind waits or an earlier one here goes on, else pending."""
    expired = jobs.where((F.col("status") == "processing") & (F.col("lease_expires_at") < now))
    waiting = jobs.where("status = 'pending'").select("document_id", "kind").distinct().withColumn("waits", F.lit(True))
    tired = F.col("attempts") >= MOST_ATTEMPTS
    first = F.row_number().over(Window.partitionBy("document_id", "kind", tired).orderBy("id")) == 1
    marked = expired.withColumn("first", first).join(waiting, ["document_id", "kind"], "left")
    return marked.select("id", F.when(tired, "error").when(F.col("waits").isNotNull() | ~F.col("first"), "done").otherwise("pending").alias("status"))


def idempotent(requests: DataFrame, hours: int = 24) -> DataFrame:
    """(id, owner_id, key, result, created_by): the first request of a key creates, equal ones replay it, others conflict, until hours have passed; the next one creates again.

    requests: id, owner_id, key, at, request_hash. Each accepted request opens a window of its own, so the requests of a key are folded in order
    (at, id): sorted by Spark, streamed, with the open request alone in memory. created_by is the request whose result counts.
    """
    span = hours * 3_600_000_000
    own = requests.select("id", "owner_id", "key", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "request_hash")
    dealt = own.repartition("owner_id", "key").sortWithinPartitions("owner_id", "key", "at", "id")
    types = {c: requests.schema[c].dataType.simpleString() for c in ("id", "owner_id", "key")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, opened, first, digest = None, 0, None, None
        for b in batches:
            result, by = [], []
            for i, owner, key, at, asked in zip(*(b.column(c).to_pylist() for c in ("id", "owner_id", "key", "at", "request_hash")), strict=True):
                if (owner, key) != of or at - opened > span:
                    of, opened, first, digest = (owner, key), at, i, asked
                    result.append("created")
                else:
                    result.append("replayed" if asked == digest else "conflict")
                by.append(first)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("owner_id"), b.column("key"), pa.array(result, pa.string()), pa.array(by, b.column("id").type)], ["id", "owner_id", "key", "result", "created_by"])

    return dealt.mapInArrow(run, f"id {types['id']}, owner_id {types['owner_id']}, key {types['key']}, result string, created_by {types['id']}")


def backfill_authors(versions: DataFrame, audit: DataFrame) -> DataFrame:
    """versions (document_id, version, created_at) with author and author_via of the audit row written at the same time.

    audit: id, document_id, occurred_at, action, actor, actor_via, detail (JSON). A first version belongs to document_created, a later one to the
    text_updated row that names it; of several the first by id counts. The join is by document and time, so no version meets another's rows.
    """
    told = audit.where("action in ('document_created', 'text_updated')").select(
        "document_id", F.col("occurred_at").alias("created_at"), F.col("id").alias("audit_id"), "action", "actor", "actor_via", F.get_json_object("detail", "$.version").try_cast("int").alias("told")
    )
    fits = F.when(F.col("version") == 1, F.col("action") == "document_created").otherwise((F.col("action") == "text_updated") & (F.col("told") == F.col("version")))
    met = versions.select("document_id", "version", "created_at").join(told, ["document_id", "created_at"]).where(fits)
    first = met.groupBy("document_id", "version").agg(F.min_by(F.struct("actor", "actor_via"), "audit_id").alias("a"))
    return versions.join(first, ["document_id", "version"], "left").select(*versions.columns, F.col("a.actor").alias("author"), F.when(F.col("a").isNotNull(), F.coalesce("a.actor_via", F.lit("direct"))).alias("author_via"))


def grant_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, document_id, user_id, group_id): what to add and remove."""
    key = ["document_id", "user_id", "group_id"]
    a, b = old.select(*key).distinct(), new.select(*key).distinct()
    same = lambda x, y: x.alias("x").join(y.alias("y"), F.expr(" and ".join(f"x.{c} <=> y.{c}" for c in key)), "left_anti")
    return same(b, a).select(F.lit("add").alias("change"), *key).unionByName(same(a, b).select(F.lit("remove").alias("change"), *key))


def transfer_owner(docs: DataFrame, grants: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the new owner, and grants without those that the new owner no longer needs."""
    moved = docs.withColumn("owner_id", F.when(F.col("owner_id") == old, new).otherwise(F.col("owner_id")))
    own = moved.where(F.col("owner_id") == new).select(F.col("id").alias("document_id"))
    needless = grants.where(F.col("user_id") == new).join(own, "document_id", "left_semi").select("document_id", "user_id")
    return moved, grants.join(needless, ["document_id", "user_id"], "left_anti")


def delete_user(docs: DataFrame, folders: DataFrame, grants: DataFrame, members: DataFrame, user: str, heir: str) -> dict[str, DataFrame]:
    """The tables after a user is gone: documents and folders (created_by) go to the heir, who needs no grant on them; the user's own grants and memberships end."""
    moved, left = transfer_owner(docs, grants, user, heir)
    given = folders.withColumn("created_by", F.when(F.col("created_by") == user, heir).otherwise(F.col("created_by")))
    other = lambda df: df.where(~F.col("user_id").eqNullSafe(F.lit(user)))
    return {"documents": moved, "folders": given, "grants": other(left.select(*grants.columns)), "members": other(members)}


def write_results(docs: DataFrame, writes: DataFrame) -> DataFrame:
    """(document_id, result, version) of optimistic writes (document_id, client_version, content_hash); a text written where none was keeps its version."""
    blank = F.regexp_replace("content", r"^[ \t\r\n\f]+", "") == ""
    met = writes.join(docs.select(F.col("id").alias("document_id"), F.col("version").alias("now"), F.col("content_hash").alias("hash"), F.coalesce(blank, F.lit(True)).alias("blank")), "document_id", "left")
    result = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("client_version"), "conflict").when(F.col("hash") == F.col("content_hash"), "unchanged").otherwise("applied")
    return met.select("document_id", result.alias("result"), F.when((result == "applied") & ~F.col("blank"), F.col("now") + 1).otherwise(F.col("now")).alias("version"))


def version_authors(versions: DataFrame) -> DataFrame:
    """versions (…, source, actor, via) with author and author_via: texts of the extraction belong to the worker, others to who acts."""
    read = F.coalesce(F.col("source") == "extraction", F.lit(False))
    return versions.withColumns({"author": F.when(~read, F.col("actor")), "author_via": F.when(read, "worker").otherwise(F.coalesce("via", F.lit("direct")))}).drop("source", "actor", "via")


def derive_extract_jobs(before: DataFrame, after: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, kind) extract jobs of documents that came in waiting for extraction or turned to it; one pending for each."""
    was = before.select("id", F.col("extraction_status").alias("was"))
    asked = after.join(was, "id", "left").where((F.col("extraction_status") == "pending") & ~F.col("was").eqNullSafe(F.lit("pending")))
    waiting = jobs.where("status = 'pending' and kind = 'extract'").select("document_id")
    return asked.select(F.col("id").alias("document_id"), F.lit("extract").alias("kind")).join(waiting, "document_id", "left_anti")


def restore_results(docs: DataFrame, versions: DataFrame, asks: DataFrame) -> DataFrame:
    """(document_id, result, version) of restoring asks (document_id, wanted, client_version): the old text is written as a new version; unextracted documents refuse."""
    past = versions.select("document_id", F.col("version").alias("wanted"), F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash"))
    ready = docs.select(F.col("id").alias("document_id"), "extraction_status")
    met = asks.join(ready, "document_id").join(past, ["document_id", "wanted"], "left")
    fit = met.where("extraction_status = 'done' and content_hash is not null")
    refused = met.where("extraction_status <> 'done' or content_hash is null").select("document_id", F.when(F.col("extraction_status") != "done", "not_extracted").otherwise("no_version").alias("result"))
    refused = refused.join(docs.select(F.col("id").alias("document_id"), "version"), "document_id")
    return write_results(docs, fit.select("document_id", "client_version", "content_hash")).unionByName(refused)


def reembed(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, result) of asking for new embeddings: a new job, the one that waits already, or a refusal where there is no text yet."""
    waiting = jobs.where("status = 'pending' and kind = 'embed'").select(F.col("document_id").alias("id"), F.lit(True).alias("waits")).distinct()
    state = F.when(F.col("extraction_status") == "failed", "recognition_failed").when(F.col("extraction_status") == "pending", "extracting").when(F.col("waits"), "waiting").otherwise("queued")
    return docs.join(waiting, "id", "left").select(F.col("id").alias("document_id"), state.alias("result"))
