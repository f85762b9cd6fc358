"""Checks over logs, ledgers and snapshots of a run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_index(rows: DataFrame, key: str, value: str, index: Column, name: str) -> DataFrame:
    """(key, name): the value at a place, from 0, of each key's sorted values; index is made of the column total. Equal values are counted before the window."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.select(key, value, upto.alias("upto"), total.alias("total")).where(F.col("upto") > index).groupBy(key).agg(F.min(value).alias(name))


def floor_percentile(rows: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """The element at int(q * n), the last one at most."""
    return at_index(rows, key, value, F.least(F.col("total") - 1, F.floor(q * F.col("total"))), name)


def request_summary(requests: DataFrame, key: str) -> DataFrame:
    """requests (key, ms, status, empty): counts, failures (status 400 and up), empty results, median and the element at int(0.95 * (n - 1))."""
    p95 = at_index(requests, key, "ms", F.floor(0.95 * (F.col("total") - 1)), "p95_ms")
    summed = requests.groupBy(key).agg(
        F.count("*").alias("requests"), F.count_if(F.coalesce("status", F.lit(500)) >= 400).alias("failures"), F.count_if("empty").alias("empty_results"), F.percentile("ms", F.lit(0.5)).alias("median_ms"),
    )
    return summed.join(p95, key, "left")


def observations(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median and mean of each key."""
    return rows.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"))


def tally(events: DataFrame) -> DataFrame:
    """events (kind, status, ok, error_jobs) by kind: answers of 500, final failures, most jobs in error, and whether the kind is sound."""
    out = events.groupBy("kind").agg(F.count_if(F.col("status") == 500).alias("raw_500"), F.count_if(~F.col("ok")).alias("final_failures"), F.coalesce(F.max(F.when(F.col("ok"), F.col("error_jobs"))), F.lit(0)).alias("error_jobs"))
    return out.withColumn("sound", (F.col("raw_500") == 0) & (F.col("final_failures") == 0) & (F.col("error_jobs") == 0))


def ledger_rows(docs: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """(id, title, stored, computed, version, files): hashes as kept and as computed again, and the versions of the file in order."""
    own = files.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("file_version", "sha256"))).alias("f"))
    names = F.coalesce(F.transform("f", lambda x: F.concat_ws(":", x.file_version.cast("string"), x.sha256)), F.array().cast("array<string>"))
    seen = docs.where(F.startswith("title", F.lit(prefix)))
    return seen.join(own, "id", "left").select("id", "title", F.col("content_hash").alias("stored"), F.sha2(F.encode("content", "UTF-8"), 256).alias("computed"), "version", names.alias("files"))


def ordered_digest(rows: DataFrame, key: str, digest: str, block: int = 1 << 15) -> DataFrame:
    """(digest): the MD5 of all rows' digests in the order of key, as one string of them would have it.

    Ranges of keys are sorted and joined into blocks by many tasks; one task reads the blocks in order and keeps the state of the MD5 alone, as its
    definition asks. Null digests count as empty; equal keys stand in the order of their digests; no rows give the MD5 of nothing.
    """
    dealt = rows.select(F.col(key).alias("k"), F.coalesce(F.col(digest), F.lit("")).alias("d")).repartitionByRange("k").sortWithinPartitions("k", "d")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, block):
                text = "".join(b.column("d").slice(i, block).to_pylist())
                yield pa.record_batch([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([text], pa.string())], ["part", "number", "text"])
                number += 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.md5(usedforsecurity=False)
        for b in batches:
            for text in b.column("text").to_pylist():
                state.update(text.encode())
        yield pa.record_batch([pa.array([state.hexdigest()], pa.string())], ["digest"])

    blocks = dealt.mapInArrow(join, "part long, number long, text string")
    folded = blocks.repartition(1).sortWithinPartitions("part", "number").mapInArrow(fold, "digest string")
    return folded.agg(F.coalesce(F.max("digest"), F.md5(F.lit(""))).alias("digest"))  # one row at most


def recovery_point(uploads: DataFrame, stored: DataFrame, cut_from: Column, cut_to: Column) -> DataFrame:
    """One row: what became of acknowledged uploads (title, hash, at) from before, during and after a cut, against stored (title, hash)."""
    kept = stored.groupBy("title").agg(F.count("*").alias("copies"), F.collect_set("hash").alias("hashes"))
    met = uploads.join(kept, "title", "left")
    must, after = F.col("at") < cut_from, F.col("at") >= cut_to
    here, ambiguous = F.col("copies").isNotNull(), ~must & ~after
    return met.agg(
        F.count_if(must).alias("must"), F.count_if(must & ~here).alias("lost"), F.count_if(must & here & ~F.array_contains("hashes", F.col("hash"))).alias("mismatched"), F.count_if(must & (F.col("copies") > 1)).alias("duplicates"),
        F.count_if(ambiguous).alias("ambiguous"), F.count_if(ambiguous & here).alias("ambiguous_present"), F.count_if(after).alias("after"), F.count_if(after & here).alias("after_present"),
        (F.unix_micros(cut_from) - F.max(F.when(must & here, F.unix_micros("at")))).alias("gap_micros"),
    )


def unfinished(docs: DataFrame, jobs: DataFrame, chunks: DataFrame, prefix: str) -> DataFrame:
    """One row: open jobs, jobs in error, documents with chunks of another version, documents not ready, of titles with the prefix."""
    own = docs.where(F.startswith("title", F.lit(prefix))).select(F.col("id").alias("document_id"), F.col("version").alias("now"), "embedding_status")
    j = jobs.join(own, "document_id", "left_semi").agg(F.count_if(F.col("status").isin("pending", "processing")).alias("jobs"), F.count_if(F.col("status") == "error").alias("error"))
    stale = chunks.join(own, "document_id").where("version <> now").agg(F.countDistinct("document_id").alias("inconsistent"))
    return j.join(stale).join(own.agg(F.count_if(F.col("embedding_status") != "ready").alias("not_ready")))


def reconcile(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, title): what a ledger of uploads (title, ok, sha256, file_sha256) and stored rows (title, stored, recomputed, version, files) disagree on.

    lost, mismatched (a stored or recomputed hash), file_mismatched (the files (file_version, stored, recomputed) are not the one uploaded, where its hash is
    known) and version_drift are acknowledged uploads; a ghost was refused and is there; a duplicate is there twice; an unknown one is in no ledger.
    Of several rows of a title the greatest version speaks for versions and files.
    """
    found = rows.groupBy("title").agg(
        F.count("*").alias("n"), F.array_union(F.collect_set("stored"), F.collect_set("recomputed")).alias("hashes"), F.max("version").alias("version"), F.max_by("files", "version").alias("files"),
    )
    met = ledger.join(found, "title", "full").withColumn("there", F.col("n").isNotNull())
    known, acked = F.col("ok").isNotNull(), F.coalesce("ok", F.lit(False))
    one = F.array(F.struct(F.lit(1).cast("long").alias("file_version"), F.col("file_sha256").alias("stored"), F.col("file_sha256").alias("recomputed")))
    files = F.transform(F.coalesce("files", F.array().cast("array<struct<file_version:long,stored:string,recomputed:string>>")), lambda f: F.struct(f["file_version"].cast("long").alias("file_version"), f["stored"].alias("stored"), f["recomputed"].alias("recomputed")))
    classes = F.array_compact(F.array(
        F.when(acked & ~F.col("there"), "lost"), F.when(acked & F.col("there") & F.exists("hashes", lambda h: ~h.eqNullSafe(F.col("sha256"))), "mismatched"), F.when(known & ~acked & F.col("there"), "ghost"),
        F.when(F.col("n") > 1, "duplicate"), F.when(~known, "unknown"), F.when(acked & F.col("there") & F.col("file_sha256").isNotNull() & (files != one), "file_mismatched"), F.when(acked & (F.col("version") != 1), "version_drift"),
    ))
    return met.select(F.explode(classes).alias("class"), "title").distinct()


JOB_PATH = ("pending", "processing", "done")


def between(first: DataFrame, restored: DataFrame, second: DataFrame, fields: list[str], key: str = "title") -> DataFrame:
    """(key, problem): why a restored snapshot does not lie between two others: rows that both have and it lacks, rows that neither has, fields that did not change but differ."""
    side = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    met = side(first, "a").join(side(restored, "r"), key, "full").join(side(second, "b"), key, "full")
    a, r, b = F.col("a"), F.col("r"), F.col("b")
    changed = [F.when(a.isNotNull() & b.isNotNull() & r.isNotNull() & a[f].eqNullSafe(b[f]) & ~r[f].eqNullSafe(b[f]), F.lit(f)) for f in fields]
    problems = F.array_compact(F.array(F.when(a.isNotNull() & b.isNotNull() & r.isNull(), "missing"), F.when(a.isNull() & b.isNull(), "extra"), *changed))
    return met.select(key, F.explode(problems).alias("problem"))


def jobs_between(first: DataFrame, restored: DataFrame, second: DataFrame) -> DataFrame:
    """(id, status): restored jobs whose status is not on the path from the first snapshot's to the second's; off the path of pending, processing and done only the two ends are."""
    path = F.array(*map(F.lit, JOB_PATH))
    met = restored.select("id", "status").join(first.select("id", F.col("status").alias("a")), "id", "left").join(second.select("id", F.col("status").alias("b")), "id", "left")
    at = lambda c: F.array_position(path, F.col(c))
    on_path = (at("a") > 0) & (at("b") > 0)
    within = (at("status") > 0) & (at("status") >= at("a")) & (at("status") <= at("b"))
    ends = F.array_contains(F.array_compact(F.array("a", "b")), F.col("status"))
    backwards = F.coalesce(on_path & (at("a") > at("b")), F.lit(False))  # nothing is told of a job that went back
    return met.where((F.col("a").isNotNull() | F.col("b").isNotNull()) & ~backwards & ~F.when(F.coalesce(on_path, F.lit(False)), within).otherwise(ends)).select("id", "status")
