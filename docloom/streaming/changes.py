"""The change pipeline over a stream of document snapshots: keyed state that knows stored versions, waiting jobs and links.

Events are changes (a document's new version) and ends of jobs. For each document the state holds the versions of the last day with their
times, the newest version with its hash, the kinds of jobs that wait, and the targets of the links of the newest text. A change whose version is
stored already adds nothing, whenever it comes; one that is new adds its version; if it is also the newest and its text differs, it asks for an embed
job unless one waits, and its links replace those there are. So replays, duplicates and late changes end in the tables that the batch derivation
gives. A timer forgets versions a day of event time after they came; a version that is no newer than a forgotten one counts as stored, and the
watermark drops what is later than that anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom.operators import search
from docloom.session import cut_lineage

DAY_MS = 24 * 3600 * 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "id long, event string, version int, content string, content_hash string, targets array<string>, kind string, at timestamp"
OUT = "document_id long, what string, version int, content string, content_hash string, kind string, target string"


def events(changes: DataFrame, ended_jobs: DataFrame | None = None) -> DataFrame:
    """Events of changes (id, version, content, content_hash, extraction_status, at) that have a text, and of ended jobs (document_id, kind, at)."""
    done = changes.where("extraction_status = 'done'")
    out = done.select(
        F.col("id").cast("long").alias("id"), F.lit("change").alias("event"), F.col("version").cast("int").alias("version"), "content", "content_hash",
        search.link_targets(F.col("content")).alias("targets"), F.lit(None).cast("string").alias("kind"), "at",
    )
    if ended_jobs is None:
        return out
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("version", "int"), ("content", "string"), ("content_hash", "string"), ("targets", "array<string>"))}
    return out.unionByName(ended_jobs.select(F.col("document_id").cast("long").alias("id"), F.lit("job").alias("event"), *none.values(), "kind", "at"))


def stored_state(versions: DataFrame, jobs: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """What is stored before the stream begins, one row a document: versions (document_id, version, content_hash), waiting jobs (document_id, kind), links (document_id, target)."""
    rows = versions.groupBy(F.col("document_id").cast("long").alias("id")).agg(F.max(F.struct(F.col("version").cast("int").alias("version"), "content_hash")).alias("newest"), F.array_sort(F.collect_set(F.col("version").cast("int"))).alias("versions"))
    for name, more, column in (("kinds", jobs, "kind"), ("targets", links, "target")):
        if more is None:
            rows = rows.withColumn(name, F.array().cast("array<string>"))
            continue
        own = more.groupBy(F.col("document_id").cast("long").alias("id")).agg(F.collect_set(column).alias(name))
        rows = rows.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return cut_lineage(rows.select("id", "versions", F.col("newest.version").alias("version"), F.col("newest.content_hash").alias("content_hash"), "kinds", "targets"))


class Derive(StatefulProcessor):
    """One document's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.versions = handle.getMapState("versions", "version int", "at long")
        self.newest = handle.getValueState("newest", "version int, content_hash string, forgotten int")
        self.waiting = handle.getMapState("waiting", "kind string", "at long")
        self.links = handle.getValueState("links", "targets array<string>")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            for version in row.versions:
                self.versions.updateValue((int(version),), (0,))
            self.newest.update((int(row.version), row.content_hash, -1))
            for kind in row.kinds:
                self.waiting.updateValue((kind,), (0,))
            self.links.update((list(row.targets),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = sorted((r for b in rows for r in b.itertuples()), key=lambda r: (r.at, r.event == "job", -1 if r.event == "job" else r.version))
        newest, digest, forgotten = self.newest.get() or (-1, None, -1)
        out = []
        add = lambda what, row=None, **more: out.append({"document_id": key[0], "what": what, "version": row.version if row else None, "content": None, "content_hash": None, "kind": None, "target": None} | more)
        last, before = 0, newest
        targets = None  # state is read and written once for each call where that gives the same: each use is a message to the JVM
        for r in changed:
            if r.event == "job":
                self.waiting.removeKey((r.kind,))
                continue
            version, at = int(r.version), int(r.at.timestamp() * 1000)
            if version > forgotten and not self.versions.containsKey((version,)):
                self.versions.updateValue((version,), (at,))
                last = max(last, at)
                add("version", r, content=r.content, content_hash=r.content_hash)
            if version <= newest:
                continue
            if r.content_hash != digest:
                if not self.waiting.containsKey(("embed",)):
                    self.waiting.updateValue(("embed",), (at,))
                    add("job", r, kind="embed")
                old, new = set((self.links.get() or ([],))[0]) if targets is None else targets, set(r.targets)
                for target in sorted(old - new):
                    add("unlink", r, target=target)
                for target in sorted(new - old):
                    add("link", r, target=target)
                targets = new
            newest, digest = version, r.content_hash
        if targets is not None:
            self.links.update((sorted(targets),))
        if newest != before:
            self.newest.update((newest, digest, forgotten))
        if last:
            self.handle.registerTimer(last + DAY_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"version": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() - DAY_MS
        newest, digest, forgotten = self.newest.get() or (-1, None, -1)
        old = [version for (version,), (at,) in self.versions.iterator() if at <= until]
        for version in old:
            self.versions.removeKey((version,))
        self.newest.update((newest, digest, max([forgotten, *old])))
        return iter(())

    def close(self) -> None:
        pass


def derived(stream: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows to write (document_id, what, ...) for a stream of events; what is version, job, link or unlink."""
    late = stream.withWatermark("at", "24 hours")
    initial = stored.groupBy("id") if stored is not None else None
    return late.groupBy("id").transformWithStateInPandas(Derive(), OUT, "Append", "EventTime", initial)


def start(stream: DataFrame, out: str, checkpoint: str, stored: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Write what a stream of events derives under out, a folder for each kind of row and batch.

    A batch that is run again after a failure overwrites its own folders. The session must use the RocksDB state store (ROCKS).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = derived(stream, stored).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def written(spark: SparkSession, out: str) -> DataFrame:
    """All rows that a stream has written."""
    return spark.read.schema(OUT + ", batch int").option("basePath", out).parquet(f"{out}/batch=*")


def links_now(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(document_id, target): links after the rows that a stream has written, over those there were before."""
    steps = rows.where("what in ('link', 'unlink')").select("document_id", "target", "version", (F.col("what") == "link").alias("there"))
    if before is not None:
        steps = steps.unionByName(before.select("document_id", "target", F.lit(-1).alias("version"), F.lit(True).alias("there")))
    last = F.row_number().over(Window.partitionBy("document_id", "target").orderBy(F.desc("version")))
    return steps.withColumn("n", last).where("n = 1 and there").select("document_id", "target")
