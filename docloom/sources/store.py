"""Derived tables that are kept: bucketed by source, named by a pointer file, rebuilt for some sources at a time.

A kept table is a pointer file and folders of Parquet, one for each bucket of a hash of the source. The pointer names the folder of every
bucket and the state that the table was built from; it is replaced in one rename, after all folders are whole, so a reader sees the old
table or the new one. A rebuild of some sources writes the buckets of these sources anew and leaves the files of all others as they are.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import shared_folder

BUCKETS = 16


def state_of(tables: list[DataFrame], *built_by: ModuleType | Callable | str) -> str:
    """A digest of the files that the tables are read from (paths, sizes, times; listed, not scanned) and of the code and parameters of a build."""
    spark = tables[0].sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = {f for t in tables for f in t.inputFiles()}
    state = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        path = hadoop(spark._jvm.java.net.URI(folder))
        for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            if s.isFile():
                state.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    names = {f.rsplit("/", 1)[1] for f in files}
    state = sorted(x for x in state if x[0].rsplit("/", 1)[1] in names)
    code = [b if isinstance(b, str) else inspect.getsource(b) for b in built_by]
    return hashlib.sha256(repr((state, code)).encode()).hexdigest()[:24]


class Kept:
    """One kept table under the session's shared folder."""

    def __init__(self, spark: SparkSession, name: str, source: str, buckets: int = BUCKETS):
        self.spark, self.source, self.buckets = spark, source, buckets
        self.folder = f"{shared_folder(spark)}/docloom-kept-{name}"
        self.pointer = f"{self.folder}/CURRENT"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.pointer)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def current(self) -> dict | None:
        """What the pointer says: state, schema, folders by bucket. None before the first build."""
        fs, path = self._fs()
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def point(self, state: str, schema: T.StructType, folders: dict[str, str]) -> None:
        """Replace the pointer in one step."""
        fs, path = self._fs()
        jvm = self.spark._jvm
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.pointer}-{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(json.dumps({"state": state, "schema": schema.json(), "folders": folders}).encode())
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), fs.makeQualified(path), overwrite)

    def bucket(self, source: str | Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.folder}/{uuid.uuid4().hex}"
        bucket = "_bucket"
        rows.withColumn(bucket, self.bucket(self.source)).repartition(self.buckets, bucket).sortWithinPartitions(bucket, self.source).write.partitionBy(bucket).parquet(folder)
        return folder

    def _there(self, folder: str, buckets: list[int]) -> dict[str, str]:
        """The buckets that a written folder has rows of; the others are empty."""
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return {str(b): f"{folder}/_bucket={b}" for b in buckets if fs.exists(path(f"{folder}/_bucket={b}"))}

    def build(self, state: str, rows: DataFrame) -> DataFrame:
        folder = self._write(rows)
        self.point(state, rows.schema, self._there(folder, list(range(self.buckets))))
        return self.read()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        now = self.current()
        if now is None:
            raise LookupError(f"{self.folder} was never built")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        paths = [p for b, p in now["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, state: str, sources: DataFrame, fresh: DataFrame) -> DataFrame:
        """The table with the rows of sources (one column of their keys) replaced by fresh ones; only buckets of these sources are written."""
        now = self.current()
        own = sources.select(F.col(sources.columns[0]).alias(self.source)).distinct()
        touched = sorted(r[0] for r in own.select(self.bucket(self.source)).distinct().collect())  # at most as many as there are buckets
        if touched:
            kept = self.read(touched)
            rows = kept.join(own, self.source, "left_anti").select(*kept.columns).unionByName(fresh.join(own, self.source, "left_semi").select(*kept.columns))
            folder = self._write(rows)
            folders = {b: p for b, p in now["folders"].items() if int(b) not in touched} | self._there(folder, touched)
            self.point(state, kept.schema, folders)
        return self.read()

    def sweep(self, older_than: float) -> int:
        """Delete this table's folders that no kept table's pointer names any more and that are older than so many seconds, which readers of an old pointer may still need. Gives their number."""
        fs, path = self._fs()
        named = set()
        for pointer in fs.globStatus(path.getParent().getParent().suffix("/docloom-kept-*/CURRENT")) or []:
            stream = fs.open(pointer.getPath())
            try:
                told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            named |= {folder.split("/_bucket=")[0].rsplit("/", 1)[1] for folder in told["folders"].values()}
        gone = 0
        for one in fs.listStatus(path.getParent()) if fs.exists(path.getParent()) else []:
            if one.isDirectory() and one.getPath().getName() not in named and one.getModificationTime() < (time.time() - older_than) * 1000:
                gone += bool(fs.delete(one.getPath(), True))
        return gone

    def fork(self, name: str) -> Kept:
        """A table of another name that starts with the same files."""
        now = self.current()
        other = Kept(self.spark, name, self.source, self.buckets)
        other.point(now["state"], T.StructType.fromJson(json.loads(now["schema"])), now["folders"])
        return other


def stored(name: str, source: str, tables: list[DataFrame], build: Callable[[], DataFrame], *built_by: ModuleType | Callable | str, buckets: int = BUCKETS) -> Kept:
    """The kept table for the state of tables and of the code and parameters that built_by names; built if there is none for this state."""
    state = state_of(tables, *built_by)
    kept = Kept(tables[0].sparkSession, f"{name}-{state}", source, buckets)
    if kept.current() is None:
        kept.build(state, build())
    return kept


def replace_by_source(old: DataFrame, fresh: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    """old without the rows of sources (column source), and the fresh rows of these sources; rows that point to them stay."""
    own = sources.select(source).distinct()
    return old.join(own, source, "left_anti").select(*old.columns).unionByName(fresh.join(own, source, "left_semi").select(*old.columns))
