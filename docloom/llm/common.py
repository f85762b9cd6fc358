"""Helpers shared by the operators: shared scratch tables, connected components, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step holds at a time.
SLICE_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, which only a local session may lack."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it needs to be no column of df."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no query reads any more."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about limit bytes of a text column, and one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def with_hot_keys(rows: DataFrame, owner: DataFrame, key: str, count: int, most: int = 10_000) -> DataFrame:
    """rows joined with owner (key, n: how many of the count rows have it, ...). Keys of more than a most-th of all rows, fewer than most, are broadcast."""
    bound = max(1000, count // most)
    hot, plain = F.broadcast(owner.where(F.col("n") > bound)), owner.where(F.col("n") <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(plain, key))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b): component is the smallest reachable id.

    Alternates the large-star and small-star steps, so that paths shrink by halves: each step is a grouped minimum (combined before
    the shuffle) and a join, whose side of edges the adaptive skew join splits where a hub has very many.
    Rounds end when the edge set no longer changes, found by an order-free hash of all edges.
    """
    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.join(least, "a")
        if large:  # larger neighbours of a go to the smallest one
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        to = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return to.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "edges")
    seen = marks(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = materialize(star(star(e, True), False), "edges")
        now = marks(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
