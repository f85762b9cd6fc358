"""Nearest chunks by inverted lists: every chunk is filed under the nearest of some centres; a search probes the nearest lists.

Centres are fitted by spherical k-means on a sample of at most SAMPLE chunks (the smallest by a hash of their ids, so that it is the same
each time) on the driver; there are as many as the root of the number of chunks, MOST_LISTS at most. Every chunk is filed. A list is cut into blocks of
BLOCK chunks, and so are the queries that probe it; a block of each meet in one task, so long lists and many queries cost more tasks, not longer ones.
With a number of probes, what is shuffled is that many copies of each query; recall is measured by ``recall`` against the exact comparison. The exact
mode goes on from there: a list is left out for a query only where the distance to its centre less its radius exceeds the distance of
the k-th chunk found, by the triangle inequality; the others are probed too. For that, queries and lists are not copied for each other: bounded blocks of
queries meet bounded blocks of chunks, as in the comparison of all, and in a task each list meets those queries of the block that it is not left out for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.vectors import BLOCK_ROWS, NEAR_SCHEMA, PLACES, Block, across, blocks_of, k_nearest, meet, nearest_in, nearest_to, nearest_within, no_pairs
from docloom.session import cut_lineage

SAMPLE, MOST_LISTS, BLOCK, STEPS = 8_192, 1_024, 8_192, 10
#: Rounding of stored distances, and of sums in the bound.
SLACK = 10.0**-PLACES


@dataclass
class PartitionIndex:
    """rows: document_id, chunk_index, embedding, list, block; lists: (list, blocks, radius); centres: one unit vector a list."""

    rows: DataFrame
    lists: DataFrame
    centres: np.ndarray


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=np.isfinite(length) & (length > 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(chunks: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of a bounded sample of chunks; lists without rows of the sample keep the row they began with."""
    own = chunks.select("document_id", "chunk_index", "embedding")
    lists = lists or min(MOST_LISTS, max(1, round(own.count() ** 0.5)))
    taken = own.orderBy(F.xxhash64("document_id", "chunk_index"), "document_id", "chunk_index").limit(sample).toArrow()
    if not taken.num_rows:
        return np.zeros((0, 0))
    x = _units(_matrix(taken.column("embedding").combine_chunks()))
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(STEPS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = np.sqrt((sums * sums).sum(axis=1)) > 0
        centres[some] = _units(sums[some])
    return centres


def build(chunks: DataFrame, centres: np.ndarray | None = None, block: int = BLOCK) -> PartitionIndex:
    """Every chunk under its nearest centre."""
    spark = chunks.sparkSession
    centres = fit(chunks) if centres is None else centres
    shipped = spark.sparkContext.broadcast(centres)  # MOST_LISTS vectors at most

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for b in batches:
            u = _units(_matrix(b.column("embedding")))
            dots = u @ c.T
            near = dots.argmax(axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * dots[np.arange(len(near)), near], 0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(apart)], [*b.schema.names, "list", "apart"])

    own = chunks.select("document_id", "chunk_index", "embedding")
    if not len(centres):
        rows = own.withColumns({"list": F.lit(0), "apart": F.lit(0.0)})
    else:
        rows = own.mapInArrow(file, "document_id long, chunk_index long, embedding array<double>, list int, apart double")
    rows = cut_lineage(rows)
    lists = cut_lineage(rows.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("apart").alias("radius")))
    filed = rows.drop("apart").join(F.broadcast(lists.select("list", "blocks")), "list")  # a row for each list
    filed = filed.withColumn("block", F.pmod(F.xxhash64("document_id", "chunk_index"), F.col("blocks")).cast("int")).drop("blocks")
    return PartitionIndex(filed, lists, centres)


def _probe(index: PartitionIndex, asked: DataFrame, probes: int, k: int) -> DataFrame:
    """Nearest chunks of asked rows within the lists nearest to them; blocks of queries and blocks of the list meet by themselves."""
    wanted = _wanted(index, asked, probes, False)
    counts = wanted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # a row for each list, as below
    sized = F.broadcast(counts.join(index.lists.select("list", "blocks"), "list"))
    part = F.pmod(F.xxhash64("document_id", "chunk_index"), F.col("parts")).cast("int").alias("part")
    left = wanted.join(sized, "list").select("list", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "document_id", "chunk_index", "embedding")
    right = index.rows.join(F.broadcast(counts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "document_id", "chunk_index", "embedding")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return nearest_in(Block(a), Block(b), k) if a.num_rows and b.num_rows else no_pairs()

    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, NEAR_SCHEMA)


def open_lists(unit: np.ndarray, reach: np.ndarray, centres: np.ndarray, radii: np.ndarray, probes: int) -> np.ndarray:
    """Which lists (columns) each query still has to ask: not its nearest ones, and not those whose chunks are all beyond its reach."""
    dots = unit @ centres.T
    order = np.argsort(-dots, axis=1, kind="stable")
    mask = np.sqrt(np.maximum(2 - 2 * dots, 0)) - radii[None, :] <= np.sqrt(2 * (reach + SLACK))[:, None] + SLACK
    np.put_along_axis(mask, order[:, :probes], False, axis=1)
    return mask


def _radii(index: PartitionIndex) -> np.ndarray:
    radii = np.zeros(len(index.centres))
    for r in index.lists.collect():  # a row for each list
        radii[r["list"]] = r["radius"]
    return radii


def _wanted(index: PartitionIndex, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
    """queries once for each list to probe: the nearest ones, or (beyond) those after them that their reach (column) does not rule out."""
    shipped = queries.sparkSession.sparkContext.broadcast((index.centres, _radii(index) if beyond else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shipped.value
        for b in batches:
            unit = _units(_matrix(b.column("embedding")))
            if beyond:
                mask = open_lists(unit, b.column("reach").to_numpy(zero_copy_only=False), centres, radii, probes)
            else:
                mask = np.zeros((len(unit), len(centres)), bool)
                np.put_along_axis(mask, np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            i, j = np.nonzero(mask)
            rows = b.select(["document_id", "chunk_index", "embedding"]).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(j.astype(np.int32))], [*rows.schema.names, "list"])

    return queries.mapInArrow(run, "document_id long, chunk_index long, embedding array<double>, list int")


def _beyond(index: PartitionIndex, queries: DataFrame, probes: int, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Nearest chunks of queries (with reach) in the lists after the nearest ones that their reach does not rule out."""
    shipped = queries.sparkSession.sparkContext.broadcast((index.centres, _radii(index)))
    few, one = blocks_of(queries, block)
    own = index.rows.select("document_id", "chunk_index", "embedding", "list")
    many, two = blocks_of(own, block)
    left, right = across(queries.select("document_id", "chunk_index", "embedding", "reach"), one, few, own, two, many)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return no_pairs()
        centres, radii = shipped.value
        asking, filed = Block(a), Block(b)
        reach, lists = asking.table.column("reach").to_numpy(), filed.table.column("list").to_numpy()
        out = [no_pairs()]
        for begin in range(0, len(asking), BLOCK):
            some = slice(begin, begin + BLOCK)
            mask = open_lists(asking.unit[some], reach[some], centres, radii, probes)
            out.append(nearest_within(asking, filed, k, begin, mask, reach[some], lists))
        return pa.concat_tables(out)

    return meet(left, right, few * many, run)


def search(index: PartitionIndex, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """(src, src_chunk, dst, dst_chunk, distance): the k nearest chunks of other documents for each query (document_id, chunk_index, embedding).

    Without exact, only the nearest lists are asked. Zero vectors find nothing and are found by nothing; ties go to the smaller ids.
    """
    asked = queries.select("document_id", "chunk_index", "embedding")
    if not len(index.centres):
        return asked.sparkSession.createDataFrame([], NEAR_SCHEMA)
    found = k_nearest(_probe(index, asked, probes, k), k)
    if not exact or probes >= len(index.centres):
        return found
    found = cut_lineage(found)
    reach = found.groupBy(F.col("src").alias("document_id"), F.col("src_chunk").alias("chunk_index")).agg(F.when(F.count("*") >= k, F.max("distance")).alias("r"))
    open_ = asked.join(reach, ["document_id", "chunk_index"], "left").withColumn("reach", F.coalesce("r", F.lit(2.0))).drop("r")
    return k_nearest(found.unionByName(_beyond(index, open_, probes, k)), k)


def recall(index: PartitionIndex, queries: DataFrame, k: int = 10, probes: int = 8) -> float:
    """The share of the exact nearest chunks of queries that the probes find, by distance, so that ties are no misses."""
    keys = ["src", "src_chunk"]
    truth = nearest_to(queries, index.rows, k).groupBy(*keys).agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    found = search(index, queries, k, probes)
    hits = truth.join(found, keys, "left").groupBy(*keys, "n").agg(F.count_if(F.col("distance") <= F.col("far")).alias("hits"))
    hit, n = hits.agg(F.sum(F.least("hits", "n")), F.sum("n")).first()
    return 1.0 if not n else hit / n
