"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is cut into two-bit segments; the vector of their bit counts is an embedding in which the Manhattan
distance never exceeds the Hamming distance. The segments are dealt to ranges, the coordinates of a grid. Vectors within a Manhattan
distance of ``max_bits`` agree exactly in all ranges but ``max_bits``, so the grid over each choice of that many ranges, with cells one
count wide, meets every such pair. The range join then tests the Manhattan distance, and what it leaves is verified by the bits. The
number of ranges grows with the fingerprints (``grid_ranges``), so that a cell holds few of them at any size.

Counts are written as so many ones (0, 1, 11), so that the Manhattan distance of two vectors is the bit count of their XOR.
Equal fingerprints are one node from the start. To join a dense group without all its pairs, every fingerprint is first
compared with two pivots of its cell; only pairs that these links leave in different components are then joined.

Null texts count as empty: fingerprint zero, linked like any other. Texts of fewer words than a shingle are one shingle; very long
ones are read whole, one at a time. A tie of a bit (half of the hashes) gives 0. Rows that repeat an id stay apart rows, each with its own
fingerprint. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from docloom.llm.common import connected_components, materialize, text_slices, with_hot_keys

SEED = 42
#: Hashes whose bits are unpacked at once.
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    if len(words) > shingle:
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
    else:
        hashes = [xxh64_intdigest(joined, SEED)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _HASHES):
        ones += np.unpackbits(np.array(hashes[i : i + _HASHES], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer. row: name of a further column, the hash of the text, which tells rows of one key apart."""
    kept = [docs.schema[key], *([T.StructField(row, T.LongType())] if row else [])]
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(text).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([*(b.column(f.name) for f in kept), pa.array(fp.view(np.int64))], schema.names)

    return docs.select(key, text, *([F.xxhash64(text).alias(row)] if row else [])).mapInArrow(run, schema)


def segment_counts(fp: Column) -> Column:
    """Bit counts of all 32 two-bit segments, each as so many ones in its own two bits."""
    places = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(places), F.shiftrightunsigned(fp, 1).bitwiseAND(places)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_ranges(count: int, max_bits: int = 4, cell: int = 16) -> int:
    """Ranges for which a cell holds about cell fingerprints of count: a segment's counts carry 1.5 bits, 48 in all."""
    ranges = max_bits + 2
    while ranges < 32 and count / 2 ** (48 * (ranges - max_bits) / ranges) > cell:
        ranges += 1
    return ranges


def cells(fps: DataFrame, ranges: int, max_bits: int) -> DataFrame:
    """The rows of fps with their counts and (choice, cell) for each choice of ranges - max_bits ranges of segments."""
    edges = [round(i * 32 / ranges) for i in range(ranges + 1)]
    masks = []
    for kept in combinations(range(ranges), ranges - max_bits):
        mask = sum(3 << (2 * s) for b in kept for s in range(edges[b], edges[b + 1]))
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    spots = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("counts").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)))
    return fps.withColumn("counts", segment_counts(F.col("fp"))).select(*fps.columns, "counts", F.inline(spots))


def near_pairs(fps: DataFrame, ranges: int = 6, max_bits: int = 4, pivots: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within max_bits."""
    manhattan = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = (manhattan("va", "vb") <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    spots = cells(fps, ranges, max_bits)
    pivot = [F.min_by(F.struct(F.col("fp").alias("b"), F.col("counts").alias("vb")), F.xxhash64("fp", F.lit(i))) for i in range(pivots)]
    chosen = spots.groupBy("choice", "cell").agg(F.count("*").alias("n"), F.array(*pivot).alias("ps")).where("n > 1")
    met = spots.join(chosen, ["choice", "cell"]).select(F.col("fp").alias("a"), F.col("counts").alias("va"), F.inline("ps"))
    first = materialize(met.where(F.col("a") != F.col("b")).where(near).select("a", "b").distinct(), "simhash-pivot")
    parts = connected_components(first)
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "component"), "simhash-named")
    spots = cells(named, ranges, max_bits)
    a, b = spots.toDF("a", "ca", "va", "choice", "cell"), spots.toDF("b", "cb", "vb", "choice", "cell")
    rest = a.join(b, (a.choice == b.choice) & (a.cell == b.cell) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near)
    return first.unionByName(rest.select("a", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """(key, row if named, fingerprint as 16 hex digits, component_id: smallest key reachable by links)."""
    marked = materialize(fingerprints(docs, shingle, text, key, row), "simhash")
    classes = materialize(marked.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")), "simhash-classes")
    count, rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = materialize(connected_components(near_pairs(classes.select("fp"), grid_ranges(count, max_bits), max_bits)), "simhash-parts")
    linked = parts.join(classes, parts.node == classes.fp).select("fp", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    owner = linked.select("fp", "component").join(least, "component").select("fp", "component_id")
    owner = classes.join(owner, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_hot_keys(marked, materialize(owner, "simhash-owner"), "fp", rows).select(key, *([row] if row else []), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
