"""The document similarity graph: building its edges and walking them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.vectors import nearest_to, neighbours
from docloom.sources.store import Kept

EDGES_PER_DOCUMENT = 5
OVERLAP_SHARE, OVERLAP_LEAST = 0.8, 3


def pair_stats(near: DataFrame) -> DataFrame:
    """Per pair of documents: how many chunks of each side matched, and the least distance."""
    return near.groupBy("src", "dst").agg(F.countDistinct("src_chunk").alias("matched_src"), F.countDistinct("dst_chunk").alias("matched_dst"), F.min("distance").alias("min_distance"))


def build_edges(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, kind, src_chunk, dst_chunk, score): the five strongest partners of each document, for all documents at once."""
    return edges_from(neighbours(chunks, k), chunks)


def build_edges_of(sources: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """The edges that build_edges gives for some sources (one column of ids): their chunks alone are compared with all."""
    own = sources.select(F.col(sources.columns[0]).alias("document_id")).distinct()
    return edges_from(nearest_to(chunks.join(own, "document_id", "left_semi"), chunks, k), chunks)


def rebuild_edges(kept: Kept, sources: DataFrame, chunks: DataFrame, state: str, k: int = 10) -> DataFrame:
    """The kept graph after the chunks of sources changed: their outgoing edges are built again, those that point to them stay."""
    return kept.replace(state, sources, build_edges_of(sources, chunks, k))


def edges_from(near: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges of the documents that near has the nearest chunks of.

    An edge is an overlap when four fifths of the chunks of either side matched, three at least; its score is then the share of its source's
    chunks that matched.
    """
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("src").orderBy(F.desc("matched_src"), "min_distance", "dst")
    ranked = pair_stats(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EDGES_PER_DOCUMENT)
    closest = near.groupBy("src", "dst").agg(F.min(F.struct("distance", "src_chunk", "dst_chunk")).alias("c"))
    sized = ranked.join(closest, ["src", "dst"])
    for side in ("src", "dst"):
        sized = sized.join(counts.select(F.col("document_id").alias(side), F.col("n").alias(f"n_{side}")), side)
    share = F.least(F.col("matched_src") / F.col("n_src"), F.col("matched_dst") / F.col("n_dst"))
    overlap = (share >= OVERLAP_SHARE) & (F.col("matched_src") >= OVERLAP_LEAST) & (F.col("matched_dst") >= OVERLAP_LEAST)
    return sized.select(
        "src", "dst", F.when(overlap, "overlaps").otherwise("related").alias("kind"), F.when(~overlap, F.col("c.src_chunk")).alias("src_chunk"),
        F.when(~overlap, F.col("c.dst_chunk")).alias("dst_chunk"), F.round(F.when(overlap, F.col("matched_src") / F.col("n_src")).otherwise(1 - F.col("min_distance")), 6).alias("score"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, kind, b_chunk, score): every edge from each of its ends."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind", F.col("dst_chunk").alias("b_chunk"), "score")
    return out.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "kind", F.col("src_chunk").alias("b_chunk"), "score"))
