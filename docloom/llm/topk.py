"""Exact top-k search over an impact-ordered index, score at a time.

Vectors become integers. Rows are dealt to blocks of bounded size. In a block, postings (dimension, row, value) stand in segments by
their dimension and quantised impact, the size of the component in ``LEVELS`` steps. Queries take the segments in falling impact and add up scores; what is
left of a score is bounded by the smaller of two proofs, ``sum |q_d| * next impact`` and Cauchy-Schwarz on the postings of a row that are still to
come. A query is done when the rows that may still be among its k best are few, and only those are scored exactly; queries
that are done take no further segments.

Each query's best of each block are merged. Ties go to the smaller id. Vectors that are null or hold null or non-finite components take
no part; shorter vectors count as filled up with zeros. Queries that repeat an id are one query (the smallest vector in array order), and rows
of the query's own id are not its candidates; other rows that repeat an id are candidates of their own. Scores are exact; those beyond
the range of a long are returned as its nearest end. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import shuffle_partitions
from docloom.llm.embeddings import matrix

LEVELS = 16
#: Queries that take segments together, and rows of a query for which exact scores cost less than another level.
TOGETHER, FEW = 256, 48


class ImpactIndex:
    """Posting segments of a block of rows: for each level, the highest first, the (dimension, rows, values) that have it."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.top = max(1.0, float(np.abs(rows).max(initial=0)))
        level = np.ceil(np.abs(rows.T) * (LEVELS / self.top)).astype(np.int64)
        segment = ((LEVELS - level) * width + np.arange(width)[:, None]).ravel()
        order = np.argsort(segment, kind="stable")
        row, value = order % n, rows.T.ravel()[order]
        ends = np.searchsorted(segment[order], np.arange(LEVELS * width), "right")
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        rest, self.levels = (rows**2).sum(axis=1), []
        for i in range(LEVELS):
            spans = [(d, slice(starts[i * width + d], ends[i * width + d])) for d in range(width) if ends[i * width + d] > starts[i * width + d]]
            if spans:
                level = slice(spans[0][1].start, spans[-1][1].stop)
                rest -= np.bincount(row[level], value[level] ** 2, n)
            self.levels.append(([(d, row[at], value[at, None]) for d, at in spans], np.sqrt(np.maximum(rest, 0))))

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows that may be among the k best of a query; own marks rows that are none of its candidates."""
        n = own.shape[1]
        length, weight = np.sqrt((queries**2).sum(axis=1)), np.abs(queries).sum(axis=1)
        active, score = np.arange(len(queries)), np.zeros((n, len(queries)))  # a row of the block beside another
        by_dim, found = np.ascontiguousarray(queries.T), []
        for step, (segments, rest) in enumerate(self.levels):
            for d, rows, values in segments:
                score[rows] += values * by_dim[d]
            if (step % 3 != 2 and step + 1 < LEVELS) or n <= k:
                continue
            impact = self.top * (LEVELS - step - 1) / LEVELS  # no posting to come is larger
            left = np.minimum(rest[:, None] * length[active], weight[active] * impact)
            low = score - left
            low[own[active].T] = -np.inf
            proof = np.partition(low, n - k, axis=0)[n - k]
            slack = 1e-9 * length[active] * (self.top * np.sqrt(queries.shape[1])) + 1e-6
            may = (score + left >= proof - slack) & ~own[active].T
            done = may.sum(axis=0) <= FEW if step + 1 < LEVELS else np.ones(len(active), bool)
            if done.any():
                r, q = np.nonzero(may[:, done])
                found.append((active[done][q], r))
                active, score, by_dim = active[~done], score[:, ~done], by_dim[:, ~done]
            if not len(active):
                break
        if len(active):
            q, r = np.nonzero(~own[active])
            found.append((active[q], r))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors pair by pair; whole numbers of Python where doubles could round."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    sums = (sum(int(a) * int(b) for a, b in zip(q, r, strict=True)) for q, r in zip(queries.tolist(), rows.tolist(), strict=True))
    return np.array([min(high, max(low, s)) for s in sums], np.int64)


def search_block(index: ImpactIndex, ids: np.ndarray, rows: np.ndarray, names: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of a block for some queries."""
    q, r = index.candidates(queries, names[:, None] == ids[None, :], k)
    exact = _exact(queries[q], rows[r])
    order = np.lexsort((ids[r], -exact.astype(object) if len(exact) and exact.min() == -(1 << 63) else -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return names[q[keep]], ids[r[keep]], exact[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, query_block: int = TOGETHER, row_block: int = 4096, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each query row.

    A task reads a block's rows, which come first, makes their index once, and streams the queries through it, query_block at a time.
    """
    inf = float("inf")
    fine = vectors.where(F.col(key).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    fine = fine.select(F.col(key).cast("long").alias("id"), F.transform(column, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    rows, width = fine.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-rows // row_block))
    fine = fine.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width or 0) - F.size("v"))))
    of = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    candidates = fine.select(of.alias("block"), F.lit(0).alias("side"), "id", "v")
    queries = fine.where("asks").groupBy("id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "v")
    dealt = candidates.unionByName(queries).repartition(min(blocks, shuffle_partitions(vectors.sparkSession)), "block").sortWithinPartitions("block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        ids = rows = np.zeros(0)
        for t in batches:
            block, side = t.column("block").to_numpy(), t.column("side").to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (side[1:] != side[:-1])))) if len(block) else np.zeros(0, np.int64)
            for s, e in zip(begins.tolist(), [*begins[1:].tolist(), len(block)], strict=True):
                own, part = t.slice(s, e - s), block[s]
                names, values = own.column("id").to_numpy(), np.floor(matrix(own.column("v")) * scale) if width else np.zeros((e - s, 0))
                if part != now:
                    now, held, index = part, [], None
                if side[s] == 0:
                    held.append((names, values))
                    continue
                if not held or not width:
                    continue
                if index is None:
                    ids, rows = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                    index = ImpactIndex(rows)
                for i in range(0, e - s, query_block):
                    found = search_block(index, ids, rows, names[i : i + query_block], values[i : i + query_block], k)
                    yield pa.record_batch([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    met = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
