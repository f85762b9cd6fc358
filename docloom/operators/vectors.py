"""Cosine distance, exact nearest chunks and the hash embedding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances are rounded before ranking, so that equal vectors tie whatever order their sums were made in.
PLACES = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, rounded; null if a vector is zero."""
    return F.round(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), PLACES)


def with_distance(chunks: DataFrame, query: DataFrame) -> DataFrame:
    """chunks with their distance to the one vector of query (column q)."""
    one = F.broadcast(query.limit(1).select("q", F.sqrt(dot(F.col("q"), F.col("q"))).alias("q_length")))
    e, q = F.col("embedding"), F.col("q")
    distance = F.round(1 - F.try_divide(dot(e, q), F.sqrt(dot(e, e)) * F.col("q_length")), PLACES)
    return chunks.crossJoin(one).withColumn("distance", distance).drop("q", "q_length")


def best_per(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


NEAR_SCHEMA = "src long, src_chunk long, dst long, dst_chunk long, distance double"


#: Rows and columns of a tile of products; rows of a block at most, and doubles of one; blocks that small tables are cut into, for the tasks.
TILE, BLOCK_ROWS, BLOCK_VALUES, FEW_ROWS, BLOCKS = 1_024, 65_536, 1 << 22, 512, 12
#: Pairs that wait for a new limit.
MOST_PENDING = 1 << 20


class Block:
    """Unit vectors of a table (document_id, chunk_index, embedding) in the order of their ids; rows without a direction are left out."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("document_id", "ascending"), ("chunk_index", "ascending")])
        rows = t.column("embedding").combine_chunks()
        rows = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        good = np.isfinite(unit).all(axis=1)
        self.table = t.filter(pa.array(good))
        self.unit = unit[good]
        self.short = self.unit.astype(np.float32)
        self.document, self.chunk = (self.table.column(c).to_numpy() for c in ("document_id", "chunk_index"))
        #: Products of short vectors are no further than this from the exact ones.
        self.slack = (unit.shape[1] + 4) * 2.0**-23

    def __len__(self) -> int:
        return len(self.document)


#: Bits of a distance of at most 2 as a whole number of its last place.
DISTANCE_BITS = np.uint64(31)


def nearest_first(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, columns j and rounded distances d in the order of i, d and j; sorted as one number each where they fit into 64 bits."""
    rows, columns = (np.uint64(int(x.max(initial=0)).bit_length()) for x in (i, j))
    if rows + DISTANCE_BITS + columns > 64:
        order = np.lexsort((j, d, i))
        return i[order], j[order], d[order]
    keys = (i.astype(np.uint64) << DISTANCE_BITS | np.rint(d * 10**PLACES).astype(np.uint64)) << columns | j.astype(np.uint64)
    keys.sort()
    j, keys = keys & ((np.uint64(1) << columns) - np.uint64(1)), keys >> columns
    d = (keys & ((np.uint64(1) << DISTANCE_BITS) - np.uint64(1))) / 10**PLACES
    return (keys >> DISTANCE_BITS).astype(np.int64), j.astype(np.int64), d


class Nearest:
    """The k nearest columns of each of n rows so far, and the least product by which another could be one of them."""

    def __init__(self, n: int, k: int, slack: float, limit: np.ndarray | None = None, ordered: bool = True):
        self.k, self.slack, self.ordered, self.pending = k, slack, ordered, 0
        self.limit = np.full(n, -3.0, np.float32) if limit is None else limit
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.fresh: list[tuple] = []

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        self.fresh.append((i, j, d))
        self.pending += len(i)
        if self.pending > MOST_PENDING and self.pending > len(self.limit) * self.k:
            self.settle()

    def first(self, products: np.ndarray, rows: slice | np.ndarray) -> None:
        """Limits of rows that have none yet, by a part of their products (a row each)."""
        if products.shape[1] >= self.k and (self.limit[rows] <= -3).any():
            least = np.partition(products, -self.k, axis=1)[:, -self.k] - 2 * self.slack
            self.limit[rows] = np.maximum(self.limit[rows], least)

    def settle(self) -> None:
        i, j, d = nearest_first(*(np.concatenate(x) for x in zip(self.kept, *self.fresh, strict=True)))
        self.fresh, self.pending = [], 0
        begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
        place = np.arange(len(i)) - np.repeat(begin, np.diff(np.r_[begin, len(i)]))
        last = place == self.k - 1
        # Where columns come in the order of their ids, nothing later can take the place of k at no distance.
        self.limit[i[last]] = np.where(self.ordered & (d[last] <= 0), 9.0, np.maximum(self.limit[i[last]], 1 - d[last] - 2 * self.slack))
        self.kept = tuple(x[place < self.k] for x in (i, j, d))

    def table(self, one: Block, two: Block, begin: int = 0) -> pa.Table:
        self.settle()
        i, j, d = self.kept
        i = i + begin
        return pa.table({"src": one.document[i], "src_chunk": one.chunk[i], "dst": two.document[j], "dst_chunk": two.chunk[j], "distance": d})


def exact(one: Block, two: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded cosine distances of pairs of rows."""
    out = np.empty(len(i))
    for n in range(0, len(i), 1 << 15):
        part = slice(n, n + (1 << 15))
        out[part] = np.round(1 - np.einsum("ij,ij->i", one.unit[i[part]], two.unit[j[part]]), PLACES)
    return out


def apart(products: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Products with those within a document, of which both sides are in order, out of reach."""
    low, high = np.searchsorted(two, one, "left"), np.searchsorted(two, one, "right")
    n = high - low
    if n.any():
        products[np.repeat(np.arange(len(one)), n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)] = -4
    return products


def _often(n: int) -> bool:
    """1, 2, 4, 8, ..: limits are drawn anew each time that twice as much was seen."""
    return n & (n - 1) == 0


def nearest_in(one: Block, two: Block, k: int, both: bool = False) -> pa.Table:
    """The k nearest rows of two for each row of one, ties by id; with both, also those of one for each row of two.

    Products of short vectors, tile by tile, tell which pairs could be among the nearest; of these the exact distances are taken.
    """
    found, back = [], Nearest(len(two), k, one.slack)
    for sweep, r in enumerate(range(0, len(one), TILE), 1):
        near = Nearest(min(TILE, len(one) - r), k, one.slack)
        for tile, c in enumerate(range(0, len(two), TILE), 1):
            rows, cols = slice(r, r + TILE), slice(c, c + TILE)
            s = apart(one.short[rows] @ two.short[cols].T, one.document[rows], two.document[cols])
            near.first(s, slice(None))
            possible = s >= near.limit[:, None]
            if both:
                if sweep == 1:
                    back.first(np.ascontiguousarray(s.T), cols)
                possible |= s >= back.limit[None, cols]
            i, j = np.divmod(np.flatnonzero(possible), s.shape[1])
            p = s[i, j]
            true = p > -3
            i, j, p = i[true], j[true], p[true]
            d = exact(one, two, i + r, j + c)
            own = p >= near.limit[i]
            near.add(i[own], j[own] + c, d[own])
            if both:
                own = p >= back.limit[j + c]
                back.add(j[own] + c, i[own] + r, d[own])
            if _often(tile):
                near.settle()
        found.append(near.table(one, two, r))
        if both and _often(sweep):
            back.settle()
    return pa.concat_tables([no_pairs(), *found, *([back.table(two, one)] if both else [])])


def nearest_within(one: Block, two: Block, k: int, begin: int, mask: np.ndarray, reach: np.ndarray, lists: np.ndarray) -> pa.Table:
    """The k nearest rows of two for rows of one from begin on, no further than their reach, in those lists (of rows of two) that mask names for them."""
    limit = np.where(reach >= 2, -3.0, 1 - reach - 2 * one.slack).astype(np.float32)
    near = Nearest(len(mask), k, one.slack, limit, ordered=False)
    by_list = np.argsort(lists, kind="stable")
    ends = np.searchsorted(lists[by_list], np.arange(mask.shape[1] + 1))
    for number in np.flatnonzero(mask.any(axis=0) & (np.diff(ends) > 0)):
        asking, filed = np.flatnonzero(mask[:, number]), by_list[ends[number] : ends[number + 1]]
        for r in range(0, len(asking), TILE):
            rows = asking[r : r + TILE]
            for c in range(0, len(filed), TILE):
                cols = filed[c : c + TILE]
                s = apart(one.short[rows + begin] @ two.short[cols].T, one.document[rows + begin], two.document[cols])
                near.first(s, rows)
                i, j = np.divmod(np.flatnonzero(s >= np.maximum(near.limit[rows], -3)[:, None]), len(cols))
                true = s[i, j] > -3
                i, j = rows[i[true]], cols[j[true]]
                near.add(i, j, exact(one, two, i + begin, j))
    return near.table(one, two, begin)


def no_pairs() -> pa.Table:
    return pa.table({n: pa.array([], t) for n, t in (("src", pa.int64()), ("src_chunk", pa.int64()), ("dst", pa.int64()), ("dst_chunk", pa.int64()), ("distance", pa.float64()))})


def k_nearest(met: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each chunk, of those that tasks found."""
    rank = F.row_number().over(Window.partitionBy("src", "src_chunk").orderBy("distance", "dst", "dst_chunk"))
    return met.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def blocks_of(own: DataFrame, block: int) -> tuple[int, Column]:
    """How many blocks: BLOCKS whatever the size, fewer for small tables and more only where a block would outgrow a task."""
    n, values = own.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, min(BLOCKS, -(-n // FEW_ROWS)), -(-n // max(1, min(block, BLOCK_VALUES // max(values or 1, 1)))))
    return blocks, F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(blocks)).cast("int")


def meet(left: DataFrame, right: DataFrame, pairs: int, run: Callable) -> DataFrame:
    """run on the rows of both sides of each pair of blocks (column pair, from 0); a pair is a task of its own, however many partitions the session has."""
    one, two = (x.repartitionById(pairs, F.col("pair")).groupBy("pair") for x in (left, right))
    return one.cogroup(two).applyInArrow(run, NEAR_SCHEMA)


def neighbours(chunks: DataFrame, k: int = 10, block: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest chunks of other documents for every chunk: (src, src_chunk, dst, dst_chunk, distance).

    Each unordered pair of blocks of chunks meets once, in a task of its own, which serves both directions; per pair of blocks at most k rows of each
    chunk leave. The number of blocks stays the same until a block would have more than block rows or BLOCK_VALUES numbers, so up to there what
    is shuffled grows with the chunks; the products grow with their square.
    """
    own = chunks.select("document_id", "chunk_index", "embedding")
    blocks, number = blocks_of(own, block)
    # Blocks with themselves come first, then 0 and 1, 0 and 2, 1 and 2, ..
    pair = F.expr(f"CAST(CASE WHEN one = two THEN one ELSE {blocks} + two * (two - 1) DIV 2 + one END AS INT)").alias("pair")
    left = own.select(number.alias("one"), F.explode(F.sequence(number, F.lit(blocks - 1))).alias("two"), "*").select(pair, *own.columns)
    right = own.select(number.alias("two"), F.explode(F.sequence(F.lit(0), number)).alias("one"), "*").select(pair, *own.columns).toDF("pair", *own.columns)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return no_pairs()
        return nearest_in(Block(a), Block(b), k, both=key[0].as_py() >= blocks)

    return k_nearest(meet(left, right, blocks * (blocks + 1) // 2, run), k)


def across(asked: DataFrame, one: Column, few: int, own: DataFrame, two: Column, many: int) -> tuple[DataFrame, DataFrame]:
    """Both sides once for each block of the other (numbers one of few, and two of many), with the number of the pair."""
    left = asked.select(F.explode(F.sequence(one * many, one * many + (many - 1))).alias("pair"), *asked.columns)
    right = own.select(F.explode(F.sequence(two, two + (few - 1) * many, F.lit(many))), *own.columns).toDF("pair", *own.columns)
    return left, right


def nearest_to(queries: DataFrame, chunks: DataFrame, k: int = 10, block: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest chunks of other documents for some chunks only: every block of queries meets every block of chunks."""
    asked, own = (x.select("document_id", "chunk_index", "embedding") for x in (queries, chunks))
    few, one = blocks_of(asked, block)
    many, two = blocks_of(own, block)
    left, right = across(asked, one, few, own, two, many)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return nearest_in(Block(a), Block(b), k) if a.num_rows and b.num_rows else no_pairs()

    return k_nearest(meet(left, right, few * many, run), k)


def hash_embedding(docs: DataFrame, dim: int = 64, key: str = "id", text: str = "content") -> DataFrame:
    """Sparse unit vectors (key, dimension, weight): each word adds +1 or -1 at a place, both taken from its SHA-256."""
    word = docs.select(key, F.explode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("w")).where("w <> ''")
    digest = F.sha2(F.encode("w", "UTF-8"), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = word.select(key, place.alias("dimension"), sign.alias("s")).groupBy(key, "dimension").agg(F.sum("s").alias("s"))
    length = sums.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("length"))
    return sums.join(length, F.col(key) == F.col("_k")).where("s <> 0").select(key, "dimension", F.round(F.col("s") / F.col("length"), 6).alias("weight"))
