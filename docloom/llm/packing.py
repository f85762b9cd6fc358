"""Best-fit packing by linear grouping.

Documents become token pieces of at most ``capacity``. How pieces are packed depends on their lengths only, and
there are at most ``capacity`` of these, so the plan is made on the histogram of lengths (its size does not
grow with the data) and the pieces are then dealt to the plan's slots:

1. Large lengths are put in order and cut into groups of equal cardinality; each is rounded up to its group's
   greatest. Configurations of the few rounded sizes are chosen by repeatedly taking the fullest one.
2. Actual lengths replace the rounded ones, in order, so that equal bins stay together as runs.
3. Small lengths go, longest first, to the run of bins with the least room that holds them; new bins open last.

A piece finds its slot by its rank among the pieces of its length: its rank in the task that cut it plus the number
of such pieces in tasks before. No task gathers a length, so a length that a third of all pieces share does no harm.

Null and empty texts hold the end token alone. Ties (equal lengths) take any slot of their length. Repeated rows and ids are packed
again, row by row; very long texts are read whole, one at a time, and cut into pieces. An empty table gives an empty plan and no rows. Extra
columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.bpe import ship_vocabulary
from docloom.llm.common import materialize, text_slices


@dataclass
class Run:
    """Equal bins: how many, and the lengths in each."""

    bins: int
    items: list[int] = field(default_factory=list)
    used: int = 0


def group_sizes(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths in falling order cut into groups of equal cardinality: (rounded size, [[length, count], ...])."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append([length, n])
            left, room = left - n, room - n
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """Group numbers whose rounded sizes fill a bin best: the largest size left, then the best sum by dynamic programming."""
    first = next(i for i, n in enumerate(left) if n)
    best: dict[int, tuple[int, ...]] = {sizes[first]: (first,)}
    order = [sizes[first]]
    for i in range(first, len(sizes)):
        for used in list(order):
            have = best[used]
            for k in range(1, min(left[i] - have.count(i), (capacity - used) // sizes[i]) + 1):
                if (u := used + k * sizes[i]) not in best:
                    best[u] = (*have, *[i] * k)
                    order.append(u)
    return list(best[max(best)])


def plan(counts: dict[int, int], capacity: int, groups: int = 48, small_part: float = 0.25) -> list[Run]:
    """Runs of equal bins that hold each length as often as counts says."""
    large = {k: n for k, n in counts.items() if n and k > capacity * small_part}
    small = {k: n for k, n in counts.items() if n and k <= capacity * small_part}
    grouped = group_sizes(large, groups)
    sizes, members = [g[0] for g in grouped], [g[1] for g in grouped]
    left = [sum(n for _, n in m) for m in members]
    runs: list[Run] = []
    while any(left):
        config = fullest(sizes, left, capacity)
        times = min(left[i] // config.count(i) for i in set(config))
        for i in set(config):
            left[i] -= times * config.count(i)
        while times:  # actual lengths, as many bins at once as all slots agree on
            n, taken = times, []
            for i in config:
                taken.append(next(m for m in members[i] if m[1] > sum(t is m for t in taken)))
            for m in {id(t): t for t in taken}.values():
                n = min(n, m[1] // sum(t is m for t in taken))
            for m in taken:
                m[1] -= n
            items = [m[0] for m in taken]
            runs.append(Run(n, items, sum(items)))
            members = [[m for m in g if m[1]] if g and not g[0][1] else g for g in members]
            times -= n
    rooms: dict[int, list[Run]] = {}
    free: list[int] = []

    def put(run: Run) -> None:
        if (room := capacity - run.used) not in rooms:
            rooms[room] = []
            bisect.insort(free, room)
        rooms[room].append(run)

    for run in runs:
        put(run)
    full: list[Run] = []
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                room = free[at]
                run = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
                times = max(1, min(room // length, n // run.bins)) if n >= run.bins else 1
                bins = min(run.bins, n)
                if bins < run.bins:
                    put(Run(run.bins - bins, list(run.items), run.used))
            else:
                times = max(1, min(capacity // length, n))
                bins = max(1, n // times)
                run = Run(0)
            made = Run(bins, run.items + [length] * times, run.used + length * times)
            n -= bins * times
            (put if made.used < capacity else full.append)(made)
    return full + [r for rs in rooms.values() for r in rs]


def slots(runs: list[Run]) -> np.ndarray:
    """(length, first rank, bins, first sequence, offset) of every slot, ordered by length and rank."""
    rows, sequence, rank = [], 0, {}
    for run in runs:
        offset = 0
        for length in run.items:
            rows.append((length, rank.get(length, 0), run.bins, sequence, offset))
            rank[length] = rank.get(length, 0) + run.bins
            offset += length
        sequence += run.bins
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Token pieces of every document, with the task that cut them and their rank there among pieces of their length."""
    model = ship_vocabulary(docs.sparkSession, vocabulary)
    numbers = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("task_rank", T.LongType())]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, seen = model(), TaskContext.get().partitionId(), {}
        for b in text_slices(batches, text):
            ids, at = m.encode(b.column(text).to_pylist())
            ids = np.insert(ids, at[1:], end_id).astype("<u4")
            at = at + np.arange(len(at))
            rows, owner = [], []
            for row, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                for piece, start in enumerate(range(begin, end, capacity)):
                    stop = min(start + capacity, end)
                    rank = seen.get(stop - start, 0)
                    seen[stop - start] = rank + 1
                    owner.append(row)
                    rows.append((piece, start - begin, stop - start, zlib.crc32(ids[start:stop].tobytes()), task, rank))
            columns = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.record_batch([b.column(key).take(pa.array(owner)), *columns], [key, *(n for n, _ in numbers)])

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, groups: int = 48, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id, text, key), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most one row for each length up to the capacity reaches the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity, groups)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    placed = pieces.join(starts, ["task", "length"])
    schema = T.StructType([*(placed.schema[c] for c in (key, "piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, bins, sequence, offset = table.value.T
        span = int((first + bins).max(initial=0)) + 1
        begin = length * span + first
        for b in batches:
            rank = b.column("task_rank").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(begin, b.column("length").to_numpy() * span + rank, side="right") - 1
            yield pa.record_batch([*(b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")), pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], schema.names)

    return placed.select(key, "piece", "start", "length", "ids_crc32", "task_rank", "before").mapInArrow(place, schema)
