"""Communities of an undirected graph by Louvain's method: rounds of moves on each level, then contraction into a weighted graph.

A level holds its nodes with the sum of their weights (d) and the weight of their loops, both ways counted, and its edges once from
each end. In a round every node finds the community next to it that raises modularity most; a hash of node and round picks the half
that moves, so that neighbours do not trade places. A level is settled when no node wants to move, or when rounds stop raising
modularity; its best round counts. A level may need hundreds of rounds. One of more than TASK_ROWS rows of nodes and edges has each
round spread over all tasks, with four shuffles by key, whatever the graph's shape, and one written table of nodes. A smaller one, as
most become by contraction, goes through the same rounds in the memory of one task, which works out anew only the weights of nodes
next to a move; spread out, its jobs would take a hundred times as long as its arithmetic. A settled level is
then contracted, and levels end when one raises modularity by less than LEAST_GAIN. The nodes then move once more from the communities
found, and all is done again, until a whole pass gains nothing. Levels have as many rounds as they need, which grow with the graph: rounds end
as modularity is at most 1 and each PATIENCE of them must add to it. A caller may set a limit, beyond which an error is raised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage

LEAST_GAIN = 1e-7
PATIENCE = 8
#: Nodes and edges (from each end) of a level that one task settles, under 300 bytes each; a larger level is spread over all tasks.
TASK_ROWS = 1 << 20


@dataclass
class Level:
    """nodes (node, d, loop); edges (a, b, w) with a <> b, from each end; total: the sum of all d."""

    nodes: DataFrame
    edges: DataFrame
    total: float


def first_level(edges: DataFrame) -> Level:
    """Distinct unordered pairs of edges (a, b), each of weight 1; an edge from a node to itself is left out."""
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    both = cut_lineage(pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b", F.lit(1.0).alias("w")))
    nodes = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d")).withColumn("loop", F.lit(0.0)))
    return Level(nodes, both, nodes.agg(F.sum("d")).first()[0] or 0.0)


def moves(level: Level, labels: DataFrame, number: int, resolution: float) -> DataFrame:
    """labels (node, d, loop, community) after one round, with inside (weight between a node and its community before), was and wants."""
    weight = labels.groupBy(F.col("community").alias("to")).agg(F.sum("d").alias("tot"))
    label_of = labels.select(F.col("node").alias("b"), F.col("community").alias("to"))
    near = level.edges.join(label_of, "b").select(F.col("a").alias("node"), "to", "w")
    own = labels.select("node", F.col("community").alias("to"), F.lit(0.0).alias("w"))
    choice = near.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("k")).join(weight, "to").join(labels, "node")
    here = F.col("to") == F.col("community")
    gain = F.round(F.col("k") - resolution * F.col("d") * (F.col("tot") - F.when(here, F.col("d")).otherwise(0.0)) / level.total, 9)
    best = choice.withColumn("gain", gain).groupBy("node").agg(
        F.min_by("to", F.struct(-F.col("gain"), F.col("to"))).alias("best"), F.max("gain").alias("top"), F.max(F.when(here, F.col("gain"))).alias("stay"), F.max(F.when(here, F.col("k"))).alias("inside"),
        F.first("d").alias("d"), F.first("loop").alias("loop"), F.first("community").alias("was"),
    )
    wants = F.col("top") > F.col("stay")
    turn = F.substring(F.md5(F.concat_ws(":", F.col("node").cast("string"), F.lit(str(number)))), 1, 1) < "8"
    return best.select("node", "d", "loop", F.when(wants & turn, F.col("best")).otherwise(F.col("was")).alias("community"), "was", "inside", wants.alias("wants"))


def _modularity(level: Level, marked: DataFrame, resolution: float) -> tuple[float, int]:
    """Of the communities before a round; and how many nodes want to move."""
    sums = marked.groupBy("was").agg(F.sum(F.col("inside") + F.col("loop")).alias("inside"), F.sum("d").alias("tot"), F.sum(F.col("wants").cast("long")).alias("wants"))
    inside, squares, wants = sums.agg(F.sum("inside"), F.sum(F.col("tot") * F.col("tot")), F.sum("wants")).first()
    return inside / level.total - resolution * squares / level.total**2, wants


def settle(level: Level, start: DataFrame, resolution: float, most_rounds: int | None = None) -> tuple[DataFrame, float]:
    """(node, community) of one level, moved on from start, and its modularity."""
    labels = level.nodes.join(start, "node")
    best, most, since = labels, float("-inf"), 0
    for number in count() if most_rounds is None else range(most_rounds):
        marked = cut_lineage(moves(level, labels, number, resolution))
        now, wants = _modularity(level, marked, resolution)
        since = 0 if now > most + LEAST_GAIN else since + 1
        if now > most:
            best, most = labels, now
        if not wants or since >= PATIENCE:
            return best.select("node", "community"), most
        labels = marked.select("node", "d", "loop", "community")
    raise RuntimeError(f"communities did not settle in {most_rounds} rounds")


class Table:
    """A level in the memory of one task. Nodes are numbers in the order of their names.

    Each node has a slot for each of its edges and one for itself. Within a node, the slots are sorted by the community they lead to; the first
    slot of a community has the weight towards it, the others have none.
    """

    def __init__(self, d: np.ndarray, loop: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, resolution: float):
        n = len(d)
        self.d, self.loop, self.total, self.resolution = d, loop, total, resolution
        ends = np.concatenate([a, np.arange(n)])
        order = np.argsort(ends, kind="stable")
        self.node, self.next, self.w = ends[order], np.concatenate([b, np.arange(n)])[order], np.concatenate([w, np.zeros(n)])[order]
        self.begin = np.searchsorted(self.node, np.arange(n))
        self.to, self.k = np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends))

    def renew(self, labels: np.ndarray, nodes: np.ndarray) -> None:
        """Communities and weights of the slots of some nodes (a mask)."""
        own = np.flatnonzero(nodes[self.node])
        if not len(own):
            return
        node, to = self.node[own], labels[self.next[own]]
        order = np.lexsort((to, node))
        to, w = to[order], self.w[own][order]
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (to[1:] != to[:-1])])
        self.to[own], self.k[own] = to, -np.inf
        self.k[own[first]] = np.add.reduceat(w, first)

    def rounds(self, labels: np.ndarray, names: list[str], most_rounds: int | None) -> tuple[np.ndarray, float | None]:
        """As settle does: the best labels and their modularity; None if most_rounds did not do."""
        best, most, since = labels, float("-inf"), 0
        changed = np.ones(len(labels), dtype=bool)
        for number in count() if most_rounds is None else range(most_rounds):
            self.renew(labels, changed)
            tot = np.bincount(labels, self.d, len(labels))
            here = self.to == labels[self.node]
            gain = self.k - self.resolution * self.d[self.node] * (tot[self.to] - np.where(here, self.d[self.node], 0.0)) / self.total
            gain = np.copysign(np.floor(np.abs(gain) * 1e9 + 0.5), gain)  # halves away from zero, as SQL rounds
            top = np.maximum.reduceat(gain, self.begin)
            own = np.flatnonzero(here & (self.k > -np.inf))
            now = (self.k[own].sum() + self.loop.sum()) / self.total - self.resolution * (tot * tot).sum() / self.total**2
            wants = top > gain[own]
            since = 0 if now > most + LEAST_GAIN else since + 1
            if now > most:
                best, most = labels, now
            if not wants.any() or since >= PATIENCE:
                return best, most
            moved = np.zeros(len(labels), dtype=bool)
            for x in np.flatnonzero(wants).tolist():
                moved[x] = hashlib.md5(f"{names[x]}:{number}".encode()).digest()[0] < 128
            slots = np.flatnonzero(moved[self.node])
            tops = slots[gain[slots] == top[self.node[slots]]]
            node, first = np.unique(self.node[tops], return_index=True)
            labels = labels.copy()
            labels[node] = self.to[tops[first]]
            changed = moved
            changed[self.next[slots]] = True
        return best, None


def settle_in_a_task(level: Level, start: DataFrame, resolution: float, most_rounds: int | None = None) -> tuple[DataFrame, float]:
    """What settle gives, by one task that holds the whole level; communities of start are named after nodes of the level."""
    total = level.total
    nodes = level.nodes.join(start, "node").select(F.col("node").alias("a"), F.col("community").alias("b"), F.lit(None).cast("double").alias("w"), "d", "loop", F.col("node").cast("string").alias("name"))
    rows = nodes.unionByName(level.edges, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own, edges = t.filter(pc.is_null(t["w"])).sort_by("a"), t.filter(pc.is_valid(t["w"]))
        names = own["a"].combine_chunks()
        number = lambda c: pc.index_in(c, value_set=names).to_numpy().astype(np.int64)
        table = Table(own["d"].to_numpy(), own["loop"].to_numpy(), number(edges["a"]), number(edges["b"]), edges["w"].to_numpy(), total, resolution)
        labels, reached = table.rounds(number(own["b"]), own["name"].to_pylist(), most_rounds)
        yield from pa.table({"node": names, "community": names.take(pa.array(labels)), "reached": pa.array([reached] * len(names), pa.float64())}).to_batches(max_chunksize=10_000)

    kind = level.nodes.schema["node"].dataType.simpleString()
    found = cut_lineage(rows.coalesce(1).mapInArrow(run, f"node {kind}, community {kind}, reached double"))
    reached = found.select("reached").first()[0]
    if reached is None:
        raise RuntimeError(f"communities did not settle in {most_rounds} rounds")
    return found.select("node", "community"), reached


def settled(level: Level, start: DataFrame, resolution: float, most_rounds: int | None = None) -> tuple[DataFrame, float]:
    """(node, community) of one level and its modularity, by one task or by all."""
    rows = level.nodes.select("d").unionByName(level.edges.select(F.col("w").alias("d"))).count()
    return (settle_in_a_task if rows <= TASK_ROWS else settle)(level, start, resolution, most_rounds)


def contract(level: Level, found: DataFrame) -> Level:
    """The graph of communities: weights between them added up, weights inside as loops."""
    a, b = found.toDF("a", "ca"), found.toDF("b", "cb")
    joined = cut_lineage(level.edges.join(a, "a").join(b, "b").groupBy("ca", "cb").agg(F.sum("w").alias("w")))
    nodes = level.nodes.join(found, "node").groupBy(F.col("community").alias("node")).agg(F.sum("d").alias("d"), F.sum("loop").alias("loop"))
    inner = joined.where("ca = cb").select(F.col("ca").alias("node"), F.col("w").alias("inner"))
    nodes = nodes.join(inner, "node", "left").select("node", "d", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"))
    return Level(cut_lineage(nodes), joined.where("ca <> cb").toDF("a", "b", "w"), level.total)


def louvain(edges: DataFrame, resolution: float = 1.0, most_rounds: int | None = None) -> DataFrame:
    """(node, community) of every node of edges (a, b); a community is named after its smallest node.

    Nodes without an edge to another are in no row. A graph without edges gives no rows; null ends are left out.
    """
    base = first_level(edges)
    alone = lambda level: level.nodes.select("node", F.col("node").alias("community"))
    found, best = alone(base), float("-inf")
    while base.total:
        step, reached = settled(base, found, resolution, most_rounds)
        now, level = cut_lineage(step), base
        of = now
        while True:
            level = contract(level, of)
            step, more = settled(level, alone(level), resolution, most_rounds)
            if more <= reached + LEAST_GAIN:
                break
            of, reached = cut_lineage(step), more
            now = cut_lineage(now.join(of.toDF("community", "next"), "community").select("node", F.col("next").alias("community")))
        if reached <= best + LEAST_GAIN:
            break
        found, best = now, reached
    smallest = found.groupBy("community").agg(F.min("node").alias("least"))
    return found.join(smallest, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Of communities (node, community) over distinct unordered pairs of edges (a, b)."""
    level = first_level(edges)
    ends = level.edges.join(communities.toDF("a", "ca"), "a").join(communities.toDF("b", "cb"), "b")
    inside = ends.where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = ends.groupBy("ca").agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inside / level.total - resolution * squares / level.total**2
