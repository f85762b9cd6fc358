"""Embedding near-dedup by NN-descent.

Equal vectors are one node that counts as many, known by the 64-bit hash of its unit vector. Neighbour lists start from random-hyperplane
buckets. Each round joins every node's neighbours with one another (forward and reverse lists, in blocks of bounded size) and keeps the
``k`` best of each node. What a block links at or over the threshold is kept beside the lists for good, as one edge of each node to the first
of its group there, so that no link once seen is lost to a better one. These edges form components. Lists that hold nothing but such
edges are saturated and look no further: inside a component all is compared block by block, and saturated nodes of different components
are compared through pieces of bounded size, of which only those are left out whose centres and radii rule a link out. No group of
copies sits in one task.

Recall is audited twice after each round. A bounded sample of vectors is compared with all: the found share of a vector's true links, on average
over the vectors with about as many links. And each of the sample has had a partner planted at the threshold's edge, which takes part in all
rounds and is taken out before components are formed: the share of these that was found, so that a table without links is audited too.
Rounds go on while either is under ``recall``. Where it still is after ``most_rounds``, all components are compared with one another exactly.

Vectors that are null, zero, or hold null or non-finite components link with nothing; they get zero links and their own id.
Shorter vectors count as filled up with zeros. Rows that repeat an id are vectors of their own: each has a row with its links, and
``kept`` holds for every row whose id is its component's; rows that repeat id and vector count in each other's links. Ties in a list go to the
greater node. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from docloom.llm.common import connected_components, materialize, shuffle_partitions, with_hot_keys

BLOCK = 64


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def unit_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, raw: hash of the vector as it stands, unit array<double>) of the vectors that can link."""
    inf = float("inf")
    good = vectors.where(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(column, lambda x: x != 0))
    good = good.select(F.col(key).alias("key"), F.xxhash64(column).alias("raw"), F.col(column).alias("v"))
    width = good.agg(F.max(F.size("v"))).first()[0] or 1
    schema = T.StructType([good.schema["key"], T.StructField("raw", T.LongType()), T.StructField("unit", T.ArrayType(T.DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros((b.num_rows, width))
            for i, v in enumerate(b.column("v")):
                x = v.values.to_numpy(zero_copy_only=False)
                rows[i, : len(x)] = x
            rows /= np.abs(rows).max(axis=1, keepdims=True)
            rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            yield pa.record_batch([b.column("key"), b.column("raw"), pa.FixedSizeListArray.from_arrays(pa.array((rows + 0.0).ravel()), width).cast(pa.list_(pa.float64()))], schema.names)

    return good.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of sorted rows in which no group of keys goes on in the next, unless it has more than most rows."""
    rest: pa.Table | None = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = now if rest is None else pa.concat_tables([rest, now])
        starts = group_starts(now, keys)
        last = int(starts[-1]) if len(starts) and now.num_rows - starts[-1] <= most else now.num_rows
        if last:
            yield now.slice(0, last).combine_chunks()
        rest = now.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def block_spans(starts: np.ndarray, end: int, block: int) -> Iterator[tuple[int, int]]:
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True):
        for i in range(s, e, block):
            yield i, min(i + block, e)


_EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("link", T.BooleanType())])
#: Similarity of rows that are links through others only.
_NO_SIM = -3.0


def first_linked(near: np.ndarray) -> np.ndarray:
    """For each place of a symmetric matrix the first place that it is linked with, directly or through others."""
    n = len(near)
    label = np.arange(n)
    while True:
        now = np.minimum(label, np.where(near, label, n).min(axis=1))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _local_join(keys: list[str], k: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Within each group (in blocks), edges from each node to its k best there that beat its list's last entry, and its link to the first of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys):
            node, unit, worst = t.column("node").to_numpy(), matrix(t.column("unit")), t.column("worst").to_numpy()
            a, b, sim, link = [], [], [], []
            for s, e in block_spans(group_starts(t, keys), t.num_rows, BLOCK):
                if e - s < 2:
                    continue
                got = unit[s:e] @ unit[s:e].T
                got[node[s:e, None] == node[None, s:e]] = -2
                best = np.argpartition(-got, min(k, e - s - 1) - 1, axis=1)[:, :k]
                value = np.take_along_axis(got, best, 1)
                i, j = np.nonzero(value > worst[s:e, None])
                a.append(node[s:e][i])
                b.append(node[s:e][best[i, j]])
                sim.append(value[i, j])
                link.append(np.zeros(len(i), bool))
                near = got >= threshold
                if near.any():
                    head = first_linked(near)
                    i = np.flatnonzero(node[s:e][head] != node[s:e])
                    a.append(node[s:e][i])
                    b.append(node[s:e][head[i]])
                    sim.append(np.full(len(i), _NO_SIM))
                    link.append(np.ones(len(i), bool))
            if a:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (a, b, sim, link)], _EDGES.names)

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node (best), and all its links (link)."""
    top = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("link").alias("link"))
    top = top.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("sim", "b", "link")), False).alias("l"))
    top = top.select("a", F.posexplode("l").alias("at", "x")).select("a", "x.*", ((F.col("at") < k) & (F.col("x.sim") > _NO_SIM)).alias("best"))
    return top.where("best or link").select("a", "b", "sim", "link", "best")


def start_lists(nodes: DataFrame, count: int, k: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """First lists from buckets of random hyperplanes, about half a block in each."""
    bits = max(1, math.ceil(math.log2(max(2, 2 * count / BLOCK))))
    schema = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("place", T.DoubleType()), T.StructField("node", T.LongType()), T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("worst", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = matrix(batch.column("unit"))
            for t in range(tables):
                planes = np.random.default_rng((seed, t)).normal(size=(unit.shape[1], bits + 1))
                side = unit @ planes
                bucket = (side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                n = batch.num_rows
                yield pa.record_batch([pa.array(np.full(n, t), pa.int32()), pa.array(bucket), pa.array(side[:, bits]), batch.column("node"), batch.column("unit"), pa.array(np.full(n, -2.0))], schema.names)

    spread = nodes.mapInArrow(run, schema)
    # by range of bucket and place: a bucket with very many vectors goes to many tasks
    spread = spread.repartitionByRange(shuffle_partitions(nodes.sparkSession), "table", "bucket", "place").sortWithinPartitions("table", "bucket", "place")
    return _best(spread.mapInArrow(_local_join(["table", "bucket"], k, threshold), _EDGES), k)


def descend(nodes: DataFrame, edges: DataFrame, k: int, threshold: float) -> DataFrame:
    """One round: the neighbours of every node, either way, are compared with one another."""
    best = edges.where("best")
    worst = best.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    own = nodes.join(worst, nodes.node == worst.a, "left").select("node", "unit", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    ends = best.select(F.col("a").alias("center"), F.col("b").alias("node"))
    ends = ends.unionByName(best.select(F.col("b").alias("center"), F.col("a").alias("node"))).distinct()
    n = shuffle_partitions(nodes.sparkSession)
    met = ends.join(own, "node").withColumn("place", F.xxhash64("node", "center"))
    met = met.repartitionByRange(n, "center", "place").sortWithinPartitions("center", "place")
    return _best(edges.drop("best").unionByName(met.mapInArrow(_local_join(["center"], k, threshold), _EDGES)), k)


def component_links(members: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(node, links) by comparing each component (component, node, unit, copies) with itself, a pair of blocks at a time."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    put = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = put.select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "unit", "copies")
    keys = ["component", "one", "two"]
    pair = pair.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, most=1 << 30):  # a pair of blocks has a few times block rows
            node, unit, copies, own = t.column("node").to_numpy(), matrix(t.column("unit")), t.column("copies").to_numpy(), t.column("own").to_numpy()
            one, two = t.column("one").to_numpy(), t.column("two").to_numpy()
            starts = group_starts(t, keys)
            nodes, links = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                if one[s] == two[s]:
                    near = unit[s:e] @ unit[s:e].T >= threshold
                    np.fill_diagonal(near, False)
                    nodes.append(node[s:e])
                    links.append(near @ copies[s:e])
                else:
                    m = s + int(np.searchsorted(own[s:e], two[s]))
                    near = unit[s:m] @ unit[m:e].T >= threshold
                    nodes.append(node[s:e])
                    links.append(np.concatenate((near @ copies[m:e], copies[s:m] @ near)))
            yield pa.record_batch([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links).astype(np.int64))], ["node", "links"])

    return pair.drop("blocks").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def pieces(members: DataFrame, block: int) -> DataFrame:
    """members (component, node, unit) in pieces of block nodes of one component; the first row of each holds its centre and radius (an angle)."""
    schema = T.StructType([T.StructField("piece", T.LongType()), *(members.schema[c] for c in ("component", "node", "unit")), T.StructField("center", T.ArrayType(T.DoubleType())), T.StructField("radius", T.DoubleType())])
    spread = T.StructType([*(members.schema[c] for c in ("component", "node", "unit")), T.StructField("place", T.DoubleType())])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = matrix(b.column("unit"))
            side = unit @ np.random.default_rng(11).normal(size=(unit.shape[1], 9))
            place = (side[:, :8] > 0) @ (1 << np.arange(8)) + 0.5 + np.arctan(side[:, 8]) / 4
            yield pa.record_batch([b.column("component"), b.column("node"), b.column("unit"), pa.array(place.astype(float))], spread.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for t in whole_groups(batches, ["component"]):
            unit = matrix(t.column("unit"))
            piece, center, radius = np.zeros(t.num_rows, np.int64), [None] * t.num_rows, [None] * t.num_rows
            for s, e in block_spans(group_starts(t, ["component"]), t.num_rows, block):
                piece[s:e] = number = number + 1
                middle = unit[s:e].sum(axis=0)
                middle = middle / length if (length := np.linalg.norm(middle)) > 1e-6 else unit[s]
                center[s], radius[s] = middle, float(np.arccos(np.clip((unit[s:e] @ middle).min(), -1, 1)))
            columns = [pa.array(piece), *(t.column(c).combine_chunks() for c in ("component", "node", "unit")), pa.array(center, pa.list_(pa.float64())), pa.array(radius, pa.float64())]
            yield pa.record_batch(columns, schema.names)

    laid = members.select("component", "node", "unit").mapInArrow(lay, spread)
    laid = laid.repartitionByRange(shuffle_partitions(members.sparkSession), "component", "place").sortWithinPartitions("component", "place")
    return materialize(laid.drop("place").mapInArrow(cut, schema), "pieces")


def near_pieces(heads: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """(p, q) of the pieces of different components that centres and radii do not keep from a link; chunk pieces are sent to all tasks at a time."""
    sc, count = heads.sparkSession.sparkContext, heads.count()
    steps = max(1, math.ceil(count / chunk))
    angle = math.acos(threshold) + 1e-6
    found = None
    for step in range(steps):
        some = heads.where(F.pmod(F.xxhash64("piece", F.lit(5)), F.lit(steps)) == step).select("piece", "component", "center", "radius").toArrow()
        if not some.num_rows:
            continue
        shipped = sc.broadcast((some.column("piece").to_numpy(), some.column("component").to_numpy(), matrix(some.column("center")), some.column("radius").to_numpy() + angle))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            piece, component, center, reach = shipped.value
            ahead = np.column_stack((center, -np.cos(reach), np.sin(reach)))  # times the other side: cosine less cosine of the reach
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    radius, own = b.column("radius").to_numpy(), b.column("piece").to_numpy()
                    behind = np.column_stack((matrix(b.column("center")), np.cos(radius), np.sin(radius)))
                    open_ = ahead @ behind.T >= -1e-9
                    if reach.max() + radius.max() >= math.pi:
                        open_ |= reach[:, None] + radius >= math.pi
                    i, j = np.nonzero(open_)
                    keep = (piece[i] < own[j]) & (component[i] != b.column("component").to_numpy()[j])
                    yield pa.record_batch([pa.array(piece[i][keep]), pa.array(own[j][keep])], ["p", "q"])

        pairs = materialize(heads.select("piece", "component", "center", "radius").mapInArrow(run, "p long, q long"), "pieces-near")
        found = pairs if found is None else found.unionByName(pairs)
    return heads.select(F.col("piece").alias("p"), F.col("piece").alias("q")).limit(0) if found is None else found


def cross_links(members: DataFrame, threshold: float, block: int = 256, chunk: int = 4096) -> DataFrame:
    """(a, b): components of members (component, node, unit) that a link of two of their members joins. Exact."""
    parts = pieces(members, block)
    pairs = near_pieces(parts.where("center is not null"), threshold, chunk)
    ends = pairs.select("p", "q", F.explode(F.array("p", "q")).alias("piece"))
    met = ends.join(parts.select("piece", "component", "unit"), "piece")
    met = met.repartition(shuffle_partitions(members.sparkSession), "p", "q").sortWithinPartitions("p", "q", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["p", "q"], most=1 << 30):
            unit, piece, q, component = matrix(t.column("unit")), t.column("piece").to_numpy(), t.column("q").to_numpy(), t.column("component").to_numpy()
            starts = group_starts(t, ["p", "q"])
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                m = s + int(np.searchsorted(piece[s:e], q[s]))
                if (unit[s:m] @ unit[m:e].T >= threshold).any():
                    a.append(component[s])
                    b.append(component[m])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def joined(parts: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """parts with the components joined that cross_links finds among members."""
    more = materialize(cross_links(members, threshold), "cross")
    if more.isEmpty():
        return parts
    return materialize(connected_components(parts.toDF("a", "b").unionByName(more)), "parts")


def planted(nodes: DataFrame, threshold: float, sample: int, seed: int = 17) -> tuple[DataFrame, np.ndarray]:
    """A partner of each of a bounded sample of nodes, a tenth of the way from the threshold to one, as nodes; and the pairs of node ids."""
    spark = nodes.sparkSession
    schema = T.StructType([nodes.schema["node"], nodes.schema["unit"]])
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(3))).limit(sample).select("node", "unit").toArrow()
    unit = matrix(chosen.column("unit"))
    if not chosen.num_rows or unit.shape[1] < 2:
        return spark.createDataFrame([], schema), np.zeros((0, 2), np.int64)
    side = np.random.default_rng(seed).normal(size=unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.9 * threshold + 0.1
    made = near * unit + math.sqrt(1 - near * near) * side
    ids = chosen.column("node").to_numpy()
    own = np.array([xxh3_64_intdigest(v.tobytes(), seed) for v in made], np.uint64).view(np.int64)
    return spark.createDataFrame(list(zip(own.tolist(), made.tolist(), strict=True)), schema), np.column_stack((ids, own))


def planted_recall(lists: DataFrame, pairs: np.ndarray, threshold: float) -> float:
    """Share of the planted pairs that the lists link."""
    if not len(pairs):
        return 1.0
    want = F.broadcast(lists.sparkSession.createDataFrame(pairs.tolist(), "a long, b long"))
    both = lists.where((F.col("sim") >= threshold) | F.col("link")).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return both.join(want.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"]).distinct().count() / len(pairs)


def audit(nodes: DataFrame, parts: DataFrame, threshold: float, sample: int) -> float:
    """Share of a vector's links, found by comparing a bounded sample with all vectors, that lie inside one found component.

    It is averaged over vectors, so that dense groups do not stand for pairs, by doublings of the number of links; the least counts.
    """
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(3))).limit(sample).toArrow()
    if not chosen.num_rows:
        return 1.0
    shipped = nodes.sparkSession.sparkContext.broadcast((chosen.column("node").to_numpy(), matrix(chosen.column("unit"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shipped.value
        for b in batches:
            node = b.column("node").to_numpy()
            i, j = np.nonzero(unit @ matrix(b.column("unit")).T >= threshold)
            keep = ids[i] != node[j]
            yield pa.record_batch([pa.array(ids[i][keep]), pa.array(node[j][keep])], ["x", "y"])

    true = nodes.mapInArrow(run, "x long, y long")
    one, two = parts.toDF("x", "cx"), parts.toDF("y", "cy")
    own = true.join(one, "x", "left").join(two, "y", "left").groupBy("x").agg(F.count("*").alias("n"), F.count_if(F.col("cx") == F.col("cy")).alias("found"))
    least = own.groupBy(F.floor(F.log2("n"))).agg(F.avg(F.col("found") / F.col("n")).alias("share")).agg(F.min("share")).first()[0]
    return 1.0 if least is None else least


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = 8, tables: int = 8, rounds: int = 2, most_rounds: int = 6, recall: float = 0.97, sample: int = 512, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    units = materialize(unit_vectors(vectors, key, column).withColumn("node", F.xxhash64("unit")), "units")
    nodes = materialize(units.groupBy("node").agg(F.first("unit").alias("unit"), F.min("key").alias("least"), F.count("*").alias("copies")), "nodes")
    count = nodes.count()
    plants, pairs = planted(nodes, threshold, sample)
    taking = nodes.select("node", "unit").unionByName(plants)
    lists = materialize(start_lists(taking, count, k, tables, 1, threshold), "lists")
    for done in range(1, most_rounds + 1):
        lists = materialize(descend(taking, lists, k, threshold), "lists")
        if done < rounds:
            continue
        out = F.broadcast(plants.select("node"))  # sample rows at most
        own = lists.join(out, lists.a == out.node, "left_anti").join(out, F.col("b") == out.node, "left_anti")
        parts = materialize(connected_components(own.where((F.col("sim") >= threshold) | F.col("link")).select("a", "b")), "parts")
        full = lists.where("best").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n"), F.min("sim").alias("least_sim")).where((F.col("n") >= k) & (F.col("least_sim") >= threshold))
        parts = joined(parts, nodes.join(full, "node").join(parts, "node").select("component", "node", "unit"), threshold)
        if planted_recall(lists, pairs, threshold) >= recall and audit(nodes, parts, threshold, sample) >= recall:
            break
        if done == most_rounds:
            every = nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "unit")
            parts = joined(parts, every, threshold)
            break
        fresh = start_lists(taking, count, k, tables, 1 + done, threshold)
        lists = materialize(_best(lists.unionByName(fresh).drop("best"), k), "lists")
    members = nodes.join(parts, "node").select("component", "node", "unit", "copies")
    links = component_links(members, threshold)
    named = parts.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    found = nodes.join(parts, "node", "left").join(F.broadcast(named) if count <= 1_000_000 else named, "component", "left").join(links, "node", "left")
    found = found.select("node", F.col("copies").alias("n"), F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = units.select("key", "raw", "node").distinct()
    owner = with_hot_keys(rows, materialize(found, "found"), "node", units.count()).select("key", "raw", "n_links", "component_id")
    asked = vectors.select(F.col(key).alias("key"), F.xxhash64(column).alias("raw"))
    out = asked.join(owner, ["key", "raw"], "left").withColumnRenamed("key", key)
    component = F.coalesce("component_id", key)
    return out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col(key) == component).alias("kept"))
