"""Prefix trie of conversations: an LCP-aware mergesort over the cluster, and one pass with a stack of open nodes.

A turn is told by 128 bits of the SHA-256 of its role and text, so that texts never leave the scan. A conversation is the sequence
of its turns' codes. Equal conversations meet first (by a 128-bit digest, their ids in order) and become one entry. Tasks sort
bounded runs of entries and write with each entry how many turns it shares with the one before it (its LCP). The runs go to
partitions of contiguous ranges, balanced by sampled keys and sized by bytes, and a loser tree merges them there: entries are
compared by their LCPs with the last winner first and by turns only from there on. The merged stream keeps the path of open nodes on
a stack; a node is finished when the next entry shares fewer turns than its depth. Nodes on the path of the first or the last entry
of a range may go on in another range: these alone, at most two paths a partition, meet by the digest of their prefix in one task.

A null role or text counts as empty. Rows without a conv_id are no conversation. Turns with the same number (or none; these come
first) stand in the order of their codes, repeated rows included. The base of conversation c is c - pmod(c, 5), for negative c too.
Texts are only hashed by Spark, however long; a task holds the codes (24 bytes a turn) of one conversation while it rebuilds it, and
those of one range while it merges. The digest of the ids that end at a node is sequential, so equal conversations are read by one
task, as a stream of ids. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, shuffle_partitions

#: Bytes of a turn: its code and the UTF-8 length of its text, big-endian.
CODE, UNIT = 16, 24
#: A conversation takes over fewer turns of its base than this.
TAKES, BLOCK = 9, 5
#: Bytes of entries that a task sorts as one run, and that a range holds.
RUN_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
#: Turns of an entry that the ranges are cut by.
KEY_TURNS = 64
NO_IDS = hashlib.sha256().hexdigest()


def turn_codes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, unit): the code and size of each turn, made by Spark."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * CODE))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (UNIT - CODE), "0"))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat(code, size).alias("unit"))


def rebuilt(codes: DataFrame) -> DataFrame:
    """(conv_id, digest, entry) of every conversation, with the first turns of its block's base in place of its own."""
    block = (F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))).alias("block")
    dealt = codes.select(block, "conv_id", "turn", "unit").repartition(shuffle_partitions(codes.sparkSession), "block").sortWithinPartitions("block", "conv_id", F.asc_nulls_first("turn"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_of, base = None, b""
        now, units = None, bytearray()
        out: list[tuple[int, bytes, bytes]] = []
        held = 0

        def close() -> int:
            nonlocal base_of, base
            if now is None:
                return 0
            if now % BLOCK == 0:
                base_of, base = now, bytes(units[: (TAKES - 1) * UNIT])
            taken = crc32(str(now).encode()) % TAKES * UNIT
            entry = (base[:taken] if base_of == now - now % BLOCK else b"") + bytes(units[taken:])
            out.append((now, hashlib.blake2b(entry, digest_size=CODE).digest(), entry))
            return len(entry)

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["conv_id", "digest", "entry"])
            out.clear()
            return made

        for b in batches:
            for conv, unit in zip(b.column("conv_id").to_pylist(), b.column("unit").to_pylist(), strict=True):
                if conv != now:
                    held += close()
                    now, units = conv, bytearray()
                    if held > RUN_BYTES // 4:
                        yield batch()
                        held = 0
                units += unit
        close()
        yield batch()

    return dealt.select("conv_id", "unit").mapInArrow(run, "conv_id long, digest binary, entry binary")


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """How many first units a and b share, given that they share the first known ones."""
    most = min(len(a), len(b)) // UNIT
    step = 1
    while known < most:
        if a[known * UNIT : (known + step) * UNIT] == b[known * UNIT : (known + step) * UNIT]:
            known = min(known + step, most)
            step *= 2
        elif step == 1:
            break
        else:
            step = 1
    return known


def sorted_runs(conversations: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, place, lcp, entry, n, least, ends): distinct entries with their members, in sorted runs that carry LCPs."""
    dealt = conversations.repartition(shuffle_partitions(conversations.sparkSession), "digest").sortWithinPartitions("digest", "conv_id")
    kinds = {"run": pa.int64(), "place": pa.int64(), "lcp": pa.int64(), "entry": pa.binary(), "n": pa.int64(), "least": pa.int64(), "ends": pa.string()}
    schema = "run long, place long, lcp long, entry binary, n long, least long, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        now, entry, n, least, ids = None, b"", 0, 0, hashlib.sha256()

        def close() -> int:
            if now is None:
                return 0
            held.append((entry, n, least, ids.hexdigest()))
            return len(entry) + 100

        def sort() -> pa.RecordBatch:
            held.sort()
            shared = [common_turns(a[0], b[0]) for a, b in zip(held, held[1:], strict=False)]
            rows = [[number] * len(held), range(len(held)), [0, *shared][: len(held)], *zip(*held, strict=True)]
            batch = pa.record_batch([pa.array(x, t) for x, t in zip(rows, kinds.values(), strict=True)], list(kinds))
            held.clear()
            return batch

        for b in batches:
            for conv, digest, of in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), b.column("entry").to_pylist(), strict=True):
                if digest != now:
                    size += close()
                    if size > run_bytes:
                        yield sort()
                        number, size = number + 1, 0
                    now, entry, n, least, ids = digest, of, 1, conv, hashlib.sha256(str(conv).encode())
                else:
                    n += 1
                    ids.update(b",%d" % conv)
        close()
        if held:
            yield sort()

    return dealt.mapInArrow(run, schema)


@dataclass
class Run:
    """A sorted run as the loser tree reads it: the entry it stands at, and what that shares with the last winner."""

    entries: list[tuple]  # (lcp with the one before, entry, ...)
    at: int = 0
    shared: int = 0

    def head(self) -> bytes | None:
        return self.entries[self.at][1] if self.at < len(self.entries) else None


def merge(runs: list[Run]) -> Iterator[tuple[int, tuple]]:
    """(turns shared with the one before, entry and its values) of all runs in order, by a loser tree."""

    def beats(x: Run, y: Run) -> bool:
        """Whether x comes before y; the later of them then knows what it shares with the earlier."""
        a, b = x.head(), y.head()
        if a is None or b is None:
            return b is None
        if x.shared != y.shared:  # both follow the last winner: the one that shares more with it comes first
            return x.shared > y.shared
        k = common_turns(a, b, x.shared)
        first = a[k * UNIT : (k + 1) * UNIT] <= b[k * UNIT : (k + 1) * UNIT]
        (y if first else x).shared = k
        return first

    width = 1
    while width < len(runs):
        width *= 2
    runs = runs + [Run([]) for _ in range(width - len(runs))]
    tree: list[Run] = [None] * width  # losers; the winner comes out at the top

    def play(node: int) -> Run:
        if node >= width:
            return runs[node - width]
        x, y = play(2 * node), play(2 * node + 1)
        won, tree[node] = (x, y) if beats(x, y) else (y, x)
        return won

    place = {id(r): i for i, r in enumerate(runs)}
    best = play(1)
    while best.head() is not None:
        yield best.shared, best.entries[best.at]
        best.at += 1
        if best.at < len(best.entries):
            best.shared = best.entries[best.at][0]
        node = (place[id(best)] + width) // 2
        while node:
            if not beats(best, tree[node]):
                best, tree[node] = tree[node], best
            node //= 2


@dataclass
class Node:
    """An open node of the path; children, leaves and saved are those of its finished children."""

    size: int = 0  # bytes of its last text
    prefix: bytes | None = None  # told only where the node may go on in another range
    n_convs: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str = NO_IDS
    waiting: list[Row] = field(default_factory=list)  # finished children, which lack the id of this node

    def gather(self, n: int, least: int) -> None:
        self.n_convs += n
        self.least = least if self.least is None else min(self.least, least)

    def add_child(self, leaves: int, saved: int) -> None:
        self.children += 1
        self.leaves += leaves
        self.saved += saved


class Row(NamedTuple):
    """A node as the tasks write it. With a prefix: the figures of one range; else whole, below the node parent_prefix if that is told."""

    depth: int
    prefix: bytes | None
    parent_prefix: bytes | None
    conv_id: int
    parent_conv_id: int | None
    n_convs: int
    n_children: int
    n_leaves: int
    saved_tokens: int
    size: int
    ends_sha256: str


ROW_SCHEMA = "depth long, prefix binary, parent_prefix binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
ROOT = b"root"


def _prefixes(entry: bytes) -> list[bytes]:
    """A digest of each prefix of an entry, the empty one first."""
    out = [ROOT]
    for i in range(0, len(entry), UNIT):
        out.append(hashlib.blake2b(out[-1] + entry[i : i + UNIT], digest_size=CODE).digest())
    return out


def finished_nodes(merged: Iterator[tuple[int, tuple]]) -> Iterator[Row]:
    """The nodes of one range: those on its first and last path with a prefix, all others whole."""
    path = [Node(prefix=ROOT)]

    def close(depth: int) -> Iterator[Row]:
        while len(path) - 1 > depth:
            node = path.pop()
            up, d = path[-1], len(path)
            up.gather(node.n_convs, node.least)
            if node.prefix is not None:
                yield Row(d, node.prefix, up.prefix, node.least, None, node.n_convs, node.children, node.leaves, node.saved, node.size, node.ends)
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n_convs - 1) * node.size
            up.add_child(leaves, saved)
            yield from (row._replace(parent_conv_id=node.least) for row in node.waiting)
            row = Row(d, None, up.prefix, node.least, None, node.n_convs, node.children, leaves, saved, node.size, node.ends)
            if up.prefix is None:
                up.waiting.append(row)
            else:
                yield row

    entry = None
    for shared, (_, now, n, least, ends) in merged:
        names = _prefixes(now) if entry is None else None
        yield from close(shared)
        for d in range(len(path), len(now) // UNIT + 1):
            path.append(Node(int.from_bytes(now[d * UNIT - UNIT + CODE : d * UNIT], "big"), names[d] if names else None))
        path[-1].gather(n, least)
        path[-1].ends = ends
        entry = now
    if entry is None:
        return
    for node, name in zip(path, _prefixes(entry), strict=True):
        node.prefix = name
        yield from (row._replace(parent_prefix=name) for row in node.waiting)
    yield from close(0)
    root = path[0]
    yield Row(0, ROOT, None, root.least, None, root.n_convs, root.children, root.leaves, root.saved, 0, root.ends)


def _to_arrow(rows: list[Row], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


ARROW = pa.schema([(n.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[n.split()[1]]) for n in ROW_SCHEMA.split(", ")])


def merged_ranges(runs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of all ranges."""
    spark = runs.sparkSession
    total = runs.agg(F.sum(F.octet_length("entry") + 100)).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-total // range_bytes))
    dealt = runs.repartitionByRange(ranges, F.substring("entry", 1, KEY_TURNS * UNIT)).sortWithinPartitions("run", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Run] = []
        last = None
        for b in batches:
            for number, *values in zip(*(b.column(c).to_pylist() for c in ("run", "lcp", "entry", "n", "least", "ends")), strict=True):
                if number != last:
                    found.append(Run([]))
                    last = number
                found[-1].entries.append(tuple(values))
        out: list[Row] = []
        for row in finished_nodes(merge(found)) if found else ():
            out.append(row)
            if len(out) == 10_000:
                yield _to_arrow(out, ARROW)
                out = []
        yield _to_arrow(out, ARROW)

    return dealt.mapInArrow(run, ROW_SCHEMA)


def joined_paths(parts: DataFrame) -> DataFrame:
    """The nodes with a prefix, whole: figures of all ranges added up, deepest nodes first. Two paths a range, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[bytes, Node] = {}
        above: dict[bytes, tuple[int, bytes | None]] = {}
        for b in batches:
            for row in (Row(**r) for r in b.to_pylist()):
                node = nodes.setdefault(row.prefix, Node(row.size, row.prefix))
                above[row.prefix] = row.depth, row.parent_prefix
                node.gather(row.n_convs, row.conv_id)
                node.children += row.n_children
                node.leaves += row.n_leaves
                node.saved += row.saved_tokens
                node.ends = row.ends_sha256 if node.ends == NO_IDS else node.ends
        out = []
        for prefix in sorted(nodes, key=lambda p: -above[p][0]):
            node, (depth, up) = nodes[prefix], above[prefix]
            leaves, saved = node.leaves or 1, node.saved + (node.n_convs - 1) * node.size
            if up is not None:
                nodes[up].add_child(leaves, saved)
            out.append(Row(depth, prefix, up, node.least, nodes[up].least if up is not None else None, node.n_convs, node.children, leaves, saved, node.size, node.ends))
        yield _to_arrow(out, ARROW)

    return parts.repartition(1).mapInArrow(run, ROW_SCHEMA)


def prefix_trie(conversations: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, the textless root included."""
    runs = materialize(sorted_runs(rebuilt(turn_codes(conversations)), run_bytes), "trie-runs")
    rows = materialize(merged_ranges(runs, range_bytes), "trie-rows")
    paths = materialize(joined_paths(rows.where("prefix IS NOT NULL")), "trie-paths")
    whole = rows.where("prefix IS NULL")
    below = whole.where("parent_prefix IS NOT NULL").drop("parent_conv_id").join(paths.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("parent_conv_id")), "parent_prefix")
    return whole.where("parent_prefix IS NULL").select(*COLUMNS).unionByName(below.select(*COLUMNS)).unionByName(paths.select(*COLUMNS))
