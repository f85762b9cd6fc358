"""Line dedup by an exact set-similarity join.

A line is the set of its word shingles (``shingle`` words, lower case; hashed to 64 bits). A line of fewer words, but ``least`` at
least, is one shingle of all its words; lines of fewer words than that, blank ones among them, are left alone. A line is
removed when an earlier one (by document id, then line number) has a Jaccard similarity of ``part[0] / part[1]`` or more, whether or
not that one stays itself.

1. Shingles are counted over all documents in 2**18 hash places; the order of shingles is by that count, then by hash. A
   place's count is at least the shingle's own, and any common order keeps the join exact.
2. Every line is read once into its set. Of the equal sets of one batch the first place alone goes on, so a line that very many
   documents share reaches the shuffle once a batch. Equal sets (two 64-bit digests and the size) then meet in a window by place:
   the first stands for all, the others go.
3. A set's prefix holds its ``n - ceil(part * n) + 1`` rarest shingles; similar sets share one. Prefix entries are dealt by
   range of (shingle, set), so that a hot shingle spreads over tasks. Length filter, positional filter and a 64-bit parity signature (its
   differing bits never exceed the shingles that differ) leave the candidates. In groups of up to ``SMALL`` sets all meet; in larger ones,
   and in those that go on in another task, every set meets the earliest first. Candidates are verified on their sets, read again
   from the documents that hold them.
4. Sets of large groups that this does not remove meet the others a pair of bounded blocks at a time, and are verified there; a set
   is all that comes out, never its pairs.

Null texts stay null; empty texts and blank lines stay. Rows are told apart by id and text: rows that repeat an id with another text
lose only what they repeat themselves, and may be repeats of each other; rows that repeat both are one document and stay alike. Rows
with a null id stay as they are and remove nothing. Very long texts are read whole, one at a time. Extra columns pass through, whatever
their names, but for one with the name of the count, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import discard, free_name, materialize, scratch_path, shuffle_partitions, text_slices
from docloom.llm.embeddings import group_starts, whole_groups
from docloom.llm.words import ODD, first_of_each, is_space, mix, word_bounds, word_hashes

PLACES = 18
#: Text bytes of a step: its arrays stay in the processor's cache.
STEP_BYTES = 1 << 19
#: Sets of a shingle up to which all meet at once; beyond, sets of a block, and those of it that are compared at a time.
SMALL, BLOCK, TILE = 16, 1024, 256
#: Prefix entries that a task sorts at a time, and that a range holds.
HELD_ENTRIES = 1 << 18
#: Lines up to which the places of candidates are broadcast; more are joined by shuffle.
BROADCAST_LINES = 1_000_000


def line_shingles(texts: list[str | None], shingle: int, least: int = 1, wanted: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, line, code) of every shingle of the lines that have one, line after line; wanted: which lines of each row."""
    parts = [(t or "").lower().encode() for t in texts]
    data = b"\n".join(parts)
    flat = np.frombuffer(data, np.uint8)
    begin, end = word_bounds(is_space(flat))
    breaks = np.flatnonzero(flat == 10)
    size = np.diff(np.searchsorted(begin, breaks), prepend=0, append=len(begin))  # words of each line, counted through the batch
    row_of = np.repeat(np.arange(len(parts)), [p.count(b"\n") + 1 for p in parts])
    first = np.searchsorted(row_of, np.arange(len(parts)))
    line_of = np.arange(len(row_of)) - first[row_of]
    if not parts:
        return row_of, line_of, np.zeros(0, np.uint64)
    use = size >= min(shingle, least)
    if wanted is not None:
        asked = np.zeros(len(row_of), bool)
        asked[np.concatenate([first[i] + np.asarray(w, np.int64) for i, w in enumerate(wanted)])] = True
        use &= asked
    number = np.repeat(np.arange(len(size)), size)
    if not use.all():
        keep = use[number]
        begin, end, number = begin[keep], end[keep], number[keep]
    code = word_hashes(data, begin, end)
    mixed, size = code.copy(), size[number]
    for i in range(1, shingle):  # where a line has i words only, its hash stays as it is
        mixed[:-i] = np.where(size[:-i] > i, mixed[:-i] * ODD + code[i:], mixed[:-i])
    whole = np.zeros(len(number), bool)
    whole[: max(0, len(number) - shingle + 1)] = number[shingle - 1 :] == number[: max(0, len(number) - shingle + 1)]
    whole |= (size < shingle) & np.concatenate((np.ones(min(1, len(number)), bool), number[1:] != number[:-1]))
    number = number[whole]
    return row_of[number], line_of[number], mix(mixed[whole])


def _by_number(number: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Order by number, then token: one sort of both in 64 bits, and the full sort if the bits left out could matter."""
    bits = np.uint64(max(1, int(number[-1]).bit_length() if len(number) else 1))
    key = (number.astype(np.uint64) << (np.uint64(64) - bits)) | (token >> bits)
    order = np.argsort(key)
    tie = key[order[1:]] == key[order[:-1]]
    return np.lexsort((token, number)) if (tie & (token[order[1:]] != token[order[:-1]])).any() else order


class LineSets:
    """Ordered shingle sets of the lines of a batch: token holds the level of a shingle's count above 56 bits of its hash."""

    def __init__(self, texts: list[str | None], shingle: int, levels: np.ndarray, least: int = 1, wanted: list[list[int]] | None = None):
        row, line, code = line_shingles(texts, shingle, least, wanted)
        token = (levels[(code >> np.uint64(64 - PLACES)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (code & np.uint64((1 << 56) - 1))
        first = np.concatenate(([True], (row[1:] != row[:-1]) | (line[1:] != line[:-1]))) if len(row) else np.zeros(0, bool)
        number = np.cumsum(first) - 1
        order = _by_number(number, token)
        token, number, code = token[order], number[order], code[order]
        keep = np.concatenate(([True], (token[1:] != token[:-1]) | (number[1:] != number[:-1]))) if len(token) else np.zeros(0, bool)
        self.token, self.number, self.code = token[keep], number[keep], code[keep]
        self.row, self.line = row[first], line[first]
        self.size = np.bincount(self.number, minlength=len(self.row))
        self.begin = np.cumsum(self.size) - self.size
        self.pos = np.arange(len(self.token)) - self.begin[self.number]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Parity signature and digest of each line's set."""
        if not len(self.begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        bits = mix(self.code)
        return np.bitwise_xor.reduceat(np.uint64(1) << (bits >> np.uint64(58)), self.begin), np.add.reduceat(bits * bits, self.begin)


def _levels(docs: DataFrame, shingle: int, text: str, least: int) -> np.ndarray:
    """For each hash place a level of its count, in 255 steps of an eighth of a doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PLACES, np.int64)
        for b in text_slices(batches, text, STEP_BYTES):
            _, _, code = line_shingles(b.column(text).to_pylist(), shingle, least)
            total += np.bincount((code >> np.uint64(64 - PLACES)).astype(np.int64), minlength=1 << PLACES)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], ["place", "n"])

    counts = docs.select(text).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("int").alias("level")
    found = counts.select("place", level).where("level > 0").toArrow()  # 2**PLACES rows at most, whatever the data
    levels = np.zeros(1 << PLACES, np.uint8)
    levels[found["place"].to_numpy()] = found["level"].to_numpy()
    return levels


def _prefix(size: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    return size - -(-part[0] * size // part[1]) + 1


def line_sets(own: DataFrame, kind: T.DataType, shingle: int, part: tuple[int, int], levels, least: int) -> DataFrame:
    """A row for each line of own (doc, uid, body): digest, sig, size, and the prefix where no equal set of the batch comes before."""
    schema = T.StructType([T.StructField("doc", kind), T.StructField("uid", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("digest", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("again", T.BooleanType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = pc.rank(batch.column("doc"), tiebreaker="dense").to_numpy().astype(np.int64)
            uid = batch.column("uid").to_numpy()
            rows, line, digest, sig, size, tokens, at = [], [], [], [], [], [], 0
            for b in text_slices(iter((batch,)), "body", STEP_BYTES):
                s = LineSets(b.column("body").to_pylist(), shingle, levels.value, least)
                mark, code = s.marks()
                tokens.append(s.token[s.pos < _prefix(s.size, part)[s.number]])
                rows.append(s.row + at)
                line.append(s.line)
                digest.append(code)
                sig.append(mark)
                size.append(s.size)
                at += b.num_rows
            if not rows:
                continue
            rows, line, digest, sig, size, tokens = map(np.concatenate, (rows, line, digest, sig, size, tokens))
            first = first_of_each(digest ^ sig * ODD, rank[rows], uid[rows], line)
            again = (rank[rows] != rank[rows][first]) | (uid[rows] != uid[rows][first]) | (line != line[first])
            leads = first == np.arange(len(first))
            put = leads | again  # a repeated row says nothing new
            length = _prefix(size, part)
            held = np.repeat(leads, length)
            offsets = np.concatenate(([0], np.cumsum(np.where(leads, length, 0)[put])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[held].view(np.int64)))
            rows = rows[put]
            yield pa.record_batch([batch.column("doc").take(pa.array(rows)), pa.array(uid[rows]), pa.array(line[put], pa.int32()), pa.array(digest[put].view(np.int64)), pa.array(sig[put].view(np.int64)), pa.array(size[put], pa.int32()), pa.array(again[put]), lists], schema.names)

    return own.mapInArrow(run, schema)


def _may_match(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], part: tuple[int, int]) -> np.ndarray:
    """Length, positional and parity filters between entries (size, pos, sig)."""
    (n, i, x), (m, j, y) = one, two
    both = n + m
    need = -(-both * part[0] // (part[0] + part[1]))
    fits = (np.minimum(n, m) * part[1] >= np.maximum(n, m) * part[0]) & (np.minimum(n - i, m - j) >= need)
    return fits & (np.bitwise_count((x ^ y).view(np.uint64)) <= both - 2 * need)


_MEET = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("token", T.LongType()), T.StructField("digest", T.LongType())])
#: What an entry holds beside its token and digest.
_MORE = ("sig", "size", "pos", "age")


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers by the bytes that the largest of them needs, after that number of bytes."""
    wide = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def pack(token: np.ndarray, *more: np.ndarray) -> bytes:
    """Entries in the order of their tokens as one block: the tokens as steps from one to the next, every column as narrow as it can be."""
    steps = np.concatenate((token[:1], np.diff(token)))
    return b"".join([len(token).to_bytes(4, "little"), int(token[0]).to_bytes(8, "little"), _narrow(steps[1:]), *map(_narrow, more)])


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    """The columns of a block."""
    n, at = int.from_bytes(block[:4], "little"), 12
    out = []
    for i in range(columns):
        rows, wide = n - (i == 0), block[at]
        x = np.zeros((rows, 8), np.uint8)
        x[:, :wide] = np.frombuffer(block, np.uint8, rows * wide, at + 1).reshape(rows, wide)
        out.append(x.view("<u8").ravel())
        at += 1 + rows * wide
    out[0] = np.cumsum(np.concatenate(([np.uint64(int.from_bytes(block[4:12], "little"))], out[0])), dtype=np.uint64)
    return out


def range_bounds(lead: DataFrame, parts: int, entries: int, each: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(token, digest) where the ranges of entries begin, but for the first: from the entries of some sets, told by their digests, about each a range."""
    every = max(1, entries // (each * parts))
    found = lead.where(F.pmod(F.xxhash64("digest", F.lit(9)), F.lit(every)) == 0).select(F.explode("prefix").alias("token"), "digest").toArrow()
    token, digest = (found.column(c).to_numpy().view(np.uint64) for c in ("token", "digest"))
    order = np.lexsort((digest, token))
    at = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
    return token[at], digest[at]


def entry_blocks(lead: DataFrame, bounds, held: int = HELD_ENTRIES) -> DataFrame:
    """(part, block): the prefix entries of sets (digest, sig, size, age, prefix), a block for each range and each so many entries of a task."""

    def cut(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        lists = pa.concat_arrays([b.column("prefix") for b in tables])
        length = lists.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(length)), length)
        column = lambda c: np.concatenate([b.column(c).to_numpy() for b in tables])[own].astype(np.int64).view(np.uint64)
        token = lists.flatten().to_numpy().view(np.uint64)
        pos = (np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint64)
        digest = column("digest")
        order = np.lexsort((digest, token))
        token, digest = token[order], digest[order]
        more = [x[order] for x in (column("sig"), column("size"), pos, column("age"))]
        low, high = np.searchsorted(token, bounds.value[0]), np.searchsorted(token, bounds.value[0], "right")
        edge = [i + int(np.searchsorted(digest[i:j], d)) for i, j, d in zip(low.tolist(), high.tolist(), bounds.value[1], strict=True)]
        edge = np.array([0, *edge, len(token)])
        some = np.flatnonzero(edge[1:] > edge[:-1])
        blocks = [pack(*(x[edge[i] : edge[i + 1]] for x in (token, digest, *more))) for i in some]
        return pa.record_batch([pa.array(some, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, count = [], 0
        for b in batches:
            tables.append(b)
            count += len(b.column("prefix").flatten())
            if count >= held:
                yield cut(tables)
                tables, count = [], 0
        if count:
            yield cut(tables)

    return lead.select("digest", "sig", "size", "age", "prefix").mapInArrow(run, "part int, block binary")


def meet(lead: DataFrame, part: tuple[int, int], partitions: int, most: int = HELD_ENTRIES) -> DataFrame:
    """Candidates (a, b: digests) of the prefix entries of sets in small groups and with the earliest of large ones; (token, digest) of large ones.

    lead: (digest, sig, size, age, prefix). Entries go to ranges of (token, digest) of about most entries, so a hot shingle spreads over several;
    they travel as blocks, 26 bytes an entry, and a range is sorted once where it arrives.
    """
    entries = lead.agg(F.sum(F.size("prefix"))).first()[0] or 0
    parts = max(partitions, -(-entries // most))
    bounds = lead.sparkSession.sparkContext.broadcast(range_bounds(lead, parts, entries))  # two numbers a range
    dealt = entry_blocks(lead, bounds).repartitionByRange(parts, "part").sortWithinPartitions("part")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        now, held = None, []
        for b in batches:
            for p, block in zip(b.column("part").to_pylist(), b.column("block"), strict=True):
                if p != now and held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                now = p
                held.append(unpack(block.as_py(), 2 + len(_MORE)))
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in ranges(batches):
            order = np.lexsort((columns[1], columns[0]))
            token, digest, sig, size, pos, age = (x[order].view(np.int64) for x in columns)
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])  # equal sets of several batches
            token, digest, sig, size, pos, age = (x[keep] for x in (token, digest, sig, size, pos, age))
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            count = np.diff(starts, append=len(token))
            large = count > SMALL
            large[0] = large[-1] = True  # these may go on in another range
            a, b = [], []

            def compare(i: np.ndarray, j: np.ndarray, fields=(size, pos, sig), digest=digest, a=a, b=b) -> None:
                fits = _may_match(tuple(f[i] for f in fields), tuple(f[j] for f in fields), part)
                a.append(digest[i[fits]])
                b.append(digest[j[fits]])

            for gap in range(1, SMALL):
                group = np.flatnonzero(~large & (count > gap))
                i = np.concatenate([np.arange(0)] + [starts[group[count[group] > k + gap]] + k for k in range(SMALL - gap)])
                compare(i, i + gap)
            group = np.flatnonzero(large)
            many = count[group]
            own, inner = np.repeat(np.arange(len(group)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = starts[group][own] + inner
            order = np.lexsort((digest[at], age[at], own))
            first = at[order[np.cumsum(many) - many]][own] if len(group) else at
            compare(at[at != first], first[at != first])
            a, b = np.concatenate(a), np.concatenate(b)
            if not len(a) and not len(at):
                continue
            pairs, rows = len(a), len(at)
            wide = lambda x, kind: pa.concat_arrays([pa.nulls(pairs, kind), pa.array(x, kind)])
            less = lambda x: pa.concat_arrays([pa.array(x), pa.nulls(rows, pa.int64())])
            yield pa.record_batch([less(np.minimum(a, b)), less(np.maximum(a, b)), wide(token[at], pa.int64()), wide(digest[at], pa.int64())], _MEET.names)

    return dealt.select("part", "block").mapInArrow(run, _MEET)


def _same_row(own: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """own (doc, uid, ...) with found of the same row; found is broadcast up to BROADCAST_LINES, else shuffled."""
    return own.join(F.broadcast(found) if rows <= BROADCAST_LINES else found, ["doc", "uid"])


def read_sets(digests: DataFrame, firsts: DataFrame, own: DataFrame, shingle: int, levels, least: int) -> DataFrame:
    """(digest, p: its first place, tokens) of the sets with these digests, read from the documents that hold the first places; a row a digest."""
    spots = materialize(digests.join(firsts, "digest"), "lines-spots")
    lists = spots.groupBy("doc", "uid").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    schema = T.StructType([own.schema["doc"], T.StructField("uid", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("digest", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "body", STEP_BYTES):
            s = LineSets(b.column("body").to_pylist(), shingle, levels.value, least, b.column("lines").to_pylist())
            tokens = pa.ListArray.from_arrays(pa.array(np.append(s.begin, len(s.token)), pa.int32()), pa.array(s.token.view(np.int64)))
            rows = pa.array(s.row)
            yield pa.record_batch([b.column("doc").take(rows), b.column("uid").take(rows), pa.array(s.line, pa.int32()), pa.array(s.marks()[1].view(np.int64)), tokens], schema.names)

    read = _same_row(own, lists, spots.count()).mapInArrow(run, schema)
    return read.select("digest", F.struct("doc", "uid", "line").alias("p"), "tokens").dropDuplicates(["digest"])


def similar_pairs(pairs: DataFrame, sets: DataFrame, part: tuple[int, int]) -> DataFrame:
    """(digest): the later set of each candidate pair (a, b) that is similar."""
    met = pairs.join(sets.toDF("a", "ap", "at"), "a").join(sets.toDF("b", "bp", "bt"), "b")
    common = F.size(F.array_intersect("at", "bt"))
    near = met.where(common * part[1] >= (F.size("at") + F.size("bt") - common) * part[0])
    return materialize(near.select(F.when(F.col("ap") > F.col("bp"), F.col("a")).otherwise(F.col("b")).alias("digest")).distinct(), "lines-gone")


def common_tokens(x: list[np.ndarray], y: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """How many tokens each set of x shares with each of y."""
    tx, ty = np.concatenate(x), np.concatenate(y)
    shared = np.intersect1d(tx, ty)
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(shared):
        return out

    def cells(t: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, t), len(shared) - 1)
        hit = shared[at] == t
        return row[hit], at[hit]

    (rx, cx), (ry, cy) = cells(tx, x), cells(ty, y)
    for low in range(0, len(shared), wide):  # a slice of the shared tokens at a time
        n = min(wide, len(shared) - low)
        mx, my = np.zeros((len(x), n), np.float32), np.zeros((len(y), n), np.float32)
        kx, ky = (cx >= low) & (cx < low + n), (cy >= low) & (cy < low + n)
        mx[rx[kx], cx[kx] - low] = 1
        my[ry[ky], cy[ky] - low] = 1
        out += (mx @ my.T).astype(np.int64)
    return out


def similar_in_groups(rows: DataFrame, sets: DataFrame, part: tuple[int, int]) -> DataFrame:
    """(digest): the open sets of large groups (token, digest, open, xn, yn) that have a similar earlier set, found a pair of blocks at a time.

    The open sets of a group are dealt to xn blocks and all its sets to yn, so that a set travels as often as the other side has blocks;
    where both are one, an open set travels once and is on both sides.
    """
    full = rows.join(sets, "digest").select("token", "open", "digest", "p.*", "tokens", "xn", "yn")
    block = lambda n: F.pmod(F.xxhash64("digest", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    fields = ["digest", "doc", "uid", "line", "tokens"]
    full = full.withColumn("alone", F.expr("xn = 1 and yn = 1"))
    x = full.where("open").select("token", block("xn").alias("xb"), every("yn").alias("yb"), F.lit(0).alias("side"), "alone", *fields)
    y = full.where("not (open and alone)").select("token", every("xn").alias("xb"), block("yn").alias("yb"), F.lit(1).alias("side"), "alone", *fields)
    keys = ["token", "xb", "yb"]
    met = x.unionByName(y).repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, keys, most=1 << 30):  # a pair of blocks has 2 * BLOCK rows at most
            starts = group_starts(t, keys)
            gone = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                own = t.slice(s, e - s)
                digest, uid, line = (own.column(c).to_numpy() for c in ("digest", "uid", "line"))
                rank = pc.rank(own.column("doc").combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
                age = np.zeros(e - s, np.int64)
                age[np.lexsort((line, uid, rank))] = np.arange(e - s)
                n = int(np.searchsorted(own.column("side").to_numpy(), 1))
                tokens = [x.values.to_numpy() for x in own.column("tokens")]
                size = np.array([len(x) for x in tokens])
                y = 0 if own.column("alone")[0].as_py() else n  # where the other side begins
                for i in range(0, n if y < len(tokens) else 0, TILE):
                    j = min(i + TILE, n)
                    common = common_tokens(tokens[i:j], tokens[y:])
                    near = common * part[1] >= (size[i:j, None] + size[None, y:] - common) * part[0]
                    near &= (digest[i:j, None] != digest[None, y:]) & (age[i:j, None] > age[None, y:])
                    gone.append(digest[i:j][near.any(axis=1)])
            yield pa.record_batch([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *gone])))], ["digest"])

    return materialize(met.mapInArrow(run, "digest long").distinct(), "lines-gone")


def repeated_lines(docs: DataFrame, shingle: int = 5, part: tuple[int, int] = (4, 5), text: str = "text", key: str = "doc_id", least: int = 1) -> DataFrame:
    """(doc, uid, line) of the lines to remove; uid is the 64-bit hash of the row's text."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_levels(docs, shingle, text, least))
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("uid"), F.col(text).alias("body"))
    sets = materialize(line_sets(own, docs.schema[key].dataType, shingle, part, levels, least), "lines-read", read := scratch_path(spark, "lines-read"))
    lead = sets.where("not again")
    same = Window.partitionBy("digest", "sig", "size").orderBy("doc", "uid", "line")
    places = lead.select("doc", "uid", "line", "digest", (F.row_number().over(same) == 1).alias("first"), (F.rank().over(same) > 1).alias("gone"))
    places = places.where("first or gone").unionByName(sets.where("again").select("doc", "uid", "line", "digest", F.lit(False).alias("first"), F.lit(True).alias("gone")))
    places = materialize(places, "lines-places")
    age = F.xxhash64("doc") if not isinstance(docs.schema[key].dataType, T.IntegralType) else F.col("doc").cast("long")
    met = materialize(meet(lead.withColumn("age", age), part, shuffle_partitions(spark)), "lines-met")
    discard(spark, read)
    spots = places.where("first").select("digest", "doc", "uid", "line")
    pairs = materialize(met.where("a is not null").select("a", "b").distinct(), "lines-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    gone = similar_pairs(pairs, read_sets(ends, spots, own, shingle, levels, least), part)
    rows = met.where("token is not null").select("token", "digest").join(gone.withColumn("gone", F.lit(True)), "digest", "left")
    rows = materialize(rows.select("token", "digest", F.col("gone").isNull().alias("open")), "lines-rows")
    many = rows.groupBy("token").agg(F.count_if("open").alias("xn"), F.count("*").alias("yn")).where("xn > 0 and yn > 1")
    many = materialize(many.select("token", *(F.ceil(F.col(n) / BLOCK).alias(n) for n in ("xn", "yn"))), "lines-many")
    groups = many.count()
    if groups:
        rows = materialize(rows.join(F.broadcast(many) if groups <= BROADCAST_LINES else many, "token"), "lines-open")
        held = materialize(read_sets(rows.select("digest").distinct(), spots, own, shingle, levels, least), "lines-sets")
        gone = gone.unionByName(similar_in_groups(rows, held, part)).distinct()
    out = places.where("gone").select("doc", "uid", "line")
    return out.unionByName(gone.join(spots, "digest").select("doc", "uid", "line"))


def dedup(docs: DataFrame, shingle: int = 5, part: tuple[int, int] = (4, 5), text: str = "text", key: str = "doc_id", least: int = 1, removed: str = "removed_lines") -> DataFrame:
    """docs with the text less its repeated lines, and how many were removed."""
    doc, uid, found = (free_name(docs, n) for n in ("doc", "uid", "lines"))
    gone = repeated_lines(docs, shingle, part, text, key, least).groupBy(F.col("doc").alias(doc), F.col("uid").alias(uid)).agg(F.collect_set("line").alias(found))
    joined = docs.join(gone.hint("merge"), (docs[key] == gone[doc]) & (F.xxhash64(docs[text]) == gone[uid]), "left").drop(doc, uid)
    fields = [f for f in docs.schema.fields if f.name.lower() != removed.lower()]
    schema = T.StructType([*fields, T.StructField(removed, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            lost = [set(x or ()) for x in b.column(found).to_pylist()]
            texts = ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in f) if t and f else t for t, f in zip(b.column(text).to_pylist(), lost, strict=True)]
            columns = [pa.array(texts, pa.string()) if f.name == text else b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(len, lost), pa.int32())], names=schema.names)

    return joined.mapInArrow(run, schema)
