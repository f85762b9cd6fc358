"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the UTF-8 bytes of a text; a chunk ends after a word where the hash, which depends on the 16 bytes
before only, falls under a threshold. So an insertion moves the cuts near it and no others, and a passage is cut alike wherever
it stands. Words of over ``LONG`` bytes (text without white space) are cut inside by the same hash, at whole characters. Compared are windows:
the shortest runs of consecutive chunks that hold ``min_words`` words or more (16 bytes of a long word count as one), from each chunk on and up
to each chunk, by a 64-bit digest of their words; white space between words counts for nothing. Of all places of a window the first (by
document id, then position) stays; later ones are removed, but for those that overlap the first. So what is removed stands in one earlier
place as a whole, or is joined from such passages, and common phrases from several documents never cut a text.

Of the equal windows of one batch of documents only the first goes into the shuffle, so a passage that very many documents hold reaches a task
once a batch.

Null texts stay null and empty ones empty. A text that repeats an earlier one whole becomes empty (white space before its first word stays); its
row stays. Rows are told apart by id and text: rows that repeat an id with another text lose only what they repeat themselves; rows that
repeat both are one document and stay alike. Rows with a null id are left as they are. Very long texts are read whole, one at a time. Extra
columns pass through, whatever their names, but for those with the names of the two results, which are replaced. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from docloom.llm.common import free_name, shuffle_partitions, text_slices
from docloom.llm.embeddings import whole_groups
from docloom.llm.words import first_of_each, is_space, mix, word_bounds, word_hashes

#: The gear table, made by a rule: low 32 bits of XXH64 of the byte.
GEAR = np.array([xxh64_intdigest(bytes([b]), 1) & 0xFFFFFFFF for b in range(256)], np.uint32)
#: Bytes that a gear hash depends on, and the bytes of a word that is cut inside.
WIDTH, LONG = 16, 64
STEP_BYTES = 1 << 19
#: Of the polynomial hash; odd, so that its powers have inverses.
BASE = 0xD6E8FEB86659FD93


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR[byte j places back] << j. Made by doubling the window."""
    h = GEAR[data]
    step = 1
    while step < WIDTH:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 to BASE**n modulo 2**64, and their inverses."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Chunks:
    """Words of several texts and the chunks they form; places are bytes of data, in which text i begins at start[i]."""

    def __init__(self, texts: list[str | None], mean_words: int = 5):
        parts = [(t or "").encode() for t in texts]
        gap = b"\n" * WIDTH  # before each text, so that no hash reaches into another
        self.data = b"".join(x for p in parts for x in (gap, p)) + b"\n"
        length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(length + WIDTH) - length
        self.stop = self.start + length
        flat = np.frombuffer(self.data, np.uint8)
        begin, end = word_bounds(is_space(flat))
        level = (gear_hashes(flat) >> np.uint32(7)).astype(np.uint8)  # bits 7 to 14: no byte over 15 places back has a share in them
        cut = level[end] < 256 // mean_words
        unit = np.ones(len(begin), np.int64)
        if (end - begin > LONG).any():
            begin, end, cut, unit = self._split(flat, level, begin, end, cut)
        self.begin, self.end, self.unit = begin, end, unit
        self.doc = np.searchsorted(self.start, begin, "right") - 1
        if len(cut):
            cut = cut.copy()
            cut[:-1] |= self.doc[1:] != self.doc[:-1]
            cut[-1] = True
        self.last = np.flatnonzero(cut)  # word by which a chunk ends
        self.first = np.concatenate(([0], self.last[:-1] + 1)) if len(cut) else self.last

    @staticmethod
    def _split(flat: np.ndarray, level: np.ndarray, begin: np.ndarray, end: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        """Long words in pieces of 16 bytes on average; every second one, on average, ends a chunk of its own making."""
        inner = np.flatnonzero((level < 16) & ((flat & 0xC0) != 0x80)) if len(flat) else np.zeros(0, np.int64)
        word = np.searchsorted(begin, inner, "right") - 1
        inner = inner[(word >= 0) & (inner > begin[word]) & (inner < end[word]) & (end[word] - begin[word] > LONG)]
        starts, stops = np.sort(np.concatenate((begin, inner))), np.sort(np.concatenate((end, inner)))
        cuts = np.zeros(len(stops), bool)
        cuts[np.searchsorted(stops, end)] = cut
        cuts[np.searchsorted(stops, inner)] = level[inner] < 4
        long_ = np.repeat(end - begin > LONG, np.diff(np.searchsorted(starts, begin), append=len(starts)))
        return starts, stops, cuts, np.where(long_, np.maximum(1, (stops - starts) // 16), 1)

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin, end, digest) of the shortest runs of min_words words from each chunk on, and up to each; places are bytes of the text."""
        n = len(self.begin)
        if not n:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        total = np.concatenate(([0], np.cumsum(self.unit)))
        before, after, doc = total[self.first], total[self.last + 1], self.doc[self.first]
        till = np.minimum(np.searchsorted(after, before + min_words), len(after) - 1)
        ahead = np.flatnonzero((after[till] - before >= min_words) & (doc[till] == doc))
        start = np.searchsorted(before, after - min_words, "right") - 1
        behind = np.flatnonzero((start >= 0) & (doc[start] == doc))
        behind = behind[till[start[behind]] != behind]  # the others are there already
        one, two = self.first[np.concatenate((ahead, start[behind]))], self.last[np.concatenate((till[ahead], behind))]
        up, down = _powers(1 << max(18, n.bit_length()))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes(self.data, self.begin, self.end) * up[:n], out=run[1:])
        text = self.doc[one]
        follow = np.minimum(two + 1, n - 1)
        stop = np.where((two + 1 < n) & (self.doc[follow] == text), self.begin[follow], self.stop[text])  # with the white space after it
        return text, self.begin[one] - self.start[text], stop - self.start[text], mix((run[two + 1] - run[one]) * down[one])


def cut(text: str, mean_words: int = 5) -> list[int]:
    """Byte places at which the chunks of a text end."""
    c = Chunks([text], mean_words)
    return (c.end[c.last] - c.start[0]).tolist()


_SPOT = [T.StructField("uid", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]


def passages(own: DataFrame, mean_words: int, min_words: int) -> DataFrame:
    """(doc, uid, begin, end, deal, source) of the windows of own (doc, uid, body); deal is the digest, or any number where source tells an earlier place in the batch."""
    kind = own.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), *_SPOT, T.StructField("deal", T.LongType()), T.StructField("source", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], 0
            for b in text_slices(iter((batch,)), "body", STEP_BYTES):
                text, begin, end, digest = Chunks(b.column("body").to_pylist(), mean_words).windows(min_words)
                found.append((text + at, begin, end, digest))
                at += b.num_rows
            if not found:
                continue
            row, begin, end, digest = (np.concatenate(x) for x in zip(*found, strict=True))
            doc, uid = batch.column("doc"), batch.column("uid").to_numpy()
            rank = pc.rank(doc, tiebreaker="dense").to_numpy().astype(np.int64)
            first = first_of_each(digest, rank[row], uid[row], begin)
            again = first != np.arange(len(first))
            same = (rank[row] == rank[row[first]]) & (uid[row] == uid[row[first]])
            put = ~(again & same & (begin < end[first]))  # neither the same place twice nor one that overlaps the first
            deal = np.where(again, mix(digest + row.astype(np.uint64)), digest)[put]
            source = doc.take(pa.array(row[first[put]], mask=~again[put]))
            yield pa.record_batch([doc.take(pa.array(row[put])), pa.array(uid[row[put]]), pa.array(begin[put], pa.int32()), pa.array(end[put], pa.int32()), pa.array(deal.view(np.int64)), source], schema.names)

    return own.mapInArrow(run, schema)


def repeats(parts: DataFrame) -> DataFrame:
    """(doc, uid, begin, end, source) of the windows whose digest stands in an earlier place."""
    kind = parts.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), *_SPOT, T.StructField("source", kind)])
    dealt = parts.repartition(shuffle_partitions(parts.sparkSession), "deal").sortWithinPartitions("deal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["deal"], most=1 << 30):  # a digest has a row for each batch of documents at most
            known = pc.is_valid(t.column("source"))
            if pc.any(known).as_py():
                yield from t.filter(known).select(schema.names).to_batches()
                t = t.filter(pc.invert(known))
            digest = t.column("deal").to_numpy()
            same = digest[1:] == digest[:-1]
            if not same.any():
                continue
            t = t.filter(pa.array(np.concatenate((same, [False])) | np.concatenate(([False], same))))
            doc = t.column("doc").combine_chunks()
            digest, uid, begin, end = (t.column(c).to_numpy() for c in ("deal", "uid", "begin", "end"))
            rank = pc.rank(doc, tiebreaker="dense").to_numpy().astype(np.int64)
            first = first_of_each(digest, rank, uid, begin)
            later = np.flatnonzero((rank != rank[first]) | (uid != uid[first]) | (begin >= end[first]))
            at = pa.array(later)
            yield pa.record_batch([doc.take(at), pa.array(uid[later]), pa.array(begin[later], pa.int32()), pa.array(end[later], pa.int32()), doc.take(pa.array(first[later]))], schema.names)

    return dealt.mapInArrow(run, schema)


def long_runs(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of adjoining or overlapping spots."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spots):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def dedup(docs: DataFrame, mean_words: int = 5, min_words: int = 12, text: str = "text", key: str = "doc_id", removed: str = "removed_bytes", sources: str = "source_doc_ids") -> DataFrame:
    """docs with the text less its repeated passages, the bytes removed, and the ids that hold their first places."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("uid"), F.col(text).alias("body"))
    gone = repeats(passages(own, mean_words, min_words))
    doc, uid, found = (free_name(docs, n) for n in ("doc", "uid", "spots"))
    spots = gone.groupBy(F.col("doc").alias(doc), F.col("uid").alias(uid)).agg(F.struct(F.collect_list("begin").alias("begin"), F.collect_list("end").alias("end"), F.sort_array(F.collect_set("source")).alias("source")).alias(found))
    joined = docs.join(spots, (docs[key] == spots[doc]) & (F.xxhash64(docs[text]) == spots[uid]), "left").drop(doc, uid)
    fields = [f for f in docs.schema.fields if f.name.lower() not in (removed.lower(), sources.lower())]
    schema = T.StructType([*fields, T.StructField(removed, T.LongType()), T.StructField(sources, T.ArrayType(docs.schema[key].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            texts, lost, origins = [], [], []
            for t, here in zip(b.column(text).to_pylist(), b.column(found).to_pylist(), strict=True):
                gone = []
                if here:
                    gone = long_runs(list(zip(here["begin"], here["end"], strict=True)))
                    data, kept, last = t.encode(), [], 0
                    for begin, end in gone:
                        kept.append(data[last:begin])
                        last = end
                    t = b"".join([*kept, data[last:]]).decode()
                texts.append(t)
                lost.append(sum(e - s for s, e in gone))
                origins.append(here["source"] if here else [])
            columns = [pa.array(texts, pa.string()) if f.name == text else b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lost, pa.int64()), pa.array(origins, pa.list_(b.column(key).type))], names=schema.names)

    return joined.mapInArrow(run, schema)
