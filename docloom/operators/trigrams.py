"""Trigram word similarity of short texts, and the join of texts that reach a threshold.

A text's words (runs of letters and digits, lower-cased) give trigrams with two blanks before and one after. The word similarity of a in b is the
greatest similarity (common / (those of a + those of the extent - common)) between the set of a's trigrams and any run of b's in order; it is not
symmetric. The join does not form all pairs: a similarity of t needs at least c = ceil(t n) of a's n trigrams in b, so of these, ordered from the
rarest on, s of the first n - c + s must be there, for every s up to c (the prefix filter). Only texts that share such a set of s trigrams are
compared. One trigram is shared by a part of all texts, four are by few, so s is as large as it can be: MOST_SHARED, less where a text has fewer
to share or would give more than MOST_SETS sets. Two texts meet by the lesser s of theirs, so long texts cost no more sets and lose no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import cut_lineage


MOST_SHARED, MOST_SETS = 4, 256


@cache
def _subsets(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)), np.int64).reshape(-1, size)


def most_shared(n: int, needed: int | None = None) -> int:
    """How many trigrams a set may have: of all n, or of the first n - needed + s."""
    fits = [s for s in range(1, min(MOST_SHARED, needed or n) + 1) if comb(n if needed is None else n - needed + s, s) <= MOST_SETS]
    return max(fits, default=1)


def set_keys(hashes: np.ndarray, size: int, tag: int) -> np.ndarray:
    """A number for each set of so many of these trigrams, whatever their order; equal ones by chance only add pairs to compare."""
    h = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return (mixed[_subsets(len(h), size)].sum(axis=1, dtype=np.uint64) + np.uint64(tag * 0xA24BAED4963EE407 % 2**64)).view(np.int64)


def trigrams(text: Column) -> Column:
    """All trigrams of a text in order; null for null."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))


def word_similarity(of: list[str], in_: list[str]) -> float:
    """The greatest similarity between the set of one list of trigrams and any run of the other."""
    wanted, best = set(of), 0.0
    hits = [i for i, t in enumerate(in_) if t in wanted]
    for place, first in enumerate(hits):  # a best run begins and ends at a common trigram
        if len(hits) - place <= best * len(wanted):
            break  # what is left can't be more
        seen, common = set(), 0
        for t in in_[first:]:
            if t not in seen:
                seen.add(t)
                common += t in wanted
                if t in wanted:
                    best = max(best, common / (len(wanted) + len(seen) - common))
            if common == len(wanted):
                break
        if best == 1.0:
            break
    return best


def similar(texts: DataFrame, threshold: float, key: str = "id", text: str = "title") -> DataFrame:
    """(a, b, ab, ba) for pairs of keys a < b one of whose word similarities reaches threshold: ab is that of a in b.

    Texts without trigrams are similar to none; keys must be distinct; a null text has none.
    """
    own = texts.select(F.col(key).alias("k"), trigrams(F.col(text)).alias("all")).where(F.size("all") > 0).withColumn("set", F.array_distinct("all"))
    own = cut_lineage(own)
    each = own.select("k", F.size("set").alias("n"), F.explode("set").alias("t"))
    rarity = each.groupBy("t").agg(F.count("*").alias("freq"))
    needed = F.greatest(F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int"), F.lit(1))
    ranked = each.join(rarity, "t").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "t"))).alias("r"))
    ranked = cut_lineage(ranked.select("k", needed.alias("needed"), F.col("r.t").alias("set"), F.transform("r.t", lambda t: F.xxhash64(t)).alias("hashes")))
    kind = texts.schema[key].dataType.simpleString()

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The s of a text as the one that is sought, and the trigrams that its sets are made of."""
        for batch in batches:
            n = pc.list_value_length(batch.column("hashes")).to_pylist()
            c = batch.column("needed").to_pylist()
            own = [most_shared(x, y) for x, y in zip(n, c, strict=True)]
            first = [x - y + s for x, y, s in zip(n, c, own, strict=True)]
            yield pa.record_batch([batch.column("k"), batch.column("hashes"), batch.column("needed"), pa.array(own, pa.int32()), pa.array(first, pa.int32())], ["k", "hashes", "needed", "s", "first"])

    sought = cut_lineage(ranked.select("k", "hashes", "needed").mapInArrow(classed, f"k {kind}, hashes array<bigint>, needed int, s int, first int"))
    used = sought.select(F.explode(F.slice("hashes", F.lit(1), F.col("first"))).alias("h")).distinct()
    holding = sought.select("k", F.explode("hashes").alias("h")).join(used, "h", "left_semi").groupBy("k").agg(F.collect_list("h").alias("hashes"))
    holding = cut_lineage(holding)
    seeking = sorted(r[0] for r in sought.select("s").distinct().collect())  # MOST_SHARED at most
    sizes = holding.select(F.least(F.size("hashes"), F.lit(MOST_SETS + 1))).distinct().collect()  # MOST_SETS + 1 at most
    held_by = sorted({most_shared(r[0]) for r in sizes})

    def sets(of: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                    keys, rows = [], []
                    hashes, more = part.column("hashes"), part.to_pydict() if of else {}
                    for i in range(part.num_rows):
                        h = hashes[i].values.to_numpy()
                        mine = more["s"][i] if of else most_shared(len(h))
                        for theirs in held_by if of else seeking:
                            s = min(mine, theirs)
                            own = h[: len(h) - more["needed"][i] + s] if of else h
                            tag = mine * 16 + theirs if of else theirs * 16 + mine
                            keys.append(set_keys(own, s, tag))
                            rows.append(np.full(len(keys[-1]), i))
                    yield pa.record_batch([part.column("k").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(keys))], ["k", "key"])

        return run

    wanted = sought.select("k", "hashes", "needed", "s").mapInArrow(sets(True), f"k {kind}, key bigint").select(F.col("k").alias("of"), "key")
    held = holding.mapInArrow(sets(False), f"k {kind}, key bigint").select(F.col("k").alias("in"), "key")
    met = wanted.join(held, "key").where("of <> in").select(F.least("of", "in").alias("a"), F.greatest("of", "in").alias("b")).distinct()
    pairs = met.join(own.select(F.col("k").alias("a"), F.col("all").alias("ta")), "a").join(own.select(F.col("k").alias("b"), F.col("all").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            both = [(word_similarity(x, y), word_similarity(y, x)) for x, y in zip(ta, tb, strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array([x for x, _ in both], pa.float64()), pa.array([y for _, y in both], pa.float64())], ["a", "b", "ab", "ba"])

    compared = pairs.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, ab double, ba double")
    return compared.where(F.greatest("ab", "ba") >= threshold - 1e-9)


def margins(pairs: DataFrame, below: float = 0.1, at: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """One row: pairs, those with a margin (difference of the two directions) under below, and its percentiles as an array."""
    margin = F.abs(F.col("ab") - F.col("ba"))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(margin < below).alias("below"), F.percentile(margin, F.array(*map(F.lit, at))).alias("percentiles"))
