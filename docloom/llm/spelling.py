"""Spelling variants: words of the corpus, the words one edit away, and the frequent form that each leads to.

An even-partition pigeonhole join. A word of length L is indexed by its two halves, the first of L // 2 code points. One edit
leaves one half as it is, so a word of length l looks its near words up by substrings: among words of its own length by its two
halves, among words that are one shorter by its beginning and, shifted by one place, by its end. What the index gives is verified
by the edit distance inside the join, so that no unverified pair is ever a row, and a pair that both halves find counts by the
first one only. Halves that very many words share are refined by half of the rest, so that no group holds more words than differ
in a quarter of their letters.

A null text has no words; a null doc_id counts as the empty text in the checksum that deletes letters. Texts are read whole, a few
MB at a time, and counted per task before the shuffle, so a very frequent word costs one row a task. Repeated rows are counted as
often as they stand there. Of near words with the same count the smallest in code-point order is the form. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, text_slices

#: À to ÿ are the letters that stay as they are; only A-Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
#: One run of this many, told by a checksum of document and run, loses a letter.
DELETES = 97
LEAST_SIZE, LEAST_COUNT = 5, 3
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: A half that more words than this share is refined.
HOT_HALF = 64
HALF = ["len", "part", "half"]


def count_text(counts: Counter, doc_id: object, text: str, least: int) -> None:
    """Add the words of one text to counts."""
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
        h = crc32(run.encode(), start)
        if h % DELETES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            counts[run] += n


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words with enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in text_slices(batches, text):
            for doc_id, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if t:
                    count_text(counts, doc_id, t, least_size)
                if len(counts) >= HELD_WORDS:
                    yield out()
        yield out()

    return docs.select(key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _kept_halves(word: Column, own: Column, shift: int) -> Column:
    """The two lookups of a text among texts of own code points, which is shift fewer than it has: part, the half that is kept, the rest.

    With no shift these are also its index entries.
    """
    first = F.floor(own / 2).cast("int")
    way = lambda part, half, rest: F.struct(F.lit(part).alias("part"), half.alias("half"), rest.alias("rest"))
    return F.array(
        way(1, F.substring(word, F.lit(1), first), F.substring(word, first + 1, own + shift)),
        way(2, F.substring(word, first + 1 + shift, own), F.substring(word, F.lit(1), first + shift)),
    )


def _entries(words: DataFrame, word: str, n: str, shift: int) -> DataFrame:
    size = F.char_length(word) - shift
    of = words.select(F.col("word").alias(word), F.col("n").alias(n))
    return of.select(word, n, size.alias("len"), F.lit(shift).alias("shift"), F.explode(_kept_halves(F.col(word), size, shift)).alias("at")).select(word, n, "len", "shift", "at.*")


def _by_quarters(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries whose half is hot are looked up by half of the rest as well; part2 is 0 for all others."""
    rest = F.char_length("rest") - F.col("shift")
    none = F.array(F.struct(F.lit(0).alias("part"), F.lit("").alias("half"), F.lit("").alias("rest")))
    with_hot = entries.join(hot.withColumn("hot", F.lit(True)), HALF, "left")
    either = F.concat(*(F.when(F.col("shift") == s, _kept_halves(F.col("rest"), rest, s)).otherwise(F.array()) for s in (0, 1)))
    return with_hot.withColumn("more", F.explode(F.when(F.col("hot"), either).otherwise(none))).withColumns({"part2": F.col("more.part"), "quarter": F.col("more.half")}).drop("hot", "more")


def near_words(words: DataFrame, hot_half: int = HOT_HALF) -> DataFrame:
    """Each unordered pair (a, n_a, b, n_b) of words one inserted, deleted or replaced code point apart, once; b is no shorter than a.

    A half that more than hot_half words share is refined by the same rule: of the rest one half is kept again, so hot halves
    meet by three quarters of the word.
    """
    index = _entries(words, "a", "n_a", 0)
    probes = _entries(words, "b", "n_b", 0).unionByName(_entries(words, "b", "n_b", 1))
    hot = materialize(index.groupBy(HALF).agg(F.count("*").alias("entries")).where(F.col("entries") > hot_half).select(HALF), "spelling-hot")
    first = F.floor(F.col("len") / 2).cast("int")
    quarter = F.floor(F.char_length("rest") / 2).cast("int")
    # where the kept end begins, if an end is kept: what both kept halves find differs before it or was found by its beginning
    end = F.when(F.col("part2") == 2, F.when(F.col("part") == 1, first).otherwise(0) + quarter).when(F.col("part") == 2, first)
    index = _by_quarters(index, hot).withColumn("end", end).drop("rest", "shift")
    probes = _by_quarters(probes, hot).drop("rest")
    a, b = F.col("a"), F.col("b")
    once = F.when(F.col("shift") == 0, a < b).otherwise(F.col("end").isNull() | (F.substring(a, F.lit(1), F.col("end")) != F.substring(b, F.lit(1), F.col("end"))))
    found = index.join(probes, [*HALF, "part2", "quarter"]).where(once & (F.levenshtein(a, b, 1) == 1))
    return found.select("a", "n_a", "b", "n_b")


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, where that is at least twice the word's own."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    best = pairs.select(sides.alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("m"), F.col("s.near").alias("near"))).alias("best"))
    some = -F.col("best.m") >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(some, F.col("best.near")).alias("form"), F.when(some, -F.col("best.m")).alias("form_n")
    )


def with_roots(found: DataFrame) -> DataFrame:
    """found and root: where the forms lead in the end.

    Counts at least double from form to form, so a path has at most log2 of the largest count steps, and doubling the
    steps at each join ends after the logarithm of that.
    """
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    steps = materialize(steps, "spelling-steps")
    while not (further := steps.join(steps.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("word", "next")).isEmpty():
        further = materialize(further, "spelling-further")
        steps = materialize(steps.join(further, "word", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-steps")
    return found.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the corpus."""
    words = materialize(word_counts(docs, text, key, least_size, least_count), "spelling-words")
    found = materialize(forms(words, near_words(words)), "spelling-forms")
    return with_roots(found)
