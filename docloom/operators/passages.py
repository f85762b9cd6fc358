"""What a search shows of its hits: an excerpt by identifier, the chunks around, a preview, and passages merged from neighbouring candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators.search import Request, candidates, context, ranked_hits
from docloom.operators.vectors import best_per, with_distance
from docloom.session import cut_lineage

MOST_PASSAGES = 8
#: Chunks on each side of a passage's candidate, and of an excerpt.
PASSAGE_REACH, EXCERPT_REACH = 2, 1
JOIN = "\n\n"


def around(chunks: DataFrame, spots: DataFrame, reach: int, at: str = "chunk_index") -> DataFrame:
    """spots with near: the chunks of the same version up to reach away from a place, as an ordered array of (chunk_index, content)."""
    keys = ["document_id", "version", at]
    places = spots.select(*keys).distinct().withColumn("_at", F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)))
    own = chunks.select("document_id", "version", F.col("chunk_index").alias("_at"), "content")
    met = places.join(own, ["document_id", "version", "_at"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("chunk_index"), "content"))).alias("near"))
    return spots.join(met, keys, "left")


def joined(near: Column) -> Column:
    return F.array_join(F.transform(near, lambda c: c["content"]), JOIN)


def place_in(near: Column, at: Column) -> Column:
    """Where the chunk at begins in the joined text, from 0."""
    before = F.filter(near, lambda c: c["chunk_index"] < at)
    return F.aggregate(before, F.lit(0), lambda n, c: n + F.length(c["content"]) + len(JOIN))


def excerpts(chunks: DataFrame, hits: DataFrame, query: DataFrame, pattern: str | None) -> DataFrame:
    """(document_id, version, excerpt_index): for each hit the nearest chunk of its version that holds the identifier; no rows without one."""
    if pattern is None:
        return hits.select("document_id", "version", F.col("chunk_index").alias("excerpt_index")).where(F.lit(False))
    own = chunks.join(hits.select("document_id", "version"), ["document_id", "version"], "left_semi").where(F.col("content").rlike(pattern))
    return best_per(with_distance(own, query), ["document_id", "version"], "distance", "chunk_index").select("document_id", "version", F.col("chunk_index").alias("excerpt_index"))


def shown_hits(chunks: DataFrame, hits: DataFrame, query: DataFrame, asked: str) -> DataFrame:
    """hits (document_id, version, chunk_index, rank, ...) with content, shown_index, near and preview.

    content is the text around the excerpt, or else around the hit itself. near are the chunks around either; the preview is the excerpt's
    text from the identifier on, or the stretch of near that holds most of what was asked; shown_index is the chunk that it begins in.
    """
    pattern = text.identifier_pattern(asked)
    found = hits.join(excerpts(chunks, hits, query, pattern), ["document_id", "version"], "left").withColumn("centre", F.coalesce("excerpt_index", "chunk_index"))
    found = around(chunks, found, EXCERPT_REACH, "centre")
    plain = context(chunks, hits.select("document_id", "chunk_index")).withColumnRenamed("context", "plain")
    found = found.join(plain, ["document_id", "chunk_index"], "left").withColumn("content", F.when(F.col("excerpt_index").isNotNull(), joined(F.col("near"))).otherwise(F.col("plain"))).drop("plain")
    if pattern is not None:
        own = F.try_element_at(F.filter("near", lambda c: (c["chunk_index"] == F.col("chunk_index")) & c["content"].rlike(pattern)), F.lit(1))
        begin = F.regexp_instr(own["content"], F.lit(pattern))
        return found.withColumns({"preview": F.substring(own["content"], begin, F.lit(text.PREVIEW_MOST)), "shown_index": F.col("chunk_index")})
    whole = text.preview_options(found.withColumn("whole", joined(F.col("near"))), "whole").withColumn("chosen", text.best_option(F.col("options"), asked))
    whole = whole.withColumn("preview", F.when(F.col("chosen").isNotNull(), text.with_row_before(F.col("whole"), F.col("chosen"))))
    start = F.instr("whole", F.col("preview")) - 1
    begun = F.filter("near", lambda c: place_in(F.col("near"), c["chunk_index"]) <= start)
    return whole.withColumn("shown_index", F.coalesce(F.try_element_at(begun, F.lit(-1))["chunk_index"], F.col("chunk_index"))).drop("whole", "options", "chosen")


def merged_passages(chunks: DataFrame, found: DataFrame, most: int = MOST_PASSAGES, reach: int = PASSAGE_REACH) -> DataFrame:
    """(document_id, version, chunk_index, first, last, content, score, focus_from, focus_to, place) of candidates (document_id, version, chunk_index, distance).

    The nearest candidates of a document, most of them, take the chunks around them; those whose chunks overlap or touch become one passage. It is
    named after its nearest candidate, whose place in the text is the focus; passages of a document stand by score.
    """
    order = Window.partitionBy("document_id", "version").orderBy("distance", "chunk_index")
    near = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    near = around(chunks, near.select("document_id", "version", "chunk_index", "distance"), reach).where(F.col("near").isNotNull())
    first, last = F.try_element_at("near", F.lit(1))["chunk_index"], F.try_element_at("near", F.lit(-1))["chunk_index"]
    along = Window.partitionBy("document_id", "version").orderBy("first", "chunk_index")
    spans = near.withColumns({"first": first, "last": last})
    spans = spans.withColumn("reached", F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("first") > F.col("reached") + 1, 1).otherwise(0)).over(along))
    grouped = spans.groupBy("document_id", "version", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.struct("distance", "chunk_index")).alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")
    )
    start = place_in(F.col("near"), F.col("best.chunk_index"))
    own = F.try_element_at(F.filter("near", lambda c: c["chunk_index"] == F.col("best.chunk_index")), F.lit(1))["content"]
    out = grouped.select(
        "document_id", "version", F.col("best.chunk_index").alias("chunk_index"), "first", "last", joined(F.col("near")).alias("content"),
        F.round(1 - F.col("best.distance"), 6).alias("score"), start.alias("focus_from"), (start + F.length(own)).alias("focus_to"), F.col("best.distance").alias("_d"),
    )
    return out.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "version").orderBy("_d", "chunk_index"))).drop("_d")


def hits_and_passages(corpus, request: Request, query: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a search shows of its direct hits, and their passages; the candidates, five times k rows, are written once."""
    found = cut_lineage(candidates(corpus, request, query))
    hits = cut_lineage(ranked_hits(found, request).select("document_id", "title", "version", "chunk_index", "distance", "rank"))
    passages = merged_passages(corpus.chunks, found.join(hits.select("document_id", "version"), ["document_id", "version"], "left_semi"))
    return shown_hits(corpus.chunks, hits, query, request.text), passages


def chunks_at(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, place, document_id, version, chunk_index, content) of places given as three arrays of a row (ids, versions, indexes); a place without a chunk has no row."""
    places = asked.select("key", F.posexplode(F.arrays_zip("ids", "versions", "indexes")).alias("place", "at")).select("key", "place", F.col("at.ids").alias("document_id"), F.col("at.versions").alias("version"), F.col("at.indexes").alias("chunk_index"))
    return places.join(chunks.select("document_id", "version", "chunk_index", "content"), ["document_id", "version", "chunk_index"]).select("key", "place", "document_id", "version", "chunk_index", "content")


#: Where evidence may get lost, in the order in which it is looked for.
CAUSES = ("extraction", "candidates", "selection", "complete")


def evidence_grades(evidence: DataFrame, hits: DataFrame, passages: DataFrame, stored: DataFrame, top: int = 5) -> DataFrame:
    """(query, required, first_excerpt, top_passages, cause) of evidence (query, source, text): how many sentences the first hit's excerpt and the passages of the top hits hold.

    hits: (query, rank, title, content); passages: (query, rank, title, content); stored: (title, content). Blanks count as one. The cause is the first
    that holds: a text that no document of its title has (extraction), that no excerpt or passage of a top hit of its title has (candidates), or
    that the best hit of its title does not show (selection).
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    asked = evidence.select("query", "source", plain("text").alias("_t")).distinct()
    holds = F.contains(plain("content"), F.col("_t"))
    key = ["query", "source", "_t"]
    told = asked.join(stored.withColumnRenamed("title", "source"), "source").groupBy(*key).agg(F.bool_or(holds).alias("stored"))
    near = hits.where(F.col("rank") <= top).withColumnRenamed("title", "source")
    best = near.groupBy("query", "source").agg(F.min_by("content", "rank").alias("content"))
    shown = asked.join(best, ["query", "source"]).groupBy(*key).agg(F.bool_or(holds).alias("shown"))
    first = asked.join(near.where("rank = 1"), ["query", "source"]).groupBy(*key).agg(F.bool_or(holds).alias("first"))
    parts = passages.where(F.col("rank") <= top).withColumnRenamed("title", "source").select("query", "source", "content")
    passage = asked.join(parts, ["query", "source"]).groupBy(*key).agg(F.bool_or(holds).alias("passage"))
    out = asked
    for more in (told, shown, first, passage, asked.join(near.select("query", "source", "content"), ["query", "source"]).groupBy(*key).agg(F.bool_or(holds).alias("excerpt"))):
        out = out.join(more, key, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    cause = F.when(no("stored"), 0).when(no("passage") & no("excerpt"), 1).when(no("shown"), 2).otherwise(3)
    graded = out.groupBy("query").agg(F.count("*").alias("required"), F.count_if(~no("first")).alias("first_excerpt"), F.count_if(~no("passage")).alias("top_passages"), F.min(cause).alias("_c"))
    return graded.select("query", "required", "first_excerpt", "top_passages", F.get(F.array(*map(F.lit, CAUSES)), F.col("_c")).alias("cause"))
