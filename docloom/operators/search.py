"""The hybrid search: filters, visibility, nearest chunks, a walk of two steps over edges and links, previous versions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import identifier_pattern
from docloom.operators import graph, visibility
from docloom.operators.vectors import best_per, with_distance
from docloom.session import cut_lineage

OVER_FETCH = 5
HOP_COST = 2.0
#: Which kind of edge wins when paths are equal.
KIND_ORDER = {"overlaps": 0, "related": 1, "refers": 2, "revision": 3}


@dataclass(frozen=True)
class Request:
    principal: str | None
    k: int = 10
    text: str = ""
    tags: tuple[str, ...] = ()
    content_type: str | None = None
    folder_id: str | None = None


def kind_rank(kind: str | Column) -> Column:
    out = F.when(F.col(kind) == "overlaps", 0)
    for name in ("related", "refers", "revision"):
        out = out.when(F.col(kind) == name, KIND_ORDER[name])
    return out


STEM, EDITION = r" \(\d{4}판\)$", r" \((\d{4})판\)$"


def edition_of(text: str) -> str | None:
    """The one edition that a query asks for: a year before 판 or 년판."""
    years = set(re.findall(r"(?<!\d)(?:19|20)\d{2}(?=\s*(?:판|년판))", text))
    return years.pop() if len(years) == 1 else None


def title_rank(title: Column, text: str) -> Column:
    """0 for the title that the query is, or, where it asks for one edition, names; that edition is then demanded. 1 for others."""
    edition = edition_of(text)
    if edition is None:
        return F.when(title == F.lit(text), 0).otherwise(1)
    named = (title == F.lit(text)) | F.lit(text).contains(F.regexp_replace(title, STEM, ""))
    return F.when(named & (F.regexp_extract(title, EDITION, 1) == edition), 0).otherwise(1)


def number_rank(title: Column, text: str) -> Column:
    """0 for titles that a query with one numbered decision or article names, 1 for others."""
    if identifier_pattern(text) is None:
        return F.lit(1)
    return F.when(F.lit(text).contains(F.regexp_replace(title, STEM, "")), 0).otherwise(1)


def matching(corpus, request: Request, in_folder: bool = True) -> DataFrame:
    """(document_id, title) of visible documents that pass the request's filters."""
    docs = corpus.documents.join(visibility.visible_documents(corpus, request.principal), "id", "left_semi")
    if request.tags:
        docs = docs.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, request.tags))), F.lit(False)))
    if request.content_type:
        docs = docs.where(F.col("content_type") == request.content_type)
    if in_folder and request.folder_id:
        below = visibility.closure(corpus).where(F.col("ancestor_id") == request.folder_id).select("folder_id")
        seen = visibility.visible_folders(corpus, request.principal).where(F.col("folder_id") == request.folder_id)
        docs = docs.join(below, "folder_id", "left_semi").join(seen.select(F.lit(1).alias("_seen")), F.lit(1) == F.col("_seen"), "left_semi")
    return docs.select(F.col("id").alias("document_id"), "title")


def candidates(corpus, request: Request, query: DataFrame) -> DataFrame:
    """The nearest chunks, five times as many as documents are asked for: (document_id, title, chunk_index, distance)."""
    near = with_distance(corpus.chunks.join(matching(corpus, request), "document_id"), query)
    return near.select("document_id", "title", "version", "chunk_index", "distance").orderBy(F.asc_nulls_last("distance"), "document_id", "chunk_index").limit(OVER_FETCH * request.k)


def ranked_hits(found: DataFrame, request: Request) -> DataFrame:
    """The best candidate of each document with its rank, documents that the query names first."""
    best = best_per(found, ["document_id"], "distance", "chunk_index")
    order = Window.orderBy("title_rank", "number_rank", "distance", "document_id")  # over five times k rows at most
    ranked = best.withColumns({"title_rank": title_rank(F.col("title"), request.text), "number_rank": number_rank(F.col("title"), request.text)})
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= request.k)


def direct_hits(corpus, request: Request, query: DataFrame) -> DataFrame:
    """(document_id, chunk_index, distance, score, rank)."""
    ranked = ranked_hits(candidates(corpus, request, query), request)
    return ranked.select("document_id", "chunk_index", "distance", F.round(1 - F.col("distance"), 6).alias("score"), "rank")


def context(chunks: DataFrame, spots: DataFrame, reach: int = 1) -> DataFrame:
    """(document_id, chunk_index, context): the text of a chunk and its neighbours, by an equi-join on exploded places."""
    near = spots.select("document_id", "chunk_index", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("by")).withColumn("at", F.col("chunk_index") + F.col("by"))
    text = chunks.select("document_id", F.col("chunk_index").alias("at"), "content")
    met = near.join(text, ["document_id", "at"]).groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("c"))
    return met.select("document_id", "chunk_index", F.array_join(F.col("c.content"), "\n\n").alias("context"))


def link_targets(content: Column) -> Column:
    """The distinct titles in [[...]] of a text: without embeds, alias, anchor, path, media names and quoted ones."""
    found = F.regexp_extract_all(F.replace(content, F.lit("\\|"), F.lit("|")), F.lit(r"(!?)\[\[([^\[\]]+)\]\]"), F.lit(0))

    def target(m: Column) -> Column:
        name = F.split_part(F.split_part(F.regexp_extract(m, r"\[\[([^\[\]]+)\]\]", 1), F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))
        return F.trim(F.regexp_replace(name, "^.*/", ""))

    named = F.transform(F.filter(found, lambda m: ~F.startswith(m, F.lit("!"))), target)
    return F.array_distinct(F.filter(named, lambda t: (t != "") & ~F.startswith(t, F.lit('"')) & ~F.lower(t).rlike(r"\.(png|jpe?g|gif|svg|webp|bmp|pdf|mp3|mp4)$")))


def wikilinks(docs: DataFrame) -> DataFrame:
    """(id, target) of every link, once."""
    return docs.select("id", F.explode(link_targets(F.col("content"))).alias("target")).distinct()


def resolved_links(corpus, visible: DataFrame) -> DataFrame:
    """(src, dst): links to visible documents of the title, all of them when several have it."""
    links = wikilinks(corpus.linked_text)
    titles = corpus.documents.join(visible, "id", "left_semi").select(F.col("id").alias("dst"), "title")
    return links.join(titles, F.col("target") == F.col("title")).where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()


def traversal_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, kind, b_chunk): edges either way and links forward."""
    out = graph.both_ways(edges).select("a", "b", "kind", "b_chunk")
    return out.unionByName(links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("refers").alias("kind"), F.lit(None).cast("long").alias("b_chunk"))).distinct()


def walk(start: DataFrame, steps: DataFrame, allowed: DataFrame, skip: DataFrame) -> DataFrame:
    """(document_id, target_chunk, distance, kind, depth, via): what two steps reach, at 2.0 a step.

    start: (document_id, distance), folded to the least distance of each document before the walk. Targets must be allowed and not in skip.
    """
    least = start.groupBy("document_id").agg(F.min("distance").alias("distance"))
    steps = steps.join(allowed.select(F.col("document_id").alias("b")), "b", "left_semi").join(skip.select(F.col("document_id").alias("b")), "b", "left_anti")
    one = least.join(steps, F.col("document_id") == F.col("a")).select(F.col("document_id").alias("origin"), F.col("b").alias("document_id"), F.col("b_chunk").alias("target_chunk"), (F.col("distance") + HOP_COST).alias("distance"), "kind", F.lit(1).alias("depth"), F.col("a").alias("via"))
    onward = one.select("origin", F.col("document_id").alias("at"), "distance").distinct()
    two = onward.join(steps, F.col("at") == F.col("a")).where(F.col("b") != F.col("origin")).select("origin", F.col("b").alias("document_id"), F.col("b_chunk").alias("target_chunk"), (F.col("distance") + HOP_COST).alias("distance"), "kind", F.lit(2).alias("depth"), F.col("a").alias("via"))
    both = one.unionByName(two).where(F.col("document_id") != F.col("origin")).withColumn("spot", F.coalesce("target_chunk", F.lit(-1)))
    return best_per(both, ["document_id", "spot"], "distance", kind_rank("kind"), "depth", "via", "origin").drop("spot", "origin")


def search(corpus, request: Request, query: DataFrame, edges: DataFrame) -> DataFrame:
    """(document_id, version, chunk_index, depth, kind, distance, score, part_rank): k direct hits and k expansions.

    The candidates, five times k rows, are written out once; of the chunks only those of documents that the walk reaches are scored.
    """
    visible = visibility.hold_visible(corpus, request.principal)
    found = cut_lineage(candidates(corpus, request, query))
    direct = cut_lineage(ranked_hits(found, request))
    reached = cut_lineage(walk(found, traversal_edges(edges, resolved_links(corpus, visible)), matching(corpus, request, in_folder=False), direct))
    own = corpus.chunks.join(F.broadcast(reached.select("document_id").distinct()) if reached.count() <= 100_000 else reached.select("document_id").distinct(), "document_id", "left_semi")
    near = with_distance(own, query).select("document_id", "version", F.col("chunk_index").alias("c"), F.col("distance").alias("chunk_distance"))
    spot = reached.join(near, "document_id").where(F.col("target_chunk").isNull() | (F.col("target_chunk") == F.col("c")))
    spot = best_per(spot, ["document_id", "target_chunk"], "chunk_distance", "c").select("document_id", "version", F.col("c").alias("chunk_index"), "depth", "kind", "distance")
    before = corpus.versions.select("document_id", "version")
    asked = found.select("document_id", (F.col("version") - 1).alias("version"), "chunk_index", F.lit(1).alias("depth"), F.lit("revision").alias("kind"), (F.col("distance") + HOP_COST).alias("distance"))
    revised = asked.join(before, ["document_id", "version"], "left_semi")
    each = F.when(F.col("kind") != "revision", F.col("chunk_index")).otherwise(-1)
    more = best_per(spot.unionByName(revised).withColumn("spot", each), ["document_id", "version", "spot"], "distance", kind_rank("kind"), "depth", "chunk_index").drop("spot")
    order = ("distance", kind_rank("kind"), "depth", "document_id", "version", "chunk_index")
    top = more.orderBy(*order).limit(request.k).withColumn("part_rank", F.row_number().over(Window.orderBy(*order)))
    first = direct.select("document_id", "version", "chunk_index", F.lit(0).alias("depth"), F.lit("direct").alias("kind"), "distance", F.col("rank").alias("part_rank"))
    return first.unionByName(top).withColumn("score", F.round(1 - F.col("distance"), 6)).withColumn("distance", F.round("distance", 6))
