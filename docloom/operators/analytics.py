"""Read-side analytics over documents, their graph and their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import graph, visibility
from docloom.operators.search import kind_rank
from docloom.operators.vectors import best_per


def visible_hashes(corpus, principal: str | None) -> DataFrame:
    """(id, content_hash) of the visible documents, so that hashes are shuffled and no texts.

    A plan with a semi-join, or with the conditions of visibility in it, would put these before the hashes; the ids are therefore held, and joined.
    """
    return corpus.documents.select("id", "content_hash").join(visibility.hold_visible(corpus, principal).distinct(), "id")


def related(corpus, edges: DataFrame, principal: str | None) -> DataFrame:
    """(id, neighbour, kind, score, mutual) for every visible document: the best edge of either direction, other texts only."""
    hashes = visible_hashes(corpus, principal)
    sides = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "kind", "score", F.lit(0).alias("side"))
    sides = sides.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "kind", "score", F.lit(1).alias("side")))
    mutual = sides.groupBy("id", "neighbour").agg((F.countDistinct("side") == 2).alias("mutual"))
    best = best_per(sides, ["id", "neighbour"], kind_rank("kind"), F.desc("score"), "side").drop("side").join(mutual, ["id", "neighbour"])
    own, other = hashes, hashes.toDF("neighbour", "other_hash")
    return best.join(own, "id").join(other, "neighbour").where("content_hash <> other_hash").select("id", "neighbour", "kind", "score", "mutual")


def ranked_related(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(kind_rank("kind"), F.desc("mutual"), F.desc("score"), "neighbour")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def identical(corpus, principal: str | None) -> DataFrame:
    """(id, copies): visible documents whose text others have too; counted by class, no pairs."""
    seen = visible_hashes(corpus, principal)
    classes = seen.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return seen.select("id", "content_hash").join(classes, "content_hash").select("id", F.col("first").alias("class_id"), (F.col("n") - 1).alias("copies"))


def suggest_tags(corpus, rows: DataFrame, limit: int = 5) -> DataFrame:
    """(id, tag, votes): tags of the ten best neighbours that the document lacks."""
    tags = corpus.documents.select("id", "tags")
    votes = ranked_related(rows, 10).join(tags.toDF("neighbour", "theirs"), "neighbour").select("id", F.explode("theirs").alias("tag")).groupBy("id", "tag").agg(F.count("*").alias("votes"))
    new = votes.join(tags, "id").where(~F.array_contains("tags", F.col("tag")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("votes"), "tag"))
    return new.withColumn("rank", rank).where(F.col("rank") <= limit).select("id", "tag", "votes", "rank")


def suggest_folders(corpus, edges: DataFrame, principal: str | None) -> DataFrame:
    """(id, folder_id, votes, voters): the folder that at least two, and at least half, of a document's filed neighbours share."""
    seen = visibility.hold_visible(corpus, principal)
    pairs = graph.both_ways(edges).groupBy("a", "b").agg(F.max("score").alias("score"))
    pairs = pairs.join(seen.toDF("a"), "a", "left_semi").join(seen.toDF("b"), "b", "left_semi")
    filed = corpus.documents.where("folder_id is not null").join(visibility.visible_folders(corpus, principal), "folder_id", "left_semi").select(F.col("id").alias("b"), "folder_id")
    votes = pairs.join(filed, "b").groupBy("a", "folder_id").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 6).alias("weight"))
    voters = votes.groupBy("a").agg(F.sum("votes").alias("voters"))
    best = best_per(votes.join(voters, "a").where("votes >= 2 and votes * 2 >= voters"), ["a"], F.desc("votes"), F.desc("weight"), "folder_id")
    own = corpus.documents.select(F.col("id").alias("a"), F.col("folder_id").alias("now"))
    return best.join(own, "a").where(~F.col("folder_id").eqNullSafe(F.col("now"))).select(F.col("a").alias("id"), "folder_id", "votes", "voters")


def related_reasons(corpus, ranked: DataFrame, principal: str | None) -> DataFrame:
    """(id, chunks, based_on_version, related, reason) of every visible document: not_indexed without chunks, no_edges without related ones (ranked: id, ...)."""
    state = corpus.chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunks"), F.max("version").alias("based_on_version"))
    found = ranked.groupBy("id").agg(F.count("*").alias("related"))
    seen = visibility.visible_documents(corpus, principal).join(state, "id", "left").join(found, "id", "left")
    reason = F.when(F.col("chunks").isNull(), "not_indexed").when(F.col("related").isNull(), "no_edges")
    return seen.select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "based_on_version", F.when(F.col("chunks").isNotNull(), F.coalesce("related", F.lit(0))).otherwise(0).alias("related"), reason.alias("reason"))


def unfiled_suggestions(corpus, edges: DataFrame, principal: str) -> DataFrame:
    """(id, title, suggested, votes, total): the principal's own documents without a folder."""
    own = corpus.documents.where(F.col("folder_id").isNull() & (F.col("owner_id") == principal)).join(visibility.hold_visible(corpus, principal), "id", "left_semi").select("id", "title")
    total = own.agg(F.count("*").alias("total"))
    suggested = suggest_folders(corpus, edges, principal).select("id", F.col("folder_id").alias("suggested"), "votes")
    return own.join(suggested, "id", "left").crossJoin(F.broadcast(total)).select("id", "title", "suggested", "votes", "total")  # total is one row


def orphans(corpus, edges: DataFrame, principal: str | None) -> DataFrame:
    """(id): visible, extracted documents without an edge to another visible one."""
    seen = visibility.hold_visible(corpus, principal)
    ends = graph.both_ways(edges).select("a", "b").join(seen.toDF("b"), "b", "left_semi").select(F.col("a").alias("id"))
    done = corpus.documents.where("extraction_status = 'done'").join(seen, "id", "left_semi").select("id")
    return done.join(ends, "id", "left_anti")


def duplicates(corpus, edges: DataFrame, principal: str | None, top: int = 10) -> DataFrame:
    """Pairs of overlapping documents with score 0.95 or more, and one row per class of identical texts; totals and the top of each type."""
    seen = visibility.hold_visible(corpus, principal)
    over = graph.both_ways(edges).where("kind = 'overlaps' and a < b").groupBy("a", "b").agg(F.max("score").alias("score")).where("score >= 0.95")
    over = over.join(seen.toDF("a"), "a", "left_semi").join(seen.toDF("b"), "b", "left_semi").select(F.lit("overlaps").alias("match_type"), "a", "b", "score")
    same = identical(corpus, principal).where("id <> class_id").select(F.lit("identical").alias("match_type"), F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("double").alias("score"))
    both = same.unionByName(over)
    totals = both.groupBy("match_type").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("match_type").orderBy(F.desc_nulls_last("score"), "a", "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "match_type").select("match_type", "a", "b", "score", "rank", "total")


def cluster_names(docs: DataFrame, assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, kind, name, size) of communities (node, community) of docs (id, title, tags).

    The name is the tag that most sets a community apart (its count inside less that in all other documents, if above none: tagged), else the
    title of the document with the most partners inside (community). A name of a bucket tells where it comes from; names used twice get a number,
    the larger community first. edges: (src, dst), a pair of documents counts once.
    """
    own = docs.select(F.col("id").alias("node"), "title", "tags").join(assignment, "node")
    total = docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("total"))
    inside = own.select("community", F.explode("tags").alias("tag")).groupBy("community", "tag").agg(F.count("*").alias("inside"))
    scored = inside.join(total, "tag").withColumn("score", 2 * F.col("inside") - F.col("total")).where("score > 0")
    best = scored.groupBy("community").agg(F.min(F.struct((-F.col("score")).alias("s"), "tag")).getField("tag").alias("tag"))
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    met = pairs.join(assignment.toDF("a", "ca"), "a").join(assignment.toDF("b", "cb"), "b").where("ca = cb")
    degree = met.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    central = F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "title", "node")).getField("title")
    titles = own.join(degree, "node", "left").groupBy("community").agg(central.alias("central"), F.min("title").alias("first"), F.count("*").alias("size"))
    named = titles.join(best, "community", "left").withColumn("label", F.coalesce("tag", "central"))
    origin = F.when(F.col("tag").isNotNull(), " (태그)").otherwise(" (문서)")
    named = named.withColumn("label", F.when(F.col("label").isin(UNCATEGORIZED, OTHER), F.concat("label", origin)).otherwise(F.col("label")))
    number = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("size"), "first", "community"))
    name = F.when(F.col("n") > 1, F.concat("label", F.lit(" ("), "n", F.lit(")"))).otherwise(F.col("label"))
    return named.withColumn("n", number).select("community", F.when(F.col("tag").isNotNull(), "tagged").otherwise("community").alias("kind"), name.alias("name"), "size")


def cluster_connections(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(one, two, pairs): unordered document pairs between communities, each counted once."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    met = pairs.join(assignment.toDF("a", "ca"), "a").join(assignment.toDF("b", "cb"), "b").where("ca <> cb")
    return met.groupBy(F.least("ca", "cb").alias("one"), F.greatest("ca", "cb").alias("two")).agg(F.count("*").alias("pairs"))


def system_status(corpus) -> DataFrame:
    """One row of counts; one aggregate per table, cross-joined."""
    docs = corpus.documents.agg(
        F.count("*").alias("documents"), F.count_if(F.col("deleted_at").isNotNull()).alias("trashed"), F.count_if(F.col("embedding_status") == "ready").alias("ready"),
        F.count_if(F.col("extraction_status") == "failed").alias("failed"),
    )
    stale = corpus.versions.join(corpus.documents.select(F.col("id").alias("document_id"), F.col("version").alias("current")), "document_id").agg(F.countDistinct(F.when(F.col("version") != F.col("current"), F.col("document_id"))).alias("stale"))
    chunks = corpus.chunks.agg(F.count("*").alias("chunks"))
    jobs = corpus.jobs.agg(F.count_if(F.col("status") == "pending").alias("pending_jobs"), F.count_if(F.col("status") == "error").alias("failed_jobs"))
    return docs.crossJoin(F.broadcast(stale)).crossJoin(F.broadcast(chunks)).crossJoin(F.broadcast(jobs))


def intervals(log: DataFrame, ok: str, time: str, key: str) -> DataFrame:
    """Runs of failures between successes: (key, started, ended, failures); gaps and islands by a running count of successes."""
    w = Window.partitionBy(key).orderBy(time, "id").rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("island", F.sum(F.col(ok).cast("int")).over(w))
    bad = marked.where(~F.col(ok)).groupBy(key, "island").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("failures"))
    return bad.drop("island")


def merged_spans(rows: DataFrame, key: str, begin: str, end: str, gap_seconds: int = 2) -> DataFrame:
    """(key, started, ended, members): spans no more than gap_seconds apart, merged by the running end."""
    w = Window.partitionBy(key).orderBy(begin, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", (before.isNull() | (F.col(begin) > before + F.make_dt_interval(secs=F.lit(gap_seconds)))).cast("int"))
    numbered = new.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "span").agg(F.min(begin).alias("started"), F.max(end).alias("ended"), F.count("*").alias("members")).drop("span")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(queries, recall_at_k, mrr, top1, missed) of ranked (query, document, rank) against relevant (query, document)."""
    hit = relevant.join(ranked, ["query", "document"], "left").groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    return hit.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("found") / F.col("n")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.count_if(F.col("first") == 1).alias("top1"), F.count_if(F.col("first").isNull()).alias("missed"),
    )


#: The name of documents without a cluster and of clusters beyond the cap.
UNCATEGORIZED, OTHER = "미분류", "기타"


def fold_clusters(assignment: DataFrame, most: int = 20) -> DataFrame:
    """(node, name) with the largest named clusters kept and the others folded into one, so that there are ``most`` names; the uncategorised stay apart."""
    sizes = assignment.groupBy("name").agg(F.count("*").alias("size"))
    spare = F.col("name") == UNCATEGORIZED
    total = sizes.agg(F.count("*").alias("clusters"), F.count_if(spare).alias("reserved"))
    top = sizes.where(~spare).orderBy(F.desc("size"), "name").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "name"))  # over ``most`` rows
    kept = top.withColumn("rank", rank).join(F.broadcast(total)).where(f"clusters <= {most} or rank <= {most} - reserved - 1").select("name", F.lit(True).alias("kept"))
    return assignment.join(F.broadcast(kept), "name", "left").select("node", F.when(spare | F.col("kept"), F.col("name")).otherwise(OTHER).alias("name"))


def outage_log(probes: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, kind, last_ok_at, first_failure_at, recovered_at, node_before, node_after, timeline_before, timeline_after, failed_checks) of probes (key, at, id, ok, node, timeline).

    Each good answer closes the stretch since the last one: an outage if least checks failed in between, or if the timeline changed, which is a promotion.
    What comes before the first good answer is none; a change without a failure begins where it is seen.
    """
    along = Window.partitionBy(key).orderBy("at", "id")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    good = lambda c: F.last(F.when(F.col("ok"), F.col(c)), ignorenulls=True).over(before)
    marked = probes.withColumn("stretch", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(before))
    failed = F.when(~F.col("ok"), F.col("at"))
    marked = marked.withColumns({"last_ok_at": good("at"), "node_before": good("node"), "timeline_before": good("timeline")})
    inside = Window.partitionBy(key, F.coalesce("stretch", F.lit(0)))
    marked = marked.withColumns({"first_failure_at": F.min(failed).over(inside), "failed_checks": F.count(failed).over(inside)})
    changed = ~F.col("timeline").eqNullSafe(F.col("timeline_before"))
    found = marked.where(F.col("ok") & F.col("last_ok_at").isNotNull() & ((F.col("failed_checks") >= least) | changed))
    return found.select(
        key, F.when(changed, "promotion").otherwise("interruption").alias("kind"), "last_ok_at", F.coalesce("first_failure_at", "at").alias("first_failure_at"), F.col("at").alias("recovered_at"),
        "node_before", F.col("node").alias("node_after"), "timeline_before", F.col("timeline").alias("timeline_after"), "failed_checks",
    )


def share_details(shares: DataFrame, documents: DataFrame, folders: DataFrame, tokens: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """shares (share_id, name) with what they open: documents and folders (share_id, id, title/name), tokens (share_id, id, expires_at) with expired, and names of revoked tokens from the audit log's details."""
    gather = lambda df, name, *fields: df.groupBy("share_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    part = lambda name: F.get_json_object("detail", f"$.{name}")
    revoked = log.where((F.col("action") == "share_changed") & (part("change") == "token_revoked")).select(part("share_id").alias("share_id"), part("token_name").alias("name"))
    expired = F.coalesce(F.col("expires_at") <= now, F.lit(False)).alias("expired")
    out = shares
    for more in (gather(documents, "documents", "title", "id"), gather(folders, "folders", "name", "id"), gather(tokens.select("share_id", "id", "name", expired), "tokens", "id", "name", "expired"), revoked.groupBy("share_id").agg(F.array_sort(F.collect_set("name")).alias("revoked"))):
        out = out.join(more, "share_id", "left")
    return out
