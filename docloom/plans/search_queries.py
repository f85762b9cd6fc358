"""Visibility, vector search, similarity graph and link queries."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import analytics, communities, embedding, graph, partition_index, search, vectors, visibility
from docloom.operators.search import Request
from docloom.plans.corpus import SHARE, Corpus, visible_folders_sql, visible_sql, with_tables
from docloom.plans.registry import query
from docloom.sources.store import replace_by_source

DISTANCE = "round(list_cosine_distance(embedding, q), 9)"
NEAR = f"SELECT c.*, {DISTANCE} AS distance FROM chunks c, qv"


def _visible(principal: str | None) -> str:
    return with_tables(f"SELECT DISTINCT id FROM ({visible_sql(principal)})")


@query(_visible("user1"))
def visible_docs_owner(c):
    return visibility.visible_documents(c, "user1")


@query(_visible(None))
def visible_docs_anonymous(c):
    return visibility.visible_documents(c, None)


@query(_visible(SHARE))
def visible_docs_share(c):
    return visibility.visible_documents(c, SHARE)


@query(_visible("user3"))
def visible_docs_group_member(c):
    return visibility.visible_documents(c, "user3")


@query(with_tables(f"SELECT DISTINCT folder_id FROM ({visible_folders_sql('user1')})"))
def visible_folders(c):
    return visibility.visible_folders(c, "user1")


@query(with_tables("""SELECT id, CASE WHEN follows_folder AND folder_id IS NOT NULL THEN rv ELSE visibility END AS effective_visibility FROM docs
    LEFT JOIN (SELECT c.folder_id AS f, r.visibility AS rv FROM closure c JOIN folders r ON r.id = c.ancestor_id WHERE r.parent_id IS NULL) ON f = folder_id"""))
def effective_visibility(c):
    return visibility.effective_visibility(c)


@query(with_tables("SELECT c.folder_id, string_agg(f.name, '/' ORDER BY c.depth DESC) AS path FROM closure c JOIN folders f ON f.id = c.ancestor_id GROUP BY 1"))
def folder_paths(c):
    return visibility.folder_paths(c)


def _topk(where: str = "true") -> str:
    return with_tables(f"""SELECT document_id, chunk_index, distance, round(1 - distance, 6) AS score, row_number() OVER (ORDER BY tr, distance, document_id) AS rank FROM (
        SELECT *, CASE WHEN title = 'Title 3' THEN 0 ELSE 1 END AS tr FROM (SELECT n.document_id, n.chunk_index, n.distance, d.title FROM near n JOIN docs d ON d.id = n.document_id JOIN vis ON vis.id = d.id
        WHERE {where} ORDER BY distance, document_id, chunk_index LIMIT 50) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY distance, chunk_index) = 1) QUALIFY rank <= 10""", near=NEAR)


def _direct(c, **filters):
    return search.direct_hits(c, Request("user1", text="Title 3", **filters), c.query_vector)


@query(_topk())
def vector_topk(c):
    return _direct(c)


@query(_topk("list_has_any(tags, ['en', 'group-3'])"))
def vector_topk_tags(c):
    return _direct(c, tags=("en", "group-3"))


@query(_topk("content_type = 'md'"))
def vector_topk_type(c):
    return _direct(c, content_type="md")


@query(_topk("folder_id IN (SELECT folder_id FROM closure WHERE ancestor_id = 'r2') AND 'r2' IN (SELECT folder_id FROM visf)"))
def vector_topk_folder(c):
    return _direct(c, folder_id="r2")


#: Queries and which documents each promotes: (text, whole title, stem, edition demanded).
ASKED = (("Title 3", "Title 3", None, None), ("Rules 2021판", None, "Rules", "2021"), ("Rules 2020판 and 2021판", None, None, None), ("2020 and 2021 of Rules", None, None, None), ("the Rules of 2020년판", None, "Rules", "2020"))


def _title_sql(whole, stem, edition) -> str:
    return f"title = '{whole}'" if whole else f"title = '{stem} ({edition}판)'" if stem else "false"


@query(with_tables("SELECT q, id, title, CASE WHEN CASE q " + " ".join(f"WHEN {i} THEN {_title_sql(w, s, e)}" for i, (_, w, s, e) in enumerate(ASKED)) + """ END THEN 0 ELSE 1 END AS title_rank
    FROM (SELECT id, CASE id % 3 WHEN 0 THEN title ELSE 'Rules (' || (2018 + id % 5) || '판)' END AS title FROM docs), (SELECT unnest(range(5)) AS q)"""))
def title_priority(c):
    i = F.col("id")
    docs = c.documents.select("id", F.when(i % 3 == 0, F.col("title")).otherwise(F.concat(F.lit("Rules ("), 2018 + i % 5, F.lit("판)"))).alias("title"))
    ranks = F.array(*(F.struct(F.lit(n).cast("long").alias("q"), search.title_rank(F.col("title"), text).alias("title_rank")) for n, (text, *_) in enumerate(ASKED)))
    return docs.select("id", "title", F.inline(ranks)).select("q", "id", "title", "title_rank")


@query(with_tables("SELECT id, CASE WHEN title = 'Title 12' THEN 0 WHEN title = 'Title 1' THEN 0 ELSE 1 END AS number_rank, 1 AS plain_rank FROM docs"))
def number_priority(c):
    rank = lambda text: search.number_rank(F.col("title"), text)
    return c.documents.select("id", rank("ADR-7 in Title 12").alias("number_rank"), rank("ADR-7 and ADR-8 in Title 12").alias("plain_rank"))


@query(with_tables("""SELECT a.document_id, a.chunk_index, string_agg(b.content, chr(10) || chr(10) ORDER BY b.chunk_index) AS context
    FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 GROUP BY 1, 2"""))
def neighbour_context(c):
    return search.context(c.chunks, c.chunks)


@query(with_tables("""SELECT id, dimension, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS weight FROM (SELECT id, ('0x' || h[1:8])::BIGINT % 64 AS dimension,
    sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS s FROM (SELECT id, sha256(w) AS h FROM (SELECT id, unnest(regexp_split_to_array(content, '\\s+')) AS w FROM docs) WHERE w <> '') GROUP BY 1, 2)
    QUALIFY s <> 0"""))
def hash_embedding(c):
    return vectors.hash_embedding(c.documents)


KNN = """SELECT src, src_chunk, dst, dst_chunk, distance FROM (SELECT a.document_id AS src, a.chunk_index AS src_chunk, b.document_id AS dst, b.chunk_index AS dst_chunk,
    round(list_cosine_distance(a.embedding, b.embedding), 9) AS distance FROM chunks a JOIN chunks b ON a.document_id <> b.document_id)
    QUALIFY row_number() OVER (PARTITION BY src, src_chunk ORDER BY distance, dst, dst_chunk) <= 10"""
STATS = "SELECT src, dst, count(DISTINCT src_chunk) AS matched_src, count(DISTINCT dst_chunk) AS matched_dst, min(distance) AS min_distance FROM knn GROUP BY 1, 2"
EDGES = """SELECT src, dst, CASE WHEN o THEN 'overlaps' ELSE 'related' END AS kind, CASE WHEN NOT o THEN sc END AS src_chunk, CASE WHEN NOT o THEN dc END AS dst_chunk,
    round(CASE WHEN o THEN matched_src / n_src ELSE 1 - min_distance END, 6) AS score FROM (SELECT s.*, x.c.b AS sc, x.c.c AS dc, ns.n AS n_src,
    least(matched_src / ns.n, matched_dst / nd.n) >= 0.8 AND matched_src >= 3 AND matched_dst >= 3 AS o FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY matched_src DESC, min_distance, dst) AS rank FROM stats QUALIFY rank <= 5) s
    JOIN (SELECT src, dst, min({'a': distance, 'b': src_chunk, 'c': dst_chunk}) AS c FROM knn GROUP BY 1, 2) x USING (src, dst)
    JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) ns ON ns.document_id = src JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) nd ON nd.document_id = dst)"""
GRAPH = {"knn": KNN, "stats": STATS, "edges": EDGES}
BOTH = "SELECT src AS a, dst AS b, kind, dst_chunk AS b_chunk, score FROM edges UNION ALL SELECT dst, src, kind, src_chunk, score FROM edges"


def edges_of(c):
    """The stored graph."""
    return c.edges


@query(with_tables("SELECT src, dst, matched_src, matched_dst, round(min_distance, 6) AS min_distance FROM stats", **GRAPH))
def edge_pair_stats(c):
    return graph.pair_stats(vectors.neighbours(c.chunks)).withColumn("min_distance", F.round("min_distance", 6))


@query(with_tables("SELECT * FROM edges", **GRAPH))
def build_edges(c):
    return graph.build_edges(c.chunks)


@query(with_tables("SELECT * FROM edges", **GRAPH))
def stored_edges(c):
    return edges_of(c)


@query(with_tables("SELECT src, dst, kind, CASE WHEN src % 10 = 3 THEN score ELSE -1 END AS score FROM edges", **GRAPH))
def replace_edges(c):
    """Edges of some documents replace theirs in an older state of the graph; those that point to them stay."""
    old = edges_of(c).withColumn("score", F.lit(-1.0))
    sources = c.documents.where("id % 10 = 3").select(F.col("id").alias("src"))
    return replace_by_source(old, edges_of(c), sources, "src").select("src", "dst", "kind", "score")


CUT = {"cut": "SELECT * FROM chunks WHERE document_id % 10 <> 3 OR chunk_index < 3"} | {
    f"{n}_cut": GRAPH[n].replace("chunks", "cut").replace("knn", "knn_cut").replace("stats", "stats_cut") for n in GRAPH
}


@query(with_tables("SELECT * FROM edges WHERE src % 10 <> 3 UNION ALL SELECT * FROM edges_cut WHERE src % 10 = 3", **GRAPH, **CUT))
def rebuild_edges(c):
    """Some documents lost their last chunks: their edges are built again in a copy of the kept graph; those of all others stay as they are."""
    fork = c.kept_edges.fork(f"edges-rebuilt-{uuid.uuid4().hex}")
    sources = c.documents.where("id % 10 = 3").select(F.col("id").alias("src"))
    return graph.rebuild_edges(fork, sources, c.chunks.where("document_id % 10 <> 3 OR chunk_index < 3"), "rebuilt")


@query(with_tables("SELECT * FROM knn", knn=KNN))
def indexed_neighbours(c):
    """The exact nearest chunks by inverted lists: some lists probed, then those that the bound cannot leave out."""
    index = partition_index.build(c.chunks)
    return partition_index.search(index, c.chunks, exact=True)


@query(with_tables("SELECT document_id, chunk_index, CASE WHEN document_id % 4 = 1 THEN substr(content, 1, 20) ELSE content END AS content FROM chunks WHERE document_id % 4 <> 1 OR chunk_index < 2"))
def replace_chunks(c):
    own = c.chunks.select("document_id", "chunk_index", "content")
    fresh = own.where("chunk_index < 2").withColumn("content", F.substring("content", 1, 20))
    return replace_by_source(own, fresh, own.where("document_id % 4 = 1"), "document_id")


KNN40 = KNN.replace("<= 10", "<= 40")


@query(with_tables("SELECT n.k, round(avg(d), 6) AS avg_docs, min(d) AS min_docs, max(d) AS max_docs FROM (SELECT k, src, src_chunk, count(DISTINCT dst) AS d FROM (SELECT unnest([5, 10, 20, 40]) AS k) n JOIN (SELECT *, row_number() OVER (PARTITION BY src, src_chunk ORDER BY distance, dst, dst_chunk) AS r FROM knn40) x ON x.r <= n.k GROUP BY ALL) n GROUP BY 1", knn40=KNN40))
def edge_neighbour_spread(c):
    """How many documents the 5, 10, 20 and 40 nearest chunks of a chunk come from."""
    near = vectors.neighbours(c.chunks, 40)
    r = F.row_number().over(Window.partitionBy("src", "src_chunk").orderBy("distance", "dst", "dst_chunk"))
    each = near.withColumn("r", r).withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20, 40))))).where("r <= k").groupBy("k", "src", "src_chunk").agg(F.countDistinct("dst").alias("d"))
    return each.groupBy("k").agg(F.round(F.avg("d"), 6).alias("avg_docs"), F.min("d").alias("min_docs"), F.max("d").alias("max_docs"))


@query(with_tables("SELECT CAST(least(10, floor(r * 10 / 1.000001) + 1) AS BIGINT) AS bucket, count(*) AS pairs FROM (SELECT matched_src / n AS r FROM stats JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) ON document_id = src) GROUP BY 1", **GRAPH))
def edge_ratio_histogram(c):
    n = c.chunks.groupBy(F.col("document_id").alias("src")).agg(F.count("*").alias("n"))
    ratio = graph.pair_stats(vectors.neighbours(c.chunks)).join(n, "src").select(F.expr("width_bucket(matched_src / n, 0, 1.000001, 10)").alias("bucket"))
    return ratio.groupBy("bucket").agg(F.count("*").alias("pairs"))


@query(with_tables("SELECT count(*) AS pairs FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges)", **GRAPH))
def edge_pair_count(c):
    return edges_of(c).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("pairs"))


LINKS = r"""SELECT DISTINCT id, target FROM (SELECT id, trim(regexp_replace(split_part(split_part(regexp_extract(m, '\[\[([^\[\]]+)\]\]', 1), '|', 1), '#', 1), '^.*/', '')) AS target
    FROM (SELECT id, unnest(regexp_extract_all(replace(content, '\|', '|'), '(!?)\[\[([^\[\]]+)\]\]')) AS m FROM linked) WHERE m NOT LIKE '!%')
    WHERE target <> '' AND target NOT LIKE '"%' AND NOT regexp_matches(lower(target), '\.(png|jpe?g|gif|svg|webp|bmp|pdf|mp3|mp4)$')"""
RESOLVED = "SELECT DISTINCT l.id AS src, d.id AS dst FROM links l JOIN docs d ON d.title = l.target JOIN vis ON vis.id = d.id WHERE l.id <> d.id"


@query(with_tables("SELECT * FROM links", links=LINKS))
def wikilinks(c):
    return search.wikilinks(c.linked_text)


@query(with_tables("SELECT l.id, l.target, count(d.id) AS found FROM links l LEFT JOIN (SELECT docs.id, title FROM docs JOIN vis USING (id)) d ON d.title = l.target GROUP BY 1, 2", links=LINKS))
def resolve_links(c):
    seen = c.documents.join(visibility.visible_documents(c, "user1"), "id", "left_semi").select(F.col("id").alias("d"), "title")
    return search.wikilinks(c.linked_text).join(seen, F.col("target") == F.col("title"), "left").groupBy("id", "target").agg(F.count("d").alias("found"))


@query(with_tables("SELECT dst AS id, count(*) AS backlinks FROM resolved JOIN vis ON vis.id = src GROUP BY 1", links=LINKS, resolved=RESOLVED))
def backlinks(c):
    seen = visibility.visible_documents(c, "user1")
    return search.resolved_links(c, seen).join(seen.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("backlinks"))


@query(with_tables("SELECT l.id, l.target FROM links l JOIN vis USING (id) WHERE NOT EXISTS (SELECT 1 FROM docs d JOIN vis v ON v.id = d.id WHERE d.title = l.target)", links=LINKS))
def broken_links(c):
    seen = visibility.visible_documents(c, "user1")
    titles = c.documents.join(seen, "id", "left_semi").select(F.col("title").alias("target"))
    return search.wikilinks(c.linked_text).join(seen, "id", "left_semi").join(titles, "target", "left_anti").select("id", "target")


KIND = "CASE kind WHEN 'overlaps' THEN 0 WHEN 'related' THEN 1 WHEN 'refers' THEN 2 ELSE 3 END"
WALK = {
    "links": LINKS,
    "resolved": RESOLVED,
    **GRAPH,
    "near": NEAR,
    "cand": "SELECT n.document_id, n.version, d.title, n.chunk_index, n.distance FROM near n JOIN docs d ON d.id = n.document_id JOIN vis ON vis.id = d.id ORDER BY distance, document_id, chunk_index LIMIT 50",
    "direct": """SELECT document_id, version, chunk_index, distance, row_number() OVER (ORDER BY CASE WHEN title = 'Title 3' THEN 0 ELSE 1 END, distance, document_id) AS rank
        FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY distance, chunk_index) = 1) QUALIFY rank <= 10""",
    "steps": """SELECT DISTINCT a, b, kind, b_chunk FROM (SELECT src AS a, dst AS b, kind, dst_chunk AS b_chunk FROM edges UNION ALL SELECT dst, src, kind, src_chunk FROM edges
        UNION ALL SELECT src, dst, 'refers', NULL FROM resolved) WHERE b IN (SELECT id FROM vis) AND b NOT IN (SELECT document_id FROM direct)""",
    "one": "SELECT l.document_id AS origin, s.b AS document_id, s.b_chunk AS target_chunk, l.distance + 2.0 AS distance, s.kind, 1 AS depth, s.a AS via FROM (SELECT document_id, min(distance) AS distance FROM cand GROUP BY 1) l JOIN steps s ON s.a = l.document_id",
    "two": "SELECT o.origin, s.b AS document_id, s.b_chunk AS target_chunk, o.distance + 2.0 AS distance, s.kind, 2 AS depth, s.a AS via FROM (SELECT DISTINCT origin, document_id, distance FROM one) o JOIN steps s ON s.a = o.document_id WHERE s.b <> o.origin",
    "reached": f"""SELECT document_id, target_chunk, distance, kind, depth, via FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE document_id <> origin
        QUALIFY row_number() OVER (PARTITION BY document_id, coalesce(target_chunk, -1) ORDER BY distance, {KIND}, depth, via, origin) = 1""",
    "spot": """SELECT r.document_id, n.version, n.chunk_index, r.depth, r.kind, r.distance FROM reached r JOIN near n ON n.document_id = r.document_id AND (r.target_chunk IS NULL OR r.target_chunk = n.chunk_index)
        QUALIFY row_number() OVER (PARTITION BY r.document_id, r.target_chunk ORDER BY n.distance, n.chunk_index) = 1""",
    "more": f"""SELECT * FROM (SELECT * FROM spot UNION ALL SELECT c.document_id, v.version, c.chunk_index, 1, 'revision', c.distance + 2.0 FROM cand c JOIN versions v ON v.document_id = c.document_id AND v.version + 1 = c.version)
        QUALIFY row_number() OVER (PARTITION BY document_id, version, CASE kind WHEN 'revision' THEN -1 ELSE chunk_index END ORDER BY distance, {KIND}, depth, chunk_index) = 1""",
}


def _request():
    return Request("user1", text="Title 3")


@query(with_tables("SELECT document_id, target_chunk, round(distance, 6) AS distance, kind, depth, via FROM reached", **WALK))
def search_expand_edges(c):
    request, edges = _request(), edges_of(c)
    links = search.resolved_links(c, visibility.visible_documents(c, "user1"))
    out = search.walk(search.candidates(c, request, c.query_vector), search.traversal_edges(edges, links), search.matching(c, request), search.direct_hits(c, request, c.query_vector))
    return out.withColumn("distance", F.round("distance", 6))


@query(with_tables(f"""SELECT document_id, version, chunk_index, depth, kind, part_rank, round(1 - distance, 6) AS score, round(distance, 6) AS distance FROM (
    SELECT document_id, version, chunk_index, 0 AS depth, 'direct' AS kind, distance, rank AS part_rank FROM direct UNION ALL
    SELECT *, row_number() OVER (ORDER BY distance, {KIND}, depth, document_id, version, chunk_index) AS part_rank FROM more QUALIFY part_rank <= 10)""", **WALK))
def search_full(c):
    return search.search(c, _request(), c.query_vector, edges_of(c))


ASKED_TEXT = "the of and in der die que de la"
WORDS_OF = "SELECT {key}, ('0x' || h[1:8])::BIGINT % 64 AS dimension, sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END) AS s FROM (SELECT {key}, sha256(w) AS h FROM (SELECT {key}, unnest(regexp_split_to_array(content, '\\s+')) AS w FROM {table}) WHERE w <> '') GROUP BY ALL HAVING s <> 0"
HASHED = {
    "hv": "SELECT document_id, chunk_index, dimension, round(s / sqrt(sum(s * s) OVER (PARTITION BY document_id, chunk_index)), 6) AS w FROM (" + WORDS_OF.format(key="document_id, chunk_index", table="chunks") + ")",
    "hq": "SELECT dimension, s / sqrt(sum(s * s) OVER ()) AS w FROM (" + WORDS_OF.format(key="one", table=f"(SELECT 1 AS one, '{ASKED_TEXT}' AS content)") + ")",
    "near": """SELECT c.*, round(1 - x.d, 9) AS distance FROM chunks c LEFT JOIN (SELECT document_id, chunk_index, coalesce(sum(v.w * q.w), 0) / (sqrt(sum(v.w * v.w)) * (SELECT sqrt(sum(w * w)) FROM hq)) AS d FROM hv v LEFT JOIN hq q USING (dimension) GROUP BY 1, 2) x USING (document_id, chunk_index)""",
}


class Hashed(Corpus):
    """The corpus with the hash embedding of each chunk's text."""

    @cached_property
    def chunks(self):
        return embedding.hashed(super().chunks.drop("embedding"), ["document_id", "chunk_index"])


@query(with_tables("""SELECT document_id, chunk_index, distance, round(1 - distance, 6) AS score, row_number() OVER (ORDER BY distance, document_id) AS rank FROM (SELECT * FROM (SELECT n.document_id, n.chunk_index, n.distance FROM near n JOIN docs d ON d.id = n.document_id JOIN vis ON vis.id = d.id
    ORDER BY distance, document_id, chunk_index LIMIT 50) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY distance, chunk_index) = 1) QUALIFY rank <= 10""", **HASHED))
def text_search(c):
    """A search for a text: the query and the chunks go through the same embedding."""
    asked = embedding.query_vector(c.spark, ASKED_TEXT, embedding.hash_provider())
    return search.direct_hits(Hashed(c.spark, c.sf_dir), Request("user1", text=ASKED_TEXT), asked)


@query(with_tables("""SELECT document_id, chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY distance, chunk_index) AS place, context FROM cand JOIN (
    SELECT a.document_id, a.chunk_index, string_agg(b.content, chr(10) || chr(10) ORDER BY b.chunk_index) AS context FROM chunks a JOIN chunks b ON a.document_id = b.document_id
    AND b.chunk_index BETWEEN a.chunk_index - 2 AND a.chunk_index + 2 GROUP BY 1, 2) USING (document_id, chunk_index) QUALIFY place <= 8""", **WALK))
def search_passages(c):
    found = search.candidates(c, _request(), c.query_vector)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("distance", "chunk_index"))
    found = found.withColumn("place", place).where("place <= 8")
    return found.join(search.context(c.chunks, found, reach=2), ["document_id", "chunk_index"]).select("document_id", "chunk_index", "place", "context")


@query()
def clusters(c):
    """(node, name) of every visible document: communities of the graph between visible documents by name, the uncategorised apart."""
    seen = visibility.hold_visible(c, "user1")
    edges = c.edges.join(seen.withColumnRenamed("id", "src"), "src", "left_semi").join(seen.withColumnRenamed("id", "dst"), "dst", "left_semi")
    docs = c.documents.join(seen, "id", "left_semi").select("id", "title", "tags")
    found = communities.louvain(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = found.join(analytics.cluster_names(docs, found, edges), "community").select("node", "name")
    every = docs.select(F.col("id").alias("node")).join(named, "node", "left").withColumn("name", F.coalesce("name", F.lit(analytics.UNCATEGORIZED)))
    return analytics.fold_clusters(every)
