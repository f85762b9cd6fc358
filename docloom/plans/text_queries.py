"""Chunks, diffs, passages, evidence, grading, tokens and snapshots."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import answers, extraction, passages, search, visibility
from docloom.operators.search import Request
from docloom.plans.corpus import Corpus, with_tables
from docloom.plans.registry import query
from docloom.plans.search_queries import NEAR, WALK

FOUND = {"near": NEAR, "cand": WALK["cand"]}


def _found(c):
    return search.candidates(c, Request("user1", text="Title 3"), c.query_vector)


@query()
def chunk_documents(c):
    return text.chunk_documents(c.documents)


@query()
def version_diff(c):
    """Each version of a document against the one before."""
    new = c.versions.select(F.col("document_id").alias("id"), "version", F.col("content").alias("new"))
    old = c.versions.select(F.col("document_id").alias("oid"), (F.col("version") + 1).alias("next"), F.col("content").alias("old"))
    pairs = new.join(old, (F.col("id") == F.col("oid")) & (F.col("version") == F.col("next"))).select(F.struct("id", "version").alias("pair"), "old", "new")
    return text.diff_versions(pairs, key="pair").select("pair.id", "pair.version", "op", "old_from", "old_to", "new_from", "new_to")


@query()
def search_previews(c):
    hits = _found(c).join(c.chunks.select("document_id", "chunk_index", "content"), ["document_id", "chunk_index"])
    return text.previews(hits, "the thing of nations")


class Numbered(Corpus):
    """The corpus with a numbered decision at the head of each chunk."""

    @cached_property
    def chunks(self):
        number = ((F.col("document_id") + F.col("chunk_index")) % 3).cast("string")
        return super().chunks.withColumn("content", F.concat(F.lit("ADR-"), number, F.lit(" "), "content"))


NEAREST = {
    **FOUND,
    "direct": WALK["direct"],
    "num": "SELECT document_id, version, chunk_index, 'ADR-' || ((document_id + chunk_index) % 3) || ' ' || content AS content FROM chunks",
    "excerpt": "SELECT n.document_id, n.version, n.chunk_index AS excerpt_index FROM near n JOIN num USING (document_id, version, chunk_index) WHERE num.content LIKE 'ADR-1 %' QUALIFY row_number() OVER (PARTITION BY n.document_id, n.version ORDER BY distance, n.chunk_index) = 1",
    "eight": "SELECT document_id, version, chunk_index, distance FROM cand QUALIFY row_number() OVER (PARTITION BY document_id, version ORDER BY distance, chunk_index) <= 8",
    "spans": "SELECT e.document_id, e.version, e.chunk_index, e.distance, min(x.chunk_index) AS first, max(x.chunk_index) AS last FROM eight e JOIN chunks x ON x.document_id = e.document_id AND x.version = e.version AND x.chunk_index BETWEEN e.chunk_index - 2 AND e.chunk_index + 2 GROUP BY ALL",
    "islands": """SELECT *, sum(CASE WHEN first > reached + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, version ORDER BY first, chunk_index) AS island FROM (
        SELECT *, max(last) OVER (PARTITION BY document_id, version ORDER BY first, chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans)""",
    "merged": """SELECT g.document_id, g.version, g.chunk_index, g.first, g.last, g.distance, string_agg(x.content, chr(10) || chr(10) ORDER BY x.chunk_index) AS content, CAST(coalesce(sum(length(x.content) + 2) FILTER (x.chunk_index < g.chunk_index), 0) AS BIGINT) AS focus_from,
        CAST(coalesce(sum(length(x.content) + 2) FILTER (x.chunk_index < g.chunk_index), 0) + max(length(x.content)) FILTER (x.chunk_index = g.chunk_index) AS BIGINT) AS focus_to
        FROM (SELECT document_id, version, island, min(first) AS first, max(last) AS last, min({'d': distance, 'c': chunk_index}).c AS chunk_index, min(distance) AS distance FROM islands GROUP BY 1, 2, 3) g
        JOIN chunks x ON x.document_id = g.document_id AND x.version = g.version AND x.chunk_index BETWEEN g.first AND g.last GROUP BY ALL""",
}


@query(with_tables("""SELECT document_id, rank, chunk_index AS shown_index, coalesce((SELECT string_agg(x.content, chr(10) || chr(10) ORDER BY x.chunk_index) FROM num x WHERE x.document_id = d.document_id AND x.version = d.version AND x.chunk_index BETWEEN excerpt_index - 1 AND excerpt_index + 1),
    (SELECT string_agg(x.content, chr(10) || chr(10) ORDER BY x.chunk_index) FROM num x WHERE x.document_id = d.document_id AND x.chunk_index BETWEEN d.chunk_index - 1 AND d.chunk_index + 1)) AS content,
    (SELECT string_agg(x.chunk_index, ',' ORDER BY x.chunk_index) FROM num x WHERE x.document_id = d.document_id AND x.version = d.version AND x.chunk_index BETWEEN coalesce(excerpt_index, d.chunk_index) - 1 AND coalesce(excerpt_index, d.chunk_index) + 1) AS near,
    (SELECT substr(x.content, 1, 300) FROM num x WHERE x.document_id = d.document_id AND x.chunk_index = d.chunk_index AND x.content LIKE 'ADR-1 %' AND abs(x.chunk_index - coalesce(excerpt_index, d.chunk_index)) <= 1) AS preview FROM direct d LEFT JOIN excerpt USING (document_id, version)""", **NEAREST))
def search_output(c):
    """What a search for one numbered decision shows of its hits."""
    numbered = Numbered(c.spark, c.sf_dir)
    hits, _ = passages.hits_and_passages(numbered, Request("user1", text="ADR-1 in Title 3"), c.query_vector)
    return hits.select("document_id", "rank", "shown_index", "content", F.array_join(F.transform("near", lambda x: x["chunk_index"].cast("string")), ",").alias("near"), "preview")


@query(with_tables("SELECT document_id, version, chunk_index, first, last, content, round(1 - distance, 6) AS score, focus_from, focus_to, row_number() OVER (PARTITION BY document_id, version ORDER BY distance, chunk_index) AS place FROM merged", **NEAREST))
def passage_merge(c):
    return passages.merged_passages(c.chunks, _found(c))


ITEMS = """SELECT row_number() OVER (ORDER BY d.rank, m.distance, m.chunk_index) AS n, m.document_id, m.chunk_index, m.version, m.content, length(m.content) AS size, trim(m.content, E' \\n\\t\\r\\f\\v') AS whole,
    focus_from + length(f) - length(ltrim(f, E' \\n\\t\\r\\f\\v')) AS b, focus_from + length(rtrim(f, E' \\n\\t\\r\\f\\v')) AS e, v.current FROM (SELECT *, substr(content, focus_from + 1, focus_to - focus_from) AS f FROM merged) m JOIN direct d USING (document_id, version)
    JOIN (SELECT docs.id, coalesce(max(w.version), 1) AS current FROM docs LEFT JOIN versions w ON w.document_id = docs.id GROUP BY 1) v ON v.id = m.document_id"""
PASS_ONE = """WITH RECURSIVE one AS (SELECT 0 AS n, CAST(4000 AS BIGINT) AS room, CAST([] AS VARCHAR[]) AS seen, false AS took, CAST(0 AS BIGINT) AS used
    UNION ALL SELECT n, room - CASE WHEN took THEN used ELSE 0 END, CASE WHEN took THEN list_append(seen, whole) ELSE seen END, took, used FROM (SELECT i.n, o.room, o.seen, i.whole, least(i.e - i.b, o.room) AS used,
        o.room > 0 AND i.whole <> '' AND NOT list_contains(o.seen, i.whole) AND NOT (i.e - i.b > o.room AND len(o.seen) > 0) AS took FROM one o JOIN items i ON i.n = o.n + 1))
    SELECT n, used, room, row_number() OVER (ORDER BY n) AS k FROM one WHERE took"""
PASS_TWO = """WITH RECURSIVE two AS (SELECT CAST(0 AS BIGINT) AS k, (SELECT min(room) FROM first_pass) AS room, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS e
    UNION ALL SELECT k, room - CASE WHEN room > 0 THEN (e2 - b2) - used ELSE 0 END, CASE WHEN room > 0 THEN b2 ELSE b END, CASE WHEN room > 0 THEN e2 ELSE b + used END FROM (SELECT *, CASE WHEN e - b >= lim THEN b ELSE least(greatest(0, b - (least(lim, size) - (e - b)) // 2), size - least(lim, size)) END AS b2,
        CASE WHEN e - b >= lim THEN b + lim ELSE least(greatest(0, b - (least(lim, size) - (e - b)) // 2), size - least(lim, size)) + least(lim, size) END AS e2 FROM (SELECT f.k, t.room, f.used, i.b, i.e, i.size, f.used + t.room AS lim FROM two t JOIN first_pass f ON f.k = t.k + 1 JOIN items i ON i.n = f.n)))
    SELECT * FROM two WHERE k > 0"""


@query(with_tables("""SELECT row_number() OVER (ORDER BY k) AS label, document_id, chunk_index, version AS based_on_version, current AS current_version, version < current AS revised, trim(substr(content, t.b + 1, t.e - t.b), E' \n\t\r\f\v') AS content
    FROM second_pass t JOIN first_pass f USING (k) JOIN items i ON i.n = f.n""", **NEAREST, items=ITEMS, first_pass=PASS_ONE, second_pass=PASS_TWO))
def evidence(c):
    """Evidence of 4,000 characters from the passages of a search's hits."""
    hits, found = passages.hits_and_passages(c, Request("user1", text="Title 3"), c.query_vector)
    newest = c.versions.groupBy(F.col("document_id").alias("d")).agg(F.max("version").alias("current_version"))
    rows = found.withColumnRenamed("place", "passage").join(hits.select("document_id", "version", "title", F.col("rank").alias("place")), ["document_id", "version"]).join(newest, F.col("document_id") == F.col("d"), "left")
    rows = rows.select(F.lit(1).alias("query_id"), "place", "passage", "document_id", "title", "chunk_index", F.col("version").alias("based_on_version"), F.coalesce("current_version", F.lit(1)).alias("current_version"), "content", "focus_from", "focus_to")
    return answers.evidence(rows, 4000).select("label", "document_id", "chunk_index", "based_on_version", "current_version", "revised", "content")


#: Every document is asked about: its first words are the answer, which cites some of three sources, the documents before it.
SOURCES = """SELECT d.id AS query_id, l AS label, s.id AS document_id, substr(s.content, 1, 200) || ' ' || (s.id % 13) || '%' AS content, s.id % 2 = 0 AS revised, l = 1 + d.id % 5 OR l = 1 + d.id % 3 AS cited FROM docs d, (SELECT unnest([1, 2, 3]) AS l) JOIN docs s ON s.id = d.id - l"""
ITEMS_ASKED = """SELECT id AS query_id, id % 6 <> 5 AS answerable, CASE id % 10 WHEN 3 THEN 'no_evidence' WHEN 7 THEN 'failed' ELSE 'answered' END AS status, 'x' || (id % 26) || '% [' || (1 + id % 5) || '] [' || (1 + id % 3) || '] ' || substr(content, 1, 50) || CASE WHEN id % 9 = 4 THEN ' 근거 문서에서 찾을 수 없습니다' ELSE '' END AS answer FROM docs"""
HOLDS = "(^|[^0-9.])12%"


@query(with_tables("SELECT query_id, label, document_id, cited FROM sources", sources=SOURCES))
def citations(c):
    """Which sources of an answer it names in brackets."""
    items, sources, _ = _asked(c)
    return answers.cited(items.select("query_id", "answer"), sources.drop("cited")).select("query_id", "label", "document_id", "cited")


def _asked(c):
    i = F.col("id")
    refusal = F.when(i % 9 == 4, F.lit(" " + answers.REFUSAL)).otherwise("")
    answer = F.concat(F.lit("x"), i % 26, F.lit("% ["), 1 + i % 5, F.lit("] ["), 1 + i % 3, F.lit("] "), F.substring("content", 1, 50), refusal)
    status = F.when(i % 10 == 3, "no_evidence").when(i % 10 == 7, "failed").otherwise("answered")
    items = c.documents.select(i.alias("query_id"), (i % 6 != 5).alias("answerable"), status.alias("status"), answer.alias("answer"), F.array(F.lit("12 %")).alias("keys"), F.array(F.lit("4 %")).alias("absent"))
    labels = c.documents.select(i.alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("label")).withColumn("document_id", F.col("query_id") - F.col("label"))
    text = c.documents.select(i.alias("document_id"), F.concat(F.substring("content", 1, 200), F.lit(" "), i % 13, F.lit("%")).alias("content"), (i % 2 == 0).alias("revised"))
    sources = answers.cited(items.select("query_id", "answer"), labels.join(text, "document_id"))
    return items, sources, c.documents.where("id % 4 <> 1").select(i.alias("query_id"), (i - 2).alias("document_id"))


@query(with_tables(f"""SELECT count(*) AS queries, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable) AS key_graded, count(*) FILTER (answerable AND hit) AS key_hits, count(*) FILTER (answerable AND given) AS keys_in_sources, count(*) FILTER (answerable AND given AND NOT hit) AS model_misses,
    count(*) FILTER (answerable AND asked AND rel) AS given_relevant, count(*) FILTER (answerable AND asked AND crel) AS cited_relevant, count(*) FILTER (answerable AND refused AND NOT hit) AS false_refusals, count(*) FILTER (NOT answerable) AS no_answer, count(*) FILTER (NOT answerable AND refused) AS correct_refusals, count(*) FILTER (leak) AS leaks
    FROM (SELECT i.*, regexp_matches(regexp_replace(answer, '\\s+', ' ', 'g'), '{HOLDS}') AS hit, regexp_matches(regexp_replace(answer, '\\s+', ' ', 'g'), '(^|[^0-9.])4\\s?%') AS leak, status = 'no_evidence' OR answer LIKE '%근거 문서에서 찾을 수 없습니다%' AS refused, query_id % 4 <> 1 AS asked,
        coalesce((SELECT bool_or(regexp_matches(regexp_replace(s.content, '\\s+', ' ', 'g'), '(^|[^0-9.])12\\s?%')) FROM sources s WHERE s.query_id = i.query_id), false) AS given, EXISTS (SELECT 1 FROM sources s WHERE s.query_id = i.query_id AND s.label = 2) AS rel,
        EXISTS (SELECT 1 FROM sources s WHERE s.query_id = i.query_id AND s.label = 2 AND s.cited) AS crel FROM asked i)""", sources=SOURCES, asked=ITEMS_ASKED))
def answer_grading(c):
    """Answers against their keys, sources and relevant documents."""
    return answers.summary(answers.grade(*_asked(c)))


@query(with_tables("""SELECT query, 1 AS required, CAST(in_top AND rank = 1 AND e AS BIGINT) AS first_excerpt, CAST(in_top AND has AND p AS BIGINT) AS top_passages, CASE WHEN NOT kept THEN 'extraction' WHEN NOT (in_top AND (e OR (has AND p))) THEN 'candidates' WHEN NOT e THEN 'selection' ELSE 'complete' END AS cause FROM (
    SELECT id AS query, 1 + id % 7 AS rank, 1 + id % 7 <= 5 AS in_top, id % 4 <> 1 AS has, contains(trim(regexp_replace(substr(content, 1, CASE WHEN id % 2 = 0 THEN 50 ELSE 120 END), '\\s+', ' ', 'g')), t) AS e, contains(trim(regexp_replace(substr(content, 1, 90), '\\s+', ' ', 'g')), t) AS p,
    (SELECT bool_or(contains(trim(regexp_replace(s.content, '\\s+', ' ', 'g')), t)) FROM docs s WHERE s.title = d.title) AS kept FROM (SELECT *, trim(regexp_replace(CASE WHEN id % 11 = 4 THEN 'no such sentence' ELSE substr(content, 20, 40) END, '\\s+', ' ', 'g')) AS t FROM docs) d)"""))
def evidence_causes(c):
    """Where a sentence of each document gets lost on its way into what a search shows: hits and passages are beginnings of texts of different lengths."""
    i = F.col("id")
    rank = (1 + i % 7).alias("rank")
    wanted = c.documents.select(i.alias("query"), F.col("title").alias("source"), F.when(i % 11 == 4, "no such sentence").otherwise(F.substring("content", 20, 40)).alias("text"))
    hits = c.documents.select(i.alias("query"), rank, "title", F.substring(F.col("content"), F.lit(1), F.when(i % 2 == 0, 50).otherwise(120)).alias("content"))
    parts = c.documents.where("id % 4 <> 1").select(i.alias("query"), rank, "title", F.substring("content", 1, 90).alias("content"))
    return passages.evidence_grades(wanted, hits, parts, c.documents.select("title", "content"))


@query(with_tables("SELECT p.document_id, v AS file_version, CASE WHEN t IS NULL THEN NULL WHEN t = d.version THEN d.content ELSE (SELECT w.content FROM versions w WHERE w.document_id = p.document_id AND w.version = t) END AS content FROM (SELECT id AS document_id, unnest([1, 2]) AS v, CASE WHEN id % 3 <> 0 THEN 1 + id % 4 END AS t FROM docs WHERE id % 5 <> 2) p JOIN docs d ON d.id = p.document_id"))
def pending_previews(c):
    """Waiting previews with the text of their own version; versions are turns of conversations."""
    i = F.col("id")
    waiting = c.documents.where("id % 5 <> 2").select(i.alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("file_version"), F.when(i % 3 != 0, 1 + i % 4).alias("text_version"), F.lit("pending").alias("status"))
    return extraction.preview_texts(waiting, c.documents, c.versions)


@query(with_tables("SELECT c_custkey AS token_id, 'user' || (c_custkey % 7) AS owner, c_nationkey % 3 = 0 AS expired FROM customer WHERE c_mktsegment <> 'BUILDING'"))
def valid_tokens(c):
    """Tokens with their state: those of one segment are revoked, and a third have run out by now."""
    now = F.to_timestamp(F.lit("2024-01-01"))
    tokens = c.table("customer").select(F.col("c_custkey").alias("token_id"), F.concat(F.lit("user"), F.col("c_custkey") % 7).alias("owner"), F.when(F.col("c_nationkey") % 3 == 0, now - F.expr("interval 1 day")).otherwise(now + F.expr("interval 1 day")).alias("expires_at"), (F.col("c_mktsegment") == "BUILDING").alias("revoked"))
    return tokens.where("not revoked").select("token_id", "owner", (F.col("expires_at") <= now).alias("expired"))


@query(with_tables("SELECT id, title, owner_id, folder_id FROM docs JOIN vis USING (id) WHERE extraction_status = 'done' AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.document_id = docs.id)"))
def documents_without_versions(c):
    seen = c.documents.where("extraction_status = 'done'").join(visibility.visible_documents(c, "user1"), "id", "left_semi")
    return seen.join(c.versions.select(F.col("document_id").alias("id")), "id", "left_anti").select("id", "title", "owner_id", "folder_id")


@query(with_tables("SELECT kind, status, count(*) AS jobs, max(attempts) AS most_attempts FROM jobs GROUP BY 1, 2"))
def job_counts(c):
    return c.jobs.groupBy("kind", "status").agg(F.count("*").alias("jobs"), F.max("attempts").alias("most_attempts"))
