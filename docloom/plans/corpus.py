"""Canonical tables of the document engine, derived by arithmetic from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph, vectors, visibility
from docloom.sources.store import Kept, stored

SHARE = "share:1"


class Corpus:
    """Lazy tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its files are listed and its schema is read once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def documents(self) -> DataFrame:
        i = F.col("doc_id")
        number = lambda n: (i % n).cast("string")
        stamp = F.timestamp_seconds(F.lit(1704067200) + i * 60)
        return self.table("documents").select(
            i.alias("id"),
            F.concat(F.lit("Title "), F.floor(i / 2).cast("string")).alias("title"),
            F.col("text").alias("content"),
            F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"),
            F.lit(1).alias("version"),
            F.concat(F.lit("user"), number(7)).alias("owner_id"),
            F.when(i % 5 == 0, "private").otherwise("public").alias("visibility"),
            F.when(i % 2 == 1, "md").when(i % 16 == 0, "docx").when(i % 16 == 2, "xlsx").when(i % 16 == 4, "hwpx").otherwise("txt").alias("content_type"),
            F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source", F.concat(F.lit("group-"), number(10)))).alias("tags"),
            F.when(i % 37 == 0, stamp).alias("deleted_at"),
            F.when(i % 3 != 0, F.concat(F.lit("n"), number(25))).alias("folder_id"),
            (i % 4 != 0).alias("follows_folder"),
            F.when(i % 41 == 0, "failed").when(i % 41 == 1, "pending").otherwise("done").alias("extraction_status"),
            F.when(i % 13 == 0, "pending").otherwise("ready").alias("embedding_status"),
            stamp.alias("created_at"),
        )

    @cached_property
    def linked_text(self) -> DataFrame:
        """(id, content) with wikilinks put at the end of the text by id."""
        i = F.col("id")
        other = F.concat(F.lit("Title "), ((i * 7 + 3) % 500).cast("string"))
        tail = (
            F.when(i % 6 == 0, F.concat(F.lit(" [["), other, F.lit("]]")))
            .when(i % 6 == 1, F.concat(F.lit(" [[a/"), other, F.lit("|x]] [["), other, F.lit("]]")))
            .when(i % 6 == 2, F.concat(F.lit(" ![["), other, F.lit("]]")))
            .when(i % 6 == 3, F.concat(F.lit(" [["), other, F.lit(".png]] [["), other, F.lit("#part]]")))
            .when(i % 6 == 4, F.concat(F.lit(' [["x"]] [['), other, F.lit("\\|y]]")))
            .otherwise("")
        )
        return self.documents.select("id", F.concat("content", tail).alias("content"))

    @cached_property
    def folders(self) -> DataFrame:
        root, leaf = F.col("r_regionkey"), F.col("n_nationkey")
        roots = self.table("region").select(
            F.concat(F.lit("r"), root).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"),
            F.concat(F.lit("user"), root % 7).alias("created_by"), F.when(root % 2 == 0, "public").otherwise("private").alias("visibility"),
        )
        return roots.unionByName(self.table("nation").select(
            F.concat(F.lit("n"), leaf).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"),
            F.concat(F.lit("user"), leaf % 7).alias("created_by"), F.lit(None).cast("string").alias("visibility"),
        ))

    @cached_property
    def kept_closure(self) -> Kept:
        """Every folder with all above it, worked out once for each state of the folders' tables."""
        return stored("closure", "folder_id", [self.table("region"), self.table("nation")], lambda: visibility.ancestors(self.folders), visibility, buckets=1)

    @cached_property
    def members(self) -> DataFrame:
        """(user_id, group_id); users are user0 to user6, groups the market segments."""
        groups = self.table("customer").select(F.col("c_mktsegment").alias("group_id")).distinct()
        users = groups.select("group_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("u"))
        return users.where((F.ascii("group_id") + F.col("u")) % 3 == 0).select(F.concat(F.lit("user"), "u").alias("user_id"), "group_id")

    @cached_property
    def document_grants(self) -> DataFrame:
        """An order grants the document of its number to a user, or to the customer's segment.

        Most orders have no document; they are dropped before the rest meets the customers.
        """
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_mktsegment")
        own = o.join(self.documents.select("id"), F.col("o_orderkey") == F.col("id")).join(c, o.o_custkey == c.c_custkey)
        to_user = F.col("o_orderkey") % 2 == 0
        user = F.when(to_user, F.concat(F.lit("user"), F.col("o_custkey") % 7))
        return own.select(F.col("id").alias("document_id"), user.alias("user_id"), F.when(~to_user, F.col("c_mktsegment")).alias("group_id"), F.when(F.col("id") % 50 == 7, SHARE).alias("share_id")).distinct()

    @cached_property
    def folder_grants(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.table("region").select(F.concat(F.lit("r"), k).alias("folder_id"), F.when(k != 3, F.concat(F.lit("user"), (k * 2) % 7)).alias("user_id"), F.when(k == 3, "BUILDING").alias("group_id"))

    @cached_property
    def share_folders(self) -> DataFrame:
        return self.folders.where("id = 'r1'").select(F.lit(SHARE).alias("share_id"), F.col("id").alias("folder_id"))

    @cached_property
    def chunks(self) -> DataFrame:
        v = self.table("embeddings")
        docs = v.agg((F.floor(F.max("vec_id") / 5) + 1).alias("n"))
        whole = F.transform("embedding", lambda x: x.cast("double"))
        own = v.select(F.floor(F.col("vec_id") / 5).alias("document_id"), (F.col("vec_id") % 5).alias("chunk_index"), whole.alias("embedding"))
        twin = own.where("document_id % 10 = 0").crossJoin(F.broadcast(docs)).select((F.col("n") + F.floor(F.col("document_id") / 10)).alias("document_id"), "chunk_index", "embedding")
        text = self.table("documents").select(F.col("doc_id").alias("document_id"), "text")
        both = own.unionByName(twin).join(text, "document_id")
        return both.select("document_id", (1 + F.col("document_id") % 3).alias("version"), "chunk_index", F.expr("substr(text, cast(1 + 200 * chunk_index as int), 200)").alias("content"), "embedding")

    @cached_property
    def kept_edges(self) -> Kept:
        """The similarity graph of the chunks, built once for each state of their tables and of the code that builds it."""
        return stored("edges", "src", [self.table("embeddings"), self.table("documents")], lambda: graph.build_edges(self.chunks), graph, vectors)

    @cached_property
    def edges(self) -> DataFrame:
        return self.kept_edges.read()

    @cached_property
    def versions(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("version"), F.col("text").alias("content"), F.col("role").alias("author_via"))

    @cached_property
    def audit_log(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(e.alias("id"), F.col("ts").alias("occurred_at"), F.concat(F.lit("user"), F.col("user_id") % 7).alias("actor"), F.col("event_type").alias("action"), (e % 200).alias("document_id"), F.col("props").alias("detail"), "value")

    @cached_property
    def jobs(self) -> DataFrame:
        n = F.col("l_linenumber")
        kind = F.when(n % 3 == 0, "preview").when(n % 3 == 1, "embed").otherwise("edges")
        status = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "done").when(F.col("l_linestatus") == "O", "pending").otherwise("processing")
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("document_id"), kind.alias("kind"), status.alias("status"),
            (F.col("l_quantity").cast("int") % 4).alias("attempts"), F.col("l_shipdate").alias("next_attempt_at"), F.when(status == "processing", F.col("l_shipdate")).alias("lease_expires_at"),
        )

    @cached_property
    def query_vector(self) -> DataFrame:
        return self.table("embeddings").where("vec_id = 7").select(F.transform("embedding", lambda x: x.cast("double")).alias("q"))


#: The same tables for the SQL that results are held against.
CTES = {
    "docs": """SELECT doc_id AS id, 'Title ' || (doc_id // 2) AS title, text AS content, sha256(text) AS content_hash, 1 AS version, 'user' || (doc_id % 7) AS owner_id,
        CASE WHEN doc_id % 5 = 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN doc_id % 2 = 1 THEN 'md' WHEN doc_id % 16 = 0 THEN 'docx' WHEN doc_id % 16 = 2 THEN 'xlsx' WHEN doc_id % 16 = 4 THEN 'hwpx' ELSE 'txt' END AS content_type,
        CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source, 'group-' || (doc_id % 10)] END AS tags,
        CASE WHEN doc_id % 37 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS deleted_at,
        CASE WHEN doc_id % 3 <> 0 THEN 'n' || (doc_id % 25) END AS folder_id, doc_id % 4 <> 0 AS follows_folder,
        CASE doc_id % 41 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS extraction_status,
        CASE WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'ready' END AS embedding_status, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents""",
    "linked": """SELECT id, content || CASE id % 6 WHEN 0 THEN ' [[' || o || ']]' WHEN 1 THEN ' [[a/' || o || '|x]] [[' || o || ']]' WHEN 2 THEN ' ![[' || o || ']]'
        WHEN 3 THEN ' [[' || o || '.png]] [[' || o || '#part]]' WHEN 4 THEN ' [["x"]] [[' || o || '\\|y]]' ELSE '' END AS content
        FROM (SELECT id, content, 'Title ' || ((id * 7 + 3) % 500) AS o FROM docs)""",
    "folders": """SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 'user' || (r_regionkey % 7) AS created_by,
        CASE WHEN r_regionkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'user' || (n_nationkey % 7), NULL FROM nation""",
    "closure": """SELECT id AS folder_id, id AS ancestor_id, 0 AS depth FROM folders UNION ALL SELECT id, parent_id, 1 FROM folders WHERE parent_id IS NOT NULL""",
    "members": """SELECT 'user' || u AS user_id, g AS group_id FROM (SELECT DISTINCT c_mktsegment AS g FROM customer), (SELECT unnest(range(7)) AS u) WHERE (ascii(g) + u) % 3 = 0""",
    "document_grants": """SELECT DISTINCT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'user' || (o_custkey % 7) END AS user_id,
        CASE WHEN o_orderkey % 2 <> 0 THEN c_mktsegment END AS group_id, CASE WHEN o_orderkey % 50 = 7 THEN 'share:1' END AS share_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN docs ON docs.id = o_orderkey""",
    "folder_grants": """SELECT 'r' || r_regionkey AS folder_id, CASE WHEN r_regionkey <> 3 THEN 'user' || (r_regionkey * 2 % 7) END AS user_id, CASE WHEN r_regionkey = 3 THEN 'BUILDING' END AS group_id FROM region""",
    "share_folders": """SELECT 'share:1' AS share_id, id AS folder_id FROM folders WHERE id = 'r1'""",
    "own_chunks": """SELECT vec_id // 5 AS document_id, vec_id % 5 AS chunk_index, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "chunks": """SELECT document_id, 1 + document_id % 3 AS version, chunk_index, substr(text, 1 + 200 * chunk_index, 200) AS content, embedding FROM (SELECT * FROM own_chunks
        UNION ALL SELECT (SELECT max(vec_id) // 5 + 1 FROM embeddings) + document_id // 10, chunk_index, embedding FROM own_chunks WHERE document_id % 10 = 0) JOIN documents ON doc_id = document_id""",
    "versions": """SELECT conv_id AS document_id, turn + 1 AS version, text AS content, role AS author_via FROM conversations""",
    "audit_log": """SELECT event_id AS id, ts AS occurred_at, 'user' || (user_id % 7) AS actor, event_type AS action, event_id % 200 AS document_id, props AS detail, value FROM events""",
    "jobs": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS document_id, CASE l_linenumber % 3 WHEN 0 THEN 'preview' WHEN 1 THEN 'embed' ELSE 'edges' END AS kind,
        CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_returnflag = 'A' THEN 'done' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'processing' END AS status,
        CAST(l_quantity AS INT) % 4 AS attempts, l_shipdate AS next_attempt_at,
        CASE WHEN l_returnflag NOT IN ('R', 'A') AND l_linestatus <> 'O' THEN l_shipdate END AS lease_expires_at FROM lineitem""",
    "qv": """SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7""",
}


def visible_sql(principal: str | None) -> str:
    """SELECT id of the documents that a principal sees."""
    if principal and principal.startswith("share:"):
        return f"""SELECT id FROM docs d WHERE deleted_at IS NULL AND (EXISTS (SELECT 1 FROM document_grants g WHERE g.document_id = d.id AND g.share_id = '{principal}')
            OR EXISTS (SELECT 1 FROM closure c JOIN share_folders s ON s.folder_id = c.ancestor_id WHERE c.folder_id = d.folder_id AND s.share_id = '{principal}'))"""
    u = f"'{principal}'" if principal else "CAST(NULL AS VARCHAR)"
    return f"""SELECT id FROM docs d WHERE deleted_at IS NULL AND (coalesce(owner_id = {u}, false) OR CASE WHEN follows_folder AND folder_id IS NOT NULL
        THEN folder_id IN ({visible_folders_sql(principal)})
        ELSE visibility = 'public' OR EXISTS (SELECT 1 FROM document_grants g WHERE g.document_id = d.id AND (g.user_id = {u} OR g.group_id IN (SELECT group_id FROM members WHERE user_id = {u}))) END)"""


def visible_folders_sql(principal: str | None) -> str:
    if principal and principal.startswith("share:"):
        return f"SELECT c.folder_id FROM closure c JOIN share_folders s ON s.folder_id = c.ancestor_id WHERE s.share_id = '{principal}'"
    u = f"'{principal}'" if principal else "CAST(NULL AS VARCHAR)"
    return f"""SELECT c.folder_id FROM closure c JOIN folders r ON r.id = c.ancestor_id WHERE r.parent_id IS NULL AND (r.visibility = 'public' OR r.created_by = {u}
        OR EXISTS (SELECT 1 FROM folder_grants g WHERE g.folder_id = r.id AND (g.user_id = {u} OR g.group_id IN (SELECT group_id FROM members WHERE user_id = {u}))))"""


def with_tables(body: str, principal: str | None = "user1", **more: str) -> str:
    """body over the canonical tables, vis (documents seen) and visf (folders seen)."""
    ctes = CTES | {"vis": visible_sql(principal), "visf": visible_folders_sql(principal)} | more
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n" + body
