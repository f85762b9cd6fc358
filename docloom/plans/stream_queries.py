"""Queries whose work a stream does: the rows that it has written once all given files are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.plans.corpus import with_tables
from docloom.plans.registry import query
from docloom.session import shared_folder
from docloom.streaming import changes

STREAMED = "SELECT conv_id AS id, turn + 1 AS version, text || ' [[Title ' || ((conv_id * 7 + turn) % 50) || ']] [[a/Title 1|x]]' AS content, 'Title ' || ((conv_id * 7 + turn) % 50) AS target FROM conversations"


@query(with_tables("""SELECT id AS document_id, 'version' AS what, version, sha256(content) AS key FROM streamed WHERE id % 3 <> 0 OR version > 1
    UNION ALL SELECT id, 'job', NULL, 'embed' FROM streamed WHERE id % 3 <> 0 OR version > 1 GROUP BY 1
    UNION ALL SELECT DISTINCT id, 'link', NULL, unnest([target, 'Title 1']) FROM (SELECT * FROM streamed QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE id % 3 <> 0 OR version > 1
    UNION ALL SELECT DISTINCT id, 'link', NULL, unnest(['Title 49']) FROM (SELECT id, max(version) AS version FROM streamed GROUP BY 1) WHERE id % 3 = 0 AND version = 1""", streamed=STREAMED))
def stream_changes(c):
    """The turns of a conversation are versions of a document; first versions of some documents and a link of theirs are stored before the stream begins."""
    spark = c.spark
    path, turns = f"{c.sf_dir}/conversations.parque[t]", c.table("conversations")  # a pattern, as a stream does not take the path of one file
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", changes.ROCKS)
    text = F.concat("text", F.lit(" [[Title "), ((F.col("conv_id") * 7 + F.col("turn")) % 50).cast("string"), F.lit("]] [[a/Title 1|x]]"))
    version = (F.col("turn") + 1).cast("int").alias("version")
    snapshots = lambda t: t.select(F.col("conv_id").alias("id"), version, text.alias("content"), F.sha2(F.encode(text, "UTF-8"), 256).alias("content_hash"), F.lit("done").alias("extraction_status"), F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60).alias("at"))
    first = snapshots(turns).where("id % 3 = 0 and version = 1").select(F.col("id").alias("document_id"), "version", "content_hash")
    links = first.select("document_id", F.lit("Title 49").alias("target"))
    folder = f"{shared_folder(spark)}/docloom-stream-{uuid.uuid4().hex}"
    stream = changes.events(snapshots(spark.readStream.schema(turns.schema).parquet(path)))
    changes.start(stream, f"{folder}/out", f"{folder}/checkpoint", changes.stored_state(first, links=links)).awaitTermination()
    rows = changes.written(spark, f"{folder}/out")
    added = rows.where("what in ('version', 'job')").select("document_id", "what", F.when(F.col("what") == "version", F.col("version").cast("long")).alias("version"), F.coalesce("kind", "content_hash").alias("key"))
    now = changes.links_now(rows, links)
    return added.unionByName(now.select("document_id", F.lit("link").alias("what"), F.lit(None).cast("long").alias("version"), F.col("target").alias("key")))
