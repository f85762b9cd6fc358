"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, with
n_chars set to the length of the text as it then is. A stage only sees what the one before kept.

Null and empty texts are documents like any other and go with what the classifier says of an empty text; null ids stay what they are and are
dropped by no stage that compares documents. Rows that repeat an id are told apart by their texts, equal rows are repeated documents. Very
long texts are read whole by each stage. Ties (equal scores, copies) are settled by the smaller id. Further columns, whatever their names, come
through all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import lines, packing, quality, simhash, substring
from docloom.llm.common import free_name, materialize

#: SQL has no factorisation machine; tests hold the stages' operators against brute force, and the stages on planted documents.
ORACLE_SQL = None


def _as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*(F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in like.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(lines.dedup(docs), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays. Rows are told apart by id and text, so that another text of a dropped id stays."""
    row, of = free_name(docs, "text_hash"), free_name(docs, "dropped")
    dropped = simhash.near_duplicates(docs, row=row).where("doc_id <> component_id").select(F.col("doc_id").alias(of), row)
    return docs.join(dropped, (docs.doc_id == dropped[of]) & (F.xxhash64(docs.text) == dropped[row]), "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(substring.dedup(docs), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
