"""The document list: optional filters, orders, pages with totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators import visibility


@dataclass(frozen=True)
class Filters:
    embedding_status: str | None = None
    extraction_status: str | None = None
    tag: str | None = None
    title: str | None = None
    content_type: str | None = None
    folder_id: str | None = None
    owned: bool = False
    unfiled: bool = False
    granted: bool = False


def listed(corpus, principal: str, f: Filters) -> DataFrame:
    """Visible documents that pass the filters; the title is sought as literal text whatever its case, granted ones are others' private documents."""
    docs = corpus.documents.join(visibility.visible_documents(corpus, principal), "id", "left_semi")
    for name in ("embedding_status", "extraction_status", "content_type", "folder_id"):
        if getattr(f, name) is not None:
            docs = docs.where(F.col(name) == getattr(f, name))
    if f.tag is not None:
        docs = docs.where(F.array_contains("tags", f.tag))
    if f.title is not None and f.title.strip():
        docs = docs.where(F.contains(F.lower("title"), F.lower(F.lit(f.title.strip()))))
    if f.folder_id is not None:
        docs = docs.join(visibility.visible_folders(corpus, principal), "folder_id", "left_semi")
    if f.owned:
        docs = docs.where(F.col("owner_id") == principal)
    if f.unfiled:
        docs = docs.where("folder_id is null")
    if f.granted:
        private = visibility.effective_visibility(corpus).where("effective_visibility = 'private'").select("id")
        docs = docs.where(F.col("owner_id") != principal).join(private, "id", "left_semi")
    return docs


def page(rows: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows with the total of all beside each; the total is an aggregate of its own, so that no window holds all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def natural_key(name: str) -> Column:
    """A key that sorts the numbers in names by value: digit runs are led by their length without leading zeros."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 4, "0"), bare(x))).otherwise(x)), "")
