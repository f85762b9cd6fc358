"""Closure of folders and visibility on hand-made tables."""

from __future__ import annotations

import pytest

from docloom.operators import analytics, visibility
from docloom.plans.corpus import Corpus


class Tables:
    def __init__(self, spark, folders):
        self.spark = spark
        self.folders = spark.createDataFrame(folders, "id string, parent_id string, visibility string, created_by string")
        self.members = spark.createDataFrame([("ann", "g")], "user_id string, group_id string")
        self.folder_grants = spark.createDataFrame([("p2", None, "g")], "folder_id string, user_id string, group_id string")
        self.share_folders = spark.createDataFrame([("share:1", "m")], "share_id string, folder_id string")
        docs = [(1, "bob", "private", "leaf", True, None), (2, "bob", "public", "p1", True, None), (3, "bob", "private", None, True, None), (4, "ann", "private", None, False, None), (5, "ann", "private", None, False, "2024"), (6, "bob", "public", "p1", False, None), (7, "bob", "private", "p1", False, None), (8, "bob", "private", "p2", True, None)]
        self.documents = spark.createDataFrame(docs, "id long, owner_id string, visibility string, folder_id string, follows_folder boolean, deleted_at string")
        self.document_grants = spark.createDataFrame([(7, "ann", None, None), (3, None, None, "share:1"), (2, "ann", None, None)], "document_id long, user_id string, group_id string, share_id string")


CHAIN = [("r", None, "public", "x"), ("m", "r", None, "x"), ("leaf", "m", None, "x"), ("p1", None, "private", "x"), ("p2", None, "private", "x")]


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_who_sees_what(spark):
    t = Tables(spark, CHAIN)
    assert ids(visibility.visible_folders(t, None)) == ["leaf", "m", "r"]
    assert ids(visibility.visible_folders(t, "ann")) == ["leaf", "m", "p2", "r"] and ids(visibility.visible_folders(t, "x")) == ["leaf", "m", "p1", "p2", "r"]
    assert ids(visibility.visible_folders(t, "share:1")) == ["leaf", "m"]
    assert ids(visibility.visible_documents(t, None)) == [1, 6]
    assert ids(visibility.visible_documents(t, "ann")) == [1, 4, 6, 7, 8]
    assert ids(visibility.visible_documents(t, "bob")) == [1, 2, 3, 6, 7, 8]
    assert ids(visibility.visible_documents(t, "share:1")) == [1, 3]


def test_closure(spark):
    got = {(r.folder_id, r.ancestor_id): r.depth for r in visibility.closure(Tables(spark, CHAIN)).collect()}
    assert got == {("r", "r"): 0, ("m", "m"): 0, ("m", "r"): 1, ("leaf", "leaf"): 0, ("leaf", "m"): 1, ("leaf", "r"): 2, ("p1", "p1"): 0, ("p2", "p2"): 0}


def test_a_circle_raises(spark):
    with pytest.raises(Exception, match="(?i)recursion"):
        visibility.closure(Tables(spark, [*CHAIN, ("a", "b", None, "x"), ("b", "a", None, "x")])).collect()


def test_asking_for_hidden_documents(spark):
    t = Tables(spark, CHAIN)
    asked = lambda *n: spark.createDataFrame([(i,) for i in n], "id long")
    assert ids(visibility.ensure_visible(t, "ann", asked(1, 4))) == [1, 4]
    for hidden in (2, 5, 99):
        with pytest.raises(visibility.NotVisible):
            visibility.ensure_visible(t, "ann", asked(1, hidden))


def test_hashes_are_made_before_texts_meet_the_visible(spark, small):
    """Below the hash stands the table, and no join that texts would be shuffled for."""
    plan = analytics.identical(Corpus(spark, small), "user1")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    hashed = [n for n, line in enumerate(plan) if "sha2(" in line and "Project" in line]
    assert hashed
    for n in hashed:
        table = next(m for m in range(n, len(plan)) if "Relation" in plan[m])
        assert not any("Join" in line for line in plan[n:table])


def tables_read(df):
    """The first columns of the tables that a plan reads, from the inside out."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line.split("Relation [")[1].split("#")[0] for line in plan.split("\n") if "Relation [" in line]


@pytest.mark.parametrize("ask", [analytics.unfiled_suggestions, analytics.suggest_folders, analytics.orphans, analytics.duplicates])
def test_visibility_is_worked_out_once(spark, small, ask):
    """Not anew, with the grants of all orders, in each place that reads it."""
    edges = spark.createDataFrame([], "src long, dst long, kind string, src_chunk long, dst_chunk long, score double")
    read = tables_read(ask(Corpus(spark, small), edges, "user1"))
    assert "doc_id" in read and "o_orderkey" not in read


def test_orders_meet_documents_before_customers(spark, small):
    assert tables_read(Corpus(spark, small).document_grants) == ["o_orderkey", "doc_id", "c_custkey"]
