"""Integrity rules and keys on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import analytics, listing, validators, verification


def test_natural_order(spark):
    names = ["image10.png", "image2.png", "image02b.png", "10", "9", "a"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    out = [r.name for r in df.orderBy(listing.natural_key("name"), "name").collect()]
    assert out == ["9", "10", "a", "image2.png", "image02b.png", "image10.png"]


def test_previews_and_outages(spark):
    p = spark.createDataFrame([(1, "ready", "x"), (2, "ready", None), (3, "failed", "x"), (4, "pending", None)], "document_id int, status string, pdf_sha256 string")
    assert sorted(r.document_id for r in validators.preview_violations(p).collect()) == [2, 3]
    o = spark.createDataFrame([(1, 1, 2, 3), (2, 2, 1, 3), (3, 1, 3, 2), (4, 1, 1, 1)], "id int, last_ok_at int, first_failure_at int, recovered_at int")
    assert sorted(r.id for r in validators.outage_violations(o).collect()) == [2, 3]


def test_departments(spark):
    users = spark.createDataFrame([("u1", "g1"), ("u2", "g1"), ("u3", None)], "user_id string, group_id string")
    members = spark.createDataFrame([("u1", "g1")], "user_id string, group_id string")
    folders = spark.createDataFrame([("a", None, "g1"), ("b", None, "g1"), ("c", "a", "g2"), ("d", None, None), ("e", None, None)], "id string, parent_id string, group_id string")
    found = {n: df.count() for n, df in validators.department_violations(users, members, folders).items()}
    assert found == {"department_without_membership": 1, "department_with_folders": 1, "department_folder_below_top": 1}


def test_append_only(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, action string, detail string")
    after = spark.createDataFrame([(1, "a", None), (2, "b", "z"), (4, "d", None)], "id int, action string, detail string")
    assert sorted(r.id for r in validators.changed_rows(before, after).collect()) == [2, 3]


def test_few_clusters_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, analytics.UNCATEGORIZED)], "node int, name string")
    assert {r.node: r.name for r in analytics.fold_clusters(df).collect()} == {1: "a", 2: "b", 3: analytics.UNCATEGORIZED}
    assert {r.node: r.name for r in analytics.fold_clusters(df, 2).collect()} == {1: analytics.OTHER, 2: analytics.OTHER, 3: analytics.UNCATEGORIZED}


def test_recovery_point(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = [("a", "h", 1), ("b", "h", 2), ("c", "h", 3), ("d", "h", 10), ("e", "h", 15), ("f", "h", 20), ("g", "h", 25)]
    up = spark.createDataFrame(rows, "title string, hash string, t int").select("title", "hash", F.timestamp_seconds("t").alias("at"))
    kept = spark.createDataFrame([("a", "h"), ("a", "h"), ("b", "x"), ("d", "h"), ("f", "h")], "title string, hash string")
    out = verification.recovery_point(up, kept, at(10), at(20)).first().asDict()
    assert out == {"must": 3, "lost": 1, "mismatched": 1, "duplicates": 1, "ambiguous": 2, "ambiguous_present": 1, "after": 2, "after_present": 1, "gap_micros": 8_000_000}


def test_outages_and_promotions(spark):
    probes = [(1, True, "a", 1), (2, False, None, None), (3, True, "a", 1), (4, False, None, None), (5, False, None, None), (6, True, "a", 1), (7, True, "b", 2), (8, False, None, None), (9, True, "c", 3), (10, False, None, None)]
    rows = [("x", t, t, ok, node, line) for t, ok, node, line in probes] + [("y", 1, 1, False, None, None), ("y", 2, 2, False, None, None), ("y", 3, 3, True, "a", 1)]
    df = spark.createDataFrame(rows, "k string, at int, id int, ok boolean, node string, timeline int")
    got = [tuple(r) for r in analytics.outage_log(df, "k").orderBy("recovered_at").collect()]
    assert got == [("x", "interruption", 3, 4, 6, "a", "a", 1, 1, 2), ("x", "promotion", 6, 7, 7, "a", "b", 1, 2, 0), ("x", "promotion", 7, 8, 9, "b", "c", 2, 3, 1)]
