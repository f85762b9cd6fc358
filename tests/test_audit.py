"""Audit rows between snapshots, and questions to the log."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docloom.operators import audit

DOCS = "id long, title string, visibility string, follows_folder boolean, folder_id string, folder_name string, deleted_at timestamp, owner_id string"
GRANTS = "document_id long, user_id string, group_id string"


def told(df):
    return sorted((r.action, r.document_id, r.document_title, json.dumps(json.loads(r.detail))) for r in df.collect())


def test_rows_of_documents_and_grants(spark):
    before = spark.createDataFrame([(1, "old", "public", True, "a", "A", None, "u"), (2, "gone", "public", True, None, None, None, "u"), (3, "t", "public", False, "a", "A", None, "u")], DOCS)
    after = spark.createDataFrame([(1, "new", "private", True, None, None, None, "v"), (3, "t", "public", False, "b", "B", None, "u"), (4, "n", "public", False, None, None, None, "u")], DOCS)
    g0 = spark.createDataFrame([(1, "u", None), (2, "u", None), (3, None, "g")], GRANTS)
    g1 = spark.createDataFrame([(1, None, "g"), (3, None, "g")], GRANTS)
    got = told(audit.derive({"documents": before, "grants": g0}, {"documents": after, "grants": g1}))
    assert got == sorted([
        ("access_changed", 1, "new", '{"kind": "visibility", "before": "public", "after": "private"}'), ("access_changed", 1, "new", '{"kind": "folder", "before": "A", "after": null}'),
        ("owner_changed", 1, "new", '{"kind": "document", "before": "u", "after": "v"}'), ("document_deleted", 2, "gone", "{}"), ("document_created", 4, "n", "{}"),
        ("access_changed", 1, "new", '{"kind": "grant", "change": "removed", "grantee_type": "user", "grantee": "u"}'), ("access_changed", 1, "new", '{"kind": "grant", "change": "added", "grantee_type": "group", "grantee": "g"}'),
    ])


def test_equal_snapshots_tell_nothing(spark):
    docs = spark.createDataFrame([(1, "t", None, None, None, None, None, None)], DOCS)
    grants = spark.createDataFrame([(1, None, None)], GRANTS)
    assert audit.derive({"documents": docs, "grants": grants}, {"documents": docs, "grants": grants}).collect() == []


def test_every_rule_names_columns_that_its_table_has():
    for watched in audit.RULES.values():
        known = {*watched.key, *watched.columns}
        assert all(r.when in ("added", "removed") or r.when in known for r in watched.rules)
        assert watched.document is None or watched.document in known


def test_filters_escape_what_is_looked_for(spark):
    rows = [(1, "a", "access_changed", "50% off", "{}"), (2, "b", "access_changed", "50 off", "{}"), (3, "a", "folder_changed", None, '{"folder_name": "x_50%"}'), (4, "a", "folder_changed", None, "broken")]
    log = spark.createDataFrame(rows, "id long, actor string, action string, document_title string, detail string").withColumn("occurred_at", F.timestamp_seconds("id"))
    ids = lambda **more: [r.id for r in audit.newest(audit.entries(log, **more)).collect()]
    assert ids(q="50%") == [3, 1] and ids(q="X_5") == [3] and ids(actor="a", before_id=4) == [3, 1]
    assert ids(action="folder_changed", since=F.timestamp_seconds(F.lit(4))) == [4] and ids() == [4, 3, 2, 1]


def test_private_entries_are_for_owners(spark):
    log = spark.createDataFrame([(i, d, a) for i, (d, a) in enumerate([(1, "text_updated"), (1, "share_changed"), (2, "share_changed"), (2, "owner_changed"), (2, "group_changed"), (3, "text_updated")])], "id long, document_id long, action string")
    docs = spark.createDataFrame([(1, True), (2, False)], "id long, owner boolean")
    assert [(r.id, r.place) for r in audit.activity(log, docs).orderBy("id").collect()] == [(0, 2), (1, 1), (3, 1)]
