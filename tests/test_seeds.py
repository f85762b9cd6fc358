"""Front matter of seed files."""

from __future__ import annotations

from docloom.sources import seeds


def test_strict_heads(spark):
    files = {
        "good": "---\ntitle: A: b\ntags: x, y ,,\nvisibility: private\n---\n\n# Head\ntext\n", "heading": "---\ntags: x\n---\n# Head of it  \nmore", "windows": "---\r\ntags: x\r\n---\r\n# H\r\nmore", "last": "---\ntitle: one\ntitle: two\ntags: x\n---\ntext",
        "none": "# no head", "key": "---\ntags: x\nauthor: me\n---\nt", "line": "---\ntags: x\nodd\n---\nt", "tags": "---\ntitle: t\n---\nbody", "seen": "---\ntags: x\nvisibility: secret\n---\n# t", "empty": "---\ntags: x\n---\n  \n", "title": "---\ntags: x\n---\nno heading", "null": None,
    }
    out = {r.name: r for r in seeds.seed_documents(spark.createDataFrame(list(files.items()), "name string, text string")).collect()}
    good = {n: (r.title, r.tags, r.visibility) for n, r in out.items() if r.problem is None}
    assert good == {"good": ("A: b", ["x", "y"], "private"), "heading": ("Head of it", ["x"], "public"), "windows": ("H", ["x"], "public"), "last": ("two", ["x"], "public")}
    assert out["good"].content == "# Head\ntext"
    assert {n: r.problem for n, r in out.items() if r.problem} == {"none": "no head", "key": "an unknown key", "line": "a line of the head is not key: value", "tags": "no tags", "seen": "an unknown visibility", "empty": "no text", "title": "no title", "null": "no head"}
    assert all(r.title is None and r.content is None for r in out.values() if r.problem)
