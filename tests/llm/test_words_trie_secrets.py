"""Spelling variants, the prefix trie and the secret scan against brute force and on planted rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import prefix_trie, secrets, spelling
from docloom.llm.queries import queries

DOCS = "doc_id long, text string"


# spelling variants

def brute_words(rows, least_size=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_size:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, near):
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def near_by_definition(words):
    return {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}


def near_by_holes(words):
    """Words that are equal after a letter is taken out or replaced by a hole."""
    by = defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
            by[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by.values():
        for w in group:
            near[w] |= group
    return {w: [v for v in near[w] if v != w and one_edit(v, w)] for w in words}


def variants(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_spelling_variants_of_the_table(spark, small):
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    words = brute_words([(r["doc_id"], r["text"]) for r in rows])
    want = brute_variants(words, near_by_holes(words))
    assert len(want) > 1000 and any(r[3] for r in want)
    assert variants(queries()["op11_spelling_variants"](spark, small)) == want


@pytest.mark.parametrize("hot_half", [0, 2, 1000])
def test_near_words_at_any_split(spark, hot_half):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"aaaa", "aaaaa", "aaaaaa", "ababab", "babababa", ""}
    counts = {w: rng.randint(1, 50) for w in words}
    got = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), hot_half).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    near = near_by_definition(counts)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {tuple(sorted((a, b))) for a in near for b in near[a]}
    assert all(counts[r.a] == r.n_a and counts[r.b] == r.n_b for r in got)


def test_spelling_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "House house HOUSE hause hause hause"), (3, "house " * 6), (3, "house " * 6), (4, "ÄPFEL äPFEL äpfel Äpfel" * 3), (5, "x" * 200_000 + " " + "mouse " * 20), (6, "mousse mousse mousse grouse grouse grouse")]
    words = brute_words(rows)
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], DOCS + ", n long, word string")
    assert variants(spelling.spelling_variants(df)) == brute_variants(words, near_by_definition(words))
    assert variants(spelling.spelling_variants(df.limit(0))) == []


# prefix trie

def brute_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows, key=lambda r: r[:2])] for c, rows in own.items()}
    built = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string"


def nodes(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.COLUMNS).collect()), key=lambda r: r[:2])


def test_trie_of_the_table(spark, small):
    rows = pq.read_table(f"{small}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    assert nodes(queries()["op12_prefix_trie"](spark, small)) == brute_trie([tuple(r.values()) for r in rows])


@pytest.mark.parametrize("run_bytes, range_bytes", [(1, 1500), (600, 4000), (1 << 20, 1 << 20)])
def test_trie_over_runs_and_ranges(spark, run_bytes, range_bytes):
    rng = random.Random(5)
    turns = []
    for c in range(-40, 400):
        same = c % 3 == 0  # a third of all conversations is the same
        for t in range(4 if same else rng.randint(0, 12)):
            turns.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {t}" if same else rng.choice(["a", "bé", "", "long " * 20])))
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).repartition(7)
    assert nodes(prefix_trie.prefix_trie(df, run_bytes, range_bytes)) == brute_trie(turns)


def test_trie_edge_rows(spark):
    turns = [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 3, None, None), (7, 1, "user", None), (8, 0, "user", "x" * 300_000), (9, 0, "us", "er"), (11, 0, "u", "ser"), (12, 5, "a", "b"), (5, 0, "q", "base")]
    turns += [(20, t, "user", str(t)) for t in range(3000)]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], TURNS + ", depth long, n_convs long")
    assert nodes(prefix_trie.prefix_trie(df)) == brute_trie(turns)
    assert nodes(prefix_trie.prefix_trie(df.limit(0))) == []
    repeated = spark.createDataFrame([(1, 0, "user", "a")] * 3, TURNS)  # repeated rows are turns of their own
    assert [r[1] for r in nodes(prefix_trie.prefix_trie(repeated))] == [r[1] for r in brute_trie([(1, 0, "user", "a")] * 3)]


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    entries = {b"".join(bytes([rng.randint(0, 2)]) * prefix_trie.UNIT for _ in range(rng.randint(0, 6))) for _ in range(500)}
    runs = [[] for _ in range(5)]
    for e in sorted(entries):
        runs[rng.randint(0, 4)].append(e)
    made = [prefix_trie.Run([(prefix_trie.common_turns(r[i - 1], e) if i else 0, e) for i, e in enumerate(r)]) for r in runs]
    out = list(prefix_trie.merge(made))
    assert [e for _, (_, e) in out] == sorted(entries)
    assert [s for s, _ in out] == [0, *(prefix_trie.common_turns(a[1][1], b[1][1]) for a, b in zip(out, out[1:], strict=False))]


# secret scan

def brute_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def written(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)


def check_base(got, texts):
    for r, text in zip(got, texts, strict=True):
        base = brute_base(text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert {x for x in r.spans.split(",") if not x.startswith("random")} == {x for x in written(base).split(",")} - ({""} if "random" in r.spans else set())


def test_base_spans(spark):
    small = "/root/testdata/sf0.01"
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(queries()["op13_secret_scan"](spark, small).collect(), key=lambda r: r.doc_id)
    check_base(got, [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert sum(r.n_assign for r in got)


def test_secret_edge_rows(spark):
    texts = [None, "", "secret=token :abcdefgh", "TOKEN = 'abcdef'", "toKen=abcdefgh", "ſecret: abcdefgh", "api_key:abc api-key=abcdefgh apikey= =abcdef", "AKIA" * 5 + "é AKIAAKIA", "é😀" + "0f" * 12, "0f" * 11 + "0", "password:" + "x" * 300_000]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], DOCS + ", n_hex long, spans string")
    check_base(sorted(secrets.find_secrets(df).collect(), key=lambda r: r.doc_id), texts)
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_random_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    docs = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    makes = [
        lambda: base64.b64encode(rng.randbytes(30)).decode(),
        lambda: base64.urlsafe_b64encode(rng.randbytes(33)).decode().rstrip("="),
        lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=40)),
        lambda: "".join(rng.choices(string.ascii_uppercase + "234567", k=32)),
        lambda: "".join(rng.choices(string.digits + "ABCDEF", k=40)),
    ]
    plain = ["averyordinarycompoundwordoflowercase", "getElementsByTagNameNamespaceOfNode", "some_long_snake_case_identifier_name", "/usr/local/share/documents/reports/latest", "2024-01-05-10-11-12-13-14-15-16", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "abcdefghijklmnopqrstuvwxyz0123456789", "1234567890123456789012345678", "INTERNATIONALORGANISATIONOFCOMMERCE"]
    planted = [rng.choice(makes)() for _ in range(200)]
    texts = [f"{d[:200]} {planted[i]} {d[200:]}" if i < 200 else f"{d[:200]} {plain[i % len(plain)]} {d[200:]}" if i < 400 else d for i, d in enumerate(docs)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    at = [f"random:{len(docs[i][:200]) + 1}:{len(docs[i][:200]) + 1 + len(planted[i])}" for i in range(200)]
    found = sum(at[i] in got[i].spans.split(",") for i in range(200))
    assert found >= 185, found
    wrong = [texts[i][int(s) : int(e)] for i, r in got.items() if i >= 200 for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "random"]
    assert len(wrong) <= 2, wrong


def test_battery_is_level_on_random_texts():
    rng = np.random.default_rng(0)
    for name, size in (("hex", 40), ("base62", 24), ("base64", 64), ("lower", 32)):
        symbols = np.frombuffer(secrets.ALPHABETS[name].encode(), np.uint8)
        p = secrets.battery(rng.choice(symbols, (4000, size)))[1]
        assert (p < 0.01).mean() < 0.03 and (p < 0.5).mean() < 0.65, (name, (p < 0.01).mean(), (p < 0.5).mean())
