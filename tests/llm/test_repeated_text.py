"""Line and substring dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from docloom.llm import lines, substring
from docloom.llm.words import word_hashes


def shingles(line):
    w = line.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None


def slow_lines(rows):
    """{(row number, line)} of the lines to remove; rows that repeat id and text are one."""
    seen, gone, places = [], set(), {}
    distinct = sorted({(d, lines_uid(t), t) for d, t in rows if d is not None and t is not None})
    for d, _, t in distinct:
        for n, line in enumerate(t.split("\n")):
            s = shingles(line)
            if s is None:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                places.setdefault((d, t), set()).add(n)
            seen.append(s)
    for i, (d, t) in enumerate(rows):
        gone |= {(i, n) for n in places.get((d, t), ())}
    return gone


def lines_uid(text):
    from xxhash import xxh64_intdigest

    n = xxh64_intdigest(text.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def check_lines(spark, rows):
    df = spark.createDataFrame([(t, "x", d, i) for i, (d, t) in enumerate(rows)], "text string, token string, doc_id long, uid long")
    gone = slow_lines(rows)
    out = {r.uid: r for r in lines.dedup(df).collect()}
    assert len(out) == len(rows)
    for i, (d, t) in enumerate(rows):
        mine = {n for j, n in gone if j == i}
        assert out[i].text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in mine)), (i, d, t)
        assert out[i].removed_lines == len(mine) and out[i].token == "x"
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    words = list("abcdefghijkl")
    base = [[rng.choice(words) + rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(25)]
    rows = [(900, None), (901, ""), (902, "\n\n"), (903, " ".join("long" + str(i % 999) for i in range(20_000)))]
    for i in range(90):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                if rng.random() < 0.6:
                    w[rng.randrange(len(w))] = rng.choice(words)
            text.append(" ".join(w))
        rows.append((i, "\n".join(text)))
    assert len(check_lines(spark, rows)) > 50
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_repeated_ids(spark):
    rng = random.Random(21)
    rows = [(i % 30, "\n".join(" ".join(rng.choice("abcA") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    rows += [(50, "東京都に行きました。"), (51, "x\n東京都に行きました。\n\n \n\n"), (52, "All rights reserved.\nall  rights RESERVED."), (53, "Of."), (54, "y Of.\nOf.")]
    rows += [(None, "Of."), (60, "unique one here\nOf."), (60, "Of.\nunique two here, été"), (60, "Of.\nunique two here, été"), (61, "unique two here, été")]
    check_lines(spark, rows)


@pytest.mark.parametrize("small, block", [(2, 4), (16, 1024)])
def test_large_groups_of_similar_lines(spark, monkeypatch, small, block):
    """Many different lines that share their shingles: more than a small group, and over several blocks and tasks."""
    monkeypatch.setattr(lines, "SMALL", small)
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(5)
    rows = []
    for family in range(3):
        words = [f"w{family}x{i}" for i in range(60)]
        for i in range(60):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            rows.append((family * 100 + i, " ".join(w[rng.randint(0, 6) :])))
    rng.shuffle(rows)
    assert len(check_lines(spark, rows)) > 50


def test_word_hashes():
    data = b"a ab abcdefgh abcdefghi " + b"x" * 300 + b" abcdefghi a"
    begin = np.array([i for i in range(len(data)) if data[i : i + 1] != b" " and (i == 0 or data[i - 1 : i] == b" ")])
    end = np.array([b + len(data[b:].split(b" ")[0]) for b in begin])
    code = word_hashes(data, begin, end).tolist()
    assert code[0] == code[6] and code[3] == code[5] and len(set(code)) == 5


def slow_windows(text):
    """(begin, end, words) of the shortest runs of chunks with twelve words or more, of a text whose words are short."""
    data = text.encode()
    ends = substring.cut(text)
    spaced = lambda i: i >= len(data) or data[i : i + 1].isspace()
    edges, last = [], 0
    for e in ends:
        begin = next(i for i in range(last, e) if not spaced(i))
        edges.append((begin, e))
        last = e
    count = [len(data[b:e].split()) for b, e in edges]
    found = set()
    for i in range(len(edges)):
        j = next((j for j in range(i, len(edges)) if sum(count[i : j + 1]) >= 12), None)
        if j is not None:
            found.add((i, j))
        k = next((k for k in range(i, -1, -1) if sum(count[k : i + 1]) >= 12), None)
        if k is not None:
            found.add((k, i))
    stop = lambda j: edges[j + 1][0] if j + 1 < len(edges) else len(data)
    return [(edges[i][0], stop(j), tuple(data[edges[i][0] : edges[j][1]].split())) for i, j in found]


def slow_cut(rows):
    """Texts by row number after the removal of repeated windows."""
    distinct = sorted({(d, lines_uid(t), t) for d, t in rows if d is not None and t is not None})
    first, spots = {}, {}
    every = [(d, u, b, e, w, t) for d, u, t in distinct for b, e, w in slow_windows(t)]
    for d, u, b, e, w, _ in every:
        first[w] = min(first.get(w, (d, u, b, e)), (d, u, b, e))
    for d, u, b, e, w, t in every:
        f = first[w]
        if (d, u) != f[:2] or b >= f[3]:
            spots.setdefault((d, t), []).append((b, e))
    out = []
    for d, t in rows:
        data = None if t is None else t.encode()
        for b, e in reversed(substring.long_runs(spots.get((d, t), []))):
            data = data[:b] + data[e:]
        out.append(None if data is None else data.decode())
    return out


def check_substrings(spark, rows):
    df = spark.createDataFrame([(t, "x", d, i) for i, (d, t) in enumerate(rows)], "text string, digest string, doc_id long, uid long")
    out = {r.uid: r for r in substring.dedup(df).collect()}
    assert len(out) == len(rows)
    for i, want in enumerate(slow_cut(rows)):
        assert out[i].text == want, (rows[i], want)
        assert out[i].removed_bytes == len((rows[i][1] or "").encode()) - len((want or "").encode()) and out[i].digest == "x"
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))
    rows, passages = [], [text(60) for _ in range(60)]
    for p in passages:
        for _ in range(2):
            rows.append((len(rows), f"{text(rng.randint(5, 150))}{p}{text(rng.randint(5, 150))}"))
    rows += [(1000 + i, text(200)) for i in range(60)] + [(2000, None), (2001, ""), (2002, " \n "), (2003, rows[0][1]), (2004, passages[0] * 3)]
    rows += [(3000, rows[4][1]), (3000, "été " * 3 + text(80)), (3000, passages[2] + text(90)), (3000, passages[2] + text(90)), (None, passages[3])]
    rows += [rows[-2]]
    out = check_substrings(spark, rows)
    assert sum(out[i].removed_bytes > 0 for i in range(1, 120, 2)) >= 59
    assert all(out[i].source_doc_ids == [i - 1] for i in range(1, 120, 2) if out[i].removed_bytes)
    assert all(out[i].text == t for i, (d, t) in enumerate(rows) if i in range(0, 120, 2) or 1000 <= (d or 0) < 2003)
    assert out[183].text == "" and out[183].source_doc_ids == [0]
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_phrases_of_several_documents_cut_nothing(spark):
    rng = random.Random(31)
    phrases = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(5)) + " " for _ in range(6)]
    fill = lambda: " ".join("".join(rng.choice("klmnopqrst") for _ in range(7)) for _ in range(30)) + " "
    rows = [(i, fill() + p + fill()) for i, p in enumerate(phrases)] + [(10, fill() + "".join(phrases) + fill()), (11, fill() + "".join(phrases) + fill())]
    out = check_substrings(spark, rows)
    assert all(out[i].removed_bytes == 0 for i in range(7)) and out[7].removed_bytes >= 100


def test_text_without_white_space(spark):
    rng = random.Random(6)
    kanji = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    shared = kanji(900)
    rows = [(1, kanji(300) + shared + kanji(300)), (2, kanji(501) + shared + kanji(100)), (3, "x" * 50_000), (4, "y" * 50_000), (5, "x" * 50_000)]
    out = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].removed_bytes == 0 and out[3].removed_bytes == 0 and out[4].removed_bytes == 0 and out[5].text == ""
    assert 2200 <= out[2].removed_bytes <= 2700 and out[2].text in rows[1][1].replace(shared, "\0") or out[2].text.startswith(rows[1][1][:501])


@pytest.mark.parametrize("text", ["", "a b", "word " * 3000, "x" * 9000, "é" * 4000 + " b", "\n" * 50])
def test_cuts_are_whole_characters(text):
    raw, ends = text.encode(), substring.cut(text)
    assert ends == sorted(set(ends)) and (not raw.strip() or ends[-1] == len(raw.rstrip()))
    for s, e in zip([0, *ends], ends, strict=False):
        raw[s:e].decode()


def test_cuts_resist_insertions():
    rng = random.Random(9)
    words = [f"{rng.randrange(10**6)}" for _ in range(4000)]
    a, b = " ".join(words), " ".join([*words[:100], "inserted", *words[100:]])
    shift = len(b) - len(a)
    cuts_a, cuts_b = set(substring.cut(a)), {e - shift for e in substring.cut(b)}
    late = {e for e in cuts_a if e > 2000}
    assert len(late & cuts_b) > 0.98 * len(late)
