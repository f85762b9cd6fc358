from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, html_text, quality

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header><h2>Site name</h2></header><!-- ad <p>x</p> --><div class="ad">Buy this now, it is good.</div>
<article><h1>Head</h1><p><b>First, &eacute;t&#233; para&nbsp;graph<br>goes   on, and on, with words.<br><p>Second &lt;one&gt;, unclosed, and with <i>inline</i> parts.
<ul><li>item one<li>item two, with a comma.</ul><aside>Aside, text, here.</aside><div class="comments"><p>Reader, one, says: hello there, and more.</p></div><form><p>Name</p></form></article>
<div id="sidebar"><p>Side, text.</p></div><footer>&copy; f</footer></body></html>"""


def test_page():
    want = ["Head", "First, été para graph goes on, and on, with words.", "Second <one>, unclosed, and with inline parts.", "item one", "item two, with a comma."]
    assert html_text.main_text(PAGE) == "\n".join(want)


def test_page_without_article():
    page = "<body><div class=menu><a>x</a></div><h2>Title</h2><p>Some text, long enough, to be content.</p><p>And more, text.</p><div class='cookie-notice'>We use cookies, always.</div></body>"
    assert html_text.main_text(page) == "Title\nSome text, long enough, to be content.\nAnd more, text."


PROSE = "Some words of the text, and then more of them, to be read. " * 4
PAR = f"<p>{PROSE}</p>"
MENU = "<div><a href=x>Home</a> <a href=y>News</a></div>"
RIGHTS = "<p>Copyright 2024, Acme Inc. All rights reserved.</p>"
LAYOUTS = [
    (f'<main class="has-sidebar"><h1>T</h1>{PAR}</main>', "TC"),
    (f'<div class="layout with-comments"><article><h1>T</h1>{PAR}</article></div>', "TC"),
    (f'<article class="post search-hit"><h1>T</h1>{PAR}</article>', "TC"),
    (f"<form action=x><h1>T</h1>{PAR}{PAR}<input></form>", "TCC"),
    (f"<form><article><h1>T</h1>{PAR}</article></form>", "TC"),
    (f"{MENU}<article><h1>T</h1>{PAR}</article>{RIGHTS}", "TC"),
    (f"{MENU}<h1>T</h1>{PAR}{PAR}{RIGHTS}", "TCC"),
    (f'<article><h2 id="related-work">T</h2>{PAR}<section id="social-impact">{PAR}</section><p id="notice-2">{PROSE}</p></article>', "TCCC"),
    (f"<main><h1>T</h1><p>T</p><article>{PAR}</article></main>", "TTC"),
    (f'<div><h1>T</h1><div>{PAR * 8}</div><section>{PAR}</section></div><div class="comments">{PAR * 30}</div>', "TCCCCCCCCC"),
    (f"<div>{PAR * 3}<div id=comment-list><div><b>Al</b> says<p>Nice, really, good.</p></div></div></div>", "CCC"),
    (f"<article><h1>T</h1>{PAR}<ul><li>T<li>T</ul><div class=share-buttons><a>x</a></div></article>", "TCTT"),
]


#: Layouts whose furniture has no names and no links, so that only lengths and punctuation tell it.
NOTE = "Our office is open from nine to five"
SCORED = [
    (f"<table><tr><td>Home<tr><td>News<tr><td>Mail</table><div>{PAR * 3}</div>", "CCC"),
    (f"<div><div>{NOTE}</div></div><div><h1>T</h1>{PAR * 4}</div>", "TCCCC"),
    (f"<div>{PAR * 4}</div><div><ul><li>{NOTE}<li>{NOTE}</ul></div>", "CCCC"),
    (f"<dl><dt>Phone<dd>12345<dt>Fax<dd>12346</dl><div><h1>T</h1>{PAR * 2}</div>", "TCC"),
    (f"<article><h2>T</h2><p>A teaser here</p></article><article><h1>T</h1>{PAR * 6}</article><article><h2>T</h2><p>More of it</p></article>", "TCCCCCC"),
    (f"<div><span>{NOTE}</span></div><section>{PAR * 5}</section>", "CCCCC"),
    (f"<ul><li>Home<li>World<li>Sports</ul><div>{PAR * 3}</div><ul><li>Terms<li>Press</ul>", "CCC"),
    (f"<div><div>Today</div><div>{NOTE}</div></div><div><div>{PAR * 2}</div><div>{PAR}</div></div>", "CCC"),
]
SENTENCE = "A short section that closes the text in sixty characters."
SAID = lambda name, when: f"<div class=x><b>{name}</b><div>{when}</div><p>{PROSE}</p></div>"
FOUND = [
    (f'<div>{PAR * 2}</div><section id="reader-comments">{PAR}</section>', "CC"),
    (f"<article>{PAR * 2}</article><div class=discussion-thread>{PAR * 3}</div>", "CC"),
    (f"<article>{PAR * 2}<div class=user-thread>{PAR}</div></article>", "CC"),
    (f"<main><h1>T</h1>{PAR * 2}<div class=related-posts>{PAR}</div><div class=cta-box>{PAR}</div></main>", "TCC"),
    (f"<div class=header>{PAR}</div><div>{PAR * 3}</div>", "CCC"),
    (f"<div class=article-header><h1>T</h1></div><div>{PAR * 3}</div>", "TCCC"),
    (f"<article>{PAR}<ul>{'<li><a href=x>T</a>' * 4}</ul></article>", "CTTTT"),
    (f"<div>{PAR * 30}</div><section><p>{SENTENCE}</p></section>", "C" * 30 + "S"),
    (f"<header><h1>T</h1></header><div>{PAR * 3}</div>", "TCCC"),
    (f"<article><p title='the hidden text'>{PROSE}</p><p data-note='display: none is css'>{PROSE}</p><p class='hidden-gem'>{PROSE}</p><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p><p aria-hidden=true>{PROSE}</p></article>", "CCC"),
    (f"<article>{PAR * 3}{SAID('Ann', '2 May 2024')}{SAID('Bo', '3 May 2024')}</article>", "CCC"),
    (f"<div>{PAR * 3}</div><div>{SAID('Ann', '10:15')}{SAID('Bo', '2 days ago')}{SAID('Cy', '2024-05-01')}</div>", "CCC"),
]


def expected(want):
    return "\n".join({"T": "T", "C": PROSE.strip(), "S": SENTENCE}[x] for x in want)


@pytest.mark.parametrize("page, want", LAYOUTS + SCORED + FOUND)
def test_layouts(page, want):
    got = html_text.main_text(f"<html><body>{page}</body></html>")
    assert got == expected(want)


def test_scores_decide(monkeypatch):
    """Without text length and punctuation alone, names and linked text as they are, most of the layouts without names come out wrong."""
    monkeypatch.setattr(html_text, "fused", lambda chars, marks, blocks: np.ones(len(chars)))
    wrong = [html_text.main_text(f"<html><body>{p}</body></html>") != expected(w) for p, w in SCORED]
    assert sum(wrong) >= len(SCORED) - 1, wrong


def test_odd_pages(spark):
    rows = [(1, "u", None, 9), (2, "u", "", 9), (3, None, "<", 9), (4, "u", "plain, text", 9), (5, "u", "<p>a, b<p", 9), (6, "u", "<div>" * 3000 + "deep, text", 9), (7, "u", "<article>" + "<p>w, w</p>" * 5000, 9), (7, "u", "<script>", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect()), key=str)
    want = [(1, "u", ""), (2, "u", ""), (3, None, "<"), (4, "u", "plain, text"), (5, "u", "a, b"), (6, "u", "deep, text"), (7, "u", "\n".join(["w, w"] * 5000)), (7, "u", "")]
    assert got == sorted(((*w, len(w[2])) for w in want), key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_all_pages_of_the_table(spark, small):
    import html
    import re

    for r in html_text.extract(spark.read.parquet(f"{small}/pages.parquet"), keep=("page_id", "html")).collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def test_escape_round_trip():
    rng = random.Random(0)
    marks = [*chat.INSTRUCT.marks, "\\", "<", "[", "/", "s>", "INST]", "x", "é", "\n"]
    pattern = chat.INSTRUCT.pattern()
    for _ in range(5000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text, chat.INSTRUCT)
        assert chat.unescape(safe) == text and not pattern.search(safe)
        for part in chat.INSTRUCT.parts.values():
            found = pattern.findall(part.opening + safe + part.closing)
            assert found == [part.opening, part.closing], text


def test_chat_digests(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard), (1, 0, "system", None), (1, 1, "user", "a\\<s>"), (1, 2, "assistant", "é" * 10), (1, 3, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "tool", "t[ROLE]"), (3, 0, None, None), (4, 0, "user", "x"), (4, 0, "user", "x"), (None, 0, "user", "n")]
    rows += [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, r, t in own if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(own)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert g.formatted_chars >= sum(len(t) for *_, t in own)
    assert {c: got[c].turns_out_of_order for c in (-1, 1, 2, 4, 7)} == {-1: 0, 1: 1, 2: 2, 4: 1, 7: 0}
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_machine_and_identity():
    rng = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.1, rng.normal(size=30), rng.normal(size=(30, 4)))
    place, value = np.array([2, 5, 7, 29]), rng.normal(size=4)
    slow = m.bias + m.linear[place] @ value + sum(m.factors[place[i]] @ m.factors[place[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(m.score([(place, value)])[0], 1 / (1 + np.exp(-slow)))


def test_held_out_accuracy(spark, small):
    big = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = quality.classify(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    met = out.join(labels, "doc_id").where("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("quality")).alias("right")).first()
    assert met.right >= 0.95 * met.n


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, ("fine words here. " if i % 2 else "JUNK!! | ") * 20, None) for i in range(40)] + [(50, None, 5), (51, "", -1), (51, "", -1), (52, "w " * 60_000, 10)], "doc_id long, text string, n_chars long")
    out = quality.classify(docs, labels)
    assert out.count() == 44 and out.where("score is null").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect() if r} is not None
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)
