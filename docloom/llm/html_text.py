"""Main text of web pages by tag-path ratios.

A page is read once into blocks: stretches of text between block-level tags, each with its root-to-leaf tag path. For every path
the text length, the punctuation and the linked text of its blocks are summed. Length and punctuation per block are smoothed along the
page and multiplied; the share of linked text and a prior of the names of the elements around lower the product. Paths that
reach a part of the greatest product are content; blocks of the others stay only as company of content (headings, list items, short
sections): inside an article or main element around content, or, where there is none, beside content in the same parent. Of several
article or main elements those stay whose own ratios reach that part of the greatest.

Names are a prior, no verdict: an element named as page furniture (a menu, footer, sidebar, notice, advert, form, comment) counts little,
one with such a word among others a bit less, and neither where it holds an article or main element. Forms and the like that hold
half of a page's text count as wrappers too, where the page has no article or main element. Readers' comments also show by repetition: sibling
elements of one kind, each a short line with a date or the like and a text. Scripts, styles and hidden elements are never read.

A null or empty page, and one without any content, give the empty text. Broken markup is read as browsers do in the common cases:
paragraphs, list items and cells close each other, unknown end tags are ignored, open elements end with their parent. Paths of equal
product are all content or none is. Pages that repeat are read again; very long pages are read whole, one at a time. Columns other than
the html and those kept are not read, so their names may clash; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?。、，！？；：…]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
#: A start tag of the key closes open elements of the value, up to the nearest container of them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select menu dialog fieldset".split())
#: Words in class, id or role that name page furniture (fixed values).
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert "
    "comment comments commentlist reply replies respond disqus sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer share "
    "sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay pagination pager login signup search "
    "contentinfo complementary dialog form masthead discussion discussions thread threads cta header tagcloud taglist".split()
)
#: Words beside them that say nothing, and words that turn them round: has-sidebar is no sidebar (fixed values).
PLAIN_WORDS = frozenset("site page main left right top bottom global list box block wrap wrapper container section area bar inner outer item items links widget primary secondary reader readers user users visitor posts articles stories".split())
#: What a header may be of and still be no page furniture: the head of the text itself (fixed values).
TITLED_WORDS = frozenset("article post entry story content text".split())
TURNING_WORDS = frozenset("has have no with without is are open closed enabled disabled".split())
#: Furniture that never wraps a page, however much text it holds.
CLOSED_TAGS = frozenset("nav footer aside select button menu dialog".split())
CLOSED_WORDS = frozenset("comment comments commentlist replies respond disqus footer discussion".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Priors of furniture by its whole name and by a part of it.
STRONG, WEAK = 0.02, 0.3
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b).{0,180}\Z|.{0,150}all rights reserved\W*\Z", re.I | re.S)


@dataclass
class Element:
    """An open or closed element; those of furniture count how much text they hold."""

    name: str
    prior: float = 1.0
    closed: bool = False
    holds_article: bool = False
    chars: int = 0
    label: str = ""  # its classes


@dataclass
class Block:
    around: tuple[Element, ...]
    path: tuple[str, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def words(self) -> str:
        return self.text[0]


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a start tag by their names; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html_lib.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def _named(name: str, attributes: dict[str, str]) -> tuple[float, bool]:
    """Prior of an element by its tag and names, and whether it never wraps a page."""
    prior, closed = (STRONG, name in CLOSED_TAGS) if name in FURNITURE_TAGS or name == "header" else (1.0, False)
    if not attributes or name in ARTICLE or name in HEADINGS or name in ("html", "body"):
        return prior, closed
    for token in " ".join(attributes.get(n, "") for n in ("class", "id", "role")).lower().split():
        parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        known = [w for w in parts if w in FURNITURE_WORDS and not (w == "header" and TITLED_WORDS.intersection(parts))]
        if known and not TURNING_WORDS.intersection(parts):
            whole = all(w in FURNITURE_WORDS or w in PLAIN_WORDS for w in parts)
            prior = min(prior, STRONG if whole else WEAK)
            closed |= whole and bool(CLOSED_WORDS.intersection(known))
    return prior, closed


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    fresh, links, hidden = True, 0, 0

    def put(raw: str) -> None:
        nonlocal fresh
        if not raw or hidden:
            return
        if fresh:
            if not raw.strip():
                return
            around = tuple(x for x in stack if x.name not in INLINE or x.prior < 1)
            out.append(Block(around, tuple(x.name for x in around)))
            fresh = False
        out[-1].text.append(raw)
        if links:
            out[-1].linked += len(raw.strip())

    def close(to: int) -> None:
        nonlocal fresh, links, hidden
        for x in stack[to:]:
            fresh = fresh or x.name not in INLINE
            links -= x.name == "a"
            hidden -= x.prior == 0
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            low = 0 if name not in INLINE else max((i + 1 for i, x in enumerate(stack) if x.name not in INLINE), default=0)
            found = next((i for i in range(len(stack) - 1, low - 1, -1) if stack[i].name == name), None)
            if found is not None:
                close(found)
            elif name not in INLINE:
                fresh = True
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if not m[0].endswith("/>") else None
            at = at if m[0].endswith("/>") else stop.end() if stop else end
            continue
        if name in ("br", "td", "th") or name in VOID:
            put(" ")  # white space inside a block
        if name in VOID:
            fresh = fresh or name == "hr"
            continue
        if name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in CLOSES[name]:
                    close(i)
                    if name != "tr" or not any(x.name in CLOSES[name] for x in stack[max(0, i - 1) :]):
                        break
                elif stack[i].name in HOLDERS or stack[i].name in FURNITURE_TAGS:
                    break
        elif name not in INLINE:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p" or stack[i].name in HEADINGS and name in HEADINGS:
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
        attributes = attributes_of(m[3]) if m[3].strip() else {}
        prior, closed = _named(name, attributes)
        if name == "header" and any(x.name in ARTICLE for x in stack):
            prior = 1.0
        if attributes and name not in ("html", "body") and _hidden(attributes):
            prior = 0.0
        if name in ARTICLE:
            for x in stack:
                x.holds_article = True
        if name not in INLINE:
            fresh = True
        if not m[0].endswith("/>") or name not in INLINE:
            stack.append(Element(name, prior, closed, label=attributes.get("class", "")))
            links += name == "a"
            hidden += prior == 0
    for b in out:
        b.text = [" ".join(html_lib.unescape("".join(b.text)).split())]
    return [b for b in out if b.words]


def _smooth(x: np.ndarray) -> np.ndarray:
    """A quarter of each neighbour's share, ends doubled."""
    wide = np.concatenate((x[:1], x, x[-1:]))
    return (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4


#: What stands by a reader's name: a date, a time, or a word for speaking (fixed values).
_SAID = re.compile(r"\b(?:\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|ago|says|said|wrote|replied|reply|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,? \d{1,4}|\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*)\b", re.I)
_SHORT, _PROSE = 60, 200


def _threads(found: list[Block]) -> set[int]:
    """Elements that repeat as readers' words do: siblings of one kind, each a short line with a date or the like and then a text.

    They count only where the rest of the page has a text of its own.
    """
    kinds: dict[tuple, dict[int, list[Block]]] = {}
    for b in found:
        for up, x in zip((_ROOT, *b.around), b.around, strict=False):
            if x.name in ("div", "li", "article", "section", "blockquote", "dd") and up.prior == x.prior == 1:
                kinds.setdefault((id(up), x.name, x.label), {}).setdefault(id(x), []).append(b)
    out: set[int] = set()
    for group in kinds.values():
        said = [x for x, own in group.items() if len(own) > 1 and any(len(b.words) <= _SHORT and _SAID.search(b.words) for b in own[:-1]) and len(own[0].words) <= _SHORT and (own[0].path[-1] not in HEADINGS)]
        if len(said) >= 2 and 2 * len(said) > len(group):
            inner = {id(b) for own in group.values() for b in own}
            if sum(len(b.words) - b.linked for b in found if id(b) not in inner and _PUNCTUATION.search(b.words)) >= _PROSE:
                out |= set(group)
    return out


def _priors(found: list[Block]) -> list[float]:
    """Of each block, the product of the priors around it that are no wrapper's."""
    total = 0
    for b in found:
        own = max(0, len(b.words) - b.linked)
        total += own
        for x in b.around:
            if x.prior < 1:
                x.chars += own
    article = any(x.name in ARTICLE for b in found for x in b.around)
    wraps = lambda x: x.holds_article or not article and not x.closed and 2 * x.chars > total
    threads = _threads(found)
    titles = [b for b in found if b.path[-1:] == ("h1",)]
    title = titles[0] if len(titles) == 1 and not article and not titles[0].linked else None  # a page's one title may stand in its header
    out = []
    for b in found:
        prior = STRONG if _RIGHTS.match(b.words) and not any(x.name in ARTICLE for x in b.around) else 1.0
        for x in b.around:
            if id(x) in threads:
                prior *= STRONG
            elif x.prior < 1 and not wraps(x) and not (b is title and x.name == "header"):
                prior *= x.prior
        out.append(prior)
    return out


def fused(chars: np.ndarray, marks: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Of each path: smoothed text length and punctuation per block, multiplied, and growing with all its text."""
    return _smooth(chars / blocks) * _smooth(marks / blocks) * np.sqrt(chars)


def path_scores(found: list[Block], priors: list[float]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Number of each block's path (told apart by prior), the score of each path, and its share of linked text."""
    number: dict[tuple, int] = {}
    own = [number.setdefault((b.path, p), len(number)) for b, p in zip(found, priors, strict=True)]
    nodes, chars, marks, linked, prior = (np.zeros(len(number)) for _ in range(5))
    for i, b, p in zip(own, found, priors, strict=True):
        nodes[i] += 1
        chars[i] += len(b.words)
        marks[i] += 1 + len(_PUNCTUATION.findall(b.words))
        linked[i] += min(b.linked, len(b.words))
        prior[i] = p
    share = linked / chars
    return own, fused(chars, marks, nodes) * (1 - share) ** 2 * prior, share


def _article_scores(found: list[Block], priors: list[float], outer: list[Element | None]) -> dict[int, float]:
    """The same ratios for each outermost article or main element, as if each were a path."""
    places: dict[int, int] = {}
    for o in outer:
        if o is not None:
            places.setdefault(id(o), len(places))
    if not places:
        return {}
    chars, marks, nodes = (np.zeros(len(places)) for _ in range(3))
    for b, p, o in zip(found, priors, outer, strict=True):
        if o is not None and p > STRONG:
            i = places[id(o)]
            nodes[i] += 1
            chars[i] += max(0, len(b.words) - b.linked)
            marks[i] += 1 + len(_PUNCTUATION.findall(b.words))
    whole = np.maximum(nodes, 1)
    plain = chars / whole * marks / whole * np.sqrt(chars)  # not smoothed: neighbouring articles are no lines of one text
    return {o: float(plain[i]) for o, i in places.items()}


def main_text(page: str | None, part: float = 0.1) -> str:
    """Content blocks of a page joined by newlines."""
    found = blocks(page or "")
    if not found:
        return ""
    priors = _priors(found)
    own, score, share = path_scores(found, priors)
    if score.max() <= 0:
        return ""
    content = [score[i] >= part * score.max() for i in own]
    outer = [next((x for x in b.around if x.name in ARTICLE), None) for b in found]
    inside = sum(len(b.words) for b, c, o in zip(found, content, outer, strict=True) if c and o is not None)
    total = sum(len(b.words) for b, c in zip(found, content, strict=True) if c)
    titled = [b.path[-1:] != () and b.path[-1] in HEADINGS for b in found]
    listed = [o is not None and "li" in b.path for b, o in zip(found, outer, strict=True)]  # references of a text may all be links
    company = [p > WEAK and (share[i] <= 0.8 or t or r) for p, i, t, r in zip(priors, own, titled, listed, strict=True)]
    if 2 * inside >= total:
        weight = _article_scores(found, priors, outer)
        holders = {id(o) for o, c in zip(outer, content, strict=True) if c and o is not None and weight[id(o)] >= part * max(weight.values())}
        keep = [o is not None and id(o) in holders and (c or q) for o, c, q in zip(outer, content, company, strict=True)]
    else:
        parents = {id(_parent(b)) for b, c in zip(found, content, strict=True) if c}
        above = {id(x) for b, c in zip(found, content, strict=True) if c for x in (_ROOT, *b.around)}  # of titles
        keep = [c or q and (id(_parent(b)) in (above if t else parents) or _apart(b, above)) for b, c, q, t in zip(found, content, company, titled, strict=True)]
    return "\n".join(b.words for b, k in zip(found, keep, strict=True) if k)


_ROOT = Element("")


def _parent(b: Block) -> Element:
    """The div, section or body that a block stands in."""
    return next((x for x in reversed(b.around) if x.name in ("div", "section", "body", "html", *ARTICLE)), _ROOT)


def _apart(b: Block, above: set[int]) -> bool:
    """Whether a block in an element of its own, beside content, is the page's title, or a paragraph of sentences in a section."""
    parent = _parent(b)
    outside = b.around[: next((i for i, x in enumerate(b.around) if x is parent), 0)]
    up = next((x for x in reversed(outside) if x.name in ("div", "section", "body", "html")), _ROOT)
    told = parent.name == "section" and b.words[-1:] in {*".!?…。！？"}
    return id(up) in above and not b.linked and (told or b.path[-1:] == ("h1",))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep, text and n_chars of every page."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, html):
            texts = [main_text(h) for h in b.column(html).to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*dict.fromkeys((*keep, html))).mapInArrow(run, schema)
