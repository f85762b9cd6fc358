"""Secrets in texts: three fixed patterns, and a battery of randomness tests over all tokens that could be keys.

The base spans are what the patterns say. The battery takes every token of 16 or more letters, digits and signs, infers its
encoding (the smallest alphabet that holds it), and asks three questions of its symbols: are they spread evenly (chi-squared
against the alphabet, two-sided), do they cross the middle of the alphabet as often as chance would (runs), and does a symbol tell
the next one (serial correlation). The three p-values become one by Fisher's rule; a random token has a large one.

How large ordinary text makes it depends on the length. So all texts of the corpus give decoys: what stands outside the tokens and base
spans, its letters and digits in a row, with and without signs between the words, is cut into pieces of the least length of each
stratum in turn and put to the same battery. A token's p-value is the share of decoys
of its stratum that look as random; the false-discovery rule of Benjamini and Hochberg over all tokens then sets one threshold
for each stratum. Counts of decoys and tokens are kept by stratum and tenth of a power of ten, so all texts are read once and only
these counts reach the driver.

A null or empty text has no spans. Texts are read whole, long ones as one string. Spans count code points. Equal rows are scanned
again and count again; rows with equal ids stay apart. Of spans with the same start the kinds stand as listed. Other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import materialize, text_slices

#: Fixed patterns; letters mean ASCII letters.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ["assign", "access", "hex", "random"]

#: Least lengths of the strata.
STRATA = [16, 20, 24, 32, 48, 64]
TOKEN = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?!\w)")
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in the order of their sizes; their order gives a symbol its value.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "signs": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_SIZES = np.array([len(a) for a in ALPHABETS.values()])
#: Value of each byte in each alphabet, and the alphabets that hold it as bits.
_VALUES = np.zeros((len(ALPHABETS), 256), np.int16)
_HELD_BY = np.zeros(256, np.int16)
for _i, _symbols in enumerate(ALPHABETS.values()):
    _VALUES[_i, list(_symbols.encode())] = np.arange(len(_symbols))
    _HELD_BY[list(_symbols.encode())] |= 1 << _i
#: Numbers are no keys, however random.
DECIMAL = 0
#: Alphabets that differ in case or signs only; a text of one stands for the others.
FAMILIES = [["hex", "HEX"], ["lower", "upper"], ["base36", "BASE36"], ["base64", "base64url", "signs"]]
#: p-values are counted by tenths of a power of ten; a token below the level is not taken for random.
BINS, LEVEL_BIN = 200, 20
FALSE_DISCOVERIES = 0.01
#: Pieces that the battery takes at a time.
_PIECES = 20_000
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def battery(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alphabet, p-value) of texts of one length, given as rows of bytes: how likely a random text of its alphabet is as odd."""
    held = np.bitwise_and.reduce(_HELD_BY[pieces], axis=1)
    alphabet = np.log2(held & -held).astype(int)
    v = _VALUES[alphabet[:, None], pieces].astype(np.int64)
    m, n = v.shape
    k = _SIZES[alphabet]
    widest = int(_SIZES.max())
    counts = np.bincount((v + np.arange(m)[:, None] * widest).ravel(), minlength=m * widest).reshape(m, widest)
    spread = k / n * (counts**2).sum(1) - n
    scale = (n - 1) / n  # the statistic has mean k - 1 and variance 2 (k - 1) (n - 1) / n: a scaled chi-squared one, made normal by its cube root
    freedom = (k - 1) / scale
    even = _two_sided((np.cbrt(spread / (k - 1)) - (1 - 2 / (9 * freedom))) / np.sqrt(2 / (9 * freedom)))
    high = v >= (k // 2)[:, None]
    crossed = (high[:, 1:] != high[:, :-1]).sum(1)
    runs = _two_sided(np.maximum(np.abs(crossed - (n - 1) / 2) - 0.5, 0) / (math.sqrt(n - 1) / 2))
    x = v - ((k - 1) / 2)[:, None]
    serial = _two_sided((x[:, 1:] * x[:, :-1]).sum(1) / ((k**2 - 1) / 12 * math.sqrt(n - 1)))
    fisher = -np.log(np.maximum(even, 1e-300)) - np.log(np.maximum(runs, 1e-300)) - np.log(np.maximum(serial, 1e-300))
    return alphabet, np.exp(-fisher) * (1 + fisher + fisher**2 / 2)


def cells(size: int, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, bin) of texts of one length: group counts strata and alphabets, bin falls with the p-value."""
    stratum = np.searchsorted(STRATA, size, "right") - 1
    group, p = np.zeros(len(pieces), int), np.zeros(len(pieces))
    for i in range(0, len(pieces), _PIECES):
        group[i : i + _PIECES], p[i : i + _PIECES] = battery(pieces[i : i + _PIECES])
    return stratum * len(ALPHABETS) + group, np.minimum(-10 * np.log10(np.maximum(p, 1e-300)), BINS - 1).astype(int)


GROUPS = len(STRATA) * len(ALPHABETS)
_ALNUM = np.zeros(256, bool)
_ALNUM[list((_DIGITS + _UPPER + _LOWER).encode())] = True
_SIGNS = np.frombuffer(b"_-/+", np.uint8)
#: Words in a row that are joined alike: with no sign, then with each sign in turn.
_ALIKE = 64


class Decoys:
    """Counts of the decoys of one task; letters that fill no piece wait for the next texts."""

    def __init__(self) -> None:
        self.counts = np.zeros((GROUPS, BINS), np.int64)
        self.rest = np.zeros(0, np.uint8)
        self.gaps = 0

    def add(self, texts: bytes) -> None:
        flat = np.frombuffer(texts + b" ", np.uint8).copy()
        keep = _ALNUM[flat]
        gap = np.flatnonzero(~keep & np.concatenate(([False], keep[:-1])))  # the first place after a word
        number = self.gaps + np.arange(len(gap))
        signed = (number // _ALIKE) % 2 == 1
        flat[gap] = _SIGNS[(number // (2 * _ALIKE)) % len(_SIGNS)]
        keep[gap[signed]] = True
        self.gaps += len(gap)
        letters = np.concatenate((self.rest, flat[keep]))
        whole = len(letters) // sum(STRATA)
        self.cut(letters[: whole * sum(STRATA)].reshape(whole, sum(STRATA)))
        self.rest = letters[whole * sum(STRATA) :]

    def cut(self, rows: np.ndarray) -> None:
        at = 0
        for size in STRATA:
            if at + size <= rows.shape[1]:
                np.add.at(self.counts, cells(size, rows[:, at : at + size]), 1)
            at += size

    def end(self) -> np.ndarray:
        self.cut(self.rest[None, :])
        return self.counts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def loose_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, letters without padding) of the tokens that touch no base span."""
    out, at, reached = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():  # base spans by start, so reached is the furthest end of those that begin before this one ends
            reached = max(reached, base[at][2])
            at += 1
        if reached <= m.start():
            out.append((m.start(), m.end(), m[0].rstrip("=").encode()))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with a blank for each span."""
    if not spans:
        return text
    parts, at = [], 0
    for start, end in sorted(spans):
        parts.append(text[at:start])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def span_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TOKEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("group", pa.int32()), ("bin", pa.int32())])
_CELL = pa.struct([("group", pa.int32()), ("bin", pa.int32()), ("decoys", pa.int64()), ("tokens", pa.int64())])
_SCANNED = "base array<struct<start:long,kind:int,end:long>>, base_sha256 string, tokens array<struct<start:long,end:long,group:int,bin:int>>, cells array<struct<group:int,bin:int,decoys:long,tokens:long>>"


def scan(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row for each document, with base spans and tokens in their cells; and rows with cells, which hold a task's counts."""
    kind = docs.schema[key].dataType
    names, types = [key, "base", "base_sha256", "tokens", "cells"], [to_arrow_type(kind), pa.list_(_SPAN), pa.string(), pa.list_(_TOKEN), pa.list_(_CELL)]

    def batch(*columns: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoys, seen = Decoys(), np.zeros((GROUPS, BINS), np.int64)
        for b in text_slices(batches, text):
            texts = [t or "" for t in b.column(text).to_pylist()]
            base = [base_spans(t) for t in texts]
            tokens = [loose_tokens(t, of) for t, of in zip(texts, base, strict=True)]
            decoys.add(" ".join(without(t, [(s, e) for s, _, e in of] + [x[:2] for x in own]) for t, of, own in zip(texts, base, tokens, strict=True)).encode())
            loose = [(i, *token) for i, own in enumerate(tokens) for token in own]
            by_size: dict[int, list[tuple]] = {}
            for token in loose:
                by_size.setdefault(len(token[3]), []).append(token)
            found: list[list[dict]] = [[] for _ in texts]
            for size, alike in by_size.items():
                groups, bins = cells(size, np.frombuffer(b"".join(t[3] for t in alike), np.uint8).reshape(len(alike), size))
                np.add.at(seen, (groups, bins), 1)
                for (i, start, end, _), g, x in zip(alike, groups.tolist(), bins.tolist(), strict=True):
                    found[i].append({"start": start, "end": end, "group": g, "bin": x})
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in of] for of in base]
            yield batch(b.column(key).to_pylist(), spans, [span_digest(of) for of in base], found, [None] * len(texts))
        counts = decoys.end()
        at = zip(*(x.tolist() for x in np.nonzero(counts + seen)), strict=True)
        yield batch([None], [None], [None], [None], [[{"group": g, "bin": x, "decoys": int(counts[g, x]), "tokens": int(seen[g, x])} for g, x in at]])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, {_SCANNED}")


def thresholds(decoys: np.ndarray, tokens: np.ndarray, rate: float = FALSE_DISCOVERIES) -> list[int]:
    """For each group the number of its bins that are discoveries, from the most random on.

    The p-value of a cell is the share of the decoys of its stratum that are of the same family of alphabets and look at least as random,
    times the number of alphabets; the rate holds over all tokens but numbers.
    """
    by = (len(STRATA), len(ALPHABETS), BINS)
    decoys, tokens = decoys.reshape(by), tokens.reshape(by).copy()
    tokens[:, DECIMAL] = 0
    decoys = decoys.copy()
    total = decoys.sum((1, 2))
    for family in FAMILIES:
        members = [list(ALPHABETS).index(a) for a in family]
        decoys[:, members] = decoys[:, members].sum(1, keepdims=True)
    p = (1 + decoys.cumsum(2)) / (1 + total)[:, None, None] * len(ALPHABETS)
    p[:, :, LEVEL_BIN:] = 2
    p[:, DECIMAL] = 2
    order = np.argsort(p, axis=None, kind="stable")
    sorted_p, found = p.ravel()[order], tokens.ravel()[order].cumsum()
    fine = np.flatnonzero((sorted_p <= 1) & (sorted_p * tokens.sum() <= rate * found) & (found > 0))
    return (p <= (sorted_p[fine[-1]] if len(fine) else -1)).sum(2).ravel().tolist()


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every document."""
    scanned = materialize(scan(docs, text, key), "secrets")
    counts = scanned.where("cells IS NOT NULL").select(F.explode("cells").alias("c")).groupBy("c.group", "c.bin").agg(F.sum("c.decoys"), F.sum("c.tokens")).collect()
    decoys, tokens = np.zeros((2, GROUPS, BINS), np.int64)
    for group, at, d, t in counts:
        decoys[group, at], tokens[group, at] = d, t
    taken = F.array(*map(F.lit, thresholds(decoys, tokens, rate)))
    random = F.filter("tokens", lambda t: t["bin"] < F.element_at(taken, t["group"] + 1))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    name = F.array(*map(F.lit, KINDS))
    written = lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.where("cells IS NULL").select(
        key, *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.size(random).cast("long").alias("n_random"), "base_sha256",
        F.array_join(F.transform(F.array_sort(F.concat("base", random)), written), ",").alias("spans"),
    )
