"""BPE encoding and decoding: batched numpy merge rounds over many words at once.

The vocabulary file is one of the public ``tokenizers`` JSON files with word-end symbols. Symbols of all
words of a batch stand in one flat array; in each round the rank of every adjacent pair is found by binary
search over the sorted pair keys, each word merges its lowest-ranked pair everywhere (left to right), and
words without a known pair leave the array. Words are encoded once per worker and kept in a cache of
bounded size; ids of texts are gathered from it.

Nulls and empty texts encode to no ids and decode to the empty text. Special-token strings inside a text
become their special id, as the library does. Repeated rows and ids are encoded again, row by row; very long texts are encoded whole,
one at a time. Of pairs of one rank (the same pair more than once) the leftmost merges first. Extra columns are ignored by the query and
kept by nothing else; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docloom.llm.common import text_slices

#: The public word pattern, and the same for texts of these characters only, where the faster module has all it needs.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\s0-9a-zß-öø-ɏ]+")
_NOT_LATIN = re.compile("[^\t-\r -~¡-©«-±´¶-¸»¿-ɏ\u2010-\u2027]")
_NO_PAIR = np.iinfo(np.int32).max


class _Index(dict):
    """Numbers words in the order in which they first come."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class BpeModel:
    """Vocabulary, merge table and word cache of one worker process."""

    def __init__(self, source: str, cache_words: int = 500_000):
        spec = json.loads(source)
        model, added = spec["model"], spec["added_tokens"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.size = 1 + max([*vocab.values(), *(x["id"] for x in added)])
        self.special = {x["content"]: x["id"] for x in added}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"])
        self._latin = split["pattern"]["Regex"] == WORDS
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        tokens = [b""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            tokens[i] = text.encode()
        self.tokens = tokens
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same symbol; rounds could not merge all places of a pair")
        order = np.argsort(key)
        self.keys, self.made, self.ranks = key[order], made[order], order.astype(np.int32)
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        """Start the cache anew with the special tokens, which no other word can equal."""
        self.index = _Index(list(self.special))
        self.ids = np.array(list(self.special.values()), np.uint32)
        self.sizes = np.ones(len(self.special), np.int64)
        self.starts = np.arange(len(self.special))

    def _rank(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at the places at; places that begin no known pair get _NO_PAIR."""
        key = sym[at] * self.size + sym[at + 1]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[found] == key) & (word[at] == word[at + 1])
        return np.where(known, self.ranks[found], _NO_PAIR), self.made[found]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty words, one word after the other, and their number for each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes) - 1
        sym = self.first[flat]
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, made = np.full(len(sym), _NO_PAIR, np.int32), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._rank(sym, word, np.arange(len(sym) - 1))
        done_word, done_sym = [], []
        while len(sym):
            new = np.concatenate(([True], word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            over = least == _NO_PAIR
            done_word.append(word[over])
            done_sym.append(sym[over])
            take = np.flatnonzero((rank == least) & ~over)
            if not len(take):
                break
            # of overlapping pairs (a a a) every second one, from the left
            run = np.concatenate(([True], np.diff(take) != 1))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - begin) % 2 == 0]
            sym[take] = made[take]
            keep = ~over
            keep[take + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = moved[take]  # pairs with a merged symbol on the right or on the left are ranked anew
            at = np.concatenate((at[at > 0] - 1, at))
            rank[at[at == len(sym) - 1]] = _NO_PAIR
            at = at[at < len(sym) - 1]
            rank[at], made[at] = self._rank(sym, word, at)
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        return sym[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _split(self, text: str) -> list[str]:
        """Normalised words and special tokens of a text."""
        if "<" in text and self._special.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += [*self._split(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self._split(text[at:])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (_LATIN_WORDS if self._latin and not _NOT_LATIN.search(text) else self._words).findall(text)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after the other, and where each text begins (one place more than texts).

        Texts of one call share their merge rounds; words seen before come from the cache.
        """
        if len(self.index) > self.cache_words:
            self._forget()
        parts, counts = [], [0]
        for t in texts:
            words = self._split(t) if t else []
            parts.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        if self.index.new:
            ids, sizes = self.merge([w.encode() for w in self.index.new])
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.index.new = []
        words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = self.sizes[words]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(self.starts[words] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.ids[place], ends[np.cumsum(counts)]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces: the vocabulary file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist())).decode()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=2)
def load_model(source: str) -> BpeModel:
    return BpeModel(source)


def ship_vocabulary(spark: SparkSession, path: str) -> Callable[[], BpeModel]:
    """Read the vocabulary on the driver and broadcast it (a file of a few MB, whatever the data); workers parse it once."""
    with open(path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    return lambda: load_model(source.value)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded) of every text."""
    model = ship_vocabulary(docs.sparkSession, vocabulary)
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in text_slices(batches, text):
            ids, at = m.encode(b.column(text).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            decoded = pa.array([m.decode(ids[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.string())
            yield pa.record_batch([b.column(key), lists, decoded], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, schema)


def token_digests(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and keeps digests only."""
    model = ship_vocabulary(docs.sparkSession, vocabulary)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for b in text_slices(batches, text):
            ids, at = m.encode(b.column(text).to_pylist())
            each = [ids[x:y] for x, y in zip(at, at[1:], strict=False)]
            digest = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]
            back = [hashlib.sha256(m.decode(x).encode()).hexdigest() for x in each]
            yield pa.record_batch([b.column(key), pa.array(np.diff(at)), pa.array(digest, pa.string()), pa.array(back, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, schema)
