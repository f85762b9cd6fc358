from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return bpe.BpeModel(f.read(), cache_words=50)


def test_ids_equal_the_library(model, library):
    rng = random.Random(1)
    letters = [*map(chr, range(0x250)), "Σ", "İ", "́", "各", "한", " ", "\x1c", "½", "Ⅷ", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", " ", "the", "aaa"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert model.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_long_words_and_batches(model, library):
    texts = ["a" * 20_000, None, "", " \n ", "abcabcabd" * 700, "Hello world"]
    ids, at = model.encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_digest_query_against_the_library(spark, library):
    rows = [(1, "It's 2024, été!", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "w " * 5000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.token_digests(df, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.token_digests(df.limit(0), PATH).count() == 0
    assert bpe.encode_documents(df.where("doc_id = 1"), PATH).first()["ids"] == library.encode(rows[0][1], add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_length_once(seed):
    rng = random.Random(seed)
    lengths = [min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(rng.choice([0, 1, 7, 400, 20_000]))] + [2049] * seed + [1365] * 30 * seed
    counts = Counter(lengths)
    runs = packing.plan(dict(counts), 4096)
    got: Counter = Counter()
    for r in runs:
        assert r.bins > 0 and r.used == sum(r.items) <= 4096
        for x in r.items:
            got[x] += r.bins
    assert got == counts
    if len(lengths) > 1000:
        halves = sum(1 for x in lengths if x > 2048)
        assert sum(r.bins for r in runs) <= 1.02 * max(halves, -(-sum(lengths) // 4096)) + 3


def test_pack_rows(spark, library):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "x1"]
    texts = ["", None, "one", " ".join(rng.choice(words) for _ in range(10_000))] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["same text here"] * 20
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack(df, PATH).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        for k, r in enumerate(own.itertuples()):
            assert (r.piece, r.start) == (k, 4096 * k)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
    assert packing.pack(df.limit(0), PATH).count() == 0
