"""The inverted lists against all pairs; the kept graph and its rebuild for some sources."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from docloom.operators import graph, partition_index, vectors
from docloom.sources.store import Kept, state_of

CHUNKS = "document_id long, chunk_index long, embedding array<double>"


def groups(n_groups=40, size=25, dim=24, seed=0):
    """Vectors around some directions, one of which has a third of all; a zero vector and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, dim))
    own = [centres[0 if i % 3 == 0 else i % n_groups] + 0.25 * rng.normal(size=dim) for i in range(n_groups * size)]
    own[10] = own[11] = own[500]
    own[12] = np.zeros(dim)
    return [(i // 5, i % 5, [float(x) for x in v]) for i, v in enumerate(own)]


def rows(df):
    return sorted((r.src, r.src_chunk, r.dst, r.dst_chunk, round(r.distance, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(groups(), CHUNKS).cache()


def test_lists_hold_every_row_and_find_the_nearest(chunks):
    index = partition_index.build(chunks, block=64)
    assert index.rows.count() == chunks.count() and 20 <= index.lists.count() <= 32
    assert partition_index.recall(index, chunks, probes=6) >= 0.95
    assert partition_index.recall(index, chunks, probes=1) < 1
    assert partition_index.recall(index, chunks, probes=10_000) == 1


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_mode_equals_all_pairs(chunks, probes):
    index = partition_index.build(chunks, block=64)
    assert rows(partition_index.search(index, chunks, probes=probes, exact=True)) == rows(vectors.neighbours(chunks, block=200))


def test_probes_shuffle_copies_of_queries_not_pairs(chunks):
    index = partition_index.build(chunks)
    assert partition_index._wanted(index, chunks, 4, False).count() == 4 * chunks.count()
    bound = chunks.withColumn("reach", F.lit(1e-6))
    assert partition_index._wanted(index, bound, 4, True).count() < 4 * chunks.count()  # a close k-th chunk rules lists out


def test_empty_and_few(spark):
    none = spark.createDataFrame([], CHUNKS)
    assert partition_index.search(partition_index.build(none), none).collect() == []
    two = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], CHUNKS)
    assert rows(partition_index.search(partition_index.build(two), two, exact=True)) == [(1, 0, 2, 0, 1.0), (2, 0, 1, 0, 1.0)]


def test_nearest_to_some_equals_all(chunks):
    some = chunks.where("document_id % 7 = 2")
    want = [r for r in rows(vectors.neighbours(chunks)) if r[0] % 7 == 2]
    assert rows(vectors.nearest_to(some, chunks, block=100)) == want


def files(kept):
    out = {}
    for b, folder in kept.current()["folders"].items():
        folder = folder.removeprefix("file:")
        out[b] = {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".parquet")}
    return out


def test_rebuild_replaces_some_sources_only(spark, chunks):
    kept = Kept(spark, "test-edges", "src", buckets=8)
    assert kept.current() is None
    before = kept.build("one", graph.build_edges(chunks)).collect()
    assert sorted(before) == sorted(graph.build_edges(chunks).collect())
    old_files = files(kept)
    changed = chunks.where("document_id not in (3, 8) or chunk_index < 2").unionByName(chunks.where("document_id = 5").select(F.lit(900).cast("long").alias("document_id"), "chunk_index", "embedding"))
    sources = spark.createDataFrame([(3,), (8,), (900,)], "id long")
    after = graph.rebuild_edges(kept, sources, changed, "two").collect()
    full = graph.build_edges(changed).collect()
    own = {3, 8, 900}
    assert sorted(r for r in after if r.src in own) == sorted(r for r in full if r.src in own)
    assert sorted(r for r in after if r.src not in own) == sorted(r for r in before if r.src not in own)
    touched = {str(r.b) for r in sources.select(kept.bucket("id").alias("b")).collect()}
    new_files = files(kept)
    assert 0 < len(touched) < 8 and all(new_files[b] == old_files[b] for b in old_files if b not in touched)
    assert kept.current()["state"] == "two"


def test_a_source_without_rows_and_a_fork(spark):
    kept = Kept(spark, "test-fork", "src", buckets=4)
    df = spark.createDataFrame([(i, i) for i in range(20)], "src long, v long")
    kept.build("s", df)
    fork = kept.fork("test-forked")
    fork.replace("t", spark.createDataFrame([(3,), (77,)], "id long"), df.limit(0))
    assert {r.src for r in fork.read().collect()} == set(range(20)) - {3}
    assert kept.read().count() == 20


def test_state_follows_files_code_and_parameters(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    one = state_of([t], graph, "k=10")
    assert one == state_of([t], graph, "k=10") and one != state_of([t], graph, "k=5") and one != state_of([t], vectors, "k=10")
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t"))
    assert one != state_of([spark.read.parquet(str(tmp_path / "t"))], graph, "k=10")


def test_sweep_keeps_what_pointers_name(spark):
    kept = Kept(spark, "test-sweep", "src", buckets=1)
    df = spark.createDataFrame([(i, i) for i in range(10)], "src long, v long")
    kept.build("a", df)
    fork = kept.fork("test-sweep-fork")
    kept.replace("b", df.select("src").limit(3), df.limit(0))
    kept.replace("c", df.select("src").limit(5), df.limit(0))
    assert kept.sweep(3600) == 0 and kept.sweep(-10) == 1  # the fork still names the first folder
    assert fork.read().count() == 10 and kept.read().count() == 5
    assert kept.sweep(-10) == 0


def brute(one, two, k):
    """By all distances at once, ties by id."""
    far = np.round(1 - one.unit @ two.unit.T, 9)
    far[one.document[:, None] == two.document[None, :]] = np.inf
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    return sorted((one.document[i], one.chunk[i], two.document[j], two.chunk[j], far[i, j]) for i in range(len(one)) for j in order[i] if np.isfinite(far[i, j]))


@pytest.mark.parametrize("n, copies, k", [(2600, 0, 10), (2600, 1500, 10), (2200, 0, 40), (9, 0, 10)])
def test_tiles_of_blocks_equal_all_distances(n, copies, k):
    rng = np.random.default_rng(n + copies)
    x = rng.normal(size=(n, 12))
    x[rng.permutation(n)[:copies]] = x[0]
    x[3] = 0
    table = pa.table({"document_id": np.arange(n) // 5, "chunk_index": np.arange(n) % 5, "embedding": pa.array(list(x))})
    here = pa.array(rng.random(n) < 0.6)
    one, two = vectors.Block(table.filter(here)), vectors.Block(table.filter(pc.invert(here)))
    found = vectors.nearest_in(one, two, k, both=True).to_pylist()
    assert np.array(sorted(tuple(r.values()) for r in found)) == pytest.approx(np.array(sorted(brute(one, two, k) + brute(two, one, k))), rel=0, abs=2e-9)


def test_blocks_do_not_grow_in_number_with_the_chunks(spark):
    number = lambda df: vectors.blocks_of(df, vectors.BLOCK_ROWS)[0]
    wide = spark.range(7_000).select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"), F.array(F.lit(1.0), F.col("id") * 1.0).alias("embedding"))
    assert number(wide) == number(wide.crossJoin(spark.range(8).toDF("n"))) == vectors.BLOCKS
    assert number(wide.crossJoin(spark.range(200).toDF("n"))) == -(-1_400_000 // vectors.BLOCK_ROWS)  # bounded in memory beyond


@pytest.mark.parametrize("top", [1 << 10, 1 << 40])
def test_one_number_sorts_as_row_distance_and_column(top):
    rng = np.random.default_rng(top)
    i, j, d = rng.integers(0, 30, 4000), rng.integers(0, top, 4000), np.round(rng.choice([0, 1e-9, 0.3, 1.999999999, 2], 4000) + rng.integers(0, 2, 4000) * 0.0, 9)
    i[0], j[0] = 1 << 16, top
    order = np.lexsort((j, d, i))
    for got, want in zip(vectors.nearest_first(i, j, d), (i[order], j[order], d[order]), strict=True):
        assert (got == want).all()
    assert [len(x) for x in vectors.nearest_first(i[:0], j[:0], d[:0])] == [0, 0, 0]


def test_each_pair_of_blocks_is_a_task(chunks, monkeypatch):
    """Two pairs in one task would take twice as long as the others, and fewer partitions than cores would leave cores idle."""
    monkeypatch.setattr(vectors, "k_nearest", lambda met, k: met)
    tasks = lambda met: met.select(F.spark_partition_id()).distinct().count()
    assert tasks(vectors.neighbours(chunks, block=200)) == 5 * 6 // 2
    assert tasks(vectors.nearest_to(chunks.where("document_id < 100"), chunks, block=200)) == 3 * 5
