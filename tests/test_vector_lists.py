"""Inverted lists: recall, exactness, and which files a search reads."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import search as S
from quarry.sources.vector_lists import VectorLists, fitted, nearest_each, recall

SF = "/root/testdata/sf0.01"


def clustered(spark, n=4000, centers=40, dim=16):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(centers, dim))
    x = c[rng.integers(centers, size=n)] + 0.15 * rng.normal(size=(n, dim))
    rows = [(i, i // 3, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    vectors = clustered(spark).cache()
    return vectors, VectorLists(spark, str(tmp_path_factory.mktemp("lists") / "v")).build(vectors, part_rows=60)


def asked(vectors):
    return vectors.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def test_every_vector_is_in_one_list(made):
    vectors, lists = made
    held = lists.vectors()
    assert held.count() == vectors.count() == held.select("chunk_id").distinct().count()
    assert sum(r["n"] for r in lists.lists()) == vectors.count()
    assert held.groupBy("list", "part").count().agg(F.max("count")).first()[0] <= 150
    assert {r["parts"] for r in lists.lists()} != {1}


def test_recall_with_few_lists(made):
    vectors, lists = made
    assert lists.probes() <= 0.5 * len(lists.lists())
    got = recall(lists.near_each(asked(vectors)), nearest_each(vectors, asked(vectors))).first()
    assert got.queries == 40 and got.recall >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_over_the_table_of_embeddings(spark, tmp_path):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"), "embedding")
    lists = VectorLists(spark, str(tmp_path / "v")).build(vectors)
    assert recall(lists.near_each(asked(vectors)), nearest_each(vectors, asked(vectors))).first().recall >= 0.9


def test_exact_search_equals_brute_force(made, spark):
    vectors, lists = made
    for q in [r.embedding for r in asked(vectors).limit(4).collect()] + [[1.0] * 16]:
        for probes in (1, None):
            want = [tuple(r) for r in S.knn(vectors, q, 30).collect()]
            assert [tuple(r) for r in lists.nearest(q, 30, probes).orderBy(F.desc("score"), "chunk_id").collect()] == want
    allowed = spark.createDataFrame([(i,) for i in range(0, 1300, 17)], "doc_id long")
    q = vectors.where("chunk_id = 0").first().embedding
    assert {tuple(r) for r in lists.nearest(q, 20, 1, allowed).collect()} == {tuple(r) for r in S.knn(vectors, q, 20, allowed).collect()}
    assert lists.nearest(q, 20, 1, allowed.limit(0)).collect() == []


def test_other_lists_are_not_read(made):
    vectors, lists = made
    q = vectors.where("chunk_id = 0").first().embedding
    near = lists.near(q, 10, 3)
    near.collect()
    leaf = near._jdf.queryExecution().executedPlan().collectLeaves().head()
    chosen = {name for *_, name in lists._order(q)[:3]}
    parts = sum(r["parts"] for r in lists.lists() if r["list"] in chosen)
    assert leaf.metrics().apply("numFiles").value() == parts < len(lists.vectors().inputFiles())
    assert leaf.metrics().apply("numOutputRows").value() == sum(r["n"] for r in lists.lists() if r["list"] in chosen)


def test_batches_equal_single_searches(made):
    vectors, lists = made
    some = asked(vectors).limit(3)
    got = {}
    for r in lists.near_each(some, 15).collect():
        got.setdefault(r.query_id, set()).add((r.chunk_id, r.score))
    for r in some.collect():
        assert got[r.query_id] == {(x.chunk_id, x.score) for x in lists.near(r.embedding, 15).collect()}


def test_odd_vectors(spark, tmp_path):
    rows = [(1, 1, [0.0, 0.0]), (2, 1, None), (3, 1, [1.0, 0.0]), (4, 2, [1.0, 0.0]), (5, 2, [0.0, 2.0])]
    lists = VectorLists(spark, str(tmp_path / "v")).build(spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<float>"))
    assert [r.chunk_id for r in lists.nearest([3.0, 0.0], 2).collect()] == [3, 4]
    empty = VectorLists(spark, str(tmp_path / "e")).build(spark.createDataFrame([], "chunk_id long, doc_id long, embedding array<float>"))
    assert empty.nearest([1.0, 0.0]).collect() == [] and empty.near([1.0, 0.0]).collect() == []


def test_fitting_equal_vectors():
    assert np.allclose(fitted(np.tile([[1.0, 0.0]], (9, 1)), 4), [[1.0, 0.0]] * 4)


def test_encoder_counts_words():
    a, b, c, none = V.hashing_encoder()(["Alpha beta alpha", "beta ALPHA\nalpha", "gamma", ""])
    assert np.array_equal(a, b) and not np.array_equal(a, c) and abs(float((a * a).sum()) - 1) < 1e-6 and not none.any()
    assert V.embedded("beta alpha alpha", V.hashing_encoder) == [float(x) for x in a]


def test_lists_are_bounded_and_batches_meet_slice_by_slice(made, spark, tmp_path, monkeypatch):
    from quarry.sources import vector_lists

    vectors, _ = made
    monkeypatch.setattr(vector_lists, "MOST_LISTS", 5)
    monkeypatch.setattr(vector_lists, "PART_ROWS", 900)
    monkeypatch.setattr(vector_lists, "QUESTIONS", 7)
    monkeypatch.setattr(vector_lists, "BLOCK", 3000)
    lists = VectorLists(spark, str(tmp_path / "v")).build(vectors)
    assert len(lists.lists()) <= 5 and lists.vectors().count() == vectors.count()
    some = asked(vectors)
    best = lambda df: {(r.query_id, r.chunk_id, r.score) for r in df.collect()}
    want = {(q.query_id, r.chunk_id, r.score) for q in some.limit(3).collect() for r in S.knn(vectors, q.embedding, 20).collect()}
    every = best(lists.near_each(some, 20, probes=5))
    assert every == best(nearest_each(vectors, some, 20)) and want <= every
    assert "CoGroup" in nearest_each(vectors, some, 20)._jdf.queryExecution().executedPlan().toString()
