"""Recall of the stored index against all vectors, blocks of a hot cell, and what has no direction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.operators import resolve, vector_index
from chronofact.operators.vector_index import VectorIndex

SF = "/root/testdata/sf0.01"


def exact(vectors, asked, k):
    norm = lambda x: x / np.linalg.norm(x)
    ids = sorted(vectors)
    x = np.stack([norm(vectors[i]) for i in ids])
    out = {}
    for i in asked:
        s = x @ norm(vectors[i])
        out[i] = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[j], 12), ids[j])) if ids[j] != i][:k]
    return out


def recall(spark, vectors, asked, k=5, index=None, **how):
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors.items()], "id long, v array<double>")
    index = index or VectorIndex.build(df)
    found = index.search(df.where(F.col("id").isin(asked)).select(F.col("id").alias("query"), F.col("v").alias("q")), k, **how).collect()
    want = exact(vectors, asked, k)
    got = {i: [r.id for r in sorted(found, key=lambda r: r.place) if r.query == i] for i in asked}
    assert all(len(g) <= k and i not in g for i, g in got.items())
    return sum(len(set(got[i]) & set(want[i])) for i in asked) / sum(len(w) for w in want.values())


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    index = VectorIndex.build(v)
    got = {(r.query, r.id): r.similarity for r in index.search(asked).collect()}
    want = {(r.query, r.id): r.similarity for r in resolve.nearest(asked, v, 5).collect()}
    both = set(got) & set(want)
    assert len(both) >= 0.9 * len(want) and all(got[p] == pytest.approx(want[p]) for p in both)
    assert index.rows().count() == v.count()
    again = VectorIndex(spark, index.path)  # as it is stored
    assert {(r.query, r.id) for r in again.search(asked).collect()} == set(got)


def test_recall_among_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    vectors = {i: centres[i % 40] + rng.normal(size=24) * 0.4 for i in range(4000)}
    vectors |= {i: vectors[7] * (i - 3990) for i in range(4001, 5500)}  # one direction: a third of them in one cell
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 200)
    asked = list(range(0, 4000, 80))
    assert recall(spark, vectors, asked) >= 0.9


def test_what_has_no_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [None, 1.0]), (9, [-1.0, 0.0]), (2, [0.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(df)
    got = index.search(df.select(F.col("id").alias("query"), F.col("v").alias("q"))).collect()
    assert {r.query for r in got} == {1, 2, 6, 9}
    assert [r.id for r in sorted(got, key=lambda r: r.place) if r.query == 1][:2] == [6, 2]
    empty = VectorIndex.build(df.limit(0))
    assert empty.search(df.select(F.col("id").alias("query"), F.col("v").alias("q"))).count() == 0
