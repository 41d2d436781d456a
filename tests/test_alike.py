"""Vectors compared in blocks: what is found, and that no pair or trigram is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from chronofact.operators import resolve


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).tolist()
    x[7] = x[11] = x[30] = x[5]  # copies tie, and the least ids are taken
    x[9] = None
    v = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    asked = v.where("id % 5 = 0 OR id = 9").select(F.col("id").alias("query"), F.col("v").alias("q"))
    monkeypatch.setattr(resolve, "BLOCK", 4)
    monkeypatch.setattr(resolve, "VECTOR_BLOCK", 7)
    found = resolve.nearest(asked, v, 3)
    assert "Join" not in plan(found)
    got = {(r.query, r.place): r.id for r in found.collect()}
    own = [None if r is None else np.array(r) / np.linalg.norm(r) for r in x]
    for q in [r.query for r in asked.collect()]:
        score = lambda i: 9.0 if own[i] is None or own[q] is None else -round(float(own[q] @ own[i]), 12)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (score(i), i))[:3]
        assert [got[q, p] for p in (1, 2, 3)] == want


def test_vectors_shuffle_texts_alone(spark):
    rows = spark.createDataFrame([(1, "Müller"), (1, "b"), (2, None)], "id long, t string")
    made = resolve.embed(rows, "id", "t")
    assert plan(made).count("Aggregate") == 1 and "Window" not in plan(made)
    assert {r.id for r in made.collect()} == {1, 2}


def test_similar_texts(spark, monkeypatch):
    names = [f"Customer#{i:09d}" for i in range(0, 4000, 37)] + ["red bolt"] * 5 + ["", None, "Red Bolt "]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, text string").cache()
    asked = rows.where("id % 4 = 0").withColumnRenamed("id", "query")
    v = resolve.embed(rows, "id", "text").cache()
    q = resolve.embed(asked, "query", "text")
    monkeypatch.setattr(resolve, "BLOCK", 16)
    for least in (0.5, 0.8, 0.95):
        full = {(x.query, x.id): round(x.similarity, 9) for x in resolve.cosine(q, v, least - 1e-9).collect()}
        found = resolve.similar_texts(asked, rows, least)
        assert {(x.query, x.id): round(x.similarity, 9) for x in found.collect()} == full
        assert found.count() == len(full)


def test_different_texts_of_one_vector(spark):
    rows = spark.createDataFrame([(1, "Customer#000000100"), (2, "Customer#000001000")], "id long, text string")
    found = resolve.similar_texts(rows.withColumnRenamed("id", "query"), rows, 0.9)
    assert sorted((r.query, r.id) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_copies_are_paired_in_their_task(spark, monkeypatch):
    """Whatever they are cut into; and no pairs are joined to names."""
    monkeypatch.setattr(resolve, "MEMBERS", 3)
    monkeypatch.setattr(resolve, "QUERIES", 2)
    rows = spark.createDataFrame([(i, ["red bolt", "red bolts", "ring"][i % 3]) for i in range(40)], "id long, text string")
    found = resolve.similar_texts(rows.where("id < 20").withColumnRenamed("id", "query"), rows, 0.5)
    assert plan(found).startswith("FlatMapCoGroups")
    got = [(r.query, r.id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(q, i) for q in range(20) for i in range(40) if (q % 3 == 2) == (i % 3 == 2)}
