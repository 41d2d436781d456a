"""The nearest vectors of all vectors."""

import duckdb
import numpy as np

from chronofact.operators import resolve
from chronofact.plans import catalog

ROOT = "/root/testdata/sf0.001"


def test_every_vector_asks(spark):
    got = {(r.query, r.id): r.similarity for r in catalog.queries()["R2_nearest_vectors"](spark, ROOT).collect()}
    ids = {r[0] for r in duckdb.sql(f"SELECT vec_id FROM '{ROOT}/embeddings.parquet'").fetchall()}
    assert {q for q, _ in got} == ids and len(got) == 5 * len(ids)
    want = duckdb.sql(catalog.oracle_sql()["R2_nearest_vectors"].replace("embeddings", f"'{ROOT}/embeddings.parquet'")).fetchall()
    assert got == {(q, i): s for q, i, s in want}


def test_near_ties_in_single_precision(spark):
    """Vectors that differ by less than single precision tells, in more rows than are kept first."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(1, 8)), 700, axis=0) + rng.normal(size=(700, 8)) * 1e-8
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    asked = v.where("id % 100 = 0").toDF("query", "q")
    own = x / np.sqrt((x * x).sum(axis=1))[:, None]
    for r in resolve.nearest(asked, v, 2).collect():
        scores = (own[r.query] * own).sum(axis=1)
        order = sorted((i for i in range(700) if i != r.query), key=lambda i: (-scores[i], i))
        assert order[r.place - 1] == r.id


def test_blocks_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "VECTOR_BLOCK", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        v = spark.range(100).selectExpr("id", "array(double(id), 1d) AS v")
        rows = resolve.nearest(v.toDF("query", "q"), v, 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 200 and {r.query for r in rows} == set(range(100))
