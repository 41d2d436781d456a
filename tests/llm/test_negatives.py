import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row long, block string, score double"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 0.5) for r in rows], SCHEMA)


def brute(rows, anchors=lambda i: i is not None and i % 4 == 0, positives=5, negatives=10):
    """All inner products, in whole numbers; rows are told apart by their place."""
    ok = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(256 * float(np.float32(x))) for x in v)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a, (i, lab, v) in enumerate(ok):
        if not anchors(i):
            continue
        scored = [(max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), j, other == lab) for b, (j, other, w) in enumerate(ok) if b != a]
        for p, pid, _ in sorted((t for t in scored if t[2]), key=order)[:positives]:
            window = [t for t in scored if not t[2] and 30 * p <= 100 * t[0] <= 90 * p]
            for rank, (s, j, _) in enumerate(sorted(window, key=order)[:negatives], 1):
                out.append((i, pid, rank, j, p, s))
    return sorted(out, key=repr)


def mined(df):
    got = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_cases_that_any_table_may_hold(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.uniform(-0.2, 1) for _ in range(6)]) for i in range(60)]
    rows += [(i, i % 3, rows[4][2]) for i in range(60, 75)]  # ties
    rows += [(4, 1, rows[4][2]), (4, 2, rows[5][2]), (None, 1, rows[8][2]), (None, 2, rows[9][2])]
    rows += [(100, None, rows[0][2]), (101, 1, None), (104, 1, [1.0, None]), (108, 1, [math.nan] * 6), (112, 1, [math.inf] * 6), (116, 1, [3e38] * 6)]
    rows += [(120, 1, []), (124, 2, [0.5, 0.5]), (128, 0, [0.3] * 9), (132, 77, rows[0][2])]
    got = mined(table(spark, rows))
    assert got == brute(rows) and len(got) > 500
    assert mined(table(spark, [])) == [] and mined(table(spark, [(0, 1, [1.0]), (4, 1, [1.0])])) == []


def test_scores_beyond_doubles(spark):
    rows = [(0, 1, [2.0**20, 2.0**20 + 8]), (1, 1, [2.0**20, 2.0**21]), (2, 0, [2.0**19, 2.0**20]), (3, 0, [2.0**19, 2.0**20 - 0.0625]), (5, 2, [-1.0, 0.5])]
    assert mined(table(spark, rows)) == brute(rows) != []


@pytest.mark.parametrize("leaf", [2, 32])
def test_blocks_and_trees(spark, monkeypatch, leaf):
    """Many blocks of vectors and of queries give what one gives."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(int(i), int(i % 5), [float(x) for x in (centres[i % 5] + rng.normal(size=8) * 0.3)]) for i in range(400)]
    for name, value in (("BLOCK_ROWS", 60), ("LEAST", 7), ("QUERY_ROWS", 30), ("LEAF", leaf)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(table(spark, rows)) == brute(rows)


def test_bounds_leave_nodes_out_and_lose_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05))
    labels = rng.integers(0, 2, 2000)
    q, own = x[:40], labels[:40]
    score = (q @ x.T) * 1.0
    score[own[:, None] == labels[None, :]] = -np.inf
    low = np.full(40, 1000.0)
    high = score.max(axis=1) * 0.9
    found = negatives.Search(negatives.Tree(x, labels), q, np.arange(40), low, high, own, False, np.arange(40), 10)
    for i in range(40):
        fits = [(-s, j) for j, s in enumerate(score[i]) if low[i] <= s <= high[i]]
        assert [(-s, j) for s, j in zip(found.score[i], found.row[i]) if j >= 0 and s > -np.inf] == sorted(fits)[:10]
    assert found.visited < 40 * 2000 / 2  # bounds left most rows out
