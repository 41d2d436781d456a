"""Graphs in parts, and rounds on them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronofact.operators import graph, parts
from chronofact.plans import catalog
from chronofact.session import in_buckets


def test_values_reach_all_neighbours(spark):
    """Each node sums the codes of its neighbours, over parallel links and loops; a node that isn't given tells zero."""
    rng = random.Random(1)
    ways = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(300)] + [(7, 99)]
    nodes = spark.createDataFrame([(c, 2 * c) for c in range(-40, 41)], "c long, twice long")
    for simple in (False, True):
        held = parts.graph(spark, spark.createDataFrame(ways, "a long, b long"), nodes, len(ways), simple)
        first = in_buckets(spark, held.start(lambda p: p.round(p.own, p.given("twice"), [0.0])), "test", "part")

        def step(part, told):
            sums = np.array([told[part.at[i:j]].sum() for i, j in zip(part.starts, part.starts[1:])], dtype=np.int64)
            return part.round(sums, np.stack([sums, part.state(np.int64)[0]]), [float(len(part.own)), 1.0])

        last = in_buckets(spark, held.next(first, step, np.int64), "test", "part")
        assert parts.sums_of(last, 2)[0] == 81
        rows = held.rows(last, lambda p: pa.table({"c": p.own, "s": p.state(np.int64)[0], "t": p.state(np.int64)[1]}), "c long, s long, t long").collect()
        both = [x for a, b in ways for x in ((a, b), (b, a))]
        both = {(a, b) for a, b in both if a != b} if simple else both
        want = Counter()
        for a, b in both:
            want[b] += a if a != 99 else 0
        assert {r.c: (r.s, r.t) for r in rows} == {c: (want[c], 2 * c) for c in range(-40, 41)}


def test_commonest_label():
    rng = np.random.default_rng(2)
    rows, labels = np.append(rng.integers(0, 50, 400), np.arange(50)), rng.integers(0, 6, 450)
    want = []
    for r in range(50):
        counts = Counter(labels[rows == r].tolist())
        want.append(min(counts, key=lambda x: (-counts[x], x)))
    assert graph._commonest(rows, labels, 6).tolist() == want == graph._commonest(rows, labels, 2**62).tolist()


def test_names_that_share_a_code(spark, monkeypatch):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "c"), ("c", "x"), ("d", None)], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    found = lambda: ({r.node: round(r.pagerank, 9) for r in graph.pagerank(e, nodes).collect()}, sorted(map(tuple, graph.communities(e).collect())))
    usual = found()
    monkeypatch.setattr(graph, "_code", lambda node: F.when(F.col(node).isNotNull(), F.lit(1).cast("long")))
    assert found() == usual


def test_metrics_number_no_lines(spark, monkeypatch):
    """Ids of edges come from a window over all lines, which no measure needs."""
    kept, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda s, df, name: (kept.append((name, df)), stored(s, df, name))[1])
    got = catalog.queries()["G10_metrics"](spark, "/root/testdata/sf0.001")
    plan = next(df for name, df in kept if name == "edges")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Union" in plan
    assert set(got.columns) == {"node", "community", "settled", "pagerank", "degree", "community_rank", "x", "y"}
