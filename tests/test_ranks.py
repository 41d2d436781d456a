"""PageRank on codes of names."""

import pytest
from pyspark.sql import functions as F

from chronofact.operators import graph

EDGES = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "x"), ("d", None)]


def ranks(spark, rounds):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("e",), (None,)], "node string")
    return sorted((r.node or "", round(r.pagerank, 9)) for r in graph.pagerank(e, nodes, rounds).collect())


def test_rounds_and_shared_codes(spark, monkeypatch):
    usual = ranks(spark, 2)
    assert [x for x, _ in usual] == ["", "a", "b", "c", "d", "e", "e"]
    n, r = 7, dict.fromkeys("abcde", 1 / 7)
    d = {"a": 2, "b": 3, "c": 4, "d": 1}
    for _ in range(2):
        lost = 2 * r["e"] + r.get("", 1 / 7)
        got = {"a": 2 * r["b"] / 3, "b": 2 * r["a"] / 2 + r["c"] / 4, "c": r["b"] / 3 + 2 * r["c"] / 4}
        r = {x: 0.15 / n + 0.85 * (got.get(x, 0) + lost / n) for x in ["", *"abcde"]}
    assert dict(usual) == pytest.approx(r, abs=1e-8)
    monkeypatch.setattr(graph, "_code", lambda node: F.col(node).isNotNull().cast("long"))  # all names share one
    assert ranks(spark, 2) == usual


def test_links_stay_in_place(spark):
    """A round shuffles what nodes get, and no links to meet the ranks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from chronofact.session import bucketed

        links = bucketed(spark, spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), "links", "a")
        own = spark.createDataFrame([(1, 1, 1, 0.5), (2, 1, 1, 0.5)], "c long, d long, copies long, r double")
        plan = graph._received(links, own)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(a#") == 1  # that of the ranks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_round_shuffles_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(graph, "in_buckets", lambda s, df, name, key: (plans.append((name, df)), graph.bucketed(s, df, name, key))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "c"), ("d", "e")], "src string, dst string")
        graph.pagerank(e, spark.createDataFrame([(x,) for x in "abcdef"], "node string")).collect()
        graph.communities(e).collect()
        for name in ("ranks", "labels"):
            last = [df for n, df in plans if n == name][-1]
            assert str(last._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("Exchange ") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hub_has_its_links_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "LINKS_IN_ROW", 4)
    ways = spark.createDataFrame([(0, i % 30) for i in range(1, 60)], "a long, b long")
    for simple, most in ((False, 4), (True, 4)):
        rows = graph.grouped_links(spark, ways, simple).collect()
        assert max(len(r.bs) for r in rows) <= most
        got = sorted((r.a, b) for r in rows for b in r.bs)
        both = [x for i in range(1, 60) for x in ((0, i % 30), (i % 30, 0))]
        assert got == sorted(set(both) if simple else both)
