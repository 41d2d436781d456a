"""Communities of high modularity against plain Python and against every partition of small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronofact.operators import graph, modularity


def quality(edges, community):
    m = len(edges)
    degree, inside = {}, 0
    for a, b in edges:
        for x in (a, b):
            degree[community[x]] = degree.get(community[x], 0) + 1
        inside += community[a] == community[b]
    return inside / m - sum((d / 2 / m) ** 2 for d in degree.values())


def table(spark, edges):
    return spark.createDataFrame([(f"e{i}", a, b) for i, (a, b) in enumerate(edges)], "id string, src string, dst string")


def found(spark, edges, **how):
    return {r.node: r.community for r in graph.communities(table(spark, edges), "modularity", **how).collect()}


def clique(prefix, n):
    return list(itertools.combinations([f"{prefix}{i}" for i in range(n)], 2))


def together(edges, community):
    """Whether each community is connected."""
    for c in set(community.values()):
        members = {n for n, x in community.items() if x == c}
        reached, front = set(), [min(members)]
        while front:
            n = front.pop()
            reached.add(n)
            front += [b for a, b in [*edges, *[(b, a) for a, b in edges]] if a == n and b in members - reached]
        if reached != members:
            return False
    return True


def test_joined_cliques_come_apart(spark):
    edges = clique("a", 5) + clique("b", 5) + [("a0", "b0"), ("a0", "a0"), ("lone", "lone")]
    got = found(spark, edges)
    assert got == {n: n[0] + "0" for n in got} and len(got) == 10
    rows = graph.clusters(table(spark, edges), member_limit=2, method="modularity").collect()
    assert sorted((r.community, r.size, r.members, r.total) for r in rows) == [("a0", 5, ["a0", "a1"], 2), ("b0", 5, ["b0", "b1"], 2)]
    with pytest.raises(ValueError, match="method"):
        graph.communities(table(spark, edges), "louvian")
    with pytest.raises(ValueError, match="member_limit"):
        graph.clusters(table(spark, edges), member_limit=0)
    assert found(spark, [("x", "x")]) == {} and found(spark, [("x", "y")]) == {"x": "x", "y": "x"}


def test_parallel_edges_weigh_in_a_multigraph(spark):
    edges = [("a", "b")] * 9 + [("b", "c"), ("c", "d"), ("d", "a")] + [("c", "d")] * 9
    assert found(spark, edges, multigraph=True) == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_ring_of_cliques(spark):
    """Better than labels, connected, near the best that is known: each clique for itself."""
    edges = [e for k in range(12) for e in clique(f"{chr(97 + k)}", 4)] + [(f"{chr(97 + k)}0", f"{chr(97 + (k + 1) % 12)}1") for k in range(12)]
    got = found(spark, edges)
    labels = {r.node: r.community for r in graph.communities(table(spark, edges)).collect()}
    assert quality(edges, got) >= quality(edges, labels) - 1e-9
    assert quality(edges, got) >= quality(edges, {n: n[0] for n in got}) - 0.02 and together(edges, got)
    assert got == found(spark, edges[::-1])  # whatever the order of rows


def test_modularity_is_that_of_the_definition(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}") for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    community = {n: n[-1] for e in edges for n in e}
    members = spark.createDataFrame(list(community.items()), "node string, community string")
    got = modularity.modularity(modularity.weighted(table(spark, edges)), members).first()[0]
    assert got == pytest.approx(quality(edges, community))
    best = found(spark, edges, multigraph=True)
    labels = {r.node: r.community for r in graph.communities(table(spark, edges)).collect()}
    assert quality(edges, best) >= max(quality(edges, labels), quality(edges, community)) and together(edges, best)
    assert modularity.modularity(modularity.weighted(table(spark, []).where(F.lit(False))), members).first()[0] is None


def test_small_graphs_against_all_partitions(spark):
    """Within a little of the best of all partitions."""
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("f", "g")]
    nodes = sorted({n for e in edges for n in e})
    best = max(quality(edges, dict(zip(nodes, p))) for p in itertools.product(range(4), repeat=len(nodes)))
    assert quality(edges, found(spark, edges)) >= best - 0.03
