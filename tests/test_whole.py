"""Queries do the whole job: the cases that a shorter run, a part of the rows or a first match would get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import graph, resolve
from chronofact.plans import catalog


def edge_rows(spark, pairs):
    return spark.createDataFrame([(f"e{i}", a, b, "p", 1.0) for i, (a, b) in enumerate(pairs)], "id string, src string, dst string, predicate_id string, confidence double")


def test_pagerank_converges(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(8)] + [("n00", f"leaf{i}") for i in range(5)] + [("n00", "n01")]
    names = sorted({x for p in pairs for x in p}) + ["alone1", "alone2"]
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    links = np.zeros((n, n))
    for a, b in pairs:
        links[at[b], at[a]] += 1
        links[at[a], at[b]] += 1
    degree = links.sum(axis=0)
    step = np.where(degree > 0, links / np.maximum(degree, 1), 1 / n)
    exact = np.linalg.solve(np.eye(n) - 0.85 * step, np.full(n, 0.15 / n))
    nodes = spark.createDataFrame([(x,) for x in names], "node string")
    got = {r.node: r.pagerank for r in graph.pagerank(edge_rows(spark, pairs), nodes).collect()}
    assert got == pytest.approx(dict(zip(names, exact, strict=True)), abs=1e-7)
    assert sum(got.values()) == pytest.approx(1, abs=1e-6)


def brute_labels(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    last = before = {x: x for x in near}
    while True:
        votes = {x: [last[y] for y in near[x]] for x in near}
        now = {x: min(v, key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
        if now in (last, before):
            return {x: (min(now[x], last[x]), now[x] == last[x]) for x in near}
        before, last = last, now


def test_converged_query(spark, whole):
    """The query's ranks solve the equations of the fixture's graph, parallel edges and all live entities counted."""
    names = sorted(r.id for r in whole.entities.collect())
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    links = np.zeros((n, n))
    for a, _, b in EDGES:
        links[at[b], at[a]] += 1
        links[at[a], at[b]] += 1
    degree = links.sum(axis=0)
    exact = np.linalg.solve(np.eye(n) - 0.85 * np.where(degree > 0, links / np.maximum(degree, 1), 1 / n), np.full(n, 0.15 / n))
    got = {r.node: r.pagerank for r in catalog.converged_pagerank(spark, "", whole).collect()}
    assert got == pytest.approx(dict(zip(names, exact, strict=True)), abs=1e-7)


def test_labels_settle(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)]  # the least label takes a round for each hop
    pairs += [(f"l{i}", f"r{j}") for i in range(4) for j in range(4)]
    got = {r.node: (r.community, r.settled) for r in graph.communities(edge_rows(spark, pairs)).collect()}
    assert got == brute_labels(pairs)


def test_community_ranks(spark):
    rows = [(f"x{i:04d}", "big" if i % 10 else f"c{i % 7}", (i * 37 % 101) / 101) for i in range(3000)]
    scored = spark.createDataFrame(rows, "node string, community string, pagerank double")
    got = {r.node: r.community_rank for r in graph.community_ranks(scored).collect()}
    place, expected = {}, {}
    for x, c, _ in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        expected[x] = place[c] = place.get(c, 0) + 1
    assert got == expected


EDGES = [
    ("customer:1", "located_in", "nation:0"), ("customer:2", "located_in", "nation:0"), ("supplier:1", "located_in", "nation:1"), ("nation:0", "part_of", "region:0"), ("nation:1", "part_of", "region:0"),
    ("order:1", "placed_by", "customer:1"), ("order:2", "placed_by", "customer:2"), ("order:1", "contains", "part:1"), ("order:2", "contains", "part:1"), ("order:2", "contains", "part:2"), ("order:2", "supplied_by", "supplier:1"),
]


@pytest.fixture(scope="module")
def whole(spark):
    """A store of entity statements, and entities with labels."""
    said = spark.createDataFrame(EDGES, "subject_id string, predicate_id string, object_id string")
    given = {"id": F.concat_ws("|", "predicate_id", "subject_id", "object_id"), "value_type": F.lit("entity"), "rank": F.lit("normal"), "confidence": F.lit(1.0), "origin": F.lit("asserted")}
    said = said.select(*[given.get(c, F.col(c) if c in said.columns else F.lit(None)).cast(t).alias(c) for c, t in model.STATEMENT.items()])
    ids = sorted({x for s, _, o in EDGES for x in (s, o)})
    entities = spark.createDataFrame([(x, x.split(":")[0].title(), x.replace(":", " house "), None) for x in ids], "id string, type_id string, label string, merged_into string")
    types, implements, predicates = model.vocabulary(spark)
    return model.Store(entities, said, None, None, None, types, implements, predicates)


def brute_betweenness(pairs):
    """By the definition: the share of shortest paths between each two others that run through a node."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    far, ways = {}, {}
    for s in near:
        far[s], ways[s], front = {s: 0}, {s: 1}, [s]
        while front:
            fresh = []
            for x in front:
                for y in near[x]:
                    if y not in far[s]:
                        far[s][y], ways[s][y] = far[s][x] + 1, 0
                        fresh.append(y)
                    if far[s][y] == far[s][x] + 1:
                        ways[s][y] += ways[s][x]
            front = fresh
    return {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in near for t in far[s] if s < t and v not in (s, t) and v in far[s] and far[s][v] + far[v][t] == far[s][t]) for v in near}


def test_betweenness_of_all(spark, whole):
    got = {r.node: r.betweenness for r in catalog.betweenness(spark, "", whole).collect()}
    assert got == pytest.approx(brute_betweenness([(s, o) for s, _, o in EDGES]))


def test_betweenness_by_joins(spark, whole):
    """Beyond the pairs that a task may hold, the same of all nodes and of a sample."""
    e = graph.edges(whole)
    some = spark.createDataFrame([("order:1",), ("region:0",), ("order:1",), ("nobody",)], "node string")
    for sources in (None, some):
        held, joined = ({r.node: r.betweenness for r in graph.betweenness(e, sources, n).collect()} for n in (graph.HELD_PAIRS, 0))
        assert held == pytest.approx(joined)
    empty = edge_rows(spark, [("x", "x")])
    assert not graph.betweenness(empty).collect() and not graph.betweenness(empty, None, 0).collect()


def test_betweenness_of_long_paths(spark):
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(53)]
    got = {r.node: r.betweenness for r in graph.betweenness(edge_rows(spark, pairs), spark.createDataFrame([("n00",)], "node string")).collect()}
    assert got["n01"] == 26 and got["n52"] == 0.5 and got["n53"] == 0


def test_clusters_of_all(spark, whole):
    got = {x for r in catalog.clusters(spark, "", whole).collect() for x in r.members}
    labels = brute_labels([(s, o) for s, _, o in EDGES])
    sizes = [c for c, _ in labels.values()]
    assert got == {x for x, (c, _) in labels.items() if sizes.count(c) >= 2} and any(x.startswith("part:") for x in got)


def test_candidates_of_all_stages(spark, whole):
    rows = spark.createDataFrame([(1, "Agent", "HOUSE 1", None), (2, "Agent", "customer house 1", None), (3, "Agent", "2", None), (4, "Agent", "unheard", None), (5, "Part", "house", None)], "ref long, type_id string, label string, key string")
    got = {(r.ref, r.id): (r.method, r.similarity is None) for r in resolve.candidates(whole, rows, least=0.95).collect()}
    agents = {x for x in ("customer:1", "customer:2", "supplier:1")}
    assert {i for r, i in got if r == 1} == agents - {"customer:2"} and got[1, "customer:1"] == ("substring", True)
    assert got[2, "customer:1"] == ("label", False) and got[3, "customer:2"] == ("substring", True)
    assert got[4, None] == ("new", True) and {i for r, i in got if r == 5} == {"part:1", "part:2"}
    gone = whole.entities.select("id", "type_id", "label", F.when(F.col("id") == "customer:1", "customer:2").alias("merged_into"))
    named = whole.statements.limit(1).select(*[{"subject_id": F.lit("customer:1"), "predicate_id": F.lit("name"), "value_text": F.lit("Own")}.get(c, F.col(c)).alias(c) for c in whole.statements.columns])
    store = model.Store(gone, named, None, None, None, whole.types, whole.implements, whole.predicates)
    asked = spark.createDataFrame([(1, "Agent", "nothing alike", "Own")], "ref long, type_id string, label string, key string")
    assert resolve.resolve(store, asked).first().method == "new"
