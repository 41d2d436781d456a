"""A tram network made by rules of arithmetic; what operators find in it is compared with brute force in plain Python."""

import itertools
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import filters, graph, history, match, query, registry, resolve, write

STOPS, LINES, TOWNS = [f"stop{i}" for i in range(14)], [f"line{i}" for i in range(5)], [f"town{i}" for i in range(3)]
EARLY = "2011-03-01 00:00:00"


def _network():
    """(subject, predicate, object, what differs from the defaults)."""
    rows = []
    for i, line in enumerate(LINES):
        for k in range(14):
            if (3 * i + 5 * k) % 7 in (0, 3):
                rows.append((line, "serves", STOPS[k], {"confidence": round(0.3 + (i + k) % 8 / 10, 1)}))
    for k in range(14):
        rows.append((STOPS[k], "lies_in", TOWNS[(2 * k + k // 5) % 3], {}))
        if k != 8:
            rows.append((STOPS[k], "next_to", STOPS[(k + 1) % 14], {"valid_to": "2019-07-01 00:00:00"} if k == 3 else {}))
        if k % 4 == 1:
            rows.append((STOPS[k], "next_to", STOPS[(5 * k + 6) % 14], {"rank": "deprecated"} if k == 9 else {}))
    return rows


ROWS = _network()
TYPES = [("Spot", None, "continuant", True), ("Stop", "Spot", "continuant", False), ("Town", "Spot", "continuant", False), ("Line", None, "continuant", False), ("Trip", None, "occurrent", False)]
PREDICATES = [
    ("serves", "Line", None, "entity", "Stop", "n:m", False), ("lies_in", "Stop", None, "entity", "Town", "1:1", False), ("next_to", "Stop", None, "entity", "Stop", "n:m", False),
    ("name", None, "Nameable", "string", None, "1:1", True), ("fare", "Trip", None, "quantity", None, "n:m", False),
]
FARES = [(2.5, "EUR"), (4.25, "EUR"), (9.0, "CHF"), (1.125, "CHF")]


def said(predicate=None, least=0.0):
    """(subject, object) of visible rows."""
    return [(s, o) for s, p, o, more in ROWS if predicate in (None, p) and more.get("rank") != "deprecated" and more.get("confidence", 1.0) >= least]


def around(pairs):
    out = {}
    for a, b in pairs:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def all_shortest(near, a, b):
    """All shortest paths by breadth-first search over whole paths."""
    front = deque([[a]])
    found = []
    while front:
        path = front.popleft()
        if found and len(path) >= len(found[0]):
            break
        for x in sorted(near.get(path[-1], ())):
            if x == b:
                found.append([*path, x])
            elif x not in path:
                front.append([*path, x])
    return [p for p in found if len(p) == len(found[0])]


@pytest.fixture(scope="module")
def store(spark):
    rows = []
    for i, (s, p, o, more) in enumerate(ROWS):
        rows.append((f"r{i:03d}", s, p, "entity", o, None, None, None, more.get("rank", "normal"), more.get("confidence", 1.0), None, more.get("valid_to"), EARLY, None))
    for i, (number, unit) in enumerate(FARES):
        rows.append((f"f{i}", f"trip{i}", "fare", "quantity", None, None, number, unit, "normal", 1.0, None, None, EARLY, None))
    rows.append(("n1", "stop4", "name", "string", None, "Harbour", None, None, "normal", 1.0, None, None, EARLY, "2016-05-01 00:00:00"))
    rows.append(("n2", "stop4", "name", "string", None, "Old Harbour", None, None, "preferred", 1.0, None, None, "2016-05-01 00:00:00", None))
    schema = "id string, subject_id string, predicate_id string, value_type string, object_id string, value_text string, value_number double, value_unit string, rank string, confidence double, valid_from string, valid_to string, system_from string, system_to string"
    rows = spark.createDataFrame(rows, schema).withColumn("value_datetime", F.lit(None).cast("timestamp_ntz")).withColumn("origin", F.lit("asserted"))
    rows = rows.select(*[F.col(c).cast(t).alias(c) for c, t in model.STATEMENT.items()])
    kinds = [(x, "Stop") for x in STOPS] + [(x, "Line") for x in LINES] + [(x, "Town") for x in TOWNS]
    ents = [(x, t, f"{t} number {x[4:]}", None) for x, t in kinds] + [("stop4b", "Stop", "Stop number 4", "stop4"), ("stop4c", "Stop", None, "stop4b")] + [(f"trip{i}", "Trip", None, None) for i in range(4)]
    entities = spark.createDataFrame(ents, "id string, type_id string, label string, merged_into string").withColumn("created_at", F.lit(EARLY).cast("timestamp_ntz"))
    refs = rows.select(F.col("id").alias("statement_id"), F.lit("survey").alias("source_id"))
    sources = spark.createDataFrame([("survey", "field work"), ("map", "reading")], "id string, activity string").withColumn("retrieved_at", F.lit(EARLY).cast("timestamp_ntz"))
    quals = spark.createDataFrame([("r000", "metres", 120.0, "m")], "statement_id string, predicate_id string, value_number double, value_unit string")
    types = spark.createDataFrame(TYPES, "id string, parent_id string, kind string, abstract boolean")
    implements = spark.createDataFrame([("Spot", "Nameable")], "type_id string, interface_id string")
    preds = spark.createDataFrame(PREDICATES, "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean")
    return model.Store(entities, rows, quals, refs, sources, types, implements, preds)


def found(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_patterns(store):
    serves, inside = said("serves"), dict(said("lies_in"))
    for a, b in (("stop0", "stop6"), ("stop3", "stop10")):
        both = {x for x, o in serves if o == a} & {x for x, o in serves if o == b}
        assert found(match.match(store, [("?l", "serves", a), ("?l", "serves", b)], ["?l"]), "l") == both
    got = match.match(store, [("?l", "serves", "?a"), ("?a", "next_to", "?b"), ("?b", "lies_in", "?t")], ["?l", "?t"], min_confidence=0.7)
    expected = {(x, inside[b]) for x, a in said("serves", 0.7) for c, b in said("next_to") if c == a}
    assert expected and found(got, "l", "t") == expected
    assert found(match.match(store, [("stop2", "?p", "?x")], ["?p"]), "p") == {"lies_in", "next_to"}
    whole = sorted(x for x, o in serves if o == serves[0][1])
    pages = [match.page(match.match(store, [("?l", "serves", serves[0][1])], ["?l"]), 1, k).collect() for k in range(len(whole))]
    assert [p[0].l for p in pages] == whole and all(p[0].total == len(whole) for p in pages)
    assert match.match(store, [("?x", "next_to", "?x")], ["?x"]).count() == sum(a == b for a, b in said("next_to"))
    for bad, select in (([("?x", "?x", "stop1")], []), ([], []), ([("?x", "serves", "stop1")], ["?y"])):
        with pytest.raises(ValueError):
            match.check(bad, select)


def test_sets(store):
    at = lambda x: {"predicate_id": "serves", "object_id": x}
    lines = lambda x: {a for a, o in said("serves") if o == x}
    for a, b in itertools.combinations(STOPS[:5], 2):
        assert found(match.set_operation(store, "difference", [at(a), at(b)]), "id") == lines(a) - lines(b)
    assert found(match.set_operation(store, "intersect", [at("stop0"), at("stop7")]), "id") == lines("stop0") & lines("stop7")
    assert found(match.set_operation(store, "union", [at(x) for x in STOPS[:4]]), "id") == set().union(*map(lines, STOPS[:4]))
    with pytest.raises(ValueError, match="did you mean difference"):
        match.set_operation(store, "differ", [at("stop0"), at("stop1")])
    with pytest.raises(ValueError):
        match.set_operation(store, "union", [at("stop0")])


def test_time(store):
    tracks = lambda **w: found(query.matching(store, subject="stop3", predicate="next_to", **w), "object_id")
    assert "stop4" in tracks(valid_at="2019-06-30 00:00:00") and "stop4" not in tracks(valid_at="2019-07-01 00:00:00")  # half-open
    label = lambda **w: found(query.matching(store, subject="stop4", predicate="name", **w), "value_text")
    assert label() == {"Old Harbour"} and label(system_at="2012-01-01 00:00:00") == {"Harbour"} and label(system_at="2016-05-01 00:00:00") == {"Old Harbour"}
    assert found(history.label_changes(store.statements), "subject_id", "detail") == {("stop4", "Harbour → Old Harbour")}
    assert history.changes(store, "2016-05-01 00:00:00", "2016-05-01 00:00:00").count() == 1
    gone = sum(m.get("rank") == "deprecated" for *_, m in ROWS)
    assert history.changes(store, EARLY, EARLY, "deprecated").count() == query.matching(store, rank="deprecated").count() == gone > 0
    with pytest.raises(ValueError):
        filters.trusted(1.5)


def test_aggregates(store):
    sums = {r.unit: (r.value, r.n) for r in query.aggregate(store, "sum", predicate="fare").collect()}
    assert sums == {u: (sum(x for x, v in FARES if v == u), sum(v == u for _, v in FARES)) for u in ("EUR", "CHF")}
    assert query.aggregate(store, "count", predicate="fare").first().n == len(FARES)
    assert query.aggregate(store, "sum", "subject", predicate="fare").count() == len(FARES)
    with pytest.raises(ValueError):
        query.aggregate(store, "median")


def test_paths(store):
    near = around(said())
    for a, b in (("line0", "town2"), ("stop1", "stop11"), ("line1", "line4")):
        expected = all_shortest(near, a, b)
        rows = graph.shortest_paths(store, a, b).collect()
        assert expected and sorted(r.nodes for r in rows) == sorted(expected) and all(r.total == len(expected) and r.length == len(expected[0]) - 1 for r in rows)
    track = around(said("next_to"))
    expected = all_shortest(track, "stop0", "stop6")
    rows = graph.shortest_paths(store, "stop0", "stop6", predicates=["next_to"]).collect()
    assert sorted(r.nodes for r in rows) == sorted(expected)
    assert graph.shortest_paths(store, "stop0", "town1", predicates=["next_to"]).count() == 0
    assert graph.shortest_paths(store, "stop1", "stop1").first().length == 0
    assert graph.shortest_paths(store, "line1", "line4", max_paths=1).count() == 1
    real = {(s, o) for s, o in said()}
    for h in graph.path_edges(store, graph.shortest_paths(store, "line0", "town2")).collect():
        x, y = h.nodes[h.hop], h.nodes[h.hop + 1]
        assert (h.src, h.dst) in real and (h.src, h.dst) == ((x, y) if h.direction == "out" else (y, x))
    nearest = min(len(all_shortest(near, "line2", t)[0]) for t in TOWNS)
    assert len(graph.path_to_targets(store, "line2", TOWNS).first().nodes) == nearest
    nodes, inside = graph.neighborhood(store, "stop5", 1)
    own = near["stop5"] | {"stop5"}
    assert found(nodes, "node") == own and inside.count() == sum(a in own and b in own for a, b in said())
    ends = [x for pair in said() for x in set(pair)]
    assert {r.node: r.degree for r in nodes.collect()} == {x: ends.count(x) for x in own}


def test_neighbors(store):
    serves = said("serves")
    of = {x: {a for a, o in serves if o == x} for x in STOPS}
    ids = ["stop0", "stop2", "stop7"]
    got = {r.neighbor: r.shared_with for r in graph.common_neighbors(store, ids, ["serves"], "in", 2).collect()}
    assert got == {x: ",".join(i for i in ids if x in of[i]) for x in LINES if sum(x in of[i] for i in ids) >= 2}
    degrees = {r.id: r.degree for r in graph.degrees(graph.edges(store, ["serves"]), 2).collect()}
    assert all(degrees.get(x, 0) == len(of[x]) for x in STOPS)
    scores = {r.id: r.score for r in graph.similar(store, "stop0", ["serves"], "in").collect()}
    assert scores == pytest.approx({x: len(of[x] & of["stop0"]) / len(of[x] | of["stop0"]) for x in STOPS[1:] if of[x] & of["stop0"]})


def test_centrality(store):
    near = around(said("next_to"))
    expected = dict.fromkeys(near, 0.0)
    for a, b in itertools.combinations(sorted(near), 2):
        paths = all_shortest(near, a, b)
        for p in paths:
            for x in p[1:-1]:
                expected[x] += 1 / len(paths)
    got = {r.node: r.betweenness for r in graph.betweenness(graph.edges(store, ["next_to"])).collect()}
    assert got == pytest.approx({x: expected[x] for x in got}, abs=1e-9) and all(expected[x] == 0 for x in set(expected) - set(got))
    nodes = store.entities.where("merged_into IS NULL").select(F.col("id").alias("node"))
    names = sorted(r.node for r in nodes.collect())
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in said():
        m[at[a], at[b]] += 1
        m[at[b], at[a]] += 1
    out = m.sum(axis=1)
    m = np.where(out[:, None] > 0, m / np.maximum(out, 1)[:, None], 1 / len(names))
    r = np.full(len(names), 1 / len(names))
    for _ in range(400):
        r = 0.15 / len(names) + 0.85 * r @ m
    ranks = {x.node: x.pagerank for x in graph.pagerank(graph.edges(store), nodes).collect()}
    assert [ranks[x] for x in names] == pytest.approx(r.tolist(), abs=1e-7)
    groups = {x.node: (x.community, x.settled) for x in graph.communities(graph.edges(store)).collect()}
    near = around(said())
    for x, (c, settled) in groups.items():
        if settled and all(groups[y][1] for y in near[x]):
            votes = [groups[y][0] for y in [x, *near[x]]]
            assert c == min(set(votes), key=lambda v: (-votes.count(v), v))


def test_metrics(spark, store):
    measured = graph.metrics(store, rounds=3)
    rows = measured.collect()
    assert len(rows) == store.entities.where("merged_into IS NULL").count()
    for c in {r.community for r in rows}:
        own = sorted((r for r in rows if r.community == c), key=lambda r: (-r.pagerank, r.node))
        assert [r.community_rank for r in own] == list(range(1, len(own) + 1))
    assert graph.skeleton(measured, budget=5).count() == 5
    old = spark.createDataFrame([("stop4", 1.0, 2.0)], "node string, x double, y double")
    assert graph.metrics(store, old, rounds=1).where("node = 'stop4'").first().x == 1.0


def test_canonical(spark, store):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(20)] + [("x", "y"), ("y", "x")], "id string, merged_into string")
    got = {r.id: r.canonical_id for r in resolve.canonical_ids(chain, most_rounds=8).collect()}
    assert got == {f"n{i}": "n0" for i in range(1, 20)} | {"x": got["x"], "y": got["y"]}
    rows = spark.createDataFrame([("stop4c", "stop5"), ("stop4", "stop4b"), ("stop5", "stop5")], "subject_id string, object_id string")
    assert found(resolve.rewritten(rows, resolve.canonical_ids(store.entities)), "subject_id", "object_id") == {("stop4", "stop5"), ("stop5", "stop5")}


def test_resolution(spark, store):
    rows = spark.createDataFrame([(1, "Spot", "zzz", "Old Harbour"), (2, "Town", "TOWN NUMBER 1", None), (3, "Spot", "Town number 1!", None), (4, "Line", "Town number 1", None), (5, "Town", "unheard of", None)], "ref long, type_id string, label string, key string")
    got = {r.ref: (r.id, r.method) for r in resolve.resolve(store, rows, least=0.78).collect()}
    assert got == {1: ("stop4", "identifier"), 2: ("town1", "label"), 3: ("town1", "vector"), 4: (None, "new"), 5: (None, "new")}
    import hashlib

    def vector(text):
        t, v = f"  {text.strip().lower()}  ", {}
        for i in range(len(t) - 2):
            n = int.from_bytes(hashlib.sha1(t[i : i + 3].encode()).digest()[:8], "big")
            v[n % 1024] = v.get(n % 1024, 0) + (-1 if n >> 63 else 1)
        size = sum(x * x for x in v.values()) ** 0.5
        return {k: x / size for k, x in v.items() if x}

    texts = ["Müller", "日本", "", " a  b ", "tram depot"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for i, t in enumerate(texts):
        own = {r.dim: r.w for r in resolve.embed(df, "id", "t").where(f"id = {i}").collect()}
        assert own == pytest.approx(vector(t))


def candidates(spark, cases):
    base = {"value_type": "entity", "object_id": "stop9", "value_text": None, "rank": "normal", "confidence": 1.0, "valid_from": None, "valid_to": None, "source_id": "map", "predicate_id": "next_to", "subject_id": "stop2"}
    schema = "ord long, subject_id string, predicate_id string, value_type string, object_id string, value_text string, rank string, confidence double, valid_from string, valid_to string, source_id string"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [base | c | {"ord": i} for i, c in enumerate(cases)]
    c = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    c = c.withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz")).withColumn("valid_to", F.col("valid_to").cast("timestamp_ntz"))
    return c.withColumn("value_number", F.lit(None).cast("double")).withColumn("value_unit", F.lit(None).cast("string")).withColumn("value_datetime", F.lit(None).cast("timestamp_ntz"))


def test_writes(spark, store):
    name = lambda text, who="stop4": {"predicate_id": "name", "value_type": "string", "object_id": None, "value_text": text, "subject_id": who}
    cases = [
        ({}, "insert"), ({}, "reconfirm"), ({"subject_id": "stop0", "object_id": "stop1"}, "reconfirm"), ({"source_id": None}, "reject"), ({"source_id": "rumour"}, "reject"), ({"predicate_id": "beside"}, "reject"),
        ({"object_id": "town0"}, "reject"), ({"confidence": -1.0}, "reject"), (name("x") | {"predicate_id": "next_to"}, "reject"), ({"subject_id": "line0"}, "reject"),
        (name("Old Harbour"), "reconfirm"), (name("Old Harbour", "stop6"), "conflict"), (name("Mill", "stop6"), "insert"), (name("Mill", "stop7"), "conflict"), (name("\0", "stop8"), "insert"),
    ]
    c = candidates(spark, [x for x, _ in cases])
    got = {r.ord: (r.outcome, r.detail) for r in write.plan_commit(store, c).collect()}
    assert [got[i][0] for i in range(len(cases))] == [o for _, o in cases], got
    fresh, refs, _ = write.commit(store, c, "2024-01-01 00:00:00")
    assert fresh.count() == 3 and fresh.columns == store.statements.columns
    assert found(refs.where("statement_id NOT LIKE 'st:%'"), "statement_id") == {"r%03d" % ROWS.index(("stop0", "next_to", "stop1", {})), "n2"}
    assert write.commit(store, c, "2024-01-01 00:00:00", atomic=True)[0].count() == 0
    edited = write.deprecate(store.statements, spark.createDataFrame([("r000",), ("n1",)], "id string"), "2024-01-01 00:00:00")
    assert edited.count() == store.statements.count() + 1
    assert edited.where("id LIKE 'r000%' AND system_to IS NULL").first()["rank"] == "deprecated"


def test_errata(spark, store):
    schema = "id string, reason string, remove boolean, value_type string, object_id string, value_text string, value_number double, value_unit string, value_datetime timestamp_ntz, rank string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz"
    track = "r%03d" % ROWS.index(("stop0", "next_to", "stop1", {}))
    none = [None] * 4
    rows = [
        (track, "typo", None, "entity", "stop2", None, None, None, None, *none), ("r000", "never was", True, *[None] * 6, *none), ("n1", "closed rows too", None, "string", None, "Harbor", None, None, None, *none),
        ("n2", " ", None, "string", None, "x", None, None, None, *none), ("f0", "free", None, "string", None, "x", None, None, None, *none), ("f1", "doubt", None, *[None] * 6, None, 0.25, None, None), ("zz", "lost", None, *[None] * 6, *none),
    ]
    said_after, quals, refs, report = write.fix_statements(store, spark.createDataFrame(rows, schema))
    assert {r.id: r.outcome for r in report.collect()} == {track: "fixed", "r000": "deleted", "n1": "fixed", "n2": "reject", "f0": "reject", "f1": "fixed", "zz": "reject"}
    got = {r.id: r for r in said_after.collect()}
    assert len(got) == store.statements.count() - 1 and got[track].object_id == "stop2" and got["n1"].value_text == "Harbor" and got["n1"].system_to is not None
    assert got["n2"].value_text == "Old Harbour" and got["f0"].value_number == 2.5 and got["f1"].confidence == 0.25 and got["f1"].value_number == 4.25
    assert quals.count() == 0 and refs.where("statement_id = 'r000'").count() == 0 and refs.count() == store.references.count() - 1
    edits = spark.createDataFrame([("r000", None, 0.5)], "id string, rank string, confidence double")
    _, quals, refs = write.supersede_whole(store, edits, "2024-01-01 00:00:00")
    assert found(quals, "statement_id") == {"r000", "r000@2024-01-01 00:00:00"} and refs.count() == store.references.count() + 1


def test_inputs(store):
    """Merged ids stand for their entity; unknown ids and predicates are errors, with a suggestion for the latter."""
    assert resolve.canonical_inputs(store, ["stop4c", "stop1", "stop4b"]) == ["stop4", "stop1"]
    inside = dict(said("lies_in"))
    assert found(match.match(store, [("stop4c", "lies_in", "?t")], ["?t"]), "t") == {inside["stop4"]}
    assert found(graph.neighborhood(store, "stop4b")[0], "node") == found(graph.neighborhood(store, "stop4")[0], "node")
    assert found(query.entity_view(store, "stop4c"), "id") == found(query.entity_view(store, "stop4"), "id")
    for call in (lambda: graph.shortest_paths(store, "stop1", "nowhere"), lambda: query.entity_view(store, "nowhere"), lambda: match.match(store, [("nowhere", "lies_in", "?t")], ["?t"]), lambda: graph.similar(store, "nowhere")):
        with pytest.raises(ValueError, match="unknown entity nowhere"):
            call()
    for call in (lambda: query.matching(store, predicate="LIES"), lambda: match.match(store, [("?s", "lies", "?t")], ["?t"]), lambda: graph.edges(store, ["lies"])):
        with pytest.raises(ValueError, match="did you mean lies_in"):
            call()


def test_registry(spark, store):
    assert registry.descendants(store.types, "Spot") == ["Spot", "Stop", "Town"]
    with pytest.raises(ValueError, match="Town"):
        registry.descendants(store.types, "town")
    assert ("Town", "name") in found(registry.applicable(store.types, store.implements, store.predicates), "type_id", "predicate_id")


def test_lists(store):
    page = query.list_statements(store, output="ids", limit=2, predicate="serves").collect()
    assert len(page) == 2 and page[0].total == len(said("serves"))
    full = query.list_statements(store, output="full", limit=5, subject="line0").collect()
    assert all(r.references[0].source_id == "survey" for r in full) and any(r.qualifiers for r in full if r.id == "r000")
    assert found(query.list_entities(store, "Spot", "NUMBER 11"), "id") == {"stop11"}
    with pytest.raises(ValueError):
        query.list_statements(store, limit=0)
