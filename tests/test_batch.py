"""Entities of a batch: matched among themselves by identifiers, labels and vectors, written with their identifiers."""

import random

import pytest
from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import batch, resolve
from chronofact.sources import log as logs

TYPES = [("Agent", None, "continuant", True), ("Human", "Agent", "continuant", False), ("Firm", "Agent", "continuant", False)]
PREDICATES = [("mail", "Agent", None, "string", None, "1:1", True), ("phone", "Agent", None, "string", None, "1:1", True), ("motto", "Agent", None, "string", None, "n:m", False)]
ROWS = "ref string, type_id string, label string"
KEYS = "ref string, predicate_id string, value string"


@pytest.fixture
def log(spark, tmp_path):
    out = logs.Log(spark, f"file://{tmp_path}/log")
    words = model.Store(*[None] * 5, spark.createDataFrame(TYPES, "id string, parent_id string, kind string, abstract boolean"), spark.createDataFrame([], "type_id string, interface_id string"), spark.createDataFrame(PREDICATES, "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean"))
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    out.append("first", {"entities": spark.createDataFrame([("e1", "Human", "Berta Lindqvist", None), ("e2", "Firm", "Kestrel Works", None)], "id string, type_id string, label string, merged_into string").withColumn("created_at", start), "sources": spark.createDataFrame([("s1", "a")], "id string, activity string").withColumn("retrieved_at", start)}, 0)
    return out, words


def put(spark, log, rows, keys, name):
    out, words = log
    got = batch.commit_batch(out, words, spark.createDataFrame(rows, ROWS), spark.createDataFrame(keys, KEYS), "s1", "2021-01-01 00:00:00", name)
    return {r.ref: r for r in got.collect()}


def components(edges):
    at = {x: x for e in edges for x in e}
    def top(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {x: top(x) for x in at}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000, i) for i in range(1001, 1300)] + [(i, i + 1) for i in range(2000, 2060)]
    got = batch.components(spark.createDataFrame(edges, "a long, b long"))
    want = components([e for e in edges if e[0] != e[1]])
    assert {x.node: x.component for x in got.collect()} == want and got.count() == len(want)
    assert batch.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_entity_for_what_is_named_twice(spark, log):
    out, words = log
    rows = [
        ("a", "Human", "Ottilie Vance"), ("b", "Human", "OTTILIE VANCE"), ("c", "Human", None), ("d", "Human", "O. V."),  # a to d: label, then mail, then phone
        ("e", "Human", None), ("f", "Human", " "), ("g", "Human", None),  # nobody else
        ("h", "Human", "berta lindqvist"), ("i", "Human", "B."), ("j", "Agent", "Zoltan Quill"), ("k", "Firm", "Zoltan Quill"), ("l", "Human", "Zoltan Quill"),
    ]
    keys = [("b", "mail", "o@v"), ("c", "mail", "o@v"), ("c", "phone", "1"), ("d", "phone", "1"), ("e", "motto", "same"), ("f", "motto", "same"), ("g", "mail", " "), ("g", "fax", "2"), ("i", "mail", "b@l"), ("h", "mail", "b@l"), ("nobody", "mail", "o@v")]
    got = put(spark, log, rows, keys, "b1")
    assert len({got[x].id for x in "abcd"}) == 1 and all(got[x].created and got[x].method == "new" for x in "abcd")
    assert len({got[x].id for x in "aefg"}) == 4
    assert got["h"].id == "e1" and got["h"].method == "label" and got["i"].id == "e1" and not got["i"].created  # by its mail to h, by h's label to e1
    assert got["j"].id == got["k"].id != got["l"].id  # a wider type takes the least one below it, and doesn't join the others
    warned = {(r.ref, r.predicate_id): r.warning for r in batch.judged(words, spark.createDataFrame(keys, KEYS)).collect() if r.warning}
    assert warned == {("e", "motto"): "not identifying", ("f", "motto"): "not identifying", ("g", "mail"): "no value", ("g", "fax"): "unknown predicate"}
    store = out.store(words)
    made = {r.id: (r.type_id, r.label) for r in store.entities.collect()}
    assert made[got["a"].id] == ("Human", "Ottilie Vance") and made[got["e"].id] == ("Human", None) and len(made) == 2 + 6
    said = {(r.subject_id, r.predicate_id, r.value_text) for r in store.statements.collect()}
    assert said == {(got["a"].id, "mail", "o@v"), (got["a"].id, "phone", "1")}
    # the next batch matches by what was written, whatever it is called
    later = put(spark, log, [("x", "Human", "Somebody"), ("y", "Human", "else"), ("z", "Human", "Somebody")], [("x", "phone", "1"), ("y", "phone", "9")], "b2")
    assert later["x"].id == got["a"].id and later["x"].method == "identifier:phone" and later["z"].id == got["a"].id and later["z"].method == "linked"
    assert later["y"].created
    version = out.version()
    again = put(spark, log, rows, keys, "b1")
    assert out.version() == version and again["c"].id == got["a"].id


def test_two_owners_are_told(spark, log):
    first = put(spark, log, [("a", "Human", "Ada Nim"), ("b", "Human", "Bo Rask")], [("a", "mail", "a"), ("b", "mail", "b")], "b1")
    got = put(spark, log, [("1", "Human", None), ("2", "Human", None), ("3", "Human", None), ("4", "Human", "Ada Nim")], [("1", "mail", "a"), ("1", "phone", "5"), ("2", "mail", "b"), ("2", "phone", "5"), ("3", "phone", "5")], "b2")
    assert (got["1"].id, got["2"].id) == (first["a"].id, first["b"].id)  # an own identifier goes before what is linked
    assert got["3"].id == min(first["a"].id, first["b"].id) and all(got[x].ambiguous for x in "123")
    assert got["4"].id == first["a"].id and not got["4"].ambiguous


def test_empty_and_unknown(spark, log):
    assert put(spark, log, [], [], "b1") == {}
    with pytest.raises(ValueError, match="Human"):
        put(spark, log, [("a", "Humann", "x")], [], "b2")


def test_similar_is_the_full_join(spark):
    r = random.Random(5)
    words = ["harbour", "lantern", "quarry", "meadow", "0001", "0002", "1002", "north", "x", "Ä", ""]
    rows = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randrange(1, 4)))) for i in range(300)], "id long, t string")
    v = resolve.embed(rows, "id", "t").cache()
    for least in (0.3, 0.8, 0.93, 1 - 1e-9):
        full = {(x.query, x.id): round(x.similarity, 9) for x in resolve.cosine(v.withColumnRenamed("id", "query"), v, least - 1e-9).collect()}
        assert {(x.query, x.id): round(x.similarity, 9) for x in resolve.similar(v.withColumnRenamed("id", "query"), v, least).collect()} == full
