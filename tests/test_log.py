"""The written store: versions, writers that meet, batches that repeat, compaction; and what a commit decides."""

import pytest
from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import match, query, resolve, write
from chronofact.sources import log as logs

TYPES = [("Body", None, "continuant", True), ("Star", "Body", "continuant", False), ("Planet", "Body", "continuant", False)]
PREDICATES = [("circles", "Planet", None, "entity", "Star", "n:m", False), ("code", "Body", None, "string", None, "1:1", True), ("mass", "Body", None, "number", None, "n:m", False)]
COLUMNS = "ord long, subject_id string, predicate_id string, value_type string, object_id string, value_text string, value_number double, value_unit string, value_datetime timestamp_ntz, rank string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, source_id string"


def candidate(ord_, subject, predicate, value, rank="normal", since=None, source="s1"):
    import datetime

    kind = {"circles": "entity", "code": "string", "mass": "number"}[predicate]
    at = since and datetime.datetime.fromisoformat(since)
    return (ord_, subject, predicate, kind, value if kind == "entity" else None, value if kind == "string" else None, value if kind == "number" else None, None, None, rank, 1.0, at, None, source)


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def log(spark, tmp_path):
    out = logs.Log(spark, f"file://{tmp_path}/log")
    vocabulary = model.Store(*[None] * 5, spark.createDataFrame(TYPES, "id string, parent_id string, kind string, abstract boolean"), spark.createDataFrame([], "type_id string, interface_id string"), spark.createDataFrame(PREDICATES, "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean"))
    entities = [("sun", "Star", "Sun", None), ("sol", "Star", "Sol", "sun"), ("p1", "Planet", "One", None), ("p2", "Planet", "Two", None), ("p1b", "Planet", "Uno", "p1")]
    start = F.lit("2020-01-01").cast("timestamp_ntz")
    out.append("first", {"entities": spark.createDataFrame(entities, "id string, type_id string, label string, merged_into string").withColumn("created_at", start), "sources": spark.createDataFrame([("s1", "a"), ("s2", "b")], "id string, activity string").withColumn("retrieved_at", start)}, 0)
    return out, vocabulary


def report(df):
    return {r.ord: (r.outcome, r.detail) for r in df.collect()}


def test_commits(spark, log):
    out, words = log
    first = [candidate(0, "p1b", "circles", "sol"), candidate(1, "p1", "code", "P-1"), candidate(2, "p2", "mass", 5.0), candidate(3, "p2", "mass", 5.0, rank="deprecated"), candidate(4, "nobody", "mass", 1.0), candidate(5, "p2", "mass", 7.0)]
    quals = spark.createDataFrame([(5, "certainty", 0.5, None)], "ord long, predicate_id string, value_number double, value_unit string")
    got = report(logs.commit(out, words, table(spark, first), "2021-01-01 00:00:00", "b1", quals))
    assert got == {0: ("insert", None), 1: ("insert", None), 2: ("insert", None), 3: ("reconfirm", "batch"), 4: ("reject", "unknown subject"), 5: ("insert", None)}
    store = out.store(words)
    said = {(r.subject_id, r.predicate_id, r.object_id or r.value_text or r.value_number): r.id for r in store.statements.collect()}
    assert set(said) == {("p1", "circles", "sun"), ("p1", "code", "P-1"), ("p2", "mass", 5.0), ("p2", "mass", 7.0)}  # merged ends are canonical
    assert [(r.statement_id, r.value_number) for r in store.qualifiers.collect()] == [(said["p2", "mass", 7.0], 0.5)]
    # again: nothing is added, and the report is the first
    version = out.version()
    assert report(logs.commit(out, words, table(spark, first), "2022-01-01 00:00:00", "b1")) == got and out.version() == version
    # another source says the same, and some more
    code, mass = said["p1", "code", "P-1"], said["p2", "mass", 5.0]
    second = [
        candidate(0, "p1", "circles", "sun", source="s2"), candidate(1, "p1", "code", "P-1", since="2015-01-01", source="s2"), candidate(2, "p2", "code", "P-1"), candidate(3, "p2", "mass", 7.0),
        candidate(4, "p2", "mass", 5.0, since="2015-01-01"), candidate(5, "p2", "code", "P-2"), candidate(6, "p2", "code", "P-2", since="2016-01-01"), candidate(7, "p1", "code", "P-2"),
    ]
    got = report(logs.commit(out, words, table(spark, second), "2022-01-01 00:00:00", "b2"))
    assert got == {0: ("reconfirm", said["p1", "circles", "sun"]), 1: ("reconfirm", code), 2: ("conflict", "p1"), 3: ("insert", None), 4: ("insert", None), 5: ("insert", None), 6: ("reconfirm", "batch"), 7: ("conflict", "p2")}
    store = out.store(words)
    assert sorted(r.source_id for r in store.references.where(F.col("statement_id") == code).collect()) == ["s1", "s2"]
    # a deprecated row reconfirms nothing
    logs.close(out, words, spark.createDataFrame([(mass, "deprecated", None)], "id string, rank string, confidence double"), "2023-01-01 00:00:00", "b3")
    assert report(logs.commit(out, words, table(spark, [candidate(0, "p2", "mass", 5.0)]), "2024-01-01 00:00:00", "b4")) == {0: ("insert", None)}
    store = out.store(words)
    ranks = [(r.rank, r.system_to is None) for r in store.statements.where("predicate_id = 'mass' AND value_number = 5 AND valid_from IS NULL").orderBy("system_from").collect()]
    assert ranks == [("normal", False), ("deprecated", True), ("normal", True)]
    # compaction changes nothing that can be read
    before = [sorted(map(tuple, out.rows(t).collect()), key=repr) for t in logs.TABLES]
    out.compact()
    assert [sorted(map(tuple, out.rows(t).collect()), key=repr) for t in logs.TABLES] == before and out.known("b1")
    assert out.store(words, 2).statements.count() == 4
    assert out.vacuum() > 0 and [sorted(map(tuple, out.rows(t).collect()), key=repr) for t in logs.TABLES] == before
    assert report(logs.commit(out, words, table(spark, first), "2022-01-01 00:00:00", "b1"))[4] == ("reject", "unknown subject")


def test_two_writers(spark, log):
    out, words = log
    version = out.version()
    rows = {"sources": spark.createDataFrame([("s3", "c")], "id string, activity string").withColumn("retrieved_at", F.lit(None).cast("timestamp_ntz"))}
    assert out.append("one", rows, version) == version + 1
    with pytest.raises(logs.Conflict):
        out.append("two", rows, version)
    with pytest.raises(logs.Conflict):  # also where both saw the same version when they began to write
        out._put(version + 1, {"base": False, "batches": ["two"], "folders": {}})
    assert out.append("one", rows, version) == version + 1 and out.rows("sources").count() == 3
    assert out.vacuum() == 0 and not [f for f in out.versions() if f > version + 1]


def test_entities_are_created_with_a_report(spark, log):
    out, words = log
    wanted = spark.createDataFrame([(0, "Planet", "one"), (1, "Body", "x"), (2, "Moon", "y")], "ord long, type_id string, label string")
    got = logs.create_entities(out, words, wanted, "2021-01-01 00:00:00", "e1")
    rows = {r.ord: (r.outcome, r.detail, r.statement_id is None) for r in got.collect()}
    assert rows == {0: ("insert", "p1", False), 1: ("reject", "abstract type", True), 2: ("reject", "unknown type", True)}
    logs.create_entities(out, words, wanted, "2021-01-01 00:00:00", "e1")
    assert out.rows("entities").where("label = 'one'").count() == 1


def test_merged_ids_in_lists_and_sets(spark, log):
    out, words = log
    logs.commit(out, words, table(spark, [candidate(0, "p1", "circles", "sun"), candidate(1, "p2", "circles", "sun")]), "2021-01-01 00:00:00", "b1")
    store = out.store(words)
    assert query.matching(store, subject="p1b").count() == 1 and query.matching(store, object="sol").count() == 2
    got = match.set_operation(store, "intersect", [{"object_id": "sol"}, {"subject_id": "p1b"}])
    assert [r.id for r in got.collect()] == ["p1"]
    for bad in (lambda: query.matching(store, subject="nobody"), lambda: match.members(store, {"object_id": "nobody"}, "subject")):
        with pytest.raises(ValueError, match="unknown entity nobody"):
            bad()


def test_what_has_no_label_is_nobody_else(spark, log):
    out, words = log
    rows = spark.createDataFrame([(1, "Planet", None, None), (2, "Planet", None, None), (3, "Planet", " ", None), (4, "Planet", "New", None), (5, "Planet", "NEW", None)], "ref long, type_id string, label string, key string")
    got = {r.ref: r.id for r in resolve.get_or_create(out.store(words), rows).collect()}
    assert len({got[1], got[2], got[3], got[4]}) == 4 and got[4] == got[5]


def test_write_is_used(spark, log):
    out, words = log
    assert write.plan_commit(out.store(words), table(spark, [])).count() == 0
