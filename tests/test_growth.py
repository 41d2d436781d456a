"""What queries shuffle and hold, for the findings of round 3 that were projections: one step on small tables, by its plan."""

import pytest
from pyspark.sql import functions as F

from chronofact.operators import modularity
from chronofact.session import bucketed, stored


@pytest.fixture
def plain(spark):
    """Joins by shuffles, as on large tables, and plans without adaptive wrappers."""
    given = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_round_of_moves_shuffles_links_once(plain):
    edges = plain.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    links = bucketed(plain, modularity.weighted(edges), "links", "b")
    nodes = stored(plain, links.groupBy(F.col("b").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("community"), "k"), "nodes")
    plan = modularity._proposals(modularity.Level(links, nodes, 8, 0), nodes, 1, False)
    assert exchanges(plan) == 1
    assert plan.count() == 4


def test_index_compares_in_tasks(spark, monkeypatch):
    """Rows that are compared are no rows of a table: what is shuffled after it are the best of each task."""
    import numpy as np

    from chronofact.operators import vector_index

    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)], "id long, v array<double>")
    kept = []
    monkeypatch.setattr(vector_index, "stored", lambda s, df, name: kept.append(stored(s, df, name)) or kept[-1], raising=False)
    monkeypatch.setattr(vector_index, "QUERY_GROUP", 7, raising=False)
    asked = v.where("id < 20").select(F.col("id").alias("query"), F.col("v").alias("q"))
    found = vector_index.VectorIndex.build(v, cells=4).search(asked, 2, probes=4, again=5).collect()
    assert len(found) == 40 and kept[0].count() == 20 * 10


SF = "/root/testdata/sf0.001"


def test_labels_group_only_their_own_references(spark):
    from chronofact import model
    from chronofact.operators import query

    found = query.best_labels(model.reify(spark, SF))
    assert "Join Inner" in found._jdf.queryExecution().optimizedPlan().toString()  # references meet the names before they are grouped
    assert found.count() == found.select("subject_id").distinct().count() > 0


def test_proposals_without_an_inverse_are_not_joined(plain):
    from chronofact.operators import registry

    columns = "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean, inverse_id string"
    given = [(f"p{i}", "T", None, "entity", None, "n:m", False, inverse) for i, inverse in enumerate(["p1", "p0", None, "p0", "none", None])]
    found = registry.review(plain.createDataFrame(given, columns), plain.createDataFrame([("T",)], "id string"))
    assert {r.id: r.problems for r in found.collect()} == {f"p{i}": ["inverse does not point back"] if i in (3, 4) else [] for i in range(6)}
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()  # rows of the null key are beside the join


def test_cited_sources_are_counted_before_the_join(spark):
    from chronofact.plans import catalog

    found = catalog.queries()["S6_v_sources"](spark, SF)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()  # no statement's own number is needed
    assert sum(r.n for r in found.collect()) > 0


def test_modularity_of_links_one_way(plain):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("c", "d")]
    e = plain.createDataFrame(edges, "src string, dst string")
    members = plain.createDataFrame([(n, "x" if n < "c" else "y") for n in "abcd"], "node string, community string")
    once = modularity.modularity(e.toDF("a", "b").withColumn("w", F.lit(1).cast("long")), members, one_way=True)
    assert once.first()[0] == pytest.approx(modularity.modularity(modularity.weighted(e), members).first()[0])


def test_superseding_reads_what_is_edited_once(spark, monkeypatch):
    from chronofact import model
    from chronofact.operators import write

    kept = []
    monkeypatch.setattr(write, "stored", lambda s, df, name: kept.append(name) or stored(s, df, name))
    store = model.reify(spark, SF)
    edits = store.statements.where("predicate_id = 'segment'").select("id", F.lit(None).cast("string").alias("rank"), F.lit(0.5).alias("confidence"))
    refs = write.supersede_whole(store, edits, "2000-01-01 00:00:00")[2]
    assert kept == ["edits", "copies"]
    assert refs.where("statement_id LIKE '%@%'").count() == edits.count() > 0


def test_statements_are_counted_by_type_without_a_sort(plain):
    from chronofact.plans import catalog

    found = catalog.queries()["F12_applicable_predicates"](plain, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [subject_id" in plan and "SortMergeJoin [subject_id" not in plan  # what is sorted is held, statements and all
    assert sum(r.n for r in found.collect()) > 0
