from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import write
from chronofact.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_reads_its_own_predicates(spark):
    """Orders said again don't number the lines: whether a value is a second one concerns predicates of one value alone."""
    store, rows = model.reify(spark, FOLDER), catalog._candidates(spark, FOLDER)
    assert "Window" not in plan(write.validate(store, rows))


def test_rows_are_found_where_they_belong(spark):
    """Names, bare rows, bad ones and those with qualifiers in one batch, with repeats of each."""
    store = model.reify(spark, FOLDER)
    said = store.statements.where("subject_id IN ('supplier:1', 'supplier:2') AND predicate_id IN ('name', 'located_in', 'balance')")
    first = catalog._said(spark, said.orderBy("id"), "abs(hash(id)) % 1000000")
    again = first.withColumn("ord", F.col("ord") + 1000000)
    new = first.where("predicate_id = 'located_in'").withColumn("valid_from", F.lit("1999-01-01").cast("timestamp_ntz"))
    fresh = new.withColumn("ord", F.col("ord") + 2000000).unionByName(new.withColumn("ord", F.col("ord") + 3000000))
    bad = first.where("predicate_id = 'balance'").withColumn("ord", F.col("ord") + 4000000).withColumn("rank", F.lit("best"))
    held = again.where("predicate_id = 'balance'").select("ord")
    got = {r.ord: (r.outcome, r.detail) for r in write.plan_commit(store, first.unionByName(again).unionByName(fresh).unionByName(bad), held).collect()}
    ids = {r.ord: r for r in first.collect()}
    for o, r in ids.items():
        there = f"{r.predicate_id}|{r.subject_id}|1"
        assert got[o] == ("reconfirm", there)
        assert got[o + 1000000] == (("insert", "second value") if r.predicate_id == "balance" else ("reconfirm", there))
        if r.predicate_id == "located_in":
            assert got[o + 2000000] == ("insert", None) and got[o + 3000000] == ("reconfirm", "batch")
        if r.predicate_id == "balance":
            assert got[o + 4000000] == ("reject", "bad rank")
    assert len(got) == 18


def test_the_lookups_of_a_batch_are_narrow(spark, monkeypatch):
    """Only predicates that the batch has are looked up, no row is shuffled by its source, and qualified statements are known without their values."""
    store, rows = model.reify(spark, FOLDER), catalog._candidates(spark, FOLDER)
    assert "o_totalprice" not in plan(write.validate(store, rows)) and "o_orderstatus" not in plan(write.validate(store, rows))
    assert "has_source" not in plan(write.validate(store, rows))
    assert "Window" not in plan(store.qualified)
    ids = store.qualifiers.select("statement_id").distinct()
    assert store.qualified.count() == ids.count() == ids.join(store.qualified, "statement_id").count() > 0
    lost = rows.where("ord < 3").withColumn("source_id", F.lit("src:none"))
    assert {r.problems[0] for r in write.validate(store, lost).select("problems").collect()} == {"unknown source"}


def test_numbers_are_alike_as_values(spark):
    """Numbers are compared as values though their keys hold texts: minus zero is zero, and what comes back is what was given."""
    store = model.reify(spark, FOLDER)
    said = store.statements.where("subject_id = 'supplier:1' AND predicate_id = 'balance'")
    rows = catalog._said(spark, said, "1", value_number=F.lit(0.0)).unionByName(catalog._said(spark, said, "2", value_number=F.lit(-0.0)))
    rows = rows.unionByName(catalog._said(spark, said, "3"))
    got = {r.ord: (r.outcome, r.detail, r.value_number) for r in write._planned(store, rows, None).collect()}
    assert got[1][:2] == ("insert", "second value") and got[2] == ("reconfirm", "batch", 0.0)
    assert got[3] == ("reconfirm", "balance|supplier:1|1", said.first().value_number)
