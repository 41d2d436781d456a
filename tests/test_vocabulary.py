from chronofact import model
from chronofact.operators import registry


def found(df):
    return {r["id"]: "; ".join(r.problems) for r in df.collect()}


def test_review_of_predicates(spark):
    types, _, _ = model.vocabulary(spark)
    rows = [("likes", "Agent", None, "entity", "Part", "n:m", False, "liked_by"), ("liked_by", "Part", None, "entity", "Agent", "n:m", False, "likes"), ("code", None, None, "number", None, None, True, None)]
    proposed = model.literal_table(spark, rows, "id string, domain_type string, domain_interface string, range_kind string, range_type string, cardinality string, identifying boolean, inverse_id string")
    assert found(registry.review(proposed, types)) == {"likes": "", "liked_by": "", "code": "no domain; no cardinality; identifying needs string and 1:1"}


def test_review_of_types(spark):
    types, _, _ = model.vocabulary(spark)
    rows = [("City", "Place", "continuant", ["Nameable"]), ("Ghost", "Nowhere", "continuant", []), ("Party", "Agent", "occurrent", None), ("Odd", None, "thing", ["Flying"])]
    proposed = model.literal_table(spark, rows, "id string, parent_id string, kind string, interfaces array<string>")
    wanted = {"City": "", "Ghost": "unknown parent", "Party": "kind differs from parent", "Odd": "unknown kind; unknown interface"}
    assert found(registry.review_types(proposed, types, ["Nameable", "Temporal", "Embeddable"])) == wanted
