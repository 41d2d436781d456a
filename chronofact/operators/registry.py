"""The vocabulary: closures of the type tree, applicability, and the review gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.operators import filters

KINDS = ("entity", "string", "number", "datetime", "geo", "json", "quantity")
CARDINALITIES = ("1:1", "1:n", "n:m")


def closure(types: DataFrame) -> DataFrame:
    """type_id, ancestor_id for every type and itself. The tree is a vocabulary, so its depth is a handful of joins."""
    parents = {r["id"]: r["parent_id"] for r in types.select("id", "parent_id").collect()}  # a row for each type
    rows = []
    for t in parents:
        seen, at = [], t
        while at is not None and at not in seen:
            seen.append(at)
            at = parents.get(at)
        rows += [(t, a) for a in seen]
    return types.sparkSession.createDataFrame(rows, "type_id string, ancestor_id string")


def descendants(types: DataFrame, type_id: str) -> list[str]:
    """The type and all below it, as literals so that the filter reaches the scan."""
    rows = types.select("id", "parent_id").collect()  # a row for each type
    filters.known(type_id, [r["id"] for r in rows], "type")
    out, fresh = [type_id], [type_id]
    while fresh:
        fresh = [r["id"] for r in rows if r["parent_id"] in fresh and r["id"] not in out]
        out += fresh
    return out


def known_predicates(predicates: DataFrame, names: list[str]) -> list[str]:
    """names, if all are predicates of the vocabulary; else an error that suggests near ones."""
    words = [r["id"] for r in predicates.select("id").collect()] if names else []  # a row for each predicate
    return [filters.known(n, words, "predicate") for n in names]


def interfaces(types: DataFrame, implements: DataFrame) -> DataFrame:
    """type_id, interface_id, inherited down the tree."""
    up = closure(types)
    return up.join(implements.withColumnRenamed("type_id", "ancestor_id"), "ancestor_id").select("type_id", "interface_id").distinct()


def applicable(types: DataFrame, implements: DataFrame, predicates: DataFrame) -> DataFrame:
    """type_id, predicate_id: a predicate applies to its domain type and those below, to the types with its domain interface,
    and to all if it has neither."""
    own = predicates.select(F.col("id").alias("predicate_id"), "domain_type", "domain_interface")
    by_type = own.join(closure(types), F.col("domain_type") == F.col("ancestor_id")).select("type_id", "predicate_id")
    by_trait = own.join(interfaces(types, implements), F.col("domain_interface") == F.col("interface_id")).select("type_id", "predicate_id")
    free = own.where("domain_type IS NULL AND domain_interface IS NULL").crossJoin(types.select(F.col("id").alias("type_id")))  # two vocabularies
    return by_type.unionByName(by_trait).unionByName(free.select("type_id", "predicate_id")).distinct()


def review(proposals: DataFrame, types: DataFrame) -> DataFrame:
    """Proposed predicates (id, domain_type, domain_interface, range_kind, range_type, cardinality, identifying, inverse_id) with
    the list of problems that keep each from approval; an empty list passes the gate."""
    named = types.select(F.col("id").alias("t"))
    pairs = proposals.select(F.col("id").alias("inverse_id"), F.col("inverse_id").alias("back"))
    rows = proposals.join(F.broadcast(named.withColumnRenamed("t", "domain_type").withColumn("has_domain", F.lit(True))), "domain_type", "left")
    rows = rows.join(F.broadcast(named.withColumnRenamed("t", "range_type").withColumn("has_range", F.lit(True))), "range_type", "left")
    # most proposals have no inverse: joined, they would all go to the task of the null key
    rest = rows.where("inverse_id IS NULL").withColumn("back", F.lit(None).cast("string"))
    rows = rows.where("inverse_id IS NOT NULL").join(pairs, "inverse_id", "left").unionByName(rest)
    problem = lambda cond, text: F.when(cond, F.lit(text))
    found = F.array_compact(F.array(
        problem(F.col("domain_type").isNull() & F.col("domain_interface").isNull(), "no domain"),
        problem(F.col("domain_type").isNotNull() & F.col("has_domain").isNull(), "unknown domain type"),
        problem(~F.coalesce(F.col("range_kind").isin(*KINDS), F.lit(False)), "unknown range kind"),
        problem(F.col("range_type").isNotNull() & F.col("has_range").isNull(), "unknown range type"),
        problem(~F.coalesce(F.col("cardinality").isin(*CARDINALITIES), F.lit(False)), "no cardinality"),
        problem(F.col("identifying") & ((F.col("range_kind") != "string") | (F.col("cardinality") != "1:1")), "identifying needs string and 1:1"),
        problem(F.col("inverse_id").isNotNull() & ~F.col("back").eqNullSafe(F.col("id")), "inverse does not point back"),
    ))
    return rows.select("id", found.alias("problems"))


def status(events: DataFrame) -> DataFrame:
    """The state of proposals from an append-only log (proposal_id, at, status): the last event of each."""
    return events.groupBy("proposal_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"))


def review_types(proposals: DataFrame, types: DataFrame, interfaces_known: list[str]) -> DataFrame:
    """Proposed types (id, parent_id, kind, interfaces) with their problems: the parent exists and has the same kind, a root has a kind, and
    all interfaces are known."""
    parents = types.select(F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    rows = proposals.join(F.broadcast(parents), "parent_id", "left")
    problem = lambda cond, text: F.when(cond, F.lit(text))
    odd = F.array_except(F.coalesce("interfaces", F.array().cast("array<string>")), F.array(*[F.lit(i) for i in interfaces_known]).cast("array<string>"))
    found = F.array_compact(F.array(
        problem(F.col("parent_id").isNotNull() & F.col("parent_kind").isNull(), "unknown parent"),
        problem(~F.coalesce(F.col("kind").isin("continuant", "occurrent"), F.lit(False)), "unknown kind"),
        problem(F.col("parent_kind") != F.col("kind"), "kind differs from parent"),
        problem(F.size(odd) > 0, "unknown interface"),
    ))
    return rows.select("id", found.alias("problems"))


#: What may be done with a proposal. A closed one (new or rejected) may be proposed; an open one amended, rejected or approved; an approved one is final.
ACTIONS = ("propose", "amend", "reject", "approve")


def transitions(events: DataFrame) -> DataFrame:
    """events (proposal_id, seq, action, and any others) with legal, and the state after each: pending, amended, rejected, approved, or null
    before any proposal. What isn't legal changes nothing, and is a row like any other, so the illegal ones are a report.

    seq orders the events of a proposal. Whether a proposal is open before an event is told by the last of its proposals and rejections,
    legal or not: one that is illegal repeats the state it finds. So no fold is needed, only windows."""
    action = F.col("action")
    of = Window.partitionBy("proposal_id").orderBy("seq", "action")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_open", F.coalesce(F.last(F.when(action.isin("propose", "reject"), action == "propose"), ignorenulls=True).over(before), F.lit(False)))
    approves = (action == "approve") & F.col("_open")
    rows = rows.withColumn("_final", F.coalesce(F.max(approves).over(before), F.lit(False)))
    fits = F.when(action == "propose", ~F.col("_open")).when(action.isin(*ACTIONS), F.col("_open")).otherwise(False)
    rows = rows.withColumn("legal", F.coalesce(fits & ~F.col("_final"), F.lit(False)))
    after = F.when(F.col("legal"), F.when(action == "propose", "pending").when(action == "amend", "amended").when(action == "reject", "rejected").otherwise("approved"))
    state = F.last(after, ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("state", state).drop("_open", "_final")


def proposals(events: DataFrame, content: list[str]) -> DataFrame:
    """proposal_id, status, decided_at (seq of the last legal rejection or approval, null while open), illegal (how many events were), and the
    content as the last legal proposal or amendment has it, from events (proposal_id, seq, action and the columns of content)."""
    rows = transitions(events)
    legal = F.col("legal")
    last = rows.groupBy("proposal_id").agg(
        F.max_by("state", F.struct("seq", "action")).alias("status"), F.max(F.when(legal & F.col("action").isin("reject", "approve"), F.col("seq"))).alias("decided"),
        F.max_by(F.struct(*content), F.when(legal & F.col("action").isin("propose", "amend"), F.struct("seq", "action"))).alias("c"), F.count_if(~legal).alias("illegal"),
    )
    decided = F.when(F.col("status").isin("rejected", "approved"), F.col("decided"))
    return last.select("proposal_id", "status", decided.alias("decided_at"), "illegal", *[F.col(f"c.{c}").alias(c) for c in content])


def approved_pairs(decided: DataFrame) -> DataFrame:
    """Of proposals (proposal_id, status, inverse_id) the approved ones: proposal_id, inverse_id, approved. One with an inverse is approved only
    together with it, and one that is named as an inverse has the one that names it filled in (the least of several)."""
    own = decided.where("status = 'approved'").select("proposal_id", "inverse_id")
    named = own.where("inverse_id IS NOT NULL").groupBy(F.col("inverse_id").alias("proposal_id")).agg(F.min("proposal_id").alias("back"))
    rows = own.join(named, "proposal_id", "left").select("proposal_id", F.coalesce("inverse_id", "back").alias("inverse_id"))
    there = own.select(F.col("proposal_id").alias("inverse_id"), F.lit(True).alias("there"))
    rows = rows.join(there, "inverse_id", "left")
    return rows.select("proposal_id", "inverse_id", (F.col("inverse_id").isNull() | F.coalesce("there", F.lit(False))).alias("approved"))
