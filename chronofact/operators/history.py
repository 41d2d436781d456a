"""Timelines, versions and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.model import Store
from chronofact.operators import filters, resolve


def label_changes(said: DataFrame, predicate: str = "name") -> DataFrame:
    """subject_id, at, detail: consecutive versions of a label with another text. Closed rows count, deprecated don't."""
    rows = said.where((F.col("predicate_id") == predicate) & (F.col("rank") != "deprecated"))
    before = F.lag("value_text").over(Window.partitionBy("subject_id").orderBy("system_from", "id"))
    rows = rows.select("subject_id", F.col("system_from").alias("at"), before.alias("old"), F.col("value_text").alias("new"))
    return rows.where("old <> new").select("subject_id", "at", F.concat_ws(" → ", "old", "new").alias("detail"))


def runs(rows: DataFrame, by: list[str], at: str, least: int = 3) -> DataFrame:
    """Neighbours in time of one minute and equal in `by`, in runs: first, last and n of each; shorter runs than `least`
    are left out. A run lies within an hour, so the hour deals the rows to tasks."""
    w = Window.partitionBy(F.date_trunc("hour", at)).orderBy(at, *by, "id")
    minute = F.date_trunc("minute", at)
    key = F.struct(minute.alias("minute"), *by)
    fresh = F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    rows = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w))
    groups = rows.groupBy(F.date_trunc("hour", at).alias("_hour"), "_run", minute.alias("minute"), *by)
    return groups.agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("n") >= least).drop("_hour", "_run")


def timeline(store: Store, entity: str) -> DataFrame:
    """What happened to an entity: occurrents that name it (with the predicates that do), its dated statements and the changes
    of its label; dated rows in order, undated ones last."""
    (entity,) = resolve.canonical_inputs(store, [entity])
    now = store.statements.where(filters.visible())
    kinds = [r["id"] for r in store.types.where("kind = 'occurrent'").collect()]  # a row for each type
    happenings = store.entities.where(F.col("type_id").isin(kinds)).select(F.col("id").alias("subject_id"), "type_id")
    via = now.where((F.col("object_id") == entity) & (F.col("value_type") == "entity")).join(happenings, "subject_id")
    via = via.groupBy("subject_id", "type_id").agg(F.array_join(F.array_sort(F.collect_set("predicate_id")), ",").alias("detail"))
    order = F.struct(-filters.rank_order(), "confidence", "value_datetime")
    begins = now.where("value_type = 'datetime'").groupBy("subject_id").agg(F.max_by("value_datetime", order).alias("at"))
    events = via.join(begins, "subject_id", "left").select(F.lit("event").alias("kind"), F.col("subject_id").alias("id"), "at", "detail")
    dated = now.where((F.col("subject_id") == entity) & (F.col("value_type") == "datetime"))
    dated = dated.select(F.lit("date").alias("kind"), "id", F.col("value_datetime").alias("at"), F.col("predicate_id").alias("detail"))
    labels = label_changes(store.statements.where(F.col("subject_id") == entity))
    labels = labels.select(F.lit("label").alias("kind"), F.col("subject_id").alias("id"), "at", "detail")
    return events.unionByName(dated).unionByName(labels).orderBy(F.asc_nulls_last("at"), "id")


def changes(store: Store, since: str, until: str, kind: str = "all") -> DataFrame:
    """Rows that entered the store in a closed window, whether they were closed since or not: added, or deprecated by rank."""
    filters.known(kind, ["added", "deprecated", "all"], "kind")
    at = F.col("system_from")
    rows = store.statements.where(at.between(F.lit(since).cast("timestamp_ntz"), F.lit(until).cast("timestamp_ntz")))
    rows = rows.withColumn("change", F.when(F.col("rank") == "deprecated", "deprecated").otherwise("added")).withColumn("changed_at", at)
    return rows if kind == "all" else rows.where(F.col("change") == kind)


def current(log: DataFrame) -> DataFrame:
    """The present rows of an append-only log in which a row's close is a later record of its id with system_to set, and an
    erratum a record with `patched` set; the last record of an id holds (patches over closes over the row)."""
    order = F.struct(F.coalesce("patched", F.lit(False)), "recorded_at", F.col("system_to").isNotNull())
    rest = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("id", "r.*")
    return last.where("system_to IS NULL AND NOT coalesce(removed, false)")


