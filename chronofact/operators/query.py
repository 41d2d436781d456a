"""Statement queries: lists, entity views, aggregates and the store's own statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.model import Store
from chronofact.operators import filters, registry, resolve

VALUES = ["value_text", "value_number", "value_unit", "value_datetime"]
LEVELS = {"ids": 5000, "compact": 500, "full": 500}


def money(c: Column | str) -> Column:
    """A sum that doesn't depend on the order of its rows: in decimals of ten places, as a double. Values of 10 ** 18 or more, NaN and
    infinities don't fit these and are summed as doubles."""
    value = F.col(c) if isinstance(c, str) else c
    exact = value.try_cast("decimal(28,10)")
    rest = F.sum(F.when(exact.isNull(), value.cast("double")))
    return F.coalesce(F.sum(exact).cast("double") + rest, F.sum(exact).cast("double"), rest)


def matching(store: Store, subject=None, predicate=None, object=None, value_text=None, min_confidence=None, rank=None, valid_at=None, system_at=None) -> DataFrame:  # noqa: A002
    """Statements that meet all filters that are given. A subject or object that was merged away stands for the entity it went into; an
    unknown one, or an unknown predicate, is an error."""
    registry.known_predicates(store.predicates, [] if predicate is None else [predicate])
    subject, object = (None if x is None else resolve.canonical_inputs(store, [x])[0] for x in (subject, object))  # noqa: A001
    said = store.statements.where(filters.visible(valid_at, system_at, rank, min_confidence))
    for column, value in (("subject_id", subject), ("predicate_id", predicate), ("object_id", object), ("value_text", value_text)):
        if value is not None:
            said = said.where(F.col(column) == value)
    return said


def with_labels(store: Store, said: DataFrame) -> DataFrame:
    """said with subject_label, subject_type, object_label and object_type."""
    own = store.entities.select("id", "label", "type_id")
    s = own.toDF("subject_id", "subject_label", "subject_type")
    o = own.toDF("object_id", "object_label", "object_type")
    return said.join(s, "subject_id", "left").join(o, "object_id", "left")


def list_statements(store: Store, output: str = "compact", limit: int = 100, offset: int = 0, **where) -> DataFrame:
    """The statements at offset to offset + limit in canonical order, and on each the total of all that match. ids: the
    identifiers alone; compact: with values and labels; full: all columns, qualifiers and sources nested."""
    most = LEVELS[filters.known(output, list(LEVELS), "output")]
    if not 0 < limit <= most:
        raise ValueError(f"limit must lie between 1 and {most} for output {output}")
    found = matching(store, **where)
    page = found.orderBy(*filters.canonical_order()).offset(offset).limit(limit)
    page = page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row
    if output == "ids":
        return page.select("id", "subject_id", "predicate_id", "object_id", "total")
    page = with_labels(store, page)
    if output == "compact":
        return page.select("id", "subject_id", "subject_label", "predicate_id", "object_id", "object_label", *VALUES, "rank", "confidence", "total")
    return nested(store, page)


def nested(store: Store, said: DataFrame) -> DataFrame:
    """said with qualifiers and sources as arrays, by one join each. Only the children of said are grouped."""
    own = said.select(F.col("id").alias("statement_id"))
    quals = store.qualifiers.join(own, "statement_id", "left_semi").groupBy("statement_id").agg(F.sort_array(F.collect_list(F.struct("predicate_id", "value_number", "value_unit"))).alias("qualifiers"))
    refs = store.references.join(own, "statement_id", "left_semi").join(store.sources, F.col("source_id") == F.col("id")).groupBy("statement_id")
    refs = refs.agg(F.sort_array(F.collect_list(F.struct("source_id", "activity", "retrieved_at"))).alias("references"))
    out = said.join(quals.withColumnRenamed("statement_id", "id"), "id", "left")
    return out.join(refs.withColumnRenamed("statement_id", "id"), "id", "left")


def aggregate(store: Store, function: str, group_by: str | None = None, **where) -> DataFrame:
    """count, sum or avg of the statements that match; sums and averages are of numbers and quantities, and always apart by
    unit. group_by: subject or object."""
    filters.known(function, ["count", "sum", "avg"], "aggregate")
    if group_by is not None:
        filters.known(group_by, ["subject", "object"], "grouping")
    said = matching(store, **where)
    keys = [] if group_by is None else [f"{group_by}_id"]
    if function == "count":
        return said.groupBy(*keys).agg(F.count("*").alias("n"))
    said = said.where(F.col("value_type").isin("number", "quantity"))
    value = money("value_number") if function == "sum" else money("value_number") / F.count("*")
    return said.groupBy(F.col("value_unit").alias("unit"), *keys).agg(value.cast("double").alias("value"), F.count("*").alias("n"))


def labelled(store: Store, groups: DataFrame, key: str) -> DataFrame:
    """Grouped results with the label of their entity."""
    return groups.join(store.entities.select(F.col("id").alias(key), "label"), key, "left")


def entity_view(store: Store, entity: str, include_deprecated: bool = False, **when) -> DataFrame:
    """All that is said of an entity and with it as the object: direction out or in, in canonical order.
    An id that was merged away stands for the entity it went into; an unknown one is an error."""
    (entity,) = resolve.canonical_inputs(store, [entity])
    said = store.statements.where(filters.as_of(when.get("valid_at"), when.get("system_at")) & filters.trusted(when.get("min_confidence")))
    if when.get("rank") or not include_deprecated:
        said = said.where(filters.of_rank(when.get("rank")))
    out = said.where(F.col("subject_id") == entity).withColumn("direction", F.lit("out"))
    back = said.where(F.col("object_id") == entity).withColumn("direction", F.lit("in"))
    return with_labels(store, out.unionByName(back)).orderBy("direction", *filters.canonical_order())


def list_entities(store: Store, type_id: str | None = None, text: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entities that aren't merged away, of a type or one below it, whose label contains text in any case; newest first, with
    the number of their current statements."""
    found = store.entities.where("merged_into IS NULL")
    if type_id is not None:
        found = found.where(F.col("type_id").isin(registry.descendants(store.types, type_id)))
    if text is not None:
        found = found.where(F.ilike("label", F.lit(f"%{text}%")))
    counts = store.statements.where(filters.as_of()).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("k"))
    out = found.join(counts, "id", "left").select("id", "type_id", "label", "created_at", F.coalesce("k", F.lit(0)).alias("statement_count"))
    return out if limit is None else out.orderBy(F.desc("created_at"), "id").limit(limit)


def list_sources(store: Store) -> DataFrame:
    """Sources with the number of statements that cite them."""
    cited = store.references.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("k"))
    return store.sources.join(cited, "id", "left").withColumn("statement_count", F.coalesce("k", F.lit(0))).drop("k")


def source_detail(store: Store, source: str, limit: int = 200) -> DataFrame:
    """The newest statements of a source, and on each how many there are in all."""
    own = store.references.where(F.col("source_id") == source).select(F.col("statement_id").alias("id"))
    said = store.statements.join(own, "id")
    total = said.agg(F.count("*").alias("total"))
    page = said.orderBy(F.desc("system_from"), "id").limit(limit)
    return with_labels(store, page).crossJoin(F.broadcast(total)).select("id", "subject_label", "predicate_id", "object_label", "system_from", "total")


def stats(store: Store) -> DataFrame:
    """One row: entities, current statements, sources; and entities by type as a second query, entities_by_type()."""
    n = F.count("*")
    a = store.entities.where("merged_into IS NULL").agg(n.alias("entities"))
    b = store.statements.where(filters.as_of()).agg(n.alias("statements"))
    c = store.sources.agg(n.alias("sources"))
    return a.crossJoin(b).crossJoin(c)  # single rows


def entities_by_type(store: Store) -> DataFrame:
    return store.entities.where("merged_into IS NULL").groupBy("type_id").agg(F.count("*").alias("n"))


def degree(store: Store) -> DataFrame:
    """Current, visible entity statements that touch an entity; a loop counts once."""
    said = store.statements.where(filters.visible() & (F.col("value_type") == "entity"))
    ends = said.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def duplicates(store: Store, predicate: str) -> DataFrame:
    """Values of a predicate that more than one current subject has: what an identifying predicate must not have."""
    said = matching(store, predicate=predicate)
    return said.groupBy("value_text").agg(F.countDistinct("subject_id").alias("n")).where("n > 1")


def best_labels(store: Store, predicate: str = "name") -> DataFrame:
    """The label of each subject: by rank, confidence, number of sources, newest, then text."""
    said = matching(store, predicate=predicate)
    # an inner join with what is distinct: only references of these statements are grouped, and no join is pushed below the union of statements
    refs = store.references.select(F.col("statement_id").alias("id")).join(said.select("id").distinct(), "id").groupBy("id").agg(F.count("*").alias("sources"))
    said = said.join(refs, "id", "left")
    order = F.struct(-filters.rank_order(), "confidence", F.coalesce("sources", F.lit(0)), "system_from", "value_text")
    return said.groupBy("subject_id").agg(F.max_by("value_text", order).alias("label"))


def by_predicate(store: Store, entity: str) -> DataFrame:
    """An entity's statements in groups by predicate, each with its ids in canonical order."""
    said = matching(store, subject=entity)
    order = F.struct(filters.rank_order(), -F.col("confidence"), "system_from", "id")
    rows = said.groupBy("predicate_id").agg(F.sort_array(F.collect_list(order)).alias("s"), F.count("*").alias("n"))
    return rows.select("predicate_id", "n", F.transform("s", lambda x: x["id"]).alias("ids"))


def field_groups(store: Store) -> DataFrame:
    """Predicates by the question they answer: When, Where, Who or Details."""
    below = lambda t: F.col("range_type").isin(registry.descendants(store.types, t))
    question = F.when(F.col("range_kind") == "datetime", "When").when(below("Place"), "Where").when(below("Agent"), "Who").otherwise("Details")
    return store.predicates.select("id", question.alias("question"))


def views(store: Store) -> dict[str, DataFrame]:
    """The projections that ad-hoc SQL may read."""
    subject = store.entities.select(F.col("id").alias("subject_id"), F.col("label").alias("subject_label"))
    object_ = store.entities.select(F.col("id").alias("object_id"), F.col("label").alias("object_label"))
    return {
        "v_entities": store.entities.select("id", "type_id", "label", "merged_into", "created_at"),
        "v_statements": store.statements.join(subject, "subject_id").join(object_, "object_id", "left"),
        "v_qualifiers": store.qualifiers.select("statement_id", "predicate_id", "value_number"),
        "v_sources": store.sources.join(store.references.withColumnRenamed("source_id", "id"), "id", "left"),
    }
