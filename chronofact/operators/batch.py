"""Entities of a batch: its rows are matched against the store and among themselves, so that what names the same new thing makes one entity."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.model import STATEMENT, Store
from chronofact.operators import filters, registry, resolve
from chronofact.session import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) of the nodes of edges (a, b), by alternating stars: every node gives its larger neighbours to its
    least one, then all its smaller neighbours. Minima are aggregates that tasks begin before the shuffle, so a node with a third of all
    edges is no hot group. Each round is written to the shared folder."""
    spark = edges.sparkSession
    now = stored(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = stored(spark, large, "stars")
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.withColumnRenamed("b", "u").join(least, "u")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        now = stored(spark, small.distinct(), "stars")
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def checked(store: Store, rows: DataFrame) -> None:
    """An unknown type among the rows is an error that suggests near ones."""
    types = [r["id"] for r in store.types.select("id").collect()]  # a row for each type
    for r in rows.select("type_id").distinct().join(store.types.select(F.col("id").alias("type_id")), "type_id", "left_anti").limit(1).collect():
        filters.known(r["type_id"], types, "type")


def judged(store: Store, identifiers: DataFrame) -> DataFrame:
    """identifiers (ref, predicate_id, value) with a warning where they can't identify: unknown predicate, not identifying, or no value."""
    preds = store.predicates.select(F.col("id").alias("predicate_id"), "identifying")
    rows = identifiers.join(F.broadcast(preds), "predicate_id", "left")  # a vocabulary: shuffled, all of one predicate would meet in a task
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    warning = F.when(F.col("identifying").isNull(), "unknown predicate").when(~F.col("identifying"), "not identifying").when(blank, "no value")
    return rows.select("ref", "predicate_id", "value", warning.alias("warning"))


def _named(label: Column) -> Column:
    return F.when(F.trim(label) != "", F.lower(label))


def _links(rows: DataFrame, keys: DataFrame, types: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Refs of the batch that are the same by an identifier, by a label in any case, or by a label's vector: stars (ref, head), as each key links its refs
    to the least of them, never in pairs; and pairs (a, b) of heads."""
    star = lambda df, by: df.join(df.groupBy(*by).agg(F.min("ref").alias("head")), by).select("ref", "head")
    named = rows.select("ref", "type_id", _named(F.col("label")).alias("low")).where("low IS NOT NULL")
    heads = stored(rows.sparkSession, named.groupBy("type_id", "low").agg(F.min("ref").alias("ref")), "heads")
    # a label asked for under a wider type is the least one of a type below
    up = registry.closure(types).where("type_id <> ancestor_id")
    below = heads.join(up, "type_id").groupBy(F.col("ancestor_id").alias("type_id"), "low").agg(F.min("ref").alias("b"))
    wider = heads.join(below, ["type_id", "low"]).select(F.col("ref").alias("a"), "b")
    text = F.col("low").alias("text")
    near = resolve.similar_texts(heads.select(F.col("ref").alias("query"), text), heads.select(F.col("ref").alias("id"), text), least).where("query > id")
    kind = heads.select(F.col("ref").alias("query"), "type_id"), heads.select(F.col("ref").alias("id"), "type_id")
    near = near.join(kind[0], "query").join(kind[1], ["id", "type_id"]).select(F.col("query").alias("a"), F.col("id").alias("b"))
    return star(keys, ["predicate_id", "value"]).unionByName(star(named, ["type_id", "low"])), wider.unionByName(near)


def linked(stars: DataFrame, pairs: DataFrame) -> DataFrame:
    """ref, component (the least ref reachable) of stars (ref, head: the least ref of its star) and pairs (a, b) of heads. A ref is where its first head is,
    so only refs of several stars link heads, and rounds run on heads alone."""
    spark = stars.sparkSession
    own = stored(spark, stars.groupBy("ref").agg(F.min("head").alias("first"), F.max("head").alias("last")), "firsts")
    several = stars.join(own.where("first <> last").select("ref", "first"), "ref").where("head <> first").select(F.col("first").alias("a"), F.col("head").alias("b"))
    found = components(several.unionByName(pairs).distinct()).withColumnRenamed("node", "first")
    return own.select("ref", "first").join(found, "first", "left").select("ref", F.coalesce("component", "first").alias("component"))


def match_batch(store: Store, rows: DataFrame, identifiers: DataFrame, batch: str, least: float = resolve.AUTOMATIC) -> DataFrame:
    """The entity of each row (ref, type_id, label), given any identifiers (ref, predicate_id, value): ref, id, method, similarity, created, ambiguous.

    A row with an identifier of the store is its owner, the first in order of predicate and id; the owner must be live. Other rows are
    linked with each other, and with rows that have an owner, by equal identifiers, by labels in any case under one type or a wider one,
    and by vectors of `least` or more under one type. What is linked has one entity: the best match of any of its rows (identifier, label,
    vector; then similarity, then id), else a new one, whose id is made from the batch and the least ref. ambiguous: the linked rows
    have several owners in the store. A row without a label and without a usable identifier is nobody else. ref is unique and not null."""
    spark = rows.sparkSession
    checked(store, rows)
    rows = stored(spark, rows.select("ref", "type_id", "label"), "batch")
    keys = stored(spark, judged(store, identifiers).where("warning IS NULL").join(rows.select("ref"), "ref", "left_semi").distinct(), "keys")
    alive = store.entities.where("merged_into IS NULL")
    wanted = keys.select("predicate_id", F.col("value").alias("value_text")).distinct()
    held = store.statements.where(filters.visible()).select("predicate_id", "value_text", "subject_id").join(wanted, ["predicate_id", "value_text"], "left_semi")
    held = held.join(alive.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").groupBy("predicate_id", F.col("value_text").alias("value")).agg(F.min("subject_id").alias("id"))
    owned = keys.join(held, ["predicate_id", "value"]).groupBy("ref").agg(F.min(F.struct("predicate_id", "id")).alias("k"))
    owned = stored(spark, owned.select("ref", F.col("k.id").alias("own"), F.col("k.predicate_id").alias("by")), "owned")
    rows = rows.join(linked(*_links(rows, keys, store.types, least)), "ref", "left").withColumn("component", F.coalesce("component", "ref")).join(owned, "ref", "left")
    rows = stored(spark, rows, "linked")
    # labels against the store: once for each type and label of what has no owner
    open_rows = rows.join(rows.where("own IS NOT NULL").select("component").distinct(), "component", "left_anti")
    named = open_rows.select("component", "type_id", _named(F.col("label")).alias("low")).where("low IS NOT NULL").distinct()
    asked = stored(spark, named.groupBy("type_id", "low").agg(F.min("component").alias("first")).select(F.sha1(F.concat_ws("|", "type_id", "low")).alias("ref"), "type_id", F.col("low").alias("label")), "asked")
    live = alive.where("label IS NOT NULL")
    typed = live.join(registry.closure(store.types), "type_id").select("id", "label", F.col("ancestor_id").alias("type_id"))
    same = asked.join(typed.select("type_id", "id", F.lower("label").alias("label")), ["type_id", "label"]).groupBy("ref").agg(F.min("id").alias("id"))
    near = resolve._by_vector(asked.join(same, "ref", "left_anti"), live, typed, least)
    found = same.select("ref", F.struct(F.lit(2).alias("stage"), F.lit(-1.0).alias("d"), "id").alias("m"))
    found = found.unionByName(near.select("ref", F.struct("stage", (-F.col("similarity")).alias("d"), "id").alias("m")))
    named = named.select("component", F.sha1(F.concat_ws("|", "type_id", "low")).alias("ref")).join(found, "ref").select("component", "m")
    by_key = rows.where("own IS NOT NULL").select("component", F.struct(F.lit(1).alias("stage"), F.lit(-1.0).alias("d"), F.col("own").alias("id")).alias("m"))
    best = by_key.unionByName(named).groupBy("component").agg(F.min("m").alias("m"))
    owners = by_key.groupBy("component").agg((F.min("m.id") < F.max("m.id")).alias("ambiguous"))
    out = rows.join(best, "component", "left").join(owners, "component", "left")
    fresh = F.concat(F.lit("new:"), F.sha1(F.concat_ws("|", F.lit(batch), F.col("component").cast("string"))))
    method = F.when(F.col("own").isNotNull(), F.concat(F.lit("identifier:"), "by")).when(F.col("m.stage") == 1, "linked").when(F.col("m.stage") == 2, "label").when(F.col("m.stage") == 3, "vector").otherwise("new")
    return out.select("ref", F.coalesce("own", "m.id", fresh).alias("id"), method.alias("method"), F.when(F.col("m").isNotNull(), F.when(F.col("own").isNotNull(), 1.0).otherwise(-F.col("m.d"))).alias("similarity"), F.col("m").isNull().alias("created"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def new_entities(rows: DataFrame, matched: DataFrame, at: str) -> DataFrame:
    """The entities that a batch creates: of each the type of its least ref, and the label of the least ref that has one."""
    made = matched.where("created").select("ref", "id").join(rows, "ref")
    label = F.when(F.trim("label") != "", F.col("label"))
    own = made.groupBy("id").agg(F.min_by("type_id", "ref").alias("type_id"), F.min_by(label, F.when(label.isNotNull(), F.col("ref"))).alias("label"))
    return own.select("id", "type_id", "label", F.lit(None).cast("string").alias("merged_into"), F.lit(at).cast("timestamp_ntz").alias("created_at"))


def identifying(store: Store, matched: DataFrame, identifiers: DataFrame, source_id: str) -> DataFrame:
    """Candidates for the identifiers of created entities, each once, so that later batches match by them; ord is their place in order."""
    keys = judged(store, identifiers).where("warning IS NULL").join(matched.where("created").select("ref", "id"), "ref")
    keys = keys.select(F.col("id").alias("subject_id"), "predicate_id", F.col("value").alias("value_text")).distinct()
    given = {"value_type": F.lit("string"), "rank": F.lit("normal"), "confidence": F.lit(1.0)}
    columns = [given.get(c, F.col(c) if c in keys.columns else F.lit(None)).cast(t).alias(c) for c, t in STATEMENT.items() if c not in ("id", "system_from", "system_to", "origin")]
    ord_ = F.xxhash64("subject_id", "predicate_id", "value_text").alias("ord")
    return keys.select(ord_, *columns).withColumn("source_id", F.lit(source_id))


def commit_batch(log, vocabulary: Store, rows: DataFrame, identifiers: DataFrame, source_id: str, at: str, batch: str, tries: int = 5) -> DataFrame:
    """Match a batch and write what is new, entities and identifying statements, as one version of a log; gives match_batch's rows. A batch that is
    known adds nothing, and its rows then match what it wrote. After a conflict with another writer everything is matched again."""
    from chronofact.operators import write
    from chronofact.sources.log import Conflict

    spark = log.spark
    for _ in range(tries):
        version = log.version()
        store = log.store(vocabulary, version)
        matched = stored(spark, match_batch(store, rows, identifiers, batch), "matched")
        if log.known(batch):
            return matched
        fresh = stored(spark, new_entities(rows, matched, at), "new-entities")
        wider = replace(store, entities=store.entities.unionByName(fresh))
        new, report = write.committed(wider, identifying(store, matched, identifiers, source_id), at)
        try:
            log.append(batch, new | {"entities": fresh, "reports": report.withColumn("batch", F.lit(batch))}, version)
        except Conflict:
            continue
        return matched
    raise Conflict(f"batch {batch} lost {tries} times")
