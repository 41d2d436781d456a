"""All registered queries of the statement store, each with the SQL that states the same result over the same tables.

Queries over what a library would leave undefined (communities, centrality by floating sums of many rounds) have no SQL and
are held to fixtures in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact import model
from chronofact.operators import batch, filters, graph, history, match, modularity, query, registry, resolve, stored_graph, vector_index, write
from chronofact.plans import sqlguard
from chronofact.plans.reified import sql
from chronofact.session import new_folder, shuffle_partitions, stored
from chronofact.sources import calls, files, ingest, log, profiles
from chronofact.streaming import jobs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

DAY = "1998-01-01 00:00:00"
VISIBLE = "system_to IS NULL AND rank <> 'deprecated'"
AS_OF = f"(valid_from IS NULL OR valid_from <= TIMESTAMP '{DAY}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{DAY}')"
RANK = "CASE rank WHEN 'preferred' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END"
CANON = f"{RANK}, confidence DESC, system_from, id"


def registered(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir, store) under a name."""

    def put(f):
        _QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, model.reify(spark, sf_dir))
        if oracle:
            _SQL[name] = oracle
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- lists, filters, joins


@registered(
    "F0_contains_per_nation",
    sql(f"""SELECT n.label AS nation, count(*) AS n FROM stmt c JOIN stmt p ON p.subject_id = c.subject_id AND p.predicate_id = 'placed_by'
    JOIN stmt l ON l.subject_id = p.object_id AND l.predicate_id = 'located_in' JOIN ent n ON n.id = l.object_id
    WHERE c.predicate_id = 'contains' AND c.system_to IS NULL AND c.rank <> 'deprecated' AND c.confidence >= 0.7
    AND c.valid_from <= TIMESTAMP '{DAY}' AND c.valid_to > TIMESTAMP '{DAY}' GROUP BY 1"""),
)
def contains_per_nation(spark, sf_dir, store):
    said = query.matching(store, predicate="contains", min_confidence=0.7, valid_at=DAY).select(F.col("subject_id").alias("o"))
    placed = query.matching(store, predicate="placed_by").select(F.col("subject_id").alias("o"), F.col("object_id").alias("c"))
    located = query.matching(store, predicate="located_in").select(F.col("subject_id").alias("c"), F.col("object_id").alias("id"))
    names = store.entities.select("id", F.col("label").alias("nation"))
    return said.join(placed, "o").join(located, "c").join(names, "id").groupBy("nation").agg(F.count("*").alias("n"))


@registered("F1_list_page", sql(f"""SELECT s.id, s.subject_id, a.label AS subject_label, s.predicate_id, s.object_id, b.label AS object_label, s.value_text, s.value_number,
    s.value_unit, s.value_datetime, s.rank, s.confidence, s.total
    FROM (SELECT *, count(*) OVER () AS total FROM stmt WHERE {VISIBLE} AND predicate_id = 'contains' AND confidence >= 0.9 ORDER BY {CANON} LIMIT 50 OFFSET 10) s
    LEFT JOIN ent a ON a.id = s.subject_id LEFT JOIN ent b ON b.id = s.object_id"""))  # fmt: skip
def list_page(spark, sf_dir, store):
    return query.list_statements(store, limit=50, offset=10, predicate="contains", min_confidence=0.9)


@registered("F1_as_of", sql("""SELECT predicate_id, rank, count(*) AS n FROM stmt WHERE system_from <= TIMESTAMP '1997-06-01' AND (system_to IS NULL OR system_to > TIMESTAMP '1997-06-01')
    AND rank = 'preferred' GROUP BY 1, 2"""))
def as_of(spark, sf_dir, store):
    return query.matching(store, system_at="1997-06-01 00:00:00", rank="preferred").groupBy("predicate_id", "rank").agg(F.count("*").alias("n"))


@registered("F3_entity_view", sql(f"""SELECT direction, id, subject_id, predicate_id, object_id, rank FROM (SELECT 'out' AS direction, * FROM stmt WHERE subject_id = 'customer:1' UNION ALL
    SELECT 'in', * FROM stmt WHERE object_id = 'customer:1') WHERE {VISIBLE}"""))
def entity_view(spark, sf_dir, store):
    return query.entity_view(store, "customer:1").select("direction", "id", "subject_id", "predicate_id", "object_id", "rank")


@registered("F4_list_entities", sql("""SELECT e.id, e.type_id, e.label, e.created_at, count(s.id) AS statement_count FROM ent e LEFT JOIN stmt s ON s.subject_id = e.id AND s.system_to IS NULL
    WHERE e.merged_into IS NULL AND e.type_id IN ('Agent', 'Customer', 'Supplier', 'User') AND e.label ILIKE '%er#00000000%' GROUP BY ALL"""))
def list_entities(spark, sf_dir, store):
    return query.list_entities(store, "Agent", "er#00000000", limit=None)


@registered("F5_list_sources", sql("SELECT s.id, s.activity, s.retrieved_at, count(r.statement_id) AS statement_count FROM src s LEFT JOIN refs r ON r.source_id = s.id GROUP BY ALL"))
def list_sources(spark, sf_dir, store):
    return query.list_sources(store)


@registered("F6_source_detail", sql("""SELECT s.id, a.label AS subject_label, s.predicate_id, b.label AS object_label, s.system_from, s.total
    FROM (SELECT s.*, count(*) OVER () AS total FROM stmt s JOIN refs r ON r.statement_id = s.id WHERE r.source_id = 'src:master' ORDER BY s.system_from DESC, s.id LIMIT 200) s
    LEFT JOIN ent a ON a.id = s.subject_id LEFT JOIN ent b ON b.id = s.object_id"""))
def source_detail(spark, sf_dir, store):
    return query.source_detail(store, "src:master")


@registered("F12_applicable_predicates", sql(f"""SELECT v.type_id, v.predicate_id, coalesce(u.n, 0) AS n FROM (VALUES ('Nation','part_of'),('Agent','located_in'),('Customer','located_in'),('Supplier','located_in'),('User','located_in'),
    ('Place','name'),('Region','name'),('Nation','name'),('Agent','name'),('Customer','name'),('Supplier','name'),('User','name'),('Part','name'),('Customer','segment'),('Agent','balance'),
    ('Customer','balance'),('Supplier','balance'),('User','balance'),('Order','placed_by'),('Order','status'),('Order','total'),('Happening','started'),('Order','started'),('Order','contains'),
    ('Order','supplied_by'),('User','did')) v(type_id, predicate_id)
    LEFT JOIN (SELECT e.type_id, s.predicate_id, count(*) AS n FROM stmt s JOIN ent e ON e.id = s.subject_id WHERE {VISIBLE} GROUP BY 1, 2) u USING (type_id, predicate_id)"""))
def applicable(spark, sf_dir, store):
    """Each applicable predicate with how often entities of just the type use it."""
    types = store.entities.select(F.col("id").alias("subject_id"), "type_id")
    # tasks hold the entities alone, by a hash of their ids, a part of them at a time: sorted, they would hold the statements as well, several for each
    n = 4 * shuffle_partitions(spark)
    said = query.matching(store).select("subject_id", "predicate_id").repartition(n, "subject_id")
    used = said.join(types.repartition(n, "subject_id").hint("shuffle_hash"), "subject_id").groupBy("type_id", "predicate_id").agg(F.count("*").alias("n"))
    found = registry.applicable(store.types, store.implements, store.predicates).join(used, ["type_id", "predicate_id"], "left")
    return found.select("type_id", "predicate_id", F.coalesce("n", F.lit(0)).alias("n"))


@registered("F13_field_groups", sql(f"""SELECT id, question, coalesce(n, 0) AS n FROM (VALUES ('part_of','Where'),('located_in','Where'),('name','Details'),('segment','Details'),('balance','Details'),('placed_by','Who'),('status','Details'),
    ('total','Details'),('started','When'),('contains','Details'),('supplied_by','Who'),('did','Details')) v(id, question)
    LEFT JOIN (SELECT predicate_id AS id, count(*) AS n FROM stmt WHERE {VISIBLE} GROUP BY 1) USING (id)"""))
def field_groups(spark, sf_dir, store):
    """The predicates of each question with their statements."""
    return _with_statements(store, query.field_groups(store)).select("id", "question", "n")


def _with_statements(store: model.Store, predicates: DataFrame) -> DataFrame:
    """predicates (id, ...) with n, their visible statements."""
    said = query.matching(store).groupBy(F.col("predicate_id").alias("id")).agg(F.count("*").alias("n"))
    return predicates.join(said, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@registered("F14_by_predicate", sql(f"SELECT predicate_id, count(*) AS n, string_agg(id, ',' ORDER BY {CANON}) AS ids FROM stmt WHERE {VISIBLE} AND subject_id = 'order:1' GROUP BY 1"))
def by_predicate(spark, sf_dir, store):
    return query.by_predicate(store, "order:1").withColumn("ids", F.array_join("ids", ","))


@registered("F7_compact_json", sql(f"""SELECT id, '{{"subject_id":"' || subject_id || '","predicate_id":"' || predicate_id || '"' || coalesce(',"object_id":"' || object_id || '"', '') || coalesce(',"value_text":"' || value_text || '"', '') || '}}' AS doc
    FROM stmt WHERE predicate_id IN ('located_in', 'segment') AND {VISIBLE}"""))
def compact_json(spark, sf_dir, store):
    said = store.statements.where(filters.visible() & F.col("predicate_id").isin("located_in", "segment"))
    return said.select("id", F.to_json(F.struct("subject_id", "predicate_id", "object_id", "value_text"), {"ignoreNullFields": "true"}).alias("doc"))


@registered("S4_v_statements", sql("SELECT s.predicate_id, count(*) AS n, count(b.label) AS labelled FROM stmt s JOIN ent a ON a.id = s.subject_id LEFT JOIN ent b ON b.id = s.object_id GROUP BY 1"))
def v_statements(spark, sf_dir, store):
    return query.views(store)["v_statements"].groupBy("predicate_id").agg(F.count("*").alias("n"), F.count("object_label").alias("labelled"))


@registered("S5_v_qualifiers", sql("SELECT predicate_id, count(*) AS n, CAST(sum(CAST(value_number AS DECIMAL(18,2))) AS DOUBLE) AS total FROM quals GROUP BY 1"))
def v_qualifiers(spark, sf_dir, store):
    return query.views(store)["v_qualifiers"].groupBy("predicate_id").agg(F.count("*").alias("n"), query.money("value_number").cast("double").alias("total"))


@registered("S6_v_sources", sql("SELECT s.activity, count(*) AS n, count(r.statement_id) AS used FROM src s LEFT JOIN refs r ON r.source_id = s.id GROUP BY 1"))
def v_sources(spark, sf_dir, store):
    """The rows of v_sources and of these the cited ones, counted by source before sources are joined: one source is cited by most statements."""
    cited = query.list_sources(store).groupBy("activity")
    return cited.agg(F.sum(F.greatest("statement_count", F.lit(1))).alias("n"), F.sum("statement_count").alias("used"))


@registered("J5_references", sql(f"""SELECT s.id, count(DISTINCT q.predicate_id) AS qualifiers, count(DISTINCT r.source_id) AS sources FROM stmt s LEFT JOIN quals q ON q.statement_id = s.id
    LEFT JOIN refs r ON r.statement_id = s.id WHERE {VISIBLE} AND s.predicate_id = 'contains' AND s.confidence >= 0.95 GROUP BY 1"""))
def references(spark, sf_dir, store):
    said = query.matching(store, predicate="contains", min_confidence=0.95)
    return query.nested(store, said).select("id", F.coalesce(F.size("qualifiers"), F.lit(0)).cast("long").alias("qualifiers"), F.coalesce(F.size("references"), F.lit(0)).cast("long").alias("sources"))


@registered("J8_identifier_lookup", sql(f"SELECT n.n_nationkey AS ref, s.subject_id AS id FROM nation n JOIN stmt s ON s.predicate_id = 'name' AND s.value_text = n.n_name AND {VISIBLE}"))
def identifier_lookup(spark, sf_dir, store):
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("value_text"))
    return wanted.join(query.matching(store, predicate="name").select("value_text", F.col("subject_id").alias("id")), "value_text").select("ref", "id")


# -- aggregates


@registered("A1_count", sql(f"SELECT count(*) AS n FROM stmt WHERE {VISIBLE}"))
def count(spark, sf_dir, store):
    return query.aggregate(store, "count")


@registered("A2_count_by_object", sql(f"SELECT s.object_id, s.n, e.label FROM (SELECT object_id, count(*) AS n FROM stmt WHERE {VISIBLE} AND predicate_id = 'contains' AND {AS_OF} GROUP BY 1) s LEFT JOIN ent e ON e.id = s.object_id"))
def count_by_object(spark, sf_dir, store):
    return query.labelled(store, query.aggregate(store, "count", "object", predicate="contains", valid_at=DAY), "object_id")


@registered("A3_sum_by_unit", sql(f"SELECT value_unit AS unit, CAST(sum(CAST(value_number AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n FROM stmt WHERE {VISIBLE} AND value_type IN ('number', 'quantity') AND predicate_id = 'balance' GROUP BY 1"))
def sum_by_unit(spark, sf_dir, store):
    return query.aggregate(store, "sum", predicate="balance")


@registered("A3_avg_by_unit", sql(f"SELECT value_unit AS unit, round(CAST(sum(CAST(value_number AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS value, count(*) AS n FROM stmt WHERE {VISIBLE} AND value_type IN ('number', 'quantity') GROUP BY 1"))
def avg_by_unit(spark, sf_dir, store):
    return query.aggregate(store, "avg").withColumn("value", F.round("value", 4))


@registered("A3_sum_by_subject", sql(f"SELECT value_unit AS unit, subject_id, CAST(sum(CAST(value_number AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n FROM stmt WHERE {VISIBLE} AND value_type IN ('number', 'quantity') AND predicate_id = 'total' GROUP BY 1, 2"))
def sum_by_subject(spark, sf_dir, store):
    return query.aggregate(store, "sum", "subject", predicate="total")


@registered("A5_stats", sql("SELECT (SELECT count(*) FROM ent WHERE merged_into IS NULL) AS entities, (SELECT count(*) FROM stmt WHERE system_to IS NULL) AS statements, (SELECT count(*) FROM src) AS sources"))
def stats(spark, sf_dir, store):
    return query.stats(store)


@registered("A5_entities_by_type", sql("SELECT type_id, count(*) AS n FROM ent WHERE merged_into IS NULL GROUP BY 1"))
def entities_by_type(spark, sf_dir, store):
    return query.entities_by_type(store)


@registered("A6_degree", sql(f"SELECT id, count(*) AS degree FROM (SELECT DISTINCT s.id AS sid, unnest([subject_id, object_id]) AS id FROM stmt s WHERE {VISIBLE} AND value_type = 'entity') GROUP BY 1"))
def degree(spark, sf_dir, store):
    return query.degree(store)


@registered("A7_multigraph_degree", sql("SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1"))
def multigraph_degree(spark, sf_dir, store):
    return graph.degrees(graph.edges(store), 2)


@registered("A9_predicates_of_subject", sql(f"SELECT subject_id, string_agg(DISTINCT predicate_id, ',' ORDER BY predicate_id) AS via FROM stmt WHERE {VISIBLE} AND subject_id LIKE 'order:%' GROUP BY 1"))
def predicates_of_subject(spark, sf_dir, store):
    said = store.statements.where(filters.visible() & F.col("subject_id").startswith("order:"))
    return said.groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set("predicate_id")), ",").alias("via"))


@registered("A10_duplicate_names", sql(f"SELECT value_text, count(DISTINCT subject_id) AS n FROM stmt WHERE {VISIBLE} AND predicate_id = 'name' GROUP BY 1 HAVING count(DISTINCT subject_id) > 1"))
def duplicate_names(spark, sf_dir, store):
    return query.duplicates(store, "name")


@registered("A11_best_labels", sql(f"SELECT subject_id, arg_max(value_text, system_from) AS label FROM stmt WHERE {VISIBLE} AND predicate_id = 'name' GROUP BY 1"))
def best_labels(spark, sf_dir, store):
    return query.best_labels(store)


@registered("A12_turns_per_conversation", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def turns(spark, sf_dir, store):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("n"))


@registered("A15_telemetry", "SELECT event_type AS tool, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, sum(CAST(length(props) AS BIGINT))::BIGINT AS bytes FROM events GROUP BY 1")
def telemetry(spark, sf_dir, store):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("tool"))
    return rows.agg(F.count("*").alias("calls"), query.money("value").cast("double").alias("total"), F.sum(F.length("props")).cast("long").alias("bytes"))


# -- patterns and sets

FACTS = f"SELECT * FROM stmt WHERE {VISIBLE}"


@registered("J3_chain2", sql(f"SELECT DISTINCT a.subject_id AS o, b.object_id AS n FROM ({FACTS}) a JOIN ({FACTS}) b ON b.subject_id = a.object_id WHERE a.predicate_id = 'placed_by' AND b.predicate_id = 'located_in'"))
def chain2(spark, sf_dir, store):
    return match.match(store, [("?o", "placed_by", "?c"), ("?c", "located_in", "?n")], ["?o", "?n"])


@registered("J3_chain3", sql(f"""SELECT DISTINCT a.object_id AS p, c.object_id AS n FROM ({FACTS}) a JOIN ({FACTS}) b ON b.subject_id = a.subject_id AND b.predicate_id = 'placed_by'
    JOIN ({FACTS}) c ON c.subject_id = b.object_id AND c.predicate_id = 'located_in' WHERE a.predicate_id = 'contains' AND a.confidence >= 0.8 AND b.confidence >= 0.8 AND c.confidence >= 0.8"""))
def chain3(spark, sf_dir, store):
    return match.match(store, [("?o", "contains", "?p"), ("?o", "placed_by", "?c"), ("?c", "located_in", "?n")], ["?p", "?n"], min_confidence=0.8)


@registered("J3_same_nation", sql(f"""SELECT DISTINCT a.subject_id AS o, b.object_id AS s, n1.object_id AS n FROM ({FACTS}) a JOIN ({FACTS}) b ON b.subject_id = a.subject_id AND b.predicate_id = 'supplied_by'
    JOIN ({FACTS}) n1 ON n1.subject_id = a.object_id AND n1.predicate_id = 'located_in' JOIN ({FACTS}) n2 ON n2.subject_id = b.object_id AND n2.predicate_id = 'located_in' AND n2.object_id = n1.object_id
    WHERE a.predicate_id = 'placed_by'"""))
def same_nation(spark, sf_dir, store):
    return match.match(store, [("?o", "placed_by", "?c"), ("?o", "supplied_by", "?s"), ("?c", "located_in", "?n"), ("?s", "located_in", "?n")], ["?o", "?s", "?n"])


@registered("J3_text", sql(f"SELECT DISTINCT a.subject_id AS o FROM ({FACTS}) a JOIN ({FACTS}) b ON b.subject_id = a.object_id WHERE a.predicate_id = 'placed_by' AND b.predicate_id = 'segment' AND b.value_text = 'BUILDING'"))
def text_pattern(spark, sf_dir, store):
    return match.match(store, [("?o", "placed_by", "?c"), ("?c", "segment", match.Text("BUILDING"))], ["?o"])


@registered("J3_predicate_variable", sql(f"SELECT DISTINCT predicate_id AS p FROM ({FACTS}) WHERE subject_id = 'order:1'"))
def predicate_variable(spark, sf_dir, store):
    return match.match(store, [("order:1", "?p", "?o"), ], ["?p"]).unionByName(
        query.matching(store, subject="order:1").where("value_type <> 'entity'").select(F.col("predicate_id").alias("p"))).distinct()


@registered("J3_cross_product", sql(f"SELECT DISTINCT a.subject_id AS x, b.subject_id AS y FROM ({FACTS}) a, ({FACTS}) b WHERE a.predicate_id = 'part_of' AND a.object_id = 'region:0' AND b.predicate_id = 'part_of' AND b.object_id = 'region:1'"))
def cross_product(spark, sf_dir, store):
    return match.match(store, [("?x", "part_of", "region:0"), ("?y", "part_of", "region:1")], ["?x", "?y"])


def _set_sql(op: str) -> str:
    one = f"SELECT DISTINCT subject_id AS id FROM ({FACTS}) WHERE predicate_id = 'contains' AND object_id = 'part:{{}}'"
    return sql(f"({one.format(1)}) {op} ({one.format(2)}) {op} ({one.format(3)})")


PARTS = [{"predicate_id": "contains", "object_id": f"part:{i}"} for i in (1, 2, 3)]


@registered("O1_intersect", sql(f"SELECT DISTINCT subject_id AS id FROM ({FACTS}) WHERE predicate_id = 'placed_by' AND confidence >= 0.5 INTERSECT SELECT DISTINCT subject_id FROM ({FACTS}) WHERE predicate_id = 'supplied_by' AND object_id = 'supplier:1'"))
def intersect(spark, sf_dir, store):
    return match.set_operation(store, "intersect", [{"predicate_id": "placed_by", "min_confidence": 0.5}, {"predicate_id": "supplied_by", "object_id": "supplier:1"}])


@registered("O2_union", _set_sql("UNION"))
def union(spark, sf_dir, store):
    return match.set_operation(store, "union", PARTS)


@registered("O3_difference", _set_sql("EXCEPT"))
def difference(spark, sf_dir, store):
    return match.set_operation(store, "difference", PARTS)


# -- history


@registered("W2_label_changes", sql("""SELECT subject_id, moment AS "at", old || ' → ' || new AS detail FROM (SELECT subject_id, system_from AS moment, lag(value_text) OVER (PARTITION BY subject_id ORDER BY system_from, id) AS old,
    value_text AS new FROM stmt WHERE predicate_id = 'did' AND rank <> 'deprecated') WHERE old <> new"""))
def label_changes(spark, sf_dir, store):
    return history.label_changes(store.statements, "did")


@registered("W3_runs", """WITH r AS (SELECT *, date_trunc('minute', ts) AS minute, date_trunc('hour', ts) AS hour FROM events), f AS (SELECT *, CASE WHEN lag(minute) OVER w = minute AND lag(event_type) OVER w = event_type
    THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY hour ORDER BY ts, event_type, event_id)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY hour ORDER BY ts, event_type, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
    SELECT minute, event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM g GROUP BY hour, run, minute, event_type HAVING count(*) >= 2""")
def runs(spark, sf_dir, store):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "ts", "event_type")
    out = history.runs(rows, ["event_type"], "ts", least=2)
    return out.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@registered("W5_timeline", sql(f"""SELECT 'event' AS kind, v.subject_id AS id, b.at, v.detail FROM (SELECT s.subject_id, string_agg(DISTINCT s.predicate_id, ',' ORDER BY s.predicate_id) AS detail FROM stmt s JOIN ent e
    ON e.id = s.subject_id AND e.type_id = 'Order' WHERE {VISIBLE} AND s.object_id = 'customer:1' GROUP BY 1) v LEFT JOIN (SELECT subject_id, max(value_datetime) AS at FROM stmt WHERE {VISIBLE} AND value_type = 'datetime' GROUP BY 1) b
    ON b.subject_id = v.subject_id"""))
def timeline(spark, sf_dir, store):
    return history.timeline(store, "customer:1")


@registered("W6_changes", sql("""SELECT id, CASE WHEN rank = 'deprecated' THEN 'deprecated' ELSE 'added' END AS change, system_from AS changed_at FROM stmt
    WHERE system_from BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-02-01'"""))
def changes(spark, sf_dir, store):
    return history.changes(store, "1997-01-01 00:00:00", "1997-02-01 00:00:00").select("id", "change", "changed_at")


@registered("W1_rank_in_group", sql("SELECT id, degree, row_number() OVER (PARTITION BY split_part(id, ':', 1) ORDER BY degree DESC, id) AS place FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) QUALIFY place <= 5"))
def rank_in_group(spark, sf_dir, store):
    from pyspark.sql import Window

    w = Window.partitionBy(F.split("id", ":")[0]).orderBy(F.desc("degree"), "id")
    return graph.degrees(graph.edges(store), 2).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5")


@registered("L9_nulls_last", sql("SELECT id, row_number() OVER (ORDER BY retrieved_at DESC NULLS LAST, id) AS place FROM src ORDER BY retrieved_at DESC NULLS LAST, id LIMIT 100"))
def nulls_last(spark, sf_dir, store):
    from pyspark.sql import Window

    order = [F.desc_nulls_last("retrieved_at"), F.asc("id")]
    top = store.sources.orderBy(*order).limit(100)  # the window numbers 100 rows
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "place")


# -- graph

PAIRS = "SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge) WHERE a <> b"


def _bfs(start: str, depth: int) -> dict[str, str]:
    out = {"pair": PAIRS, "l0": f"SELECT '{start}' AS node, 0 AS depth"}
    for d in range(1, depth + 1):
        out[f"l{d}"] = f"SELECT * FROM l{d - 1} UNION ALL SELECT DISTINCT p.b, {d} FROM pair p JOIN l{d - 1} x ON x.node = p.a AND x.depth = {d - 1} WHERE p.b NOT IN (SELECT node FROM l{d - 1})"
    return out


@registered("G1_levels", sql("SELECT node, depth FROM l3", **_bfs("customer:1", 3)))
def levels(spark, sf_dir, store):
    return graph.levels(stored(spark, graph.both_ways(graph.edges(store)), "pairs"), "customer:1", 3)


@registered("G1_neighborhood", sql("""SELECT x.node, x.depth, coalesce(d.degree, 0) AS degree, (SELECT count(*) FROM l2) AS total_nodes FROM (SELECT * FROM l2 ORDER BY depth, node LIMIT 40) x
    LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) d ON d.id = x.node""", **_bfs("customer:1", 2)))
def neighborhood(spark, sf_dir, store):
    return graph.neighborhood(store, "customer:1", 2, max_nodes=40)[0]


@registered("G1_stored_neighborhood", _SQL["G1_neighborhood"])
def stored_neighborhood(spark, sf_dir, store):
    """The same from a stored graph, which a service would keep between requests."""
    stock = stored_graph.GraphStore(spark, new_folder(spark, "graph"))
    stock.build(store)
    return stock.neighborhood("customer:1", 2, max_nodes=40)[0]


@registered("G1_induced_edges", sql("SELECT e.id, e.src, e.dst FROM edge e WHERE e.src IN (SELECT node FROM l2) AND e.dst IN (SELECT node FROM l2)", **_bfs("customer:1", 2)))
def induced_edges(spark, sf_dir, store):
    return graph.neighborhood(store, "customer:1", 2, max_nodes=1_000_000)[1].select("id", "src", "dst")


def _paths(start: str, end: str, depth: int) -> dict[str, str]:
    """Counts of shortest paths from start by level."""
    out = {"pair": PAIRS, "c0": f"SELECT '{start}' AS node, 0 AS depth, 1::HUGEINT AS paths"}
    for d in range(1, depth + 1):
        out[f"c{d}"] = f"SELECT * FROM c{d - 1} UNION ALL SELECT p.b, {d}, sum(x.paths)::HUGEINT FROM pair p JOIN c{d - 1} x ON x.node = p.a AND x.depth = {d - 1} WHERE p.b NOT IN (SELECT node FROM c{d - 1}) GROUP BY 1"
    return out


@registered("G2_shortest_paths_total", sql("SELECT depth AS length, paths::BIGINT AS total FROM c4 WHERE node = 'customer:2'", **_paths("customer:1", "customer:2", 4)))
def shortest_paths_total(spark, sf_dir, store):
    rows = graph.shortest_paths(store, "customer:1", "customer:2", max_depth=4, max_paths=1)
    return rows.select("length", F.col("total").cast("long").alias("total"))


@registered("G2_shortest_paths", sql("""SELECT array_to_string([a.a, a.b, b.b, c.b, d.b], ' ') AS nodes FROM pair a JOIN pair b ON b.a = a.b JOIN pair c ON c.a = b.b JOIN pair d ON d.a = c.b WHERE a.a = 'customer:1' AND d.b = 'customer:2'
    AND (SELECT depth FROM c4 WHERE node = 'customer:2') = 4 AND b.b NOT IN (a.a) AND c.b NOT IN (a.a, a.b) ORDER BY d.b, c.b, b.b, a.b LIMIT 20""", **_paths("customer:1", "customer:2", 4)))
def shortest_paths(spark, sf_dir, store):
    rows = graph.shortest_paths(store, "customer:1", "customer:2", max_depth=4, max_paths=20).where("length = 4")
    return rows.select(F.array_join("nodes", " ").alias("nodes"))


@registered("G3_path_to_targets")
def path_to_targets(spark, sf_dir, store):
    return graph.path_to_targets(store, "order:1", ["region:0", "region:1", "region:2", "region:3", "region:4"])


@registered("G4_common_neighbors", sql("""SELECT neighbor, count(*) AS shared_count, string_agg(node, ',' ORDER BY node) AS shared_with FROM (SELECT DISTINCT src AS node, dst AS neighbor FROM edge WHERE predicate_id = 'part_of'
    AND src IN ('nation:0', 'nation:1', 'nation:2', 'nation:3', 'nation:4', 'nation:5', 'nation:6', 'nation:7')) GROUP BY 1 HAVING count(*) >= 2"""))
def common_neighbors(spark, sf_dir, store):
    return graph.common_neighbors(store, [f"nation:{i}" for i in range(8)], ["part_of"], "out", 2)


@registered("X4_merged_start", sql("""SELECT x.node, x.depth FROM l1 x""", **_bfs("customer:97", 1)))
def merged_start(spark, sf_dir, store):
    """Customer 99 was merged into 98, and that into 97."""
    return graph.neighborhood(store, "customer:99", 1, max_nodes=1_000_000)[0].select("node", "depth")


@registered("X4_match_merged", sql(f"SELECT DISTINCT subject_id AS o FROM ({FACTS}) WHERE predicate_id = 'placed_by' AND object_id = 'customer:97'"))
def match_merged(spark, sf_dir, store):
    return match.match(store, [("?o", "placed_by", "customer:98")], ["?o"])


NEAR = "SELECT DISTINCT dst AS node, src AS neighbor FROM edge WHERE predicate_id = 'contains'"


@registered("G5_similar", sql("""SELECT s.node AS id, s.overlap, round(s.overlap / (z.n + (SELECT count(*) FROM near WHERE node = 'part:1') - s.overlap), 9) AS score FROM (SELECT b.node, count(*) AS overlap FROM near a JOIN near b
    ON b.neighbor = a.neighbor AND b.node <> a.node WHERE a.node = 'part:1' GROUP BY 1) s JOIN (SELECT node, count(*) AS n FROM near GROUP BY 1) z ON z.node = s.node""", near=NEAR))
def similar(spark, sf_dir, store):
    return graph.similar(store, "part:1", ["contains"], "in").withColumn("score", F.round("score", 9))


@registered("G6_top_degree", sql("SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) WHERE id LIKE 'part:%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"))
def top_degree(spark, sf_dir, store):
    return graph.of_type(store, graph.degrees(graph.edges(store), 2), "Part").orderBy(F.desc("degree"), "id").limit(20)


def _pagerank_sql(rounds: int) -> str:
    parts = {
        "ends": "SELECT src AS a, dst AS b FROM edge UNION ALL SELECT dst, src FROM edge",
        "od": "SELECT a, count(*) AS d FROM ends GROUP BY 1",
        "node": "SELECT e.id, o.d FROM ent e LEFT JOIN od o ON o.a = e.id WHERE e.merged_into IS NULL",
        "nn": "SELECT count(*)::DOUBLE AS n FROM node",
        "r0": "SELECT id, d, 1.0 / (SELECT n FROM nn) AS r FROM node",
    }
    for i in range(1, rounds + 1):
        parts[f"r{i}"] = (
            f"SELECT x.id, x.d, 0.15 / (SELECT n FROM nn) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE d IS NULL) / (SELECT n FROM nn)) AS r FROM node x "
            f"LEFT JOIN (SELECT e.b, sum(p.r / p.d) AS got FROM ends e JOIN r{i - 1} p ON p.id = e.a GROUP BY 1) g ON g.b = x.id"
        )
    return sql(f"SELECT id AS node, round(r, 9) AS pagerank FROM r{rounds}", **parts)


def _ends(spark: SparkSession, store: model.Store) -> DataFrame:
    """The ends of all edges. Ids of edges are numbers in a window over all lines, which is left out where nothing reads them."""
    return stored(spark, graph.edges(store).select("src", "dst"), "edges")


@registered("G7_pagerank", _pagerank_sql(3))
def pagerank(spark, sf_dir, store):
    nodes = store.entities.where("merged_into IS NULL").select(F.col("id").alias("node"))
    return graph.pagerank(_ends(spark, store), nodes, rounds=3).withColumn("pagerank", F.round("pagerank", 9))


@registered("G7_pagerank_converged")
def converged_pagerank(spark, sf_dir, store):
    """The ranks as they settle, of all live entities over all edges; G7_pagerank states the plain round."""
    nodes = store.entities.where("merged_into IS NULL").select(F.col("id").alias("node"))
    return graph.pagerank(_ends(spark, store), nodes)


@registered("G8_betweenness")
def betweenness(spark, sf_dir, store):
    """Exact, of all nodes over all edges: searches from every node, so the work is nodes times edges."""
    return graph.betweenness(graph.edges(store))


@registered("G9_clusters")
def clusters(spark, sf_dir, store):
    return graph.clusters(_ends(spark, store))


@registered("G9_clusters_modularity")
def modularity_clusters(spark, sf_dir, store):
    """Communities of high modularity over all edges."""
    return graph.clusters(_ends(spark, store), method="modularity")


@registered("G9_modularity", sql("""SELECT round(sum(inside) / max(m) - sum((total / m) * (total / m)), 9) AS modularity FROM (SELECT ca, sum(CASE WHEN ca = cb THEN 1 ELSE 0 END)::DOUBLE AS inside, count(*)::DOUBLE AS total,
    sum(count(*)) OVER ()::DOUBLE AS m FROM (SELECT coalesce(x.home, a) AS ca, coalesce(y.home, b) AS cb FROM ends LEFT JOIN home x ON x.id = a LEFT JOIN home y ON y.id = b) GROUP BY 1)""",
    ends="SELECT src AS a, dst AS b FROM edge WHERE src <> dst UNION ALL SELECT dst, src FROM edge WHERE src <> dst",
    home="SELECT src AS id, min(dst) AS home FROM edge WHERE predicate_id IN ('located_in', 'placed_by') GROUP BY 1"))
def modularity_of_homes(spark, sf_dir, store):
    """Of a given partition: agents with their nation, orders with their customer, all others alone."""
    e = stored(spark, graph.edges(store), "edges")
    links = e.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("w"))
    home = e.where(F.col("predicate_id").isin("located_in", "placed_by")).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("home"))
    members = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(home, "node", "left").select("node", F.coalesce("home", "node").alias("community"))
    return modularity.modularity(links, members, one_way=True).withColumn("modularity", F.round("modularity", 9))


@registered("G10_metrics")
def metrics(spark, sf_dir, store):
    return graph.metrics(store)


@registered("G11_skeleton")
def skeleton(spark, sf_dir, store):
    return graph.skeleton(stored(spark, graph.metrics(store), "metrics"))


@registered("G11_stored_skeleton")
def stored_skeleton(spark, sf_dir, store):
    """The edges among the nodes to draw, from stored metrics."""
    stock = stored_graph.GraphStore(spark, new_folder(spark, "graph"))
    stock.recompute(store)
    return stock.skeleton()[1].select("id", "src", "dst")


@registered("G12_snapshot", sql("""SELECT e.id, e.src, e.dst FROM edge e WHERE e.src IN (SELECT id FROM top) AND e.dst IN (SELECT id FROM top)""",
    top="SELECT id FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) JOIN ent USING (id) ORDER BY degree DESC, created_at DESC, id LIMIT 200"))
def snapshot(spark, sf_dir, store):
    return graph.snapshot(store, 200)[1].select("id", "src", "dst")


@registered("G13_positions", "SELECT user_id::VARCHAR AS node, arg_max(value, ts) AS x, arg_max(event_id, ts)::DOUBLE AS y FROM events GROUP BY 1")
def positions(spark, sf_dir, store):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return graph.positions(rows.select(F.col("user_id").cast("string").alias("node"), F.col("ts").alias("at"), F.col("value").alias("x"), F.col("event_id").cast("double").alias("y")))


@registered("G15_ghosts", sql("""SELECT x.node, d.degree - coalesce(i.n, 0) AS ghosts FROM l1 x JOIN (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) d ON d.id = x.node
    LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id, dst AS o FROM edge UNION ALL SELECT dst, src FROM edge) WHERE o IN (SELECT node FROM l1) AND id IN (SELECT node FROM l1) GROUP BY 1) i ON i.id = x.node""", **_bfs("customer:1", 1)))
def ghosts(spark, sf_dir, store):
    nodes, inside = graph.neighborhood(store, "customer:1", 1, max_nodes=1_000_000)
    own = graph.degrees(inside).select(F.col("id").alias("node"), F.col("degree").alias("inside"))
    return nodes.join(own, "node", "left").select("node", (F.col("degree") - F.coalesce("inside", F.lit(0))).alias("ghosts"))


# -- text, vectors, resolution

GRAMS = "SELECT id, substr(t, i, 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT id, '  ' || lower(trim(label)) || '  ' AS t FROM ent WHERE merged_into IS NULL AND label IS NOT NULL))"
HASHED = "SELECT id, ('0x' || substr(sha1(g), 14, 3))::INTEGER & 1023 AS dim, CASE WHEN substr(sha1(g), 1, 1) >= '8' THEN -1.0 ELSE 1.0 END AS sign FROM grams"
VECTORS = "SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM (SELECT id, dim, sum(sign)::DOUBLE AS x FROM hashed GROUP BY 1, 2 HAVING sum(sign) <> 0)"


@registered("R1_embed", sql("SELECT id, dim, round(w, 9) AS w FROM vec", grams=GRAMS, hashed=HASHED, vec=VECTORS))
def embed(spark, sf_dir, store):
    """All live labels."""
    return resolve.embed(store.entities.where("merged_into IS NULL AND label IS NOT NULL"), "id", "label").withColumn("w", F.round("w", 9))


@registered("R2_label_similarity", sql("SELECT a.id AS query, b.id, round(sum(a.w * b.w), 9) AS similarity FROM vec a JOIN vec b USING (dim) WHERE CAST(split_part(a.id, ':', 2) AS BIGINT) % 20 = 0 GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.5 - 1e-9", grams=GRAMS, hashed=HASHED, vec=VECTORS))
def label_similarity(spark, sf_dir, store):
    """The labels of entities with a key divisible by 20 against all live labels."""
    live = store.entities.where("merged_into IS NULL AND label IS NOT NULL").select("id", F.col("label").alias("text"))
    asked = live.where(F.split("id", ":")[1].cast("long") % 20 == 0).withColumnRenamed("id", "query")
    return resolve.similar_texts(asked, live, 0.5).withColumn("similarity", F.round("similarity", 9))


@registered("R2_nearest_vectors", """SELECT query, id, round(similarity, 6) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    WHERE place <= 5""")
def nearest_vectors(spark, sf_dir, store):
    """The nearest five of all vectors to each of all."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.select(F.col("id").alias("query"), F.col("v").alias("q"))
    return resolve.nearest(asked, v, 5).select("query", "id", F.round("similarity", 6).alias("similarity"))


@registered("R2_nearest_index")
def nearest_index(spark, sf_dir, store):
    """The same by a stored index: about the nearest five of all vectors to each twentieth."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    return vector_index.VectorIndex.build(v).search(asked).select("query", "id", F.round("similarity", 6).alias("similarity"))


@registered("R3_semantic_search")
def semantic_search(spark, sf_dir, store):
    return resolve.semantic_search(store, "NATION_1", "Place", 10)


@registered("R5_resolve")
def resolve_batch(spark, sf_dir, store):
    """All candidates for suppliers: by key, by label, by a label with a letter too many, and by the last characters of one."""
    k = F.col("s_suppkey") % 4
    label = F.when(k == 1, F.lower("s_name")).when(k == 2, F.concat("s_name", F.lit("x"))).when(k == 3, F.substr(F.col("s_name"), F.lit(-6))).otherwise(F.lower("s_name"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ref"), F.lit("Agent").alias("type_id"), label.alias("label"), F.when(k == 0, F.col("s_name")).alias("key"))
    return resolve.candidates(store, rows)


@registered("R6_get_or_create", """SELECT s_suppkey AS ref, s_suppkey % 2 = 1 AS created, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier:' || s_suppkey ELSE 'new:' || sha1('Supplier|brand new house ' || reverse(sha1(s_suppkey::VARCHAR))) END AS id FROM supplier""")
def get_or_create(spark, sf_dir, store):
    fresh = F.concat(F.lit("Brand new house "), F.reverse(F.sha1(F.col("s_suppkey").cast("string"))))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ref"), F.lit("Supplier").alias("type_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(fresh).alias("label"))
    return resolve.get_or_create(store, rows.withColumn("key", F.col("label"))).select("ref", "created", "id")


@registered("X4_canonical", "SELECT 'customer:' || c_custkey AS id, 'customer:' || (c_custkey - (c_custkey % 100 - 97)) AS canonical_id FROM customer WHERE c_custkey % 100 >= 98")
def canonical(spark, sf_dir, store):
    return resolve.canonical_ids(store.entities)


@registered("R7_merge_rewrite", """SELECT 'customer:' || CASE WHEN o_custkey % 100 >= 98 THEN o_custkey - (o_custkey % 100 - 97) ELSE o_custkey END AS customer, count(*) AS n FROM orders GROUP BY 1""")
def merge_rewrite(spark, sf_dir, store):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("subject_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("object_id"))
    out = resolve.rewritten(raw, resolve.canonical_ids(store.entities))
    return out.groupBy(F.col("object_id").alias("customer")).agg(F.count("*").alias("n"))


# -- writes


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as `placed_by` candidates with faults by their key: of 20, 1 has no source, 2 a bad confidence, 3 an unknown customer, 4 an
    unknown predicate, 5 a supplier as its customer, 6 a reversed window; the others are there already."""
    k = F.col("o_orderkey") % 20
    order = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    customer = F.concat(F.lit("customer:"), model.canonical_customer(F.col("o_custkey")).cast("string"))
    none = lambda t: F.lit(None).cast(t)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("ord"), order.alias("subject_id"), F.when(k == 4, "was_placed").otherwise("placed_by").alias("predicate_id"), F.lit("entity").alias("value_type"),
        F.when(k == 3, "customer:none").when(k == 5, "supplier:1").otherwise(customer).alias("object_id"),
        none("string").alias("value_text"), none("double").alias("value_number"), none("string").alias("value_unit"), none("timestamp_ntz").alias("value_datetime"),
        F.lit("normal").alias("rank"), F.when(k == 2, 1.5).otherwise(1.0).alias("confidence"), F.col("o_orderdate").alias("valid_from"),
        F.when(k == 6, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).when(k == 7, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("valid_to"),
        F.when(k != 1, F.concat(F.lit("src:"), order)).alias("source_id"),
    )


@registered("V2_validate", """SELECT o_orderkey AS ord, CASE o_orderkey % 20 WHEN 1 THEN 'no source' WHEN 2 THEN 'bad confidence' WHEN 3 THEN 'unknown object' WHEN 4 THEN 'unknown predicate' WHEN 5 THEN 'range'
    WHEN 6 THEN 'valid_from after valid_to' ELSE '' END AS problems FROM orders""")
def validate(spark, sf_dir, store):
    return write.validate(store, _candidates(spark, sf_dir)).select("ord", F.array_join("problems", "; ").alias("problems"))


@registered("V3_plan_commit", "SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 6 THEN 'reject' WHEN o_orderkey % 20 = 7 THEN 'insert' ELSE 'reconfirm' END AS outcome FROM orders")
def plan_commit(spark, sf_dir, store):
    return write.plan_commit(store, _candidates(spark, sf_dir)).select("ord", "outcome")


@registered("V3_mixed_commit", """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 20 BETWEEN 1 AND 6 THEN 'reject' WHEN o_orderkey % 20 = 7 THEN 'insert' ELSE 'reconfirm' END AS outcome FROM orders UNION ALL
    SELECT -s_suppkey - 1, CASE s_suppkey % 4 WHEN 0 THEN 'reconfirm' WHEN 1 THEN CASE WHEN s_suppkey < (SELECT max(s_suppkey) FROM supplier) THEN 'conflict' ELSE 'insert' END
    WHEN 2 THEN CASE WHEN s_suppkey < (SELECT max(s_suppkey) FROM supplier) THEN 'conflict' ELSE 'insert' END ELSE 'insert' END FROM supplier""")
def mixed_commit(spark, sf_dir, store):
    """Entity values and identifying names in one batch, in order of ord. Of four suppliers, one repeats its name, one claims that of the next,
    one a new name that the next, which comes before it, claims as well."""
    k = F.col("s_suppkey") % 4
    none = lambda t: F.lit(None).cast(t)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    top = s.agg(F.max("s_suppkey").alias("top"))
    after = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("next"))
    s = s.join(after, "s_suppkey", "left").crossJoin(F.broadcast(top))  # one row
    text = F.when(k == 0, F.col("s_name")).when(k == 1, F.coalesce("next", F.lit("nobody's"))).when(k == 2, F.concat(F.lit("Fresh "), (F.col("s_suppkey") + 1).cast("string"))).otherwise(F.concat(F.lit("Fresh "), F.col("s_suppkey").cast("string")))
    names = s.select(
        (-F.col("s_suppkey") - 1).alias("ord"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("subject_id"), F.lit("name").alias("predicate_id"), F.lit("string").alias("value_type"),
        none("string").alias("object_id"), text.alias("value_text"), none("double").alias("value_number"), none("string").alias("value_unit"), none("timestamp_ntz").alias("value_datetime"),
        F.lit("normal").alias("rank"), F.lit(1.0).alias("confidence"), none("timestamp_ntz").alias("valid_from"), none("timestamp_ntz").alias("valid_to"), F.lit("src:master").alias("source_id"),
    )
    return write.plan_commit(store, _candidates(spark, sf_dir).unionByName(names)).select("ord", "outcome")


def _said(spark, rows: DataFrame, ord_: str, **given) -> DataFrame:
    """Candidates from rows of statements, with some columns replaced."""
    columns = "subject_id predicate_id value_type object_id value_text value_number value_unit value_datetime valid_from valid_to".split()
    own = {c: given.get(c, F.col(c)) for c in columns}
    return rows.select(F.expr(ord_).cast("long").alias("ord"), *[v.alias(c) for c, v in own.items()], F.lit("normal").alias("rank"), F.lit(1.0).alias("confidence"), F.lit("src:master").alias("source_id"))


@registered("V3_commit_rules", sql(f"""SELECT ord, outcome FROM (
    SELECT k * 1000 + n * 10 + 1 AS ord, CASE WHEN kept > 0 THEN 'reconfirm' WHEN row_number() OVER (PARTITION BY subject_id, object_id, valid_from ORDER BY n) = 1 THEN 'insert' ELSE 'reconfirm' END AS outcome
    FROM (SELECT *, count(*) FILTER (rank <> 'deprecated') OVER (PARTITION BY subject_id, object_id, valid_from) AS kept FROM said WHERE predicate_id = 'supplied_by')
    UNION ALL SELECT k * 1000 + n * 10 + 2, CASE WHEN row_number() OVER (PARTITION BY subject_id, object_id, valid_from ORDER BY n) = 1 THEN 'insert' ELSE 'reconfirm' END FROM said WHERE predicate_id = 'contains'
    UNION ALL SELECT -s_suppkey * 10 - 3, 'reconfirm' FROM supplier
    UNION ALL SELECT -c_custkey * 10 - 4, CASE WHEN EXISTS (SELECT 1 FROM customer y WHERE y.c_custkey = root AND y.c_nationkey = x.c_nationkey) THEN 'reconfirm'
        WHEN row_number() OVER (PARTITION BY root, c_nationkey ORDER BY c_custkey DESC) = 1 THEN 'insert' ELSE 'reconfirm' END
        FROM (SELECT *, c_custkey - (c_custkey % 100 - 97) AS root FROM customer WHERE c_custkey % 100 >= 98) x
    UNION ALL SELECT o_orderkey * 1000 + 5, CASE WHEN o_orderkey % 2 = 0 THEN 'insert' ELSE 'reconfirm' END FROM orders)""",
    said="SELECT *, CAST(split_part(id, '|', 3) AS BIGINT) AS n, CAST(split_part(subject_id, ':', 2) AS BIGINT) AS k FROM stmt WHERE predicate_id IN ('supplied_by', 'contains') AND system_to IS NULL"))
def commit_rules(spark, sf_dir, store):
    """Everything that is open is said again: of lines without qualifiers those that are only deprecated are new; of lines with qualifiers none
    is confirmed by the store; names of suppliers are confirmed in another window; merged customers stand for others; a status with a
    qualifier is new."""
    now = store.statements.where("system_to IS NULL")
    k, n = "CAST(split_part(subject_id, ':', 2) AS BIGINT)", "CAST(split_part(id, '|', 3) AS BIGINT)"
    moved = F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")
    rows = [
        _said(spark, now.where("predicate_id = 'supplied_by'"), f"{k} * 1000 + {n} * 10 + 1"),
        _said(spark, now.where("predicate_id = 'contains'"), f"{k} * 1000 + {n} * 10 + 2"),
        _said(spark, now.where("predicate_id = 'name' AND subject_id LIKE 'supplier:%'"), f"-{k} * 10 - 3", valid_from=moved),
        _said(spark, now.where(f"predicate_id = 'located_in' AND subject_id LIKE 'customer:%' AND {k} % 100 >= 98"), f"-{k} * 10 - 4"),
        _said(spark, now.where("predicate_id = 'status'"), f"{k} * 1000 + 5"),
    ]
    quals = now.where(f"predicate_id = 'status' AND {k} % 2 = 0").select(F.expr(f"{k} * 1000 + 5").alias("ord"), F.lit("quantity").alias("predicate_id"), F.lit(1.0).alias("value_number"), F.lit(None).cast("string").alias("value_unit"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return write.plan_commit(store, out, quals).select("ord", "outcome")


@registered("S14_written_store", """SELECT 'supplier:' || s_suppkey AS subject_id, p AS predicate_id, rank, current FROM supplier, (VALUES ('located_in', 'normal', TRUE, 9), ('name', 'normal', TRUE, 0), ('name', 'normal', FALSE, 1), ('name', 'deprecated', TRUE, 1)) v(p, rank, current, k)
    WHERE k = 9 OR k = CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END""")
def written_store(spark, sf_dir, store):
    """Suppliers' names and places committed in three batches, one of them twice; a fifth of the names withdrawn; then compacted."""
    out = log.Log(spark, new_folder(spark, "log"))
    alive = store.entities.where(F.col("type_id").isin("Supplier", "Nation"))
    out.append("entities", {"entities": alive, "sources": store.sources.where("id = 'src:master'")}, 0)
    rows = store.statements.where("subject_id LIKE 'supplier:%' AND predicate_id IN ('name', 'located_in')")
    key = "CAST(split_part(subject_id, ':', 2) AS BIGINT)"
    said = _said(spark, rows, f"{key} * 2 + IF(predicate_id = 'name', 1, 0)")
    for batch in (0, 1, 0, 2):
        log.commit(out, store, said.where(F.expr(f"{key} % 3 = {batch}")), "1996-01-01 00:00:00", f"batch {batch}")
    names = out.rows("statements").where(F.expr(f"predicate_id = 'name' AND {key} % 5 = 0"))
    log.close(out, store, names.select("id", F.lit("deprecated").alias("rank"), F.lit(None).cast("double").alias("confidence")), "1997-01-01 00:00:00", "withdrawn")
    out.compact()
    return out.rows("statements").select("subject_id", "predicate_id", "rank", F.col("system_to").isNull().alias("current"))


@registered("X4_list_merged", sql(f"SELECT id, subject_id, predicate_id FROM stmt WHERE {VISIBLE} AND object_id = 'customer:97'"))
def list_merged(spark, sf_dir, store):
    """What is said of an entity, asked for by an id that went into it over two steps."""
    return query.matching(store, object="customer:99").select("id", "subject_id", "predicate_id")


@registered("X4_set_merged", sql(f"SELECT subject_id AS id FROM stmt WHERE {VISIBLE} AND object_id = 'customer:97' INTERSECT SELECT subject_id FROM stmt WHERE {VISIBLE} AND predicate_id = 'contains'"))
def set_merged(spark, sf_dir, store):
    return match.set_operation(store, "intersect", [{"object_id": "customer:98"}, {"predicate_id": "contains"}])


@registered("V6_supersede", sql("""SELECT predicate_id, rank, system_to IS NULL AS current, count(*) AS n FROM (SELECT predicate_id, rank, CASE WHEN predicate_id = 'segment' AND system_to IS NULL THEN TIMESTAMP '2000-01-01' ELSE system_to END AS system_to
    FROM stmt UNION ALL SELECT predicate_id, 'deprecated', NULL FROM stmt WHERE predicate_id = 'segment' AND system_to IS NULL) WHERE predicate_id IN ('segment', 'name') GROUP BY ALL"""))
def supersede(spark, sf_dir, store):
    said = store.statements.where(F.col("predicate_id").isin("segment", "name"))
    out = write.deprecate(said, said.where("predicate_id = 'segment'").select("id"), "2000-01-01 00:00:00")
    return out.groupBy("predicate_id", "rank", F.col("system_to").isNull().alias("current")).agg(F.count("*").alias("n"))


@registered("V6_supersede_children", sql("""SELECT k, n FROM (SELECT 'qualifiers' AS k, count(*) + count(*) FILTER (s.system_to IS NULL) AS n FROM quals q JOIN stmt s ON s.id = q.statement_id
    UNION ALL SELECT 'references', (SELECT count(*) FROM refs) + (SELECT count(*) FROM stmt WHERE predicate_id = 'contains' AND system_to IS NULL) UNION ALL SELECT 'statements', (SELECT count(*) FROM stmt)
    + (SELECT count(*) FROM stmt WHERE predicate_id = 'contains' AND system_to IS NULL))"""))
def supersede_children(spark, sf_dir, store):
    edits = store.statements.where("predicate_id = 'contains'").select("id", F.lit(None).cast("string").alias("rank"), F.lit(0.5).alias("confidence"))
    said, quals, refs = write.supersede_whole(store, edits, "2000-01-01 00:00:00")
    total = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")
    return total(quals, "qualifiers").unionByName(total(refs, "references")).unionByName(total(said, "statements"))


@registered("V9_fix_statements", sql("""SELECT id, CASE WHEN k % 4 = 0 THEN 'FIXED' ELSE value_text END AS value_text, confidence FROM (SELECT *, CAST(split_part(subject_id, ':', 2) AS BIGINT) AS k FROM stmt WHERE predicate_id = 'segment')
    WHERE k % 4 <> 1"""))
def fix_statements(spark, sf_dir, store):
    """Of four customers' segments, one is overwritten and one removed; a bad confidence and a missing reason keep the others as they are."""
    own = store.statements.where("predicate_id = 'segment'")
    k = F.split("subject_id", ":")[1].cast("long") % 4
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    fixes = own.select(
        "id", "predicate_id", F.when(k != 3, "wrong in the source").alias("reason"), (k == 1).alias("remove"), F.when(k == 0, "string").alias("value_type"), none("object_id", "string"), F.when(k == 0, "FIXED").alias("value_text"),
        none("value_number", "double"), none("value_unit", "string"), none("value_datetime", "timestamp_ntz"), none("rank", "string"), F.when(k >= 2, F.when(k == 2, 1.5).otherwise(0.1)).alias("confidence"),
        none("valid_from", "timestamp_ntz"), none("valid_to", "timestamp_ntz"),
    )
    return write.fix_statements(store, fixes)[0].where("predicate_id = 'segment'").select("id", "value_text", "confidence")


@registered("V10_removable", sql(f"""SELECT e.id, NOT EXISTS (SELECT 1 FROM stmt WHERE {VISIBLE} AND (subject_id = e.id OR object_id = e.id)) AND e.merged_into IS NULL AND e.id NOT IN
    (SELECT merged_into FROM ent WHERE merged_into IS NOT NULL) AS removable FROM ent e WHERE type_id IN ('Document', 'Customer', 'Page')"""))
def removable(spark, sf_dir, store):
    ids = store.entities.where(F.col("type_id").isin("Document", "Customer", "Page")).select("id")
    return write.removable(store, ids).select("id", "removable")


@registered("P1_closure", sql("""SELECT type_id, ancestor_id, coalesce(n, 0) AS n FROM c LEFT JOIN (SELECT type_id, count(*) AS n FROM ent WHERE merged_into IS NULL GROUP BY 1) USING (type_id)""", t="""{recursive}SELECT * FROM (VALUES ('Place', NULL), ('Region', 'Place'), ('Nation', 'Place'), ('Agent', NULL), ('Customer', 'Agent'), ('Supplier', 'Agent'), ('User', 'Agent'), ('Part', NULL), ('Document', NULL),
    ('Page', NULL), ('Conversation', NULL), ('Happening', NULL), ('Order', 'Happening')) v(id, parent)""", c="""SELECT id AS type_id, id AS ancestor_id FROM t UNION ALL SELECT c.type_id, t.parent FROM c JOIN t ON t.id = c.ancestor_id WHERE t.parent IS NOT NULL"""))
def closure(spark, sf_dir, store):
    """Each type under each type above it, with its live entities."""
    live = store.entities.where("merged_into IS NULL").groupBy("type_id").agg(F.count("*").alias("n"))
    return registry.closure(store.types).join(live, "type_id", "left").select("type_id", "ancestor_id", F.coalesce("n", F.lit(0)).alias("n"))


PROPOSED_PREDICATES = """SELECT o_orderkey AS k, 'p' || o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Nowhere' ELSE 'Agent' END AS domain_type,
    CASE WHEN o_orderkey % 10 = 0 THEN 'Nameable' END AS domain_interface, CASE o_orderkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'string' WHEN 2 THEN 'number' ELSE 'colour' END AS range_kind,
    CASE o_orderkey % 12 WHEN 0 THEN 'Part' WHEN 4 THEN 'Void' END AS range_type, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 < 3 THEN '1:1' ELSE 'n:m' END AS cardinality,
    o_orderkey % 6 = 1 AS identifying, CASE o_orderkey % 9 WHEN 0 THEN 'p' || (o_orderkey + 1) WHEN 1 THEN 'p' || (o_orderkey - 1) WHEN 2 THEN 'p' || (o_orderkey + 1) END AS inverse_id FROM orders"""


@registered("P5_review", f"""WITH p AS ({PROPOSED_PREDICATES}) SELECT p.id, concat_ws('; ', CASE WHEN p.domain_type IS NULL AND p.domain_interface IS NULL THEN 'no domain' END,
    CASE WHEN p.domain_type = 'Nowhere' THEN 'unknown domain type' END, CASE WHEN p.range_kind = 'colour' THEN 'unknown range kind' END, CASE WHEN p.range_type = 'Void' THEN 'unknown range type' END,
    CASE WHEN p.cardinality IS NULL THEN 'no cardinality' END, CASE WHEN p.identifying AND (p.range_kind <> 'string' OR p.cardinality <> '1:1') THEN 'identifying needs string and 1:1' END,
    CASE WHEN p.inverse_id IS NOT NULL AND b.inverse_id IS DISTINCT FROM p.id THEN 'inverse does not point back' END) AS problems FROM p LEFT JOIN p b ON b.id = p.inverse_id""")
def review(spark, sf_dir, store):
    """Orders as proposed predicates: what they propose follows from their keys."""
    proposed = spark.sql(PROPOSED_PREDICATES.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return registry.review(proposed, store.types).withColumn("problems", F.array_join("problems", "; "))


@registered("P6_status", "SELECT user_id AS proposal_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def proposal_status(spark, sf_dir, store):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return registry.status(rows.select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("at"), F.col("event_type").alias("status")))


# -- ingest, ad-hoc SQL, streams


@registered("S12_links", """SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def links(spark, sf_dir, store):
    return ingest.links(spark.read.parquet(f"{sf_dir}/pages.parquet")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@registered("S9_content_hashes", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hashes(spark, sf_dir, store):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@registered("I5_followers", """WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'user.' || user_id END AS username FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY username ORDER BY pos) AS k FROM r)
    SELECT pos, username, CASE WHEN username IS NULL THEN 'invalid' WHEN k > 1 THEN 'duplicate' WHEN username IN ('user.1', 'user.3') THEN 'confirmed' ELSE 'new_entity' END AS status FROM n""")
def followers(spark, sf_dir, store):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 7 == 0, "not a name!").otherwise(F.concat(F.lit(" @@User."), F.col("user_id").cast("string"), F.lit(" ")))
    known = model.literal_table(spark, [("user.1",), ("user.3",)], "username string")
    return ingest.follower_rows(e.select(F.col("event_id").alias("pos"), name.alias("username")), known)


@registered("A13_import_summary", "SELECT CASE WHEN event_id % 7 = 0 THEN 'invalid' WHEN k > 1 THEN 'duplicate' ELSE 'new_entity' END AS status, count(*) AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_id % 7 = 0 ORDER BY event_id) AS k FROM events) GROUP BY 1")
def import_summary(spark, sf_dir, store):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 7 == 0, "?").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return ingest.summary(ingest.follower_rows(e.select(F.col("event_id").alias("pos"), name.alias("username")), model.literal_table(spark, [("nobody",)], "username string")))


@registered("I4_snapshot", """SELECT c_custkey::VARCHAR AS ref, CASE c_custkey % 4 WHEN 0 THEN NULL ELSE 'nation:' || CASE c_custkey % 4 WHEN 1 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END END AS id,
    CASE c_custkey % 4 WHEN 0 THEN 'new_entity' WHEN 1 THEN 'confirmed' ELSE 'new_statement' END AS status FROM customer""")
def snapshot_import(spark, sf_dir, store):
    k = F.col("c_custkey") % 4
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = F.when(k == 1, F.col("c_nationkey")).otherwise((F.col("c_nationkey") + 1) % 25).cast("string")
    rows = c.select(F.col("c_custkey").cast("string").alias("ref"), F.when(k != 0, F.concat(F.lit("nation:"), nation)).alias("id"), F.lit("located_in").alias("predicate_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("owner"))
    return ingest.snapshot_rows(rows, query.matching(store, predicate="located_in"))


@registered("I1_extract", """SELECT c_custkey AS doc_id, 'name' AS predicate, c_name AS value, 0.95 AS confidence FROM customer UNION ALL SELECT c_custkey, 'alias', c_mktsegment, 0.9 FROM customer
    UNION ALL SELECT c_custkey, 'knows', 'Customer ' || c_nationkey, 0.85 FROM customer""")
def extract(spark, sf_dir, store):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.to_json(F.struct(F.lit("person").alias("kind"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"), F.array(F.struct(F.concat(F.lit("Customer "), F.col("c_nationkey").cast("string")).alias("name"))).alias("knows"), F.col("c_acctbal").alias("worth")))
    return ingest.extract_profile(c.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw")))[0]


@registered("I1_proposals", "SELECT c_custkey AS doc_id, 'worth' AS field FROM customer")
def proposals(spark, sf_dir, store):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("worth")))
    return ingest.extract_profile(c.select(F.col("c_custkey").alias("doc_id"), raw.alias("raw")))[1]


@registered("Q1_guarded_sql", sql("SELECT predicate_id, count(*) AS n FROM stmt s JOIN ent e ON e.id = s.subject_id WHERE s.rank = 'preferred' GROUP BY 1"))
def guarded_sql(spark, sf_dir, store):
    text = "WITH p AS (SELECT * FROM v_statements WHERE rank = 'preferred') SELECT predicate_id, count(*) AS n FROM p GROUP BY predicate_id"
    return sqlguard.run(spark, text, query.views(store))[0]


@registered("T1_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir, store):
    return jobs.tumbling(spark, f"{sf_dir}/events.parquet")


@registered("T1_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP - INTERVAL 1 DAY]) AS start FROM events) GROUP BY 1")
def sliding(spark, sf_dir, store):
    return jobs.sliding(spark, f"{sf_dir}/events.parquet")


@registered("T1_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark, sf_dir, store):
    return jobs.sessions(spark, f"{sf_dir}/events.parquet")


@registered("T4_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest(spark, sf_dir, store):
    return jobs.latest(spark, f"{sf_dir}/events.parquet")


@registered("T4_upsert", _SQL["T4_latest"])
def upserted(spark, sf_dir, store):
    """The same as upserts into a log, batch by batch."""
    return jobs.upserted(spark, f"{sf_dir}/events.parquet").rows("users").select("user_id", "event_id", "event_type")


@registered("T1_deduplicated", "SELECT DISTINCT event_id, event_type FROM events")
def deduplicated(spark, sf_dir, store):
    return jobs.deduplicated(spark, f"{sf_dir}/events.parquet")


# -- more of the write path, the gate and the sources


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw values of all kinds, every third of them faulty."""
    k, bad = F.col("o_orderkey") % 7, F.col("o_orderkey") % 3 == 0
    keys = ["entity", "string", "number", "quantity", "datetime", "geo", "json"]
    kind = F.element_at(F.array(*[F.lit(x) for x in keys]), (k + 1).cast("int"))
    text = lambda c: c.cast("string")
    pair = lambda name, value: F.create_map(F.lit(name), F.when(~bad, value))
    v = (
        F.when(k == 0, pair("id", text(F.col("o_custkey")))).when(k == 1, pair("text", F.col("o_orderpriority")))
        .when(k == 2, pair("number", F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("12.5"))).when(k == 3, F.map_concat(F.create_map(F.lit("unit"), F.lit("USD")), pair("number", F.lit("7"))))
        .when(k == 4, pair("at", F.lit("1998-01-01 00:00:00"))).when(k == 5, F.map_concat(pair("lat", F.lit("48.5")), pair("lon", F.lit("9.25")))).otherwise(pair("json", F.lit('{"a": 1}')))
    )
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"), kind.alias("value_type"), v.alias("v"))


@registered("V1_normalize", """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 THEN o_custkey::VARCHAR END AS object_id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 1 THEN o_orderpriority END AS value_text,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 12.5 END WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 3 THEN 7.0 END::DOUBLE AS value_number,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 4 THEN TIMESTAMP '1998-01-01' END AS value_datetime, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 = 5 THEN '{"type":"Point","coordinates":[9.25,48.5]}' END AS value_geo,
    CASE WHEN o_orderkey % 3 = 0 THEN ['entity needs id', 'string needs text', 'number expected', 'number expected', 'datetime expected', 'lat and lon expected', 'json expected'][o_orderkey % 7 + 1] END AS problem FROM orders""")
def normalize(spark, sf_dir, store):
    return write.normalize(_values(spark, sf_dir)).select("ord", "object_id", "value_text", "value_number", "value_datetime", "value_geo", "problem")


@registered("V5_qualifiers", "SELECT o_orderkey AS ord, CASE o_orderkey % 4 WHEN 0 THEN 'unknown predicate' WHEN 1 THEN 'kind can''t qualify' WHEN 2 THEN 'value type' END AS problem FROM orders")
def qualifier_rules(spark, sf_dir, store):
    k = F.col("o_orderkey") % 4
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.when(k == 0, "colour").otherwise("started").alias("predicate_id"), F.when(k == 1, "geo").when(k == 2, "string").otherwise("datetime").alias("value_type"))
    return write.check_qualifiers(store, rows)


@registered("V11_create_entities", """SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'unknown type' WHEN 1 THEN 'abstract type' END AS problem, CASE WHEN s_suppkey % 3 = 2 THEN 'supplier:' || s_suppkey END AS twins FROM supplier""")
def create_entities(spark, sf_dir, store):
    k = F.col("s_suppkey") % 3
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ord"), F.when(k == 0, "Robot").when(k == 1, "Agent").otherwise("Supplier").alias("type_id"), F.upper("s_name").alias("label"))
    return write.plan_entities(store, rows)


@registered("P4_review_types", """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS parent, o_orderkey % 3 AS kind FROM orders) SELECT 't' || k AS id, concat_ws('; ', CASE WHEN parent = 1 THEN 'unknown parent' END,
    CASE WHEN kind = 2 THEN 'unknown kind' END, CASE WHEN parent IN (0, 2) AND kind <> 0 THEN 'kind differs from parent' END, CASE WHEN k % 5 = 2 THEN 'unknown interface' END) AS problems FROM p""")
def review_types(spark, sf_dir, store):
    """Orders as proposed types."""
    k = F.col("o_orderkey")
    parent = F.when(k % 4 == 0, "Place").when(k % 4 == 1, "Nowhere").when(k % 4 == 2, "Agent")
    kind = F.when(k % 3 == 0, "continuant").when(k % 3 == 1, "occurrent").otherwise("thing")
    names = F.when(k % 5 == 1, F.array(F.lit("Nameable"))).when(k % 5 == 2, F.array(F.lit("Nameable"), F.lit("Flying"))).when(k % 5 > 2, F.array().cast("array<string>"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("t"), k.cast("string")).alias("id"), parent.alias("parent_id"), kind.alias("kind"), names.alias("interfaces"))
    return registry.review_types(rows, store.types, ["Nameable", "Temporal", "Embeddable"]).withColumn("problems", F.array_join("problems", "; "))


@registered("L10_evictions", "SELECT event_id AS node FROM (SELECT event_id, row_number() OVER (ORDER BY ts, user_id, event_id) AS k FROM events WHERE event_type <> 'purchase') WHERE k <= (SELECT count(*) FROM events) - (SELECT count(*) // 2 FROM events)")
def evictions(spark, sf_dir, store):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_id").alias("node"), F.col("ts").alias("touched_at"), F.col("user_id").alias("degree"), (F.col("event_type") == "purchase").alias("protected"))
    return graph.evictions(rows, e.count() // 2).select("node")


@registered("A16_recompute_summary", sql("SELECT (SELECT count(*) FROM ent WHERE merged_into IS NULL) AS entities, (SELECT count(*) FROM edge) AS edges"))
def recompute_summary(spark, sf_dir, store):
    nodes = store.entities.where("merged_into IS NULL").select(F.col("id").alias("node"), F.col("type_id").alias("community"))
    return graph.recompute_summary(nodes, graph.edges(store)).select("entities", "edges")


@registered("I2_model_answers", "SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN NULL ELSE event_type END AS name, event_id % 3 = 0 AS failed FROM events")
def model_answers(spark, sf_dir, store):
    k = F.col("event_id") % 3
    item = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "x": 1}'))
    answer = F.when(k == 0, F.lit("I am sorry.")).when(k == 1, F.concat(F.lit("Sure:\n```json\n["), item, F.lit("]\n```\nDone."))).otherwise(F.concat(F.lit("Here: "), item, F.lit(" as asked")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), answer.alias("answer"))
    out = ingest.model_answers(rows, "name: string")
    return out.select("id", F.get("items.name", F.lit(0)).alias("name"), F.col("error").isNotNull().alias("failed"))


@registered("I3_pipeline", "SELECT s_suppkey AS doc_id, 'name' AS predicate, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || ' x9' END AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'reconfirm' ELSE 'reject' END AS outcome FROM supplier")
def ingest_pipeline(spark, sf_dir, store):
    """Known names confirm what is there; a created entity is not in the store yet, so its statement waits for it."""
    name = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" x9")))
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("doc_id"), F.to_json(F.struct(name.alias("name"))).alias("raw"))
    return ingest.run_pipeline(store, docs, "Order", "src:master", ["name"])[0].select("doc_id", "predicate", "value", "outcome")


@registered("I6_identities", """SELECT 'u' || c_custkey AS username, CASE WHEN c_custkey % 4 <> 3 THEN 'p' || c_custkey END AS pk, CASE WHEN c_custkey % 2 = 0 THEN 'pk:' || c_custkey WHEN c_custkey % 3 = 0 THEN 'name:' || c_custkey END AS id,
    c_custkey % 2 = 1 AND c_custkey % 3 = 0 AND c_custkey % 4 <> 3 AS backfill FROM customer""")
def identities(spark, sf_dir, store):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    key = F.col("k").cast("string")
    users = c.select(F.concat(F.lit("u"), key).alias("username"), F.when(F.col("k") % 4 != 3, F.concat(F.lit("p"), key)).alias("pk"))
    by_pk = c.where("k % 2 = 0").select(F.concat(F.lit("p"), key).alias("pk"), F.concat(F.lit("pk:"), key).alias("id"))
    by_name = c.where("k % 3 = 0").select(F.concat(F.lit("u"), key).alias("username"), F.concat(F.lit("name:"), key).alias("id"))
    return ingest.identities(users, by_pk, by_name)


@registered("S7_tool_log", "SELECT event_type AS tool, max(ts) AS last, count(*) FILTER (value > 50) AS slow FROM events GROUP BY 1")
def tool_log(spark, sf_dir, store):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("tool"))
    return rows.agg(F.max("ts").alias("last"), F.count_if(F.col("value") > 50).alias("slow"))


@registered("F8_vocabulary", sql(f"""SELECT CASE WHEN predicate_id IN ('part_of', 'located_in', 'contains', 'supplied_by', 'did') THEN 'n:m' ELSE '1:1' END AS cardinality, count(DISTINCT predicate_id) AS n, count(*) AS statements
    FROM stmt WHERE {VISIBLE} GROUP BY 1"""))
def compact_vocabulary(spark, sf_dir, store):
    """The vocabulary by cardinality, with what is said by its predicates."""
    rows = _with_statements(store, store.predicates.select("id", "cardinality"))
    return rows.groupBy("cardinality").agg(F.count("*").alias("n"), F.sum("n").alias("statements"))


PROPOSED = """SELECT user_id AS p, event_id AS seq, ts, value, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'amend' ELSE 'propose' END AS action FROM events"""
OPENED = """SELECT *, coalesce(last_value(CASE WHEN action IN ('propose', 'reject') THEN action = 'propose' END IGNORE NULLS) OVER (PARTITION BY p ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS open FROM proposed"""
ENDED = """SELECT *, coalesce(min(CASE WHEN action = 'approve' AND open THEN seq END) OVER (PARTITION BY p), 9223372036854775807) AS stop FROM opened"""
JUDGED = """SELECT *, seq <= stop AND (CASE WHEN action = 'propose' THEN NOT open ELSE open END) AS legal FROM ended"""
FOLDED = f"WITH proposed AS ({PROPOSED}), opened AS ({OPENED}), ended AS ({ENDED}), judged AS ({JUDGED})"


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as proposals: what they do amends, rejects or approves them."""
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "approve").when(kind == "error", "reject").when(kind == "click", "amend").otherwise("propose")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), action.alias("action"), "value")


@registered("P6_transitions", f"""{FOLDED} SELECT p AS proposal_id, seq, action, legal, last_value(CASE WHEN legal THEN CASE action WHEN 'propose' THEN 'pending' WHEN 'amend' THEN 'amended' WHEN 'reject' THEN 'rejected' ELSE 'approved' END END IGNORE NULLS)
    OVER (PARTITION BY p ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM judged""")
def transitions(spark, sf_dir, store):
    return registry.transitions(_proposed(spark, sf_dir)).select("proposal_id", "seq", "action", "legal", "state")


@registered("P3_proposals", f"""{FOLDED}, l AS (SELECT p, max(CASE WHEN legal THEN seq END) AS last, arg_max(value, CASE WHEN legal AND action IN ('propose', 'amend') THEN seq END) AS value, count(*) FILTER (NOT legal) AS illegal FROM judged GROUP BY 1)
    SELECT l.p AS proposal_id, CASE j.action WHEN 'propose' THEN 'pending' WHEN 'amend' THEN 'amended' WHEN 'reject' THEN 'rejected' WHEN 'approve' THEN 'approved' END AS status, CASE WHEN j.action IN ('reject', 'approve') THEN j.seq END AS decided_at,
    l.illegal, l.value FROM l LEFT JOIN judged j ON j.p = l.p AND j.seq = l.last""")
def proposals(spark, sf_dir, store):
    return registry.proposals(_proposed(spark, sf_dir), ["value"])


@registered("P5_approved_pairs", f"""{FOLDED}, a AS (SELECT DISTINCT p, CASE WHEN p % 3 = 0 THEN p + 1 END AS inv FROM judged WHERE legal AND action = 'approve')
    SELECT a.p AS proposal_id, coalesce(a.inv, b.p) AS inverse_id, coalesce(a.inv, b.p) IS NULL OR coalesce(a.inv, b.p) IN (SELECT p FROM a) AS approved FROM a LEFT JOIN a b ON b.inv = a.p""")
def approved_pairs(spark, sf_dir, store):
    """Every third proposal names the next as its inverse."""
    decided = registry.proposals(_proposed(spark, sf_dir), ["value"])
    return registry.approved_pairs(decided.withColumn("inverse_id", F.when(F.col("proposal_id") % 3 == 0, F.col("proposal_id") + 1)))


@registered("S12_profiles")
def pasted_profiles(spark, sf_dir, store):
    """Profiles of the pages that are lists, under the names that follow their links."""
    return profiles.profile_lists(spark.read.parquet(f"{sf_dir}/pages.parquet"))[0]


# -- sources and their files


def _page_store(spark: SparkSession, sf_dir: str) -> files.FileLog:
    """Pages as sources, their html as files; then each third has a notice in place of it, and each sixth its own again. The second batch comes twice."""
    out = files.open_files(spark, new_folder(spark, "files"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("ord", F.col("page_id"))
    docs = pages.select("ord", F.to_json(F.struct("page_id", "url")).alias("raw"), "url", F.lit("crawl").alias("activity"), F.lit("crawler").alias("agent"), F.lit(None).cast("timestamp_ntz").alias("retrieved_at"))
    said = files.ingest(out, docs, "2024-01-01 00:00:00", "pages").where("outcome = 'insert'").select("ord", "source_id")
    own = stored(spark, said, "page-sources").join(pages, "ord")
    file = lambda rows, content: rows.select("ord", "source_id", F.concat("page_id", F.lit(".html")).alias("filename"), F.lit("text/html").alias("mime"), content.cast("binary").alias("content"))
    files.attach(out, file(own, F.col("html")), "2024-01-02 00:00:00", "first")
    for _ in range(2):
        files.attach(out, file(own.where("page_id % 3 = 0"), F.lit("moved")), "2024-01-03 00:00:00", "moved")
    files.attach(out, file(own.where("page_id % 6 = 0"), F.col("html")), "2024-01-04 00:00:00", "back")
    return out


@registered("S8_sources", "SELECT 'src:' || sha1('pages|' || page_id) AS id, url, TIMESTAMP '2024-01-01' AS retrieved_at, 'crawl' AS activity, page_id FROM pages")
def ingested_sources(spark, sf_dir, store):
    """Pages as source documents, read back from the log."""
    out = files.open_files(spark, new_folder(spark, "files"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = pages.select(F.col("page_id").alias("ord"), F.to_json(F.struct("page_id", "url")).alias("raw"), "url", F.lit("crawl").alias("activity"), F.lit("crawler").alias("agent"), F.lit(None).cast("timestamp_ntz").alias("retrieved_at"))
    files.ingest(out, docs, "2024-01-01 00:00:00", "pages")
    return out.rows("sources").select("id", "url", "retrieved_at", "activity", F.get_json_object("raw", "$.page_id").cast("long").alias("page_id"))


_HELD = """WITH p AS (SELECT page_id, html, coalesce(octet_length(encode(html)) BETWEEN 1 AND 5242880, FALSE) AS ok FROM pages),
    f AS (SELECT page_id, ok, CASE WHEN page_id % 3 = 0 AND NOT (page_id % 6 = 0 AND ok) THEN 'moved' ELSE html END AS content FROM p WHERE ok OR page_id % 3 = 0)"""


@registered("S9_files", _HELD + """ SELECT 'src:' || sha1('pages|' || page_id) AS source_id, page_id || '.html' AS filename, octet_length(encode(content))::BIGINT AS size_bytes,
    sha256(content) AS sha256, CASE WHEN ok THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-03' END AS created_at FROM f""")
def file_names(spark, sf_dir, store):
    """What holds for each source after four batches, one of them twice."""
    return files.meta(_page_store(spark, sf_dir)).drop("mime")


@registered("S9_blobs", _HELD + " SELECT sha256(content) AS sha256, count(*) AS refs, octet_length(encode(any_value(content)))::BIGINT AS bytes FROM f GROUP BY 1")
def file_contents(spark, sf_dir, store):
    """Live contents after a compaction, with the bytes that are there and the sources that name them."""
    out = _page_store(spark, sf_dir)
    out.compact()
    out.vacuum()
    return out.rows("blobs").select("sha256", F.length("data").cast("long").alias("bytes")).join(files.held(out).select("sha256", "refs"), "sha256", "full")


@registered("S10_reports", """WITH p AS (SELECT page_id, html, coalesce(octet_length(encode(html)), 0) AS size FROM pages), b AS (SELECT *, size BETWEEN 1 AND 5242880 AS ok FROM p)
    SELECT batch, outcome, detail, count(*) AS n FROM (
    SELECT 'pages' AS batch, 'insert' AS outcome, NULL AS detail FROM b
    UNION ALL SELECT 'first', CASE WHEN ok THEN 'insert' ELSE 'reject' END, CASE WHEN size = 0 THEN 'empty file' WHEN NOT ok THEN 'too large' END FROM b
    UNION ALL SELECT 'moved', CASE WHEN ok THEN CASE WHEN html = 'moved' THEN 'same' ELSE 'replace' END ELSE 'insert' END, NULL FROM b WHERE page_id % 3 = 0
    UNION ALL SELECT 'back', CASE WHEN NOT ok THEN 'reject' WHEN html = 'moved' THEN 'same' ELSE 'replace' END, CASE WHEN size = 0 THEN 'empty file' WHEN NOT ok THEN 'too large' END FROM b WHERE page_id % 6 = 0) GROUP BY ALL""")
def file_reports(spark, sf_dir, store):
    """What the log says of each batch."""
    return _page_store(spark, sf_dir).rows("reports").groupBy("batch", "outcome", "detail").agg(F.count("*").alias("n"))


# -- results and calls


@registered("U3_offload", """WITH r AS (SELECT doc_id, source, to_json(string_split(text, ' ')) AS content, len(string_split(text, ' ')) AS n FROM documents WHERE doc_id IS NOT NULL)
    SELECT coalesce(source, '-') AS session, CAST(doc_id AS VARCHAR) AS call_id, coalesce(length(content) > 8000, FALSE) AS offloaded, CASE WHEN length(content) > 8000 THEN 'ref:' || sha1('words|' || coalesce(source, '-') || '|' || doc_id) END AS ref,
    CASE WHEN length(content) > 8000 THEN 'list of ' || n || ' entries' END AS summary, length(content)::INT AS chars FROM r""")
def offloaded(spark, sf_dir, store):
    """The words of each document as a result: long ones are kept, and read back through their references."""
    out = calls.open_calls(spark, new_folder(spark, "calls"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL")
    told = calls.offload(out, docs.select(F.coalesce("source", F.lit("-")).alias("session"), F.col("doc_id").cast("string").alias("call_id"), F.to_json(F.split("text", " ")).alias("content")), "words")
    kept = out.rows("results").select(F.concat(F.lit("ref:"), "id").alias("ref"), F.length("content").alias("kept"))
    # what is shown whole has no reference, and would be one group of the join
    columns = ["session", "call_id", "offloaded", "ref", "summary", "chars"]
    long = told.where("offloaded").join(kept, "ref", "left").withColumn("chars", F.col("kept"))
    return told.where("NOT offloaded").withColumn("chars", F.length("content")).select(*columns).unionByName(long.select(*columns))


def _event_calls(spark: SparkSession, sf_dir: str) -> calls.CallLog:
    """Events as calls in two batches, the second of them twice; each fifth has long arguments."""
    out = calls.open_calls(spark, new_folder(spark, "calls"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    args = F.when(F.col("event_id") % 5 == 0, F.to_json(F.struct("event_id", F.repeat(F.col("props"), F.lit(300)).alias("props")))).otherwise(F.col("props"))
    given = rows.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("tool"), args.alias("args"), F.col("ts").cast("timestamp_ntz").alias("called_at"), F.round(F.col("value") * 100).cast("long").alias("duration_ms"),
        F.when(F.col("value") < 5, "failed").alias("error"), F.col("props").alias("result"), F.col("user_id").cast("string").alias("token"),
    )
    for part in (0, 1, 1):
        calls.log_calls(out, given.where(F.col("id").cast("long") % 2 == part), f"part {part}")
    return out


@registered("U6_call_log", """SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 5) AS errors, count(*) FILTER (event_id % 5 = 0 AND length(props) * 300 > 2048) AS cut,
    avg(CAST(round(value * 100) AS BIGINT)) AS avg_ms, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY 1""")
def call_log(spark, sf_dir, store):
    """Telemetry from the log as it is read back."""
    return calls.telemetry(_event_calls(spark, sf_dir))


@registered("U6_tokens", "SELECT substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) AS token_hash, count(*) AS calls, max(ts) AS last FROM events GROUP BY 1")
def call_tokens(spark, sf_dir, store):
    """Calls by caller, who is known by a part of a hash."""
    return _event_calls(spark, sf_dir).rows("calls").groupBy("token_hash").agg(F.count("*").alias("calls"), F.max("called_at").alias("last"))


@registered("U6_quantiles")
def call_quantiles(spark, sf_dir, store):
    """Quantiles of durations from the sketches of all batches."""
    found = calls.quantiles(_event_calls(spark, sf_dir), [0.5, 0.9, 0.99])
    return found.select("tool", "n", F.posexplode("q").alias("place", "ms"))


# -- batches matched among themselves


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents that each name a supplier of theirs: even ones by the name in the store, others by one that isn't there, and some of these also by a
    yard that ten suppliers share."""
    t = model.tables(spark, sf_dir)
    rows = t["lineitem"].select("l_orderkey", "l_suppkey").distinct().join(t["supplier"].select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    rows = stored(spark, rows.select("l_orderkey", "l_suppkey", "s_name"), "lines")  # read several times
    rows = rows.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("ref"), F.col("l_suppkey").alias("s"), "s_name", (F.col("l_orderkey") % 50 == 0).alias("yard"))
    odd = F.col("s") % 2 == 1
    names = rows.select("ref", F.when(odd, F.concat(F.lit("Unlisted "), F.col("s").cast("string"))).otherwise(F.col("s_name")).alias("value"))
    yards = rows.where(odd & F.col("yard")).select("ref", F.concat(F.lit("Yard "), F.floor(F.col("s") / 10).cast("string")).alias("value"))
    said = names.unionByName(yards).select("ref", F.lit("name").alias("predicate_id"), "value")
    return rows.select("ref", F.lit("Supplier").alias("type_id"), F.lit(None).cast("string").alias("label")), said


_LINES = """WITH l AS (SELECT DISTINCT l_orderkey || '-' || l_suppkey AS ref, l_suppkey AS s, l_orderkey % 50 = 0 AS yard FROM lineitem), g AS (SELECT s, s % 2 = 0 AS known, bool_or(yard) AS y FROM l GROUP BY 1),
    c AS (SELECT ref, s, known, yard, CASE WHEN y AND NOT known THEN 'y' || (s // 10) ELSE 's' || s END AS grp FROM l JOIN g USING (s)),
    m AS (SELECT *, CASE WHEN known THEN 'supplier:' || s ELSE 'new:' || sha1('lines|' || min(ref) OVER (PARTITION BY grp)) END AS id FROM c)"""


@registered("R6_batch", _LINES + " SELECT ref, id, CASE WHEN known THEN 'identifier:name' ELSE 'new' END AS method, NOT known AS created FROM m")
def batch_matches(spark, sf_dir, store):
    return batch.match_batch(store, *_lines(spark, sf_dir), "lines").select("ref", "id", "method", "created")


@registered("R6_batch_statements", _LINES + " SELECT DISTINCT id AS subject_id, 'name' AS predicate_id, v AS value_text FROM (SELECT id, 'Unlisted ' || s AS v FROM m WHERE NOT known UNION ALL SELECT id, 'Yard ' || (s // 10) FROM m WHERE NOT known AND yard)")
def batch_statements(spark, sf_dir, store):
    """The identifiers that are written for what the batch creates."""
    rows, said = _lines(spark, sf_dir)
    matched = batch.match_batch(store, rows, said, "lines")
    return batch.identifying(store, matched, said, "src:master").select("subject_id", "predicate_id", "value_text")
