"""The reified tables stated in SQL: a WITH prefix for the oracle queries."""

from __future__ import annotations

CUSTOMER = "'customer:' || CASE WHEN {k} % 100 >= 98 THEN {k} - ({k} % 100 - 97) ELSE {k} END"
START = "TIMESTAMP '1995-01-01 00:00:00'"
NULLS = {
    "object_id": "VARCHAR", "value_text": "VARCHAR", "value_number": "DOUBLE", "value_unit": "VARCHAR", "value_datetime": "TIMESTAMP",
    "valid_from": "TIMESTAMP", "valid_to": "TIMESTAMP", "system_to": "TIMESTAMP",
}
ORDER = ["id", "subject_id", "predicate_id", "value_type", "object_id", "value_text", "value_number", "value_unit", "value_datetime", "rank", "confidence", "valid_from", "valid_to", "system_from", "system_to"]


def _part(table: str, predicate: str, subject: str, value_type: str, n: str = "1", **rest: str) -> str:
    columns = {k: f"CAST(NULL AS {t})" for k, t in NULLS.items()} | {"rank": "'normal'", "confidence": "1.0::DOUBLE", "system_from": START}
    columns |= {"id": f"'{predicate}|' || {subject} || '|' || {n}", "subject_id": subject, "predicate_id": f"'{predicate}'", "value_type": f"'{value_type}'"} | rest
    return "SELECT " + ", ".join(f"{columns[c]} AS {c}" for c in ORDER) + f" FROM {table}"


def statements_sql() -> str:
    unit = "CASE WHEN {} % 2 = 0 THEN 'USD' ELSE 'EUR' END"
    order, dated = "'order:' || o_orderkey", {"valid_from": "o_orderdate", "system_from": "o_orderdate"}
    line = {
        "rank": "CASE l_returnflag WHEN 'A' THEN 'preferred' WHEN 'R' THEN 'deprecated' ELSE 'normal' END", "confidence": "round(1 - 5 * l_discount, 2)",
        "valid_from": "l_shipdate", "valid_to": "l_shipdate + INTERVAL 60 DAY", "system_from": "l_shipdate",
        "system_to": "CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL 90 DAY END",
    }
    own = "'order:' || l_orderkey"
    names = [("region", "r"), ("nation", "n"), ("customer", "c"), ("supplier", "s"), ("part", "p")]
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    parts = [
        _part("nation", "part_of", "'nation:' || n_nationkey", "entity", object_id="'region:' || n_regionkey"),
        _part("customer", "located_in", "'customer:' || c_custkey", "entity", object_id="'nation:' || c_nationkey"),
        _part("supplier", "located_in", "'supplier:' || s_suppkey", "entity", object_id="'nation:' || s_nationkey"),
        *[_part(t, "name", f"'{t}:' || {keys[t]}", "string", value_text=f"{p}_name") for t, p in names],
        _part("customer", "segment", "'customer:' || c_custkey", "string", value_text="c_mktsegment", confidence="0.9::DOUBLE"),
        _part("customer", "balance", "'customer:' || c_custkey", "quantity", value_number="c_acctbal", value_unit=unit.format("c_nationkey")),
        _part("supplier", "balance", "'supplier:' || s_suppkey", "quantity", value_number="s_acctbal", value_unit=unit.format("s_nationkey")),
        _part("orders", "placed_by", order, "entity", object_id=CUSTOMER.format(k="o_custkey"), **dated),
        _part("orders", "status", order, "string", value_text="o_orderstatus", **dated),
        _part("orders", "total", order, "quantity", value_number="o_totalprice", value_unit="'USD'", **dated),
        _part("orders", "started", order, "datetime", value_datetime="o_orderdate", system_from="o_orderdate"),
        _part("lines", "contains", own, "entity", "n", object_id="'part:' || l_partkey", **line),
        _part("lines", "supplied_by", own, "entity", "n", object_id="'supplier:' || l_suppkey", **line),
        _part("events", "did", "'user:' || user_id", "string", "event_id", value_text="event_type", valid_from="ts", system_from="ts"),
    ]
    return "\nUNION ALL ".join(parts)


LINES = (
    "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem"
)
ENTITIES = f"""
SELECT 'region:' || r_regionkey AS id, 'Region' AS type_id, r_name AS label, CAST(NULL AS VARCHAR) AS merged_into, {START} AS created_at FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name, NULL, {START} FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name, CASE WHEN c_custkey % 100 >= 98 THEN 'customer:' || (c_custkey - 1) END, {START} FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name, NULL, {START} FROM supplier
UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name, NULL, {START} FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Order', NULL, NULL, o_orderdate FROM orders
UNION ALL SELECT DISTINCT 'user:' || user_id, 'User', NULL, NULL, {START} FROM events
UNION ALL SELECT 'doc:' || doc_id, 'Document', NULL, NULL, {START} FROM documents
UNION ALL SELECT 'page:' || page_id, 'Page', url, NULL, {START} FROM pages
UNION ALL SELECT DISTINCT 'conv:' || conv_id, 'Conversation', NULL, NULL, {START} FROM conversations"""
REFERENCES = "SELECT id AS statement_id, CASE WHEN subject_id LIKE 'order:%' THEN 'src:' || subject_id ELSE 'src:master' END AS source_id FROM stmt"
SOURCES = f"""
SELECT 'src:order:' || o_orderkey AS id, 'order entry' AS activity, o_orderdate AS retrieved_at FROM orders
UNION ALL SELECT 'src:doc:' || doc_id, 'crawl', NULL FROM documents UNION ALL SELECT 'src:master', 'load', {START}"""
QUALIFIERS = """
SELECT 'contains|order:' || l_orderkey || '|' || n AS statement_id, 'quantity' AS predicate_id, l_quantity AS value_number, CAST(NULL AS VARCHAR) AS value_unit FROM lines
UNION ALL SELECT 'contains|order:' || l_orderkey || '|' || n, 'price', l_extendedprice, 'USD' FROM lines"""
#: Current entity-valued statements of a visible rank between entities that aren't merged away.
EDGES = """
SELECT s.id, s.subject_id AS src, s.object_id AS dst, s.predicate_id, s.confidence FROM stmt s JOIN ent a ON a.id = s.subject_id AND a.merged_into IS NULL
JOIN ent b ON b.id = s.object_id AND b.merged_into IS NULL WHERE s.value_type = 'entity' AND s.system_to IS NULL AND s.rank <> 'deprecated'"""


def sql(body: str, **more: str) -> str:
    """A query over lines, stmt, ent, refs, quals, src, edge, and further named parts."""
    parts = {"lines": LINES, "stmt": statements_sql(), "ent": ENTITIES, "refs": REFERENCES, "quals": QUALIFIERS, "src": SOURCES, "edge": EDGES} | more
    recursive = "RECURSIVE " if any("{recursive}" in v for v in parts.values()) else ""
    return f"WITH {recursive}" + ",\n".join(f"{k} AS ({v.replace('{recursive}', '')})" for k, v in parts.items()) + "\n" + body
