"""A few registered queries against DuckDB over the smallest tables, and what is not SQL."""

import duckdb
import pytest

import __spark_entry__
from chronofact.operators import query
from chronofact.plans import catalog, sqlguard
from chronofact.sources import ingest
from chronofact import model

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["F0_contains_per_nation", "F1_list_page", "A3_sum_by_unit", "A6_degree", "J3_chain2", "W2_label_changes", "W3_runs", "G1_levels", "G2_shortest_paths_total", "R1_embed", "V3_plan_commit", "V3_mixed_commit", "I5_followers", "S12_links", "T1_sessions"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, duck, name):
    df, r = catalog.queries()[name](spark, ROOT), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(r.columns) == columns
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted((tuple(norm(x[c]) for c in columns) for x in df.collect()), key=repr)
    at = [r.columns.index(c) for c in columns]
    assert ours == sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["nation", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("text", [
    "UPDATE v_entities SET label = 'x'", "DELETE FROM v_entities", "SELECT * FROM statement", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'exit', 0)", "DROP TABLE v_entities",
    "SELECT * FROM parquet.`/root`", "SELECT (SELECT count(*) FROM secret)", "WITH x AS (SELECT * FROM other) SELECT * FROM x", "SELECT * FROM v_entities WHERE id IN (SELECT id FROM other)", "SHOW TABLES", "SET a = 1",
    "SELECT * FROM range(10)", "INSERT INTO v_entities SELECT * FROM v_entities", "EXPLAIN SELECT 1", "SELECT java_method('java.lang.Math', 'abs', 1)",
])
def test_guard_rejects(spark, text):
    with pytest.raises(ValueError):
        sqlguard.check(spark, text, {"v_entities", "v_statements"})


def test_guard_runs(spark):
    views = query.views(model.reify(spark, ROOT))
    rows, more = sqlguard.run(spark, "WITH x AS (SELECT type_id FROM v_entities) SELECT type_id, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'all', (SELECT count(*) FROM v_entities)", views, limit=3)
    assert rows.count() == 3 and more
    with pytest.raises(ValueError, match="v_entities\\(id"):
        sqlguard.run(spark, "SELECT nothing FROM v_entities", views)


def test_scraped_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"metadata": {"kind": "followers", "handle": "@Own"}, "users": [{"username": "One", "pk": "1"}, {"username": "one"}, {"username": "own", "id": "9"}, {"username": "no way"}]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"metadata": {"kind": "following", "handle": "x"}, "users": []}')
    files = ingest.scraped_files(spark, str(tmp_path))
    assert {r.file: r.error for r in files.collect()} == {"a.json": None, "b.json": "not a scraped list", "c.json": None}
    assert sorted((r.username or "", r.status) for r in ingest.scraped_users(files).collect()) == [("", "invalid"), ("one", "duplicate"), ("one", "ok"), ("own", "owner")]
    assert tuple(ingest.batch_totals(files).first()) == (3, 1, 4)


def test_binary_files(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "large").write_bytes(b"x" * 100)
    got = {r.name: (r.size, r.error, r.sha256 is None) for r in ingest.binary_files(spark, str(tmp_path), most=50).collect()}
    assert got == {"small": (3, None, False), "large": (100, "too large", True)}


def test_profiles(spark):
    raw = '{"kind": "person", "name": "N", "aliases": ["x", "y"], "accounts": [{"handle": "h", "follows": ["z"]}], "shoe": 42}'
    candidates, unknown = ingest.extract_profile(spark.createDataFrame([(1, raw), (2, "{}")], "doc_id long, raw string"))
    assert {(r.predicate, r.value) for r in candidates.collect()} == {("name", "N"), ("alias", "x"), ("alias", "y"), ("owns_account", "h")}
    assert [(r.doc_id, r.field) for r in unknown.collect()] == [(1, "shoe")]
