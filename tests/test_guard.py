"""The SQL guard, by the scope of common table expressions, and sums."""

import time

import pytest

from chronofact.operators import query
from chronofact.plans import sqlguard

GOOD = [
    "SELECT x FROM shown", "WITH a AS (SELECT x FROM shown), b AS (SELECT x FROM a) SELECT * FROM b", "WITH shown AS (SELECT x + 1 AS x FROM shown) SELECT * FROM shown",
    "WITH a AS (WITH b AS (SELECT x FROM shown) SELECT * FROM b) SELECT * FROM a", "SELECT * FROM shown WHERE x IN (WITH a AS (SELECT 1 AS x) SELECT x FROM a)",
    "WITH a AS (SELECT 1 AS x) SELECT * FROM shown WHERE EXISTS (SELECT * FROM a WHERE a.x = shown.x)", "SELECT x FROM SHOWN UNION ALL SELECT 2",
    "SELECT DISTINCT a.x FROM shown a LEFT JOIN (SELECT x, count(*) AS n FROM shown GROUP BY x HAVING count(*) > 0) b ON a.x = b.x WHERE b.n BETWEEN 1 AND 2 AND a.x IN (1, 2) ORDER BY a.x DESC NULLS LAST LIMIT 5",
    "SELECT x, row_number() OVER (PARTITION BY x % 2 ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, CASE WHEN x IS NULL OR NOT x > 1 THEN 'a' ELSE trim(upper(concat('b', x))) END AS c FROM shown",
    "SELECT sum(x) AS x FROM shown GROUP BY ROLLUP(x)", "SELECT transform(array(x), i -> i + 1)[0] AS x, CAST(x AS string) LIKE '1%' AS l, DATE '2020-01-01' AS d FROM shown", "SELECT x FROM shown EXCEPT SELECT 1", "SELECT * FROM (VALUES (1), (2)) v(x)",
]
BAD = [
    "SELECT * FROM hidden", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "SELECT b.x FROM (WITH hidden AS (SELECT 1 AS x) SELECT * FROM hidden) a, hidden b",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a", "WITH a AS (WITH hidden AS (SELECT 1 AS x) SELECT * FROM hidden) SELECT * FROM a, hidden", "SELECT * FROM shown WHERE x IN (SELECT x FROM hidden)",
    "SELECT (SELECT max(x) FROM hidden) FROM shown", "WITH RECURSIVE a(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM a WHERE x < 3) SELECT * FROM a", "DROP TABLE shown", "SELECT 1; SELECT 2",
    "SELECT * FROM IDENTIFIER('hidden')", "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')", "SELECT IDENTIFIER('java_method')('java.lang.Math', 'abs', -1) FROM shown",
    "FROM shown |> EXTEND (SELECT max(x) FROM IDENTIFIER('hidden')) AS m", "SELECT user() FROM shown", "SELECT x FROM shown WHERE x IN (SELECT x FROM IDENTIFIER('hidden'))", "TABLE hidden", "VALUES (1), (2) UNION TABLE hidden",
    "SELECT * FROM shown TABLESAMPLE (10 PERCENT)", "SELECT session.x FROM hidden session", "SELECT * FROM shown, LATERAL (SELECT * FROM hidden)", "SELECT current_catalog()", "SELECT builtin.reflect('java.lang.System', 'exit', 1)",
    "SELECT x FROM shown LATERAL VIEW inline(array(struct(1))) t", "SELECT transform(array(1), i -> (SELECT max(x) FROM hidden)) FROM shown", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "SELECT * FROM shown MINUS SELECT * FROM hidden",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM range(5)", "SELECT * FROM default.hidden", "SELECT * FROM parquet.`/tmp/x`", "CREATE TABLE t AS SELECT * FROM shown",
]


@pytest.fixture
def views(spark):
    spark.sql("SELECT 42 AS x").createOrReplaceTempView("hidden")
    yield {"shown": spark.createDataFrame([(1,), (2,)], "x int")}
    spark.catalog.dropTempView("hidden")


@pytest.mark.parametrize("text", GOOD)
def test_allowed(spark, views, text):
    rows, more = sqlguard.run(spark, text, views)
    assert all(r.x != 42 for r in rows.collect()) and not more and not spark.catalog.tableExists("shown")


@pytest.mark.parametrize("text", BAD)
def test_denied(spark, views, text):
    with pytest.raises(ValueError):
        sqlguard.run(spark, text, views)


def test_limits(spark, views):
    rows, more = sqlguard.run(spark, "SELECT x FROM shown ORDER BY x", views, limit=1)
    assert [r.x for r in rows.collect()] == [1] and more
    slow = "SELECT sum(a.id * b.id % 7) AS x FROM shown CROSS JOIN big a CROSS JOIN big b"
    began = time.time()
    with pytest.raises(TimeoutError):
        sqlguard.run(spark, slow, views | {"big": spark.range(3_000_000)}, seconds=2)
    assert time.time() - began < 60 and spark.range(3).count() == 3


def test_sums_keep_small_parts_and_large_values(spark):
    for values in ([1 / 3] * 3000, [1e20, 1.0], [0.125, -0.25]):
        got = spark.createDataFrame([(v,) for v in values], "v double").agg(query.money("v").alias("s")).first().s
        assert got == pytest.approx(sum(values), rel=1e-9)
    assert spark.createDataFrame([(None,)], "v double").agg(query.money("v").alias("s")).first().s is None
