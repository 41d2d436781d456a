"""Results kept and shown by digests of bounded size; calls read back from their log."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from chronofact.sources import calls

CALL = "id string, tool string, args string, called_at timestamp_ntz, duration_ms long, error string, result string, token string"


@pytest.fixture
def log(spark, tmp_path):
    return calls.open_calls(spark, f"file://{tmp_path}/calls")


def results(spark, rows):
    return spark.createDataFrame([("s", k, v if isinstance(v, str | None) else json.dumps(v, ensure_ascii=False)) for k, v in rows], "session string, call_id string, content string")


def test_long_results_are_kept(spark, log):
    people = [{"name": f"n{i}", "age": i, "tags": ["ä"] * 3} for i in range(900)]
    given = {
        "list": people, "object": {"items": people, "total": 900, "sub": {"a": 1, "b": 2}, "none": None, "text": "x" * 5000}, "numbers": list(range(5000)), "short": [1, 2], "null": None, "empty": "",
        "wide": {f"k{i:04d}": i for i in range(3000)}, "text": "no json " * 2000, "string": '"' + "y" * 9000 + '"', "long": ["z" * 9000, 1], "edge": "[" + " " * 7998 + "]", "over": "[" + " " * 7999 + "]",
    }
    out = {r.call_id: r for r in calls.offload(log, results(spark, given.items()), "b1").collect()}
    assert {k for k, r in out.items() if not r.offloaded} == {"short", "null", "empty", "edge"}
    assert all((r.ref is None and r.sample is None) if not r.offloaded else r.content is None for r in out.values())
    assert out["list"].summary == "list of 900 entries, objects with keys age, name, tags" and json.loads(out["list"].sample) == people[:10]
    assert out["object"].summary == "object with items: list[900], none: void, sub: object[2 keys], text: string, total: bigint"
    got = json.loads(out["object"].sample)
    assert got["items"] == people[:10] and got["sub"] == {"a": 1, "b": 2} and got["total"] == 900 and got["none"] is None and len(got["text"]) < 600
    assert out["numbers"].summary == "list of 5000 entries" and json.loads(out["numbers"].sample) == list(range(10))
    assert out["wide"].summary.endswith(", and 2980 more") and len(json.loads(out["wide"].sample)) == 20
    assert out["text"].summary == "text of 16000 characters" and out["string"].summary == "string value" and out["over"].summary == "list of 0 entries"
    assert all(len(r.sample) + len(r.summary) < 8000 and json.loads(r.sample) is not False for r in out.values() if r.offloaded)
    for k in ("list", "text"):
        assert calls.resolved(log, "s", [out[k].ref]).first().content == (given[k] if k == "text" else json.dumps(given[k], ensure_ascii=False))
    with pytest.raises(ValueError, match="unknown reference"):
        calls.resolved(log, "another session", [out["list"].ref])
    n, version = log.rows("results").count(), log.version()
    calls.offload(log, results(spark, given.items()), "b1")
    assert (log.rows("results").count(), log.version()) == (n, version)
    log.compact()
    assert log.rows("results").count() == n
    assert calls.offload(log, results(spark, []), "b2").count() == 0


def test_uniform_samples(spark, log):
    """Over many results each place is chosen about equally often, in order, and again the same."""
    df = results(spark, [(f"c{i}", list(range(2500))) for i in range(200)])
    picks = [json.loads(r.sample) for r in calls.offload(log, df, "b", uniform=True).collect()]
    assert all(len(set(p)) == 10 and p == sorted(p) for p in picks)
    assert 0.4 < sum(x < 1250 for p in picks for x in p) / 2000 < 0.6 and len({tuple(p) for p in picks}) > 190
    again = [json.loads(r.sample) for r in calls.offload(log, df, "b", uniform=True).collect()]
    assert sorted(again) == sorted(picks)


def test_rows_of_a_query(spark):
    small = calls.offload_rows(spark.range(3))
    assert not small["offloaded"] and sorted(small["content"]) == ['{"id":0}', '{"id":1}', '{"id":2}']
    assert calls.offload_rows(spark.range(0))["content"] == []
    big = calls.offload_rows(spark.range(50_000).withColumn("t", F.lit("ü")))
    assert big["offloaded"] and big["rows"] == 50_000 and big["columns"] == {"id": "bigint", "t": "string"} and len(big["sample"]) == 10
    assert spark.read.parquet(big["ref"]).count() == 50_000
    assert max(json.loads(x)["id"] for x in big["sample"]) > 1000  # not the first rows


def test_calls(spark, log):
    day = datetime.datetime(2024, 1, 1)
    many = json.dumps({"ids": ["x" * 30] * 200, 'q"uote': 1})
    rows = [(f"{i}", "find" if i % 3 else "write", many if i % 5 == 0 else '{"a":1}', day + datetime.timedelta(hours=i), i * i, "bad" if i % 7 == 0 else None, "ä" * i if i % 2 else None, "secret" if i % 2 else None) for i in range(300)]
    for batch in (0, 1, 1):
        calls.log_calls(log, spark.createDataFrame([r for r in rows if int(r[0]) % 2 == batch], CALL), f"b{batch}")
    back = {r.id: r for r in log.rows("calls").collect()}
    assert len(back) == 300 and json.loads(back["0"].args) == {"_truncated": True, "ids": "…", 'q"uote': "…"} and back["1"].args == '{"a":1}'
    assert back["1"].token_hash == "2bb80d537b1d" and back["0"].token_hash is None and back["3"].result_bytes == 6 and back["2"].result_bytes is None
    assert "secret" not in str(back)
    got = {r.tool: r for r in calls.telemetry(log).collect()}
    for tool in ("find", "write"):
        own = [r for r in rows if r[1] == tool]
        assert (got[tool].calls, got[tool].errors, got[tool].cut) == (len(own), sum(r[5] is not None for r in own), sum(r[2] == many for r in own))
        assert got[tool].avg_ms == pytest.approx(sum(r[4] for r in own) / len(own))
    for since, until in ((None, None), ("2024-01-03", "2024-01-09")):
        for r in calls.quantiles(log, [0.1, 0.5, 0.99], since, until).collect():
            own = sorted(x[4] for x in rows if x[1] == r.tool and (since is None or since <= x[3].date().isoformat() < until))
            assert r.n == len(own)
            for share, q in zip((0.1, 0.5, 0.99), r.q):
                assert abs(sum(x <= q for x in own) / len(own) - share) < 0.03
    assert calls.quantiles(log, [0.5], "2030-01-01").count() == 0


def test_odd_arguments(spark):
    rows = spark.createDataFrame([(None,), ("",), ("x" * 3000,), ("[" + "1," * 2000 + "1]",)], "a string")
    assert [r[0] for r in rows.select(calls.cut_arguments(F.col("a"))).collect()] == [None, "", '{"_truncated":true}', '{"_truncated":true}']


def test_shown_results_join_nothing(spark):
    """Results without a reference are beside the join of those with one, not a group of it."""
    from chronofact.plans import catalog

    plan = catalog.queries()["U3_offload"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Union") < plan.index("Join")
