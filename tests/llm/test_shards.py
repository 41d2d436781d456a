import zlib
from collections import Counter

import pytest

from chronofact.llm import shards
from tests.llm.helpers import TEXTS, documents


def found(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]


def held(rows, texts, n=16):
    """Every row once, places without gaps, numbers of rows at most one apart."""
    said = lambda t: (t or "").encode()
    assert Counter(r[:3] for r in rows) == Counter((d, len(said(t)) + 1, zlib.crc32(said(t))) for d, t in texts)
    assert {r[3] for r in rows} <= {"rows"} and {r[6] for r in rows} <= {None}
    sizes = Counter(r[4] for r in rows)
    assert set(sizes) <= set(range(n)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(n)) <= 1
    for s in sizes:
        assert sorted(r[5] for r in rows if r[4] == s) == list(range(sizes[s]))


def test_cases_that_any_table_may_hold(spark):
    held(found(shards.sharded(documents(spark))), TEXTS)
    assert found(shards.sharded(documents(spark, []))) == []


@pytest.mark.parametrize("n", [1, 5, 16])
def test_many_buckets(spark, n, monkeypatch):
    texts = [(i, f"text {i}" * (i % 7)) for i in range(2000)] + [(5, "hot")] * 1500 + [(None, "hot")] * 1200
    monkeypatch.setattr(shards, "BUCKET_ROWS", 100)
    path = shards.write(documents(spark, texts), n, bucket_rows=100)
    rows = shards.read(spark, path, documents(spark, texts).schema)
    assert rows.columns == [*documents(spark, []).columns, "slot", "shard"]
    for s, size in Counter(r.shard for r in rows.collect()).items():
        assert sorted(r.slot for r in rows.where(f"shard = {s}").collect()) == list(range(size))
    assert Counter((r.doc_id, r.text) for r in rows.collect()) == Counter(texts)


def test_a_seed_gives_one_order_however_the_input_is_cut(spark):
    texts = [(i, f"text {i}") for i in range(3000)]
    order = lambda df, seed: sorted(found(shards.read(spark, shards.write(df, 4, seed, bucket_rows=200), df.schema).selectExpr("doc_id", "0 AS size", "0 AS text_crc32", "'' AS law", "shard", "slot", "0 AS grown_shard")))
    docs = documents(spark, texts)
    first = order(docs, 42)
    assert first == order(docs.repartition(7), 42) and first != order(docs, 43)


def test_order_is_random(spark):
    """Each document is as likely in one shard as in another, and neighbours part."""
    texts = [(i, "t") for i in range(4000)]
    place = {r[0]: (r[4], r[5]) for r in found(shards.sharded(documents(spark, texts)))}
    expected = 250 / 16
    spread = sum((Counter(place[i][0] for i in range(k, k + 250)).get(s, 0) - expected) ** 2 / expected for k in range(0, 4000, 250) for s in range(16))
    assert spread < 400  # chi-square of about 225 degrees
    together = sum(place[i][0] == place[i + 1][0] and abs(place[i][1] - place[i + 1][1]) == 1 for i in range(3999))
    assert together < 10


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, "x", 7)], "doc_id long, text string, shard int, slot string, lang int")
    path = shards.write(docs, 2)
    (row,) = shards.read(spark, path, docs.schema).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a", "_column_2": 5, "_column_3": "x", "lang": 7, "slot": 0, "shard": 0}
