"""Source documents and their files: contents held once, the last write of a source, faults as rows of a report."""

import datetime
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from chronofact.sources import files
from chronofact.sources.log import Conflict

DOCS = "ord long, raw string, url string, activity string, agent string, retrieved_at timestamp_ntz"
FILE = "ord long, source_id string, filename string, mime string, content binary"


def put(log, batch, rows, at="2024-01-02 00:00:00", **given):
    df = log.spark.createDataFrame([(i, s, f"{i}.bin", "x/y", c) for i, s, c in rows], FILE)
    return {r.ord: (r.outcome, r.detail) for r in files.attach(log, df, at, batch, **given).collect()}


@pytest.fixture
def store(spark, tmp_path):
    log = files.open_files(spark, f"file://{tmp_path}/files")
    when = datetime.datetime(2020, 5, 5)
    docs = [(1, '{"a": 1}', "u1", "crawl", "me", when), (2, '{"a": 1}', None, "crawl", "me", None), (3, "[1]", "u3", "crawl", "me", None), (4, None, "u4", "crawl", "me", None), (5, '{"a": ', "u5", "crawl", "me", None), (6, "{}", "u6", None, "me", None)]
    report = files.ingest(log, spark.createDataFrame(docs, DOCS), "2024-01-01 00:00:00", "docs").collect()
    return log, {r.ord: r.source_id for r in report if r.outcome == "insert"}, {r.ord: r.detail for r in report}


def test_documents(spark, store):
    log, ids, details = store
    assert sorted(ids) == [1, 2] and len(set(ids.values())) == 2  # equal contents are sources of their own
    assert details == {1: None, 2: None, 3: "not a JSON object", 4: "no document", 5: "not a JSON object", 6: "no activity"}
    got = {r.id: (r.url, r.retrieved_at) for r in log.rows("sources").collect()}
    assert got == {ids[1]: ("u1", datetime.datetime(2020, 5, 5)), ids[2]: (None, datetime.datetime(2024, 1, 1))}
    version = log.version()
    files.ingest(log, spark.createDataFrame([], DOCS), "2024-01-01 00:00:00", "docs")
    assert log.version() == version  # a batch that is known
    assert files.ingest(log, spark.createDataFrame([], DOCS), "2024-01-01 00:00:00", "none").count() == 0


def test_replaced_twice_leaves_one_content(spark, store, tmp_path):
    log, ids, _ = store
    big = bytes(range(256)) * 4000
    for batch, content in enumerate([b"one" * 1000, b"two" * 1000, big]):
        assert put(log, f"b{batch}", [(1, ids[1], content)], f"2024-02-0{batch + 1} 00:00:00")[1] == ("replace" if batch else "insert", None)
    assert [(r.sha256, r.refs) for r in files.held(log).collect()] == [(hashlib.sha256(big).hexdigest(), 1)]
    assert [bytes(r.data) for r in log.rows("blobs").collect()] == [big]
    row = files.fetch(log, [ids[1]]).first()
    assert bytes(row.data) == big and row.size_bytes == len(big) and row.created_at == datetime.datetime(2024, 2, 1)
    log.compact()
    log.vacuum()
    left = spark.read.parquet(*{p.rsplit("/", 1)[0] for p in glob.glob(f"{tmp_path}/files/data/blobs/*/*.parquet")})
    assert [bytes(r.data) for r in left.collect()] == [big]  # the bytes of the others are gone
    assert bytes(files.fetch(log, [ids[1]]).first().data) == big


def test_shared_contents_live_as_long_as_a_name(store):
    log, ids, _ = store
    assert put(log, "a", [(1, ids[1], b"same"), (2, ids[2], b"same")]) == {1: ("insert", None), 2: ("insert", None)}
    assert log.records("blobs").count() == 1
    assert put(log, "b", [(1, ids[1], b"other")])[1][0] == "replace"
    assert {bytes(r.data) for r in log.rows("blobs").collect()} == {b"same", b"other"}
    assert put(log, "c", [(1, ids[2], b"other")])[1][0] == "replace"
    assert {bytes(r.data) for r in log.rows("blobs").collect()} == {b"other"}
    assert put(log, "d", [(1, ids[2], b"same")])[1][0] == "replace"  # a content that was gone comes back
    assert {bytes(r.data) for r in log.rows("blobs").collect()} == {b"same", b"other"}
    assert put(log, "e", [(1, ids[2], b"same")])[1][0] == "same"
    assert {bytes(r.data) for r in files.fetch(log, [ids[1], ids[2]]).collect()} == {b"same", b"other"}


def test_faults_and_order_in_a_batch(spark, store):
    log, ids, _ = store
    rows = [(1, ids[1], b""), (2, ids[1], None), (3, ids[1], b"x" * 11), (4, "nobody", b"y"), (5, ids[1], b"first"), (6, ids[1], b"later"), (7, None, b"z")]
    want = {1: ("reject", "empty file"), 2: ("reject", "empty file"), 3: ("reject", "too large"), 4: ("reject", "unknown source"), 5: ("passed", None), 6: ("insert", None), 7: ("reject", "unknown source")}
    assert put(log, "a", rows, most=10) == want
    assert put(log, "a", rows, most=10) == want and log.records("names").count() == 1
    assert [r.filename for r in files.meta(log).collect()] == ["6.bin"]
    assert files.meta(log).where(F.col("source_id") == ids[2]).count() == 0  # no file is no error here
    with pytest.raises(ValueError, match="no file"):
        files.fetch(log, [ids[1], ids[2]])


def test_another_writer_first(store, monkeypatch):
    log, ids, _ = store
    real, lost = files.FileLog.append, []

    def append(self, batch, tables, expected):
        if batch == "mine" and not lost:
            lost.append(1)
            put(log, "theirs", [(1, ids[1], b"theirs")])
        return real(self, batch, tables, expected)

    monkeypatch.setattr(files.FileLog, "append", append)
    assert put(log, "mine", [(1, ids[1], b"mine")]) == {1: ("replace", None)}  # decided again over the version of the other
    assert [bytes(r.data) for r in log.rows("blobs").collect()] == [b"mine"]
    monkeypatch.setattr(files.FileLog, "append", lambda *a: (_ for _ in ()).throw(Conflict("always")))
    with pytest.raises(Conflict):
        put(log, "never", [(1, ids[1], b"never")], tries=2)
