"""WARC archives of pages, and a globally ordered capture index by an external merge.

Pages are written as gzip members, one record each, to one archive for each task. Payloads of 100 bytes or more that equal
that of a page with a smaller id are revisit records without a payload. The index has a line for each capture: URL key
(host labels reversed, then path and query), timestamp, and the place of its record. Every writing task sorts the lines of
its archive: a run. Ranges of (URL key, timestamp, page) are dealt to tasks, and each merges the runs that reach it with a
loser tree, so that the parts of the index, in order, give the history of every URL.
"""

from __future__ import annotations

import datetime
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.text import named
from chronofact.llm.urlrules import host
from chronofact.session import new_folder, stored

LEAST = 100
#: Digests of repeated payloads that are broadcast at most (80 bytes each).
BROADCAST_DIGESTS = 200_000
#: Date of the capture of page 0; each page is captured a second after the one before.
EPOCH = 1_704_067_200
INDEX = "url_key string, timestamp string, page_id long, path string, at long, size long, record_type string"
PLACED = INDEX + ", part long, position long"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, `)`, then path and query; hosts' A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), rest)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest (SHA-256, hex), refers_to (null for responses).

    Of equal payloads of 100 bytes or more, the row with the smallest page_id (null ids last), then url, is the response;
    of rows equal in both, one is. The smallest is found by an aggregate, so that a payload which many pages share is met
    by one small row from each task. The digests that repeat are broadcast where a count says that they are few, so that
    payloads stay where they were read; beyond, rows and digests are joined by a shuffle.
    """
    spark = pages.sparkSession
    rows = named(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    own = F.struct(F.col("page_id").isNull().alias("n"), "page_id", F.coalesce("url", F.lit("")).alias("u"))
    large = F.octet_length("payload") >= LEAST
    alike = rows.where(large).groupBy("digest", own.alias("f")).agg(F.count("*").alias("c"))
    first = alike.groupBy("digest").agg(F.min(F.struct("f.*", "c")).alias("f"), F.sum("c").alias("k")).where("k > 1")
    first = stored(spark, first.select("digest", "f"), "warc-repeated")
    if first.where("f.c > 1").limit(1).count():  # rows that are equal in all: written with numbers, of which the least is the response
        rows = stored(spark, rows.withColumn("_row", F.monotonically_increasing_id()), "warc-rows")
        least = rows.join(first.select("digest", F.struct("f.n", "f.page_id", "f.u").alias("f")), "digest").where(own == F.col("f")).groupBy("digest").agg(F.min("_row").alias("first_row"))
        first = stored(spark, first.join(least, "digest"), "warc-first")
        is_first = F.col("_row") == F.col("first_row")
    else:
        is_first = own.getField("n").eqNullSafe(F.col("f.n")) & F.col("page_id").eqNullSafe(F.col("f.page_id")) & own.getField("u").eqNullSafe(F.col("f.u"))
    out = rows.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, "digest", "left")
    revisit = F.coalesce(large & F.col("f").isNotNull() & ~is_first, F.lit(False))
    out = out.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("f.page_id")))
    return out.select("page_id", "url", "payload", "digest", "revisit", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, revisit: bool, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has no payload; its length and digest are those of the full one."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c not in chr(13) + chr(10))}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record: what follows the HTTP header of its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["http-length"] = next(x.split(b":")[1].decode().strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return fields, payload


def captured(page_id: int | None) -> datetime.datetime:
    """The capture time that stands for a page: its id in seconds after the start of 2024, over again after 2 ** 32 of them."""
    return datetime.datetime.fromtimestamp(EPOCH + (page_id or 0) % 2**32, datetime.UTC)


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives; returns the lines of the index, a sorted run for each archive (column path).

    A task writes its rows in order of page_id, url, digest and kind, so an attempt that is repeated writes the same bytes under
    the same name, and the places that another attempt gave still hold.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"captures-{part:06d}.warc.gz"
        tmp = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        lines, at = [], 0
        with store.open_output_stream(tmp) as f:
            for b in batches:
                for r in b.to_pylist():
                    stamp = captured(r["page_id"])
                    data = gzip_member(record(r["page_id"], r["url"], r["payload"], r["digest"], stamp.strftime("%Y-%m-%dT%H:%M:%SZ"), r["revisit"], r["refers_to"]))
                    f.write(data)
                    lines.append((r["url_key"], stamp.strftime("%Y%m%d%H%M%S"), r["page_id"], f"{folder}/{name}", at, len(data), "revisit" if r["revisit"] else "response"))
                    at += len(data)
        if lines:
            store.move(tmp, f"{base}/{name}")
            yield _lines(sorted(lines, key=_order))
        else:
            store.delete_file(tmp)

    rows = mark_revisits(pages).withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions("page_id", "url", "digest", "revisit")
    return stored(spark, rows.mapInArrow(run, INDEX), "warc-runs")


def _order(line: tuple) -> tuple:
    return line[0], line[1], line[2] is None, line[2] or 0, line[3], line[4]


def _lines(lines: list[tuple]) -> pa.RecordBatch:
    names = ["url_key", "timestamp", "page_id", "path", "at", "size", "record_type"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names=names)


def merged(runs: list[Iterator], key: Callable) -> Iterator:
    """Sorted runs in one order, by a loser tree: a node holds the run that lost there, and the winner's next item plays
    only the games on its way to the root."""
    k = len(runs)
    items = [next(r, None) for r in runs]
    keys = [None if x is None else (key(x), i) for i, x in enumerate(items)]

    def beats(a: int, b: int) -> bool:
        return keys[a] is not None and (keys[b] is None or keys[a] < keys[b])

    losers = [-1] * max(1, k)

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        losers[node] = b if beats(a, b) else a
        return a if beats(a, b) else b

    if not k:
        return
    winner = play(1) if k > 1 else 0
    while keys[winner] is not None:
        yield items[winner]
        items[winner] = nxt = next(runs[winner], None)
        keys[winner] = None if nxt is None else (key(nxt), winner)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def merge_index(lines: DataFrame) -> DataFrame:
    """The lines of all runs as one index: part is a range, and (part, position) the global order. A range's slices of runs are held as
    Arrow batches, and the tree takes a few lines of each at a time."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), {}
        for b in batches:  # in order of path: a run's slice is a stretch of rows
            paths = b.column(3).dictionary_encode()
            starts = [0, *(np.flatnonzero(np.diff(paths.indices.to_numpy())) + 1).tolist(), b.num_rows]
            for x, y in zip(starts, starts[1:], strict=False):
                if x < y:
                    runs.setdefault(b.column(3)[x].as_py(), []).append(b.slice(x, y - x))
        at, out = 0, []
        for line in merged([_streamed(r) for _, r in sorted(runs.items())], _order):
            out.append(line)
            if len(out) == 10_000:
                yield _placed(out, part, at)
                at, out = at + len(out), []
        if out:
            yield _placed(out, part, at)

    rows = lines.repartitionByRange(n, "url_key", "timestamp", F.col("page_id").isNull(), "page_id")
    rows = rows.sortWithinPartitions("path", "url_key", "timestamp", F.col("page_id").isNull(), "page_id", "at")
    return rows.mapInArrow(run, PLACED)


def _streamed(batches: list[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """The rows of a run's batches, made into tuples a few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)


def _placed(lines: list[tuple], part: int, at: int) -> pa.RecordBatch:
    b = _lines(lines)
    new = [pa.array([part] * len(lines), pa.int64()), pa.array(range(at, at + len(lines)), pa.int64())]
    return pa.record_batch(b.columns + new, names=b.schema.names + ["part", "position"])


def read(index: DataFrame, block: int = 1 << 26) -> DataFrame:
    """The index with the record of each line: url, refers_to, payload_bytes and payload_digest (of the full payload) and
    payload (empty for revisits). Tasks take blocks of archives in order. The payload of a response is hashed again and
    held to its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            out, size = [], 0
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if line[3] != name:
                    if f:
                        f.close()
                    name = line[3]
                    store, base = fs.FileSystem.from_uri(name)
                    f = store.open_input_file(base)
                f.seek(line[4])
                out.append((*line, *_row(*parse(zlib.decompress(f.read(line[5]), 31)))))
                size += len(out[-1][-1])
                if size > 1 << 23:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
        if f:
            f.close()

    names = [*index.columns, "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    batch = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = index.repartition(n, "path", F.floor(F.col("at") / block)).sortWithinPartitions("path", "at")
    return rows.mapInArrow(run, PLACED + ", url string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _row(fields: dict[str, str], payload: bytes) -> tuple:
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {fields['warc-record-id']} has another digest than its header")
    first = fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">") if revisit else ""
    return fields["warc-target-uri"], int(first) if first else None, int(fields["http-length"]), digest, payload


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives, merge their index, and read the archives back through it: the index (part and position
    are its order) with url, record_type, refers_to, payload_bytes, payload_digest and payload.

    A row for each row of pages. Null html is an empty payload, null urls are empty, line ends are taken out of urls.
    Empty tables write no archive and give no rows. page_id may be null or repeated.
    """
    return read(stored(pages.sparkSession, merge_index(write(pages, folder)), "warc-index"))
