"""Token shards in patched frame-of-reference blocks.

A shard holds the ids of consecutive documents. Ids come in blocks of 128: each block stores its minimum, the width in
bits that the 90th percentile of its offsets from the minimum needs, the low bits of all offsets packed at that width,
and the offsets that need more bits in an exception list. Block starts are indexed, so a range of ids is decoded without
the rest.

    magic 8 bytes | header: n_ids, n_docs, n_blocks, n_packed, n_exceptions (u64 each)
    minimums u32 | widths u8 | block starts in the packed bytes u64 | exception starts u32   (one for each block)
    packed bytes | exception places u8 | exception offsets u32
    doc_id i64 | whether doc_id is null u8 | first id of the document u64                    (one for each document)

Documents are dealt by ranges of doc_id and sorted within, so shards in order of (part, shard) are in order of doc_id.
A shard is written under a temporary name and renamed; its name and bytes depend on its rows alone, so a task that runs
again writes the same file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm import tokens
from chronofact.llm.text import named
from chronofact.session import new_folder, stored

MAGIC = b"PFORTOK1"
BLOCK = 128


def pack(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, percentile: float = 0.9) -> bytes:
    """The bytes of a shard. starts: the first id of each document."""
    n, nb = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(nb * BLOCK, np.uint32)
    grid[:n] = ids
    if nb:
        grid[n:] = ids[-1]
    grid = grid.reshape(nb, BLOCK)
    low = grid.min(axis=1) if nb else np.empty(0, np.uint32)
    off = grid - low[:, None]
    k = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    typical = np.partition(off, k, axis=1)[:, k] if nb else low
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    sizes = width.astype(np.uint64) * (BLOCK // 8)
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    packed = np.zeros(int(at[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for some in np.array_split(rows, len(rows) // 512 + 1):
                packed[at[some].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)] = _low_bits(off[some], int(w))
    most = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    row, place = np.nonzero(off > most[:, None])
    first = np.searchsorted(row, np.arange(nb + 1))
    head = np.array([n, len(doc_ids), nb, len(packed), len(row)], "<u8")
    parts = [
        low.astype("<u4"), width, at[:-1].astype("<u8"), first[:-1].astype("<u4"), packed,
        place.astype(np.uint8), off[row, place].astype("<u4"),
        np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.asarray(starts, "<u8"),
    ]
    return MAGIC + head.tobytes() + b"".join(p.tobytes() for p in parts)


def _low_bits(off: np.ndarray, w: int) -> np.ndarray:
    """The w low bits of each number, packed row by row, lowest first."""
    if w in (8, 16, 32):
        return np.ascontiguousarray(off.astype(f"<u{w // 8}")).view(np.uint8)
    bits = np.unpackbits(off.astype("<u4").view(np.uint8).reshape(*off.shape, 4), axis=2, bitorder="little")[:, :, :w]
    return np.packbits(bits.reshape(len(off), -1), axis=1, bitorder="little")


class Shard:
    """Reads the bytes of a shard."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, n_docs, self.nb, n_packed, n_exc = map(int, np.frombuffer(data, "<u8", 5, 8))
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.low, self.width, self.at, self.first = take("<u4", self.nb), take("u1", self.nb), take("<u8", self.nb), take("<u4", self.nb)
        self.packed, self.place, self.off = take("u1", n_packed), take("u1", n_exc), take("<u4", n_exc)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.starts = take("<u8", n_docs).astype(np.int64)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """The ids of blocks a to b, as a flat array."""
        out = np.zeros((b - a, BLOCK), np.uint32)
        width = self.width[a:b]
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                got = self.packed[self.at[a:b][rows].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                if w in (8, 16, 32):
                    out[rows] = got.view(f"<u{w // 8}")
                    continue
                bits = np.unpackbits(got, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
                whole = np.zeros((len(rows), BLOCK, 4), np.uint8)
                low = np.packbits(bits, axis=2, bitorder="little")
                whole[:, :, : low.shape[2]] = low
                out[rows] = whole.view("<u4")[:, :, 0]
        lo = int(self.first[a]) if a < self.nb else 0
        hi = int(self.first[b]) if b < self.nb else len(self.place)
        row = np.searchsorted(self.first[a:b], np.arange(lo, hi), side="right") - 1
        out[row, self.place[lo:hi]] = self.off[lo:hi]
        return (out + self.low[a:b, None]).reshape(-1)

    def read(self, start: int, n: int) -> np.ndarray:
        """n ids from the shard's id number start."""
        a, b = start // BLOCK, -(-(start + n) // BLOCK)
        return self.blocks(a, b)[start - a * BLOCK : start - a * BLOCK + n] if n else np.empty(0, np.uint32)

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id and ids of each document; `most` ids or one document are decoded at a time."""
        ends = np.append(self.starts[1:], self.n) if len(self.starts) else self.starts
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + most, side="right")))
            got = self.read(int(self.starts[i]), int(ends[j - 1] - self.starts[i]))
            for k in range(i, j):
                yield self.doc_ids[k], int(self.starts[k]), got[self.starts[k] - self.starts[i] : ends[k] - self.starts[i]]
            i = j


def put(folder: str, name: str, data: bytes) -> str:
    """Write a file to a shared folder under a temporary name, then rename it."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        f.write(data)
    store.move(tmp, f"{base}/{name}")
    return f"{folder}/{name}"


def get(path: str) -> bytes:
    store, base = fs.FileSystem.from_uri(path)
    with store.open_input_stream(base) as f:
        return f.read()


def write(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, shard_ids: int = 1 << 20) -> DataFrame:
    """Encode docs and write them as shards of shard_ids ids or a little more. Returns the manifest: part, shard, path,
    n_docs, n_tokens, and start (the ids of all shards before)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        enc, end = tokens.encoder(vocabulary), np.array([end_id], np.uint32)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(x) for _, x in held], np.int64)
            data = pack(np.concatenate([x for _, x in held]), [d for d, _ in held], np.cumsum(lengths) - lengths)
            path = put(folder, f"part-{part:06d}-{shard:05d}.pfor", data)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": path, "n_docs": len(held), "n_tokens": int(lengths.sum())}])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.each(b.column(1)), strict=True):
                held.append((doc_id, np.append(ids, end)))
                size += len(held[-1][1])
                if size >= shard_ids:
                    yield close()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = named(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(spark, rows.mapInArrow(run, "part long, shard long, path string, n_docs long, n_tokens long"), "token-manifest")
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return manifest.join(parts.select("part", "base"), "part").withColumn("start", start).drop("base")


def read(manifest: DataFrame) -> DataFrame:
    """Documents of the shards in a manifest: doc_id, start (ids before it in all shards), n_tokens, ids (u32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                size = 0
                for doc_id, start, ids in Shard(get(path)).documents():
                    out.append((doc_id, base + start, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size > 1 << 20:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def round_trip(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write docs as token shards and read them back: doc_id, start, n_tokens, ids.

    A row for each row of docs, in ascending doc_id over the shards: null ids first, rows of one doc_id by text. Null and
    empty texts hold the end id alone. An empty table writes no shard and gives no rows. Long texts make long shards,
    never cut ones.
    """
    return read(write(docs, vocabulary, folder))
