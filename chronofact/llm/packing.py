"""Packing documents into sequences by patterns that non-negative least squares fits to the histogram of lengths.

Whatever the number of documents, lengths run from 1 to the sequence size, so their histogram is small. The driver
enumerates patterns of one to three lengths that fill a sequence exactly, fits repeat counts to the histogram, rounds
them, and packs what is left over by best fit on the histogram's counts. It never sees a document.

A pattern that repeats x times owns x sequence numbers and, for each of its lengths, x consecutive ranks among the pieces
of that length. A piece's rank is its rank within its part plus the pieces of that length in earlier parts, so a common
length is numbered by all tasks at once, and the slot of a rank is found by binary search in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofact.llm import tokens
from chronofact.llm.text import named
from chronofact.session import stored

SIZE = 1024
END = 2
#: Rows of the (part, length) table that are broadcast at most; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all but the first have the full size."""
    k = max(1, -(-n // size))
    first = n - (k - 1) * size
    return [(0, first)] + [(first + i * size, size) for i in range(k - 1)]


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """part, doc_id, piece, start, length, rank (among those of its part and length), ids_crc32, and ids if asked for; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, end = TaskContext.get().partitionId(), tokens.encoder(vocabulary), np.array([end_id], np.uint32)
        seen = np.zeros(size + 1, np.int64)
        out: list[tuple] = []
        held = 0
        for b in batches:
            for doc_id, found in zip(b.column(0).to_pylist(), enc.each(b.column(1)), strict=True):
                ids = np.append(found, end)
                for i, (start, length) in enumerate(cut(len(ids), size)):
                    own = ids[start : start + length].astype("<u4").tobytes()
                    out.append((part, doc_id, i, start, length, int(seen[length]), zlib.crc32(own), *[own] * with_ids))
                    seen[length] += 1
                    held += length
                    if held > 1 << 19:
                        yield _batch(out)
                        out, held = [], 0
        if out:
            yield _batch(out)

    kinds = "part long, doc_id long, piece int, start long, length long, rank long, ids_crc32 long" + ", ids binary" * with_ids
    rows = named(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return stored(docs.sparkSession, rows.mapInArrow(run, kinds), "pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "doc_id", "piece", "start", "length", "rank", "ids_crc32", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    n = len(rows[0])
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[:n], strict=True)], names=names[:n])


def patterns(counts: np.ndarray) -> np.ndarray:
    """Lengths (a >= b >= c, zero for none) that occur in counts and add up to the size, len(counts) - 1."""
    size = len(counts) - 1
    here = counts > 0
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(0, size // 2 + 1), indexing="ij")
    c = size - a - b
    ok = (b <= a) & (c <= b) & (c >= 0)
    found = np.stack([a[ok], b[ok], c[ok]], axis=1)
    present = here.copy()
    present[0] = True
    return found[present[found].all(axis=1)]


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared error of patterns against counts, by multiplicative updates."""
    n = len(counts)
    used = (found > 0).astype(float)
    target = counts.astype(float)
    target[0] = 0
    x = np.full(len(found), target.sum() / max(1, used.sum()))
    up = (target[found] * used).sum(axis=1)
    for _ in range(rounds):
        now = np.bincount(found.ravel(), (x[:, None] * used).ravel(), n)
        x *= up / np.maximum((now[found] * used).sum(axis=1), 1e-12)
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use every length as often as counts (by length) says."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left.any() and len(found := patterns(left)):
        x = fit(found, left)
        for i in np.argsort(-x, kind="stable"):
            lengths = tuple(int(v) for v in found[i] if v)
            n = min([int(np.rint(x[i]))] + [int(left[v]) // lengths.count(v) for v in set(lengths)])
            if n > 0:
                out.append((lengths, n))
                for v in lengths:
                    left[v] -= n
    while len(here := np.flatnonzero(left)):
        now = left.copy()
        lengths, room = [], len(left) - 1
        while room and len(fits := here[: np.searchsorted(here, room, side="right")]):
            fits = fits[now[fits] > 0]
            if not len(fits):
                break
            lengths.append(int(fits[-1]))
            now[fits[-1]] -= 1
            room -= int(fits[-1])
        n = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        out.append((tuple(lengths), n))
        for v in lengths:
            left[v] -= n
    return out


def slots(chosen: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: who has a rank from the first on, up to the next row,
    stands at the offset in the sequence as far from the first."""
    rows, taken, sequence = [], {}, 0
    for lengths, n in chosen:
        at = 0
        for v in lengths:
            rows.append((v, taken.get(v, 0), sequence, at))
            taken[v] = taken.get(v, 0) + n
            at += v
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves unless with_ids is false.

    Each row of docs becomes one or more pieces; null and empty texts are the end id alone. Rows of one doc_id, or of
    none, are documents of their own. Full pieces fill a sequence each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = pieces(docs, vocabulary, size, end_id, with_ids)
    hist = stored(spark, rows.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(size + 1, np.int64)
    for r in hist.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    table = slots(plan(counts))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = hist.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if hist.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    skinny = rows.select("part", "doc_id", "piece", "start", "length", "rank", "ids_crc32", *["ids"] * with_ids).join(base, ["part", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(table[:, 1].max(initial=0)) + 1
        scale = max(top, 1 << 40)
        keys = table[:, 0] * scale + table[:, 1] if scale < 1 << 52 else None
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("at").to_numpy()
            if keys is not None:
                row = table[np.searchsorted(keys, length * scale + rank, side="right") - 1]
            else:  # ranks beyond 2 ** 52
                row = np.empty((len(rank), 4), np.int64)
                for v in np.unique(length):
                    own, me = table[table[:, 0] == v], length == v
                    row[me] = own[np.searchsorted(own[:, 1], rank[me], side="right") - 1]
            new = [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])]
            yield pa.record_batch([b.column(c) for c in names] + new, names=names + ["sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return skinny.select(*names, (F.col("rank") + F.col("base")).alias("at")).mapInArrow(run, kinds)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its token ids (u32 bytes) and the lengths of its pieces in order: what a trainer reads."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
