"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ by two bits or fewer differ by at
most one bit in one of the segments, so each distinct fingerprint is indexed under its 64 one-wildcard segment variants
(segment, wildcard position, the other 31 bits). An equality join on the variants brings candidates together and the
popcount of their difference verifies them.

A variant that more than `crowd` distinct fingerprints share is not joined with itself, which would emit all its pairs.
Its members are indexed a second time under every 64-bit value within one bit of them: two fingerprints share such a
value exactly if they differ by two bits or fewer, at most 65 fingerprints can share one, and each is linked with the
least of them. No link is lost and no group is large.

Fingerprints are 16 bytes a document, so equal texts meet before any index is built. Components are found by
alternating large-star and small-star steps on the links, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.text import apart, named
from chronofact.session import stored

SEED = 42
#: Variants of three fingerprints or more that are broadcast at most (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """The SimHash of the n-word shingles of a text, as an unsigned integer; zero for a text without words."""
    found = (text or b"").lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    k = max(1, len(found) - n + 1)
    last = ends[min(n, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - sizes)[:k].tolist(), last, strict=True)], np.uint64)
    on = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 16):  # bits take eight times the memory of the hashes
        on += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * on > k, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and its fingerprint fp (long), a row for each row of docs. A null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), n) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = dict(named(docs, "doc_id").dtypes)["doc_id"]
    return named(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows for each fp: key holds segment (bit 37), wildcard position (32 to 36) and the segment without that bit."""
    at = F.col("at")
    seg = F.when(at < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, CAST(at % 32 AS INT))")
    key = seg.bitwiseAND(F.bitwise_not(bit)) + at.cast("long") * F.lit(1 << 32)
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).select("fp", key.alias("key"))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, bits: int = 2, crowd: int = 16) -> DataFrame:
    """Links a < b (as signed longs) between distinct fingerprints, enough of them that every pair within `bits` bits
    (2 at most) is joined by links each of which is itself such a pair. fps: distinct values in a column fp."""
    if not 0 <= bits <= 2:
        raise ValueError("two segments with one wildcard each find pairs of two bits or fewer")
    spark = fps.sparkSession
    # 64 rows for each fingerprint: deal the fingerprints to tasks by number of rows, not by their few bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fps.count() // 100_000 + 1)
    fps = fps.repartition(tasks, "fp")
    sizes = stored(
        spark,
        _variants(fps).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"),
        "simhash-variants",
    )
    near = _apart(F.col("a"), F.col("b")) <= bits
    pairs = sizes.where("n = 2").where(near).select("a", "b")
    common = sizes.where("n > 2").select("key", "n")
    if common.count() <= BROADCAST_KEYS:
        common = F.broadcast(common)
    shared = stored(spark, _variants(fps).join(common, "key"), "simhash-shared")
    few = shared.where(F.col("n") <= crowd)
    few = _joined(few, near)
    crowded = shared.where(F.col("n") > crowd).select("fp").distinct()
    return pairs.unionByName(few).unionByName(_around(crowded, bits)).distinct()


def _joined(few: DataFrame, near: Column) -> DataFrame:
    a = few.select("key", F.col("fp").alias("a"))
    b = few.select(F.col("key").alias("key_b"), F.col("fp").alias("b"))
    return a.join(b, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _around(fps: DataFrame, bits: int) -> DataFrame:
    """Links among fps by the values within one bit of each."""
    flipped = F.when(F.col("at") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, CAST(at AS INT))")))
    near = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("at")).select("fp", flipped.alias("value"))
    near = near.groupBy("value").agg(F.sort_array(F.collect_set("fp")).alias("fps")).where(F.size("fps") > 1)
    if bits == 2:  # whoever shares a value is a pair
        return near.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    pairs = near.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    return pairs.where((F.col("a") < F.col("b")) & (_apart(F.col("a"), F.col("b")) <= bits))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (least node reachable, as a signed long) for every node of the edges (a, b).

    Large-star joins the greater neighbours of a node to its least neighbour, small-star the lesser ones; the edges
    become stars in a number of rounds that grows with the logarithm of the longest path. Only counts reach the driver.
    """
    spark = edges.sparkSession
    edges = stored(spark, edges, "components")
    before = None
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b"), F.col("m").alias("a")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m"))
        edges = stored(spark, small.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if now[:2] == before and now[0] == now[2]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now[:2]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, n: int = 3, bits: int = 2, crowd: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the least doc_id among all documents that links lead to.

    A row for each row of docs. Rows with a null or a repeated doc_id keep their rows; null ids don't count as least
    (component_id is null where no member has an id). Null and empty texts have fingerprint zero and link like others.
    An empty table gives no rows. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    fps = stored(spark, fingerprints(docs, n), "simhash")
    classes = stored(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), bits, crowd))
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stored(spark, classes.join(ids, "root").select("fp", "component_id"), "simhash-ids")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n: int = 3, bits: int = 2) -> DataFrame:
    """docs with one row of each component: the least by doc_id (null ids last), then by the hash of its text. Rows that repeat in
    both are one row too. Other columns are as they were."""
    spark = docs.sparkSession
    docs, back = apart(docs, "doc_id", "text")
    row = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")]
    own = named(docs, "doc_id", "text")
    fps = own.select(F.struct(*row).alias("doc_id"), "text")
    found = stored(spark, fingerprints(fps, n), "simhash-rows")
    classes = stored(spark, found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), bits))
    roots = classes.join(roots, classes["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = stored(spark, roots.agg(F.min("least").alias("k")).select("k.id", "k.hash"), "simhash-kept")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    out = docs.join(kept, same, "left_semi")
    if found.count() == found.select("doc_id").distinct().count():
        return back(out)
    return back(out.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]))
