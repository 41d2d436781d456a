"""Sharding by a shuffle in two passes, in built-in functions alone.

The first pass scatters records over buckets of bounded size by a seeded hash; the shuffle's files are the buckets. The second takes each
bucket into memory, permutes it by Spark's own Fisher-Yates (the function shuffle), and writes it. Buckets follow one another, so a record's
place among all is known from the bucket's size alone, and shards are equal ranges of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from chronofact.llm.text import apart, named
from chronofact.session import new_folder, stored

#: Bytes and rows of a bucket on average.
BUCKET_BYTES, BUCKET_ROWS = 16 * 2**20, 50_000
#: Rows of one doc_id from which on these are scattered one by one.
FREQUENT = 1000


def size(text: Column) -> Column:
    """UTF-8 bytes of a text, and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _frequent(docs: DataFrame) -> DataFrame | None:
    """doc_ids of more than FREQUENT rows (null is one), if there are any."""
    many = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("doc_id")
    found = stored(docs.sparkSession, many, "frequent")
    return found if found.limit(1).count() else None


def scattered(docs: DataFrame, buckets: int, seed: int) -> DataFrame:
    """docs with _bucket, and _hash, which orders a bucket before it is permuted. Rows of one doc_id are together, unless it has many: these
    have a part of their own for each thousand or so, by their place in the input, and docs is then written first, so that places hold."""
    many = _frequent(docs)
    if many is None:
        docs = docs.withColumn("_part", F.lit(0).cast("long"))
    else:
        docs = stored(docs.sparkSession, docs.withColumn("_part", F.monotonically_increasing_id()), "placed")
        hot = many.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_hot"))
        docs = docs.join(hot, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        docs = docs.withColumn("_part", F.when(F.col("_hot"), F.col("_part")).otherwise(0)).drop("_id", "_hot")
    key = F.xxhash64(F.lit(seed), "doc_id", "_part")
    return docs.withColumn("_bucket", F.pmod(key, F.lit(buckets)).cast("int")).withColumn("_hash", F.xxhash64(F.lit(seed + 1), "doc_id", "_part", "text")).drop("_part")


def _places(rows: DataFrame) -> tuple[DataFrame, int]:
    """The number of rows in the buckets before each (one row for a bucket), and of all rows."""
    counts = stored(rows.sparkSession, rows.groupBy("_bucket").agg(F.count("*").alias("n")), "buckets")
    before = F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each 16 MB of input
    return counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before")), counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _given_back(docs: DataFrame) -> dict[str, str]:
    """The names under which write() keeps the columns that apart() has renamed: their own, unless these clash with another column."""
    low = [c.lower() for c in docs.columns]
    return {f"_column_{i}": c for i, c in enumerate(docs.columns) if low.count(c.lower()) == 1 and c.lower() not in ("shard", "slot")}


def _first_place(shard: Column, shards: int, count: int) -> Column:
    """The first place of a shard: the first count % shards of them have a row more."""
    least, more = divmod(count, shards)
    return shard.cast("long") * least + F.least(shard.cast("long"), F.lit(more))


def _shard_of(place: Column, shards: int, count: int) -> Column:
    least, more = divmod(count, shards)
    large = more * (least + 1)  # places of the shards that have a row more
    in_rest = F.lit(0) if not least else F.floor((place - large) / least) + more
    return F.when(place < large, F.floor(place / (least + 1))).otherwise(in_rest).cast("int")


def write(docs: DataFrame, shards: int = 16, seed: int = 42, path: str | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> str:
    """Write docs (doc_id, text, and any others) in random order to folders shard=0 and on of a table, with their columns and slot, the place
    in the shard from 0 without gaps; returns its path. The numbers of rows in two shards differ by one at most.

    Seed, rows and sizes of buckets decide the order; rows that are equal in doc_id and text may change places, and so may those of a doc_id
    with more than a thousand rows if the input is cut otherwise. Null ids and texts are values like any other, and rows that repeat are
    rows of their own: each is written once. A text goes whole to one place, so a task needs memory for its buckets, or for the longest
    text. Columns whose names are in use (shard, slot, or twice the same) are named _column_0 and on by their places. An empty table
    gives no shards."""
    spark = docs.sparkSession
    own, _ = apart(docs, "doc_id", "text")
    n, total = own.agg(F.count("*"), F.sum(size(F.col("text")))).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes), -(-n // bucket_rows))
    rows = scattered(own, buckets, seed)
    before, count = _places(rows)
    record = F.struct("_hash", F.struct(*own.columns).alias("r"))
    together = rows.repartition(buckets, "_bucket").groupBy("_bucket").agg(F.collect_list(record).alias("rows"))  # 16 MB on average
    in_order = F.array_sort("rows", lambda a, b: F.when(a["_hash"] < b["_hash"], -1).when(a["_hash"] > b["_hash"], 1).otherwise(0))
    mixed = together.sortWithinPartitions("_bucket").withColumn("rows", F.shuffle(in_order, F.lit(seed)))
    placed = mixed.join(F.broadcast(before), "_bucket").select("_before", F.posexplode("rows").alias("_at", "_row"))
    placed = placed.select("_row.r.*", (F.col("_before") + F.col("_at")).alias("_place")).withColumnsRenamed(_given_back(docs))
    placed = placed.withColumn("shard", _shard_of(F.col("_place"), shards, count))
    placed = placed.withColumn("slot", F.col("_place") - _first_place(F.col("shard"), shards, count)).drop("_place")
    path = path or new_folder(spark, "shards")
    placed.write.partitionBy("shard").parquet(path)
    return path


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at path. schema: of the written docs, needed where there are no rows to tell it."""
    found = spark.createDataFrame([], schema)
    names = [_given_back(found).get(f"_column_{i}", c if c.lower() in ("doc_id", "text") else f"_column_{i}") for i, c in enumerate(found.columns)]
    own = StructType([StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
    return spark.read.schema(own.add("slot", LongType()).add("shard", IntegerType())).parquet(path)


def sharded(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`: numbers of rows are at most one apart), shard, slot and grown_shard (null: one more shard moves
    rows everywhere) of written docs, read back. See write() for nulls, repeated rows and the like."""
    spark = docs.sparkSession
    docs = named(docs, "doc_id", "text")
    rows = read(spark, write(docs, shards, seed), docs.schema)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
