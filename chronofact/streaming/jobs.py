"""Streaming jobs over a folder of events. Each runs over what is there (availableNow) and returns the written result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.operators.query import money
from chronofact.session import new_folder
from chronofact.sources.log import Log

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """The stream of events, with event time as a timestamp and a watermark. path: a folder of files, or one file of a folder."""
    folder, _, name = path.rstrip("/").rpartition("/")
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(EVENTS).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def written(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream to its present end. Batches overwrite (complete) or append to a table in the shared folder."""
    spark = stream.sparkSession
    out, log = new_folder(spark, name), new_folder(spark, f"{name}-log")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(spark: SparkSession, path: str, width: str = "1 day") -> DataFrame:
    """start, event_type, n, total: events by window of event time."""
    rows = events(spark, path).groupBy(F.window("ts", width).alias("w"), "event_type")
    rows = rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return written(rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "tumbling")


def sliding(spark: SparkSession, path: str, width: str = "2 days", step: str = "1 day") -> DataFrame:
    rows = events(spark, path).groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return written(rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "sliding")


def sessions(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    """user_id, start, n: runs of a user's events with less than `gap` between them."""
    rows = events(spark, path).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return written(rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "sessions")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_id, event_type: the change feed folded into the present state of each user."""
    rows = events(spark, path).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return written(rows.select("user_id", "e.event_id", "e.event_type"), "latest")


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """event_id, event_type: events once each, however often they are delivered within the watermark."""
    rows = events(spark, path).dropDuplicatesWithinWatermark(["event_id"])
    return written(rows.select("event_id", "event_type"), "deduplicated", "append")


#: The present state of each user: of two records the later event holds, whichever came first.
FEED = {"users": ("user_id long, event_id long, event_type string, ts timestamp_ntz", ["user_id"], ["ts", "event_id"])}


def upserted(spark: SparkSession, path: str, folder: str | None = None, compact_every: int = 8, files_per_batch: int | None = None) -> Log:
    """The change feed as a log of upserts: of each batch the last event of each user, added under the batch's number, so that a batch that is
    repeated after a restart adds nothing. No state is kept between batches but the log, which is compacted every few of them. Late events
    count by their time. folder: of the log and the stream's checkpoint, to go on from; fresh by default."""
    folder = folder or new_folder(spark, "feed")
    log = Log(spark, f"{folder}/log", FEED)
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.option("pathGlobFilter", name).parquet(parent) if name.endswith(".parquet") else reader.parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        last = batch.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("e"))
        log.append(f"batch {number}", {"users": last.select("user_id", "e.*")}, log.version())
        if number % compact_every == compact_every - 1:
            log.compact()
            log.vacuum()

    query = raw.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return log


def closed_windows(spark: SparkSession, path: str, width: str = "1 day", late: str = "1 day") -> tuple[DataFrame, int]:
    """start, event_type, n, total of the windows that the watermark has passed, each written once, and the number of rows that came too
    late for theirs. State holds open windows alone."""
    rows = events(spark, path, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), money("value").alias("total"))
    rows = rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    out, marks = new_folder(spark, "closed"), new_folder(spark, "closed-log")
    query = rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    return spark.read.schema(rows.schema).parquet(out), dropped
