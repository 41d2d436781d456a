"""A store of source documents and their original files, as a log.

A file is held by its content: `blobs` has each content once, under its SHA-256, and `names` says which content a source has. The last write of a
source holds. A commit that takes the last name from a content also writes that it is gone, so the next compaction drops the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import stored
from chronofact.sources.ingest import MAX_FILE_BYTES
from chronofact.sources.log import GONE, VERSION, Conflict, Log

FILES = {
    "sources": ("id string, url string, retrieved_at timestamp_ntz, activity string, agent string, raw string", ["id"]),
    "names": ("source_id string, filename string, mime string, size_bytes long, sha256 string, created_at timestamp_ntz", ["source_id"]),
    "blobs": ("sha256 string, data binary", ["sha256"]),
    "reports": ("batch string, ord long, outcome string, detail string, source_id string", ["batch", "ord"]),
}
META = ["source_id", "filename", "mime", "size_bytes", "sha256", "created_at"]


@dataclass(frozen=True)
class FileLog(Log):
    """A log whose contents are found by their heads (hash and version), so that no aggregate carries them."""

    tables: dict = field(default_factory=lambda: FILES)

    def rows(self, table: str, version: int | None = None) -> DataFrame:
        if table != "blobs":
            return super().rows(table, version)
        return self.blobs(self.records("blobs", version))

    @staticmethod
    def blobs(records: DataFrame) -> DataFrame:
        """Live contents of some records: sha256, data."""
        return records.join(FileLog.heads(records), ["sha256", VERSION], "left_semi").select("sha256", "data")

    @staticmethod
    def heads(records: DataFrame) -> DataFrame:
        """sha256 and version of live contents; reads no bytes."""
        last = records.groupBy("sha256").agg(F.max_by(GONE, VERSION).alias(GONE), F.max(VERSION).alias(VERSION))
        return last.where(~F.col(GONE)).select("sha256", VERSION)


def open_files(spark: SparkSession, path: str) -> FileLog:
    return FileLog(spark, path)


def _problem(*rules) -> F.Column:
    """The first rule (condition, text) that applies, else null."""
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def _committed(log: FileLog, batch: str, decide, tries: int) -> DataFrame:
    """Append what decide(version) gives, again after a conflict; the report of the batch. A batch that is known gives its first report."""
    for _ in range(tries):
        version = log.version()
        if not log.known(batch):
            try:
                log.append(batch, decide(version), version)
            except Conflict:
                continue
        return log.rows("reports").where(F.col("batch") == batch).drop("batch")
    raise Conflict(f"batch {batch} lost {tries} times")


def ingest(log: FileLog, docs: DataFrame, at: str, batch: str, tries: int = 5) -> DataFrame:
    """Append source documents (ord, raw, url, activity, agent, retrieved_at): a report with ord, outcome (insert or reject), detail and source_id.

    ord is unique in a batch, and the id is made from both. raw must be a JSON object; without activity or agent a document is rejected;
    without a time it has that of the commit. Documents with equal contents are sources of their own. An empty batch is a batch."""

    def decide(version: int) -> dict[str, DataFrame]:
        own = F.concat(F.lit("src:"), F.sha1(F.concat_ws("|", F.lit(batch), F.col("ord").cast("string"))))
        problem = _problem((F.col("raw").isNull(), "no document"), (F.json_object_keys("raw").isNull(), "not a JSON object"), (F.col("activity").isNull(), "no activity"), (F.col("agent").isNull(), "no agent"))
        judged = docs.withColumn("detail", problem)
        good = F.col("detail").isNull()
        when = F.coalesce(F.col("retrieved_at").cast("timestamp_ntz"), F.lit(at).cast("timestamp_ntz"))
        rows = judged.where(good).select(own.alias("id"), "url", when.alias("retrieved_at"), "activity", "agent", "raw")
        report = judged.select(F.lit(batch).alias("batch"), F.col("ord").cast("long").alias("ord"), F.when(good, "insert").otherwise("reject").alias("outcome"), "detail", F.when(good, own).alias("source_id"))
        return {"sources": rows, "reports": report}

    return _committed(log, batch, decide, tries)


def attach(log: FileLog, files: DataFrame, at: str, batch: str, most: int = MAX_FILE_BYTES, tries: int = 5) -> DataFrame:
    """Store the original files of sources (ord, source_id, filename, mime, content): a report with ord, outcome, detail and source_id.

    ord is unique in a batch. Outcomes: insert, replace (the source had another file), same (it had this content; name and type are taken over),
    passed (a later file of the batch holds) or reject: an empty file, one larger than `most`, an unknown source. A source keeps the time of
    its first file. Contents that are there already, or several times in the batch, are written once."""

    def decide(version: int) -> dict[str, DataFrame]:
        spark = log.spark
        known = log.rows("sources", version).select(F.col("id").alias("source_id"), F.lit(True).alias("known"))
        light = files.select(F.col("ord").cast("long").alias("ord"), "source_id", "filename", "mime", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
        problem = _problem((F.col("size_bytes") == 0, "empty file"), (F.col("size_bytes") > most, "too large"), (F.col("known").isNull(), "unknown source"))
        judged = stored(spark, light.join(known, "source_id", "left").withColumn("detail", problem).drop("known"), "files")
        good = judged.where("detail IS NULL")
        last = good.groupBy("source_id").agg(F.max("ord").alias("ord"))
        old = log.rows("names", version).join(last.select("source_id"), "source_id", "left_semi")
        old = stored(spark, old.select("source_id", F.col("sha256").alias("was"), "created_at"), "files-old")
        now = good.join(last, ["source_id", "ord"]).join(old, "source_id", "left").withColumn("created_at", F.coalesce("created_at", F.lit(at).cast("timestamp_ntz")))
        now = stored(spark, now, "files-now")
        heads = FileLog.heads(log.records("blobs", version))
        fresh = now.groupBy("sha256").agg(F.min("ord").alias("ord")).join(heads, "sha256", "left_anti")
        put = files.withColumn("ord", F.col("ord").cast("long")).join(fresh, "ord").select("sha256", F.col("content").alias("data"), F.lit(False).alias(GONE))
        kept = log.rows("names", version).join(now.select("source_id"), "source_id", "left_anti").select("sha256").unionByName(now.select("sha256"))
        dead = old.select(F.col("was").alias("sha256")).distinct().join(kept, "sha256", "left_anti")
        dead = dead.select("sha256", F.lit(None).cast("binary").alias("data"), F.lit(True).alias(GONE))
        outcome = F.when(F.col("detail").isNotNull(), "reject").when(F.col("held").isNull(), "passed").when(F.col("was").isNull(), "insert")
        outcome = outcome.when(F.col("was") == F.col("sha256"), "same").otherwise("replace")
        report = judged.join(now.select("ord", "was", F.lit(True).alias("held")), "ord", "left")
        report = report.select(F.lit(batch).alias("batch"), "ord", outcome.alias("outcome"), "detail", "source_id")
        return {"names": now.select(*META), "blobs": put.unionByName(dead), "reports": report}

    return _committed(log, batch, decide, tries)


def meta(log: FileLog) -> DataFrame:
    """What is known of the file of each source, without its bytes. A filter on source_id reaches the files of the log."""
    return log.rows("names").select(*META)


def fetch(log: FileLog, ids: list[str]) -> DataFrame:
    """Files with their bytes for the sources named; a source without a file is an error. The hashes asked for are pushed into the scan."""
    found = meta(log).where(F.col("source_id").isin(ids))
    rows = found.select("source_id", "sha256").collect()  # a row for each id
    if lost := set(ids) - {r["source_id"] for r in rows}:
        raise ValueError(f"no file for source {', '.join(sorted(lost))}")
    records = log.records("blobs").where(F.col("sha256").isin(sorted({r["sha256"] for r in rows})))
    return found.join(FileLog.blobs(records), "sha256").select(*META, "data")


def held(log: FileLog) -> DataFrame:
    """Live contents with their references: sha256, refs, size_bytes."""
    return log.rows("names").groupBy("sha256").agg(F.count("*").alias("refs"), F.first("size_bytes").alias("size_bytes"))
