"""A corpus pipeline of five stages: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's
docs. All stages but the last return the columns of docs, whatever other columns there are and whatever their names.

Rows that repeat are rows of their own to every stage but the second. Texts are read whole, however long. An empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm import decontam, packing, quality, queries, secrets, simhash
from chronofact.llm.text import apart
from chronofact.session import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep. Null, empty and blank texts fail the base rules, so they go. Rows that are
    equal are judged alike. Without labels the base rules alone decide."""
    labels = queries.table(spark, sf_dir, "labels")
    own, back = apart(docs, "doc_id", "text")
    return back(quality.judge(own, labels).where("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id (null ids last), of equal ids the least hash of the text; rows equal in
    both are one. Null and empty texts have fingerprint zero, so they are one group."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contaminated ones. These are few, and taken out by an anti join on doc_id and text. Null, empty and wordless texts
    are never contaminated and stay; rows that repeat go or stay together. Without benchmark items all stay."""
    docs, back = apart(docs, "doc_id", "text")
    found = decontam.contamination(docs, queries.table(spark, sf_dir, "benchmark"))
    bad = stored(spark, found.where("contaminated").select(F.col("doc_id").alias("d"), F.col("hash").alias("h")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.xxhash64("text").eqNullSafe(F.col("h"))
    return back(docs.join(decontam.small(bad), same, "left_anti"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars, where there is one, counts the new text.
    Null texts stay null and empty ones empty; rows that repeat are redacted alike."""
    own, back = apart(docs, *[c for c in docs.columns if c in ("text", "n_chars")])
    found = secrets.scan(own, redact=True).withColumn("text", F.col("redacted"))
    if "n_chars" in own.columns:
        found = found.withColumn("n_chars", F.length("text").cast(dict(own.dtypes)["n_chars"]))
    return back(found)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null and empty texts are one piece, the end id; rows that repeat, and rows
    without a doc_id, are documents of their own; a text of more than a sequence is cut."""
    return packing.pack(docs, queries.vocabulary(), with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL states neither the learned list, the fingerprints, nor the packing; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
