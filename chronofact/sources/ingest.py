"""Readers and parsers that turn files and pages into candidate rows. A broken row or file is reported, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_FILE_BYTES = 5 * 1024 * 1024
HANDLE = r"^[a-z0-9._]{1,30}$"

#: Shape of a scraper's list of accounts.
SCRAPED = (
    "metadata struct<kind: string, handle: string, user_id: string, status: string, captured_at: string, expected_total: bigint>, "
    "users array<struct<username: string, pk: string, pk_id: string, id: string, full_name: string, is_verified: boolean, is_private: boolean>>"
)
#: Shape of a profile document.
PROFILE = (
    "kind string, name string, email string, aliases array<string>, knows array<struct<name: string, since: string>>, "
    "accounts array<struct<platform: string, handle: string, uri: string, follows array<string>>>"
).replace("follows array<string>", "follows: array<string>")
#: What each field of a profile becomes: predicate and confidence.
FIELDS = {"name": ("name", 0.95), "email": ("email", 0.95), "aliases": ("alias", 0.9), "knows": ("knows", 0.85), "accounts": ("owns_account", 0.9)}


def handle(text: Column) -> Column:
    """Trimmed, one leading run of @ taken off, lower case; null where that is no valid handle."""
    clean = F.lower(F.regexp_replace(F.trim(text), r"^@+", ""))
    return F.when(clean.rlike(HANDLE), clean)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the first in input order; rows without a key all stay."""
    w = Window.partitionBy(key, F.when(F.col(key).isNull(), F.col(order))).orderBy(order)  # rows without a key stand alone
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def follower_rows(pasted: DataFrame, known: DataFrame) -> DataFrame:
    """pasted (pos, username) as pos, username, status: invalid, duplicate, confirmed (in known) or new_entity."""
    rows = pasted.select("pos", handle(F.col("username")).alias("username"))
    rows = rows.withColumn("_key", F.coalesce("username", F.concat(F.lit("\0"), F.col("pos").cast("string"))))  # invalid rows aren't one group
    n = F.row_number().over(Window.partitionBy("_key").orderBy("pos"))
    rows = rows.withColumn("_n", n).join(known.select(F.col("username").alias("_key"), F.lit(True).alias("_known")), "_key", "left")
    status = F.when(F.col("username").isNull(), "invalid").when(F.col("_n") > 1, "duplicate").when(F.col("_known"), "confirmed").otherwise("new_entity")
    return rows.select("pos", "username", status.alias("status"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows by status, as an importer reports them."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def scraped_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a scraper, one JSON document each: file, data (null where broken), error."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    data = F.from_json("value", SCRAPED)
    rows = raw.select("file", data.alias("data"))
    broken = F.col("data.metadata").isNull()
    return rows.select("file", F.when(~broken, F.col("data")).alias("data"), F.when(broken, "not a scraped list").alias("error"))


def scraped_users(files: DataFrame) -> DataFrame:
    """The accounts of scraped files: file, owner, kind, username, pk, full_name, status (invalid, owner or ok); the first of each name
    in a file counts."""
    rows = files.where("error IS NULL").select("file", F.col("data.metadata").alias("m"), F.posexplode_outer("data.users").alias("pos", "u")).where("u IS NOT NULL")
    rows = rows.select("file", "pos", handle(F.col("m.handle")).alias("owner"), F.col("m.kind").alias("kind"), handle(F.col("u.username")).alias("username"), F.coalesce("u.pk", "u.pk_id", "u.id").alias("pk"), F.col("u.full_name").alias("full_name"))
    n = F.row_number().over(Window.partitionBy("file", "username").orderBy("pos"))
    status = F.when(F.col("username").isNull(), "invalid").when(F.col("username") == F.col("owner"), "owner").when(F.col("_n") > 1, "duplicate").otherwise("ok")
    return rows.withColumn("_n", n).withColumn("status", status).drop("_n")


def batch_totals(files: DataFrame) -> DataFrame:
    """One row over a batch of files: files, failed, and accounts in those that could be read."""
    return files.agg(
        F.count("*").cast("long").alias("files"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("data.users"))), F.lit(0)).cast("long").alias("accounts"),
    )


def extract_profile(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, raw JSON) as candidates (doc_id, predicate, value, confidence), and unknown fields as proposals (doc_id, field)."""
    parsed = docs.select("doc_id", "raw", F.from_json("raw", PROFILE).alias("p"))
    entry = lambda name, value: F.struct(F.lit(FIELDS[name][0]).alias("predicate"), value.alias("value"), F.lit(FIELDS[name][1]).alias("confidence"))
    none = F.array().cast("array<struct<predicate: string, value: string, confidence: double>>")
    many = lambda name, column: F.coalesce(F.transform(column, lambda x: entry(name, x)), none)
    each = F.concat(
        F.array(entry("name", F.col("p.name")), entry("email", F.col("p.email"))),
        many("aliases", F.col("p.aliases")), many("knows", F.col("p.knows.name")), many("accounts", F.col("p.accounts.handle")),
    )
    candidates = parsed.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.*").where("value IS NOT NULL")
    known = ["kind", *FIELDS]
    fields = docs.select("doc_id", F.explode(F.json_object_keys("raw")).alias("field")).where(~F.col("field").isin(known))
    return candidates, fields


def snapshot_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Snapshot members (ref, id or null, predicate_id, owner) against existing statements: new_entity, new_statement, confirmed or
    invalid. What a snapshot leaves out is no evidence."""
    there = existing.select(F.col("subject_id").alias("owner"), "predicate_id", F.col("object_id").alias("id"), F.lit(True).alias("_there")).distinct()
    out = rows.join(there, ["owner", "predicate_id", "id"], "left")
    status = F.when(F.col("ref").isNull(), "invalid").when(F.col("id").isNull(), "new_entity").when(F.col("_there"), "confirmed").otherwise("new_statement")
    return out.select("ref", "id", status.alias("status"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, link: the href targets of a page, in order of appearance, repeats included."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("link"))


def binary_files(spark: SparkSession, path: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """name, sha256, size and content of files up to a size; larger ones are listed with an error and without content."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    over = F.col("length") > most
    return rows.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"),
        F.when(~over, F.sha2("content", 256)).alias("sha256"), F.when(~over, F.col("content")).alias("content"), F.when(over, "too large").alias("error"),
    )


def model_answers(rows: DataFrame, schema: str, text: str = "answer") -> DataFrame:
    """rows with what a language model answered, parsed: a code fence is taken off, the outermost braces or brackets are read as an array of
    items, and an answer that still can't be read gives an error. Items whose required text fields are all null are malformed."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)^.*?```(?:json)?\s*|```.*$", "")
    inner = F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1)
    whole = F.when(inner.startswith("{"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(inner)
    items = F.from_json(whole, f"array<struct<{schema}>>")
    error = F.when((inner == "") | F.col("items").isNull(), "no JSON in the answer")
    return rows.withColumn("items", items).withColumn("error", error)


def identities(users: DataFrame, by_pk: DataFrame, by_name: DataFrame) -> DataFrame:
    """Accounts (username, pk) with the entity that they are: the owner of the pk first, then of the name; backfill marks those known by name
    whose pk is new. by_pk (pk, id), by_name (username, id)."""
    rows = users.join(by_pk.select("pk", F.col("id").alias("_p")), "pk", "left").join(by_name.select("username", F.col("id").alias("_n")), "username", "left")
    backfill = F.col("_p").isNull() & F.col("_n").isNotNull() & F.col("pk").isNotNull()
    return rows.select("username", "pk", F.coalesce("_p", "_n").alias("id"), backfill.alias("backfill"))


def run_pipeline(store, docs: DataFrame, type_id: str, source_id: str, predicates: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles (doc_id, raw) through extraction, resolution and a commit plan: the report (doc_id, predicate, value, outcome, detail),
    the proposals for unknown fields, and the entities resolved or created (of type_id). Only string fields named in predicates are committed. A candidate that fails is a row of the report."""
    from chronofact.model import STATEMENT
    from chronofact.operators import resolve, write

    candidates, proposals = extract_profile(docs)
    candidates = candidates.where(F.col("predicate").isin(predicates))
    wanted = candidates.where("predicate = 'name'").select(F.col("doc_id").alias("ref"), F.lit(type_id).alias("type_id"), F.col("value").alias("label"), F.col("value").alias("key"))
    owners = resolve.get_or_create(store, wanted)
    rows = candidates.join(owners.select(F.col("ref").alias("doc_id"), F.col("id").alias("subject_id")), "doc_id")
    none = {c: F.lit(None).cast(t) for c, t in STATEMENT.items()}
    rows = rows.select(
        F.xxhash64("doc_id", "predicate", "value").alias("ord"), "doc_id", "predicate", "value", "subject_id", F.col("predicate").alias("predicate_id"), F.lit("string").alias("value_type"),
        F.col("value").alias("value_text"), F.lit("normal").alias("rank"), "confidence", none["object_id"].alias("object_id"), none["value_number"].alias("value_number"),
        none["value_unit"].alias("value_unit"), none["value_datetime"].alias("value_datetime"), none["valid_from"].alias("valid_from"), none["valid_to"].alias("valid_to"), F.lit(source_id).alias("source_id"),
    )
    report = rows.select("ord", "doc_id", "predicate", "value").join(write.plan_commit(store, rows.drop("doc_id", "predicate", "value")), "ord").drop("ord")
    return report, proposals, owners
