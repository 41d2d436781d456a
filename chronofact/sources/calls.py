"""Results too long to show, and a log of calls, both as tables of a log.

A long result stays in the store; what is shown of it is a digest of bounded size: its shape, a sample of its entries, and a reference.
Calls are logged with their arguments cut; a quantile sketch of durations for each tool, day and batch is written beside them, so
that quantiles over any span merge sketches and read no calls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.session import new_folder
from chronofact.sources.log import GONE, VERSION, Log

MOST_CHARS = 8000
MOST_ARGUMENTS = 2048
SAMPLE = 10
KEYS = 20
ENTRY = 600

CALLS = {
    "results": ("session string, id string, call_id string, content string, summary string", ["session", "id"]),
    "calls": ("id string, tool string, args string, called_at timestamp_ntz, duration_ms long, status string, error string, result_bytes long, token_hash string", ["id"]),
    "sketches": ("tool string, day date, part string, n long, sketch binary", ["tool", "day", "part"]),
}


@dataclass(frozen=True)
class CallLog(Log):
    """Ids of results are made from their batch, which is added once, so records of results are rows, and nothing has to carry contents."""

    tables: dict = field(default_factory=lambda: CALLS)

    def rows(self, table: str, version: int | None = None) -> DataFrame:
        return self.records(table, version).where(~F.col(GONE)).drop(VERSION, GONE) if table == "results" else super().rows(table, version)


def open_calls(spark: SparkSession, path: str) -> CallLog:
    return CallLog(spark, path)


def _array(v: Column) -> Column:
    """The entries of a JSON array, null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _quoted(text: Column) -> Column:
    inside = F.to_json(F.array(text))
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def _short(json: Column) -> Column:
    """An entry as JSON; a long one as a string of its first characters."""
    return F.when(F.length(json) <= ENTRY, json).otherwise(_quoted(F.concat(F.substr(json, F.lit(1), F.lit(ENTRY // 2)), F.lit("…"))))


def _shape(v: Column) -> Column:
    """What a value of an object is, in a word."""
    named = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1))
    size = F.size(F.json_object_keys(F.to_json(v))).cast("string")
    return F.when(_array(v).isNotNull(), F.concat(F.lit("list["), F.size(_array(v)).cast("string"), F.lit("]"))).when(named == "object", F.concat(F.lit("object["), size, F.lit(" keys]"))).otherwise(named)


def _listed(keys: Column, each: Column) -> Column:
    more = F.size(keys) - KEYS
    return F.concat(F.array_join(F.slice(each, 1, KEYS), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def _chosen(items: Column, seed: Column | None) -> Column:
    """The first entries; or, with a seed, those whose hashed positions are least, in their order: a uniform sample that repeats."""
    if seed is None:
        return F.slice(items, 1, SAMPLE)
    places = F.transform(F.sequence(F.lit(1), F.size(items)), lambda i: F.struct(F.xxhash64(seed, i).alias("h"), i.alias("i")))
    least = F.array_sort(F.transform(F.slice(F.array_sort(places), 1, SAMPLE), lambda p: p["i"]))
    return F.when(F.size(items) <= SAMPLE, items).otherwise(F.transform(least, lambda i: F.element_at(items, i)))


def digests(results: DataFrame, seed: str | None = None) -> DataFrame:
    """results with summary and sample (JSON) of their content (JSON): for a list the number of entries, the keys of the first, and ten
    entries; for an object its keys with the shape of each, lists in it cut to ten entries; anything that can't be read as JSON, or not
    held as a variant, is a text. Twenty keys at most are shown, and an entry of more than 600 characters by its first 300; so a digest
    is bounded, whatever the result. seed: a column; lists are sampled uniformly by it instead of from their start."""
    rows = results.withColumn("_v", F.try_parse_json("content"))
    v, chosen = F.col("_v"), (F.col(seed) if seed else None)
    rows = rows.withColumn("_items", _array(v))
    items = F.col("_items")
    rows = rows.withColumn("_map", F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")))
    rows = rows.withColumn("_pairs", F.array_sort(F.map_keys("_map")))
    keys, at = F.col("_pairs"), lambda k: F.element_at(F.col("_map"), k)
    first = F.array_sort(F.json_object_keys(F.to_json(F.get(items, 0))))
    of = F.when(F.size(first) > 0, F.concat(F.lit(", objects with keys "), _listed(first, first))).otherwise("")
    listed = F.concat(F.lit("list of "), F.size(items).cast("string"), F.lit(" entries"), of)
    held = F.concat(F.lit("object with "), _listed(keys, F.transform(F.slice(keys, 1, KEYS), lambda k: F.concat(k, F.lit(": "), _shape(at(k))))))
    text = F.concat(F.lit("text of "), F.length("content").cast("string"), F.lit(" characters"))
    plain = F.concat(F.lower(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)), F.lit(" value"))
    summary = F.when(v.isNull(), text).when(items.isNotNull(), listed).when(keys.isNotNull(), held).otherwise(plain)
    entries = lambda xs: F.concat(F.lit("["), F.array_join(F.transform(_chosen(xs, chosen), lambda x: _short(F.to_json(x))), ","), F.lit("]"))
    part = lambda k: F.concat(_quoted(k), F.lit(":"), F.when(_array(at(k)).isNotNull(), entries(_array(at(k)))).otherwise(_short(F.to_json(at(k)))))
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.slice(keys, 1, KEYS), part), ","), F.lit("}"))
    sample = F.when(v.isNull(), _short(_quoted(F.col("content")))).when(items.isNotNull(), entries(items)).when(keys.isNotNull(), shown).otherwise(_short(F.to_json(v)))
    return rows.withColumn("summary", summary).withColumn("sample", sample).drop("_v", "_items", "_map", "_pairs")


def offload(log: CallLog, results: DataFrame, batch: str, most: int = MOST_CHARS, uniform: bool = False) -> DataFrame:
    """Keep the results (session, call_id, content) that are longer than `most` characters. Of each result: session, call_id, offloaded,
    content (null where offloaded), ref, summary, sample (all null where not). call_id is unique in a session of a batch. A null or
    empty result is not offloaded. A batch that is known adds nothing."""
    own = F.sha1(F.concat_ws("|", F.lit(batch), "session", "call_id"))
    rows = results.select("session", "call_id", "content", own.alias("id"))
    long = F.coalesce(F.length("content") > most, F.lit(False))
    told = digests(rows.where(long), "id" if uniform else None)
    log.append(batch, {"results": told}, log.version())
    null = F.lit(None).cast("string")
    short = rows.where(~long).select("session", "call_id", F.lit(False).alias("offloaded"), "content", null.alias("ref"), null.alias("summary"), null.alias("sample"))
    return short.unionByName(told.select("session", "call_id", F.lit(True).alias("offloaded"), null.alias("content"), F.concat(F.lit("ref:"), "id").alias("ref"), "summary", "sample"))


def resolved(log: CallLog, session: str, refs: list[str]) -> DataFrame:
    """ref, content of results of one session; a reference that is unknown, or of another session, is an error. Filters reach the scan."""
    ids = [r.removeprefix("ref:") for r in refs]
    found = log.rows("results").where((F.col("session") == session) & F.col("id").isin(ids)).select(F.concat(F.lit("ref:"), "id").alias("ref"), "content")
    there = {r["ref"].removeprefix("ref:") for r in found.select("ref").collect()}  # a row for each reference asked for
    if lost := set(ids) - there:
        raise ValueError(f"unknown reference {', '.join(sorted(lost))}")
    return found


def offload_rows(df: DataFrame, folder: str | None = None, most: int = MOST_CHARS) -> dict:
    """A query's result: its rows if their JSON has at most `most` characters, else stored as Parquet with a digest (ref, rows, columns,
    and ten rows with the least hashes, so each row has an equal chance). Nothing but the digest reaches the driver."""
    spark = df.sparkSession
    path = folder or new_folder(spark, "result")
    df.write.parquet(path)
    there = spark.read.schema(df.schema).parquet(path)
    json = F.to_json(F.struct("*"))
    n, chars = there.select(json.alias("j")).agg(F.count("*"), F.coalesce(F.sum(F.length("j") + 1), F.lit(0)) + 1).first()
    if chars <= most:
        return {"offloaded": False, "rows": n, "content": [r["j"] for r in there.select(json.alias("j")).collect()]}
    picked = there.select(json.alias("j")).orderBy(F.xxhash64("j"), "j").limit(SAMPLE).select(_short(F.col("j")).alias("j"))
    return {"offloaded": True, "ref": path, "rows": n, "columns": dict(df.dtypes), "sample": [r["j"] for r in picked.collect()]}


def cut_arguments(args: Column, most: int = MOST_ARGUMENTS) -> Column:
    """Arguments (JSON) as they are logged: of long ones the names alone."""
    names = F.transform(F.coalesce(F.json_object_keys(args), F.array().cast("array<string>")), lambda k: F.concat(F.lit(","), _quoted(k), F.lit(':"…"')))
    return F.when(F.length(args) > most, F.concat(F.lit('{"_truncated":true'), F.array_join(names, ""), F.lit("}"))).otherwise(args)


def log_calls(log: CallLog, calls: DataFrame, batch: str) -> int:
    """Append calls (id, tool, args, called_at, duration_ms, error, result, token): the version. Of the token a part of its hash is kept, of the
    result its size; a call with an error has status error. A batch that is known adds nothing; a call without a duration is in no sketch."""
    error = F.col("error").isNotNull()
    rows = calls.select(
        "id", "tool", cut_arguments(F.col("args")).alias("args"), F.col("called_at").cast("timestamp_ntz").alias("called_at"), F.col("duration_ms").cast("long").alias("duration_ms"),
        F.when(error, "error").otherwise("ok").alias("status"), "error", F.octet_length("result").cast("long").alias("result_bytes"), F.substr(F.sha2("token", 256), F.lit(1), F.lit(12)).alias("token_hash"),
    )
    timed = rows.where("duration_ms IS NOT NULL AND called_at IS NOT NULL").groupBy("tool", F.to_date("called_at").alias("day"))
    sketches = timed.agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("duration_ms").alias("sketch")).withColumn("part", F.lit(batch))
    return log.append(batch, {"calls": rows, "sketches": sketches}, log.version())


def telemetry(log: CallLog) -> DataFrame:
    """Calls by tool: calls, errors, cut (arguments), avg_ms, bytes."""
    rows = log.rows("calls").groupBy("tool")
    return rows.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("args").startswith('{"_truncated":true')).alias("cut"), F.avg("duration_ms").alias("avg_ms"), F.sum("result_bytes").alias("bytes"))


def quantiles(log: CallLog, shares: list[float], since: str | None = None, until: str | None = None) -> DataFrame:
    """tool, n, q (an array, one for each share) of the durations of calls on the days from since up to, and without, until. The sketches
    are merged; a quantile's rank is off by about 1.5 % of n at most."""
    rows = log.rows("sketches")
    if since is not None:
        rows = rows.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(F.col("day") < F.lit(until).cast("date"))
    merged = rows.groupBy("tool").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("s"))
    return merged.select("tool", "n", F.array(*[F.kll_sketch_get_quantile_bigint("s", F.lit(x)) for x in shares]).alias("q"))
