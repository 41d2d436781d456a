"""A store that is written: an append-only log of Parquet folders, with a manifest for each version.

    path/data/<table>/<random>/   rows of one commit, never changed
    path/manifests/<version>.json {"base", "batches", "folders": {table: [...]}}

A manifest is written aside and renamed to its version, which fails if that version is there; so of two writers on one version one is told
to retry, and a reader sees a commit whole or not at all. A manifest that is a base lists all that holds; others list what they add.
The rename must be atomic, as it is on HDFS and local disks; on an object store without that, one writer at a time.

A row's change is another record: rows carry the version that wrote them, and the last record of a key holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.model import STATEMENT, Store

#: Schemas and keys of the tables of a store. A record with `gone` set takes the row of its key out.
TABLES = {
    "entities": ("id string, type_id string, label string, merged_into string, created_at timestamp_ntz", ["id"]),
    "statements": (", ".join(f"{c} {t}" for c, t in STATEMENT.items()), ["id"]),
    "qualifiers": ("statement_id string, predicate_id string, value_number double, value_unit string", ["statement_id", "predicate_id", "value_number", "value_unit"]),
    "references": ("statement_id string, source_id string", ["statement_id", "source_id"]),
    "sources": ("id string, activity string, retrieved_at timestamp_ntz", ["id"]),
    "reports": ("batch string, ord long, outcome string, detail string, statement_id string", ["batch", "ord"]),
}
VERSION = "_version"
GONE = "_gone"


class Conflict(RuntimeError):
    """Another writer took the version; read again and retry."""


@dataclass(frozen=True)
class Log:
    """tables: the schema and the key columns of each; and, where the last version doesn't hold but the greatest of some columns, these."""

    spark: SparkSession
    path: str
    tables: Mapping[str, tuple] = field(default_factory=lambda: TABLES)

    def _jvm(self):
        return self.spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._jvm().Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that are there, in order."""
        files, folder = self._files(), self._path("manifests")
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]  # a name for each commit since the last vacuum
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def _since_base(self, version: int | None = None) -> Iterator[dict]:
        """The manifests that make up a version: from it back to the last base."""
        for v in reversed([v for v in self.versions() if version is None or v <= version]):
            found = self._manifest(v)
            yield found
            if found["base"]:
                return

    def known(self, batch: str) -> bool:
        return any(batch in m["batches"] for m in self._since_base())

    def _put(self, version: int, manifest: dict) -> None:
        jvm = self._jvm()
        aside = self._path("manifests", f".{uuid.uuid4().hex}")
        self._files().mkdirs(self._path("manifests"))
        out = self._files().create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        options = self.spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
        options[0] = getattr(jvm, "Options$Rename").NONE
        context = jvm.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path("manifests", f"{version:012d}.json"), options)
        except Py4JJavaError as e:
            self._files().delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} is taken") from None
            raise

    def _write(self, tables: dict[str, DataFrame], version: int) -> dict[str, list[str]]:
        folders = {}
        for name, rows in tables.items():
            schema = self.tables[name][0]
            columns = [c.split()[0] for c in schema.split(", ")]
            gone = F.col(GONE) if GONE in rows.columns else F.lit(False)
            folder = f"data/{name}/{uuid.uuid4().hex}"
            number = F.col(VERSION) if VERSION in rows.columns else F.lit(version).cast("long")
            rows.select(*columns, number.alias(VERSION), gone.alias(GONE)).write.parquet(f"{self.path}/{folder}")
            folders[name] = [folder]
        return folders

    def append(self, batch: str, tables: dict[str, DataFrame], expected: int) -> int:
        """Add records as the version after `expected`, the one they were made from; returns the new version. A batch that is known adds
        nothing. Conflict if another writer was first: the records may be wrong by now, so they have to be made again."""
        if self.known(batch):
            return self.version()
        if self.version() != expected:
            raise Conflict(f"version is {self.version()}, not {expected}")
        manifest = {"base": expected == 0, "batches": [batch], "folders": self._write(tables, expected + 1)}
        self._put(expected + 1, manifest)
        return expected + 1

    def records(self, table: str, version: int | None = None) -> DataFrame:
        """All records of a table at a version, with the version that wrote them."""
        schema = f"{self.tables[table][0]}, {VERSION} long, {GONE} boolean"
        folders = [f for m in self._since_base(version) for f in m["folders"].get(table, [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def rows(self, table: str, version: int | None = None) -> DataFrame:
        """The rows that hold at a version: the last record of each key, unless it is gone. Tasks begin the aggregate before the shuffle."""
        records = self.records(table, version)
        keys, order = self.tables[table][1], [*self.tables[table][2:], [VERSION]][0]
        rest = [c for c in records.columns if c not in keys]
        last = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, VERSION)).alias("r")).select(*keys, "r.*")
        return last.where(~F.col(GONE)).select(*[c for c in records.columns if c not in (VERSION, GONE)])

    def store(self, vocabulary: Store, version: int | None = None) -> Store:
        """The store at a version, with the vocabulary (types, implements, predicates) of another."""
        version = self.version() if version is None else version
        tables = [self.rows(t, version) for t in ("entities", "statements", "qualifiers", "references", "sources")]
        return Store(*tables, vocabulary.types, vocabulary.implements, vocabulary.predicates)

    def compact(self) -> int:
        """Write the rows that hold as a base of their own version, so that readers need one folder for each table."""
        version = self.version()
        batches = sorted({b for m in self._since_base() for b in m["batches"]})
        tables = {t: self.rows(t, version) for t in self.tables}
        self._put(version + 1, {"base": True, "batches": batches, "folders": self._write(tables, version + 1)})
        return version + 1

    def vacuum(self) -> int:
        """Remove the manifests before the last base, and all folders that no manifest names: of older versions, and of writers that lost.
        Readers of older versions and writers at work must have ended. Returns the number of folders removed."""
        files, versions = self._files(), self.versions()
        bases = [v for v in versions if self._manifest(v)["base"]]
        for v in versions:
            if bases and v < bases[-1]:
                files.delete(self._path("manifests", f"{v:012d}.json"), False)
        named = {f for m in self._since_base() for fs in m["folders"].values() for f in fs}
        removed = 0
        for table in self.tables:
            folder = self._path("data", table)
            for s in files.listStatus(folder) if files.exists(folder) else []:
                if f"data/{table}/{s.getPath().getName()}" not in named:
                    removed += files.delete(s.getPath(), True)
        return removed


def commit(log: Log, vocabulary: Store, candidates: DataFrame, at: str, batch: str, qualifiers: DataFrame | None = None, tries: int = 5) -> DataFrame:
    """Commit candidates (see write.plan_commit) as a batch; the report has a row for each: ord, outcome, detail, statement_id. A batch that is
    known adds nothing and gives its first report. After a conflict with another writer everything is decided again."""
    from chronofact.operators import write

    for _ in range(tries):
        version = log.version()
        if not log.known(batch):
            new, report = write.committed(log.store(vocabulary, version), candidates, at, qualifiers)
            try:
                log.append(batch, new | {"reports": report.withColumn("batch", F.lit(batch)).withColumn("ord", F.col("ord").cast("long"))}, version)
            except Conflict:
                continue
        return log.rows("reports").where(F.col("batch") == batch).drop("batch")
    raise Conflict(f"batch {batch} lost {tries} times")


def create_entities(log: Log, vocabulary: Store, wanted: DataFrame, at: str, batch: str) -> DataFrame:
    """Create entities (ord, type_id, label): ord, outcome (insert or reject), detail (the problem, or entities that have the label already) and
    the new id as statement_id. A batch that is known adds nothing."""
    from chronofact.operators import write

    version = log.version()
    if not log.known(batch):
        plan = write.plan_entities(log.store(vocabulary, version), wanted).join(wanted, "ord")
        own = F.concat(F.lit("en:"), F.sha1(F.concat_ws("|", F.lit(batch), F.col("ord").cast("string"))))
        good = F.col("problem").isNull()
        plan = plan.withColumn("id", F.when(good, own))
        fresh = plan.where(good).select("id", "type_id", "label", F.lit(None).cast("string").alias("merged_into"), F.lit(at).cast("timestamp_ntz").alias("created_at"))
        report = plan.select(F.lit(batch).alias("batch"), F.col("ord").cast("long").alias("ord"), F.when(good, "insert").otherwise("reject").alias("outcome"), F.coalesce("problem", "twins").alias("detail"), F.col("id").alias("statement_id"))
        log.append(batch, {"entities": fresh, "reports": report}, version)
    return log.rows("reports").where(F.col("batch") == batch).drop("batch")


def close(log: Log, vocabulary: Store, edits: DataFrame, at: str, batch: str) -> int:
    """Supersede statements (id, and rank and confidence, null to keep): records that close them, and copies with their qualifiers and
    references; see write.supersede_whole."""
    from chronofact.operators import write

    version = log.version()
    store = log.store(vocabulary, version)
    said, quals, refs = write.supersede_whole(store, edits, at)
    touched = edits.select("id").distinct()
    closed = said.where(F.col("system_to") == F.lit(at).cast("timestamp_ntz")).join(touched, "id", "left_semi")
    copies = said.where(F.col("system_from") == F.lit(at).cast("timestamp_ntz")).join(touched.select(F.concat("id", F.lit("@"), F.lit(at)).alias("id")), "id", "left_semi")
    own = copies.select(F.col("id").alias("statement_id"))
    return log.append(batch, {"statements": closed.unionByName(copies), "qualifiers": quals.join(own, "statement_id", "left_semi"), "references": refs.join(own, "statement_id", "left_semi")}, version)
