"""Session settings and the folder that driver and executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("chronofact")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only a local session may go without: it gets a temporary folder. On a cluster an unset folder is an error, since a
    path of one machine can't be read by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="chronofact-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/chronofact/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str) -> DataFrame:
    """Like stored, in buckets of a key: joins on it read them without a shuffle, however often."""
    return in_buckets(spark, df.repartition(shuffle_partitions(spark), key), name, key)


def in_buckets(spark: SparkSession, df: DataFrame, name: str, key: str) -> DataFrame:
    """Like bucketed, of rows that lie by their key already, as after a join or a grouping by it."""
    path = new_folder(spark, name)
    table = "chronofact_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(shuffle_partitions(spark), key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each context; what --py-files does for a submitted job."""
    context = spark.sparkContext
    if getattr(context, "_chronofact_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/chronofact", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._chronofact_shipped = True
