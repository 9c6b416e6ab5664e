"""Results as CSV, JSON, reports, and stores on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a result, in order.
RESULT = ["url", "name", "reason", "source_page", "relevance", "verdict", "source", "period", "year", "published", "series", "latest_in_series"]
_POINTER = "CURRENT"


def write_csv(docs: DataFrame, folder: str) -> None:
    """One line per document and a header, also where there is none; null is the empty string."""
    docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RESULT]).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def as_json(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct(*[c for c in RESULT if c in docs.columns])).alias("json"))


def write_report(rows: DataFrame, folder: str, label: str) -> str:
    """A report of one run as JSON lines in a folder of its own, never over another; its path."""
    path = f"{folder.rstrip('/')}/{label}"
    rows.write.mode("errorifexists").json(path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _version(spark: SparkSession, folder: str) -> str | None:
    fs, pointer = _fs(spark, f"{folder.rstrip('/')}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_store(df: DataFrame, folder: str) -> None:
    """Replace a store by ``df``, which may be derived from it.

    The rows go into a new version's folder; then a pointer file is renamed over the old one in a single step, so a reader,
    or a run after a crash, finds the old rows or the new ones, whole.  The version before stays for readers that hold it,
    older ones are removed.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = folder.rstrip("/")
    before, version = _version(spark, folder), uuid.uuid4().hex
    df.write.parquet(f"{folder}/{version}")
    fs, fresh = _fs(spark, f"{folder}/{_POINTER}.{version}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{folder}/{_POINTER}"), options)
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)):
        name = status.getPath().getName()
        if status.isDirectory() and name not in (version, before):
            fs.delete(status.getPath(), True)


def read_store(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """The rows of a store; none (of ``schema``) where it was never written."""
    version = _version(spark, folder)
    if version is None:
        if schema is None:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{folder.rstrip('/')}/{version}")


def save_program(programs: DataFrame, snapshots: DataFrame, results: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stores after saving programs: the old code's snapshot and results go with it."""
    keys = new.select("program_key").distinct()
    without = lambda df: df.join(keys, "program_key", "left_anti")
    return without(programs).unionByName(new), without(snapshots), without(results)
