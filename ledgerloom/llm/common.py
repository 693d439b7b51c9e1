"""Helpers shared by the operators: table reading, staging in the shared folder, small expressions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import checkpoint_root, configure

#: Words: runs of anything but ASCII white space (fixed by the contracts of the queries).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: those of the library, and small Arrow batches, as texts may be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "33554432")
    # Python workers import the operators by name: from an installed package, or from here
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (here, env.get("PYTHONPATH", ""))))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir`` and read back: later plans
    start from these files, which every executor can read, whatever executor is lost."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Removes the files of a table of ``staged`` once everything made from it is staged itself."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` (a staged table) with a broadcast hint if it has at most ``max_rows`` rows; a
    larger one keeps its shuffle join, in which AQE splits hot keys."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (an array of one element, mapped)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def crc32_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that extra columns of the
    caller, whatever they are called, cannot clash."""
    return df.select(*(df[f"`{source}`"].alias(own) for own, source in columns.items()))
