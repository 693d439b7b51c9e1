"""S1 (recursive source listing), S2 (glob match), S5 (sheet listing for CSV)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.store import Store

# Readable source extensions (case-insensitive) and the lock-file prefix.
SOURCE_EXT_RE = "(?i)\\.(xlsx|xls|csv)$"
WORKBOOK_EXT_RE = "(?i)\\.(xlsx|xls)$"
LOCK_PREFIX = "~$"

FILES_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("rel_path", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("ext", T.StringType()),
    T.StructField("length", T.LongType()), T.StructField("modification_time", T.TimestampType()),
])


def to_uri(path: str) -> str:
    """A path as the URI that Spark reports in ``_metadata``; without a scheme it lies on the default file system, as for Spark."""
    return Store(SparkSession.active()).qualified(path).rstrip("/")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every source file below ``root`` (metadata only; file contents are not read)."""
    if not Store(spark).exists(root):
        return spark.createDataFrame([], FILES_SCHEMA)
    prefix = to_uri(root) + "/"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "length", F.col("modificationTime").alias("modification_time")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return (df.withColumn("name", name)
              .filter(F.col("name").rlike(SOURCE_EXT_RE) & ~F.col("name").startswith(LOCK_PREFIX))
              .withColumn("rel_path", F.when(F.col("path").startswith(prefix),
                                             F.expr(f"substring(path, {len(prefix) + 1})"))
                          .otherwise(F.col("path")))
              .withColumn("ext", F.lower(F.regexp_extract("name", "\\.([^.]*)$", 1)))
              .select(*[f.name for f in FILES_SCHEMA.fields]))


def files_from_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The listing schema for known files (e.g. one stream micro-batch), without
    listing the folder again."""
    prefix = to_uri(root) + "/"
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return (df.withColumn("name", name)
              .filter(F.col("name").rlike(SOURCE_EXT_RE) & ~F.col("name").startswith(LOCK_PREFIX))
              .withColumn("rel_path", F.when(F.col("path").startswith(prefix),
                                             F.expr(f"substring(path, {len(prefix) + 1})"))
                          .otherwise(F.col("path")))
              .withColumn("ext", F.lower(F.regexp_extract("name", "\\.([^.]*)$", 1)))
              .withColumn("length", F.lit(None).cast("long"))
              .withColumn("modification_time", F.lit(None).cast("timestamp"))
              .select(*[f.name for f in FILES_SCHEMA.fields]))


def source_hit(regex: Column, path: Column, rel_path: Column) -> Column:
    """Whether a source's regex matches a file by its relative or absolute path."""
    return F.regexp_like(rel_path, regex) | F.regexp_like(F.regexp_replace(path, "^file:", ""), regex) | F.regexp_like(path, regex)


def relative_to(root: str) -> Callable[[Column], Column]:
    """A path's part below ``root``."""
    prefix = to_uri(root) + "/"
    return lambda p: F.when(p.startswith(prefix), F.substr(p, F.lit(len(prefix) + 1))).otherwise(p)


def match_files(files: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Files x rule sources where the source regex matches the relative or the
    absolute path. ``rule_sources`` comes from the rule YAML (bounded by the rule
    count), so it is broadcast and the theta join never shuffles the file list."""
    rs = F.broadcast(rule_sources)
    return files.join(rs, source_hit(rs["regex"], files["path"], files["rel_path"]), "inner")


def csv_sheets(files: DataFrame) -> DataFrame:
    """S5 for CSV: every CSV file is one sheet named ``csv`` at position 0."""
    return (files.filter(F.col("ext") == "csv")
                 .select(F.col("path").alias("source_file"), F.lit("csv").alias("sheet_name"),
                         F.lit(0).alias("sheet_pos")))
