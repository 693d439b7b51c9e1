"""Session settings shared by every stage, and the shared work folder.

All files the library writes (staged table versions, derived fixtures) go below
``spark.checkpoint.dir``: on a cluster that is the shared folder the cluster
names; a local default is set only when the session has none (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session confs every stage relies on (fixed values, see README "Session").
SESSION_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime confs (idempotent; only SQL confs, safe on a live session)."""
    for k, v in SESSION_CONFS.items():
        if k == "spark.sql.ansi.doubleQuotedIdentifiers":
            continue  # switched on per statement by the SQL stages only
        spark.conf.set(k, v)
    checkpoint_root(spark)
    return spark


def get_session(master: str | None = None, partitions: int = 8) -> SparkSession:
    """Session for tests / local runs. On a cluster, build the session yourself and
    call :func:`configure`."""
    b = SparkSession.builder.appName("ledgerloom")
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.shuffle.partitions", str(partitions))
          .config("spark.driver.memory", "8g")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; set a local one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        # DataFrame.checkpoint() uses the context's folder: point it at the same place
        spark.sparkContext.setCheckpointDir(d)
    if d.startswith("file:"):
        d = d[len("file:"):]
    return d


def work_dir(spark: SparkSession, *parts: str, fresh: bool = False) -> str:
    """A folder below the shared checkpoint root. ``fresh`` adds a unique leaf."""
    p = os.path.join(checkpoint_root(spark), "ledgerloom", *parts)
    if fresh:  # a unique leaf that does not exist yet (writers create folders)
        p = os.path.join(p, uuid.uuid4().hex[:12])
    return p


def clone(spark: SparkSession) -> SparkSession:
    """A session of its own with the settings and temporary views of ``spark``."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
