"""Incremental clean with Structured Streaming.

The reference picks up new source files by re-running the clean. Here a file
stream over the source folder (``binaryFile``, metadata only -- the content
column is never selected) tracks which files were already seen in its
checkpoint (in the shared folder), and each micro-batch runs the same clean
over just its new files and appends to the big table (M2). With
``trigger(availableNow=True)`` a run processes everything new and stops, so it
can be scheduled like the reference's rebuild; with a processing-time trigger
it keeps watching the folder. The stream's checkpoint commits a batch after ``foreachBatch``
returned, so a batch may run again: its rows and its number become part of the table by one commit, so a
batch that is in the table appends nothing, and one that failed before its commit left nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, CleanPipeline, Rule
from ledgerloom.operators.clean import clean
from ledgerloom.plans.workspace import RunSummary, Workspace, bt_namespace
from ledgerloom.sources.files import LOCK_PREFIX, SOURCE_EXT_RE


def incremental_clean(ws: Workspace, pipeline: CleanPipeline, rules: list[Rule], cfg: BigTableConfig,
                      checkpoint: str | None = None, max_files_per_trigger: int = 1000,
                      available_now: bool = True, processing_time: str | None = None,
                      extracted_at: str | None = None) -> list[RunSummary]:
    spark = ws.spark
    ckpt = checkpoint or os.path.join(ws.root, "streams", pipeline.id)
    stream = (spark.readStream.format("binaryFile")
              .schema("path string, modificationTime timestamp, length long, content binary")
              .option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", str(max_files_per_trigger))
              .load(pipeline.source_dir)
              .select("path"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stream = stream.filter(name.rlike(SOURCE_EXT_RE) & ~name.startswith(LOCK_PREFIX))
    runs: list[RunSummary] = []

    def batch(df, epoch_id):
        paths = [r["path"] for r in df.collect()]      # this batch's file names (<= max_files_per_trigger)
        if not paths:
            return
        # the query's id stays with its checkpoint
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ckpt
        if ws.appended(bt_namespace(cfg.folder), cfg.table_name, (query, epoch_id)):
            return
        res = clean(ws, pipeline, rules, cfg, extracted_at=extracted_at, paths=paths, mode="append", batch=(query, epoch_id))
        runs.append(res.summary)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return runs
