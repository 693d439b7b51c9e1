"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters: the shard of a row is the one with the highest seeded hash of (doc_id, shard)
(rendezvous hashing: with one more shard, a row stays or goes to the new one), and within the shard
a second seeded hash picks one of as many buckets as keep each bucket within ``bucket_bytes``.
The scattered rows are written to the shared folder. Pass 2 gathers each bucket as one array and
applies Spark's ``shuffle``, a Fisher-Yates shuffle; buckets of a shard follow one another.

Arrays are sorted before they are shuffled, buckets are sorted within a fixed number of
partitions, and the seed is given, so a rerun gives the same order. Equal texts do not matter to
the hashes. Defined cases: a null id hashes as the empty text; a null text has size 8 and crc32 0;
rows that agree in every carried column share a bucket; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_up_to, shared_path, staged

BUCKET_BYTES, ROW_BYTES = 16 << 20, 64


def rendezvous(key: Column, n_shards: int, seed: int) -> Column:
    """The shard from 0 to ``n_shards`` - 1 with the highest hash of (seed, key, shard)."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda s: F.struct(
        F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))))["s"]


def shard(docs: DataFrame, carry: list[str], n_shards: int = 24, seed: int = 17, key: str = "doc_id",
          size: str | None = None, bucket_bytes: int = BUCKET_BYTES, with_bucket: bool = False) -> DataFrame:
    """The columns ``carry`` of every row with shard, slot and grown_shard (the shard if there were
    one more). ``size`` names a column of ``carry`` with a row's bytes, which sets the number of
    buckets; without it, rows count ROW_BYTES each. Carry the text itself to write whole shards.
    ``with_bucket`` adds the bucket, which ``write_shards`` needs."""
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    weight = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)) if size else F.lit(ROW_BYTES).cast("long")
    rows = staged(docs.select(row.alias("r"), weight.alias("b"), rendezvous(k, n_shards, seed).cast("int").alias("shard"),
                              rendezvous(k, n_shards + 1, seed).cast("int").alias("grown")), "scattered")
    total = rows.agg(F.sum("b")).first()[0] or 0
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "r"), F.lit(per_shard)).cast("long")
    rows = rows.select(F.struct("r", "grown").alias("x"), "shard", (F.col("shard") * F.lit(per_shard) + bucket).alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # one row per bucket
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select("bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start")), "starts")
    n_parts = n_shards * per_shard
    gathered = (rows.repartition(n_parts, "bucket").groupBy("bucket").agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list("x")).alias("xs"))
                .join(starts, "bucket").repartition(n_parts, "bucket").sortWithinPartitions("bucket"))
    dealt = gathered.select("shard", "bucket", "start", F.posexplode(F.shuffle("xs", F.lit(seed))).alias("pos", "x"))
    return dealt.select(*(F.col(f"x.r.c{i}").alias(c) for i, c in enumerate(carry)), "shard",
                        (F.col("start") + F.col("pos")).alias("slot"), F.col("x.grown").alias("grown_shard"), *(["bucket"] if with_bucket else []))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard with a folder per bucket, in which rows are in slot order; buckets follow one another by number.
    A bucket is in one task already, so nothing is shuffled."""
    sharded.sortWithinPartitions("shard", "bucket", "slot").write.option("compression", "zstd").partitionBy("shard", "bucket").parquet(path)



def query(docs: DataFrame) -> DataFrame:
    """Every document with the sizes and checksums of its text, the law kept, its shard and its slot: whole shards
    are written to the shared folder, and all but the law is read from their files."""
    spark = docs.sparkSession
    size = (F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + 8).cast("long")
    path = shared_path(spark, "shards")
    write_shards(shard(docs.select("doc_id", "text", size.alias("size")), ["doc_id", "text", "size"], size="size", with_bucket=True), path)
    # a row's slot is its place in its bucket's file after the rows of the shard's earlier buckets
    rows = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, grown_shard int, shard int, bucket long").parquet(path)
    t = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = rows.select("doc_id", (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), "shard", "grown_shard",
                       "bucket", F.col("_metadata.row_index").alias("at"))
    w = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))  # one file per bucket
    files = staged(files.select("shard", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start")), "files")
    out = rows.join(broadcast_up_to(files, 1_000_000), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
