"""URL rules by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels reversed with a dot after each (``org.example.``), so a rule's
host and all its subdomains are one interval of keys: from the rule's key up to the key followed by
the byte FF, which UTF-8 never holds. Such intervals nest or are disjoint. ``sweep`` merges the
interval starts, points and interval ends in one sorted order; the depth is the running sum of
starts less ends, and the active rule of each depth is the last start at that depth: a stack with
one place per depth. The sort is dealt by key range; each range starts with the stack that the
ranges before leave, which is combined from one row per range and depth.

Two sweeps: hosts against rule hosts give every host its active rule hosts; then, under each rule
host, the paths of its urls against the paths of its rules (a path prefix is an interval too).
The longest rule wins (host plus path; a tie goes to the longer host). Urls are reduced to distinct
(host, path) first, so one hot url or host is one point of the sweep.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; rules
that repeat count once, block before allow; with no rule the verdict is ``default``; no rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, partitions, staged

#: (host, path, verdict): fixed values of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(points: DataFrame, rules: DataFrame, all_active: bool) -> DataFrame:
    """``points(key)`` and ``rules(key)``, binary, distinct and not null -> ``(point, rule)``: the
    innermost rule whose key is a prefix of the point, or every one with ``all_active``."""
    n = partitions(points.sparkSession)
    events = (rules.select("key", F.col("key").alias("rule"), F.lit(0).alias("kind"))
              .unionByName(rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(None).cast("binary").alias("rule"), F.lit(2).alias("kind")))
              .unionByName(points.select("key", F.lit(None).cast("binary").alias("rule"), F.lit(1).alias("kind"))))
    # the range of each row is fixed by writing it: a later sampling might cut elsewhere
    events = staged(events.repartitionByRange(n, "key", "kind").withColumn("part", F.spark_partition_id()), "events")
    step = F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)
    along = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inner = events.select("*", F.sum(step).over(along).alias("depth"))
    net = events.groupBy("part").agg(F.sum(step).alias("net"))  # one row per range
    base = staged(net.select("part", F.coalesce(F.sum("net").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "base")
    # ranges x one small row: the table has at most as many rows as there are shuffle partitions
    inner = inner.join(F.broadcast(base), "part").select("part", "key", "kind", "rule", (F.col("depth") + F.col("base")).cast("int").alias("depth"))
    # the stack before a range: for each depth the last start in an earlier range
    opened = F.struct("key", "rule")
    last = inner.filter("kind = 0").groupBy("part", "depth").agg(F.max(opened)["rule"].alias("top"))
    marks = last.groupBy("depth").agg(F.min("part").alias("first")).select("depth", F.explode(F.sequence(F.col("first") + 1, F.greatest(F.col("first") + 1, F.lit(n)))).alias("part"))
    carried = (marks.select("part", "depth", F.lit(None).cast("binary").alias("top"), F.lit(0).alias("own"))
               .unionByName(last.withColumn("own", F.lit(1))))
    before = Window.partitionBy("depth").orderBy("part", "own").rowsBetween(Window.unboundedPreceding, -1)
    carried = (carried.select("part", "depth", "own", F.last("top", True).over(before).alias("carry")).filter("own = 0").select("part", "depth", "carry"))
    if not all_active:
        # a point's own depth names its place in the stack
        place = Window.partitionBy("part", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = inner.select("*", F.last(F.when(F.col("kind") == 0, F.col("rule")), True).over(place).alias("own")).filter("kind = 1 AND depth > 0")
    else:
        # a point looks into each place up to its depth
        wide = inner.filter("kind <> 2").select("part", "key", "kind", "rule", F.explode(F.when(F.col("kind") == 1, F.sequence(F.lit(0), F.col("depth")))
                                                                                        .otherwise(F.array("depth"))).alias("depth")).filter("depth > 0")
        place = Window.partitionBy("part", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
        found = wide.select("*", F.last(F.when(F.col("kind") == 0, F.col("rule")), True).over(place).alias("own")).filter("kind = 1")
    return (found.join(carried, ["part", "depth"], "left").select(F.col("key").alias("point"), F.coalesce("own", "carry").alias("rule")))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with url_host, url_path, url_rule and url_verdict; ``rules(host, path, verdict)``."""
    own = [F.col(f"`{c}`") for c in urls.columns]
    h, p = host_path(F.col(f"`{url}`"))
    rows = urls.select(*own, h.alias("url_host"), p.alias("url_path"))
    rules = rules.select(reversed_host(F.translate("host", UPPER, LOWER)).cast("binary").alias("rh"), F.col("path").alias("rp"),
                         F.concat(F.translate("host", UPPER, LOWER), "path").alias("name"), "verdict").groupBy("rh", "rp", "name").agg(F.max("verdict").alias("verdict"))
    distinct = staged(rows.select("url_host", "url_path").distinct(), "urls")
    hosts = distinct.select("url_host").distinct().select("url_host", reversed_host(F.col("url_host")).cast("binary").alias("key"))
    active = sweep(hosts.select("key"), rules.select(F.col("rh").alias("key")).distinct(), True).join(hosts, F.col("point") == F.col("key")).select("url_host", F.col("rule").alias("rh"))
    # keys under a rule host: the host's key, the byte 00, the path
    under = lambda a, b: F.concat(F.col(a), F.lit(b"\x00"), F.col(b).cast("binary"))
    fits = staged(distinct.join(active, "url_host").select("url_host", "url_path", "rh", under("rh", "url_path").alias("point")), "points")
    top = sweep(fits.select(F.col("point").alias("key")).distinct(), rules.select(under("rh", "rp").alias("key")).distinct(), False)
    named = rules.select(under("rh", "rp").alias("rule"), "rh", "rp", "name", "verdict")
    best = F.max(F.struct(F.length("name"), F.length("rh"), "name", "verdict"))
    won = (fits.select("url_host", "url_path", "point").join(top, "point").join(named, "rule")
           .groupBy("url_host", "url_path").agg(best.alias("b")).select(F.col("url_host").alias("__h"), F.col("url_path").alias("__p"), "b.name", "b.verdict"))
    return (rows.join(won, (F.col("url_host") == F.col("__h")) & (F.col("url_path") == F.col("__p")), "left")
            .select(*own, "url_host", "url_path", F.col("name").alias("url_rule"), F.coalesce("verdict", F.lit(default)).alias("url_verdict")))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every page with the host and path of its url, the rule that wins and the verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge(pages.select("page_id", "url"), rules)
    return out.select("page_id", *(F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH r(h, p, v) AS (VALUES {_VALUES}),
a AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT k, page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM a),
c AS (SELECT k, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT k, h, p, v FROM c, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM c LEFT JOIN m USING (k)
"""
