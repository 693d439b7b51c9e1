"""Dependency graph, impact closure, recompute order and rebuilds.

The graph is a DataFrame ``edges(src, dst)``; closure and ordering are
iterative joins (breadth-first, one join per level, lineage cut by
``checkpoint()`` into the shared folder every level), so they also run on
graphs far larger than a pipeline list (see the lineitem-derived checks).

Node ids are namespaced: ``src:<dir>``, ``bt:<table>``, ``job:<pipeline id>``.
A query dependency binds to the job producing that result table first, then
to a big table of that name (the reference binds big tables first, which only
orders correctly by accident of names; see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import BigTableConfig, CleanPipeline, Pipeline, QueryPipeline, SqlCleanPipeline

NODE_SCHEMA = "id string, kind string, label string"


def build_graph(spark: SparkSession, pipelines: list[Pipeline], tables: list[BigTableConfig]
                ) -> tuple[DataFrame, DataFrame]:
    """G1: (nodes, edges) from pipeline and big-table configuration."""
    folder_to_table = {t.folder: t.table_name for t in tables}
    nodes, edges = {}, []
    for t in tables:
        nodes[f"bt:{t.table_name}"] = ("bigtable", t.folder)
    result_of = {}
    for p in pipelines:
        if isinstance(p, CleanPipeline):
            nodes[f"job:{p.id}"] = ("clean-pipeline", p.label or p.id)
            nodes.setdefault(f"src:{p.source_dir}", ("source", p.source_dir))
        elif isinstance(p, SqlCleanPipeline):
            nodes[f"job:{p.id}"] = ("sql-clean-pipeline", p.label or p.id)
            result_of[p.result_table] = f"job:{p.id}"
        else:
            nodes[f"job:{p.id}"] = ("query-pipeline", p.label or p.id)
            result_of[p.result_table] = f"job:{p.id}"
    for p in pipelines:
        me = f"job:{p.id}"
        if isinstance(p, CleanPipeline):
            edges.append((f"src:{p.source_dir}", me))
            t = folder_to_table.get(p.big_table_folder)
            if t is not None:
                edges.append((me, f"bt:{t}"))
        elif isinstance(p, SqlCleanPipeline):
            for f in p.big_tables:
                t = folder_to_table.get(f)
                if t is not None:
                    edges.append((f"bt:{t}", me))
        elif isinstance(p, QueryPipeline):
            for d in p.dependencies:
                if d in result_of and result_of[d] != me:
                    edges.append((result_of[d], me))
                elif f"bt:{d}" in nodes:
                    edges.append((f"bt:{d}", me))
    n = spark.createDataFrame([(k, v[0], v[1]) for k, v in nodes.items()], NODE_SCHEMA)
    e = spark.createDataFrame(sorted(set(edges)), "src string, dst string")
    return n, e


def downstream(edges: DataFrame, node: str) -> DataFrame:
    """Direct dependents."""
    return edges.filter(F.col("src") == node).select(F.col("dst").alias("id")).distinct()


def upstream(edges: DataFrame, node: str) -> DataFrame:
    """Direct dependencies."""
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("id")).distinct()


def affected(edges: DataFrame, start) -> DataFrame:
    """Transitive downstream of ``start`` (an id or a one-column DataFrame of
    ids), without the start itself unless a cycle leads back to it. Cycle-safe:
    each level joins only the new frontier and anti-joins what was seen, until
    nothing new is found."""
    e = edges.select("src", "dst").distinct()
    frontier = _starts(edges, start)
    seen = edges.sparkSession.createDataFrame([], "id string")
    while True:
        nxt = (frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
                       .join(seen, "id", "left_anti"))
        nxt = nxt.checkpoint(eager=True)
        if nxt.isEmpty():
            return seen
        seen = seen.unionByName(nxt).checkpoint(eager=True)
        frontier = nxt


def _starts(edges: DataFrame, start) -> DataFrame:
    if isinstance(start, DataFrame):
        return start.select(F.col(start.columns[0]).alias("id")).distinct()
    return edges.sparkSession.createDataFrame([(start,)], "id string")


def recompute_order(edges: DataFrame, start) -> DataFrame:
    """The affected nodes with ``level`` = longest path from the start inside
    the affected set, ordered by (level, id). Nodes without an open dependency are taken off level by
    level; what cannot be taken off is on a cycle or behind one and comes after all
    others (level NULL), as the reference appends it."""
    aff = affected(edges, start).checkpoint(eager=True)
    outside = _starts(edges, start).join(aff, "id", "left_anti")
    inside = edges.select("src", "dst").distinct().join(aff.withColumnRenamed("id", "dst"), "dst", "left_semi")
    # a start that nothing affected leads back to is done at level 0
    left = inside.join(outside.withColumnRenamed("id", "src"), "src", "left_anti") \
                 .join(aff.withColumnRenamed("id", "src"), "src", "left_semi").checkpoint(eager=True)
    todo = aff
    done = edges.sparkSession.createDataFrame([], "id string, level int")
    level = 1
    while True:
        free = todo.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").checkpoint(eager=True)
        if free.isEmpty():
            break
        done = done.unionByName(free.withColumn("level", F.lit(level))).checkpoint(eager=True)
        left = left.join(free.withColumnRenamed("id", "src"), "src", "left_anti").checkpoint(eager=True)
        todo = todo.join(free, "id", "left_anti").checkpoint(eager=True)
        level += 1
    out = done.unionByName(todo.withColumn("level", F.lit(None).cast("int")))
    return out.orderBy(F.col("level").asc_nulls_last(), "id")


def trigger_sources(nodes: DataFrame) -> DataFrame:
    """Source nodes (where a changed file enters the graph)."""
    return nodes.filter(F.col("kind") == "source").select("id")
