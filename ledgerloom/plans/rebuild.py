"""G6 (recompute selected / all / by trigger), G7 (batch by kind or folder) and
G9 (end-to-end setup flow).

Pipelines run in dependency order (G4 on the pipeline graph); a failing
pipeline is recorded in its summary and does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ledgerloom.config import (BigTableConfig, BigTableField, CleanPipeline, Pipeline, QueryPipeline, Rule,
                               RuleField, RuleSource, SqlCleanPipeline)
from ledgerloom.operators.clean import clean
from ledgerloom.operators.detect import guess_mapping
from ledgerloom.plans.inspect import detect
from ledgerloom.plans.impact import affected, build_graph, recompute_order
from ledgerloom.plans.stages import run_query, sql_clean
from ledgerloom.plans.workspace import MASTER, RunSummary, Workspace, bt_namespace
from ledgerloom.sources.files import list_files


@dataclass
class Project:
    """Everything a rebuild needs: pipelines, big tables and each folder's rules."""
    pipelines: list[Pipeline]
    tables: list[BigTableConfig]
    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def table_of(self, folder: str) -> BigTableConfig | None:
        return next((t for t in self.tables if t.folder == folder), None)


def run_pipeline(ws: Workspace, proj: Project, p: Pipeline) -> RunSummary:
    try:
        if isinstance(p, CleanPipeline):
            cfg = proj.table_of(p.big_table_folder)
            if cfg is None:
                raise ValueError(f"no big table for folder {p.big_table_folder}")
            return clean(ws, p, proj.rules.get(p.big_table_folder, []), cfg).summary
        if isinstance(p, SqlCleanPipeline):
            return sql_clean(ws, p, {t.folder: t.table_name for t in proj.tables})
        return run_query(ws, p)
    except Exception as e:  # noqa: BLE001 - recorded, the rebuild goes on
        s = RunSummary(p.id, p.kind, False, 0, f"{type(e).__name__}: {e}")
        ws.log_run(s)
        return s


def pipeline_order(ws: Workspace, proj: Project, ids: list[str] | None = None) -> list[str]:
    """Topological order of the selected pipelines (all when ``ids`` is None):
    longest-path level from the graph's roots, ties by id."""
    nodes, edges = build_graph(ws.spark, proj.pipelines, proj.tables)
    roots = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id")
    order = recompute_order(edges, roots)
    lvl = {r["id"]: r["level"] for r in order.collect()}   # pipeline-sized, a few rows
    jobs = [p.id for p in proj.pipelines if ids is None or p.id in ids]
    return sorted(jobs, key=lambda j: (lvl.get(f"job:{j}") is None, lvl.get(f"job:{j}") or 0, j))


def rebuild(ws: Workspace, proj: Project, ids: list[str] | None = None) -> list[RunSummary]:
    """Run the selected pipelines (or all) in dependency order."""
    by_id = {p.id: p for p in proj.pipelines}
    return [run_pipeline(ws, proj, by_id[j]) for j in pipeline_order(ws, proj, ids)]


def rebuild_after_change(ws: Workspace, proj: Project, source_dir: str) -> list[RunSummary]:
    """G6 by trigger: everything downstream of a changed source folder."""
    _, edges = build_graph(ws.spark, proj.pipelines, proj.tables)
    hit = [r["id"][4:] for r in affected(edges, f"src:{source_dir}").collect() if r["id"].startswith("job:")]
    return rebuild(ws, proj, hit)


def run_batch(ws: Workspace, proj: Project, kind: str | None = None, folder: str | None = None) -> list[RunSummary]:
    """All pipelines of a kind and/or big-table folder, in dependency order."""
    def keep(p):
        if kind and p.kind != kind:
            return False
        if folder:
            fs = [p.big_table_folder] if isinstance(p, CleanPipeline) else getattr(p, "big_tables", [])
            return folder in fs
        return True
    return rebuild(ws, proj, [p.id for p in proj.pipelines if keep(p)])


def quickstart(ws: Workspace, source_dir: str, folder: str, table: str = "entries",
               result_table: str | None = None) -> tuple[Project, list[RunSummary]]:
    """Detect the header row of the first file (CSV or workbook, its first sheet), guess mappings from its
    canonical headers, write one rule for all files of the folder, clean, then copy into master with
    ``SELECT *`` and check that the row counts agree and that every file gave rows or is reported."""
    spark = ws.spark
    files = list_files(spark, source_dir)
    first = files.orderBy("rel_path").select("path").first()
    if first is None:
        raise ValueError(f"no source in {source_dir}")
    _, header_row, canon = detect(spark, first["path"])
    guess = guess_mapping(canon).orderBy("pos").collect()      # one row per header cell
    rule = Rule(folder, [RuleSource("**/*", header_row)],
                [RuleField(g["source_header"], g["output_name"], i, True,
                           ["coerce_cents" if g["transform"] == "to-cents" else "none"])
                 for i, g in enumerate(guess)])
    cfg = BigTableConfig(folder, table, [BigTableField(g["output_name"], g["type"], i) for i, g in enumerate(guess)])
    c = CleanPipeline(f"clean_{folder}", source_dir, folder)
    m = SqlCleanPipeline(f"master_{folder}", [folder], f'SELECT * FROM "bt_{folder}".{table}',
                         result_table or table)
    proj = Project([c, m], [cfg], {folder: [rule]})
    runs = rebuild(ws, proj)
    if all(r.ok for r in runs):
        seen = ws.read(bt_namespace(folder), table).select(F.col("__source_file").alias("path")).distinct()
        silent = files.select("path").join(seen, "path", "left_anti").count() - runs[0].skipped
        if runs[0].rows != runs[-1].rows:
            runs[-1].ok, runs[-1].error = False, f"row count differs: clean {runs[0].rows}, master {runs[-1].rows}"
        elif silent > 0:
            runs[0].warnings.append(f"{silent} files gave no row")
    return proj, runs


__all__ = ["Project", "rebuild", "rebuild_after_change", "run_batch", "quickstart", "pipeline_order",
           "QueryPipeline", "MASTER"]
