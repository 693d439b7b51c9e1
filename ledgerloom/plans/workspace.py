"""Table storage: namespaced tables as versions, each committed by one atomic rename.

M1 rebuild, M2 append, Q3 namespaces (``bt_<slug>`` per big-table folder, ``master`` for results), Q8 table listing, Q9
update and delete, G8 run log. A version is a small JSON file in ``<table>/_versions``: the table's display name, its schema
and its parts, which are folders or files of Parquet. The highest number is the current version. A commit writes the next number
aside and renames it without overwriting, so readers see all of it or nothing, and of two writers one has to look again; data that no
version names is invisible, so a run that fails between its write and its commit changes nothing.

* a rebuild names one new folder; an append adds a folder (and remembers the stream batch it belongs to, so that a batch that
  runs twice is appended once); an update or delete replaces only the files that hold hits, the others keep their names;
* ``versions`` lists what a table was, ``vacuum`` removes the data that only older versions name;
* nothing is registered in the session's catalog: SQL finds tables by name in the workspace it runs in
  (``plans/statements.py``), so workspaces, sessions and threads do not see each other's tables.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.store import Store
from ledgerloom.session import configure, work_dir
from ledgerloom.sources.csvrows import literal_path

MASTER = "master"
_ASCII_ID = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def slug(name: str) -> str:
    """ASCII identifier for a display name: the ASCII word part plus a short hash
    when anything else was present."""
    if _ASCII_ID.match(name):
        return name.lower()
    ascii_part = re.sub(r"[^A-Za-z0-9_]", "_", name).strip("_").lower()
    h = hashlib.sha1(name.encode("utf-8")).hexdigest()[:8]
    return f"{ascii_part}_{h}" if ascii_part else f"t_{h}"


def bt_namespace(folder: str) -> str:
    return "bt_" + slug(folder)


class TableMissingError(RuntimeError):
    code = "TABLE_NOT_FOUND"


class ConcurrentWriteError(RuntimeError):
    """Another writer committed a version that this change was not made for."""
    code = "CONCURRENT_WRITE"


@dataclass
class RunSummary:
    pipeline_id: str
    kind: str
    ok: bool
    rows: int = 0
    error: str | None = None
    warnings: list[str] = field(default_factory=list)
    unused_headers: list[str] = field(default_factory=list)
    files: int = 0
    result_table: str | None = None
    skipped: int = 0                        # files that could not be read


@dataclass(frozen=True)
class Version:
    """What a table is at one time. ``batches``: the last stream batch appended, by query."""
    number: int
    name: str
    parts: tuple[str, ...]
    schema: str
    at: str = ""
    batches: dict[str, int] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def _now() -> str:
    return _dt.datetime.now(_dt.timezone.utc).isoformat()


def _nullable(schema: T.StructType) -> str:
    return json.dumps(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).jsonValue())


class Workspace:
    """A workspace root in the shared folder (``spark.checkpoint.dir`` by default)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = configure(spark)
        self.root = root or work_dir(spark, "workspace", fresh=True)
        self.store = Store(spark)

    # ---- versions -----------------------------------------------------------
    def _table_dir(self, ns: str, table: str) -> str:
        return os.path.join(self.root, "tables", ns, slug(table))

    def _numbers(self, ns: str, table: str) -> list[int]:
        names = self.store.children(os.path.join(self._table_dir(ns, table), "_versions"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _version(self, ns: str, table: str, number: int) -> Version:
        got = json.loads(self.store.read(os.path.join(self._table_dir(ns, table), "_versions", f"{number:08d}.json")))
        return Version(**got | {"parts": tuple(got["parts"])})

    def current(self, ns: str, table: str) -> Version | None:
        numbers = self._numbers(ns, table)
        return self._version(ns, table, numbers[-1]) if numbers else None

    def versions(self, ns: str, table: str) -> list[Version]:
        """Every version that is still listed, the oldest first."""
        return [self._version(ns, table, n) for n in self._numbers(ns, table)]

    def commit(self, ns: str, table: str, change: Callable[[Version | None], Version | None]) -> Version | None:
        """Make ``change(current version)`` the current version; asked again if another writer was first. None changes nothing."""
        while True:
            old = self.current(ns, table)
            new = change(old)
            if new is None:
                return old
            new = replace(new, number=(old.number if old else 0) + 1, at=_now())
            if self.store.create(os.path.join(self._table_dir(ns, table), "_versions", f"{new.number:08d}.json"),
                                 json.dumps(asdict(new), ensure_ascii=False)):
                return new

    def vacuum(self, ns: str, table: str, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions, and remove the folders inside the workspace that only those named.
        Not to be run while a writer of this table is between its write and its commit, nor while an older version is read."""
        numbers = self._numbers(ns, table)
        old, kept = numbers[:-keep], numbers[-keep:]
        base = self.store.qualified(self._table_dir(ns, table))
        named = {self.store.qualified(p) for n in kept for p in self._version(ns, table, n).parts}
        for n in old:
            self.store.delete(os.path.join(self._table_dir(ns, table), "_versions", f"{n:08d}.json"))
        removed = 0
        for child in self.store.children(base):
            folder = f"{base}/{child}"
            if child.startswith("v_") and folder not in named and not any(p.startswith(folder + "/") for p in named):
                self.store.delete(folder)
                removed += 1
        return removed

    def _new_folder(self, ns: str, table: str) -> str:
        stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
        return os.path.join(self._table_dir(ns, table), f"v_{stamp}_{uuid.uuid4().hex[:6]}")

    def slugs(self, ns: str) -> list[str]:
        """The tables of a namespace."""
        return [s for s in self.store.children(os.path.join(self.root, "tables", ns)) if self._numbers(ns, s)]

    def stage_dir(self, *parts: str) -> str:
        return os.path.join(self.root, "staging", *parts, uuid.uuid4().hex[:12])

    # ---- reads ----------------------------------------------------------------
    def attach(self, ns: str, table: str, path: str) -> None:
        """Make existing Parquet data a table. Later writes add or replace files inside the workspace only; ``path`` is left alone."""
        schema = _nullable(self.spark.read.parquet(path).schema)
        self.commit(ns, table, lambda old: Version(0, table, (path,), schema))

    def exists(self, ns: str, table: str) -> bool:
        return bool(self._numbers(ns, table))

    def _frame(self, version: Version, spark: SparkSession | None = None, parts: list[str] | None = None) -> DataFrame:
        spark = spark or self.spark
        parts = list(version.parts) if parts is None else parts
        if not parts:
            return spark.createDataFrame([], version.struct())
        return spark.read.schema(version.struct()).parquet(*map(literal_path, parts))

    def read(self, ns: str, table: str, spark: SparkSession | None = None) -> DataFrame:
        v = self.current(ns, table)
        if v is None:
            raise TableMissingError(f"{TableMissingError.code}: {ns}.{table}")
        return self._frame(v, spark)

    def list_tables(self, ns: str) -> DataFrame:
        """Q8: (table, column, type, position) for every table of a namespace, by name, as the versions name them."""
        rows = []
        for s in self.slugs(ns):
            v = self.current(ns, s)
            rows += [(v.name, f.name, f.dataType.simpleString(), i) for i, f in enumerate(v.struct().fields)]
        return self.spark.createDataFrame(rows, "table string, column string, type string, position int") \
                   .orderBy("table", "position")

    # ---- writes ---------------------------------------------------------------
    def _write(self, df: DataFrame, ns: str, table: str, metrics: list[Column] | None, project: list[Column] | None,
               beside: Column | None = None) -> tuple[str, T.StructType, int, dict]:
        """Rows written to a folder that no version names yet: (folder, schema, rows, metrics), counted by one
        ``observe`` on the write itself. ``beside`` is a column of the files that is not part of the table."""
        obs = Observation(f"w_{uuid.uuid4().hex[:8]}")
        observed = df.observe(obs, F.count(F.lit(1)).alias("__rows"), *list(metrics or []))
        columns = ["*"] if project is None else list(project)
        out = observed.select(*columns)
        folder = self._new_folder(ns, table)
        (out if beside is None else observed.select(*columns, beside)).write.mode("errorifexists").parquet(folder)
        got = dict(obs.get)
        return folder, out.schema, int(got.pop("__rows", 0) or 0), got | {"__folder": folder}

    def write_table(self, df: DataFrame, ns: str, table: str, metrics: list[Column] | None = None,
                    project: list[Column] | None = None, batch: tuple[str, int] | None = None, beside: Column | None = None) -> tuple[int, dict]:
        """M1: write new data, then make it the table. Returns (rows, metrics)."""
        folder, schema, rows, got = self._write(df, ns, table, metrics, project, beside)

        def change(old: Version | None) -> Version:
            done = dict(old.batches) if old else {}
            return Version(0, table, (folder,), _nullable(schema), batches=done | ({batch[0]: batch[1]} if batch else {}))
        self.commit(ns, table, change)
        return rows, got

    def append(self, df: DataFrame, ns: str, table: str) -> int:
        """M2: add rows to the table."""
        return self.append_observed(df, ns, table)[0]

    def appended(self, ns: str, table: str, batch: tuple[str, int]) -> bool:
        """Whether a stream's batch (query, number) is in the table."""
        v = self.current(ns, table)
        return v is not None and v.batches.get(batch[0], -1) >= batch[1]

    def append_observed(self, df: DataFrame, ns: str, table: str, metrics: list[Column] | None = None,
                        project: list[Column] | None = None, batch: tuple[str, int] | None = None, beside: Column | None = None) -> tuple[int, dict]:
        """M2 with metrics: rows written to a folder of their own, which the next version adds to the table. New columns read NULL
        in older rows; a column whose type changed makes the table be written anew in the common type."""
        v = self.current(ns, table)
        if v is None:
            return self.write_table(df, ns, table, metrics, project, batch, beside)
        kinds = {f.name: f.dataType for f in v.struct().fields}
        schema = (df.select(*project) if project is not None else df).schema
        if any(f.name in kinds and kinds[f.name] != f.dataType for f in schema.fields):
            out = df.select(*project) if project is not None else df
            obs = Observation(f"a_{uuid.uuid4().hex[:8]}")
            counted = df.observe(obs, F.count(F.lit(1)).alias("__rows"), *list(metrics or []))
            out = counted.select(*project) if project is not None else counted
            self.write_table(self._frame(v).unionByName(out, allowMissingColumns=True), ns, table, batch=batch)
            got = dict(obs.get)
            return int(got.pop("__rows", 0) or 0), got
        folder, schema, rows, got = self._write(df, ns, table, metrics, project, beside)

        def change(old: Version | None) -> Version | None:
            if batch and old and old.batches.get(batch[0], -1) >= batch[1]:
                return None                 # the batch was appended by an earlier run
            if old is None:
                old = Version(0, table, (), _nullable(T.StructType([])))
            have = old.struct()
            every = T.StructType(have.fields + [f for f in schema.fields if f.name not in have.names])
            return replace(old, parts=(*old.parts, folder), schema=_nullable(every), batches=dict(old.batches) | ({batch[0]: batch[1]} if batch else {}))
        self.commit(ns, table, change)
        return rows, got

    def _rewrite(self, ns: str, table: str, cond: Column, alias: str | None, spark: SparkSession | None,
                 hit: Callable[[DataFrame], DataFrame] | None) -> int:
        """Replace the files that hold rows of ``cond``: those rows as ``hit`` makes them (or none), the other rows of the same
        files as they are. Other files keep their names. Returns the rows met."""
        v = self.current(ns, table)
        if v is None:
            raise TableMissingError(f"{TableMissingError.code}: {ns}.{table}")
        frame = self._frame(v, spark)
        named = frame.alias(alias) if alias else frame
        # file names and counts of the files with hits: metadata
        hits = named.filter(cond).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        if not hits:
            return 0
        touched = {self.store.of_uri(r.f) for r in hits}
        files = self._frame(v, spark, sorted(touched))
        files = files.alias(alias) if alias else files
        out = files.filter(~F.coalesce(cond, F.lit(False))).select(*[F.col(f"`{c}`") for c in frame.columns])
        if hit is not None:
            out = out.unionByName(hit(files.filter(cond)))
        folder, _, _, _ = self._write(out, ns, table, None, None)
        parts: list[str] = []
        for p in v.parts:
            inside = self.store.data_files(p)
            left = [f for f in inside if f not in touched]
            parts += [p] if len(left) == len(inside) else left

        def change(now: Version | None) -> Version:
            if now is None or now.number != v.number:
                raise ConcurrentWriteError(f"{ConcurrentWriteError.code}: {ns}.{table} changed during this statement")
            return replace(now, parts=(*parts, folder))
        self.commit(ns, table, change)
        return sum(r.n for r in hits)

    def update_where(self, ns: str, table: str, cond: str | Column, assignments: dict[str, str | Column],
                     alias: str | None = None, spark: SparkSession | None = None) -> int:
        """Q9 UPDATE: the files with hits are written anew, the rows met are counted."""
        def changed(rows: DataFrame) -> DataFrame:
            kinds = rows.schema
            values = {c: F.expr(x) if isinstance(x, str) else x for c, x in assignments.items()}
            return rows.select(*[values[c].cast(kinds[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in rows.columns])
        return self._rewrite(ns, table, F.expr(cond) if isinstance(cond, str) else cond, alias, spark, changed)

    def delete_where(self, ns: str, table: str, cond: str | Column, alias: str | None = None, spark: SparkSession | None = None) -> int:
        """Q9 DELETE: the files with hits are written anew without them."""
        return self._rewrite(ns, table, F.expr(cond) if isinstance(cond, str) else cond, alias, spark, None)

    # ---- run log --------------------------------------------------------------
    def log_run(self, s: RunSummary) -> None:
        row = asdict(s)
        row["warnings"] = json.dumps(s.warnings, ensure_ascii=False)
        row["unused_headers"] = json.dumps(s.unused_headers, ensure_ascii=False)
        row.pop("skipped")
        row["at"] = _dt.datetime.now(_dt.timezone.utc).isoformat()
        schema = ("pipeline_id string, kind string, ok boolean, rows long, error string, warnings string, "
                  "unused_headers string, files long, result_table string, at string")
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append") \
            .parquet(os.path.join(self.root, "run_log"))

    def run_log(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, "run_log"))
