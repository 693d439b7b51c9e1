"""SQL statements of a workspace: Spark's own parser reads them, names are resolved on the parsed plan.

Each statement runs in a clone of the user's session (its settings, functions and temporary views), so nothing of the user's session
changes and threads do not meet. Double quotes name identifiers there. The parsed plan says where its relations are; a relation that
names a table of the workspace (``t``, ``master.t``, ``"bt_<folder>".t``, by display name or slug) becomes a temporary view of that clone,
over the table's current version. Only the namespaces given are visible. Everything else of the text reaches Spark unchanged.

INSERT, UPDATE and DELETE become writes of the workspace (new versions); attached data is never written to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from ledgerloom.config import ConfigError
from ledgerloom.operators.recursion import recursive_union
from ledgerloom.plans.workspace import MASTER, TableMissingError, Workspace, bt_namespace, slug
from ledgerloom.session import clone

_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
# Parsed statements that are no query: commands, and those that become one when they are analysed.
_WRITE = re.compile(r"Command$|^(Insert|Create|Replace|Drop|Delete|Update|Merge|Alter|Truncate|Overwrite|Append|Set|Cache|Uncache|Load|Refresh|Use|Add|Analyze|Repair|Recover|Call|Comment|Rename)")
_PART = re.compile(r'\s*(`(?:[^`]|``)*`|"(?:[^"]|"")*"|\w+)', re.UNICODE)


@contextmanager
def _active(session: SparkSession) -> Iterator[None]:
    """The session whose settings the parser follows in this thread."""
    sessions = session._jvm.org.apache.spark.sql.classic.SparkSession
    before = sessions.getActiveSession()
    sessions.setActiveSession(session._jsparkSession)
    try:
        yield
    finally:
        sessions.setActiveSession(before.get()) if before.isDefined() else sessions.clearActiveSession()


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


@dataclass
class Name:
    """A name in the text: its parts and its place (in UTF-16 units, as the parser counts)."""
    parts: list[str]
    start: int
    aliased: bool = False
    column: bool = False


class Statement:
    """A parsed statement: ``kind`` of its plan, whether it writes, the relations it names."""

    def __init__(self, session: SparkSession, sql: str):
        self.session, self.sql = session, re.sub(r";\s*$", "", sql.strip())
        session.conf.set(_QUOTES, "true")
        with _active(session):
            self.plan = session._jsparkSession.sessionState().sqlParser().parsePlan(self.sql)
        self.names: list[Name] = []
        self.writes = False
        self._walk(self.plan, frozenset(), False)

    def _walk(self, node, ctes: frozenset, aliased: bool) -> None:
        kind = _kind(node)
        self.writes = self.writes or bool(_WRITE.search(kind))
        if kind == "UnresolvedRelation":
            self._relation(node, ctes, aliased)
        elif kind == "InsertIntoStatement":
            self._relation(node.table(), frozenset(), True)
        elif kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                name, body = pair._1(), pair._2()
                inside = ctes | {name.lower()} if node.allowRecursion() else ctes
                self._walk(body.child(), inside, False)      # sees the expressions before it, and itself if it may recur
                ctes = ctes | {name.lower()}
        else:
            for e in _seq(node.expressions()):
                self._columns(e)
        for child in _seq(node.children()):
            self._walk(child, ctes, kind == "SubqueryAlias")
        for child in _seq(node.subqueries()):
            self._walk(child, ctes, False)

    def _relation(self, node, ctes: frozenset, aliased: bool) -> None:
        parts = list(_seq(node.multipartIdentifier()))
        if len(parts) > 1 or parts[0].lower() not in ctes:
            self.names.append(Name(parts, node.origin().startIndex().get(), aliased))

    def _columns(self, e) -> None:
        """Columns written with a namespace and a table in front."""
        if _kind(e) == "UnresolvedAttribute" and e.nameParts().size() > 2 and e.origin().startIndex().isDefined():
            self.names.append(Name(list(_seq(e.nameParts())), e.origin().startIndex().get(), column=True))
        for child in _seq(e.children()):
            self._columns(child)

    def edited(self, change) -> str:
        """The text with names replaced: ``change(name)`` gives the new text of its first parts and how many parts, or None."""
        raw = self.sql.encode("utf-16-le")
        for n in sorted({n.start: n for n in self.names}.values(), key=lambda n: -n.start):
            new = change(n)
            if new is None:
                continue
            text, count = new
            rest = raw[2 * n.start:].decode("utf-16-le")
            at = 0
            for k in range(count):
                if k:
                    at = rest.index(".", at) + 1
                at = _PART.match(rest, at).end()
            raw = raw[:2 * n.start] + (text + rest[at:]).encode("utf-16-le")
        return raw.decode("utf-16-le")


class Scope:
    """The tables a statement may name: those of ``ns`` without a namespace, those of all visible namespaces with one."""

    def __init__(self, ws: Workspace, ns: str = MASTER, folders: list[str] | None = None):
        self.ws, self.ns = ws, ns
        self.visible = {ns, MASTER} | {bt_namespace(f) for f in folders or []}

    def find(self, parts: list[str]) -> tuple[str, str] | None:
        """(namespace, slug) of a name, if it is a visible table."""
        if len(parts) == 1:
            ns, table = self.ns, parts[0]
        elif len(parts) == 2:
            ns, table = self._namespace(parts[0]), parts[1]
        else:
            return None
        return (ns, slug(table)) if ns in self.visible and self.ws.exists(ns, table) else None

    @staticmethod
    def _namespace(name: str) -> str:
        return bt_namespace(name[3:]) if name.lower().startswith("bt_") else name.lower()

    def resolve(self, st: Statement) -> tuple[str, dict[str, tuple[str, str]]]:
        """The text with the workspace's tables as views, and the views' tables."""
        views: dict[str, tuple[str, str]] = {}

        def change(n: Name):
            found = self.find(n.parts[:2] if n.column else n.parts)
            if found is None:
                return None
            if n.column:
                return f"`{n.parts[1].replace('`', '``')}`", 2
            view = f"__{found[0]}__{found[1]}"
            views[view] = found
            shown = n.parts[-1].replace("`", "``")
            return (f"`{view}`" if n.aliased else f"`{view}` AS `{shown}`"), len(n.parts)
        return st.edited(change), views


def parsed(spark: SparkSession, sql: str) -> Statement:
    return Statement(clone(spark), sql)


def _prepared(ws: Workspace, sql: str, ns: str, folders: list[str] | None) -> tuple[Statement, str, Scope]:
    st, scope = parsed(ws.spark, sql), Scope(ws, ns, folders)
    text, views = scope.resolve(st)
    for view, (n, t) in views.items():
        ws.read(n, t, st.session).createOrReplaceTempView(view)
    return st, text, scope


def run_sql(ws: Workspace, sql: str, ns: str = MASTER, folders: list[str] | None = None) -> DataFrame:
    """A query over the workspace's tables. Anything but a query is refused."""
    st, text, _ = _prepared(ws, sql, ns, folders)
    if st.writes:
        raise ConfigError("SQL_NOT_READONLY", "only queries are allowed here")
    df = _with_recursion(st.session, _reparsed(st, text)) or st.session.sql(text)
    st.session.conf.set(_QUOTES, "false")      # only this statement's quotes name identifiers
    return df


def _rows_of(session: SparkSession, plan) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def _names_itself(node, name: str) -> bool:
    if _kind(node) == "UnresolvedRelation":
        parts = _seq(node.multipartIdentifier())
        return len(parts) == 1 and parts[0].lower() == name.lower()
    return any(_names_itself(n, name) for n in [*_seq(node.children()), *_seq(node.subqueries())])


def _with_recursion(session: SparkSession, plan) -> DataFrame | None:
    """A statement whose own WITH list is recursive, its expressions evaluated in order (``operators/recursion.py``) as
    views of the statement's session; None for all other statements."""
    if _kind(plan) != "UnresolvedWith" or not plan.allowRecursion():
        return None
    ctes = [(p._1(), p._2().child()) for p in _seq(plan.cteRelations())]
    if not any(_names_itself(body, name) for name, body in ctes):
        return None
    for name, body in ctes:
        names = None
        if _kind(body) == "UnresolvedSubqueryColumnAliases":
            names, body = list(_seq(body.outputColumnNames())), body.child()
        if not _names_itself(body, name):
            df = _rows_of(session, body)
            (df.toDF(*names) if names else df).createOrReplaceTempView(f"`{name}`")
            continue
        distinct = _kind(body) == "Distinct"
        union = body.child() if distinct else body
        parts = _seq(union.children()) if _kind(union) == "Union" else []
        if len(parts) != 2 or _names_itself(parts[0], name):
            raise ConfigError("SQL_RECURSION", f"{name}: a recursive expression is a query, UNION or UNION ALL, and a query over {name}")
        seed = _rows_of(session, parts[0])
        seed = seed.toDF(*(names or seed.columns))

        def step(rows: DataFrame, name=name, plan=parts[1]) -> DataFrame:
            rows.createOrReplaceTempView(f"`{name}`")
            return _rows_of(session, plan)
        seed = seed.unionAll(step(seed).limit(0).toDF(*seed.columns))       # the common types of both queries
        recursive_union(seed, step, distinct).createOrReplaceTempView(f"`{name}`")
    return _rows_of(session, plan.child())


def _target(st: Statement, scope: Scope, table) -> tuple[str, str, str | None, str]:
    """(namespace, slug, alias, name as written) of the table a statement writes to."""
    alias = None
    if _kind(table) == "SubqueryAlias":
        alias, table = table.alias(), table.child()
    parts = list(_seq(table.multipartIdentifier()))
    found = scope.find(parts)
    if found is None:
        raise TableMissingError(f"{TableMissingError.code}: {'.'.join(parts)}")
    return *found, alias, parts[-1]


def _reparsed(st: Statement, text: str):
    with _active(st.session):
        return st.session._jsparkSession.sessionState().sqlParser().parsePlan(text)


def change_rows(ws: Workspace, sql: str, ns: str = MASTER, folders: list[str] | None = None) -> int:
    """Run an INSERT, UPDATE or DELETE on a table of the workspace; the rows it added or met."""
    st, text, scope = _prepared(ws, sql, ns, folders)
    root, plan = st.plan, _reparsed(st, text)      # the names of the target, and the same plan over views
    ctes = None
    if _kind(plan) == "UnresolvedWith":
        ctes, root, plan = plan, root.child(), plan.child()
    kind = _kind(plan)
    if kind == "InsertIntoStatement":
        return _insert(ws, st, scope, root, plan, ctes)
    if kind not in ("UpdateTable", "DeleteFromTable"):
        raise ConfigError("SQL_UNSUPPORTED", f"{kind}: only queries, INSERT, UPDATE and DELETE run on a workspace")
    space, table, alias, name = _target(st, scope, root.table())
    jvm = st.session._jvm.org.apache.spark.sql.classic.ExpressionUtils
    column = lambda e: ClassicColumn(jvm.column(e))
    if kind == "DeleteFromTable":
        cond = plan.condition()
        always = _kind(cond) == "Literal" and cond.toString() == "true"
        return ws.delete_where(space, table, F.lit(True) if always else column(cond), alias or name, st.session)
    cond = plan.condition()
    assignments: dict[str, Column] = {}
    kinds = {c.lower(): c for c in ws.current(space, table).struct().names}
    for a in _seq(plan.assignments()):
        key = _seq(a.key().nameParts())[-1]
        if key.lower() not in kinds:
            raise ConfigError("SQL_COLUMN_MISSING", f"{name} has no column {key!r}")
        assignments[kinds[key.lower()]] = column(a.value())
    where = column(cond.get()) if cond.isDefined() else F.lit(True)
    return ws.update_where(space, table, where, assignments, alias or name, st.session)


def _insert(ws: Workspace, st: Statement, scope: Scope, root, plan, ctes) -> int:
    space, table, _, name = _target(st, scope, root.table())
    query = plan.query()
    if ctes is not None:
        query = ctes.withNewChildren(_one(st.session, query))
    df = _rows_of(st.session, query)
    have = ws.current(space, table).struct()
    into = list(_seq(root.userSpecifiedCols())) or have.names
    if root.byName():
        into = df.columns
    exact = {c.lower(): c for c in have.names}
    if len(into) != len(df.columns) or any(c.lower() not in exact for c in into) or len({c.lower() for c in into}) < len(into):
        raise ConfigError("SQL_COLUMNS_DIFFER", f"INSERT gives {len(df.columns)} columns for {len(into)} of {name}")
    place = {exact[c.lower()]: k for k, c in enumerate(into)}
    given = df.toDF(*[f"c{k}" for k in range(len(into))])
    rows = given.select(*[(F.col(f"c{place[f.name]}") if f.name in place else F.lit(None)).cast(f.dataType).alias(f.name) for f in have.fields])
    return ws.write_table(rows, space, table)[0] if root.overwrite() else ws.append(rows, space, table)


def _one(session: SparkSession, plan):
    """A Scala sequence of one plan."""
    items = session._jvm.java.util.ArrayList()
    items.add(plan)
    return session._jvm.scala.jdk.javaapi.CollectionConverters.asScala(items).toSeq()
