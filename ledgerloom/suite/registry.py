"""All registered checks and their oracle SQL."""

from __future__ import annotations

from ledgerloom.suite import exactness, ingest, relational, reports, workbooks, workflow

MODULES = (ingest, workflow, workbooks, exactness, reports)


def queries():
    q = {}
    for mod in MODULES:
        for name in mod.ORACLES:
            q[name] = getattr(mod, name)
    q.update(relational.FUNCS)
    return q


def oracle_sql():
    o = {}
    for mod in MODULES + (relational,):
        o.update({k: v.strip() for k, v in mod.ORACLES.items()})
    return o
