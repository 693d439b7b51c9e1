"""Rule, big-table and pipeline configuration (driver-side documents).

R1 (compile) and R2 (load order) live here because they only touch the YAML
documents; everything that meets data becomes a small DataFrame in
:mod:`ledgerloom.operators.rules`.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from ledgerloom.functions.transforms import COLUMN_TYPES, RULE_KIND_TO_TRANSFORM, TRANSFORMS


class ConfigError(ValueError):
    """A configuration problem, with a stable ``code``."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class RuleSource:
    pattern: str
    header_row: int = 1
    sheet_name: str | None = None
    sheet_index: int | None = None      # 0-based; used when sheet_name is empty
    end_row: int | None = None          # last data row (inclusive), as promised by the docs


@dataclass
class RuleField:
    source_header: str
    output_name: str
    order: int = 0
    included: bool = True
    transforms: list[str] = field(default_factory=list)   # rule kinds; only the first counts


@dataclass
class Rule:
    name: str
    sources: list[RuleSource]
    fields: list[RuleField]
    display: str | None = None


@dataclass
class Mapping:
    source_header: str
    output_name: str
    transform: str = "none"


@dataclass
class CompiledRule:
    name: str
    sources: list[RuleSource]
    mappings: list[Mapping]
    headers: list[str] = field(default_factory=list)    # every included source header


def compile_rule(rule: Rule) -> CompiledRule:
    """Drop excluded fields, order by ``order``, first transform kind only,
    unknown kinds mean ``none``. A later mapping to the same output name wins and
    takes the column's first place."""
    fields = sorted((f for f in rule.fields if f.included), key=lambda f: f.order)
    maps: dict[str, Mapping] = {}
    for f in fields:
        kind = f.transforms[0] if f.transforms else "none"
        maps[f.output_name] = Mapping(f.source_header, f.output_name,
                                      RULE_KIND_TO_TRANSFORM.get(kind, "none"))
    return CompiledRule(rule.name, list(rule.sources), list(maps.values()), list(dict.fromkeys(f.source_header for f in fields)))


def rule_from_dict(d: dict) -> Rule:
    sources = [RuleSource(pattern=s["pattern"], header_row=int(s.get("headerRow", s.get("header_row", 1))),
                          sheet_name=s.get("sheetName", s.get("sheet_name")) or None,
                          sheet_index=s.get("sheetIndex", s.get("sheet_index")),
                          end_row=s.get("endRow", s.get("end_row")))
               for s in d.get("sources", [])]
    fields = []
    for i, f in enumerate(d.get("fields", [])):
        tr = f.get("transforms") or []
        kinds = [t["kind"] if isinstance(t, dict) else str(t) for t in tr]
        fields.append(RuleField(source_header=str(f.get("sourceHeader", f.get("source_header", ""))),
                                output_name=str(f.get("outputName", f.get("output_name", ""))),
                                order=int(f.get("order", i)),
                                included=f.get("included", True) is not False,
                                transforms=kinds))
    return Rule(name=d.get("name", ""), sources=sources, fields=fields, display=d.get("display"))


def load_rules(folder: str) -> list[Rule]:
    """R2: every ``*.yaml`` / ``*.yml`` in ``folder``, sorted by file name."""
    import yaml
    if not os.path.isdir(folder):
        return []
    names = sorted(n for n in os.listdir(folder) if n.lower().endswith((".yaml", ".yml")))
    out = []
    for n in names:
        with open(os.path.join(folder, n), encoding="utf-8") as fh:
            out.append(rule_from_dict(yaml.safe_load(fh) or {}))
    return out


def save_rule(folder: str, rule: Rule, file_name: str | None = None) -> str:
    import yaml
    os.makedirs(folder, exist_ok=True)
    d = {"name": rule.name,
         "sources": [{k: v for k, v in (("pattern", s.pattern), ("headerRow", s.header_row),
                                        ("sheetName", s.sheet_name), ("sheetIndex", s.sheet_index),
                                        ("endRow", s.end_row)) if v is not None} for s in rule.sources],
         "fields": [{"sourceHeader": f.source_header, "outputName": f.output_name, "order": f.order,
                     "included": f.included, "transforms": [{"kind": k} for k in f.transforms]}
                    for f in rule.fields]}
    path = os.path.join(folder, file_name or f"{rule.name}.yaml")
    with open(path, "w", encoding="utf-8") as fh:
        yaml.safe_dump(d, fh, allow_unicode=True, sort_keys=False)
    return path


@dataclass
class BigTableField:
    name: str
    type: str = "TEXT"
    order: int = 0
    primary_key: bool = False


@dataclass
class BigTableConfig:
    folder: str
    table_name: str
    fields: list[BigTableField] = field(default_factory=list)

    def type_of(self, name: str) -> str:
        for f in self.fields:
            if f.name == name:
                return f.type
        return "TEXT"


def validate_big_table(cfg: BigTableConfig) -> None:
    if not cfg.table_name:
        raise ConfigError("BIGTABLE_NO_NAME", "big table needs a table name")
    seen = set()
    for f in cfg.fields:
        if f.type not in COLUMN_TYPES:
            raise ConfigError("BIGTABLE_BAD_TYPE", f"field {f.name!r}: type {f.type!r}")
        if f.name in seen:
            raise ConfigError("BIGTABLE_DUP_FIELD", f"field {f.name!r} twice")
        seen.add(f.name)


@dataclass
class CleanPipeline:
    id: str
    source_dir: str
    big_table_folder: str
    label: str | None = None
    kind: str = "clean"


@dataclass
class SqlCleanPipeline:
    id: str
    big_tables: list[str]
    sql: str
    result_table: str
    label: str | None = None
    kind: str = "sql-clean"


@dataclass
class QueryPipeline:
    id: str
    sql: str
    result_table: str
    dependencies: list[str] = field(default_factory=list)
    label: str | None = None
    kind: str = "query"


Pipeline = CleanPipeline | SqlCleanPipeline | QueryPipeline


def validate_pipeline(p: Pipeline) -> None:
    if not p.id:
        raise ConfigError("PIPELINE_NO_ID", "pipeline needs an id")
    if isinstance(p, CleanPipeline):
        if not p.source_dir or not p.big_table_folder:
            raise ConfigError("PIPELINE_BAD_CLEAN", "clean needs source_dir and big_table_folder")
    else:
        if not p.sql or not p.sql.strip():
            raise ConfigError("SQL_REQUIRED", f"{p.id}: sql is empty")
        if not p.result_table:
            raise ConfigError("RESULT_TABLE_REQUIRED", f"{p.id}: result table is empty")
        if isinstance(p, SqlCleanPipeline) and not p.big_tables:
            raise ConfigError("BIG_TABLES_REQUIRED", f"{p.id}: list at least one big table")


def check_mappings(mappings: list[Mapping]) -> None:
    """Part of H9: static checks of a mapping list."""
    if not mappings:
        raise ConfigError("MAPPING_EMPTY", "no mappings")
    for m in mappings:
        if not m.source_header:
            raise ConfigError("MAPPING_NO_SOURCE", "empty source header")
        if not m.output_name:
            raise ConfigError("MAPPING_NO_OUTPUT", f"{m.source_header}: empty output name")
        if m.transform not in TRANSFORMS:
            raise ConfigError("MAPPING_BAD_TRANSFORM", f"{m.source_header}: {m.transform}")
