"""R1-R3, R6 as small DataFrames built from the compiled rules.

Rule documents are configuration (a handful of rows), so they are turned into
tiny DataFrames on the driver and broadcast into the data jobs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import CompiledRule, Rule, compile_rule
from ledgerloom.functions.globs import glob_to_regex

SOURCES_SCHEMA = T.StructType([
    T.StructField("src_id", T.IntegerType()), T.StructField("rule_pos", T.IntegerType()),
    T.StructField("source_pos", T.IntegerType()), T.StructField("pattern", T.StringType()),
    T.StructField("regex", T.StringType()), T.StructField("sheet_name", T.StringType()),
    T.StructField("sheet_index", T.IntegerType()), T.StructField("header_row", T.IntegerType()),
    T.StructField("end_row", T.IntegerType()),
])
FIELDS_SCHEMA = T.StructType([
    T.StructField("rule_pos", T.IntegerType()), T.StructField("col_pos", T.IntegerType()),
    T.StructField("output_name", T.StringType()), T.StructField("source_header", T.StringType()),
    T.StructField("transform", T.StringType()),
])


@dataclass
class RulePlan:
    compiled: list[CompiledRule]
    columns: list[str]                  # output columns, rule order, first wins
    sources: list[tuple]                # rows of SOURCES_SCHEMA after R3 dedup
    fields: list[tuple]                 # rows of FIELDS_SCHEMA
    warnings: list[str] = field(default_factory=list)

    def sources_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.sources, SOURCES_SCHEMA)

    def headers_df(self, spark: SparkSession) -> DataFrame:
        """Every header a rule names, also where a later mapping to the same output replaces it."""
        rows = [(rpos, h) for rpos, c in enumerate(self.compiled) for h in c.headers]
        return spark.createDataFrame(rows, "rule_pos int, source_header string")

    def fields_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.fields, FIELDS_SCHEMA)


def plan_rules(rules: list[Rule]) -> RulePlan:
    """R1 compile, output column list, R3 source dedup on pattern|sheet|headerRow (and sheet index, end row)
    (a later rule repeating a key is ignored for that source, with a warning)."""
    compiled = [compile_rule(r) for r in rules]
    columns: list[str] = []
    for c in compiled:
        for m in c.mappings:
            if m.output_name not in columns:
                columns.append(m.output_name)
    col_pos = {c: i for i, c in enumerate(columns)}
    seen: dict[str, str] = {}
    sources, fields, warnings = [], [], []
    sid = 0
    for rpos, c in enumerate(compiled):
        for spos, s in enumerate(c.sources):
            key = f"{s.pattern}|{s.sheet_name or ''}|{s.header_row}"
            if not s.sheet_name and s.sheet_index:
                key += f"|sheet {s.sheet_index}"    # two sheets of one pattern, picked by position
            if s.end_row is not None:
                key += f"|to {s.end_row}"
            if key in seen:
                warnings.append(f"rule {c.name!r}: source {key!r} already taken by rule {seen[key]!r}; ignored")
                continue
            seen[key] = c.name
            sources.append((sid, rpos, spos, s.pattern, glob_to_regex(s.pattern), s.sheet_name,
                            s.sheet_index, int(s.header_row), s.end_row))
            sid += 1
        for m in c.mappings:
            fields.append((rpos, col_pos[m.output_name], m.output_name, m.source_header, m.transform))
    return RulePlan(compiled, columns, sources, fields, warnings)


def rule_coverage(sheets: DataFrame, files: DataFrame, rule_sources: DataFrame) -> DataFrame:
    """Per (file, sheet) whether some rule covers it: the glob hits the file's
    base name or relative path and the rule's sheet is empty or equal.
    Output: rel_path, sheet_name, covered, rules (sorted rule positions)."""
    f = files.select("path", "rel_path", "name")
    s = sheets.join(f, sheets["source_file"] == f["path"])
    rs = F.broadcast(rule_sources.select("rule_pos", "regex", F.col("sheet_name").alias("rule_sheet")))
    hit = (s.join(rs, (F.regexp_like(s["name"], rs["regex"]) | F.regexp_like(s["rel_path"], rs["regex"]))
                  & (rs["rule_sheet"].isNull() | (rs["rule_sheet"] == "") | (rs["rule_sheet"] == s["sheet_name"])),
                  "left"))
    return (hit.groupBy("rel_path", "sheet_name")
               .agg(F.sort_array(F.collect_set("rule_pos")).alias("rules"))
               .withColumn("covered", F.size("rules") > 0))
