import pytest

from ledgerloom.config import (BigTableConfig, BigTableField, CleanPipeline, ConfigError, Mapping, QueryPipeline,
                               Rule, RuleField, RuleSource, SqlCleanPipeline, check_mappings, compile_rule,
                               validate_big_table, validate_pipeline)
from ledgerloom.operators.rules import plan_rules
from ledgerloom.plans.stages import is_reader


def _code(fn, *a):
    with pytest.raises(ConfigError) as e:
        fn(*a)
    return e.value.code


def test_compile_rule():
    r = Rule("r", [RuleSource("*.csv")], [
        RuleField("b", "y", 2, True, ["coerce_date", "coerce_cents"]), RuleField("a", "x", 1, True, ["weird"]),
        RuleField("c", "z", 0, False, []), RuleField("d", "x", 3, True, ["coerce_string"])])
    got = [(m.source_header, m.output_name, m.transform) for m in compile_rule(r).mappings]
    # excluded field dropped, sorted by order, first kind only, unknown -> none; a later mapping wins and keeps the first place
    assert got == [("d", "x", "trim"), ("b", "y", "normalize-date")]


def test_source_dedup_and_columns():
    a = Rule("a", [RuleSource("*.csv", 1)], [RuleField("h", "x", 0)])
    b = Rule("b", [RuleSource("*.csv", 1), RuleSource("*.csv", 2)], [RuleField("h", "y", 0)])
    plan = plan_rules([a, b])
    assert plan.columns == ["x", "y"]
    assert [(s[1], s[7]) for s in plan.sources] == [(0, 1), (1, 2)]
    assert len(plan.warnings) == 1


def test_validators():
    assert _code(validate_big_table, BigTableConfig("f", "")) == "BIGTABLE_NO_NAME"
    assert _code(validate_big_table, BigTableConfig("f", "t", [BigTableField("a", "DATE")])) == "BIGTABLE_BAD_TYPE"
    assert _code(validate_big_table, BigTableConfig("f", "t", [BigTableField("a"), BigTableField("a")])) == \
        "BIGTABLE_DUP_FIELD"
    assert _code(validate_pipeline, CleanPipeline("", "/d", "f")) == "PIPELINE_NO_ID"
    assert _code(validate_pipeline, SqlCleanPipeline("m", [], "SELECT 1", "r")) == "BIG_TABLES_REQUIRED"
    assert _code(validate_pipeline, QueryPipeline("q", " ", "r")) == "SQL_REQUIRED"
    assert _code(check_mappings, []) == "MAPPING_EMPTY"
    assert _code(check_mappings, [Mapping("", "x")]) == "MAPPING_NO_SOURCE"
    assert _code(check_mappings, [Mapping("a", "")]) == "MAPPING_NO_OUTPUT"
    assert _code(check_mappings, [Mapping("a", "x", "upper")]) == "MAPPING_BAD_TRANSFORM"


def test_reader_guard():
    assert is_reader("  select 1") and is_reader("WITH a AS (SELECT 1) SELECT * FROM a")
    assert not is_reader("/* c */ SELECT 1") and not is_reader("(SELECT 1)") and not is_reader("DELETE FROM t")
