"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from . import (attention_lm, bpe_sql, chosen_path, cover_tree, host_rules, length_buckets, line_setjoin, quality_gam, shard_shuffle,
               target_resampling, token_counts, url_rules, vector_codes)
from .common import prepare, read


def _on(table, fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, read(spark, sf_dir, table))
    run.__doc__ = fn.__doc__
    return run


def _quality(spark, sf_dir):
    prepare(spark)
    return quality_gam.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _resampling(spark, sf_dir):
    prepare(spark)
    return target_resampling.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries():
    return {
        "op1_quality_gam": _quality,
        "op2_cover_tree": _on("embeddings", lambda s, d: cover_tree.query(d)),
        "op3_bpe_sql": _on("documents", lambda s, d: bpe_sql.query(d)),
        "op4_external_shuffle": _on("documents", lambda s, d: shard_shuffle.query(d)),
        "op5_url_rules": _on("pages", url_rules.query),
        "op6_attention_lm": _on("documents", lambda s, d: attention_lm.query(d)),
        "op7_length_buckets": _on("documents", lambda s, d: length_buckets.query(d)),
        "op8_host_rules": _on("documents", lambda s, d: host_rules.query(d)),
        "op9_chosen_path": _on("documents", lambda s, d: chosen_path.query(d)),
        "op10_line_setjoin": _on("documents", lambda s, d: line_setjoin.query(d)),
        "op11_regular_sampling": _resampling,
        "op12_resident_lloyd": _on("embeddings", lambda s, d: vector_codes.query(d)),
        "op13_whole_tokens": _on("documents", lambda s, d: token_counts.query(d)),
    }


def oracle_sql():
    """SQL has no boosting, self-attention, byte-level merges by rank file or dynamic program over
    a histogram here: operators 1, 3, 4, 6, 7 and 13 are tested against brute force in ``tests/llm``."""
    return {"op2_cover_tree": cover_tree.ORACLE, "op5_url_rules": url_rules.ORACLE, "op8_host_rules": host_rules.ORACLE,
            "op9_chosen_path": chosen_path.ORACLE, "op10_line_setjoin": line_setjoin.ORACLE,
            "op11_regular_sampling": target_resampling.ORACLE, "op12_resident_lloyd": vector_codes.ORACLE}
