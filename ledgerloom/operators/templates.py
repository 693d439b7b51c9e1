"""Apply a saved mapping template to a sheet's canonical headers.

A template is a list of mappings (``source_header, output_name, transform``);
mappings whose header is one of the sheet's canonical names are kept
(``matched``), the others are reported as ``skipped``. Semi / anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_template(canon: DataFrame, template: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``template``: keys + source_header, output_name, transform (one row per sheet x
    mapping). Returns (matched mappings, skipped headers)."""
    names = canon.select(*keys, F.col("name").alias("source_header"))
    matched = template.join(names, keys + ["source_header"], "left_semi")
    skipped = template.join(names, keys + ["source_header"], "left_anti")
    return matched, skipped


def template_report(canon: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """H11 for many sheets at once: per sheet the number of template mappings
    whose header exists and the sorted list of template headers that do not.
    ``template``: source_header, output_name, transform (bounded by the template
    size, so it is broadcast)."""
    t = F.broadcast(template.select("source_header").distinct())
    hits = canon.join(t, canon["name"] == t["source_header"]).groupBy(*keys) \
                .agg(F.collect_set("source_header").alias("_hit"))
    all_headers = sorted(r["source_header"] for r in template.select("source_header").distinct().collect())
    sheets = canon.select(*keys).distinct()
    return (sheets.join(hits, keys, "left")
                  .select(*keys, F.coalesce(F.size("_hit"), F.lit(0)).alias("matched"),
                          F.array_sort(F.array_except(F.array(*[F.lit(h) for h in all_headers]),
                                                      F.coalesce(F.col("_hit"), F.array().cast("array<string>"))))
                          .alias("skipped")))
