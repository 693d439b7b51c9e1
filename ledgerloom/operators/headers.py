"""Header operators as DataFrame jobs.

H1 canonical naming, H2 resolve, H3 fail-run on ambiguity, H4 CR-insensitive
match, H8 unused headers, H9 mapping check. A header table is in *long* form:
``keys... , pos (0-based column), h (trimmed header text)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import js_trim


#: A header that is spelled like a numbered one: its text and its number.
_NUMBERED = "(?s)^(.*)_([1-9][0-9]*)$"


class DuplicateHeaderError(RuntimeError):
    code = "CLEAN_DUPLICATE_HEADER"


def header_long(header_rows: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """One row per header cell; each header is trimmed (Unicode whitespace)."""
    # outer: the optimizer would test the cells of an inner one where the rows are read, and so split every line to find the headers
    return header_rows.select(*keys, F.posexplode_outer(cells).alias("pos", "_h")).filter("pos IS NOT NULL") \
                      .withColumn("h", js_trim(F.coalesce(F.col("_h"), F.lit("")))).drop("_h")


def canonicalize(long: DataFrame, keys: list[str], materialize: bool = False) -> DataFrame:
    """H1: unique headers keep their text; a header seen N times becomes
    ``h_1 .. h_N`` in column order, skipping any number whose name is already a
    raw header of the same sheet. Adds ``name`` and ``cnt`` (occurrences of h).

    Exactness: two different groups can never generate the same name (the text
    after the last ``_`` is the number), so only raw names need excluding. With
    the excluded numbers of a group in order, the i-th of them, b_i, is passed by the
    m-th occurrence if fewer than m numbers below it are free (b_i - i < m): the m-th
    occurrence gets m plus the excluded numbers it passes, by one running count.
    A repeated header without a key or text has no name and is left out.
    """
    wk = Window.partitionBy(*keys, "h")
    df = (long.withColumn("cnt", F.count(F.lit(1)).over(wk))
              .withColumn("occ", F.row_number().over(wk.orderBy("pos"))))
    if materialize:
        # header tables are small; one reliable checkpoint feeds every branch below
        df = df.checkpoint(eager=True)
        if df.filter(F.col("cnt") > 1).limit(1).count() == 0:
            return df.withColumn("name", F.col("h")).drop("occ")
        long = df.select(*keys, "pos", "h")
    uniq = df.filter(F.col("cnt") == 1).withColumn("name", F.col("h"))
    rep = df.filter(F.col("cnt") > 1).dropna(subset=[*keys, "h"])
    numbered = long.select(*keys, F.regexp_extract("h", _NUMBERED, 1).alias("h"), F.expr("try_cast(nullif(regexp_extract(h, '%s', 2), '') AS bigint)" % _NUMBERED).alias("num"))
    excluded = numbered.filter(F.col("num").isNotNull()).dropna(subset=keys).distinct()
    excluded = excluded.withColumn("_ord", F.col("num") - F.row_number().over(Window.partitionBy(*keys, "h").orderBy("num")) + 1)
    both = rep.withColumns({"_ord": F.col("occ").cast("long"), "_own": F.lit(1)}) \
              .unionByName(excluded.drop("num").withColumn("_own", F.lit(0)), allowMissingColumns=True)
    passed = F.count_if(F.col("_own") == 0).over(
        Window.partitionBy(*keys, "h").orderBy("_ord", "_own").rowsBetween(Window.unboundedPreceding, 0))
    rep = both.withColumn("name", F.concat(F.col("h"), F.lit("_"), (F.col("_ord") + passed).cast("string"))) \
              .filter(F.col("_own") == 1).drop("_ord", "_own")
    return uniq.unionByName(rep).drop("occ")


def resolve(canon: DataFrame, wanted: DataFrame, keys: list[str], cr_possible: bool = True,
            dups_possible: bool = True) -> DataFrame:
    """H2 + H4. ``wanted``: keys + ``source_header`` (+ any payload). Adds ``idx``
    (0-based column, NULL when absent), ``via_cr`` (matched only after dropping
    ``\\r``) and ``status`` in {ok, duplicate, absent}."""
    names = canon.select(*keys, "name", "pos")
    exact = names.withColumnRenamed("name", "source_header").withColumnRenamed("pos", "_exact")
    nocr = names.withColumnRenamed("name", "_sh_nocr").withColumnRenamed("pos", "_crpos")
    dups = canon.filter(F.col("cnt") > 1).select(*keys, F.col("h").alias("source_header")).distinct() \
                .withColumn("_dup", F.lit(True))
    w = (wanted.withColumn("_sh_nocr", F.regexp_replace("source_header", "\r", ""))
               .join(exact, keys + ["source_header"], "left"))
    # the two fallbacks are skipped when the caller knows they cannot apply
    # (no CR in any mapped header / no repeated header in any sheet)
    w = w.join(nocr, keys + ["_sh_nocr"], "left") if cr_possible else \
        w.withColumn("_crpos", F.lit(None).cast("int"))
    w = w.join(dups, keys + ["source_header"], "left") if dups_possible else \
        w.withColumn("_dup", F.lit(None).cast("boolean"))
    cr_ok = F.col("_exact").isNull() & (F.col("_sh_nocr") != F.col("source_header")) & F.col("_crpos").isNotNull()
    status = (F.when(F.col("_exact").isNotNull(), F.lit("ok"))
               .when(F.col("_dup") == F.lit(True), F.lit("duplicate"))
               .when(cr_ok, F.lit("ok"))
               .otherwise(F.lit("absent")))
    return (w.withColumn("idx", F.when(F.col("_exact").isNotNull(), F.col("_exact"))
                                  .when(cr_ok & (F.col("_dup").isNull()), F.col("_crpos")))
             .withColumn("via_cr", cr_ok & F.col("_dup").isNull())
             .withColumn("status", status)
             .drop("_exact", "_crpos", "_sh_nocr", "_dup"))


def duplicate_names(canon: DataFrame, keys: list[str]) -> DataFrame:
    """Bare repeated header -> its numbered names, for H3 messages."""
    return (canon.filter(F.col("cnt") > 1).groupBy(*keys, "h")
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_n"))
                 .select(*keys, "h", F.transform("_n", lambda x: x["name"]).alias("names")))


def raise_on_duplicates(resolved: DataFrame, canon: DataFrame, keys: list[str], file_col: str) -> None:
    """H3: the whole run fails if any mapping names a repeated header bare."""
    bad = resolved.filter(F.col("status") == "duplicate").select(*keys, "source_header").limit(1).collect()
    if not bad:
        return
    b = bad[0]
    cond = [F.col(k) == F.lit(b[k]) for k in keys]
    names_row = (duplicate_names(canon, keys).filter(F.col("h") == F.lit(b["source_header"]))
                 .filter(_all(cond)).limit(1).collect())
    names = names_row[0]["names"] if names_row else []
    raise DuplicateHeaderError(
        f"{DuplicateHeaderError.code}: header {b['source_header']!r} occurs {len(names)} times in "
        f"{b[file_col]}; name one of {' / '.join(names)} in the mapping")


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def unused_headers(canon: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """H8: canonical names that no mapping of the matching rule references
    (CR-insensitive), distinct over files, sorted. ``used``: keys + source_header."""
    u = used.select(*keys, F.regexp_replace("source_header", "\r", "").alias("name")).union(
        used.select(*keys, F.col("source_header").alias("name")))
    return (canon.select(*keys, "name").join(u, keys + ["name"], "left_anti")
                 .select(F.col("name").alias("header")).distinct().orderBy("header"))


def mapping_check(canon: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """H9: a source header must hit (exactly or after dropping CR) in at least one
    matching file; otherwise it is ``duplicate`` when some file has it repeated,
    else ``missing``. ``fields``: keys + source_header (one row per file x field).
    Output: source_header, problem (NULL when fine)."""
    r = resolve(canon, fields, keys)
    g = r.groupBy("source_header").agg(
        F.bool_or(F.col("idx").isNotNull()).alias("hit"),
        F.bool_or(F.col("status") == "duplicate").alias("dup"))
    return g.select("source_header",
                    F.when(F.col("hit"), F.lit(None).cast("string"))
                     .when(F.col("dup"), F.lit("duplicate"))
                     .otherwise(F.lit("missing")).alias("problem"))
