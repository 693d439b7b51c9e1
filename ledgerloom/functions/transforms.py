"""Value transforms and column coercion, all JVM-side Column expressions.

A source cell is the pair (``value`` STRING, ``kind`` STRING): kind ``s`` text,
``n`` number (value holds its shortest decimal text), ``b`` boolean
(``true``/``false``), ``e`` error (value NULL for the null-error code, ``''`` for
the others). CSV cells are always ``s``; a NULL kind means ``s``.

The transform registry maps a transform name to ``(value, kind) -> Column``; there
is no Python UDF anywhere on this path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import WS_CHARS, js_trim, only_number_chars, parse_number

# Rule transform kinds and their value transforms.
RULE_KIND_TO_TRANSFORM = {
    "coerce_cents": "to-cents",
    "coerce_date": "normalize-date",
    "coerce_string": "trim",
    "none": "none",
}
TRANSFORMS = ("none", "to-cents", "normalize-date", "trim")

# Money marks removed before parsing (thousands comma, yen/yuan signs).
MONEY_MARK_CHARS = ",¥￥"

# Excel 1900-system serial of 1970-01-01, and the last serial we
# treat as a date (9999-12-31); numbers above 20000 count as serials.
EXCEL_EPOCH_SERIAL = 25569
SERIAL_MIN_EXCLUSIVE = 20000
SERIAL_MAX = 2958465

DATE_YMD = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$"
DIGITS_DEC = "^[0-9]+(\\.[0-9]+)?$"


def _kind(kind: Column | None) -> Column:
    return F.coalesce(kind, F.lit("s")) if kind is not None else F.lit("s")


# Each transform is split into *prepare* levels (expensive intermediates, each
# computed once) and a *finish* expression over them. Spark does not share a
# sub-expression between CASE branches, so the clean stage materialises every
# level as its own projection; the one-shot Column functions below just inline
# the levels (fine for ad-hoc use).

# A prepare level is a function of the intermediates computed so far.
Level = Callable[[dict[str, Column]], dict[str, Column]]


def _prep_money(value: Column, kind: Column) -> list[Level]:
    return [lambda got: {"money": F.translate(value, MONEY_MARK_CHARS + WS_CHARS, "")}]


def _finish_number(value: Column, kind: Column, p: dict[str, Column]) -> Column:
    return (F.when(value.isNull() | (value == ""), F.lit(None).cast("double"))
             .when(kind == "n", value.try_cast("double"))
             .when(kind == "b", F.lit(None).cast("double"))
             .otherwise(parse_number(p["money"])))


def _finish_cents(value: Column, kind: Column, p: dict[str, Column]) -> Column:
    return round_half_up_cents(_finish_number(value, kind, p))


def _prep_trim(value: Column, kind: Column) -> list[Level]:
    return [lambda got: {"trim": js_trim(value)}]


def _prep_date(value: Column, kind: Column) -> list[Level]:
    return [lambda got: {"trim": js_trim(value)},
            lambda got: {"serial": F.when(got["trim"].rlike(DIGITS_DEC), got["trim"].try_cast("double"))}]


def _finish_date(value: Column, kind: Column, p: dict[str, Column]) -> Column:
    s, serial = p["trim"], p["serial"]
    ymd = F.concat_ws("-", F.regexp_extract(s, DATE_YMD, 1),
                      F.lpad(F.regexp_extract(s, DATE_YMD, 2), 2, "0"),
                      F.lpad(F.regexp_extract(s, DATE_YMD, 3), 2, "0"))
    millis = F.floor((serial - F.lit(EXCEL_EPOCH_SERIAL)) * F.lit(86400000.0) + F.lit(0.5))
    from_serial = F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")
    return (F.when(value.isNull() | (value == ""), F.lit(None).cast("string"))
             .when((serial > F.lit(SERIAL_MIN_EXCLUSIVE)) & (serial <= F.lit(SERIAL_MAX)), from_serial)
             .when(s.rlike(DATE_YMD), ymd)
             .otherwise(s))


def _finish_trim(value: Column, kind: Column, p: dict[str, Column]) -> Column:
    return F.when(p["trim"] == "", F.lit(None).cast("string")).otherwise(p["trim"])


def _finish_keep(value: Column, kind: Column, p: dict[str, Column]) -> Column:
    return value


# name -> (prepare levels, finish)
STAGED = {
    "none": (lambda v, k: [], _finish_keep),
    "to-cents": (_prep_money, _finish_cents),
    "normalize-date": (_prep_date, _finish_date),
    "trim": (_prep_trim, _finish_trim),
}


def _inline(name: str, value: Column, kind: Column | None) -> Column:
    prep, finish = STAGED[name]
    k = _kind(kind)
    got: dict[str, Column] = {}
    for level in prep(value, k):
        got.update(level(got))
    return finish(value, k, got)


def to_number(value: Column, kind: Column | None = None) -> Column:
    """Cell -> DOUBLE; money marks and whitespace are removed from text first."""
    k = _kind(kind)
    got: dict[str, Column] = {}
    for level in _prep_money(value, k):
        got.update(level(got))
    return _finish_number(value, k, got)


def round_half_up_cents(n: Column) -> Column:
    """Math.round(n * 100): half rounds toward +inf. Out-of-range -> NULL."""
    x = n * F.lit(100.0)
    return F.when(F.abs(x) < F.lit(9.0e18), F.floor(x + F.lit(0.5)).cast("bigint"))


def to_cents(value: Column, kind: Column | None = None) -> Column:
    """Money -> integer cents (BIGINT)."""
    return _inline("to-cents", value, kind)


def normalize_date(value: Column, kind: Column | None = None) -> Column:
    """Excel serial -> YYYY-MM-DD (UTC); Y-M-D with - / . separators ->
    zero padded; anything else (periods like 2024-01 included) stays, trimmed."""
    return _inline("normalize-date", value, kind)


def trim_text(value: Column, kind: Column | None = None) -> Column:
    """C4: trimmed text, blank -> NULL."""
    return _inline("trim", value, kind)


def keep(value: Column, kind: Column | None = None) -> Column:
    """The value as is ('' stays ''); only a missing cell is NULL."""
    return value


REGISTRY: dict[str, Callable[[Column, Column | None], Column]] = {
    "none": keep,
    "to-cents": to_cents,
    "normalize-date": normalize_date,
    "trim": trim_text,
}


# --- C7 / R5: column coercion into the declared column type -------------------

COLUMN_TYPES = ("TEXT", "INTEGER", "REAL")


def coerce_integer_text(s: Column) -> Column:
    """Text -> BIGINT when it is a number with an integral value, else NULL. Digits
    alone are read as they are (exact over the whole 64-bit range); only text with a
    point or an exponent goes through DOUBLE."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")).otherwise(coerce_parsed(numeric_text(s), "INTEGER"))


def coerce_real_text(s: Column) -> Column:
    return numeric_text(s)


def staged_projection(df, specs: list[tuple[str, set[str], str, str, str | None]], keep: list[str]):
    """Apply per-column transforms to ``df`` as successive projections.

    ``specs``: (result column, transforms used, value column, kind column, code
    column or None). Every prepare level becomes one projection, so each
    intermediate is computed once per row; a column fed by one transform
    compiles to just that transform, mixed columns branch on the row's code.
    Returns (DataFrame with ``keep`` + result columns, {result: is_cents})."""
    plans = []          # (result, {transform: (levels, finish)}, value, kind, code)
    depth = 0
    for res, ts, v, k, code in specs:
        ts = set(ts) or {"none"}
        per = {}
        for t in sorted(ts):
            prep, finish = STAGED[t]
            levels = prep(F.col(v), F.col(k))
            per[t] = (levels, finish)
            depth = max(depth, len(levels))
        plans.append((res, per, v, k, code))
    carry = list(dict.fromkeys(list(keep) + [c for _, _, v, k, code in plans for c in (v, k, code) if c]))
    got: dict[tuple[str, str], dict[str, Column]] = {}
    n = 0
    for lvl in range(depth):
        new, names = [], []
        for res, per, v, k, code in plans:
            for t, (levels, _) in per.items():
                if lvl < len(levels):
                    prev = got.setdefault((res, t), {})
                    for key, expr in levels[lvl](dict(prev)).items():
                        name = f"_s{n}"
                        n += 1
                        new.append(expr.alias(name))
                        names.append(name)
                        prev[key] = F.col(name)
        df = df.select(*[F.col(c) for c in carry], *new)
        carry += names
    out, cents = [], {}
    for res, per, v, k, code in plans:
        val, kind = F.col(v), F.col(k)
        if set(per) == {"to-cents"}:
            e, cents[res] = per["to-cents"][1](val, kind, got.get((res, "to-cents"), {})), True
        elif len(per) == 1:
            t = next(iter(per))
            e, cents[res] = per[t][1](val, kind, got.get((res, t), {})), False
        else:
            e = None
            for t, (_, finish) in sorted(per.items()):
                r = finish(val, kind, got.get((res, t), {}))
                r = r.cast("string") if t == "to-cents" else r
                e = F.when(F.col(code) == t, r) if e is None else e.when(F.col(code) == t, r)
            cents[res] = False
        out.append(e.alias(res))
    return df.select(*[F.col(c) for c in keep], *out), cents


def numeric_text(result: Column) -> Column:
    """Text -> DOUBLE under the number grammar (NULL otherwise); one level of the
    typed projection so the parse is done once per value."""
    t = F.trim(result)
    return F.when(only_number_chars(t) & (t != ""), t.try_cast("double"))


def coerce_parsed(parsed: Column, col_type: str) -> Column:
    """Typing from an already parsed DOUBLE (see :func:`numeric_text`)."""
    if col_type == "INTEGER":
        return F.when((parsed == F.floor(parsed)) & (F.abs(parsed) < F.lit(9.0e18)), parsed.cast("bigint"))
    return parsed


def coerce_column(result: Column, is_cents: bool, col_type: str) -> Column:
    """The transform result in the declared column type; a value that
    does not fit becomes NULL (and is counted as a reject by the caller)."""
    if is_cents:
        return {"INTEGER": result, "REAL": result.cast("double")}.get(col_type, result.cast("string"))
    if col_type == "INTEGER":
        return coerce_integer_text(result)
    if col_type == "REAL":
        return coerce_real_text(result)
    return result
