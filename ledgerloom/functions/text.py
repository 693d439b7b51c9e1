"""Text helpers shared by transforms and header work (JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set that the reference's trim/strip treats as blank
# (ECMAScript WhiteSpace + LineTerminator), as one Java regex character class.
WS_CLASS = (
    "[\\t\\n\\x{000B}\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)

# The same set as literal characters (for translate / btrim, which need no regex).
WS_CHARS = ("\t\n\u000b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")
NUMBER_CHARS = "0123456789+-.eE"

# Decimal number grammar accepted by the numeric coercions (hex, binary and
# Infinity are rejected on purpose; see README, trap T1).
NUMBER_RE = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def js_trim(c: Column) -> Column:
    """Trim Unicode whitespace at both ends (Spark's trim only strips ASCII space)."""
    return F.btrim(c, F.lit(WS_CHARS))


def only_number_chars(text: Column) -> Column:
    """True when ``text`` holds only digits, signs, '.', 'e' / 'E' -- with it a
    successful double cast means the decimal grammar (Java's parser would also
    take hex floats, 'NaN', 'Infinity' and '1d' suffixes, which this rules out)."""
    return F.translate(text, NUMBER_CHARS, "") == F.lit("")


def parse_number(text: Column) -> Column:
    """Text -> DOUBLE under the decimal grammar, NULL otherwise. Empty text is 0
    (the reference's numeric parse of an empty string)."""
    return (F.when(text == F.lit(""), F.lit(0.0))
             .when(only_number_chars(text), text.try_cast("double")))
