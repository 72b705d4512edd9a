"""String expressions shared by all operators. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that must match Unicode word characters, digits and spaces.
PERIOD = r"(?iuU)\b(?:(fy|cy|ay)\s*)?(\d{4})(?:\s*[-/]\s*\d{2,4})?\b|\bq[1-4](?:\s*fy?\s*\d{2,4})?\b"
PERIOD_PLAIN_QUARTER = r"(?iuU)\b(?:(fy|cy|ay)\s*)?(\d{4})(?:\s*[-/]\s*\d{2,4})?\b|\bq[1-4]\b"
AMOUNT = r"(?U)[-+]?\d+(?:,\d{3})*(?:\.\d+)?"
SPACE = r"(?U)\s+"
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # what \s is in SPACE
UNEVEN_SPACE = r"(?U)\s{2,}|[\s&&[^ ]]"  # all of SPACE but single blanks, so that most texts have no match


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounds_down(x: Column, exponent: Column) -> Column:
    """Is the shortest decimal form of positive ``x`` a tie at the sixth digit that must not be rounded up?

    With the seventh digit a final 5 the decimal form alone does not tell. The product of x and a power of ten
    is split into its rounded value and its exact rest; both say on which side of the tie x lies, and no
    difference means an exact tie, which goes to the even digit.
    """
    scale = F.pow(F.lit(10.0), 6 - exponent)
    split = lambda v: v * 134217729.0 - (v * 134217729.0 - v)  # noqa: E731  upper half of a double's bits
    xh, sh = split(x), split(scale)
    rest = ((xh * sh - x * scale) + xh * (scale - sh) + (x - xh) * sh) + (x - xh) * (scale - sh)
    seven = F.rint(x * scale)
    past = (x * scale - seven) + rest
    small = (seven / scale == x) & (seven % 10 == 5) & ((past < 0) | ((past == 0) & (F.floor(seven / 10) % 2 == 0)))
    unit = F.pow(F.lit(10.0), exponent - 5)
    large = (x % unit == unit / 2) & (F.floor(x / unit) % 2 == 0)
    return F.when(exponent <= 6, small).otherwise(large)


def fmt_g(number: Column) -> Column:
    """Six significant digits, rounded half to even on the exact binary value, trailing zeros dropped, exponent form
    below 1e-4 and from 1e6 on. Denormal numbers keep Java's shorter digits."""

    def digits(x: Column) -> Column:  # of a positive number, as d.ddddde+xx
        exponent = F.substring_index(F.format_string("%.16e", x), "e", -1).cast("int")
        down = let(exponent, lambda e: F.when(_rounds_down(x, e), F.floor(x / F.pow(F.lit(10.0), e - 5)) * F.pow(F.lit(10.0), e - 5)).otherwise(x))
        return F.format_string("%.5e", down)

    def plain(e: Column) -> Column:
        mantissa, x = F.replace(F.substring_index(e, "e", 1), F.lit("."), F.lit("")), F.substring_index(e, "e", -1).cast("int")
        whole = F.concat(F.substr(mantissa, F.lit(1), x + 1), F.lit("."), F.substr(mantissa, x + 2))
        part = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), mantissa)
        short = F.regexp_replace(F.regexp_replace(F.substring_index(e, "e", 1), "0+$", ""), r"\.$", "")
        return F.when((x < -4) | (x >= 6), F.concat(short, F.lit("e"), F.substring_index(e, "e", -1))).otherwise(
            F.regexp_replace(F.regexp_replace(F.when(x >= 0, whole).otherwise(part), "0+$", ""), r"\.$", "")
        )

    def shown(v: Column) -> Column:
        sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
        return (
            F.when(F.isnan(v), F.lit("nan"))
            .when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf")))
            .when(v == 0, F.lit("0"))
            .otherwise(F.concat(sign, let(digits(F.abs(v)), plain)))
        )

    return let(number.cast("double"), shown)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squash(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text(c), UNEVEN_SPACE, " "))


def strip(c: Column) -> Column:
    return F.trim(text(c), F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def normalize_token(c: Column) -> Column:
    return squash(F.replace(F.replace(F.lower(text(c)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))


def strip_period_tokens(c: Column, pattern: str = PERIOD) -> Column:
    return F.regexp_replace(text(c), pattern, " ")


def to_snake(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(normalize_token(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit("value")).otherwise(out)


def joined(*parts: Column) -> Column:
    """Parts (null: empty) with one blank between each two; blanks of empty parts stay, as substring tests see them."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), map(text, parts))


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    if not cases:
        return otherwise
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def word_in(c: Column, words: str) -> Column:
    """Does one of the alternatives stand as a word in ``c``?"""
    return c.rlike(rf"(?iuU)\b(?:{words})\b")


def statement(attribute: Column, value: Column, unit: Column) -> Column:
    """``attribute = value unit``; the unit is left out where the value already holds it."""
    v, u = strip(value), strip(unit)
    full = F.when((u != "") & (F.instr(F.lower(v), F.lower(u)) == 0), F.trim(F.concat(v, F.lit(" "), u))).otherwise(v)
    return F.regexp_replace(F.concat(strip(attribute), F.lit(" = "), full), "^[ =]+|[ =]+$", "")


def merge_reasons(reasons: Column) -> Column:
    """Distinct non-empty reasons of an array, in order, joined by ``; ``."""
    return F.array_join(F.array_distinct(F.filter(reasons, lambda r: F.coalesce(F.trim(r), F.lit("")) != "")), "; ")


def clamp_confidence(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))  # greatest skips nulls


def optional(c: Column) -> Column:
    """Blank and spelled-out absences become null."""
    trimmed = strip(c)
    return F.when(~F.lower(trimmed).isin("", "null", "none", "n/a", "na"), trimmed)


def like_contains(c: Column, query: str) -> Column:
    """ASCII case-insensitive substring search in which ``%`` and ``_`` of the query are wildcards."""
    import string

    up, low = string.ascii_uppercase, string.ascii_lowercase
    pattern = query.translate(str.maketrans(up, low)).replace("\\", "\\\\")
    return F.translate(text(c), up, low).like(f"%{pattern}%")


SPREAD = 4


def spread(rows: DataFrame) -> DataFrame:
    """Rows in equal parts, ``SPREAD`` a core, ahead of expressions that cost far more than reading: files are few and of unequal size, and
    splits are cut by bytes, so a file's rows would be one task's work."""
    return rows.repartition(SPREAD * rows.sparkSession.sparkContext.defaultParallelism)
