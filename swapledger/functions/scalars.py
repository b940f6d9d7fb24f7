"""Column expressions: parsing, names, dates, maths."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- text and numbers -------------------------------------------------------


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def strip_quotes(c: Column) -> Column:
    """Trim, drop one pair of surrounding double quotes, trim again."""
    t = F.trim(c)
    quoted = F.startswith(t, F.lit('"'))
    # Only text with a line break needs the expression, whose dot and end know such breaks.
    plain = quoted & F.endswith(t, F.lit('"')) & (F.translate(t, _BREAKS, "") == t)
    return F.trim(
        F.when(plain & (F.length(t) > 1), F.substring(t, F.lit(2), F.length(t) - 2))
        .when(quoted & ~plain, F.regexp_replace(t, '^"(.*)"$', "$1")).otherwise(t)
    )


#: What a dot of a regular expression does not match.
_BREAKS = "\n\r\u0085\u2028\u2029"


def lenient_double(c: Column) -> Column:
    """Number from text such as ``.250``; blanks, dashes, NaN and garbage give NULL."""
    t = F.trim(c.cast("string"))
    x = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return x


def lenient_int(c: Column) -> Column:
    """Integer from text such as ``6.0``, truncating."""
    x = lenient_double(c)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def lenient_int_half_even(c: Column) -> Column:
    return F.bround(lenient_double(c), 0).cast("long")


def money(c: Column) -> Column:
    """``$28,216,944`` to a whole number; ``-`` and ``n/a`` to NULL."""
    t = F.btrim(F.translate(c, "$,", ""), F.lit(" \t\n"))
    # A failing cast costs far more than this test; a number has a digit or is spelt out.
    return F.floor(F.when(t.rlike("(?i)[0-9]|inf|nan"), t.try_cast("double"))).cast("long")


def height_inches(c: Column) -> Column:
    """``6' 4"`` to 76."""
    feet = F.regexp_extract(c, r"^\s*(\d+)'\s*(\d+)", 1).try_cast("int")
    inches = F.regexp_extract(c, r"^\s*(\d+)'\s*(\d+)", 2).try_cast("int")
    return feet * 12 + inches


# -- dates -------------------------------------------------------------------


def tolerant_date(c: Column) -> Column:
    """ISO date or the date part of an ISO datetime; anything else is NULL."""
    return F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(T.*)?$", 1).try_cast("date")


def compact_date(c: Column, placeholder_to_new_year: bool = False) -> Column:
    """``yyyymmdd``; with the flag a zero month or day means January 1 of the year."""
    y, m, d = (F.substring(c, p, n) for p, n in ((1, 4), (5, 2), (7, 2)))
    plain = F.concat_ws("-", y, m, d).try_cast("date")
    if placeholder_to_new_year:
        plain = F.when(
            (m == "00") | (d == "00"), F.concat_ws("-", y, F.lit("01"), F.lit("01")).try_cast("date")
        ).otherwise(plain)
    return F.when(c.rlike(r"^\d{8}$"), plain)


def birth_date(known: Column, year: Column, month: Column, day: Column) -> Column:
    """Known date, else one built from parts with defaults 1900 / July / 1."""
    return F.coalesce(
        known,
        F.make_date(
            F.coalesce(year, F.lit(1900)), F.coalesce(month, F.lit(7)), F.coalesce(day, F.lit(1))
        ),
    )


def completed_years(birth: Column, on: Column) -> Column:
    return F.floor(F.months_between(on, birth) / 12).cast("int")


# -- names -------------------------------------------------------------------

def _folds() -> tuple[str, str]:
    """Accented letters of the Latin blocks and the plain letters that they decompose to."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and plain.isalpha():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()


def name_key(c: Column) -> Column:
    """Trim, lower, keep ``[a-z0-9 ]`` only (accented letters are lost)."""
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9 ]", "")


def canonical_name(c: Column) -> Column:
    """Fold accents, drop dots, hyphens to blanks, drop a generation suffix, squeeze, lower."""
    folded = F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    spaced = F.translate(F.regexp_replace(folded, r"\.", ""), "-", " ")
    unsuffixed = F.regexp_replace(spaced, r"(?i)\s+(jr|sr|ii|iii|iv)\.?$", "")
    return F.lower(F.trim(F.regexp_replace(unsuffixed, r"\s+", " ")))


# -- lookups -----------------------------------------------------------------


def lookup(values: Mapping, key: Column, default=None) -> Column:
    """Constant map lookup; ``default`` may be a Column or a plain value."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def alias_code(values: Mapping, code: Column) -> Column:
    """Alias map with the code itself as default."""
    return lookup(values, code, code)


# -- maths -------------------------------------------------------------------


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c))


def signed_log(c: Column, unit: float = 1e6) -> Column:
    return F.signum(c) * F.log1p(F.abs(c) / unit)


def signed_log_inverse(c: Column, unit: float = 1e6, limit: float = 20.0) -> Column:
    x = clamp(c, -limit, limit)
    return F.signum(x) * F.expm1(F.abs(x)) * unit


def winsorise(c: Column, mean: Column, sd: Column, width: float = 5.0) -> Column:
    return F.least(mean + sd * width, F.greatest(mean - sd * width, c))


def z_score(c: Column, mean: Column, sd: Column) -> Column:
    return (c - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


# Coefficients of the rational error-function approximation 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function by polynomial; Spark SQL has none built in."""
    u = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    y = 1.0 - poly * F.exp(-u * u)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2.0)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)


def logistic(z: Column, low: float = 0.02, high: float = 0.97) -> Column:
    return clamp(1.0 / (1.0 + F.exp(-z)), low, high)
