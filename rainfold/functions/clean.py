"""Text and value cleaning (B5-B16, B22-B29) as native Column expressions.

All casts use ``try_*`` variants: ANSI mode is on by default, so a plain
CAST of a malformed string would fail the job instead of yielding null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text sentinels that mean "missing" in the daily reports.
MISSING_SENTINELS = ["-----", "---", "-", ""]

# 16-point compass rose in degrees.
COMPASS_DEGREES = {
    "N": 0.0, "NNE": 22.5, "NE": 45.0, "ENE": 67.5,
    "E": 90.0, "ESE": 112.5, "SE": 135.0, "SSE": 157.5,
    "S": 180.0, "SSW": 202.5, "SW": 225.0, "WSW": 247.5,
    "W": 270.0, "WNW": 292.5, "NW": 315.0, "NNW": 337.5,
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN is a value in Spark (counted, compared, poisons sums): map it to NULL once, at load."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column | str) -> Column:
    """Report sentinels ('-----', '---', '-', '') become NULL."""
    c = _c(c)
    return F.when(~c.isin(*MISSING_SENTINELS), c)


def strip_approx_mark(c: Column | str) -> Column:
    """Remove the literal '~' approximation mark."""
    return F.replace(_c(c), F.lit("~"), F.lit(""))


# A decimal number as reports print it; the engine's own cast also takes type
# suffixes, hexadecimal, 'nan' and 'infinity', which are no readings.
DECIMAL_PATTERN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# White space as a text parser strips it (blanks, tabs, line ends, no-break space).
EDGE_SPACE = " \t\n\x0b\x0c\r\u00a0"


def strip_text(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(_c(c), F.lit(EDGE_SPACE))


def decimal_or_null(c: Column) -> Column:
    """Text that is a decimal number → double, anything else → NULL."""
    return F.when(c.rlike(DECIMAL_PATTERN), c.try_cast("double"))


def text_to_double(c: Column | str) -> Column:
    """Text → double, malformed → NULL."""
    return decimal_or_null(strip_text(c))


def report_number(c: Column | str) -> Column:
    """Lenient report number.

    trim → ',' to '.' → drop '~' → 'O'/'o' to '0' → drop '—' → drop '--' pairs
    (an odd dash run leaves one '-', which then fails the cast) → blank or
    dash-only → NULL → try_cast double.
    """
    v = strip_text(c)
    v = F.replace(v, F.lit(","), F.lit("."))
    v = F.replace(v, F.lit("~"), F.lit(""))
    v = F.translate(v, "Oo", "00")
    v = F.replace(v, F.lit("—"), F.lit(""))
    v = F.replace(v, F.lit("--"), F.lit(""))
    return F.when(~v.isin("", "-"), decimal_or_null(v))


def report_int(c: Column | str) -> Column:
    """B10: 'O'/'o' read as zero, digits only, else NULL."""
    v = F.translate(strip_text(c), "Oo", "00")
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("int"))


def report_time(c: Column | str) -> Column:
    """B11: ';' typo to ':', 'H:MM' padded to 'HH:MM', out of range → NULL."""
    v = F.replace(strip_text(c), F.lit(";"), F.lit(":"))
    pat = r"^(\d{1,2}):(\d{2})$"
    hh = F.regexp_extract(v, pat, 1).try_cast("int")
    mm = F.regexp_extract(v, pat, 2).try_cast("int")
    ok = v.rlike(pat) & hh.between(0, 23) & mm.between(0, 59)
    return F.when(ok, F.format_string("%02d:%02d", hh, mm))


def report_wind_dir(c: Column | str) -> Column:
    """Trim, upper case, digit '5' misread for 'S'."""
    return F.translate(F.upper(strip_text(c)), "5", "S")


def compass_to_degrees(c: Column | str) -> Column:
    """Compass point → degrees; numeric text passes through; else NULL."""
    mapping = F.create_map(*[x for k, v in COMPASS_DEGREES.items() for x in (F.lit(k), F.lit(v))])
    key = F.upper(strip_text(_c(c).cast("string")))
    return F.coalesce(F.try_element_at(mapping, key), decimal_or_null(key))


def iso_date(y: Column | str, m: Column | str, d: Column | str) -> Column:
    """Date from parts; impossible dates (e.g. 30 Feb) → NULL instead of an error."""
    return F.to_date(F.try_make_timestamp_ntz(_c(y), _c(m), _c(d), F.lit(0), F.lit(0), F.lit(0)))


def status_label(pct: Column, threshold: float, ok: str = "OK", bad: str = "Incomplete") -> Column:
    """B25."""
    return F.when(pct >= threshold, F.lit(ok)).otherwise(F.lit(bad))
