"""Calendar parts, truncation, season and night attribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ts: Column | str, duration: str) -> Column:
    """Floor a TIMESTAMP_NTZ to a fixed duration ('30 minutes', '1 hour').

    Tumbling ``window().start`` keeps the NTZ type (``date_trunc`` would
    return a zoned TIMESTAMP).
    """
    return F.window(_c(ts), duration).start


def year(c: Column | str) -> Column:
    return F.year(_c(c))


def month(c: Column | str) -> Column:
    return F.month(_c(c))


def hour(c: Column | str) -> Column:
    return F.hour(_c(c))


def month_day(c: Column | str) -> Column:
    """month*100 + day, the comparison key of a season window."""
    c = _c(c)
    return F.month(c) * 100 + F.dayofmonth(c)


def in_season(c: Column | str, start_md: int = 621, end_md: int = 921) -> Column:
    """Inclusive month/day window; wraps over New Year when start > end."""
    md = month_day(c)
    if start_md <= end_md:
        return md.between(start_md, end_md)
    return (md >= start_md) | (md <= end_md)


def is_night(ts: Column | str, first_hour: int = 23, last_hour: int = 5) -> Column:
    """Night readings: hour ≥ first_hour or hour ≤ last_hour."""
    h = F.hour(_c(ts))
    return (h >= first_hour) | (h <= last_hour)


def night_date(ts: Column | str, last_hour: int = 5) -> Column:
    """Early-morning readings belong to the previous evening's night."""
    ts = _c(ts)
    return F.when(F.hour(ts) <= last_hour, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))


# Month labels used by the reports (English short names).
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
                "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_label(m: Column | str) -> Column:
    """Month number → short label (B20); ``try_element_at`` gives null when out of range."""
    return F.try_element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), _c(m).cast("int"))


def hour_label(h: Column | str) -> Column:
    """Hour number → 'HH:00' (B20); null when out of range."""
    h = _c(h).cast("int")
    return F.when(h.between(0, 23), F.format_string("%02d:00", h))


def seconds_between(start: str, end: str) -> Column:
    """Whole seconds from column ``start`` to column ``end``."""
    return F.expr(f"timestampdiff(SECOND, `{start}`, `{end}`)")


def hours_between(start: str, end: str) -> Column:
    """Elapsed hours from column ``start`` to column ``end``."""
    return F.expr(f"timestampdiff(MICROSECOND, `{start}`, `{end}`)") / F.lit(3.6e9)
