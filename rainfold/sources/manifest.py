"""Calendar manifests and source selection.

Manifests are generated on the executors from per-key first/last dates
(one row per key), never on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_manifest(df: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """Every day from each key's first to last date, inclusive."""
    by = list(by)
    span = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(date))


def month_manifest(df: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """First day of every month between each key's first and last date."""
    by = list(by)
    span = df.groupBy(*by).agg(F.trunc(F.min(date), "month").alias("_lo"), F.trunc(F.max(date), "month").alias("_hi"))
    return span.select(*by, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))


def missing_days(df: DataFrame, by: Sequence[str], date: str = "date") -> DataFrame:
    """Manifest days with no row — the failed-days ledger."""
    by = list(by)
    return day_manifest(df, by, date).join(df.select(*by, date), [*by, date], "left_anti")


# Month names in the names of stored reports.
TEXT_MONTHS = ["Gener", "Febrer", "Mar", "Abril", "Maig", "Juny", "Juliol", "Agost", "Setembre", "Octubre", "Novembre", "Desembre"]
HTML_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def candidate_sources(months: DataFrame, by: Sequence[str], month: str = "month_start", base: str = "") -> DataFrame:
    """Per (keys, month) the names a report may be stored under, in the
    order in which they are tried: text, its variant for March, HTML.

    Repeated names of a month are listed once (the special name of January
    2018 is the ordinary HTML name)."""
    by = list(by)
    y, m = F.year(month), F.month(month)
    text, html = (F.get(F.array(*[F.lit(x) for x in names]), m - 1) for names in (TEXT_MONTHS, HTML_MONTHS))
    names = F.array_compact(F.array(
        F.format_string("%s%d/%s_%d_NOAA.TXT", F.lit(base), y, text, y),
        F.when(m == 3, F.format_string("%s%d/Mar_%d_NOAA.TXT", F.lit(base), y, y)),
        F.format_string("%s%d/%s%d/climatedataout%d%d.html", F.lit(base), y, html, y, m, y)))
    return months.select(*by, month, F.posexplode(F.array_distinct(names)).alias("priority", "url"))


def pick_source(available: DataFrame, keys: Sequence[str], source: str,
                candidates: Sequence[str]) -> DataFrame:
    """Per key, the first candidate (in the given priority order) that exists."""
    keys = list(keys)
    prio = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(source))
    ranked = available.select(*keys, source, prio.alias("_p")).where(F.col("_p") > 0)
    return ranked.groupBy(*keys).agg(F.min_by(source, "_p").alias("picked"),
                                     F.count_if(F.lit(True)).alias("n_available"))
