"""Cleaning and ingestion analyses (Q29-Q31, B-series, S-series)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rainfold.functions.calendar import month_label
from rainfold.functions.clean import (COMPASS_DEGREES, compass_to_degrees, report_int, report_number,
                                      report_time, report_wind_dir, sentinel_to_null, strip_approx_mark,
                                      text_to_double)
from rainfold.operators.combine import all_keys, outer_merge, union_eras
from rainfold.session import scratch_path
from rainfold.sources import reports
from rainfold.sources.files import drop_stray_index
from rainfold.sources.fixtures import messy_text_view
from rainfold.sources.manifest import candidate_sources, month_manifest
from rainfold.sources.stored import first_existing, read_csv_rows, read_picked, route, stored_names, write_documents


def clean_report_text(messy: DataFrame) -> DataFrame:
    """B5-B13 applied to report-style text columns."""
    return messy.select(
        "event_id",
        compass_to_degrees("raw_wind_dir").alias("wind_deg"),
        report_wind_dir("raw_wind_dir").alias("wind_dir_norm"),
        report_number("raw_number").alias("number"),
        report_int("raw_number").alias("number_int"),
        text_to_double(strip_approx_mark(sentinel_to_null("raw_number"))).alias("plain_number"),
        report_time("raw_time").alias("time_hhmm"))


def category_audit(messy: DataFrame) -> DataFrame:
    """Raw direction values that map to no angle (NULL included)."""
    return messy.where(compass_to_degrees("raw_wind_dir").isNull()).select("raw_wind_dir").distinct()


def two_era_city_table(daily: DataFrame, split_month: str = "1998-01-01", dedupe: str | None = None) -> DataFrame:
    """The same daily table delivered by two eras with different
    names and a shared overlap month, renamed to one schema, wind
    direction converted from compass text, and unioned by name."""
    idx = F.pmod(F.floor(F.col("T_max") * 100), F.lit(16)).cast("int")
    compass = F.array(*[F.lit(k) for k in COMPASS_DEGREES])
    split = F.lit(split_month).cast("date")
    base = daily.withColumn("_idx", idx)
    old = base.where(F.col("date") < F.add_months(split, 1)).select(
        "station", "date", F.col("T_max").alias("max"), F.col("T_min").alias("min"), F.col("T_avg").alias("avg"),
        F.col("rain_mm").alias("rain"), (F.col("_idx") * 22.5).alias("wind_dir"),
        (F.col("T_avg") - 20).alias("dep_from_normal"))
    new = base.where(F.col("date") >= split).select(
        "station", "date", F.col("T_max").alias("max_temp_c"), F.col("T_min").alias("min_temp_c"),
        F.col("T_avg").alias("mean_temp_c"), "rain_mm", F.get(compass, F.col("_idx")).alias("dom_wind_dir"),
        F.lit("txt").alias("source_format"))
    old_c = (old.withColumnsRenamed({"max": "T_max", "min": "T_min", "avg": "T_avg", "rain": "rain_mm"})
             .drop("dep_from_normal"))
    new_c = (new.withColumnsRenamed({"max_temp_c": "T_max", "min_temp_c": "T_min", "mean_temp_c": "T_avg"})
             .withColumn("wind_dir", compass_to_degrees("dom_wind_dir")).drop("dom_wind_dir", "source_format"))
    u = union_eras([old_c, new_c], key=["station", "date"], dedupe=dedupe)
    return u.select("station", "date", F.year("date").alias("year"), F.month("date").alias("month"),
                    F.dayofmonth("date").alias("day"), "T_max", "T_min", "T_avg", "rain_mm", "wind_dir")


def text_roundtrip(daily: DataFrame) -> DataFrame:
    """Render monthly text reports from the daily table and parse them back."""
    docs = reports.render_text_reports(reports.report_values(daily))
    return reports.parse_text_reports(docs, keys=("station", "year", "month", "url")).withColumnRenamed("url", "source_url")


def html_roundtrip(daily: DataFrame) -> DataFrame:
    """S8 (+S4 cell extraction): render row-wise HTML monthly reports and parse them back."""
    docs = reports.render_html_reports(reports.report_values(daily))
    return reports.parse_html_rows(docs, keys=("station", "year", "month", "url")).withColumnRenamed("url", "source_url")


def ingest_ledger(daily: DataFrame, pages: DataFrame) -> DataFrame:
    """Text reports, HTML reports and raw web pages through one
    dispatcher; documents and rows per (format, status).  Every document is
    judged inside its own row, so no identity is needed and none is merged."""
    values = reports.report_values(daily)
    txt = reports.render_text_reports(values).select("url", "body")
    html = reports.render_html_reports(values).select("url", "body")
    web = pages.select("url", F.col("html").alias("body"))
    return reports.ledger_summary(reports.ledger(txt.unionByName(html).unionByName(web), keys=()))


def day_page_roundtrip(halfhourly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Render half-hourly day pages and parse them back; returns (rows, rejects)."""
    return reports.parse_day_pages(reports.render_day_pages(halfhourly))


def stacked_roundtrip(daily: DataFrame) -> DataFrame:
    """Render column-stacked monthly reports and parse them back."""
    return reports.parse_stacked_reports(reports.render_stacked_reports(daily))


def page_ledger(pages: DataFrame) -> DataFrame:
    """(page_id, year, month, url, format, status, message, rows) of
    every page; year and month are read from the url where it has them."""
    docs = pages.select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("body"))
    when = r"/((?:19|20)[0-9]{2})/(0?[1-9]|1[0-2])(?![0-9])"
    url = F.coalesce("url", F.lit(""))
    return reports.ledger(docs).select(
        F.col("doc_id").alias("page_id"), F.regexp_extract(url, when, 1).try_cast("int").alias("year"),
        F.regexp_extract(url, when, 2).try_cast("int").alias("month"), "url", "format", "status", "message", "rows")


def document_report_lines(documents: DataFrame) -> DataFrame:
    """Per document its lines and those that match the report pattern."""
    return reports.line_counts(documents.select("doc_id", F.col("text").alias("body")))


# ------------------------------------------------------------ stored reports

def store_reports(daily: DataFrame, folder: str) -> None:
    """Write each month's reports under their candidate names: by (year +
    month) mod 4 text only, HTML only, both, or none."""
    values = reports.report_values(daily)
    names = candidate_sources(daily.select("station", F.trunc("date", "month").alias("month_start")).distinct(), ["station"])
    names = names.withColumn("year", F.year("month_start")).withColumn("month", F.month("month_start"))
    kind = F.pmod(F.col("year") + F.col("month"), F.lit(4))
    text = reports.render_text_reports(values).drop("url").join(names.where(F.col("priority") == 0), ["station", "year", "month"]).where(kind.isin(0, 2))
    html = reports.render_html_reports(values).drop("url").join(names.where(F.lower("url").endswith(".html")), ["station", "year", "month"]).where(kind.isin(1, 2))
    both = text.select("station", "url", "body").unionByName(html.select("station", "url", "body"))
    named = both.select(F.concat_ws("/", F.regexp_replace("station", "[^A-Za-z0-9]+", "_"), "url").alias("name"), "body")
    write_documents(named, folder).agg(F.sum("bytes")).collect()   # one number; the files are written


def stored_report_rows(spark, daily: DataFrame, folder: str) -> DataFrame:
    """Per station and month of the record: the name read, how many of its
    names exist, the document's format and status, and the report rows in it."""
    months = month_manifest(daily, ["station"])
    names = candidate_sources(months, ["station"]).withColumn("url", F.concat_ws("/", F.regexp_replace("station", "[^A-Za-z0-9]+", "_"), "url"))
    picked = first_existing(names, stored_names(spark, folder), ["station", "month_start"])
    docs = read_picked(spark, folder, picked.drop("status"))
    status = reports.ledger(docs, keys=("station", "month_start", "picked", "n_available"))
    return status.select("station", "month_start", "picked", "n_available",
                         F.when(F.col("picked").isNotNull(), F.col("format")).alias("format"), "status", "rows")


def csv_good_and_rejected(spark, events: DataFrame) -> DataFrame:
    """Messy rows written as CSV with a stray index column, read with a schema,
    routed in one pass; (event_id, status, value, record) of both parts."""
    messy = messy_text_view(events).select("event_id", F.when(F.col("raw_number") != " ", F.col("raw_number")).alias("value"))
    folder = scratch_path(spark, "csv")
    messy.select(F.col("event_id").alias("Unnamed: 0"), "event_id", "value").write.option("header", True).csv(f"{folder}/in")
    schema = T.StructType([T.StructField("Unnamed: 0", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    rows = drop_stray_index(read_csv_rows(spark, f"{folder}/in", schema))
    good, ledger, counts = route(rows, F.col("_corrupt_record").isNotNull(), F.lit("malformed row"), f"{folder}/out", ["event_id"])
    total = F.lit(counts["good"]).cast("long"), F.lit(counts["rejected"]).cast("long")
    return (good.select("event_id", F.lit("good").alias("status"), "value", F.lit(None).cast("string").alias("record"), total[0].alias("of"))
            .unionByName(ledger.select("event_id", "status", F.lit(None).cast("double").alias("value"), "record", total[1].alias("of"))))


def month_shares(first: DataFrame, second: DataFrame) -> DataFrame:
    """(station, month) of either source, the days each has in that month
    of the year and their per cent (one decimal, B22) of the station's days."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("station", F.month("date").alias("month")).agg(F.count(F.lit(1)).alias(name))
    a, b = counted(first, "first_days"), counted(second, "second_days")
    keys = all_keys([a, b], ["station", "month"])
    both = outer_merge([keys, a, b], ["station", "month"])
    days = F.coalesce("first_days", F.lit(0)) + F.coalesce("second_days", F.lit(0))
    share = F.round(100 * days / F.sum(days).over(Window.partitionBy("station")), 1)   # twelve rows a station
    return both.select("station", "month", month_label("month").alias("label"), "first_days", "second_days", share.alias("share_pct"))
