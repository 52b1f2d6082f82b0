"""Registry of named queries on the driver's fixture tables.

Each entry takes (spark, sf_dir) and returns a DataFrame whose columns are
named exactly like the matching SQL in ``rainfold.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.plans import rain_hours
from rainfold.plans.output import finalize
from rainfold.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _hh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.halfhourly_from_events(fx.load(spark, sf_dir, "events"))


def _dd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.daily_from_orders(fx.load(spark, sf_dir, "orders"))


DAY_COVERAGE = dict(period="day", expected=rain_hours.HOURS_PER_DAY, threshold=0.70)


@register("hour_profile_top3")
def q_hour_profile_top3(spark, sf_dir):
    df = rain_hours.hour_profile_top3(_hh(spark, sf_dir), **DAY_COVERAGE)
    return finalize(df.select("station", "hour", "mean_rain", "rank"))


# Fixture parameters shared by several queries.
SUMMER_DAYS_KW = dict(season=(621, 921), expected=93, threshold=0.70)
LEFT, RIGHT = "1-URGENT", "2-HIGH"          # two daily "stations" for comparisons
EV_LEFT, EV_RIGHT = "click", "view"         # two half-hourly "stations"
JAN_NIGHTS = (105, 125)                     # the events table covers January only


def _days(spark, sf_dir):
    from rainfold.plans import nights
    return nights.summer_days(_dd(spark, sf_dir), **SUMMER_DAYS_KW)


# ------------------------------------------------------------ rain by hour (Q1-Q6)

@register("hour_profile_extremes")
def q_hour_profile_extremes(spark, sf_dir):
    return finalize(rain_hours.hour_profile_extremes(_hh(spark, sf_dir), **DAY_COVERAGE))


@register("station_hour_comparison")
def q_station_hour_comparison(spark, sf_dir):
    df = rain_hours.station_hour_comparison(_hh(spark, sf_dir), EV_LEFT, EV_RIGHT, **DAY_COVERAGE)
    return finalize(df.select("hour", "mean_left", "mean_right", "difference"))


@register("month_hour_matrix")
def q_month_hour_matrix(spark, sf_dir):
    return finalize(rain_hours.month_hour_matrix(_hh(spark, sf_dir), **DAY_COVERAGE))


@register("distribution_shift")
def q_distribution_shift(spark, sf_dir):
    return finalize(rain_hours.distribution_shift(_hh(spark, sf_dir), **DAY_COVERAGE))


@register("seasonal_mk_monthly_means")
def q_seasonal_mk_monthly_means(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.seasonal_mk_monthly_means(_dd(spark, sf_dir)))


# ------------------------------------------------------------ resampling and coverage

@register("halfhourly_readings")
def q_halfhourly_readings(spark, sf_dir):
    return finalize(_hh(spark, sf_dir))


@register("daily_from_halfhourly")
def q_daily_from_halfhourly(spark, sf_dir):
    from rainfold.operators.resample import daily_from_halfhourly
    return finalize(daily_from_halfhourly(_hh(spark, sf_dir)))


@register("hourly_resample_filled")
def q_hourly_resample_filled(spark, sf_dir):
    from rainfold.operators.resample import resample_hourly
    return finalize(resample_hourly(_hh(spark, sf_dir), mean_cols=["T_avg", "T_min", "T_max", "wind_dir"]))


@register("hourly_sparse_sum")
def q_hourly_sparse_sum(spark, sf_dir):
    from rainfold.operators.resample import hourly_sum
    return finalize(hourly_sum(_hh(spark, sf_dir)))


@register("coverage_by_year")
def q_coverage_by_year(spark, sf_dir):
    from rainfold.operators.coverage import coverage
    d = _dd(spark, sf_dir).withColumn("year", F.year("date"))
    return finalize(coverage(d, ["station"], "year", "rain_mm", 365, 0.70))


@register("valid_year_range")
def q_valid_year_range(spark, sf_dir):
    from rainfold.operators.coverage import coverage, valid_range
    d = _dd(spark, sf_dir).withColumn("year", F.year("date"))
    return valid_range(coverage(d, ["station"], "year", "rain_mm", 365, 0.70), ["station"], "year")


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    from rainfold.operators.aggregates import dataset_profile
    return dataset_profile(_hh(spark, sf_dir), ["station"], "datetime_utc")


# ------------------------------------------------------------ intensity (Q7-Q13)

@register("intensity_histogram")
def q_intensity_histogram(spark, sf_dir):
    from rainfold.plans import intensity
    return finalize(intensity.intensity_histogram(_hh(spark, sf_dir)))


@register("intensity_vs_time")
def q_intensity_vs_time(spark, sf_dir):
    from rainfold.plans import intensity
    return finalize(intensity.intensity_vs_time(_hh(spark, sf_dir)))


@register("rain_periods")
def q_rain_periods(spark, sf_dir):
    from rainfold.operators.periods import rain_periods
    return finalize(rain_periods(_hh(spark, sf_dir)))


@register("rain_period_counts")
def q_rain_period_counts(spark, sf_dir):
    from rainfold.operators.periods import rain_period_counts
    return rain_period_counts(_hh(spark, sf_dir))


@register("specific_rain_filtered")
def q_specific_rain_filtered(spark, sf_dir):
    from rainfold.operators.aggregates import specific_rain
    return finalize(specific_rain(_hh(spark, sf_dir), mode="filtered"))


@register("specific_rain_any_wet")
def q_specific_rain_any_wet(spark, sf_dir):
    from rainfold.operators.aggregates import specific_rain
    return finalize(specific_rain(_hh(spark, sf_dir), mode="any_wet"))


@register("yearly_maxima")
def q_yearly_maxima(spark, sf_dir):
    from rainfold.plans import intensity
    return finalize(intensity.yearly_maxima(_hh(spark, sf_dir)))


@register("yearly_max_trend")
def q_yearly_max_trend(spark, sf_dir):
    from rainfold.plans import intensity
    return finalize(intensity.yearly_max_trend(_dd(spark, sf_dir)))


@register("heavy_event_counts")
def q_heavy_event_counts(spark, sf_dir):
    from rainfold.operators.aggregates import heavy_event_counts
    d = _dd(spark, sf_dir).withColumn("year", F.year("date"))
    return finalize(heavy_event_counts(d, ["station"], "year", "rain_mm"))


@register("heavy_event_trend")
def q_heavy_event_trend(spark, sf_dir):
    from rainfold.plans import intensity
    return finalize(intensity.heavy_event_trend(_dd(spark, sf_dir)))


# ------------------------------------------------------------ seasons (Q14-Q18)

@register("monthly_totals")
def q_monthly_totals(spark, sf_dir):
    from rainfold.operators.aggregates import monthly_totals
    return finalize(monthly_totals(_dd(spark, sf_dir)))


@register("monthly_climatology")
def q_monthly_climatology(spark, sf_dir):
    from rainfold.operators.aggregates import monthly_climatology
    return finalize(monthly_climatology(_dd(spark, sf_dir)))


@register("wettest_months")
def q_wettest_months(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.wettest_months(_dd(spark, sf_dir)))


@register("climatology_comparison")
def q_climatology_comparison(spark, sf_dir):
    from rainfold.operators.aggregates import monthly_climatology
    from rainfold.operators.combine import two_way_compare
    clim = monthly_climatology(_dd(spark, sf_dir))
    return finalize(two_way_compare(clim, ["month"], "station", LEFT, RIGHT, "mean_total",
                                    names=("mean_left", "mean_right")))


@register("seasonal_mk_daily")
def q_seasonal_mk_daily(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.seasonal_mk_daily(_dd(spark, sf_dir)))


@register("monthly_trend_table")
def q_monthly_trend_table(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.monthly_trend_table(_dd(spark, sf_dir)))


@register("annual_trend_table")
def q_annual_trend_table(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.annual_trend_table(_dd(spark, sf_dir)))


def _monthly_series(spark, sf_dir):
    from rainfold.operators.aggregates import grouped_total
    from rainfold.operators.trend import make_series
    d = _dd(spark, sf_dir).withColumn("year", F.year("date")).withColumn("month", F.month("date"))
    t = grouped_total(d, ["station", "year", "month"], "rain_mm", "total")
    t = t.withColumn("ym", F.format_string("%04d-%02d", "year", "month"))
    return make_series(t, ["station"], ["year", "month"], "total", label="ym")


@register("mann_kendall_monthly")
def q_mann_kendall_monthly(spark, sf_dir):
    from rainfold.operators.trend import mann_kendall
    return finalize(mann_kendall(_monthly_series(spark, sf_dir), ["station"]))


@register("theil_sen_monthly")
def q_theil_sen_monthly(spark, sf_dir):
    from rainfold.operators.theil_sen import theil_sen
    return finalize(theil_sen(_monthly_series(spark, sf_dir), ["station"]))


@register("pettitt_monthly")
def q_pettitt_monthly(spark, sf_dir):
    from rainfold.operators.trend import pettitt
    return finalize(pettitt(_monthly_series(spark, sf_dir), ["station"]))


@register("ols_monthly")
def q_ols_monthly(spark, sf_dir):
    from rainfold.operators.trend import ols
    return finalize(ols(_monthly_series(spark, sf_dir), ["station"]))


# ------------------------------------------------------------ nights and warm days (Q19-Q28)

@register("night_table")
def q_night_table(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.night_table(_hh(spark, sf_dir), season=JAN_NIGHTS))


@register("night_coverage")
def q_night_coverage(spark, sf_dir):
    from rainfold.plans import nights
    n = nights.night_table(_hh(spark, sf_dir), season=JAN_NIGHTS)
    return finalize(nights.night_coverage(n, expected=21))


@register("summer_days")
def q_summer_days(spark, sf_dir):
    return finalize(_days(spark, sf_dir).select("station", "date", "year", "T_min", "T_max"))


@register("warm_counts")
def q_warm_counts(spark, sf_dir):
    from rainfold.plans import nights
    return nights.warm_counts(_days(spark, sf_dir))


@register("warm_count_trend")
def q_warm_count_trend(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.warm_count_trend(_days(spark, sf_dir)))


@register("warm_streaks")
def q_warm_streaks(spark, sf_dir):
    from rainfold.plans import nights
    return nights.warm_streaks(_days(spark, sf_dir))


@register("warm_percentiles")
def q_warm_percentiles(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.warm_percentiles(_days(spark, sf_dir)))


@register("yearly_box")
def q_yearly_box(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.yearly_box(_days(spark, sf_dir)))


@register("yearly_summary")
def q_yearly_summary(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.summary_table(_days(spark, sf_dir)))


@register("two_station_warm_counts")
def q_two_station_warm_counts(spark, sf_dir):
    from rainfold.plans import nights
    return nights.two_station_counts(_days(spark, sf_dir), LEFT, RIGHT)


@register("two_station_streaks")
def q_two_station_streaks(spark, sf_dir):
    from rainfold.plans import nights
    return nights.two_station_streaks(_days(spark, sf_dir), LEFT, RIGHT)


@register("median_trend_common_years")
def q_median_trend_common_years(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.median_trend_common_years(_days(spark, sf_dir), LEFT, RIGHT))


@register("warm_mean_trend_table")
def q_warm_mean_trend_table(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.yearly_mean_trend(_days(spark, sf_dir)))


# ------------------------------------------------------------ cleaning and ingestion (Q29-Q31)

def _messy(spark, sf_dir):
    return fx.messy_text_view(fx.load(spark, sf_dir, "events"))


@register("clean_report_text")
def q_clean_report_text(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.clean_report_text(_messy(spark, sf_dir)))


@register("category_audit")
def q_category_audit(spark, sf_dir):
    from rainfold.plans import ingest
    return ingest.category_audit(_messy(spark, sf_dir))


@register("null_profile")
def q_null_profile(spark, sf_dir):
    from rainfold.operators.aggregates import null_profile
    m = _messy(spark, sf_dir)
    return finalize(null_profile(m, ["value_with_nulls", "user_with_nulls", "type_with_nulls"]))


@register("union_two_eras")
def q_union_two_eras(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.two_era_city_table(_dd(spark, sf_dir)))


@register("union_two_eras_dedup")
def q_union_two_eras_dedup(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.two_era_city_table(_dd(spark, sf_dir), dedupe="prefer_new"))


@register("text_report_roundtrip")
def q_text_report_roundtrip(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.text_roundtrip(_dd(spark, sf_dir)))


@register("html_report_roundtrip")
def q_html_report_roundtrip(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.html_roundtrip(_dd(spark, sf_dir)))


@register("ingest_ledger")
def q_ingest_ledger(spark, sf_dir):
    from rainfold.plans import ingest
    return ingest.ingest_ledger(_dd(spark, sf_dir), fx.load(spark, sf_dir, "pages"))


@register("missing_days")
def q_missing_days(spark, sf_dir):
    from rainfold.sources.manifest import missing_days
    return missing_days(_dd(spark, sf_dir), ["station"])


@register("month_manifest")
def q_month_manifest(spark, sf_dir):
    from rainfold.sources.manifest import month_manifest
    return month_manifest(_dd(spark, sf_dir), ["station"])


@register("source_pick")
def q_source_pick(spark, sf_dir):
    from rainfold.sources.manifest import pick_source
    o = fx.load(spark, sf_dir, "orders")
    fmt = (F.when(F.col("o_orderstatus") == "F", "txt").when(F.col("o_orderstatus") == "P", "txt_variant")
           .otherwise("html"))
    avail = o.select(F.col("o_orderpriority").alias("station"), F.year("o_orderdate").alias("year"),
                     F.month("o_orderdate").alias("month"), fmt.alias("source")).distinct()
    return pick_source(avail, ["station", "year", "month"], "source", ["txt", "txt_variant", "html"])


@register("day_page_roundtrip")
def q_day_page_roundtrip(spark, sf_dir):
    from rainfold.plans import ingest
    rows, _ = ingest.day_page_roundtrip(_hh(spark, sf_dir))
    return finalize(rows)


@register("day_page_rejects")
def q_day_page_rejects(spark, sf_dir):
    from rainfold.plans import ingest
    _, rejects = ingest.day_page_roundtrip(_hh(spark, sf_dir))
    return rejects


@register("stacked_report_roundtrip")
def q_stacked_report_roundtrip(spark, sf_dir):
    from rainfold.plans import ingest
    return finalize(ingest.stacked_roundtrip(_dd(spark, sf_dir)))


# ------------------------------------------------------------ more compositions

@register("hourly_rain_trend_by_day")
def q_hourly_rain_trend_by_day(spark, sf_dir):
    """Q4 on a one-month record: mean hourly rain per valid day → trend row."""
    return finalize(rain_hours.hourly_rain_trend(_hh(spark, sf_dir), **DAY_COVERAGE))


@register("hourly_null_profile")
def q_hourly_null_profile(spark, sf_dir):
    """Share of missing values per column and station of the gap-filled hourly table."""
    from rainfold.operators.aggregates import null_profile
    from rainfold.operators.resample import resample_hourly
    h = resample_hourly(_hh(spark, sf_dir), mean_cols=["T_avg", "T_min", "T_max", "wind_dir"])
    return finalize(null_profile(h, ["rain_mm", "T_avg", "T_min", "T_max", "wind_dir"], by=["station"]))


@register("specific_rain_comparison")
def q_specific_rain_comparison(spark, sf_dir):
    """Two stations' yearly specific rain over the union of their years."""
    from rainfold.operators.aggregates import specific_rain
    from rainfold.operators.combine import two_way_compare
    hh = _hh(spark, sf_dir)
    a = specific_rain(hh, mode="filtered").where(F.col("station") == EV_LEFT)
    b = specific_rain(hh, mode="any_wet").where(F.col("station") == EV_RIGHT)
    return finalize(two_way_compare(a.unionByName(b), ["year"], "station", EV_LEFT, EV_RIGHT, "specific_rain",
                                    names=("specific_left", "specific_right")))


@register("monthly_trend_results")
def q_monthly_trend_results(spark, sf_dir):
    """Compact results table of the per-month trend rows."""
    from rainfold.plans import seasons
    from rainfold.plans.trends import results_table
    return finalize(results_table(seasons.monthly_trend_table(_dd(spark, sf_dir)), ["station", "month"]))


@register("seasonal_mk_detail")
def q_seasonal_mk_detail(spark, sf_dir):
    """T4 per-season detail: S, Var(S) and n for each month (daily grain, ordered by year and date)."""
    from rainfold.operators.trend import make_series, seasonal_mann_kendall
    d = _dd(spark, sf_dir).withColumn("year", F.year("date")).withColumn("season", F.month("date"))
    s = make_series(d, ["station", "season"], ["year", "date"], "rain_mm")
    _, detail = seasonal_mann_kendall(s, ["station"], "season")
    return finalize(detail)


# ------------------------------------------------------------ the night chain (Q19-Q23, Q28)

def _nights(spark, sf_dir):
    """Complete nights of valid years, shaped like days (the fixture has about
    three half-hours in four, so a night is complete at 8 of 14)."""
    from rainfold.plans import nights
    n = nights.night_table(_hh(spark, sf_dir), season=JAN_NIGHTS, complete_at=8)
    return nights.as_days(nights.valid_nights(n, expected=21))


NIGHT_THRESHOLDS = [0.5, 1.0, 2.0, 4.0]     # on the scale of the half-hourly fixture


@register("valid_nights")
def q_valid_nights(spark, sf_dir):
    return finalize(_nights(spark, sf_dir))


@register("night_warm_counts")
def q_night_warm_counts(spark, sf_dir):
    from rainfold.plans import nights
    return nights.warm_counts(_nights(spark, sf_dir), thresholds=NIGHT_THRESHOLDS)


@register("night_percentiles")
def q_night_percentiles(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.warm_percentiles(_nights(spark, sf_dir)))


@register("night_streaks")
def q_night_streaks(spark, sf_dir):
    from rainfold.plans import nights
    return nights.warm_streaks(_nights(spark, sf_dir), thresholds=NIGHT_THRESHOLDS)


@register("night_box")
def q_night_box(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.yearly_box(_nights(spark, sf_dir)))


@register("night_trends")
def q_night_trends(spark, sf_dir):
    """Q28 on nights (the fixture has one year, so each series is too short)."""
    from rainfold.plans import nights
    return finalize(nights.measure_trends(_nights(spark, sf_dir), thresholds=NIGHT_THRESHOLDS))


@register("warm_measure_trends")
def q_warm_measure_trends(spark, sf_dir):
    """Trends of T_min, T_max, threshold counts and streaks over the years."""
    from rainfold.plans import nights
    return finalize(nights.measure_trends(_days(spark, sf_dir)))


# ------------------------------------------------------------ further compositions

@register("rain_period_totals")
def q_rain_period_totals(spark, sf_dir):
    from rainfold.operators.periods import rain_period_counts, rain_period_totals
    return finalize(rain_period_totals(rain_period_counts(_hh(spark, sf_dir))))


@register("yearly_maxima_all_stations")
def q_yearly_maxima_all_stations(spark, sf_dir):
    """Q11: half-hourly stations and stations that report days only."""
    from rainfold.plans import intensity
    return finalize(intensity.yearly_maxima(_hh(spark, sf_dir), daily=_dd(spark, sf_dir)))


@register("yearly_maxima_trends")
def q_yearly_maxima_trends(spark, sf_dir):
    """Q12: the trend of every column of Q11."""
    from rainfold.plans import intensity
    return finalize(intensity.yearly_maxima_trends(intensity.yearly_maxima(_hh(spark, sf_dir), daily=_dd(spark, sf_dir))))


@register("seasonal_mk_hourly_means")
def q_seasonal_mk_hourly_means(spark, sf_dir):
    from rainfold.plans import seasons
    return finalize(seasons.seasonal_mk_hourly_means(rain_hours.valid_hourly(_hh(spark, sf_dir), **DAY_COVERAGE),
                                                     season="hour", period="day"))


@register("two_station_count_trend")
def q_two_station_count_trend(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.two_station_count_trend(_days(spark, sf_dir), LEFT, RIGHT))


@register("box_on_common_years")
def q_box_on_common_years(spark, sf_dir):
    from rainfold.plans import nights
    return finalize(nights.box_on_common_years(_days(spark, sf_dir), LEFT, RIGHT))


@register("box_outliers")
def q_box_outliers(spark, sf_dir):
    from rainfold.operators.aggregates import box_outliers
    return finalize(box_outliers(_days(spark, sf_dir), ["station", "year"], "T_max"))


@register("heavy_events_whole_record")
def q_heavy_events_whole_record(spark, sf_dir):
    from rainfold.operators.aggregates import heavy_event_counts
    d = _dd(spark, sf_dir).withColumn("year", F.year("date"))
    return finalize(heavy_event_counts(d, ["station"], "year", "rain_mm", whole_record=True))


@register("dense_columns")
def q_dense_columns(spark, sf_dir):
    """Q30: the messy table without its columns of more than 6 % nulls."""
    from rainfold.operators.aggregates import drop_sparse_columns
    m = _messy(spark, sf_dir).select("event_id", "value_with_nulls", "user_with_nulls", "type_with_nulls")
    return finalize(drop_sparse_columns(m, ["value_with_nulls", "user_with_nulls", "type_with_nulls"], 6.0))


@register("file_roundtrip")
def q_file_roundtrip(spark, sf_dir):
    """The daily table of ``lineitem`` written by station and
    year in the shared folder and read again, columns in a preferred order."""
    from rainfold.session import scratch_path
    from rainfold.sources import files
    d = fx.daily_from_lineitem(fx.load(spark, sf_dir, "lineitem")).withColumn("year", F.year("date"))
    path = scratch_path(spark, "stations")
    files.write_station_table(d, path, sort_by=("date",))
    back = files.drop_stray_index(spark.read.parquet(path))
    return finalize(files.reorder_columns(back, ["station", "date", "year"]))


# ------------------------------------------------------------ reports in the given tables

@register("page_ledger")
def q_page_ledger(spark, sf_dir):
    """One ledger row for every page, dispatched by suffix or else by content."""
    from rainfold.plans import ingest
    return ingest.page_ledger(fx.load(spark, sf_dir, "pages"))


@register("document_report_lines")
def q_document_report_lines(spark, sf_dir):
    """Lines and accepted report lines of every document."""
    from rainfold.plans import ingest
    return ingest.document_report_lines(fx.load(spark, sf_dir, "documents"))


@register("candidate_sources")
def q_candidate_sources(spark, sf_dir):
    """The names each month's report may be stored under."""
    from rainfold.sources.manifest import candidate_sources, month_manifest
    return candidate_sources(month_manifest(_dd(spark, sf_dir), ["station"]), ["station"])


@register("daily_all_columns")
def q_daily_all_columns(spark, sf_dir):
    """A1 with every column of the half-hourly report (all but the direction,
    whose circular mean is in ``daily_from_halfhourly``)."""
    from rainfold.operators.resample import daily_from_halfhourly
    hh = _hh(spark, sf_dir).drop("wind_dir").withColumns({
        "humidity": F.col("T_avg") * 5, "avg_wind_kmh": F.col("T_min"), "max_wind_kmh": F.col("T_max"),
        "pressure": F.col("T_avg") + 1000, "radiation": F.col("T_max") * 10})
    return finalize(daily_from_halfhourly(hh))


# ------------------------------------------------------------ stores, ledgers and ordered files

@register("stored_reports")
def q_stored_reports(spark, sf_dir):
    """Monthly reports written as files under their candidate names
    (text, HTML, both or neither by month), the first existing name of every
    month of the record read back, decoded and parsed."""
    from rainfold.plans.ingest import store_reports, stored_report_rows
    from rainfold.session import scratch_path
    daily = _dd(spark, sf_dir)
    folder = scratch_path(spark, "store")
    store_reports(daily, folder)
    return stored_report_rows(spark, daily, folder)


@register("time_ordered_sink")
def q_time_ordered_sink(spark, sf_dir):
    """Half-hourly readings written in time order, the months of every
    second year then delivered again; what the files say about order."""
    from rainfold.session import materialise, scratch_path
    from rainfold.sources import files
    hh = materialise(fx.spread_over_years(_hh(spark, sf_dir)).withColumn("month", F.date_format("datetime_utc", "yyyy-MM")), "readings")
    path = scratch_path(spark, "ordered")
    files.write_in_time_order(hh, path)
    files.write_in_time_order(hh.where(F.month("datetime_utc").between(1, 6) & (F.year("datetime_utc") % 2 == 0)), path)
    return files.file_order(spark.read.parquet(path))


@register("csv_reject_ledger")
def q_csv_reject_ledger(spark, sf_dir):
    """Messy CSV files with a stray index column, routed in
    one pass into good rows and a written reject ledger."""
    from rainfold.plans.ingest import csv_good_and_rejected
    return csv_good_and_rejected(spark, fx.load(spark, sf_dir, "events"))


@register("preview_by_time")
def q_preview_by_time(spark, sf_dir):
    """The first and last three readings of each station."""
    from rainfold.operators.ranking import head_tail
    return finalize(head_tail(_hh(spark, sf_dir).select("station", "datetime_utc", "T_avg"), ["station"], "datetime_utc", 3))


@register("all_station_years")
def q_all_station_years(spark, sf_dir):
    """Every (station, month) that either daily source has, with
    its share of that station's readings in per cent and its label."""
    from rainfold.plans.ingest import month_shares
    return finalize(month_shares(_dd(spark, sf_dir), fx.daily_from_lineitem(fx.load(spark, sf_dir, "lineitem"))))


@register("hour_labels")
def q_hour_labels(spark, sf_dir):
    """Mean rain by hour of the day, hours labelled HH:00."""
    from rainfold.functions.calendar import hour_label
    prof = rain_hours.hour_profile(rain_hours.valid_hourly(_hh(spark, sf_dir), **DAY_COVERAGE))
    return finalize(prof.select("station", hour_label("hour").alias("hour"), "mean_rain"))


def _nights_of_years(spark, sf_dir):
    from rainfold.plans import nights
    hh = fx.spread_over_years(_hh(spark, sf_dir))
    return nights.valid_nights(nights.night_table(hh, season=JAN_NIGHTS, complete_at=1), expected=21, threshold=0.2)


@register("night_trends_over_years")
def q_night_trends_over_years(spark, sf_dir):
    """Q28 on nights of several years: Mann-Kendall, Sen and Pettitt of every
    yearly measure."""
    from rainfold.plans import nights
    days = nights.as_days(_nights_of_years(spark, sf_dir).select("station", "night_date", "year", "night_T_min", "night_T_max"))
    return finalize(nights.measure_trends(days, thresholds=[0.5, 1.0, 2.0, 4.0]))


@register("month_hour_over_years")
def q_month_hour_over_years(spark, sf_dir):
    """Q3, Q9, J4 on several months and years: rain periods of every station
    and year, years without any filled with 0."""
    from rainfold.operators.periods import rain_period_counts
    return rain_period_counts(fx.spread_over_years(_hh(spark, sf_dir)).where((F.col("station") != EV_LEFT) | (F.year("datetime_utc") != 2021)))
