"""The named entry points run end to end on the fixtures."""

from pyspark.sql import functions as F

from paths import SF
from rainfold import api
from rainfold.sources import fixtures as fx


def test_api_chain(spark):
    hh = fx.halfhourly_from_events(fx.load(spark, SF, "events"))
    hourly = api.resample_hourly(hh)
    assert api.check_year_coverage(hourly).count() == hh.select("station").distinct().count()
    assert set(api.count_rain_periods(hh).columns) == {"station", "year", "periods"}
    assert len(api.hour_month_heatmap(hourly).columns) == 26
    dd = fx.daily_from_orders(fx.load(spark, SF, "orders")).withColumn("year", F.year("date"))
    yearly = dd.groupBy("station", "year").agg(F.sum("rain_mm").alias("total"))
    row = api.mk_analysis_series(yearly, "total").collect()
    assert len(row) == 5 and all(r.n >= 4 for r in row)
    assert api.mk_table(api.mk_analysis_series(yearly, "total")).count() == 5
    assert api.count_above_threshold(dd, "T_min", 20).count() > 0
    assert api.compute_streaks(dd, "T_min", 20).count() > 0
    assert api.trend_line(yearly, "year", "total").count() == 5
    dd2 = dd.withColumn("month", F.month("date"))
    overall, detail = api.seasonal_mann_kendall(dd2, "rain_mm")
    assert overall.count() == 5 and detail.count() > 0
    months = dd.select("station", F.month("date").alias("m")).distinct().count()
    assert api.monthly_average(dd).count() == months
    assert api.get_monthly_series(dd).select("station", "year", "month").distinct().count() == \
        api.get_monthly_series(dd).count()


def test_sens_slope_step_vs_period(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2003, 4.0), ("a", 2004, 5.0)],
                               "station STRING, year INT, v DOUBLE")
    by_step = api.sens_slope(df, "v").collect()[0].slope
    by_year = api.sens_slope(df, "v", x="year").collect()[0].slope
    assert by_year == 1.0 and by_step > by_year  # a missing year inflates the per-step slope
