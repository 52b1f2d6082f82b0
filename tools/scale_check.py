"""Scaling with the number of series.

Replicates every station k times (station key suffixed with the copy
number, values unchanged) from the given tables, inside Spark, and times a
few operators per k.  Prints one JSON line per k.

usage: python tools/scale_check.py [sf_dir] [k ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from rainfold.operators.periods import rain_periods  # noqa: E402
from rainfold.operators.trend import make_series, mann_kendall, pettitt  # noqa: E402
from rainfold.plans import rain_hours  # noqa: E402
from rainfold.session import build_session  # noqa: E402
from rainfold.sources import fixtures as fx  # noqa: E402


def replicate(df, col, k):
    return (df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn(col, F.concat_ws("#", F.col(col), F.col("_copy").cast("string"))).drop("_copy"))


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    ks = [int(a) for a in args] or [1, 10, 50]
    spark = build_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    events = fx.load(spark, sf, "events")
    orders = fx.load(spark, sf, "orders")
    for k in ks:
        # materialise the replicated inputs once so only the operators are timed
        hh = fx.halfhourly_from_events(replicate(events, "event_type", k)).checkpoint()
        dd = fx.daily_from_orders(replicate(orders, "o_orderpriority", k)).checkpoint()
        monthly = (dd.groupBy("station", F.year("date").alias("year"), F.month("date").alias("month"))
                   .agg(F.sum("rain_mm").alias("total")))
        series = make_series(monthly, ["station"], ["year", "month"], "total")
        jobs = {
            "hour_profile_top3": rain_hours.hour_profile_top3(hh, period="day", expected=24),
            "rain_periods": rain_periods(hh),
            "mann_kendall_monthly": mann_kendall(series, ["station"]),
            "pettitt_monthly": pettitt(series, ["station"]),
        }
        out = {}
        for name, df in jobs.items():
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            out[name] = round(time.perf_counter() - t0, 2)
        print(json.dumps({"copies": k, "series": 5 * k, "halfhour_rows": hh.count(), "daily_rows": dd.count(),
                          "sec": out}), flush=True)


if __name__ == "__main__":
    main()
