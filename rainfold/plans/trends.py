"""Combined trend row (T5) and results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.operators.theil_sen import theil_sen
from rainfold.operators.trend import mann_kendall, pettitt


def trend_row(series: DataFrame, sid: Sequence[str]) -> DataFrame:
    """T5: Mann-Kendall + Theil-Sen + Pettitt for every series in one table."""
    sid = list(sid)
    mk = mann_kendall(series, sid)
    ts = theil_sen(series, sid)
    pt = pettitt(series, sid)
    return (mk.select(*sid, "n", F.col("tau").alias("mk_tau"), F.col("p_value").alias("mk_p_value"),
                      F.col("trend").alias("mk_trend"), F.col("sign_0_05").alias("mk_sign_0_05"),
                      F.col("sign_0_01").alias("mk_sign_0_01"))
            .join(ts.select(*sid, F.col("slope").alias("sens_slope"), F.col("intercept").alias("sens_intercept"),
                            F.col("ci_lower").alias("sens_ci_lower"), F.col("ci_upper").alias("sens_ci_upper")),
                  sid, "left")
            .join(pt.select(*sid, F.col("cp_index").alias("pt_cp_index"), F.col("cp_label").alias("pt_cp_label"),
                            F.col("u_stat").alias("pt_u_stat"), F.col("p_value").alias("pt_p_value"),
                            F.col("significant").alias("pt_significant")),
                  sid, "left"))


def results_table(trend: DataFrame, sid: Sequence[str]) -> DataFrame:
    """The compact table — label, τ, p, slope, trend (14 chars), Y/N, change-point label."""
    label = F.concat_ws(" ", *[F.col(c).cast("string") for c in sid])
    return trend.select(label.alias("label"), "mk_tau", "mk_p_value", "sens_slope",
                        F.substring("mk_trend", 1, 14).alias("trend"),
                        F.when(F.col("mk_sign_0_05"), "Y").otherwise("N").alias("sig_0_05"),
                        F.col("pt_cp_label").alias("cp_label"))
