"""Final shaping of query results: stable float rounding and integer widths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions.numeric import round_significant


def finalize(df: DataFrame, bits: int = 30, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (except ``keep``) to ``bits`` significant
    binary digits (nine decimal ones) so that independent engines agree bit
    for bit despite summation order."""
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float") and name not in keep:
            cols.append(round_significant(F.col(name), bits).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
