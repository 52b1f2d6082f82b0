"""File sources and sinks.

Many station files are read in one scan with an explicit schema; the
station key comes from the file name (or a column) instead of one frame
per station.  Sinks partition by station and year so that later reads
prune by both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rainfold.functions.clean import nan_to_null

STRAY_INDEX_COLUMNS = ["Unnamed: 0", "_c0"]


def read_station_csv(spark: SparkSession, paths: list[str] | str, schema: StructType | None = None,
                     station_from_file: bool = True) -> DataFrame:
    """Header CSV scan; explicit schema when given (no inference pass)."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(paths)
    if station_from_file and "station" not in df.columns:
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        df = df.withColumn("station", F.regexp_replace(name, r"(_hourly|_daily)?\.csv$", ""))
    # NaN text is a missing reading: map it to NULL once, at load
    df = df.withColumns({c: nan_to_null(c) for c, t in df.dtypes if t in ("double", "float")})
    return drop_stray_index(df)


def drop_stray_index(df: DataFrame) -> DataFrame:
    """S3: drop the unnamed index column a CSV writer may have left (no-op if absent)."""
    return df.drop(*[c for c in STRAY_INDEX_COLUMNS if c in df.columns])


def reorder_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first (those present, in the given order), then the rest."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in set(first)])


def write_station_table(df: DataFrame, path: str, fmt: str = "parquet",
                        partition_by: tuple[str, ...] = ("station", "year"),
                        sort_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Partitioned sink; rows sorted by ``sort_by`` inside each task
    (no index column).  :func:`write_in_time_order` orders whole folders."""
    cols = [c for c in partition_by if c in df.columns]
    order = [c for c in sort_by if c in df.columns]
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode(mode)
    if cols:
        writer = writer.partitionBy(*cols)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_in_time_order(df: DataFrame, path: str, folder: tuple[str, ...] = ("station", "month"), time: str = "datetime_utc",
                        files_per_task: int | None = None) -> None:
    """Combine and sort by time; a folder that is written again replaces
    itself.

    The rows are dealt by range of (folder, time): each file holds one range of
    its folder's times in ascending order, and the ranges of a folder's files
    don't overlap, whatever share of the rows one station has.  Only the
    folders that ``df`` has rows for are replaced (dynamic overwrite), so
    delivering a month again is idempotent."""
    keys = [*folder, time]
    n = files_per_task or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folder).parquet(path)


def file_order(df: DataFrame, folder: tuple[str, ...] = ("station", "month"), time: str = "datetime_utc") -> DataFrame:
    """What a folder's files say about order, per folder: rows, first and last
    time, whether each file ascends and whether the files' ranges are disjoint.
    ``df`` is read from files directly."""
    from pyspark.sql import Window
    rows = df.select(*folder, time, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before = F.lag(time).over(Window.partitionBy("_file").orderBy("_at"))
    rows = rows.withColumn("_up", before.isNull() | (before <= F.col(time)))
    files = rows.groupBy(*folder, "_file").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("lo"), F.max(time).alias("hi"), F.every("_up").alias("up"))
    previous = F.max("hi").over(Window.partitionBy(*folder).orderBy("lo", "_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("apart", previous.isNull() | (previous <= F.col("lo")))
    return files.groupBy(*folder).agg(F.sum("n").alias("rows"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"),
                                      F.every("up").alias("ascending"), F.every("apart").alias("disjoint"))
