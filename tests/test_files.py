"""CSV scan with explicit schema, stray index column, partitioned sink."""

import os
import tempfile

from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rainfold.sources.files import drop_stray_index, read_station_csv, write_station_table


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="rainfold-csv-")
    for name, rows in (("alpha_daily.csv", ["0,2020-01-01,1.5", "1,2020-01-02,bad"]),
                       ("beta_daily.csv", ["0,2020-01-01,2.0"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("Unnamed: 0,date,rain_mm\n" + "\n".join(rows) + "\n")
    schema = StructType([StructField("Unnamed: 0", StringType()), StructField("date", StringType()),
                         StructField("rain_mm", DoubleType())])
    df = read_station_csv(spark, os.path.join(d, "*.csv"), schema)
    assert "Unnamed: 0" not in df.columns
    got = sorted((r.station, r.date, r.rain_mm) for r in df.collect())
    assert got == [("alpha", "2020-01-01", 1.5), ("alpha", "2020-01-02", None), ("beta", "2020-01-01", 2.0)]
    out = os.path.join(d, "out")
    write_station_table(df.withColumn("year", df.date.substr(1, 4)), out)
    assert {"station=alpha", "station=beta"} <= set(os.listdir(out))
    back = spark.read.parquet(out)
    assert back.where("station = 'beta'").count() == 1
    assert drop_stray_index(back).columns == back.columns


def test_reorder_columns(spark):
    from rainfold.sources.files import reorder_columns
    df = spark.createDataFrame([(1, 2, 3)], "c INT, a INT, b INT")
    assert reorder_columns(df, ["a", "zz", "b"]).columns == ["a", "b", "c"]


def test_first_stored_name_wins_and_bodies_are_decoded(spark):
    from rainfold.sources.stored import first_existing, read_picked, stored_names, write_documents
    folder = tempfile.mkdtemp(prefix="rainfold-store-")
    docs = spark.createDataFrame([("a/2020/Març 1+2.TXT", "pluja: 3 mm à"), ("a/2020/x.html", "<p>html"), (None, "no name"), ("b/none.txt", None)],
                                 "name STRING, body STRING")
    assert write_documents(docs, folder).count() == 2
    assert write_documents(docs.where("name LIKE '%TXT'"), folder, encoding="latin-1").first().bytes == 13   # replaces the file
    open(os.path.join(folder, "a/2020/_unfinished"), "w").write("part")
    assert sorted(r.name for r in stored_names(spark, folder).collect()) == ["a/2020/Març 1+2.TXT", "a/2020/x.html"]
    names = spark.createDataFrame([("a", 1, "a/2020/Març 1+2.TXT"), ("a", 2, "a/2020/x.html"), ("a", 0, "a/2020/missing"), ("b", 0, "b/none.txt"),
                                   ("c", 1, None), (None, 5, "a/2020/x.html")], "station STRING, priority INT, url STRING")
    picked = first_existing(names, stored_names(spark, folder), ["station"])
    got = {r.station: (r.picked, r.n_available, r.status, r.body) for r in read_picked(spark, folder, picked).collect()}
    assert got == {"a": ("a/2020/Març 1+2.TXT", 2, "found", "pluja: 3 mm à"), "b": (None, 0, "not_found", None), "c": (None, 0, "not_found", None),
                   None: ("a/2020/x.html", 1, "found", "<p>html")}
    assert read_picked(spark, "file://" + folder, picked, "ISO-8859-1").where("station = 'a'").first().body == "pluja: 3 mm à"


def test_files_in_time_order_and_months_replaced(spark):
    from pyspark.sql import functions as F
    from rainfold.sources.files import file_order, write_in_time_order
    path = os.path.join(tempfile.mkdtemp(prefix="rainfold-order-"), "t")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("b").alias("station"), F.lit("2020-01").alias("month"),
                                    F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(3000)) * 60).cast("timestamp_ntz").alias("datetime_utc"))
    write_in_time_order(rows, path, files_per_task=12)
    first = {r.station: tuple(r)[2:] for r in file_order(spark.read.parquet(path)).collect()}
    assert first["hot"][0] == 2000 and first["b"][0] == 1000 and all(v[3] and v[4] for v in first.values())
    assert len([f for f in os.listdir(os.path.join(path, "station=hot/month=2020-01")) if f.endswith("parquet")]) > 4   # one station, many tasks
    write_in_time_order(rows.where("station = 'hot'").limit(10), path)
    again = {r.station: r.rows for r in file_order(spark.read.parquet(path)).collect()}
    assert again == {"hot": 10, "b": 1000}
    unordered = os.path.join(path + "-u")
    rows.repartition(3).write.partitionBy("station", "month").parquet(unordered)
    assert not any(r.ascending and r.disjoint for r in file_order(spark.read.parquet(unordered)).collect())


def test_rejects_are_routed_in_one_evaluation(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType
    from rainfold.sources.stored import CORRUPT, read_csv_rows, route
    folder = tempfile.mkdtemp(prefix="rainfold-route-")
    with open(os.path.join(folder, "x.csv"), "w") as f:
        f.write("id,rain_mm\n1,2.5\n2,bad\n3,\n4,1.0,extra\nfive,2.0\n")
    schema = StructType([StructField("id", LongType()), StructField("rain_mm", DoubleType())])
    evaluated = spark.sparkContext.accumulator(0)
    touched = F.udf(lambda x: evaluated.add(1) or x, "string").asNondeterministic()
    rows = read_csv_rows(spark, folder + "/x.csv", schema).withColumn("seen", touched(F.lit("x")))
    good, ledger, counts = route(rows, F.col(CORRUPT).isNotNull(), F.lit("malformed row"), folder + "/out", ["id"])
    assert counts == {"good": 2, "rejected": 3}
    assert sorted((r.id, r.rain_mm) for r in good.collect()) == [(1, 2.5), (3, None)]
    assert sorted(r.record for r in ledger.collect()) == ["2,bad", "4,1.0,extra", "five,2.0"]
    assert ledger.columns == ["id", "error", "record", "status", "seen_at"] and evaluated.value == 5


def test_head_tail_and_key_sets(spark):
    from rainfold.operators.combine import all_keys
    from rainfold.operators.ranking import head_tail
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(10)] + [("b", 5, 1.0), ("b", 5, 0.0), (None, 1, 2.0), ("a", None, 9.0)],
                               "k STRING, t INT, v DOUBLE")
    got = {}
    for r in head_tail(df, ["k"], "t", 3).collect():
        got.setdefault(r.k, {})[r.place] = (r.t, r.v)
    assert got["a"] == {1: (0, 0.0), 2: (1, 1.0), 3: (2, 2.0), -1: (9, 0.0), -2: (8, 2.0), -3: (7, 1.0)}
    assert got["b"] == {1: (5, 0.0), 2: (5, 1.0)} and got[None] == {1: (1, 2.0)}
    other = spark.createDataFrame([("b", 1), ("c", 2), (None, 3)], "k STRING, x INT")
    assert sorted(all_keys([df, other], ["k"]).collect(), key=str) == sorted([("a",), ("b",), ("c",), (None,)], key=str)


def test_hour_labels(spark):
    from rainfold.functions.calendar import hour_label
    df = spark.createDataFrame([(0,), (9,), (23,), (24,), (None,)], "h INT")
    assert [r[0] for r in df.select(hour_label("h")).collect()] == ["00:00", "09:00", "23:00", None, None]
