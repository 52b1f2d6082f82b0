"""Report files in a store: writing them under their names, choosing the first
name that exists, reading bodies with their encodings (S9, S13).

Names are relative to the store's folder.  The scan lists all files; which of a
month's candidate names is there is decided on names alone, and bodies are read
for the chosen ones.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoding of bodies that are not valid UTF-8.
FALLBACK_ENCODING = "ISO-8859-1"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a folder given as URI or absolute path."""
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def write_documents(docs: DataFrame, uri: str, name: str = "name", body: str = "body", encoding: str = "utf-8") -> DataFrame:
    """Write each body as the file ``name`` below ``uri``; returns (name, bytes).

    The tasks write straight to the store, under a temporary name first, so a
    task that is run again leaves the same file.  Rows without a name or a body
    write nothing.  The result must be evaluated for the files to be there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_store(uri)
        made: set[str] = set()
        for batch in batches:
            names, sizes = [], []
            for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = b.encode(encoding)
                path = f"{folder}/{n}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, path)
                names.append(n)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    rows = docs.select(F.col(name).alias("name"), F.col(body).alias("body")).where("name IS NOT NULL AND body IS NOT NULL")
    return rows.mapInArrow(run, "name string, bytes long")


def stored_names(spark: SparkSession, uri: str) -> DataFrame:
    """(name, bytes) of every file below ``uri``; contents are not read.
    Files whose base name begins with ``_`` are unfinished and not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    return files.select(_name_below(uri).alias("name"), F.col("length").alias("bytes")).where(~F.col("name").rlike("(^|/)_[^/]*$"))


def _name_below(uri: str) -> Column:
    """A file's path without the store's folder (and without the scheme, which
    listings may write differently)."""
    folder = re.sub("^[a-z0-9]+:/*", "/", uri).rstrip("/") + "/"
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/")
    return F.substring(plain, F.position(F.lit(folder), plain) + F.lit(len(folder)), F.length(plain))


def decoded(content: Column, encoding: str | None = None) -> Column:
    """Text of a body: in the declared encoding, else UTF-8 if it is valid,
    else ``FALLBACK_ENCODING``; a byte order mark is dropped."""
    if encoding:
        text = F.decode(content, encoding)
    else:
        text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, FALLBACK_ENCODING))
    return F.regexp_replace(text, "^﻿", "")


def first_existing(candidates: DataFrame, stored: DataFrame, keys: Sequence[str], name: str = "url",
                   priority: str = "priority") -> DataFrame:
    """Per key the first candidate name, in order of ``priority``, that is
    stored: (keys, picked, n_available, status), one row per key, status
    ``found`` or ``not_found``.  Names are compared, contents are not read."""
    keys = list(keys)
    there = stored.select(F.col("name").alias("_stored")).distinct()
    ranked = candidates.join(there, candidates[name] == F.col("_stored"), "left")
    best = F.min(F.when(F.col("_stored").isNotNull(), F.struct(F.col(priority).alias("p"), F.col(name).alias("u"))))
    out = ranked.groupBy(*keys).agg(best.alias("_best"), F.count("_stored").alias("n_available"))
    return out.select(*keys, F.col("_best.u").alias("picked"), "n_available",
                      F.when(F.col("_best").isNull(), "not_found").otherwise("found").alias("status"))


def read_picked(spark: SparkSession, uri: str, picked: DataFrame, encoding: str | None = None) -> DataFrame:
    """``picked`` with ``url`` and ``body``; null bodies where nothing is stored.
    ``encoding`` is declared for all bodies, or found for each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    bodies = files.select(_name_below(uri).alias("_name"), decoded(F.col("content"), encoding).alias("body"))
    return picked.join(bodies, picked["picked"] == F.col("_name"), "left").withColumn("url", F.col("picked")).drop("_name")


CORRUPT = "_corrupt_record"


def read_csv_rows(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Header CSV with explicit schema; a row that does not fit keeps its
    text in ``_corrupt_record`` (and the fields that could be read)."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(wide).csv(paths)


def route(rows: DataFrame, rejected: Column, reason: Column, folder: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows and reject ledger from one evaluation.

    ``rows`` are evaluated once, while they are written in two parts below
    ``folder``; an observation on that write counts both, so nothing is scanned
    to count.  Returns the good rows, the ledger (keys, error, record, status,
    seen_at) and the counts {"good", "rejected"}."""
    bad = F.coalesce(rejected, F.lit(False))
    tagged = rows.withColumn("_error", F.when(bad, F.coalesce(reason, F.lit("rejected")))) \
        .withColumn("_part", F.when(bad, "ledger").otherwise("rows"))
    from pyspark.sql import Observation
    seen = Observation(f"route-{uuid.uuid4().hex[:8]}")
    counted = tagged.observe(seen, F.count_if(F.col("_part") == "rows").alias("good"), F.count_if(F.col("_part") == "ledger").alias("rejected"))
    counted.write.partitionBy("_part").parquet(folder)
    back = rows.sparkSession.read.schema(tagged.schema).parquet(folder)
    good = back.where("_part = 'rows'").select(*[f"`{c}`" for c in rows.columns if c != CORRUPT])
    record = F.col(CORRUPT) if CORRUPT in rows.columns else F.lit(None).cast("string")
    ledger = back.where("_part = 'ledger'").select(*keys, F.col("_error").alias("error"), record.alias("record"), F.lit("rejected").alias("status"),
                                                   F.input_file_name().alias("seen_at"))
    return good, ledger, dict(seen.get)
