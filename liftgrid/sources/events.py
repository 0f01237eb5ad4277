"""Event log sources: raw CSV directory, clean Parquet table."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftgrid.schemas import CLEAN_EVENTS, RAW_EVENTS

# Cell texts that mean "missing" in the raw files (fixed values; the default list of
# the CSV reader the data was produced for).
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Quotes are escaped by doubling; a file whose header is not the one it is read with is
# refused instead of being read by position.
CSV_OPTIONS = {"header": "true", "escape": '"', "enforceSchema": "false"}


def blank_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.when(~F.col(c).isin(*MISSING_TEXTS), F.col(c)).alias(c) for c in df.columns]
    )


def file_layouts(spark: SparkSession, files: str) -> list[tuple[list[str], list[str]]]:
    """The headers found in the files, each with the files that have it.

    The first line of every file is found on the executors; the driver gets one row per
    header with its paths, which a reader lists anyway.
    """
    lines = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    )
    first = lines.filter("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups = first.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [
        (next(csv.reader([row.header.removeprefix("\ufeff")])), [unquote(p) for p in row.paths])
        for row in groups.orderBy("header").collect()
    ]


def read_raw_events(spark: SparkSession, directory: str, multi_line: bool = False) -> DataFrame:
    """All ``*.csv`` files of a directory as text columns; fails when there is none.

    Files may differ in their columns and the order of them: those of one header are read
    together, and a column that a file lacks is NULL there. A column that all files lack is
    an error if cleaning needs it. ``multi_line`` reads quoted cells that hold line breaks; a
    file is then one task.
    """
    layouts = file_layouts(spark, f"{directory.rstrip('/')}/*.csv")
    present = {name for names, _ in layouts for name in names}
    needed = [c for c in RAW_EVENTS.names if c not in ("category_id", "category_code", "brand")]
    absent = [c for c in needed if c not in present]
    if absent:
        raise ValueError(f"raw events in {directory} lack columns {absent}")
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line)
    parts = [
        blank_to_null(reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(paths))
        for names, paths in layouts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_events(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Clean events, optionally only some columns; a missing table reads as an empty one."""
    try:
        events = spark.read.schema(CLEAN_EVENTS).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        events = spark.createDataFrame([], CLEAN_EVENTS)
    return events.select(*(columns or CLEAN_EVENTS.names))


def register_events(events: DataFrame, view: str = "events") -> None:
    """Make the events available to ``spark.sql`` under a view name."""
    events.createOrReplaceTempView(view)


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Clean events as snappy Parquet, partitioned by date.

    The rebalance hint lets adaptive execution cut a hot date into several files and
    merge the small ones, so the file count follows the data volume.
    """
    (
        events.hint("rebalance", "date")
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy("date")
        .parquet(path)
    )


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    features.write.mode(mode).parquet(path)


def read_features(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    features = spark.read.parquet(path)
    return features.select(*columns) if columns else features
