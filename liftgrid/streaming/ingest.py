"""Incremental ingestion of raw event files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from liftgrid.operators.cleaning import clean_events
from liftgrid.schemas import RAW_EVENTS
from liftgrid.sources.events import CSV_OPTIONS, blank_to_null


def raw_event_stream(
    spark: SparkSession, directory: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """CSV files of a directory as a stream, each file once."""
    reader = spark.readStream.options(**CSV_OPTIONS).schema(RAW_EVENTS)
    reader = reader.option("pathGlobFilter", "*.csv")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return blank_to_null(reader.csv(directory))


def ingest_events(raw: DataFrame, events_path: str, checkpoint_dir: str) -> StreamingQuery:
    """Clean what is new and append it to the event table, then stop.

    The checkpoint remembers the files done, so a rerun after a crash neither skips nor
    repeats a file. Cleaning keeps no state.
    """
    return (
        clean_events(raw)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("date")
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start(events_path)
    )
