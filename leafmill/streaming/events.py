"""Structured Streaming: event windows with late data, and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import scratch


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stream of the Parquet files of one table, a file or a folder below ``folder``."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}.parque[t]")
    # watermarks need times with a zone
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, or sliding ones with ``slide``; rows later than ``late`` are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        seen.groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events no more than ``gap`` apart."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> None:
    """Runs a stream over all that is there and stops; a restart with the same ``state`` goes on where it ended."""
    place = state or scratch(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def streamed_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream over all that is there: of complete mode its last state, of append mode all rows."""
    spark = stream.sparkSession
    path = scratch(spark)

    def sink(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    run_available(stream, sink, mode)
    return spark.read.schema(stream.schema).parquet(path)
