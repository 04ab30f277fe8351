"""Structured Streaming jobs: ingest, duplicate removal, rolling topic counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from pageloom.functions.workers import in_order
from pageloom.sources import store

IN_ORDER = 128  # parts of a batch that are put in order, each held by one task


def read_stream(spark: SparkSession, folder: str, name: str, schema: str, files: int = 1000) -> DataFrame:
    """New files of one table in ``folder`` as a stream; a table is a file or a folder of files."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files)
        .parquet(f"{folder.rstrip('/')}/{name}*.parquet")
    )


def ingest(content: DataFrame, table: str, state: str, available_now: bool = True) -> StreamingQuery:
    """Save a stream of content records batch by batch, with the rules of a single save.

    A batch that is repeated after a failure replaces its first attempt.
    """

    def save(batch: DataFrame, number: int) -> None:
        store.save_content(batch.sparkSession, table, batch, part=f"batch={number}")

    writer = content.writeStream.foreachBatch(save).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(content: DataFrame, time: str, delay: str, key: str = "content_hash") -> DataFrame:
    """First record of each key; the state of a key is kept for ``delay``. Records without a key
    are told apart by their url.

    Records older than the newest one by more than ``delay`` are not taken any more, as their key
    may be forgotten; ``late_rows`` counts them. So ``delay`` has to cover the spread of a backfill.
    Of equal keys in one batch the earliest by ``time`` and url is the first, whichever of the batch's
    files it stands in: rows are put in that order among those of like keys, in ``IN_ORDER`` parts, as a
    stream cannot be sorted.
    """
    own = F.when(F.col(key).isNull(), F.col("url"))
    ordered = (
        content.withColumn("_own", own)
        .repartition(IN_ORDER, key, "_own")
        .mapInArrow(in_order([time, "url"]), StructType([*content.schema, StructField("_own", StringType())]))
    )
    return (
        ordered.withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([key, "_own"])
        .drop("_own")
    )


def trending(
    documents: DataFrame,
    time: str,
    delay: str | None = None,
    length: str = "7 days",
    slide: str = "1 day",
) -> DataFrame:
    """Documents of each topic in sliding windows: ``window_start, window_end, topic, count``.

    Without ``delay`` every document counts, however late; there is one state row for each window
    and topic. With it, windows that ended that long before the newest document are closed.
    """
    rows = documents if delay is None else documents.withWatermark(time, delay)
    return (
        rows.select(time, F.explode(F.array_distinct("tags")).alias("topic"))
        .groupBy(F.window(time, length, slide).alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "topic",
            "count",
        )
    )


def write_changes(
    stream: DataFrame, path: str, state: str, available_now: bool = True
) -> StreamingQuery:
    """Write the rows that each batch changed, in a folder of its own; a batch that is repeated
    after a failure replaces its first attempt. ``read_changes`` gives the present state."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_changes(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The last row of each key among what ``write_changes`` wrote."""
    rows = spark.read.option("basePath", path).parquet(path)
    rest = F.struct(*[c for c in rows.columns if c not in key and c != "batch"])
    return rows.groupBy(*key).agg(F.max_by(rest, "batch").alias("_last")).select(*key, "_last.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the state of a stream and were left out, so far as its progress
    reports reach back."""
    return sum(
        s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]
    )


def write_files(
    stream: DataFrame, path: str, state: str, available_now: bool = True
) -> StreamingQuery:
    """Append what a stream has finished to parquet files."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
