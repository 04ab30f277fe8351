"""The content table: insert-only saving, reading, deleting."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import broadcast_if_small, cut, stored
from pageloom.sources.tables import CONTENT_SCHEMA, as_content

ORDER = ("extracted_at", "url")
STORED_SCHEMA = T.StructType([*CONTENT_SCHEMA.fields, T.StructField("batch", T.StringType())])


def accepted(
    batch: DataFrame, existing: DataFrame | None = None, order: tuple[str, ...] = ORDER
) -> DataFrame:
    """Rows of ``batch`` that an insert one by one, in ``order``, would keep.

    A row is refused if its hash or its url is already stored or was accepted before it; a null
    hash never collides, and a refused row blocks nobody. Each round accepts the rows that come
    first for both their hash and their url, then drops all rows these block, so the rounds
    follow the longest chain of such conflicts (one for most data). Only keys take part; the
    first rows are found by partial aggregates, so many copies of one text are no hot spot.
    The full rows are fetched by one join at the end. The batch is written once before anything
    is decided, so clocks and other changing columns are read once, and pages are parsed once.
    """
    batch = stored(batch, "batch")
    keys = ["url", "content_hash", *[c for c in order if c not in ("url", "content_hash")]]
    place = F.struct(*order, F.coalesce("content_hash", F.lit("")))
    rows = batch.select(*keys)
    if existing is not None:
        asked = {c: _shared(existing, rows, c) for c in ("content_hash", "url")}
        for column, taken in asked.items():
            rows = rows.join(taken, column, "left_anti")
    # Of rows equal in url and hash only the first can be accepted.
    pending = cut(
        rows.select("url", "content_hash", place.alias("place"))
        .groupBy("url", "content_hash")
        .agg(F.min("place").alias("place"))
    )
    parts: list[DataFrame] = []
    while not pending.isEmpty():
        by_url = pending.groupBy("url").agg(F.min("place").alias("first_url"))
        by_hash = (
            pending.where(F.col("content_hash").isNotNull())
            .groupBy("content_hash")
            .agg(F.min_by("url", "place").alias("url"), F.min("place").alias("place"))
        )
        # First for its hash and for its url; rows without a hash need only the latter.
        without = pending.where(F.col("content_hash").isNull())
        won = cut(
            by_hash.unionByName(without)
            .join(by_url, "url")
            .where(F.col("place") == F.col("first_url"))
            .select("url", "content_hash", "place")
        )
        parts.append(won)
        pending = cut(
            pending.join(won.select("url"), "url", "left_anti").join(
                won.select("content_hash").where(F.col("content_hash").isNotNull()),
                "content_hash",
                "left_anti",
            )
        )
        if len(parts) > 16:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    if not parts:
        return batch.limit(0)
    chosen = reduce(DataFrame.unionByName, parts).select(
        F.col("url").alias("_url"), F.col("place").alias("_first")
    )
    full = batch.withColumn("_place", place).join(
        chosen, (F.col("url") == F.col("_url")) & (F.col("_place") == F.col("_first")), "left_semi"
    )
    # Rows alike in every key are one insert and refusals of it.
    return full.drop("_place").dropDuplicates(keys)


def _shared(existing: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that the table and the batch share.

    If the batch's values are few, by measure, they go to the table, which is then read where it
    lies, this column only, without being shuffled.
    """
    asked = cut(batch.select(column).where(F.col(column).isNotNull()).distinct())
    return existing.select(column).join(broadcast_if_small(asked), column, "left_semi").distinct()


def save_content(
    spark: SparkSession, path: str, batch: DataFrame, order: tuple[str, ...] = ORDER, part: str | None = None
) -> DataFrame:
    """Append the accepted rows of ``batch`` to the table at ``path``; returns what was written.

    Rows are brought into the shape of the content table first. ``part`` names the folder of this
    batch, so a repeated batch replaces its first attempt.
    """
    name = part or "batch=" + spark.sql("select uuid()").first()[0]
    table = read_content(spark, path)
    if table is not None and part is not None:
        table = table.where(F.col("batch") != part.split("=", 1)[1])
    target = f"{path.rstrip('/')}/{name}"
    accepted(as_content(batch), table, order).write.mode("overwrite").parquet(target)
    return spark.read.schema(CONTENT_SCHEMA).parquet(target)


def read_content(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table with its ``batch`` column, or None before the first save."""
    try:
        table = spark.read.schema(STORED_SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return table


def delete_content(table: DataFrame, deletes: DataFrame) -> DataFrame:
    """The table without the rows whose hash is listed; unknown hashes are no error."""
    return table.join(deletes.select("content_hash").distinct(), "content_hash", "left_anti")
