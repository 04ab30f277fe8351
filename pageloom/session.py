"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where keeping the output partitioning would save a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written tables.

    A cluster names it in ``spark.checkpoint.dir``; a session may also have set it itself.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so the plan restarts there and executor loss
    costs no recomputation of earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Like ``cut`` the plan restarts from files that outlive executors, but later reads take only
    the columns they use, and can filter while they read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_CHARS = 10_000_000


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_CHARS) -> DataFrame:
    """``table``, to be sent to every executor only if its measured size allows that.

    The table should be a lineage cut: it is read once to add up the length of its rows.
    """
    length = F.length(F.to_json(F.struct(*table.columns)))
    size = table.agg(F.coalesce(F.sum(length), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(table) if size <= limit else table


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
