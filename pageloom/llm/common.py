"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import new_path

SPACE = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_PLACE = {"start": T.IntegerType(), "stop": T.IntegerType()}
SPANS = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in {"kind": T.StringType(), **_PLACE}.items()])
)
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
)


def by_value(module: str) -> None:
    """Ship the functions of ``module`` with each task, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: where a task holds very many words and no cycles, walking them
    costs more than all else. The worker's next task finds collection as it was."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collecting:
            gc.enable()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The plan restarts from files that outlive executors, and later reads take only the columns
    they use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of ``text``: runs of anything but the six white-space characters of ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def apart(df: DataFrame, taken: Sequence[str]) -> str:
    """A prefix for helper columns that no column of ``df`` and no name in ``taken`` begins with."""
    prefix = "_w"
    names = [c.lower() for c in [*df.columns, *taken]]
    while any(n.startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix
