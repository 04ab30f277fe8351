import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare
from pageloom.operators import content as ct
from pageloom.operators import dedup
from pageloom.plans import views as vw
from pageloom.sources import tables

NAMES = list(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, name):
    """Equal to its SQL, where it has one, and never a pair of every row with every row."""
    status, rows, _, note = compare(spark, name, small)
    assert status in ("ok", "rows"), note
    assert rows > 0


@pytest.mark.parametrize("name", [n for n in NAMES if not n.startswith("stream")])
def test_no_cross_join(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_recent_is_top_k(spark, small):
    text = plan(ct.recent_content(vw.content(spark, small)))
    assert "TakeOrderedAndProject" in text


def test_scan_reads_only_what_is_used(spark, small):
    text = plan(vw.content(spark, small).select("author").where("author = 'src1'"))
    assert "ReadSchema: struct<source:string>" in text
    assert "EqualTo(source,src1)" in text


def test_dedup_limits_before_shuffle(spark, small):
    text = plan(dedup.exact_dedup(vw.content(spark, small)))
    assert text.count("WindowGroupLimit") >= 2


def test_entry(spark):
    assert entry.entry(spark).agg(F.count("*")).first()[0] > 0
