import pytest
from pyspark.sql import functions as F

from pageloom.operators import seen


def keys(spark, numbers):
    return spark.createDataFrame([(None if n is None else f"k{n}",) for n in numbers], "url_hash string")


def test_equal_to_an_anti_join(spark):
    known = keys(spark, [*range(0, 3000, 2), 4, 4, None])
    asked = keys(spark, [*range(2000, 4000), 5, 5, 6, None]).withColumn("n", F.monotonically_increasing_id())
    for capacity in (1500, 10):  # the second is far too small, and so only slower
        blocks = seen.blocks_for(capacity)
        table = seen.seen_filter(known, blocks)
        got = seen.not_seen(asked, known, table, blocks)
        want = asked.join(known.where("url_hash is not null"), "url_hash", "left_anti").select(*asked.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_false_alarms_and_growth(spark):
    first = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    later = spark.range(40_000, 65_536).select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    blocks = seen.blocks_for(65_536)
    assert blocks == 2048
    table = seen.extended(seen.seen_filter(first, blocks), later, blocks).cache()
    whole = seen.seen_filter(first.unionByName(later), blocks)
    assert table.exceptAll(whole).count() == 0 and table.count() == whole.count() == blocks
    others = spark.range(10**6, 10**6 + 100_000).select(F.md5(F.col("id").cast("string")).alias("url_hash"))
    assert seen.marked(others, table, blocks).where("maybe").count() < 500
    assert seen.marked(first, table, blocks).where("not maybe").count() == 0


@pytest.mark.parametrize("rows", [[], [None]])
def test_no_rows(spark, rows):
    known, asked = keys(spark, rows), keys(spark, [1, None])
    table = seen.seen_filter(known, 1)
    assert seen.not_seen(asked, known, table, 1).count() == 2
    assert seen.not_seen(known, asked, seen.seen_filter(asked, 1), 1).count() == len(rows)


def test_the_set_is_not_shuffled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "seen")
    keys(spark, range(5000)).write.parquet(path)
    known, asked = spark.read.parquet(path), keys(spark, range(4990, 5010))
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(seen, "cut", kept)
    blocks = seen.blocks_for(5000)
    assert seen.not_seen(asked, known, seen.seen_filter(known, blocks), blocks).count() == 10
    scan = next(p for p in plans if "LeftSemi" in p)
    below = scan[scan.index("LeftSemi") :].split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in scan and "FileScan" in below and "hashpartitioning" not in below
