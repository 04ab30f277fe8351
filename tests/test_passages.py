import math

from pyspark.sql import functions as F

from pageloom.functions.passages import passages, sentences

TEXT = (
    "The red fox runs. It costs 3.5 euro (so they say.) A fox! And a fox, a red fox and the dog\nslept. "
    'He said "stop." Nothing here? Fox fox fox. 東京です。次 no end'
)


def test_sentences(spark):
    row = spark.range(1).select(sentences(F.lit(TEXT)).alias("s"), sentences(F.lit("a bcd efg. x"), 5).alias("p"),
                                sentences(F.lit(None).cast("string")).alias("n"), sentences(F.lit("...")).alias("d")).first()
    assert row["s"] == [
        "The red fox runs.", "It costs 3.5 euro (so they say.)", "A fox!", "And a fox, a red fox and the dog slept.",
        'He said "stop."', "Nothing here?", "Fox fox fox.", "東京です。", "次 no end",
    ]
    assert row["p"] == ["a bcd", "efg.", "x"] and row["n"] == [] and row["d"] == ["..."]


def test_ranked(spark):
    row = spark.range(1).select(passages(F.lit(TEXT), ["fox", "red"], 4).alias("p")).first()["p"]
    assert [(p["coverage"], p["position"]) for p in row] == [(2, 0), (2, 3), (1, 6), (1, 2)]
    assert row[0]["marked"] == "The <em>red</em> <em>fox</em> runs."
    assert row[2]["marked"] == "<em>Fox</em> <em>fox</em> <em>fox</em>."
    sizes = [4, 7, 2, 10, 3, 2, 3, 3, 3]
    n, average = 9, sum(sizes) / 9

    def part(tf, df, dl):
        return math.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))

    assert abs(row[2]["score"] - part(3, 4, 3)) < 1e-5
    assert abs(row[0]["score"] - part(1, 4, 4) - part(1, 2, 4)) < 1e-5


def test_nothing_found(spark):
    row = spark.range(1).select(
        passages(F.lit(TEXT), [], 4).alias("a"), passages(F.lit(TEXT), ["zebra"]).alias("b"),
        passages(F.lit(None).cast("string"), ["fox"]).alias("c"), passages(F.lit("!!!"), ["fox"]).alias("d"),
    ).first()
    assert [row[c] for c in "abcd"] == [[], [], [], []]


def test_unspaced_scripts(spark):
    row = spark.range(1).select(passages(F.lit("東京都です。京都。大阪"), ["京都"]).alias("p")).first()["p"]
    assert [p["marked"] for p in row] == ["<em>京都</em>。", "東<em>京都</em>です。"]
