import duckdb
import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions.words import words, words_sql

GOLDEN = [
    ("Don't stop", ["don't", "stop"]),  # WB6, WB7
    ("the dogs' 'quoted'", ["the", "dogs", "quoted"]),
    ("l’été d'Ys", ["l’été", "d'ys"]),
    ("3.5 1,000.25 10:30", ["3.5", "1,000.25", "10", "30"]),  # WB11, WB12
    ("a.m. U.S.A.", ["a.m", "u.s.a"]),
    ("example.com x:y a,b", ["example.com", "x:y", "a", "b"]),
    ("v1.5 1.a a.1 A1b2", ["v1.5", "1", "a", "a", "1", "a1b2"]),  # WB9, WB10
    ("snake_case _x __ a_1_", ["snake_case", "_x", "a_1_"]),  # WB13a, WB13b
    ("re-use and/or", ["re", "use", "and", "or"]),
    ("été ñ", ["été", "ñ"]),  # WB4
    ("́ ...", []),
    ("क्षत्रिय हिन्दी", ["क्षत्रिय", "हिन्दी"]),
    ("한국어 텍스트", ["한국어", "텍스트"]),
    ("東京都", ["東京", "京都"]),
    ("漢", ["漢"]),
    ("コーヒーを飲む", ["コー", "ーヒ", "ヒー", "ーを", "を飲", "飲む"]),
    ("ภาษาไทย abc", ["ภา", "าษ", "ษา", "าไ", "ไท", "ทย", "abc"]),
    ("iPhone15を買う", ["iphone15", "を買", "買う"]),
    ("½ x² Ⅷ", ["½", "x²", "ⅷ"]),
    ("אב״ג ג'ירף", ["אב״ג", "ג'ירף"]),
    ("", []),
    (None, []),
]


def test_golden(spark):
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r["i"]: r["w"] for r in table.select("i", words(F.col("t")).alias("w")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(GOLDEN)] == GOLDEN


@pytest.mark.parametrize("text,want", [g for g in GOLDEN if g[0]])
def test_golden_in_sql(text, want):
    assert duckdb.execute(f"SELECT {words_sql('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0] == want


def test_long_words(spark):
    made = [("x" * 300_000, 1), ("a1" * 100_000, 1), ("a.b" * 100_000, 1), ("_" * 200_000, 0), ("京" * 50_000, 49_999)]
    table = spark.createDataFrame([(t,) for t, _ in made], "t string")
    assert [r[0] for r in table.select(F.size(words(F.col("t")))).collect()] == [n for _, n in made]


def test_terms_of_a_query_and_their_hits(spark):
    assert tx.query_terms("Don't 3.5 東京都") == ["don't", "3.5", "東京", "京都"]
    pattern = tx.hit_pattern(F.array(*[F.lit(t) for t in ("3.5", "京都", "don't")]))
    text = F.lit("It is 3.5, not 335; 東京都 don't")
    row = spark.range(1).select(tx.highlight(text, pattern, 100, 3).alias("h")).first()
    assert row["h"] == ["It is <em>3.5</em>, not 335; 東<em>京都</em> <em>don't</em>"]
