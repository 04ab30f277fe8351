import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.operators import readability as rd

# The patterns that Liang's thesis shows for one word, and some for others.
ENGLISH = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n", ".ta4b", "1ta", "ta1ble", "4le.", "com1p", "1put", "4er.", "pu1ter"]
GERMAN = ["1kö", "n2ig", "1nig.", "ö1n", "1sche", "s2ch", "1gart", "r1t", "n1g", "1ten", "kin1d", "1der"]


def table(spark, patterns):
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def by_hand(word, patterns):
    """Every pattern tried at every place."""
    text = f".{word}."
    marks = [0] * (len(text) + 1)
    for pattern in patterns:
        piece, numbers = "", [0]
        for c in pattern:
            if c.isdigit():
                numbers[-1] = int(c)
            else:
                piece += c
                numbers.append(0)
        for start in range(len(text)):
            if text.startswith(piece, start):
                for j, n in enumerate(numbers):
                    marks[start + j] = max(marks[start + j], n)
    return [i - 1 for i in range(len(text)) if marks[i] % 2 and 2 <= i - 1 <= len(word) - 2]


@pytest.mark.parametrize(
    "patterns,golden",
    [
        (ENGLISH, {"hyphenation": "hy-phen-ation", "table": "table", "computer": "com-pu-ter", "a": "a", "nation": "na-tion"}),
        (GERMAN, {"könig": "kö-nig", "kindergarten": "kin-der-gar-ten", "kirsche": "kir-sche", "xyz": "xyz"}),
    ],
)
def test_words(spark, patterns, golden):
    words = spark.createDataFrame([(w,) for w in [*golden, *golden]] + [(None,), ("",)], "word string")
    got = {r["word"]: r["breaks"] for r in rd.breaks(words, table(spark, patterns)).collect()}
    assert got.pop("") == []
    assert got == {w: by_hand(w, patterns) for w in golden}
    for word, shown in golden.items():
        ends = [0, *got[word], len(word)]
        assert "-".join(word[a:b] for a, b in zip(ends, ends[1:])) == shown


def test_scores(spark):
    text = "Hyphenation computer. A table, computer!"
    rows = [(1, text), (1, text), (2, None), (3, "..."), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(repr, (tuple(r) for r in rd.flesch_reading_ease(docs, table(spark, ENGLISH)).collect())))
    score = round(206.835 - 1.015 * (5 / 2) - 84.6 * ((3 + 3 + 1 + 1 + 3) / 5), 2)
    plain = round(206.835 - 1.015 * (1 / 1), 2)
    assert got == sorted(map(repr, [(1, score), (1, score), (2, 206.84), (3, plain), (None, 206.84)]))


def test_no_patterns(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id int, text string")
    got = rd.flesch_reading_ease(docs, table(spark, [])).first()["score"]
    assert got == round(206.835 - 1.015 * 3 - 84.6, 2)
    assert docs.select(tx.flesch_reading_ease(F.col("text"))).first()[0] < got
