"""Arrow ways for plain texts against the Column functions, and blocks against a plain loop."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import plain, workers
from pageloom.functions import text as tx
from pageloom.functions.arrays import value_counts
from pageloom.operators import index
from pageloom.operators import search as se
from pageloom.operators.readability import LETTERS

TERMS = ["a", "b.c", "é"]


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(5)
    pool = [chr(i) for i in range(1, 256)] + list("Œœ–—‘’“”„…€")
    many = list("aabbcAZzéÉ019_.,;:'’· \n\t-ß")
    made = ["".join(random.choice(many if random.random() < 0.8 else pool) for _ in range(random.randint(0, 60)))
            for _ in range(3_000)]
    odd = [None, "", "a 漢字 x", "İstanbul ΣΑΣ a.b 3,5 __ _a_", "Word word aaaa bbbb the cccc " * 50_000]
    rows = spark.createDataFrame(list(enumerate(made + odd)), "id int, t string")
    return rows.repartition(4)


@pytest.mark.parametrize(
    "fast, slow",
    [
        (plain.word_counts, lambda t: F.struct(F.size(tx.tokens(t)), value_counts(tx.tokens(t)))),
        (plain.word_number, lambda t: F.size(tx.tokens(t))),
        (lambda t: plain.term_counts(t, TERMS),
         lambda t: F.array(F.size(tx.tokens(t)), *[F.size(F.filter(tx.tokens(t), lambda w: w == x)) for x in TERMS])),
        (lambda t: plain.reading_counts(t, LETTERS),
         lambda t: F.struct(tx.word_count(t), F.regexp_count(t, F.lit("[.!?]+")),
                            value_counts(F.regexp_extract_all(F.lower(t), F.lit(LETTERS), F.lit(0))))),
        (plain.clean_text, tx.clean_text),
        (lambda t: plain.keywords(t, 3), lambda t: tx.keywords(t, 3)),
    ],
)
def test_plain_texts(texts, fast, slow):
    rows = texts.select("t", fast(F.col("t")).alias("fast"), slow(F.col("t")).alias("slow"))
    assert rows.count() == 3_005
    # As text, since the names of fields differ.
    wrong = rows.where(~F.col("fast").cast("string").eqNullSafe(F.col("slow").cast("string")))
    assert wrong.collect() == []


def test_words_in_batches(texts):
    """The texts are taken apart in Arrow batches; only others by Column functions."""
    docs = texts.select(F.col("id").alias("content_hash"), *[F.col("t").alias(f) for f in index.FIELDS])
    for made in (index.postings(docs), se.scan_scores(docs, "a b.c")):
        assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()


def test_blocks():
    random.seed(7)
    rows = sorted(
        {(d, f, t): (random.randint(1, 4), random.randint(1, 9)) for d in range(1_000) for f in "xy"
         for t in random.choices("abcdefgh", k=5)}.items()
    )
    kind = pa.schema([("_doc", pa.int64()), ("field", pa.string()), ("term", pa.string()), ("tf", pa.int32()), ("dl", pa.int32())])
    records = [dict(zip(kind.names, (*key, *value))) for key, value in rows]
    batches = [pa.RecordBatch.from_pylist(records[i : i + 77], kind) for i in range(0, len(records), 77)]
    wanted = {}
    for r in records:
        wanted.setdefault((r["term"], r["field"], r["_doc"] >> 3), []).append((r["_doc"], r["tf"], r["dl"]))
    got = {}
    for block in (b for made in workers.blocks(3, rows=500)(iter(batches)) for b in made.to_pylist()):
        key = block["term"], block["field"], block["range"]
        assert key not in got
        got[key] = [(p["_doc"], p["tf"], p["dl"]) for p in block["postings"]]
        assert block["n"] == len(got[key])
        pairs = {(tf, dl) for _, tf, dl in got[key]}
        beaten = {p for p in pairs for q in pairs if q != p and q[0] >= p[0] and q[1] <= p[1]}
        assert [(p["tf"], p["dl"]) for p in block["impacts"]] == sorted(pairs - beaten, reverse=True)
    assert got == wanted
    assert list(workers.blocks(3)(iter(batches[:0]))) == []
