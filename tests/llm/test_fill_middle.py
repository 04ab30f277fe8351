import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import fill_middle as fm

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="aé漢😀 \t\n\x0b\x1c\x85\xa0<P>S", max_size=60)


def by_hand(key, text, seed=42, rate=50, share=80):
    """As the rule says, over Python strings."""
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in fm.MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < share:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_every_cut_of_a_text(text, block):
    units, found = fm.Units(text.encode(), block), UNIT.findall(text)
    assert units.n == len(found)
    for k, (size, chars) in enumerate(units.cuts(range(units.n + 1))):
        start = "".join(found[:k])
        assert (size, chars) == (len(start.encode()), len(start))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), TEXTS, st.integers(1, 7))
def test_one_text_at_a_time(key, text, block):
    digits = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    draws = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    marks = [m.encode() for m in fm.MARKS]
    got = fm.rearranged(text.encode(), draws, marks, 100, 80, block)
    assert (*got[:4], got[4].decode()) == by_hand(key, text, rate=100)


ROWS = [
    (1, None), (2, ""), (3, " \n "), (None, "a null key"), (5, "holds <M> a mark <"), (6, "é漢 😀\x85x \x0c"),
    (7, "<"), (7, "<"), (7, "another row of 7"),
]


@pytest.mark.parametrize("rate,share", [(50, 80), (100, 0), (100, 100), (0, 80)])
def test_rows_and_their_way_back(docs_of, rate, share):
    rng = random.Random(1)
    long = " ".join("wörd" * rng.randint(1, 4) + rng.choice([".", "\n", ""]) for _ in range(60_000))
    rows = [*ROWS, (8, long), (9, "x" * 300_000)] + [
        (k, "".join(rng.choice("ab é<PSM>\n") for _ in range(rng.randint(0, 40)))) for k in range(20, 120)
    ]
    made = fm.transform(docs_of(rows), rate=rate, spm_share=share, block=64)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("text", fm.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((k, t or "", *by_hand(k, t, rate=rate, share=share)) for k, t in rows), key=repr)
    assert sorted(((r.doc_id, r.text, *r[1:6]) for r in got), key=repr) == want


def test_empty_table(docs_of):
    assert fm.transform(docs_of([])).collect() == []


def test_whole_table(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in fm.transform(docs).collect()}
    assert got == {r.doc_id: by_hand(r.doc_id, r.text) for r in docs.collect()}
    assert {v[1] for v in got.values()} == {"plain", "spm", "psm"}
