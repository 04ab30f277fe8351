import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.Coder(PATH, public_tokenizers.PATTERN)
TRUE = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={}
)


def ids(text):
    return np.frombuffer(CODER.encode(text), np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aabbee é's tTh\t\n\x1c\x85\xa0　12½²漢字🙂́ſKİǅª.,!?#–", max_size=50))
def test_ids_equal_the_library(text):
    assert ids(text) == TRUE.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == TRUE.encode_ordinary(text)


def test_very_long_pre_tokens():
    rng = random.Random(1)
    for text in ("a" * 20_000, "ab" * 9_000, " " * 9_000, "é" * 5_000, "".join(rng.choices("etaoin", k=60_000))):
        assert ids(text) == TRUE.encode_ordinary(text)
    assert len(ids("".join(rng.choices("etaoinshr", k=1_000_000)))) > 100_000


def test_queue_is_empty_after_each_piece():
    ids("some words and more of them")
    assert not CODER.buckets and not any(CODER.words)


def test_round_trip_of_awkward_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "aé漢 \n"), (3, "aé漢 \n"), (None, "x"), (4, "long " * 20_000)]
    coded = bpe.encode(docs_of(rows), PATH, public_tokenizers.PATTERN)
    found = bpe.decode(coded, PATH).collect()
    got = sorted((repr(r.doc_id), bytes(r.bytes).decode(), len(r.ids)) for r in found)
    assert got == sorted((repr(k), t or "", len(TRUE.encode_ordinary(t or ""))) for k, t in rows)
    assert bpe.decode(bpe.encode(docs_of([]), PATH, public_tokenizers.PATTERN), PATH).collect() == []


def test_decode_keeps_nulls_and_other_columns(shared):
    coded = shared.createDataFrame([(1, None, "x"), (2, [], "y")], "k int, ids array<int>, other string")
    assert [tuple(r) for r in bpe.decode(coded, PATH).collect()] == [(1, None, "x", None), (2, [], "y", b"")]


def test_whole_table(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect():
        assert r.ids == TRUE.encode_ordinary(text[r.doc_id] or "")
