import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageloom.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, TOKENIZER = p.Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aEé ÉßİıſKς́.,'s12\t\n\x0b\x1c\x85\xa0　漢!?&<|>", max_size=40))
def test_ids_equal_the_tokenizer(text):
    got = np.frombuffer(next(ENCODER([text])), "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_special_strings_and_long_words():
    texts = ["a <|endoftext|> b<|startoftext|>", "x" * 3000, "", None, "ab" * 2000 + " c"]
    for text, got in zip(texts, ENCODER(texts)):
        want = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want


def used(plan, capacity):
    total = Counter()
    for filling in plan:
        assert sum(x * n for x, n in filling.items) <= capacity and filling.copies > 0
        for x, n in filling.items:
            total[x] += n * filling.copies
    return total


def fewest(lengths, capacity):
    """By trying every way to put pieces into open sequences."""
    best = [len(lengths)]

    def put(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= lengths[at] and room not in rooms[:k]:
                put(at + 1, [*rooms[:k], room - lengths[at], *rooms[k + 1 :]])
        put(at + 1, [*rooms, capacity - lengths[at]])

    put(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_few_pieces_are_packed_as_tightly_as_can_be(lengths):
    plan = p.plan_fillings(Counter(lengths), 20)
    assert used(plan, 20) == Counter(lengths)
    assert p.bins(plan) == (fewest(sorted(lengths, reverse=True), 20) if lengths else 0)


def test_search_beats_best_fit():
    """Best fit needs four sequences here, three are enough."""
    lengths = [6, 5, 5, 4, 4, 3, 3]
    counts = Counter(lengths)
    assert p.bins(p.plan_fillings(counts, 10)) == 3


@pytest.mark.parametrize(
    "lengths,capacity,want",
    [
        ([85, 85, 6, 5, 5, 5, 3, 3, 3], 100, 2),
        ([2596, 2596, 600, 500, 500, 500, 300, 300, 300], 4096, 2),
        ([50] * 4 + [14, 12, 12, 12] * 2 + [20, 10, 10, 10] * 2, 100, 4),
    ],
)
def test_sets_of_any_number_of_pieces(lengths, capacity, want):
    plan = p.plan_fillings(Counter(lengths), capacity)
    assert used(plan, capacity) == Counter(lengths) and p.bins(plan) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(12, 40))
def test_small_pieces_are_packed_as_tightly_as_can_be(lengths, capacity):
    plan = p.plan_fillings(Counter(lengths), capacity)
    assert used(plan, capacity) == Counter(lengths)
    assert p.bins(plan) == (fewest(sorted(lengths, reverse=True), capacity) if lengths else 0)


def test_many_pieces_meet_the_bound():
    rng = random.Random(3)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(30_000))
    plan = p.plan_fillings(counts)
    assert used(plan, 4096) == counts
    assert p.bins(plan) <= 1.001 * sum(k * v for k, v in counts.items()) / 4096 + 1


def packed(rows, capacity=None):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_pieces_and_places(docs_of, capacity):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"), (None, "x"),
            (5, "word " * 5000), (6, "end")]
    found = p.pack(docs_of(rows), PATH, capacity=capacity, with_ids=True).collect()
    want = Counter()
    for k, t in rows:
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(k, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part))] += 1
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found)
    assert got == want
    total = sum(r.length for r in found)
    assert packed(found, capacity) == -(-total // capacity)


def test_empty_table(docs_of):
    assert p.pack(docs_of([]), PATH).collect() == []


def test_whole_table(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet").repartition(3)
    found = p.pack(docs, PATH).collect()
    assert packed(found, 4096) == -(-sum(r.length for r in found) // 4096)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in found} == set(text)
    lengths = Counter()
    for r in found:
        lengths[r.doc_id] += r.length
    for k, n in lengths.items():
        assert n == len(TOKENIZER.encode(text[k] or "", add_special_tokens=False).ids) + 1
