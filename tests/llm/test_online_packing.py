import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pageloom.llm import online_packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def piece(key, size):
    return key, 0, size, bytes(4 * size)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=80))
def test_each_step_leaves_the_least_sum_of_squares(sizes):
    """Beside a packer that tries every window and adds up all squares."""
    capacity, levels, rooms = 12, op.Levels(12), []

    def squares(state):
        return sum(n * n for room, n in Counter(state).items() if room)

    for size in sizes:
        tries = [(squares([*rooms, capacity - size]), capacity)]
        for room in set(rooms):
            if room >= size:
                after = list(rooms)
                after[after.index(room)] -= size
                tries.append((squares(after), room))
        least, room = min(tries)
        assert levels.choose(size) == room
        full = levels.put(piece(0, size), size)
        if room == capacity:
            rooms.append(capacity)
        rooms[rooms.index(room)] -= size
        assert bool(full) == (room == size)
        rooms = [r for r in rooms if r]
        assert squares(rooms) == least and levels.n == len(rooms)
        assert sorted(rooms) == [r for r, w in enumerate(levels.windows) for _ in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.sampled_from([1, 2, 7, 16, 20]))
def test_cutting_fills_windows_and_powers_of_two(sizes, capacity):
    ids = [np.arange(i, i + n, dtype="<u4").tobytes() for i, n in enumerate(sizes)]
    found = list(op.cut([(i, 5, len(b) // 4, b) for i, b in enumerate(ids)], capacity))
    filled = [sum(len(p[3]) // 4 for p in s) for s in found]
    short = [n for n in filled if n != capacity]
    assert len(set(short)) == len(short) and all(n & (n - 1) == 0 and n < capacity for n in short)
    again = defaultdict(bytes)
    for sequence in found:
        for key, start, whole, part in sequence:
            assert part and start == 5 + len(again[key]) // 4 and whole == sizes[key]
            again[key] += part
    assert [again[i] for i in range(len(ids))] == ids


def test_open_windows_do_not_follow_the_number_of_documents():
    rng = random.Random(2)

    def left(n):
        levels = op.Levels(256)
        for _ in range(n):
            size = min(256, int(rng.lognormvariate(4, 1)) + 1)
            if size < 256:
                levels.put(piece(0, size), size)
        return levels.n

    few, many = left(4_000), left(40_000)
    assert many < 4 * few and many < 200


def checked(found, rows, capacity):
    """Pieces hold each row's ids once, sequences have no gaps, and padding is none."""
    want, whole = Counter(), Counter()
    for key, text in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, op.END]
        whole[key, len(ids)] += 1
        for at, x in enumerate(ids):
            want[key, at, x] += 1
    got, covered, sequences = Counter(), Counter(), defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        for at, x in enumerate(r.ids):
            got[r.doc_id, r.start + at, x] += 1
        covered[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    assert covered == Counter({(k, n): n * c for (k, n), c in whole.items()})
    fills = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        fills.append(at)
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in fills)
    return fills


ROWS = [(1, None), (2, ""), (3, " \n "), (4, "one two three"), (4, "one two three"), (4, "two"), (None, "x"),
        (5, "word " * 5000), (6, "end")]


@pytest.mark.parametrize("capacity,most", [(2048, 16_384), (16, 16_384), (16, 2), (100, 0), (1, 5)])
def test_pieces_and_places(docs_of, capacity, most):
    rng = random.Random(4)
    rows = ROWS + [(k, "some word " * rng.randint(0, 30)) for k in range(20, 90)]
    found = op.pack(docs_of(rows).repartition(3), PATH, capacity=capacity, open_windows=most, with_ids=True)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert found.columns == names
    checked(found.collect(), rows, capacity)


def test_no_ids_and_no_rows(docs_of):
    assert "ids" not in op.pack(docs_of([(1, "a")]), PATH).columns
    assert op.pack(docs_of([]), PATH).collect() == []


def test_whole_table(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    found = op.pack(docs.repartition(3), PATH, with_ids=True).collect()
    fills = checked(found, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert sum(n < 2048 for n in fills) <= 11 * 3
