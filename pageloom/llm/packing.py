"""Best-fit packing of tokenised documents into sequences of one length.

Tokenising is one pass over the texts. What packing has to decide depends on piece lengths only,
of which there are at most ``capacity``: a histogram of that many rows at most goes to the
driver, whatever the size of the table, and bin completion runs on it. Its plan is a list of
fillings with the number of sequences filled so; each uses up some length, so the plan stays
small too. The pieces then find their places by their rank among the pieces of their length,
which is a count of earlier tasks' pieces plus a running number within the task.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from importlib.util import find_spec
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pageloom.llm.common import by_value, stored, uncollected

by_value(__name__)

CAPACITY = 4096
END = 1
NODES = 1_000
WIDTH = 8

# No long word is kept, so these take 300 bytes each at most, and mostly 170.
_CACHED_WORDS, _CACHED_LENGTH, _TEXTS = 600_000, 64, 4096
_TAIL, _AFTER_LATIN = ".,;:!?*&$%#|)]}>", "\u0250"
_DOTTED = "\u0130"  # two characters in lower case
_ODD_SPACES = "\x1c\x1d\x1e\x1f"


# Tokens

# Byte-level tokenizers write bytes that print nothing as characters from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = dict(zip(sorted(set(range(256)) - set(_PRINTED)), range(256, 512)))

class Encoder:
    """The ids of whole texts as little-endian bytes.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its
    words one after another, and the ids of words already seen are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        if find_spec("pageloom"):  # as where executors have the package
            from pageloom.llm.kept import cache

            self.known = cache(f"words {path}")

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def learn(self, new: list[str]) -> None:
        """Add ``new`` words to those known.

        A run of Latin letters is one pre-token. It gives the same ids whatever punctuation
        follows and whatever its case in ASCII, so many new words are made up of known ones, and
        it goes straight to the merges.
        """
        made, cores, tails, others = [], [], [], []
        for w in new:
            core = w.rstrip(_TAIL)
            if not core.isalpha():
                others.append(w)
            elif core.isascii():
                made.append(w)
                tails.append(w[len(core) :])
                cores.append(core.lower())
            elif max(core) < _AFTER_LATIN and _DOTTED not in core:
                made.append(w)
                tails.append(w[len(core) :])
                cores.append(core)
            else:
                others.append(w)
        known, merge = self.known, self.tokenizer.model.tokenize
        for core in set(cores).difference(known):
            symbols = core if core.isascii() else core.lower().encode().decode("latin-1").translate(_SYMBOLS)
            known[core] = array("I", [t.id for t in merge(symbols)]).tobytes()
        rest = list({*tails, *others}.difference(known))
        known.update(zip(rest, self.encode(rest)))
        ids_of = known.__getitem__
        known.update(zip(made, map(add, map(ids_of, cores), map(ids_of, tails))))

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), _TEXTS):
            yield from self._part([t or "" for t in texts[at : at + _TEXTS]])

    def _part(self, texts: list[str]) -> Iterator[bytes]:
        """Each distinct word is looked up once, and texts are put together from the words' numbers."""
        # Python and Arrow split at four control characters that are no white space to the tokenizer.
        whole = [any(c in t for c in _ODD_SPACES) for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if w else t for w, t in zip(whole, texts)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        vocabulary, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        new = [w for w in vocabulary if w not in known]
        if new:
            self.learn(new)
        ids = [known[w] for w in vocabulary]
        sizes = np.array([len(i) // 4 for i in ids], np.int64)
        lists = pa.LargeListArray.from_arrays(
            np.append(0, np.cumsum(sizes)), pa.array(np.frombuffer(b"".join(ids), np.uint32))
        )
        all_ids = lists.take(coded.indices).flatten().to_numpy().tobytes()
        before = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))[split.offsets.to_numpy()] * 4
        for t, odd, a, b in zip(texts, whole, before.tolist(), before[1:].tolist()):
            yield self.encode([t])[0] if odd else all_ids[a:b]
        for w in new:
            if len(w) > _CACHED_LENGTH:
                known.pop(w, None)
        if len(known) > _CACHED_WORDS:
            known.clear()
            known.update((w, i) for w, i in zip(vocabulary, ids) if len(w) <= _CACHED_LENGTH)


PIECE_FIELDS = [
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
]


def _cutter(path: str, capacity: int, end: int, with_ids: bool):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        with uncollected():
            for batch in batches:
                rows: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "crc", "nth")}
                kept = []
                for row, ids in enumerate(encoder(batch.column(1).to_pylist())):
                    ids += tail
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        length = len(part) // 4
                        values = (row, piece, at // 4, length, zlib.crc32(part), int(seen[length]))
                        for column, value in zip(rows.values(), values):
                            column.append(value)
                        seen[length] += 1
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                columns = {
                    "key": batch.column(0).take(pa.array(rows["row"], pa.int64())),
                    "piece": pa.array(rows["piece"], pa.int32()),
                    "start": pa.array(rows["start"], pa.int64()),
                    "length": pa.array(rows["length"], pa.int64()),
                    "ids_crc32": pa.array(rows["crc"], pa.int64()),
                    "task": pa.array([task] * len(rows["row"]), pa.int64()),
                    "nth": pa.array(rows["nth"], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


# The plan


@dataclass(frozen=True)
class Filling:
    """``copies`` sequences that hold ``items``: lengths, longest first, and how many of each."""

    items: tuple[tuple[int, int], ...]
    copies: int


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.total = int((self.left * np.arange(capacity + 1)).sum())

    def longest(self, most: int) -> int:
        """The longest length left of at most ``most``; 0 if there is none."""
        found = np.flatnonzero(self.left[: most + 1])
        return int(found[-1]) if len(found) else 0

    def change(self, filling: Filling, sign: int) -> None:
        for length, n in filling.items:
            self.left[length] += sign * n * filling.copies
            self.total += sign * n * filling.copies * length


def _items(lengths: list[int]) -> tuple[tuple[int, int], ...]:
    return tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))


def _pairs(left: np.ndarray, total: int, most: int) -> list[list[int]]:
    """At most ``most`` pairs with the sum ``total``, those with the longest item first."""
    if total < 2:
        return []
    half = total // 2
    fits = np.flatnonzero((left[1 : half + 1] > 0) & (left[total - half : total][::-1] > 0)) + 1
    if len(fits) and 2 * fits[-1] == total and left[half] < 2:
        fits = fits[:-1]
    return [[total - y, y] for y in fits[:most].tolist()]


def _triples(left: np.ndarray, total: int, most: int) -> list[list[int]]:
    """Three pieces with the sum ``total``, if the longest pieces that fit have any."""
    for x in np.flatnonzero(left[:total])[::-1][:most].tolist():
        left[x] -= 1
        found = _pairs(left, total - x, 1)
        left[x] += 1
        if found:
            return [[x, *found[0]]]
    return []


def _exact(lengths: _Lengths, room: int, width: int) -> list[list[int]]:
    """Some sets of pieces that fill ``room``, found fast: pairs and triples, after a run of the
    longest piece while there is room for several more of it."""
    left = lengths.left
    base = []
    while (longest := lengths.longest(room)) and room >= 4 * longest:
        n = min(int(left[longest]), room // longest - 2)
        base += [longest] * n
        left[longest] -= n
        room -= n * longest
    found = _pairs(left, room, width) or _triples(left, room, 2 * width)
    for x in base:
        left[x] += 1
    return [base + f for f in found]


def _sets(left: np.ndarray, room: int, waste: int) -> Iterator[list[int]]:
    """All sets of pieces that leave at most ``waste`` of ``room``, the fullest first and those
    with the longest pieces before others.

    A bitmap for each length says which sums it and the shorter ones make, so no branch is entered
    that leads to no set.
    """
    sizes = (np.flatnonzero(left[1 : room + 1]) + 1)[::-1].tolist()
    most = [min(int(left[x]), room // x) for x in sizes]
    sums, mask = [1], (1 << (room + 1)) - 1
    for x, n in zip(reversed(sizes), reversed(most)):
        made, step = sums[-1], 1
        while n:
            taken = min(step, n)
            made |= (made << (x * taken)) & mask
            n, step = n - taken, 2 * step
        sums.append(made)
    sums.reverse()

    def walk(at: int, rest: int) -> Iterator[list[int]]:
        if not rest:
            yield []
        for k in range(at, len(sizes) if rest else at):
            if not sums[k] >> rest & 1:
                return
            x = sizes[k]
            for n in range(min(most[k], rest // x), 0, -1):
                if sums[k + 1] >> (rest - n * x) & 1:
                    for others in walk(k + 1, rest - n * x):
                        yield [x] * n + others

    for total in range(room, max(room - waste, 0) - 1, -1):
        if sums[0] >> total & 1:
            yield from walk(0, total)


def _dominated(left: np.ndarray, found: list[int], waste: int) -> bool:
    """Whether one more piece, or a longer one in the place of another, fits as well."""
    if not waste:
        return False
    free = left.copy()
    for x in found:
        free[x] -= 1
    return any(bool((free[x + 1 : x + waste + 1] > 0).any()) for x in {0, *found})


def _fillings(
    lengths: _Lengths, first: int, capacity: int, width: int, waste: int
) -> Iterator[Filling | None]:
    """Ways to complete the sequence of a piece of length ``first`` that waste at most ``waste``.

    One piece that fits exactly dominates all else. Otherwise some exact fits that are found fast
    come first, and then all other undominated sets, the fullest first; None stands for one that is
    dominated. Each is used as often as its lengths last and the waste allows, and then in fewer
    copies, down to one. ``lengths`` has to be as it was whenever the next one is asked for.
    """
    left, room = lengths.left, capacity - first

    def used(found: list[int], fewer: bool = True) -> Iterator[Filling]:
        items, unused = _items([first, *found]), room - sum(found)
        copies = min(int(left[x]) // n for x, n in items)
        copies = min(copies, waste // unused) if unused else copies
        while copies:
            yield Filling(items, copies)
            copies = copies // 2 if fewer else 0

    left[first] -= 1
    single = room > 0 and left[room] > 0
    fast = [] if single else _exact(lengths, room, width)
    left[first] += 1
    if single:
        yield from used([room], fewer=False)
        return
    for found in fast:
        yield from used(found)
    known = {_items(found) for found in fast}
    rest = left.copy()
    rest[first] -= 1
    for found in _sets(rest, room, waste):
        if _items(found) not in known:
            if _dominated(rest, found, room - sum(found)):
                yield None
            else:
                yield from used(found)


def _greedy(lengths: _Lengths, capacity: int) -> list[Filling]:
    """Best fit, longest first: each sequence takes the longest piece that fits, again and again."""
    plan = []
    while lengths.total:
        items, room = [], capacity
        while length := lengths.longest(room):
            n = min(int(lengths.left[length]), room // length)
            items.append((length, n))
            lengths.left[length] -= n
            room -= n * length
        for length, n in items:
            lengths.left[length] += n
        filling = Filling(tuple(items), min(int(lengths.left[x]) // n for x, n in items))
        lengths.change(filling, -1)
        plan.append(filling)
    return plan


def bins(plan: list[Filling]) -> int:
    return sum(f.copies for f in plan)


def plan_fillings(
    counts: Mapping[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH
) -> list[Filling]:
    """Bin completion: branch and bound over fillings around the longest piece left.

    The best-fit solution is the first incumbent, and each better one found takes its place. A
    branch ends where the waste so far cannot lead to fewer sequences than the incumbent has, or
    where the same pieces were left before after as few sequences. The search ends where it has
    tried everything, where the incumbent meets the bound on total length, or after ``nodes``
    fillings and one for each length.
    """
    lengths = _Lengths(counts, capacity)
    if not lengths.total:
        return []
    best = _greedy(_Lengths(counts, capacity), capacity)
    bound = -(-lengths.total // capacity)
    path: list[tuple[Iterator[Filling | None], Filling]] = []
    used, budget = 0, nodes + len(counts)
    before: dict[bytes, int] = {}
    choices: Iterator[Filling | None] | None = None
    while bins(best) > bound and budget > 0:
        if choices is None:
            waste = (bins(best) - 1 - used) * capacity - lengths.total
            if waste >= 0 and not lengths.total:
                best = [f for _, f in path]
                waste = -1
            state = hashlib.blake2b(lengths.left.tobytes(), digest_size=16).digest()
            if waste < 0 or before.get(state, used + 1) <= used:
                choices = iter(())
            else:
                before[state] = used
                choices = _fillings(lengths, lengths.longest(capacity), capacity, width, waste)
        budget -= 1
        try:
            filling = next(choices)
        except StopIteration:
            budget += 1
            if not path:
                break
            choices, filling = path.pop()
            lengths.change(filling, 1)
            used -= filling.copies
            continue
        if filling is not None:
            path.append((choices, filling))
            lengths.change(filling, -1)
            used += filling.copies
            choices = None
    return best


# Places


class _Places:
    """For each length, the ranges of ranks that the fillings take, as sorted arrays."""

    def __init__(self, plan: list[Filling]) -> None:
        taken: dict[int, int] = {}
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for filling in plan:
            offset = 0
            for length, n in filling.items:
                first = taken.get(length, 0)
                ranges.setdefault(length, []).append((first, n, sequence, offset))
                taken[length] = first + n * filling.copies
                offset += length * n
            sequence += filling.copies
        self.ranges = {k: np.array(v, np.int64).T for k, v in ranges.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for size in np.unique(length):
            rows = np.flatnonzero(length == size)
            first, n, base, start = self.ranges[int(size)]
            at = np.searchsorted(first, rank[rows], side="right") - 1
            within = rank[rows] - first[at]
            sequence[rows] = base[at] + within // n[at]
            offset[rows] = start[at] + within % n[at] * size
        return sequence, offset


def _placer(places: _Places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    nodes: int = NODES,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` and their places in as few sequences as can be found.

    A row's ids are those of the ``tokenizer`` file, which every executor must be able to read,
    and then ``end``. Only more than ``capacity`` ids are cut, into pieces of that size and a
    rest. Each piece gives ``(key, piece, start, length, ids_crc32, sequence_id, offset)`` and,
    with ``with_ids``, its ids. A null or empty text is the id ``end`` alone. Repeated rows and
    null keys are packed like any others; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = [narrow.schema["key"], *PIECE_FIELDS]
    numbers = [T.StructField(n, T.LongType()) for n in ("task", "nth")]
    ids = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    cut = narrow.mapInArrow(
        _cutter(tokenizer, capacity, end, with_ids), T.StructType([*fields, *numbers, *ids])
    )
    pieces = stored(cut, "pieces")
    counts = stored(
        pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths"
    )
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows
    places = _Places(plan_fillings({r["length"]: r["n"] for r in histogram}, capacity, nodes))

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    names = [f.name for f in [*fields, *ids]]
    ranked = pieces.join(starts, ["length", "task"]).select(
        *names, (F.col("before") + F.col("nth")).alias("rank")
    )
    put = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset")]
    placed = ranked.mapInArrow(_placer(places, names), T.StructType([*fields, *ids, *put]))
    return placed.withColumnRenamed("key", key)
