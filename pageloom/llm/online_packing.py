"""Sum-of-squares online packing of tokenised documents into windows of one length.

Documents are placed as they come. An array holds for each fill level how many partially filled
windows have it; a document goes to the level, or to a new window, that leaves the least sum of the
squares of these numbers. That keeps windows of all levels at hand, so documents come to fit exactly
and windows fill up to the last token. How many windows stay open hangs on the levels and hardly on
the number of documents, so the longer a stream, the smaller the share of what it leaves open.

Each task packs its own rows in one pass while it tokenises them. The documents of the windows it
leaves open are written aside and packed once more, in fewer and longer streams. What is still open
then is laid end to end and cut: at each full window, and the rest at powers of two, which need no
padding either. Nothing is shuffled and nothing goes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value, stored, uncollected
from pageloom.llm.packing import Encoder

by_value(__name__)

CAPACITY = 2048
END = 1
OPEN = 16_384

_ROWS = 4_096
_TASK_BITS = 33  # sequences of a task are numbered below this

Piece = tuple[object, int, int, bytes]  # key, place of its first id, ids of its document, its ids


class Levels:
    """Partially filled windows by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        # For each room the number of windows, and the same with none taken for impossible. A step
        # from room r to room q changes the sum of squares by 2 * (n[q] - n[r] + 1); a half at full
        # windows and at new ones, of which no number is kept, makes the same form right for them.
        self.to = np.zeros(capacity + 1)
        self.of = np.full(capacity + 1, -np.inf)
        self.to[0], self.of[capacity] = -0.5, 0.5
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.n = 0

    def choose(self, size: int) -> int:
        """The room to place ``size`` in, the least of several; the whole capacity is a new window."""
        return size + int((self.to[: self.capacity - size + 1] - self.of[size:]).argmin())

    def put(self, piece: Piece, size: int) -> list[Piece] | None:
        """Place a piece; gives the pieces of a window that is full now."""
        room = self.choose(size)
        if room == self.capacity:
            window = []
        else:
            window = self.windows[room].pop()
            self._count(room, -1)
        window.append(piece)
        if room == size:
            return window
        self.windows[room - size].append(window)
        self._count(room - size, 1)
        return None

    def _count(self, room: int, by: int) -> None:
        n = self.to[room] = self.to[room] + by
        self.of[room] = n if n else -np.inf
        self.n += by

    def take(self) -> list[list[Piece]]:
        """All open windows, the fullest first; none is left."""
        found = [w for windows in self.windows for w in windows]
        self.__init__(self.capacity)
        return found


def cut(pieces: Iterator[Piece], capacity: int) -> Iterator[list[Piece]]:
    """``pieces`` laid end to end in sequences of ``capacity``, and the rest in powers of two."""
    pieces = list(pieces)
    total = sum(len(p[3]) // 4 for p in pieces)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    at, used = 0, 0  # within pieces[at], of which ``used`` ids are placed
    for size in sizes:
        sequence = []
        while size:
            key, start, whole, ids = pieces[at]
            n = min(size, len(ids) // 4 - used)
            sequence.append((key, start + used, whole, ids[4 * used : 4 * (used + n)]))
            size, used = size - n, used + n
            if 4 * used == len(ids):
                at, used = at + 1, 0
        yield sequence


FIELDS = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


class _Rows:
    """Sequences as record batches. Open windows give their pieces without a sequence."""

    def __init__(self, kind: pa.DataType, with_ids: bool, round_: int) -> None:
        self.kind, self.with_ids = kind, with_ids
        self.next = 2 * (TaskContext.get().partitionId() << _TASK_BITS) + round_
        self.rows: list[tuple] = []

    def add(self, sequence: list[Piece], placed: bool = True) -> None:
        offset = 0
        for key, start, whole, ids in sequence:
            n = len(ids) // 4
            place = (self.next, offset) if placed else (None, None)
            kept = ids if self.with_ids or not placed else None
            self.rows.append((key, start, n, zlib.crc32(ids), whole, *place, kept))
            offset += n
        self.next += 2

    def batches(self, least: int = _ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= max(least, 1):
            *columns, ids = zip(*self.rows)
            self.rows = []
            made = [pa.array(columns[0], self.kind), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            sizes = np.cumsum([0, *[len(i or b"") // 4 for i in ids]])
            values = pa.array(np.frombuffer(b"".join(i or b"" for i in ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*made, lists], ["key", *[f.name for f in FIELDS], "ids"])


def _packed(
    pieces: Callable[[pa.RecordBatch], Iterator[Piece]], capacity: int, open_windows: int, last: bool, with_ids: bool
):
    """A pass over the pieces of each batch. Windows that it leaves open are cut if it is the
    ``last``, and stay unplaced otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rows = Levels(capacity), None

        def close() -> Iterator[pa.RecordBatch]:
            left = (piece for window in levels.take() for piece in window)
            for sequence in cut(left, capacity) if last else [[piece] for piece in left]:
                rows.add(sequence, placed=last)
                yield from rows.batches()

        with uncollected():
            for batch in batches:
                rows = rows or _Rows(batch.schema.field(0).type, with_ids, int(last))
                for piece in pieces(batch):
                    size = len(piece[3]) // 4
                    full = [piece] if size == capacity else levels.put(piece, size)
                    if full:
                        rows.add(full)
                        yield from rows.batches()
                    elif levels.n > open_windows:
                        yield from close()
            if rows:
                yield from close()
                yield from rows.batches(1)

    return run


def _reader(path: str, capacity: int, end: int):
    """Pieces of the texts of each batch: full windows of the longer ones, then what remains."""
    tail = np.array([end], "<u4").tobytes()
    encoder = []

    def pieces(batch: pa.RecordBatch) -> Iterator[Piece]:
        if not encoder:
            encoder.append(Encoder(path))
        for key, ids in zip(batch.column(0).to_pylist(), encoder[0](batch.column(1).to_pylist())):
            ids += tail
            for start in range(0, len(ids), 4 * capacity):
                yield key, start // 4, len(ids) // 4, ids[start : start + 4 * capacity]

    return pieces


def _again(batch: pa.RecordBatch) -> Iterator[Piece]:
    keys, starts, wholes = (batch.column(n).to_pylist() for n in ("key", "start", "doc_tokens"))
    ids = batch.column("ids")
    values, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
    for key, start, whole, a, b in zip(keys, starts, wholes, ends - ends[0], ends[1:] - ends[0]):
        yield key, start, whole, values[a:b].tobytes()


def pack(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    open_windows: int = OPEN,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all rows of ``docs`` and their places in sequences of at most ``capacity`` tokens.

    A row's ids are those of the ``tokenizer`` file, which every executor must be able to read, and
    then ``end``. Gives ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for each
    piece and, with ``with_ids``, its ids. Sequences hold ``capacity`` tokens or, a few at the end of
    each stream, a power of two. A document is cut where it is longer than ``capacity``, and where it
    lies in a window that no later document came to fill. A task with more than ``open_windows`` open
    ones hands all of them on, so what it holds in memory is bounded.

    A null or empty text is the id ``end`` alone. Repeated rows and null keys are packed like any
    others; other columns are left out; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["key"], *FIELDS, _IDS])
    first = _packed(_reader(tokenizer, capacity, end), capacity, open_windows, False, with_ids)
    found = stored(narrow.mapInArrow(first, schema), "windows")
    unplaced = F.col("sequence_id").isNull()
    second = _packed(_again, capacity, open_windows, True, with_ids)
    left = found.where(unplaced).mapInArrow(second, schema)
    placed = found.where(~unplaced).unionByName(left)
    return (placed if with_ids else placed.drop("ids")).withColumnRenamed("key", key)
