"""Fill-in-the-middle transformation: a text is cut at two units and its parts are set in another order.

A unit is a word with the white space before it; white space at the end of a text is one more. A
text's UTF-8 bytes are divided into blocks of a fixed size, and a Fenwick tree over the blocks holds
how many units end in each and how many code points begin in it. A cut behind a number of units is
found by binary lifting down the tree, which gives its block and the code points before that, and
then within the block alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value

by_value(__name__)

BLOCK = 4096
MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED, RATE, SPM_SHARE = 42, 50, 80

_ROWS = 512
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Units:
    """The units of one text, given by its UTF-8 bytes."""

    def __init__(self, data: bytes, block: int = BLOCK) -> None:
        self.block = block
        self.bytes = np.frombuffer(data, np.uint8)
        space = _SPACE[self.bytes]
        # Whatever the last byte is, a unit ends with it.
        self.ends = np.append(space[1:], True) & np.append(~space[:-1], True) if len(data) else space
        self.n = int(np.count_nonzero(self.ends))

    def tree(self) -> tuple[list[int], list[int]]:
        """The Fenwick tree: at ``i``, the units and the code points of the ``i & -i`` blocks that
        end with the ``i``-th."""
        starts = np.arange(0, len(self.bytes), self.block)
        i = np.arange(1, len(starts) + 1)
        found = []
        for marked in (self.ends, (self.bytes & 0xC0) != 0x80):
            before = np.append(0, np.cumsum(np.add.reduceat(marked, starts, dtype=np.int64)))
            found.append([0, *(before[i] - before[i & (i - 1)]).tolist()])
        return found[0], found[1]

    def cuts(self, units: Sequence[int]) -> list[tuple[int, int]]:
        """For each number of units, the bytes and the code points that they take from the start."""
        if not self.n:
            return [(0, 0)] * len(units)
        ended, begun = self.tree()
        return [self._cut(k, ended, begun) for k in units]

    def _cut(self, k: int, ended: list[int], begun: list[int]) -> tuple[int, int]:
        if not k:
            return 0, 0
        at, chars, step = 0, 0, 1 << ((len(ended) - 1).bit_length() - 1)
        while step:
            if at + step < len(ended) and ended[at + step] < k:
                at += step
                k -= ended[at]
                chars += begun[at]
            step >>= 1
        start = at * self.block
        inside = int(np.flatnonzero(self.ends[start : start + self.block])[k - 1]) + 1
        part = self.bytes[start : start + inside]
        return start + inside, chars + int(np.count_nonzero((part & 0xC0) != 0x80))


_ROW = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()), ("output", pa.string())]
FIELDS = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def rearranged(
    data: bytes, draws: Sequence[int], marks: Sequence[bytes], rate: int, spm_share: int, block: int
) -> tuple[int, str, int | None, int | None, bytes]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    units = Units(data, block)
    one, two, chosen, order = draws
    if not data or chosen % 100 >= rate or any(m in data for m in marks):
        return units.n, PLAIN, None, None, data
    ends = sorted((one % (units.n + 1), two % (units.n + 1)))
    (a, a_chars), (b, b_chars) = units.cuts(ends)
    p, s, m = marks
    if order % 100 < spm_share:
        parts = (s, data[b:], p, data[:a], m, data[a:b])
    else:
        parts = (p, data[:a], s, data[b:], m, data[a:b])
    return units.n, SPM if order % 100 < spm_share else PSM, a_chars, b_chars - a_chars, b"".join(parts)


def _worker(marks: Sequence[str], rate: int, spm_share: int, block: int):
    coded = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                draws = zip(*(batch.column(2 + i).to_pylist() for i in range(4)))
                rows = [rearranged(t or b"", d, coded, rate, spm_share, block) for t, d in zip(texts, draws)]
                columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), _ROW[:4])]
                output = pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())
                names = ["key", *[n for n, _ in _ROW]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, output], names)

    return run


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 that hang on the key alone."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]


def transform(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    rate: int = RATE,
    spm_share: int = SPM_SHARE,
    marks: Sequence[str] = MARKS,
    block: int = BLOCK,
) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)`` for each row of ``docs``.

    ``rate`` in a hundred texts are rearranged, and ``spm_share`` in a hundred of those put the
    suffix first. Where and whether a text is cut hangs on ``seed`` and its key alone, so repeated
    rows give the same output. A text that holds one of ``marks`` stays plain, as it could not be
    told from a rearranged one; so does an empty or null text, whose output is empty. A null key
    counts as an empty one. Other columns are left out; an empty table gives an empty result.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *_draws(F.col(key), seed))
    schema = T.StructType([narrow.schema["key"], *FIELDS])
    found = narrow.mapInArrow(_worker(marks, rate, spm_share, block), schema)
    return found.withColumnRenamed("key", key)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that ``output`` was made of, read from it and its form alone."""
    p, s, m = (F.lit(x) for x in marks)

    def between(first: Column, then: Column) -> Column:
        return F.split_part(F.split_part(output, first, F.lit(2)), then, F.lit(1))

    middle = F.split_part(output, m, F.lit(2))
    return (
        F.when(form == PSM, F.concat(between(p, s), middle, between(s, m)))
        .when(form == SPM, F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
