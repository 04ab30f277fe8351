"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by a pattern and each is merged on its own: the pair of neighbours
with the lowest rank first, the leftmost of equal rank. The pairs wait in a rank queue: a bucket of
positions for each rank, and a bitmap in two levels that tells by find-first-set which rank is
next. Tokens form a linked list over the bytes. A merge pushes its two new pairs and leaves the
old ones in their buckets, where they are skipped as stale when their turn comes. The cost grows
with the length of a pre-token times the logarithm of the largest bucket, so a pre-token of
megabytes is no trouble; results for short ones are kept.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value

by_value(__name__)

_WORD = 6  # a bitmap word covers 2 ** 6 ranks
_MASK = (1 << _WORD) - 1
_CACHED_TOKENS, _CACHED_LENGTH, _ROWS = 1_000_000, 48, 1_000
# White space to the tokenizer's own pattern engine; Python's adds four control characters.
_SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters and numbers below U+0250, and a test for characters beyond it that are not punctuation.
_LATIN_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_LATIN_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_BEYOND_LATIN = re.compile("[^\\x00-\\u024f\\u2010-\\u2027]")


def spelled(pattern: str, classes: dict[str, str]) -> str:
    """``pattern`` with the names of character classes, and ``\\S``, replaced by their members."""
    made, at, inside = [], 0, False
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name is not None:
            made.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
        elif pattern.startswith("\\S", at) and not inside:
            made.append(f"[^{classes['\\s']}]")
            at += 2
        else:
            size = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            made.append(pattern[at : at + size])
            at += size
    return "".join(made)


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        # The rank queue: positions by rank, and the lower level of the bitmap.
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((max(self.ranks.values(), default=0) >> _WORD) + 1)
        self.pattern = regex.compile(spelled(pattern, {"\\s": _SPACES}))
        latin = {"\\s": _SPACES, "\\p{L}": _LATIN_LETTERS, "\\p{N}": _LATIN_NUMBERS}
        # Python's own engine is twice as fast, where it can do what the pattern asks for.
        plain = spelled(pattern, latin)
        self.latin = self.pattern if "\\p" in plain.lower() else re.compile(plain)
        self.known: dict[str, bytes] = {}
        if find_spec("pageloom"):  # as where executors have the package
            from pageloom.llm.kept import cache

            self.known = cache(f"bpe {path} {pattern}")

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token. The queue's steps are written out here, as calls would double
        the time of short pre-tokens."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        n, words, buckets, top = len(piece), self.words, self.buckets, 0
        after, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [rank_of(piece[i : i + 2]) for i in range(n)]  # the rank of the pair from here
        waiting[n - 1] = None
        for i, rank in enumerate(waiting):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, and so a heap
                else:
                    buckets[rank] = [i]
                    words[rank >> _WORD] |= 1 << (rank & _MASK)
                    top |= 1 << (rank >> _WORD)
        while top:
            # find the first set bit of the upper level, then of the word it stands for
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << _WORD) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if waiting[i] != rank:
                continue  # stale: a neighbour was merged since
            j = after[i]
            k = after[j]
            after[i] = k
            waiting[j] = None
            p = before[i]
            if k < n:
                before[k] = i
                waiting[i] = rank = rank_of(piece[i : after[k]])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> _WORD] |= 1 << (rank & _MASK)
                        top |= 1 << (rank >> _WORD)
            else:
                waiting[i] = None
            if p >= 0:
                waiting[p] = rank = rank_of(piece[p:k])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], p)
                    else:
                        buckets[rank] = [p]
                        words[rank >> _WORD] |= 1 << (rank & _MASK)
                        top |= 1 << (rank >> _WORD)
        ids, i, ranks = [], 0, self.ranks
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as 32-bit integers."""
        text = text or ""
        pattern = self.pattern if _BEYOND_LATIN.search(text) else self.latin
        tokens, known = pattern.findall(text), self.known
        fresh = set(tokens).difference(known)
        for t in fresh:
            known[t] = array("i", self.merge(t.encode("utf-8", "surrogatepass"))).tobytes()
        ids = b"".join(map(known.__getitem__, tokens))
        for t in fresh:
            if len(t) > _CACHED_LENGTH:
                del known[t]
        if len(known) > _CACHED_TOKENS:
            known.clear()
        return ids


def _encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, pattern)
        gc.disable()  # nothing here is cyclic, and walking the known tokens costs more than all else
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [coder.encode(t.as_py()) for t in part.column(1)]
                ends = np.cumsum([0, *[len(r) // 4 for r in rows]])
                values = pa.array(np.frombuffer(b"".join(rows), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["key", "ids"])

    return run


def encode(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, ids)`` for each row of ``docs``, without special tokens.

    ``ranks`` is a file every executor can read, with all 256 single bytes in it. A null or empty
    text has no ids. Repeated rows and null keys are encoded like any others, an empty table gives
    an empty result, and other columns are left out.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([narrow.schema["key"], ids])
    return narrow.mapInArrow(_encoder(ranks, pattern), schema).withColumnRenamed("key", key)


def _decoder(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            column = batch.column(at)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            found = [
                b"".join(map(token_of.__getitem__, values[a:b].tolist())) if valid else None
                for a, b, valid in zip(ends, ends[1:], column.is_valid().to_pylist())
            ]
            columns = [*batch.columns, pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "bytes"])

    return run


def decode(coded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``coded`` and a column ``bytes``: the tokens of ``ids`` one after another. Null stays null;
    an id that the ranks do not have is an error."""
    schema = T.StructType([*coded.schema.fields, T.StructField("bytes", T.BinaryType())])
    return coded.mapInArrow(_decoder(ranks, coded.columns.index(ids)), schema)
