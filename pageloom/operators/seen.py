"""The set of crawled URLs behind a blocked Bloom filter.

A lookup that joins the candidates of a round with every URL ever crawled moves the whole set each
time. The filter is a table of blocks of 512 bits; a URL sets one bit in each of the eight words of one
block. It takes two bytes a URL, is built by partial aggregates of bits, and grows by the URLs of a round
alone. Candidates that miss a bit are new. Only the others, the URLs crawled and a small share of false
alarms, meet the exact set, and they go to it, so that it is read where it lies.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import broadcast_if_small, cut

WORDS = 8
KEYS_IN_BLOCK = 32  # 16 bits a key: false alarms are below 1 in 200

_NAMES = [f"w{i}" for i in range(WORDS)]


def blocks_for(keys: int) -> int:
    """The number of blocks for a set that may grow to ``keys``, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(keys, 1) / KEYS_IN_BLOCK)))


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def _bits(key: Column) -> list[Column]:
    """One bit for each word, from a hash that the block does not hang on."""
    other = F.xxhash64(F.lit(1), key)
    places = [F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in _NAMES])


def seen_filter(seen: DataFrame, blocks: int, key: str = "url_hash") -> DataFrame:
    """The filter ``(block, w0, ..., w7)`` of the keys in ``seen``; null keys are in no set."""
    rows = seen.where(F.col(key).isNotNull()).select(
        _block(F.col(key), blocks).alias("block"),
        *[b.alias(n) for n, b in zip(_NAMES, _bits(F.col(key)))],
    )
    return _united(rows)


def extended(table: DataFrame, added: DataFrame, blocks: int, key: str = "url_hash") -> DataFrame:
    """The filter with the keys of ``added`` in it as well."""
    return _united(table.unionByName(seen_filter(added, blocks, key)))


def marked(urls: DataFrame, table: DataFrame, blocks: int, key: str = "url_hash", name: str = "maybe") -> DataFrame:
    """``urls`` with a column that is false where the key is surely not in the set."""
    named = table.select(F.col("block").alias("_block"), *[F.col(n).alias(f"_{n}") for n in _NAMES])
    inside = reduce(
        lambda a, b: a & b,
        [F.col(f"_{n}").bitwiseAND(b) != 0 for n, b in zip(_NAMES, _bits(F.col(key)))],
    )
    return (
        urls.withColumn("_block", _block(F.col(key), blocks))
        .join(broadcast_if_small(named), "_block", "left")
        .withColumn(name, F.coalesce(inside, F.lit(False)) & F.col(key).isNotNull())
        .drop("_block", *[f"_{n}" for n in _NAMES])
    )


def not_seen(
    urls: DataFrame, seen: DataFrame, table: DataFrame, blocks: int, key: str = "url_hash"
) -> DataFrame:
    """Rows of ``urls`` whose key is not in ``seen``: what an anti-join gives, but for the rows that the
    filter lets go nothing is looked up, and ``seen`` is shuffled only where the possible hits are too
    many, by measure, to be sent to it. A null key is in no set."""
    rows = cut(marked(urls, table, blocks, key, "_maybe"))
    asked = cut(rows.where("_maybe").select(key).distinct())
    found = cut(seen.select(key).join(broadcast_if_small(asked), key, "left_semi").distinct())
    kept = rows.where("_maybe").join(broadcast_if_small(found), key, "left_anti")
    return rows.where(~F.col("_maybe")).unionByName(kept).drop("_maybe").select(*urls.columns)
