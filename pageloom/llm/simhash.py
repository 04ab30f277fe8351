"""Near duplicates by SimHash fingerprints, compared exactly in tiles.

A fingerprint is made in one pass over the text. Distinct fingerprints that can be within
``distance`` bits agree in at least one of ``distance + 1`` blocks of bits, so they meet in the
cell of that block's value. A cell is sorted by population count and compared tile against tile
with numpy's exclusive-or and bit counts; since two fingerprints differ in at least as many bits
as their population counts do, tile pairs whose counts are further apart than ``distance`` are
skipped. No link is lost.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pageloom.llm.common import apart, by_value, stored
from pageloom.llm.components import components
from pageloom.llm.forest import Forest

by_value(__name__)

BITS = 64
SEED = 42
TILE = 256
CELL_ROWS = 50_000

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits, each set if it is set in over half of the hashes of the word shingles."""
    # bytes.split() splits at the six ASCII spaces and bytes.lower() changes A-Z alone.
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_digest
    if len(tokens) <= shingle:
        return int.from_bytes(digest(b" ".join(tokens), SEED), "big")
    if shingle == 3:
        pieces = zip(tokens, tokens[1:], tokens[2:])
    else:
        pieces = zip(*[tokens[k:] for k in range(shingle)])
    ones, hashes = np.zeros(BITS, np.int64), [digest(b" ".join(p), SEED) for p in pieces]
    for start in range(0, len(hashes), _CHUNK):
        part = np.frombuffer(b"".join(hashes[start : start + _CHUNK]), np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(t.as_py(), shingle) for t in batch.column(1))
            marks = np.fromiter(found, np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["key", "fp"])

    return run


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(key, fp)`` for each row of ``docs``, the bits of the fingerprint as a signed long."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(_fingerprints(shingle), schema)


def _links(distance: int):
    """Links between rows sorted by ``(cell, ones)``, as a forest: one for each row at most."""

    def tiles(batches):
        # cut into tiles of TILE rows, whatever the size of the batches
        rest = None
        for batch in batches:
            now = pa.table(pa.Table.from_batches([batch]))
            rest = now if rest is None else pa.concat_tables([rest, now])
            while rest.num_rows >= TILE:
                yield rest.slice(0, TILE)
                rest = rest.slice(TILE)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, waiting, last, cell = Forest(), deque(), None, 0
        for table in tiles(batches):
            names = [c for c in table.column_names if c not in ("fp", "ones")]
            keys = np.stack([table.column(c).to_numpy() for c in names])
            change = np.ones(keys.shape[1], bool)
            change[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            change[0] = last is None or bool((keys[:, 0] != last).any())
            cells, last = cell + np.cumsum(change), keys[:, -1]
            cell = int(cells[-1])
            ones = table.column("ones").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            tile = (cells, ones, fp, forest.more(len(fp)))
            while waiting and (
                waiting[0][0][-1] < cells[0]
                or (
                    waiting[0][0][0] == cells[-1]
                    and ones[0] - waiting[0][1][-1] > distance
                )
            ):
                waiting.popleft()
            found_a, found_b = [], []
            for other in [*waiting, tile]:
                if other[0][-1] == cells[0] and other[0][-1] == other[0][0] == cells[-1]:
                    if ones[0] - other[1][-1] > distance:
                        continue
                near = np.bitwise_count(other[2][:, None] ^ fp[None, :]) <= distance
                near &= other[0][:, None] == cells[None, :]
                if other is tile:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                for i, j in forest.tie(other[3], tile[3], near):
                    found_a.append(other[2][i])
                    found_b.append(fp[j])
            waiting.append(tile)
            if found_a:
                pairs = [np.array(x, np.uint64).view(np.int64) for x in (found_a, found_b)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    return run


def _blocks(distance: int) -> Column:
    """The blocks of ``fp``: ``distance + 1`` runs of bits, as equal in width as they can be."""
    edges = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(F.shiftleft("fp", BITS - high), BITS - high + low).alias("value"),
            )
            for k, (low, high) in enumerate(zip(edges, edges[1:]))
        ]
    )


def links(distinct: DataFrame, distance: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(a, b)`` between rows of ``distinct(fp)``, enough to tie together all that are
    connected by differences of at most ``distance`` bits.

    A cell of over ``cell_rows`` fingerprints is dealt out in pieces of one population count, and
    pairs of pieces are compared apart; pairs that lie too far apart are not made.
    """
    if distance < 1:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    cell = ["block", "value"]
    placed = distinct.select(
        "fp", F.bit_count("fp").cast("long").alias("ones"), F.inline(_blocks(distance))
    ).withColumn("block", F.col("block").cast("long"))
    counts = placed.groupBy(*cell, "ones").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy(*cell).agg(F.sum("n").alias("all")).filter(F.col("all") > cell_rows)
    pieces = counts.join(large.drop("all"), cell).withColumn(
        "pieces", F.ceil(F.col("n") / F.lit(cell_rows)).cast("long")
    )
    pieces = stored(pieces.drop("n"), "pieces")
    rows = placed
    for name in ("p", "q"):
        rows = rows.withColumn(name, F.lit(-1).cast("long"))
    if pieces.take(1):
        each = pieces.select(
            *cell, "ones", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")
        ).withColumn("at", F.col("ones") * (1 << 40) + F.col("piece"))
        one = each.select(*cell, F.col("at").alias("p"), F.col("ones").alias("p_ones"))
        two = each.select(*cell, F.col("at").alias("q"), F.col("ones").alias("q_ones"))
        apart_ = F.col("q_ones") - F.col("p_ones")
        pairs = one.join(two, cell).filter((F.col("p") <= F.col("q")) & (apart_ <= distance))
        ways = (
            pairs.select(*cell, "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("at"))
        )
        known = placed.join(pieces, [*cell, "ones"], "left").withColumn(
            "at",
            F.col("ones") * (1 << 40) + F.pmod(F.xxhash64("fp"), F.col("pieces")),
        )
        columns = ["fp", "ones", *cell, "p", "q"]
        none = F.lit(-1).cast("long")
        rows = (
            known.filter(F.col("at").isNull())
            .select("fp", "ones", *cell, none.alias("p"), none.alias("q"))
            .unionByName(known.join(ways, [*cell, "at"]).select(*columns))
        )
    keys = [*cell, "p", "q"]
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, "ones", "fp")
    return sorted_rows.mapInArrow(_links(distance), "a long, b long")


def duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``(key, fingerprint, component_id)`` for each row of ``docs``.

    A fingerprint is written as 16 hexadecimal digits. ``component_id`` is the smallest key that
    can be reached over links of at most ``distance`` bits, the row's own included. A null or
    empty text has the fingerprint zero, which links like any other. Null keys are never the
    smallest; a component without any other gets null. Repeated rows come out as often as
    they are put in, and an empty table gives an empty result.
    """
    made = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    return _with_components(made, distance).select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component_id"),
    )


def _with_components(made: DataFrame, distance: int) -> DataFrame:
    distinct = stored(made.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    group = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    grouped = distinct.join(group, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "component").join(least, "component")
    return made.join(named, "fp")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """One row of each component of ``duplicates``, with the columns of ``docs``.

    A row with the smallest key stays. Where several rows have it, as when rows are repeated or
    keys are null, fingerprint and text decide, and of equal rows any one stays. Texts move once,
    with their key, to meet the keys that stay; only rows that share a key are looked at again.
    """
    p = apart(docs, ())
    made = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    staying = (
        _with_components(made, distance)
        .filter(F.col("key").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min("key").alias(f"{p}key"), F.min("fp").alias(f"{p}mark"))
        .drop("component")
    )
    shared = made.groupBy("key").count().filter((F.col("count") > 1) | F.col("key").isNull())
    staying = stored(
        staying.join(shared, F.col(f"{p}key").eqNullSafe(F.col("key")), "left").select(
            f"{p}key", f"{p}mark", F.col("count").isNotNull().alias(f"{p}shared")
        ),
        "staying",
    )
    single = staying.filter(~F.col(f"{p}shared")).select(f"{p}key").hint("shuffle_hash")
    kept = docs.join(single, docs[key] == F.col(f"{p}key"), "left_semi")
    several = staying.filter(f"{p}shared")
    if not several.take(1):
        return kept

    same_key = docs[key].eqNullSafe(F.col(f"{p}key"))
    mark = F.pandas_udf(
        lambda texts: texts.map(lambda t: fingerprint(t, shingle)).astype(np.uint64).astype(np.int64),
        T.LongType(),
    )
    marked = docs.join(several.select(f"{p}key").distinct(), same_key, "left_semi").withColumn(
        f"{p}fp", mark(F.col(text))
    )
    rank = F.row_number().over(
        W.partitionBy(key, f"{p}fp").orderBy(F.xxhash64(text), *[F.col(text)])
    )
    one = marked.withColumn(f"{p}rank", rank).filter(F.col(f"{p}rank") == 1)
    same = one[key].eqNullSafe(several[f"{p}key"]) & (one[f"{p}fp"] == several[f"{p}mark"])
    return kept.unionByName(one.join(several, same, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]))
