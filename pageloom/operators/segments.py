"""The written search index: segments of documents and postings, tombstones, merging, top hits.

Each write adds a segment: its documents, numbered as they are written, and their postings by term in
blocks of neighbouring documents. A document that is written again or deleted gets a tombstone, found
when the write is committed, so reading never compares versions: it leaves out the tombstones, which
are few as merging drops them. Commits go through ``sources.commits``.

A block holds the postings of a field and term for 128 neighbouring documents and, in a column of its
own, the pairs of count and length that no other pair of the block beats in both. They bound what the
block can add to any score. All terms use the same ranges of documents, so the bounds of a range add
up, and a range below the score of the last hit is not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pageloom.functions import plain
from pageloom.functions import text as tx
from pageloom.functions import workers
from pageloom.functions.arrays import value_counts
from pageloom.operators.index import FIELDS, upsert
from pageloom.operators.search import BOOSTS, DECIMALS, saturation, weight
from pageloom.session import broadcast_if_small, stored
from pageloom.sources import commits

RANGE_BITS = 7
BUCKET_DOCS = 200_000
FAN = 8  # segments of like size that are merged into one
LISTED = 1_000  # terms or ranges that are named in a filter; more are joined
PROBE = 16  # ranges with the highest bounds, read first for each query

_OWN = ("_key", "_doc", "_dl")
_BLOCK = (
    "term string, field string, range bigint, n int, impacts array<struct<tf: int, dl: int>>,"
    " postings array<struct<_doc: bigint, tf: int, dl: int>>"
)


def _key() -> Column:
    """Documents without a hash are told apart by their url."""
    return F.coalesce(F.concat(F.lit("h:"), "content_hash"), F.concat(F.lit("u:"), F.coalesce("url", F.lit(""))))


def _at(path: str, part: str) -> str:
    return f"{path.rstrip('/')}/{part}"


def _range(doc: str = "_doc") -> Column:
    return F.shiftright(doc, RANGE_BITS)


# Writing


def _write_segment(spark: SparkSession, path: str, documents: DataFrame) -> dict | None:
    """Write ``documents``, one for each key, as a segment that no commit names yet. Those of other
    segments bring their lengths along in ``_dl``."""
    part = f"segments/{uuid.uuid4().hex}"
    fields = [f for f in FIELDS if f in documents.columns]
    sizes = F.struct(*[(plain.word_number(F.col(f)) if f in fields else F.lit(0)).alias(f) for f in FIELDS])
    sized = documents if "_dl" in documents.columns else documents.withColumn("_dl", sizes)
    sized.select(
        "*", _key().alias("_key"), F.monotonically_increasing_id().alias("_doc")
    ).write.parquet(_at(path, f"{part}/documents"))
    docs = spark.read.parquet(_at(path, f"{part}/documents"))
    rows, stats = _facts(docs)
    if not rows:
        commits.remove(spark, path, part)
        return None
    entry = {"part": part, "rows": rows, "buckets": 0, "fields": stats}
    if not fields:
        return entry
    buckets = 1 << max(0, math.ceil(math.log2(rows / BUCKET_DOCS)))
    # Neighbouring documents lie together in their file, so their postings need no shuffle. A range that is
    # cut where the file is has two blocks for a term; bounds then add up to more, never to less.
    texts = [c for f in fields for c in (F.col(f).alias(f"text_{f}"), plain.other_counts(F.col(f)).alias(f"counted_{f}"))]
    (
        docs.select("_doc", *texts)
        .mapInArrow(workers.text_blocks(fields, RANGE_BITS), _BLOCK)
        .withColumn("bucket", _bucket(buckets))
        .sortWithinPartitions("bucket", "term", "field", "range")
        .write.partitionBy("bucket")
        .parquet(_at(path, f"{part}/blocks"))
    )
    return {**entry, "buckets": buckets}


def _facts(docs: DataFrame) -> tuple[int, dict[str, list[int]]]:
    """How many documents, and for each field how many have it and the sum of its lengths."""
    sums = [F.count(F.lit(1)).alias("rows")]
    for f in FIELDS:
        dl = F.col(f"_dl.{f}")
        sums += [F.count_if(dl > 0).alias(f"n_{f}"), F.coalesce(F.sum(dl), F.lit(0)).alias(f)]
    row = docs.agg(*sums).first()
    return row["rows"], {f: [row[f"n_{f}"], row[f]] for f in FIELDS}


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _documents(spark: SparkSession, path: str, segments: Sequence[dict], *columns: str) -> DataFrame | None:
    parts = []
    for s in segments:
        table = spark.read.parquet(_at(path, f"{s['part']}/documents"))
        parts.append((table.select(*columns) if columns else table).withColumn("_segment", F.lit(s["part"])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


_TOMBSTONES = "_segment string, _key string, _doc bigint"


def _dead(spark: SparkSession, path: str, state: dict, segments: Sequence[str] | None = None) -> DataFrame:
    """Tombstones ``(_segment, _key, _doc)``, of all segments or of some."""
    parts = [_at(path, p) for p in state.get("tombstones", [])]
    found = spark.read.schema(_TOMBSTONES).parquet(*parts) if parts else spark.createDataFrame([], _TOMBSTONES)
    return found if segments is None else found.where(F.col("_segment").isin(list(segments)))


def _alive(docs: DataFrame, dead: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(dead.select("_segment", "_doc")), ["_segment", "_doc"], "left_anti")


def _bury(spark: SparkSession, path: str, state: dict, keys: DataFrame) -> tuple[str | None, int, dict]:
    """Write tombstones for the living documents with one of ``keys``: their part, their number and
    the statistics without them."""
    living = _documents(spark, path, state.get("segments", []), *_OWN)
    if living is None:
        return None, 0, {}
    found = _alive(living.join(broadcast_if_small(keys), "_key", "left_semi"), _dead(spark, path, state))
    part = f"tombstones/{uuid.uuid4().hex}"
    found.write.parquet(_at(path, part))
    rows, lost = _facts(spark.read.schema(found.schema).parquet(_at(path, part)))
    if not rows:
        commits.remove(spark, path, part)
        return None, 0, {}
    return part, rows, lost


def _plus(one: Mapping[str, list], other: Mapping[str, list], sign: int = 1) -> dict[str, list]:
    return {
        f: [a + sign * b for a, b in zip(one.get(f, [0, 0]), other.get(f, [0, 0]))] for f in {**one, **other}
    }


def _commit(spark: SparkSession, path: str, entry: dict | None, keys: DataFrame) -> int:
    """Commit a segment and the tombstones of what it replaces; gives the number of tombstones."""
    buried = 0

    def change(state: dict) -> dict | None:
        nonlocal buried
        part, buried, lost = _bury(spark, path, state, keys)
        if entry is None and part is None:
            return None
        fields = _plus(state.get("fields", {}), lost, -1)
        return {
            "segments": state.get("segments", []) + ([entry] if entry else []),
            "tombstones": state.get("tombstones", []) + ([part] if part else []),
            "fields": _plus(fields, entry["fields"]) if entry else fields,
            "rows": state.get("rows", 0) + (entry["rows"] if entry else 0) - buried,
        }

    commits.commit(spark, path, change)
    return buried


def bulk_index(spark: SparkSession, path: str, documents: DataFrame) -> int:
    """Upsert ``documents`` into the index at ``path``; gives the number written.

    They take the place of documents with the same hash, or the same url where there is none; of
    several in one write the last counts, as in ``upsert``. Old texts are not read, only their keys. Of
    two writers at the same time both are kept, and the one that commits last wins.
    """
    entry = _write_segment(spark, path, upsert(None, documents))
    if entry is None:
        return 0
    keys = spark.read.parquet(_at(path, f"{entry['part']}/documents")).select("_key")
    _commit(spark, path, entry, keys)
    return entry["rows"]


def bulk_delete(spark: SparkSession, path: str, deletes: DataFrame) -> int:
    """Delete the listed hashes; gives the number of documents deleted. Unknown hashes are no error."""
    keys = deletes.where("content_hash is not null").select(F.concat(F.lit("h:"), "content_hash").alias("_key"))
    return _commit(spark, path, None, stored(keys.distinct(), "deletes"))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The documents of the index as of a commit; nothing is shuffled where tombstones are few."""
    _, state = commits.read(spark, path, version)
    docs = _documents(spark, path, state.get("segments", []))
    if docs is None:
        raise ValueError(f"nothing was written to {path}")
    return _alive(docs, _dead(spark, path, state)).drop("_segment", *_OWN)


def count(spark: SparkSession, path: str, version: int | None = None) -> int:
    """The number of documents, which each commit states."""
    return commits.read(spark, path, version)[1].get("rows", 0)


def compact(spark: SparkSession, path: str, target: str) -> int:
    """Write the present documents of the index at ``path`` as the single segment of ``target``."""
    return bulk_index(spark, target, read_index(spark, path))


def merge(spark: SparkSession, path: str, fan: int = FAN, everything: bool = False) -> int:
    """Merge segments of like size where there are ``fan`` of them, or all; gives how many were merged.

    A document is so written again a number of times that follows the logarithm of the index. Writers
    go on meanwhile: what they bury in the merged segments is buried in the new one as well.
    """
    version, before = commits.read(spark, path)
    tiers: dict[int, list[dict]] = {}
    for s in before.get("segments", []):
        tiers.setdefault(0 if everything else int(math.log(s["rows"], max(fan, 2))), []).append(s)
    chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= (1 if everything else fan)), [])
    if not chosen:
        return 0
    names = [s["part"] for s in chosen]
    docs = _alive(_documents(spark, path, chosen), _dead(spark, path, before, names))
    entry = _write_segment(spark, path, docs.drop("_segment", "_key", "_doc"))

    def change(state: dict) -> dict | None:
        kept = [s for s in state["segments"] if s["part"] not in names]
        if len(kept) != len(state["segments"]) - len(names):
            return None  # another merge was faster
        later = dict(state, tombstones=[p for p in state["tombstones"] if p not in before["tombstones"]])
        rest = _dead(spark, path, state, [s["part"] for s in kept])
        if entry:
            new = _documents(spark, path, [entry], "_key", "_doc")
            gone = _dead(spark, path, later, names).select("_key")
            rest = rest.unionByName(new.join(broadcast_if_small(gone), "_key", "left_semi").select(*rest.columns))
        part = f"tombstones/{uuid.uuid4().hex}"
        rest.write.parquet(_at(path, part))
        return {**state, "segments": kept + ([entry] if entry else []), "tombstones": [part]}

    commits.commit(spark, path, change)
    return len(chosen)


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all but the last ``keep`` commits and delete what only they name."""
    return commits.expire(
        spark, path, keep, lambda s: {x["part"] for x in s.get("segments", [])} | set(s.get("tombstones", []))
    )


# Searching


def _blocks(
    spark: SparkSession, path: str, segments: Sequence[dict], terms: DataFrame, ranges: DataFrame | None = None
) -> DataFrame:
    """Blocks of ``terms``, of all ranges or of ``ranges (segment, range)``.

    A short list of terms or ranges becomes a filter that the scan applies to folders, row groups and
    pages; a segment without any of the ranges is not opened.
    """
    few = [r["term"] for r in terms.limit(LISTED + 1).collect()]
    listed = len(few) <= LISTED
    buckets: dict[int, list[int]] = {}
    if listed:
        sizes = sorted({s["buckets"] for s in segments if s["buckets"]})
        row = terms.agg(F.count("term"), *[F.collect_set(_bucket(n)).alias(str(n)) for n in sizes]).first()
        buckets = {n: row[str(n)] for n in sizes}
    spans: dict[str, list[int]] | None = None
    if ranges is not None:
        found = ranges.limit(LISTED + 1).collect()
        if len(found) <= LISTED:
            spans = {}
            for r in found:
                spans.setdefault(r["segment"], []).append(r["range"])
    parts = []
    for s in segments:
        if not s["buckets"] or (spans is not None and s["part"] not in spans):
            continue
        table = spark.read.parquet(_at(path, f"{s['part']}/blocks"))
        if listed:
            table = table.where(F.col("bucket").isin(buckets[s["buckets"]]) & F.col("term").isin(few))
        if spans is not None:
            table = table.where(_within(sorted(spans[s["part"]])))
        parts.append(table.drop("bucket").withColumn("segment", F.lit(s["part"])))
    if not parts:
        return spark.createDataFrame([], f"{_BLOCK}, segment string")
    blocks = reduce(DataFrame.unionByName, parts)
    if not listed:
        blocks = blocks.join(terms, "term", "left_semi")
    if ranges is not None and spans is None:
        blocks = blocks.join(broadcast_if_small(ranges), ["segment", "range"], "left_semi")
    return blocks


def _within(numbers: Sequence[int], most: int = 32) -> Column:
    """``range`` is one of ``numbers``, which few intervals enclose so that pages can be skipped."""
    gaps = sorted(range(1, len(numbers)), key=lambda i: numbers[i - 1] - numbers[i])[: most - 1]
    ends = [0, *sorted(gaps), len(numbers)]
    spans = [F.col("range").between(numbers[a], numbers[b - 1]) for a, b in zip(ends, ends[1:])]
    return reduce(lambda x, y: x | y, spans) & F.col("range").isin(list(numbers))


def _df(blocks: DataFrame, dead: DataFrame) -> DataFrame:
    """``(field, term, df)`` of living documents: counts of the blocks, less the dead of those blocks
    that have any."""
    counts = blocks.select("field", "term", F.col("n").cast("long").alias("n"))
    gone = dead.select(F.col("_segment").alias("segment"), "_doc", _range().alias("range"))
    lost = (
        blocks.join(broadcast_if_small(gone.select("segment", "range").distinct()), ["segment", "range"], "left_semi")
        .select("segment", "field", "term", F.inline("postings"))
        .join(broadcast_if_small(gone.drop("range")), ["segment", "_doc"], "left_semi")
        .select("field", "term", F.lit(-1).cast("long").alias("n"))
    )
    return counts.unionByName(lost).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")


def _weights(spark: SparkSession, state: dict, df: DataFrame, queries: DataFrame, boosts: Mapping[str, float]) -> DataFrame:
    """``(query_id, field, term, avg_dl, weight)``, the boost of the field in the weight."""
    asked = queries.select("query_id", F.explode(value_counts(tx.tokens(F.col("query")))).alias("t")).select(
        "query_id", F.col("t.value").alias("term"), F.col("t.n").alias("qtf")
    )
    facts = [(f, n, total / n, float(boosts[f])) for f, (n, total) in state["fields"].items() if n and f in boosts]
    fields = spark.createDataFrame(facts, "field string, n_docs bigint, avg_dl double, boost double")
    return asked.join(df, "term").join(F.broadcast(fields), "field").select(
        "query_id", "field", "term", "avg_dl",
        (F.col("qtf") * weight(F.col("n_docs"), F.col("df")) * F.col("boost")).alias("weight"),
    )


def _best_field(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The largest of the fields' sums of ``part``."""
    sums = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("part"))), F.lit(0.0)) for f in fields]
    return rows.groupBy(*keys).agg((F.greatest(*sums) if len(sums) > 1 else sums[0]).alias("score"))


def _scores(blocks: DataFrame, weights: DataFrame, wanted: DataFrame, dead: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(query_id, segment, _doc, score)`` of the documents in the ``wanted`` ranges of each query."""
    rows = (
        blocks.select("segment", "range", "field", "term", "postings")
        .join(weights, ["field", "term"])
        .join(broadcast_if_small(wanted.select("query_id", "segment", "range")), ["query_id", "segment", "range"])
        .select("query_id", "segment", "field", "weight", "avg_dl", F.inline("postings"))
    )
    gone = broadcast_if_small(dead.select(F.col("_segment").alias("segment"), "_doc"))
    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avg_dl"))
    found = rows.join(gone, ["segment", "_doc"], "left_anti").withColumn("part", part)
    best = _best_field(found, ["query_id", "segment", "_doc"], fields)
    return best.withColumn("score", F.round("score", DECIMALS))


def ranges_to_read(
    spark: SparkSession, path: str, queries: DataFrame, size: int = 10, version: int | None = None,
    boosts: Mapping[str, float] = BOOSTS, probe: int = PROBE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search reads: ``(bounds, scores, rest)``.

    ``bounds (query_id, segment, range, score)`` come from the blocks' impacts alone. ``scores`` are
    those of the documents in the ``probe`` ranges with the highest bounds, and ``rest`` are the other
    ranges whose bound reaches the score of the ``size``-th of these.
    """
    _, state = commits.read(spark, path, version)
    segments, dead, fields = state.get("segments", []), _dead(spark, path, state), list(boosts)
    terms = stored(queries.select(F.explode(tx.tokens(F.col("query"))).alias("term")).distinct(), "terms")
    blocks = _blocks(spark, path, segments, terms)
    weights = broadcast_if_small(stored(_weights(spark, state, _df(blocks, dead), queries, boosts), "weights"))
    most = F.array_max(F.transform("impacts", lambda p: saturation(p["tf"], p["dl"], F.col("avg_dl"))))
    parts = (
        blocks.select("segment", "range", "field", "term", "impacts")
        .join(weights, ["field", "term"])
        .select("query_id", "segment", "range", "field", (F.col("weight") * most).alias("part"))
    )
    bounds = stored(_best_field(parts, ["query_id", "segment", "range"], fields), "bounds")
    highest = W.partitionBy("query_id").orderBy(F.desc("score"), "segment", "range")
    first = stored(
        bounds.withColumn("_n", F.row_number().over(highest)).where(F.col("_n") <= probe).drop("_n"), "first"
    )

    def read(wanted: DataFrame) -> DataFrame:
        found = _blocks(spark, path, segments, terms, wanted.select("segment", "range").distinct())
        return _scores(found, weights, wanted, dead, fields)

    scores = stored(read(first), "scores")
    nth = W.partitionBy("query_id").orderBy(F.desc("score"))
    least = (
        scores.withColumn("_n", F.row_number().over(nth))
        .where(F.col("_n") == size)
        .select("query_id", F.col("score").alias("least"))
    )
    rest = (
        bounds.join(first.select("query_id", "segment", "range"), ["query_id", "segment", "range"], "left_anti")
        .join(least, "query_id", "left")
        # A score is rounded, so it may lie half a digit above its bound.
        .where(F.coalesce(F.col("score") + F.lit(10.0**-DECIMALS) >= F.col("least"), F.lit(True)))
        .drop("least")
    )
    rest = stored(rest, "rest")
    return bounds, scores.unionByName(read(rest)), rest


def top_hits(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    size: int = 10,
    version: int | None = None,
    boosts: Mapping[str, float] = BOOSTS,
    show: Sequence[str] = ("url",),
    probe: int = PROBE,
) -> DataFrame:
    """``(query_id, rank, score)`` and the columns ``show`` of the best ``size`` documents for each query
    of ``queries (query_id, query)``, by score, then date, then key.

    Only ranges of documents that can hold one of the hits are read, and only hits that tie with the
    last one at most meet the documents.
    """
    _, scores, _ = ranges_to_read(spark, path, queries, size, version, boosts, probe)
    _, state = commits.read(spark, path, version)
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"))
    near = stored(
        scores.withColumn("_n", F.rank().over(by_score)).where(F.col("_n") <= size).drop("_n"), "near"
    )
    docs = _documents(spark, path, state.get("segments", []))
    if docs is None:
        raise ValueError(f"nothing was written to {path}")
    dated = F.col("publish_date") if "publish_date" in docs.columns else F.lit(None).cast("date")
    facts = docs.select(F.col("_segment").alias("segment"), "_doc", "_key", dated.alias("_date"), *show)
    order = [F.desc("score"), F.desc_nulls_last("_date"), F.asc("_key")]
    ranked = facts.join(broadcast_if_small(near), ["segment", "_doc"]).withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= size).select("query_id", "rank", "score", *show)
