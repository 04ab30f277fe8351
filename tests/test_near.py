"""Near duplicates: the places of rare words rule out pairs, and none that is alike."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions import workers
from pageloom.operators import dedup


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_places_lose_no_pair(spark, threshold):
    random.seed(11)
    rows = []
    for i in range(160):
        words = set(random.choices([f"w{n}" for n in range(60)], k=random.randint(1, 25)))
        if rows and random.random() < 0.6:
            words = set(random.choice(rows)[1].split()) ^ {f"w{random.randint(0, 59)}"}
        rows.append((i, " ".join(sorted(words))))
    wanted = {}
    for i, text in rows:
        a = set(text.split())
        for j, other in rows[:i]:
            b = set(other.split())
            if a and b and len(a & b) / len(a | b) >= threshold:
                wanted[i] = j
                break
    docs = spark.createDataFrame(rows, "id int, text string")
    got = dedup.near_duplicates(docs, "id", "text", threshold).collect()
    assert {r["id"]: r["duplicate_of"] for r in got} == wanted


def test_entries_tell_places(spark):
    sets = spark.createDataFrame([(1, [5, 6, 7, 8, 9]), (2, [5, 6, 7, 8, 10])], "id int, hashes array<bigint>")
    found = dedup._prefix_entries(sets.withColumn("size", F.size("hashes")), 0.8).collect()
    assert sorted((r["id"], r["place"], r["token"]) for r in found) == [(1, 1, 9), (1, 2, 5), (2, 1, 10), (2, 2, 5)]


def _signed(spark, rows):
    sets = spark.createDataFrame(rows, "id bigint, hashes array<bigint>").withColumn("size", F.size("hashes"))
    return sets.select("id", "size", F.arrow_udf(workers.signatures, "binary")("hashes").alias("signature"))


def test_signatures_grow_with_sets(spark, monkeypatch):
    random.seed(5)
    pool = [random.getrandbits(64) - 2**63 for _ in range(9000)]
    base, rows, wanted = pool[:2300], [], set()
    rows.append((0, base))
    for i, changed in enumerate([0, 190, 230, 250, 520, 700, 1100], 1):
        # Some of the sets lie on the other side of a power of two, so that signatures differ in length.
        words = base[changed:] + pool[3000 : 3000 + changed]
        rows.append((i, words))
        if len(set(words) & set(base)) / len(set(words) | set(base)) >= 0.8:
            wanted.add(i)
    rows.append((8, base[:1900]))
    wanted.add(8)
    signed = _signed(spark, rows)
    assert signed.selectExpr("max(length(signature)) > min(length(signature))").first()[0]
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 9)], "id bigint, partner bigint")
    for tile_bytes in (dedup.TILE_BYTES, 1000):
        monkeypatch.setattr(dedup, "TILE_BYTES", tile_bytes)
        found = {r["id"] for r in dedup._likely(pairs, signed, 0.8).collect()}
        # None that is alike is lost, and large sets that are not are ruled out without their words.
        assert wanted == {1, 2, 3, 4, 8} and wanted <= found and not found & {5, 6, 7}


def test_frequent_words_are_ordered_by_their_count(spark, monkeypatch):
    # The most frequent words fill the table, whatever share of all words they are.
    monkeypatch.setattr(dedup, "COMMON_TOKENS", 4)
    rows = [(i, [1, 2, 3, 4, *([5] if i < 2 else []), *range(100 * i, 100 * i + 20)]) for i in range(1, 9)]
    rows += [(20 + i, [1, 2, 3]) for i in range(2)] + [(30, [1, 2])]
    sets = spark.createDataFrame(rows, "id int, hashes array<bigint>").withColumn("size", F.size("hashes"))
    found = {(r["id"], r["place"]): r["token"] for r in dedup._prefix_entries(sets, 0.1).collect()}
    # 1 and 2 stand in 11 sets each, 3 in 10 and 4 in 8.
    assert [found[20, n] for n in (1, 2, 3)] == [3, 1, 2]
    assert [found[8, n] for n in (21, 22)] == [4, 3]


def test_repeated_and_missing_keys(spark):
    words = "one two three four five six seven eight nine ten"
    rows = [(1, words), (1, words), (2, words), (3, words + " more"), (3, "other text"), (None, "other text"), (4, None)]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert sorted((r["id"], r["duplicate_of"]) for r in got) == [(2, 1), (3, 1)]
