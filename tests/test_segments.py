import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.functions import plain, workers
from pageloom.operators import index as ix
from pageloom.operators import search as se
from pageloom.operators import segments as sg
from pageloom.operators.index import FIELDS, postings
from pageloom.session import new_path
from pageloom.sources import commits

SCHEMA = "url string, title string, content string, description string, publish_date date, content_hash string, indexed_at timestamp"


def documents(spark, rows):
    """From ``(hash, content)``; no hash means a url of its own."""
    full = [
        (f"u{h or c}", f"about {h}", c, None, None, h, datetime(2024, 1, 1)) for h, c in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def hashes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "content_hash string")


def kept(spark, path, version=None):
    return sorted((r["content_hash"], r["content"]) for r in sg.read_index(spark, path, version).collect())


def by_scan(spark, path, queries, size=10):
    """The same hits from the documents, one query at a time."""
    docs = sg.read_index(spark, path).withColumn("_key", F.concat(F.lit("h:"), "content_hash"))
    found = []
    for number, text in queries:
        page = se.scan_search(docs, text, size=size, key="_key").collect()
        found += [(number, i + 1, r["score"], r["url"]) for i, r in enumerate(page)]
    return sorted(found)


def hits(spark, path, queries, **more):
    asked = spark.createDataFrame(queries, "query_id int, query string")
    return sorted(map(tuple, sg.top_hits(spark, path, asked, **more).collect()))


def test_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commits.read(spark, path) == (-1, {})
    assert commits.put_if_absent(spark, path, 0, {"a": 1})
    assert not commits.put_if_absent(spark, path, 0, {"a": 2})
    seen = []

    def change(state):
        seen.append(state["a"])
        if len(seen) == 1:  # another writer is faster
            assert commits.put_if_absent(spark, path, 1, {"a": 10})
        return {"a": state["a"] + 1}

    assert commits.commit(spark, path, change) == 2
    assert seen == [1, 10] and commits.read(spark, path) == (2, {"a": 11})
    assert commits.read(spark, path, 1) == (1, {"a": 10})
    assert commits.commit(spark, path, lambda state: None) == 2
    assert commits.versions(spark, path) == [0, 1, 2]
    assert commits.expire(spark, path, 1, lambda state: set()) == 2
    with pytest.raises(ValueError):
        commits.read(spark, path, 0)


def test_two_writers_keep_both(spark, monkeypatch):
    path = new_path(spark, "index")
    assert sg.bulk_index(spark, path, documents(spark, [("a", "one"), ("b", "two")])) == 2
    bury, done = sg._bury, []

    def slow(*args):
        found = bury(*args)
        if not done:  # between the look at the state and the commit
            done.append(1)
            assert sg.bulk_index(spark, path, documents(spark, [("c", "four"), ("b", "five")])) == 2
        return found

    monkeypatch.setattr(sg, "_bury", slow)
    assert sg.bulk_index(spark, path, documents(spark, [("b", "three"), ("d", "six")])) == 2
    assert kept(spark, path) == [("a", "one"), ("b", "three"), ("c", "four"), ("d", "six")]
    assert sg.count(spark, path) == 4
    assert kept(spark, path, 0) == [("a", "one"), ("b", "two")]


def test_merging_meets_a_writer(spark, monkeypatch):
    path = new_path(spark, "index")
    for h in "abc":
        sg.bulk_index(spark, path, documents(spark, [(h, f"first {h}"), ("x", f"x of {h}")]))
    write, done = sg._write_segment, []

    def slow(*args):
        found = write(*args)
        if not done:
            done.append(1)
            sg.bulk_delete(spark, path, hashes(spark, "a"))
            sg.bulk_index(spark, path, documents(spark, [("b", "second b")]))
        return found

    monkeypatch.setattr(sg, "_write_segment", slow)
    assert sg.merge(spark, path, everything=True) == 3
    want = [("b", "second b"), ("c", "first c"), ("x", "x of c")]
    assert kept(spark, path) == want and sg.count(spark, path) == 3
    assert len(commits.read(spark, path)[1]["segments"]) == 2
    queries = [(1, "second x"), (2, "first")]
    assert hits(spark, path, queries) == by_scan(spark, path, queries)
    sg.expire(spark, path)
    assert kept(spark, path) == want


def test_segments_of_like_size_are_merged(spark):
    path = new_path(spark, "index")
    sg.bulk_index(spark, path, documents(spark, [(f"big{i}", "word") for i in range(40)]))
    for i in range(3):
        sg.bulk_index(spark, path, documents(spark, [(f"s{i}", "word")]))
    assert sg.merge(spark, path, fan=4) == 0
    sg.bulk_index(spark, path, documents(spark, [("s3", "word")]))
    assert sg.merge(spark, path, fan=4) == 4
    assert sorted(s["rows"] for s in commits.read(spark, path)[1]["segments"]) == [4, 40]
    assert sg.count(spark, path) == 44


def test_nothing_to_write_or_delete(spark):
    path = new_path(spark, "index")
    assert sg.bulk_index(spark, path, documents(spark, [])) == 0
    assert sg.bulk_delete(spark, path, hashes(spark, "a", None)) == 0
    assert commits.versions(spark, path) == []
    sg.bulk_index(spark, path, documents(spark, [("a", ""), ("a", "later"), (None, "x"), (None, "y")]))
    assert sg.bulk_delete(spark, path, hashes(spark, "no")) == 0 and sg.count(spark, path) == 3
    assert hits(spark, path, [(1, ""), (2, "absent")]) == []
    assert sg.bulk_delete(spark, path, hashes(spark, "a", "a")) == 1 and sg.count(spark, path) == 2


@pytest.fixture
def many(spark, monkeypatch):
    """600 documents in three segments with small ranges; some are written again, some deleted."""
    monkeypatch.setattr(sg, "RANGE_BITS", 2)
    rng = random.Random(8)
    path = new_path(spark, "index")

    def rows(ids):
        made = []
        for i in ids:
            words = rng.choices(["red", "fox", "dog", "sky", "sea"], [9, 6, 3, 2, 1], k=rng.randint(3, 30))
            made.append((f"{i:04}", " ".join(words + ["rare"] * (rng.random() < 0.02))))
        return documents(spark, made).coalesce(2)

    sg.bulk_index(spark, path, rows(range(400)))
    sg.bulk_index(spark, path, rows(range(350, 560)))
    sg.bulk_index(spark, path, rows(range(0, 600, 7)))
    sg.bulk_delete(spark, path, hashes(spark, *[f"{i:04}" for i in range(0, 600, 11)]))
    return path


QUERIES = [(1, "rare"), (2, "red fox"), (3, "sea rare sea"), (4, "nothing at all"), (5, "dog about")]


@pytest.mark.parametrize("size,probe", [(10, 1), (10, 16), (3, 2), (1000, 2)])
def test_top_hits_equal_a_scan(spark, many, size, probe):
    assert hits(spark, many, QUERIES, size=size, probe=probe) == by_scan(spark, many, QUERIES, size)


def test_ranges_below_the_last_hit_are_not_read(spark, many):
    asked = spark.createDataFrame([(1, "rare red")], "query_id int, query string")
    bounds, scores, rest = sg.ranges_to_read(spark, many, asked, size=3, probe=4)
    every, more = bounds.count(), rest.count()
    assert every > 100 and 4 + more < every / 4
    # The bounds hold for all documents.
    _, whole, _ = sg.ranges_to_read(spark, many, asked, size=10_000, probe=4)
    best = whole.groupBy("segment", sg._range().alias("range")).agg(F.max("score").alias("best"))
    joined = best.join(bounds, ["segment", "range"])
    assert joined.count() == best.count()
    assert joined.where("best > score + 0.0001").count() == 0
    assert scores.count() < whole.count() / 4


def test_terms_and_ranges_reach_the_scan(spark, many):
    _, state = commits.read(spark, many)
    terms = spark.createDataFrame([("rare",), ("absent",)], "term string")
    part = state["segments"][0]["part"]
    ranges = spark.createDataFrame([(part, 3), (part, 4), (part, 90)], "segment string, range bigint")
    found = sg._blocks(spark, many, state["segments"], terms, ranges)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "In(term" in plan
    assert "GreaterThanOrEqual(range,3)" in plan and "Exchange" not in plan
    assert {(r["term"], r["segment"]) for r in found.collect()} <= {("rare", part)}
    assert sg._blocks(spark, many, state["segments"], terms, ranges.limit(0)).count() == 0


def test_many_terms_and_ranges_are_joined(spark, many, monkeypatch):
    want = hits(spark, many, QUERIES)
    monkeypatch.setattr(sg, "LISTED", 1)
    assert hits(spark, many, QUERIES) == want


def test_postings_equal_those_of_the_documents(spark, many):
    _, state = commits.read(spark, many)
    docs = sg.read_index(spark, many)
    want = ix.postings(docs).groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    terms = want.select("term").distinct()
    got = sg._df(sg._blocks(spark, many, state["segments"], terms), sg._dead(spark, many, state))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    stats = {r["field"]: (r["n_docs"], r["avg_dl"]) for r in ix.field_stats(docs).collect() if r["n_docs"]}
    assert {f: (n, t / n) for f, (n, t) in state["fields"].items() if n} == stats


def test_blocks_are_made_from_texts(spark):
    """What is plain is counted where blocks are made, the rest by Columns; both as ``postings`` does."""
    rows = [(n, f"red fox {n % 7} fox", "Привет мир мир" if n % 3 else "don't _ 3.5", None if n % 5 else "") for n in range(400)]
    docs = spark.createDataFrame(rows, "_doc bigint, title string, content string, description string").coalesce(1)
    texts = [c for f in FIELDS for c in (F.col(f).alias(f"text_{f}"), plain.other_counts(F.col(f)).alias(f"counted_{f}"))]
    blocks = docs.select("_doc", *texts).mapInArrow(workers.text_blocks(FIELDS, 7), sg._BLOCK).collect()
    got = sorted((p["_doc"], b["field"], b["term"], p["tf"], p["dl"]) for b in blocks for p in b["postings"])
    wanted = postings(docs, FIELDS, key="_doc").select("_doc", "field", "term", "tf", "dl").collect()
    assert got == sorted(map(tuple, wanted)) and any(b["term"] == "мир" for b in blocks)
    # Each range has one block for a term and field.
    assert len({(b["range"], b["field"], b["term"]) for b in blocks}) == len(blocks)


def test_merged_segments_keep_lengths(spark, monkeypatch):
    path = new_path(spark, "index")
    rows = [(f"u{n}", f"h{n}", "red fox", "a fox " * n, None, datetime(2024, 1, 1)) for n in range(1, 9)]
    docs = spark.createDataFrame(
        rows, "url string, content_hash string, title string, content string, description string, indexed_at timestamp"
    )
    sg.bulk_index(spark, path, docs.where("url < 'u5'"))
    sg.bulk_index(spark, path, docs.where("url >= 'u4'"))
    before = sg.commits.read(spark, path)[1]["fields"]
    # No text is taken apart for its length again.
    monkeypatch.setattr(sg.plain, "word_number", lambda text: F.raise_error(F.lit("counted again")).cast("int"))
    assert sg.merge(spark, path, everything=True) == 2
    state = sg.commits.read(spark, path)[1]
    assert state["fields"] == before == state["segments"][0]["fields"]
    assert before["content"] == [8, 72]
