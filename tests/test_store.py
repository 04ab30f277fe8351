import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.operators import dedup, extract
from pageloom.session import new_path
from pageloom.sources import store, tables

SCHEMA = "url string, content_hash string, extracted_at timestamp"


def one_by_one(rows, urls=(), hashes=()):
    """Insert in order; refuse what collides."""
    urls, hashes, kept = set(urls), set(hashes), []
    for url, digest, at in sorted(set(rows), key=lambda r: (r[2], r[0], r[1] or "")):
        if url in urls or (digest is not None and digest in hashes):
            continue
        kept.append((url, digest, at))
        urls.add(url)
        hashes.add(digest)
    return kept


def at(n):
    return datetime(2024, 1, 1) + timedelta(minutes=n)


def rows(found):
    return sorted(map(tuple, found.select("url", "content_hash", "extracted_at").collect()), key=repr)


def test_refused_row_blocks_nobody(spark):
    data = [("u1", "h1", at(1)), ("u2", "h1", at(2)), ("u2", "h2", at(3)), ("u1", None, at(4)),
            ("u3", None, at(5)), ("u4", None, at(6)), ("u3", "h9", at(7))]
    got = rows(store.accepted(spark.createDataFrame(data, SCHEMA)))
    assert got == sorted(one_by_one(data), key=repr)
    assert ("u2", "h2", at(3)) in got and ("u4", None, at(6)) in got


def test_equals_one_by_one(spark):
    rng = random.Random(5)
    for urls, hashes in ((4, 4), (30, 10), (10, 200)):
        data = [
            (f"u{rng.randrange(urls)}", rng.choice([None, *(f"h{i}" for i in range(hashes))]),
             at(rng.randrange(40)))
            for _ in range(200)
        ]
        got = rows(store.accepted(spark.createDataFrame(data, SCHEMA)))
        assert got == sorted(one_by_one(data), key=repr)


def test_long_chain(spark):
    # Each row collides with the one before in url or hash; every other one is kept.
    data = [(f"u{(i + 1) // 2}", f"h{i // 2}", at(i)) for i in range(40)]
    got = rows(store.accepted(spark.createDataFrame(data, SCHEMA)))
    assert got == sorted(one_by_one(data), key=repr) and len(got) == 20


def test_save_twice(spark):
    path = new_path(spark, "t")
    first = [("u1", "h1", at(1)), ("u2", None, at(2))]
    second = [("u1", "h5", at(3)), ("u5", "h1", at(4)), ("u6", "h6", at(5)), ("u7", None, at(6))]
    assert store.read_content(spark, path) is None
    store.save_content(spark, path, spark.createDataFrame(first, SCHEMA), part="batch=0")
    for _ in range(2):  # a repeated batch leaves one copy
        store.save_content(spark, path, spark.createDataFrame(second, SCHEMA), part="batch=1")
    assert rows(store.read_content(spark, path)) == sorted(first + second[2:], key=repr)


def test_the_default_clock_saves_every_page(spark, small):
    """The example of the README."""
    path, pages = new_path(spark, "readme"), tables.read_table(spark, small, "pages")
    records = extract.useful(extract.content_records(extract.page_nodes(pages)))
    saved = store.save_content(spark, path, records)
    distinct = records.select("content_hash").distinct().count()
    assert saved.count() == store.read_content(spark, path).count() == distinct > 0


def test_batches_with_different_columns(spark):
    path = new_path(spark, "t")
    store.save_content(spark, path, spark.createDataFrame([("u1", "h1", at(1))], SCHEMA))
    titled = spark.createDataFrame([("u2", "h2", at(2), "T", 5)], f"{SCHEMA}, title string, other int")
    store.save_content(spark, path, titled)
    found = store.read_content(spark, path)
    assert found.columns == [f.name for f in tables.CONTENT_SCHEMA] + ["batch"]
    assert sorted((r.url, r.title) for r in found.collect()) == [("u1", None), ("u2", "T")]


def test_delete_and_schema(spark):
    table = spark.createDataFrame([("u1", "h1", at(1)), ("u2", "h2", at(2))], SCHEMA)
    deletes = spark.createDataFrame([("h1",), ("zz",)], "content_hash string")
    assert [r["url"] for r in store.delete_content(table, deletes).collect()] == ["u2"]
    whole = tables.as_content(table)
    assert [f.name for f in whole.schema] == [f.name for f in tables.CONTENT_SCHEMA]


def similarity(a, b):
    return len(a & b) / len(a | b)


def first_partners(texts, threshold=0.8):
    sets = [(i, set(t.lower().split())) for i, t in enumerate(texts)]
    found = {}
    for i, words in sets:
        for j, other in sets[:i]:
            if words and other and similarity(words, other) >= threshold:
                found[i] = j
                break
    return found


def near(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    found = dedup.near_duplicates(docs, "id", "text", **options).collect()
    assert len({r["id"] for r in found}) == len(found)
    return {r["id"]: r["duplicate_of"] for r in found}


def test_near_duplicates_random(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.sample(vocabulary, rng.randrange(1, 25)) for _ in range(25)]
    texts = []
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["", texts[3], "&"]
    assert near(spark, texts) == first_partners(texts)
    assert near(spark, texts, threshold=0.55) == first_partners(texts, 0.55)


def test_near_duplicates_of_one_page(spark):
    # Most rows are one boilerplate page with a word of their own: one large group, many rounds.
    common = " ".join(f"c{i}" for i in range(30))
    texts = [f"{common} own{i}" for i in range(160)] + [f"x{i} y{i} z{i}" for i in range(20)]
    assert near(spark, texts) == first_partners(texts) == {i: 0 for i in range(1, 160)}


def test_large_group_without_partners(spark):
    # All share frequent words but no two are alike; then two late ones are.
    rng = random.Random(3)
    words = [f"k{i}" for i in range(14)]
    texts = sorted({" ".join(sorted(rng.sample(words, 5))) for _ in range(400)})[:240]
    texts += [texts[200] + " extra", texts[230] + " more"]
    assert near(spark, texts) == first_partners(texts)


def test_near_duplicates_by_text_key(spark):
    docs = spark.createDataFrame(
        [("u2", "a b c d"), ("u1", "d c b a"), ("u3", "a b c d e"), ("u4", "x")], "url string, text string"
    )
    got = dedup.near_duplicates(docs, "url", "text").collect()
    assert {r["url"]: (r["duplicate_of"], r["similarity"]) for r in got} == {
        "u2": ("u1", 1.0), "u3": ("u1", 0.8),
    }


def test_exact_dedup(spark):
    data = [("u2", "h", at(1)), ("u1", "h", at(1)), ("u3", None, at(0)), ("u4", None, at(0))]
    got = dedup.exact_dedup(spark.createDataFrame(data, SCHEMA))
    assert sorted(r["url"] for r in got.collect()) == ["u1", "u3", "u4"]


def test_near_duplicates_on_documents(spark, small):
    docs = tables.read_table(spark, small, "documents", ["doc_id", "text"])
    from pageloom.functions.text import word_set

    words = {
        r["doc_id"]: set(r["w"])
        for r in docs.select("doc_id", word_set(F.col("text")).alias("w")).collect()
    }
    expected = {}
    for i in sorted(words):
        partners = [j for j in words if j < i and words[i] and words[j]
                    and similarity(words[i], words[j]) >= 0.8]
        if partners:
            expected[i] = min(partners)
    got = {r["doc_id"]: r["duplicate_of"]
           for r in dedup.near_duplicates(docs, "doc_id", "text").collect()}
    assert got == expected and expected
