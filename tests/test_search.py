import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pageloom.operators import index as ix
from pageloom.operators import search as se
from pageloom.operators import segments as sg
from pageloom.operators import suggest
from pageloom.plans import views as vw
from pageloom.session import new_path
from pageloom.sources import tables

DOCS = [
    ("h1", "u1", "Red fox", "the red fox runs. A fox!", "fox tale", "ann", ["a", "b"], datetime(2024, 1, 1)),
    ("h2", "u2", "Blue dog", "dogs and a fox", "dog tale", "bob", ["b"], datetime(2024, 1, 2)),
    ("h3", "u3", "", "nothing here", "", "ann", ["c"], None),
    ("h4", "u4", "Fox", "fox", "fox", "ann", [], None),
    ("h5", "u5", "Fox", "fox", "fox", "cy", ["b"], datetime(2023, 1, 1)),
]
SCHEMA = (
    "content_hash string, url string, title string, content string, description string,"
    " author string, tags array<string>, publish_date timestamp"
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


def bm25(field, terms):
    texts = {d[0]: [w for w in "".join(c if c.isalnum() else " " for c in d[field].lower()).split()]
             for d in DOCS}
    filled = [t for t in texts.values() if t]
    average = sum(map(len, filled)) / len(filled)
    scores = {}
    for key, words in texts.items():
        total = 0.0
        for term in terms:
            df = sum(term in t for t in filled)
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (len(filled) - df + 0.5) / (df + 0.5))
                total += 2.2 * idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
        scores[key] = total
    return scores


def expected(query):
    terms = query.lower().split()
    title, content, description = bm25(2, terms), bm25(3, terms), bm25(4, terms)
    best = {k: max(3 * title[k], 2 * content[k], description[k]) for k in title}
    return {k: round(v, 4) for k, v in best.items() if v > 0}


@pytest.mark.parametrize("query", ["fox", "red dog", "fox fox tale", "absent"])
def test_scores(docs, query):
    got = {r["content_hash"]: r["score"] for r in se.scan_scores(docs, query).collect()}
    assert got == pytest.approx(expected(query), abs=1e-4)


def test_scan_equals_postings(spark, docs):
    table = ix.postings(docs)
    queries = spark.createDataFrame(
        [(1, "fox"), (2, "Red dog"), (3, "fox fox tale"), (4, "absent"), (5, "")],
        "query_id int, query string",
    )
    scores = se.score(table, ix.field_stats(docs), ix.term_stats(table), queries)
    for number, text in ((1, "fox"), (2, "Red dog"), (3, "fox fox tale"), (4, "absent"), (5, "")):
        one = {r["content_hash"]: r["score"] for r in se.scan_scores(docs, text).collect()}
        many = {
            r["content_hash"]: r["score"]
            for r in scores.where(F.col("query_id") == number).collect()
        }
        assert many == one
        assert se.scan_total(docs, text).first()["total"] == len(one)
    page = se.search(scores, docs, size=2, offset=1, show=["url"])
    got = sorted(tuple(r) for r in page.where("query_id = 1").select("rank", "url").collect())
    full = [r["url"] for r in se.scan_search(docs, "fox").collect()]
    assert got == [(2, full[1]), (3, full[2])]
    assert {r["query_id"]: r["total"] for r in se.totals(scores).collect()}[1] == 4


def test_scattered_postings_are_scored_in_place(spark, docs, monkeypatch):
    monkeypatch.setattr(se, "TASK_PARTS", 100)
    # Terms of a document in tasks of their own; a posting is shuffled once, and no sum of a query is.
    table = ix.postings(docs).repartition(3, "term").checkpoint()
    queries = spark.createDataFrame([(i, "fox red dog tale") for i in range(50)], "query_id int, query string")
    stats = ix.field_stats(docs), ix.term_stats(table)
    got = se.score(table, *stats, queries, scattered=True).collect()
    assert sorted(got) == sorted(se.score(table, *stats, queries).collect())
    plan = se.score(table, *stats, queries, scattered=True)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "content_hash#" in line]
    # One by document, and one for the sums of rows without a key.
    assert [("REPARTITION_BY_NUM" in line, "query_id" in line) for line in dealt] == [(True, False), (False, True)]
    # Rows without a key are one document, as before.
    bare = table.withColumn("content_hash", F.when(F.col("content_hash") > "h2", F.col("content_hash")))
    got = se.score(bare, *stats, queries, scattered=True).collect()
    assert sorted(got, key=str) == sorted(se.score(bare, *stats, queries).collect(), key=str)


def test_order_puts_missing_dates_last(docs):
    got = [r["url"] for r in se.scan_search(docs, "fox").collect()]
    assert got.index("u5") + 1 == got.index("u4")


def test_filters_keep_scores(docs):
    everything = {r["url"]: r["score"] for r in se.scan_search(docs, "fox").collect()}
    where = se.filters("ann", ["b", "z"], F.lit("2024-01-01"), F.lit("2024-01-01"))
    got = {r["url"]: r["score"] for r in se.scan_search(docs, "fox", where).collect()}
    assert got == {"u1": everything["u1"]}
    assert se.scan_total(docs, "fox", where).first()["total"] == 1
    assert se.scan_total(docs, "fox", cap=2).first()["total"] == 2
    undated = se.scan_search(docs, "fox", se.filters(date_from=F.lit("2000-01-01"))).count()
    assert undated == 3


def test_highlights(docs):
    top = se.scan_search(docs, "fox", highlights=True, size=5).where("url = 'u1'").first()
    assert top["highlights"]["title"] == ["Red <em>fox</em>"]
    assert top["highlights"]["content"] == ["the red <em>fox</em> runs. A <em>fox</em>!"]


def test_postings_on_disk(spark, docs):
    path = new_path(spark, "postings")
    table = ix.postings(docs)
    ix.write_postings(table, path, buckets=4)
    again = spark.read.parquet(path).select(*table.columns)
    wide = new_path(spark, "postings")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    usual = spark.conf.get(size)
    spark.conf.set(size, "300")
    ix.write_postings(ix.postings(docs.repartition(4), key="url"), wide, buckets=1)
    spark.conf.set(size, usual)
    read = spark.read.parquet(wide)
    assert len({r[0] for r in read.select(F.input_file_name()).distinct().collect()}) > 1
    some = ix.read_postings(spark, path, ["fox", "absent"], buckets=4)
    assert {r["term"] for r in some.collect()} == {"fox"}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "(bucket" in plan and "Exchange" not in plan
    assert "In(term, [absent,fox])" in plan.replace("[fox,absent]", "[absent,fox]")
    joined = ix.read_postings(spark, path, ["fox", "absent"], buckets=4, listed=1)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, some.collect()))
    marked = ix.stored_field_stats(ix.postings(docs, mark=True))
    want = {r["field"]: (r["n_docs"], r["avg_dl"]) for r in ix.field_stats(docs).collect() if r["n_docs"]}
    assert {r["field"]: (r["n_docs"], r["avg_dl"]) for r in marked.collect()} == want
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    fox = table.where("term = 'fox' and field = 'content' and content_hash = 'h1'").first()
    assert (fox["tf"], fox["dl"]) == (2, 6)


def test_documents(spark):
    rows = spark.createDataFrame(
        [("http://A.com:80/x", None, "Some  text & more text", None, None, None, None, "h")],
        "url string, title string, content string, description string, author string,"
        " tags array<string>, publish_date timestamp, content_hash string",
    )
    got = ix.prepare_documents(rows, vw.moment(vw.EPOCH)).first().asDict()
    assert got["title"] == "" and got["content"] == "Some text  more text"
    assert got["keywords"] == ["text", "some", "more"]
    assert got["domain"] == "A.com:80" and got["tags"] == [] and got["word_count"] == 0
    slim = ix.prepare_documents(rows, vw.moment(vw.EPOCH), raw=True)
    assert slim.first()["content"] == "Some  text & more text" and "keywords" not in slim.columns


def test_upsert_and_bulk(spark):
    def rows(*data):
        return spark.createDataFrame(
            [(u, h, datetime(2024, 1, 1, n)) for u, h, n in data],
            "url string, content_hash string, indexed_at timestamp",
        )

    def urls(found):
        return {r["content_hash"]: r["url"] for r in found.collect()}

    start = ix.upsert(None, rows(("a", "h1", 1), ("b", "h1", 2), ("c", "h2", 1)))
    assert urls(start) == {"h1": "b", "h2": "c"}
    change = rows(("d", "h2", 0), ("e", "h3", 1))
    after = {"h1": "b", "h2": "d", "h3": "e"}
    assert urls(ix.upsert(start, change)) == after
    path = new_path(spark, "index")
    sg.bulk_index(spark, path, start)
    sg.bulk_index(spark, path, change)
    assert urls(sg.read_index(spark, path)) == after
    sg.bulk_delete(spark, path, spark.createDataFrame([("h2",), ("no",), (None,)], "content_hash string"))
    assert urls(sg.read_index(spark, path)) == {"h1": "b", "h3": "e"}
    sg.bulk_index(spark, path, rows(("f", "h2", 0), ("x", None, 1), ("y", None, 1)))
    sg.bulk_index(spark, path, rows(("x", None, 2)))
    found = sg.read_index(spark, path)
    assert sorted(r["url"] for r in found.collect()) == ["b", "e", "f", "x", "y"]
    other = new_path(spark, "index")
    sg.compact(spark, path, other)
    assert sorted(map(tuple, sg.read_index(spark, other).collect())) == sorted(map(tuple, found.collect()))
    nulls = ix.upsert(rows(("x", None, 1), ("z", None, 1)), rows(("x", None, 2), ("y", None, 2)))
    assert sorted(r["url"] for r in nulls.collect()) == ["x", "y", "z"]
    left = ix.delete(start, spark.createDataFrame([("h1",), ("no",)], "content_hash string"))
    assert urls(left) == {"h2": "c"}


# Fixed sample: product names with the words searched for suggestions.
PRODUCTS = [
    ("Honda Scooty", "honda scooty scooter"),
    ("Yamaha Scooter", "yamaha scooter scooty"),
    ("TVS Scooty Pep", "tvs scooty pep scooter"),
    ("Hero Electric Scooter", "hero electric scooter scooty"),
    ("Bajaj Scooty", "bajaj scooty scooter"),
    ("Suzuki Access", "suzuki access scooty scooter"),
    ("Honda Activa", "honda activa scooty scooter"),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(
        [(i, *p) for i, p in enumerate(PRODUCTS)], "id int, product_name string, spellcheck string"
    )


def test_corrected_queries(spark, products):
    asked = ["skuty", "scuter", "yamha scooter", "Honda", "", "acces hond"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    words = tables.vocabulary(products, "spellcheck")
    got = {r["query_id"]: r["corrected_query"] for r in suggest.corrected_queries(queries, words).collect()}
    assert got == {0: "skuty", 1: "scooter", 2: "yamaha scooter", 3: "honda", 4: "", 5: "access honda"}


def test_corrected_search(spark, products):
    queries = spark.createDataFrame([(1, "yamha scooter")], "query_id int, query string")
    hits = suggest.corrected_search(queries, products, "id").orderBy("rank").collect()
    assert hits[0]["id"] == 1 and hits[0]["corrected_query"] == "yamaha scooter"
    assert len(hits) == 7


def edits(a, b):
    """Restricted Damerau distance."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_edits(spark):
    import random

    rng = random.Random(3)
    pairs = [("wigdte", "widget"), ("ca", "abc"), ("", "ab"), ("a", ""), ("", ""), ("éa漢", "aé漢")]
    pairs += [("".join(rng.choices("abc", k=rng.randrange(1, 9))), "".join(rng.choices("abc", k=rng.randrange(1, 9)))) for _ in range(500)]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = table.select("a", "b", suggest.edits(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r["n"] for r in got] == [edits(a, b) for a, b in pairs]


def test_deletion_index(spark, products):
    words = tables.vocabulary(products, "spellcheck")
    terms = spark.createDataFrame([("scotoer",), ("yamha",), ("hodna",), ("zzzz",)], "term string")
    path = new_path(spark, "deletions")
    suggest.write_deletions(words, path, buckets=4)
    want = sorted(map(tuple, suggest.suggestions(terms, words).collect()))
    assert {r[0] for r in want} == {"scotoer", "yamha", "hodna"}
    for listed in (1_000, 1):
        found = suggest.suggestions(terms, words, index=path, buckets=4, listed=listed)
        assert sorted(map(tuple, found.collect())) == want
    plan = suggest.suggestions(terms, words, index=path, buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "stem" in plan


def test_suggestions_equal_brute_force(spark):
    import random

    rng = random.Random(11)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 15))) for _ in range(1000)}
    words |= {w + "x" * 12 for w in list(words)[:20]}
    known, asked = sorted(words)[::2], sorted(words)[1::2]
    vocabulary = spark.createDataFrame([(w, len(w)) for w in known], "term string, doc_freq int")
    terms = spark.createDataFrame([(w,) for w in asked], "term string")
    got = suggest.suggestions(terms, vocabulary, size=1000).collect()
    expected = {
        (a, b)
        for a in asked
        for b in known
        if len(a) >= 4 and a[0] == b[0] and edits(a, b) <= 2 and 1 - edits(a, b) / min(len(a), len(b)) >= 0.5
    }
    assert {(r["term"], r["suggestion"]) for r in got} == expected and expected
    first = {r["term"]: r["suggestion"] for r in got if r["rank"] == 1}
    for term, best in first.items():
        mine = [b for a, b in expected if a == term]
        assert best == min(
            mine, key=lambda b: (-len(b), -(1 - edits(term, b) / min(len(term), len(b))), b)
        )
