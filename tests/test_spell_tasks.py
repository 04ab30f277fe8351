"""A corrected search scores few postings in a task, whatever files the products lie in."""

from pageloom.operators import search as se
from pageloom.operators import suggest


def test_postings_are_spread(spark, monkeypatch):
    rows = [(i, f"red {w}", f"red {w}") for i, w in enumerate(["bolt", "plate", "gear", "ring"] * 10)]
    products = spark.createDataFrame(rows, "id int, product_name string, spellcheck string").coalesce(1)
    queries = spark.createDataFrame([("a", "red blot"), ("b", "plaet")], "query_id string, query string")
    parts, score = [], se.score

    def seen(postings, *rest):
        parts.append(postings.rdd.getNumPartitions())
        return score(postings, *rest)

    monkeypatch.setattr(se, "score", seen)
    wanted = suggest.corrected_search(queries, products, "id").collect()
    monkeypatch.setattr(suggest, "TASK_POSTINGS", 50)
    got = suggest.corrected_search(queries, products, "id").collect()
    assert parts == [1, 4]
    assert sorted(got) == sorted(wanted) and len(got) == 20
    assert {r["corrected_query"] for r in got} == {"red bolt", "plate"}
