import corpus_pipeline

import __spark_entry__ as entry
from pageloom.llm import packing, quality, secrets, simhash
from pageloom.llm.queries import QUERIES


def test_stages_keep_the_columns_and_take_effect(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "SimHash near-dedup", "secret scans", "best-fit packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs).collect() if r.kept}
    kept = docs.filter(docs.doc_id.isin(list(good)))
    one = {r.component_id for r in simhash.duplicates(kept).collect()}
    stage = docs
    for (name, function), want in zip(corpus_pipeline.STAGES[:-1], (good, one, one)):
        stage = function(shared, stage, small)
        assert stage.columns == docs.columns, name
        assert sorted(r.doc_id for r in stage.collect()) == sorted(want), name
    for r in stage.collect():
        text = rows[r.doc_id]
        spans = secrets.find(text)
        assert (r.text == text) == (not spans)
        assert "[secret]" in (r.text or "") or not spans
        assert r.n_chars == len(r.text or "")
    result = corpus_pipeline.run(shared, small).collect()
    assert {r.doc_id for r in result} == one
    total = sum(r.length for r in result)
    assert len({r.sequence_id for r in result}) == -(-total // packing.CAPACITY)


def test_every_query_is_registered_once():
    found = [name for name in entry.queries() if name.startswith("op") or name == "pipeline"]
    assert sorted(found) == sorted(QUERIES)
    assert {name.split("_")[0] for name in found} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_packed_sequences_hold_their_ids(shared, docs_of, small):
    found = corpus_pipeline.best_fit_packing(shared, docs_of([(1, "one two"), (2, None)]), small).collect()
    ids = {r.doc_id: r.ids for r in found}
    assert ids[2] == [packing.END] and ids[1][-1] == packing.END and len(ids[1]) > 1
    assert all(len(r.ids) == r.length for r in found)
