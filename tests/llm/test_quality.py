import re
from collections import Counter

from pageloom.llm import quality as q

LINE = "the quick brown fox jumps over the lazy dog near the old river bank today."
TEXTS = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one two three"), (5, LINE), (5, LINE),
    (6, (LINE + "\n") * 6), (7, " ".join(["### $$$ word"] * 30)), (8, LINE.upper() + " MORE WORDS"),
    (9, "a\nb\na\n \n\nb c\nb c"), (None, LINE), (10, " ".join(str(i) for i in range(40))),
    (11, "a b c d e f a b c d e x a b c d e"), (12, "x x x x x x x x x x"), (13, "é ü ß < > |"),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_figures_equal_brute_force(docs_of):
    rows = q.score(docs_of(TEXTS)).collect()
    got = sorted(map(repr, ((r.doc_id, *r[1:6]) for r in rows)))
    assert got == sorted(map(repr, ((k, *brute(t)) for k, t in TEXTS)))
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_figures_of_a_whole_table(shared, small):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: tuple(r[1:6]) for r in q.score(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_faults_go_and_clean_texts_stay(shared):
    folder = "/root/testdata/sf0.01"
    labels = shared.read.parquet(f"{folder}/labels.parquet")
    found = q.score(shared.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1 and not r.base_failed] or [
        r.kept for r in found if not r.base_failed
    ]
    assert sum(good) >= 0.9 * len(good)


def test_keep_good_agrees_with_score_and_keeps_columns(docs_of):
    docs = docs_of(TEXTS)
    kept = q.keep_good(docs)
    assert kept.schema == docs.schema
    want = sorted(repr(r.doc_id) for r in q.score(docs).collect() if r.kept)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_empty_table(docs_of):
    assert q.score(docs_of([])).collect() == []
    assert q.keep_good(docs_of([])).collect() == []


def test_estimates_find_good_and_useless_rules():
    clean, fault = (0,) * 8 + (1,), (0, -1) + (0,) * 7
    useless_good, useless_bad = (0,) * 7 + (-1, 1), (0, -1, 0, 0, 0, 0, 0, -1, 0)
    model = q.fit([(clean, 800), (useless_good, 80), (fault, 100), (useless_bad, 10)])
    assert model.vote["symbols"] < 3 * model.vote["line_ends"] < 0
    assert model.prior + model.vote["line_ends"] + model.vote["well_formed"] > 0
    assert model.prior + model.vote["symbols"] < 0
    assert all(w <= 0 for n, w in model.vote.items() if n != "well_formed")
    assert q.fit([]) == q.Model()


def test_a_text_without_faults_is_kept_whatever_the_others_are():
    clean, fault, silent = (0,) * 8 + (1,), (0, -1) + (0,) * 7, (0,) * 9
    for counts in ((1, 1000, 1), (1000, 1, 1), (10, 10, 10_000)):
        model = q.fit(list(zip((clean, fault, silent), counts)))
        assert model.prior >= 0 and model.vote["well_formed"] >= 0
