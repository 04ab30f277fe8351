import re

import numpy as np
import pytest

from pageloom.llm import licenses as l


@pytest.fixture(scope="module")
def model():
    return l.train()


def python_family(text, model):
    """The same decision by plain Python."""
    if not re.search(l.GATE, text):
        return l.NONE
    words = l.tokens(text)
    place = {int(h): i for i, h in enumerate(model.grams)}
    z = model.bias + l._rows([text], place)[0] @ model.weights
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    family = model.families[int(p.argmax())]
    own = set(l._pairs_of(words)) or set(words)
    share = 0.0
    if family != l.NONE:
        pairs = [set(l._pairs_of(l.tokens(t))) for t in l.TEMPLATES[family]]
        share = max(len(t & own) / min(len(t), len(own)) for t in pairs)
    if family != l.NONE and p.max() >= model.threshold and share >= l.LEAST_SHARED:
        return family
    return l.NONE if p[0] > l.NOTICE else l.UNKNOWN


def test_held_out_accuracy(model):
    held = l.labelled(5, seed=77)
    said = [(python_family(t, model), c) for t, c in held]
    assert np.mean([a == b for a, b in said]) >= 0.9
    families = [(a, b) for a, b in said if a not in (l.NONE, l.UNKNOWN)]
    assert np.mean([a == b for a, b in families]) >= 0.98
    assert all(a == l.NONE for a, b in said if b == l.NONE)


def test_spark_scores_as_python_does(docs_of, model):
    held = l.labelled(1, seed=5)
    found = l.scan(docs_of(enumerate(t for t, _ in held)), model=model).collect()
    for r in found:
        text = held[r.doc_id][0]
        want = python_family(text, model)
        assert r.licenses == ([] if want == l.NONE else [want]), text


def test_lines_of_a_document(docs_of, model):
    text = "intro\nLicensed under the Apache License, Version 2.0.\n\nReleased under the MIT License.\nmit dem Hund"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "Licensed under the Foo Bar License"),
            (4, "der Hund " * 20_000 + "\nAll rights reserved.")]
    found = l.scan(docs_of(rows), model=model).collect()
    got = sorted((repr(r.doc_id), r.licenses, [n.line for n in r.notices]) for r in found)
    assert got == [
        ("1", ["Apache-2.0", "MIT"], [1, 3]), ("1", ["Apache-2.0", "MIT"], [1, 3]), ("2", [], []), ("3", [], []),
        ("4", ["proprietary"], [1]), ("None", ["unknown"], [0]),
    ]
    assert all(r.n_notices == len(r.notices) for r in found)
    assert l.scan(docs_of([]), model=model).collect() == []


def test_whole_table(shared, small, model):
    docs = shared.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in l.scan(docs, model=model).collect():
        lines = [python_family(x, model) for x in (text[r.doc_id] or "").split("\n")]
        assert [(n.line, n.family) for n in r.notices] == [(k, f) for k, f in enumerate(lines) if f != l.NONE]


def test_wrapped_notices(docs_of, model):
    texts = [
        "This work is licensed under the GNU General Public License,\nversion 3.",
        " * This work is licensed under the GNU General Public License,\n * version 2.\n *\n * Other text.",
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU "
        "General Public License as published by\n# the Free Software Foundation, either version 3 of the License",
        "Released under the MIT License\nLicensed under the Apache License, Version 2.0",
    ]
    found = {r.doc_id: r for r in l.scan(docs_of(enumerate(texts)), model=model).collect()}
    got = [(found[k].licenses, [n.line for n in found[k].notices]) for k in range(4)]
    assert got == [(["GPL-3.0"], [0]), (["GPL-2.0"], [0]), (["GPL-3.0"], [0]), (["Apache-2.0", "MIT"], [0, 1])]
