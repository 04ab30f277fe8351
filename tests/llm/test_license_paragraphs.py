"""Notices over several lines, against whole headers and a plain Python version of the same rules."""

import random
import re
import textwrap

import numpy as np
import pytest

from pageloom.llm import licenses as l

T, MORE = l.TEMPLATES, l.FURTHER
OWNER = "Copyright (c) 2019, Jane Roe."
HEADERS = {
    "GPL-2.0": [T["GPL-2.0"][2], *MORE["GPL-2.0"][:2]],
    "GPL-3.0": [T["GPL-3.0"][2], *MORE["GPL-3.0"]],
    "LGPL": [T["LGPL"][2], *MORE["LGPL"]],
    "AGPL-3.0": [T["AGPL-3.0"][2], *MORE["AGPL-3.0"]],
    "Apache-2.0": [T["Apache-2.0"][1], T["Apache-2.0"][2], *MORE["Apache-2.0"]],
    "MIT": [OWNER, T["MIT"][5], *MORE["MIT"]],
    "ISC": [OWNER, T["ISC"][1], *MORE["ISC"]],
    "BSD": [f"{OWNER} All rights reserved.", T["BSD"][3] + ":", *MORE["BSD"][1:]],
    "MPL-2.0": [f"{T['MPL-2.0'][0]}. {MORE['MPL-2.0'][0]}"],
    "EPL-2.0": [T["EPL-2.0"][1], T["EPL-2.0"][2]],
}


@pytest.fixture(scope="module")
def model():
    return l.train()


def wrapped(paragraphs, columns, mark):
    blocks = ("\n".join(mark + x for x in textwrap.wrap(p, columns)) for p in paragraphs)
    return f"\n{mark.rstrip()}\n".join(blocks)


def test_headers_give_their_family_at_any_width(docs_of, model):
    cases = [(family, f"int main(void);\n\n{wrapped(ps, columns, mark)}\n\nint x = 1;")
             for family, ps in HEADERS.items() for columns in (20, 40, 72, 10_000)
             for mark in ("// ", "# ", " * ", "")]
    found = {r.doc_id: r for r in l.scan(docs_of(enumerate(t for _, t in cases)), model=model).collect()}
    assert [found[k].licenses for k in range(len(cases))] == [[family] for family, _ in cases]


LINES = {
    "Licensed under the MIT license or the Apache License": ["Apache-2.0", "MIT"],
    "Licensed under the MIT license or the\nApache License": ["Apache-2.0", "MIT"],
    "SPDX-License-Identifier: GPL-2.0-only OR MIT": ["GPL-2.0", "MIT"],
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"],
    "Dual-licensed under MIT and Apache-2.0": ["Apache-2.0", "MIT"],
    "Licensed under MIT/Apache-2.0": ["Apache-2.0", "MIT"],
    "Available under either the BSD license or the GPL v2": ["BSD", "GPL-2.0"],
    "This is not licensed under the MIT license": [],
    "Licensed under the zlib license": ["unknown"],
    "Licensed under\nthe zlib license": ["unknown"],
    "Released under the MIT License\n\nLicensed under the zlib license": ["MIT", "unknown"],
    "Copyright (c) 2019 Jane Roe": [],
}


def test_lists_negation_and_the_unknown(docs_of, model):
    found = {r.doc_id: r.licenses for r in l.scan(docs_of(enumerate(LINES)), model=model).collect()}
    assert [found[k] for k in range(len(LINES))] == list(LINES.values())


def test_many_lines_of_notices(docs_of, model):
    two = ["Released under the MIT License", "Licensed under the Apache License, Version 2.0"]
    texts = ["\n".join(two * 200), "\n\n".join(two * 200), "\n".join(["word " * 30] * 3_000 + two)]
    found = {r.doc_id: r for r in l.scan(docs_of(enumerate(texts)), model=model).collect()}
    assert [n.line for n in found[0].notices] == list(range(400))
    assert [n.line for n in found[1].notices] == list(range(0, 800, 2))
    assert [(n.line, n.family) for n in found[2].notices] == [(3_000, "MIT"), (3_001, "Apache-2.0")]


class Plain:
    """The rules of ``scan`` by loops and sets over one text."""

    def __init__(self, model):
        self.model = model
        self.place = {int(h): i for i, h in enumerate(model.grams)}
        self.families = {f: set(hs) for f, hs in l.known_pairs().items()}
        self.known = set().union(*self.families.values())

    @staticmethod
    def pairs(words):
        return {l.hashed(" ".join(p)) for p in zip(words, words[1:])}

    def judge(self, text, rivals):
        words, model = l.tokens(text), self.model
        z = model.bias + l._rows([text], self.place)[0] @ model.weights
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, pairs = model.families[int(p.argmax())], self.pairs(words)
        own, part, both = set(l._pairs_of(words)) or set(words[:1]), 0.0, 0
        if family != l.NONE:
            templates = [set(l._pairs_of(l.tokens(t))) for t in T[family]]
            part = max(len(t & own) / max(1, min(len(t), len(own))) for t in templates)
            both = max(len(t & own) for t in templates)
        likely = family != l.NONE and p.max() >= model.threshold and part >= l.LEAST_SHARED
        apart = not rivals or sum(
            len(pairs & ps) >= len(pairs & self.families.get(family, set())) for ps in self.families.values()) == 1
        negated = re.search(l.NEGATED, text)
        sure = bool(likely and apart and not negated)
        none = negated or (not likely and p[0] > l.NOTICE)
        said = family if sure else l.NONE if none else l.UNKNOWN
        return {"family": said, "sure": sure, "both": both, "pairs": pairs}

    def units(self, paragraph):
        if len(paragraph) == 1:
            return [paragraph]
        words = [(k, w) for k, (_, t) in enumerate(paragraph) for w in l.tokens(plain(t))]
        lines = [[w for i, w in words if i == k] for k in range(len(paragraph))]
        known = self.known & self.pairs([w for _, w in words])
        units, run = [], []
        for k, (n, text) in enumerate(paragraph):
            left = lines[k - 1][-1:] if k else []
            right = lines[k + 1][:1] if k + 1 < len(lines) else []
            row = left + lines[k] + right
            flags = [l.hashed(" ".join(p)) in known for p in zip(row, row[1:])]
            at = lambda i: 0 <= i < len(flags) and flags[i]
            hits = sum(at(len(left) + w - 1) or at(len(left) + w) for w in range(len(lines[k])))
            if lines[k] and 2 * hits >= len(lines[k]):
                run.append((n, text))
                continue
            units += [run, [(n, text)]]
            run = []
        return [u for u in [*units, run] if any(re.search(l.GATE, t) for _, t in u)]

    def told(self, family, pairs, names):
        own = pairs & self.families[family]
        return bool(pairs) and any(
            g != family and own <= self.families[g]
            and (family != l.UNKNOWN or len(pairs & self.families[g]) >= l.LEAST_TOLD * len(pairs))
            for g in names
        )

    def of_unit(self, unit):
        lone = [(n, self.judge(t, False)) for n, t in unit if re.search(l.GATE, t)]
        gated = [n for n, _ in lone]
        lone = [(n, j) for n, j in lone if j["family"] != l.NONE]
        if len(unit) == 1:
            return lone, None
        text = re.sub(r"\s[#*/;%!-]+\s", " ", " ".join(plain(t) for _, t in unit))
        whole, first = self.judge(text, True), unit[0][0]
        most = max((j["both"] for _, j in lone if j["sure"] and j["family"] == whole["family"]), default=0)
        if whole["sure"] and whole["both"] > most:
            theirs = self.families[whole["family"]]
            beside = [(n, j) for n, j in lone if j["sure"] and j["family"] != whole["family"]
                      and j["pairs"] & self.families[j["family"]] - theirs]
            named = [n for n, _ in beside]
            free = [n for n in gated if n not in named]
            return [*beside, (free[0] if first in named and free else first, whole)], whole
        if whole["family"] == l.UNKNOWN and not any(j["sure"] for _, j in lone):
            return [(first, whole)], whole
        return lone, whole

    def scan(self, text):
        paragraphs, last = [], []
        for n, t in enumerate([*text.split("\n"), ""]):
            if re.search(r"[^\W_]", t):
                last.append((n, t))
            else:
                paragraphs, last = [*paragraphs, last], []
        gated = [p for p in paragraphs if any(re.search(l.GATE, t) for _, t in p)]
        units = [self.of_unit(u) for p in gated for u in self.units(p)]
        sure = [j for notices, _ in units for _, j in notices if j["sure"]]
        names = {j["family"] for j in sure}
        names = {j["family"] for j in sure if not self.told(j["family"], j["pairs"], names)}
        out = []
        for notices, whole in units:
            if whole and self.told(l.UNKNOWN, whole["pairs"], names) and not any(j["sure"] for _, j in notices):
                continue
            out += [(n, j["family"]) for n, j in notices if not self.told(j["family"], j["pairs"], names)]
        return sorted(out)


def plain(text):
    return re.sub(r"(?i)^\s*(?:dnl|rem)\s", "", text)


def made(rng):
    """Wrapped headers, parts of them, single notices and prose, with and without empty lines between."""
    prose = [*l.PLAIN, "der Hund lief mit dem Ball davon", "see the file for details", "x = 1;"]
    parts = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.35:
            paragraph = rng.choice([p for ps in HEADERS.values() for p in ps])
            words = [w for w in paragraph.split() if rng.random() > rng.choice((0, 0, 0.1))]
            mark = rng.choice(("", "// ", "# ", " * ", "dnl "))
            parts += [mark + x for x in textwrap.wrap(" ".join(words) or "x", rng.choice((20, 40, 72)))]
        elif kind < 0.6:
            one = rng.choice([t for ts in (*T.values(), l.OTHERS) for t in ts])
            parts.append(one)
        else:
            parts.append(rng.choice(prose))
        parts += [""] * rng.randint(0, 2)
    return "\n".join(parts)


def test_random_texts_equal_the_plain_version(docs_of, model):
    rng, twin = random.Random(3), Plain(model)
    texts = [t for t in (made(rng) for _ in range(400)) if not re.search(l.LIST, t.replace("\n", " "))]
    assert len(texts) > 200
    found = {r.doc_id: r for r in l.scan(docs_of(enumerate(texts)), model=model).collect()}
    for k, text in enumerate(texts):
        assert sorted((n.line, n.family) for n in found[k].notices) == twin.scan(text), text
