"""Personal data in text, by boosted trees over candidates.

Four patterns count as personal data by themselves: e-mail addresses, IP addresses, payment cards
and international phone numbers. Beyond them, generators with high recall propose spans of many
forms, which may overlap. Gradient-boosted trees judge each from its form and the words around
it, and spans over the calibrated threshold of their kind are added.

The trees are trained on the driver, on ``TRAINING_ROWS`` labelled snippets that are made from a
seed, so a model is the same on every run; a third of them is kept for calibration and for the
thresholds. Judging is row by row and shuffles nothing.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import boosting
from pageloom.llm.common import ARROW_SPANS, SPANS, by_value

by_value(__name__)

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("address", "number", "account", "ip6")
KINDS = BASE_KINDS + ADDED_KINDS
TRAINING_ROWS = 6_000
PRECISION = 0.97
SEED = 7

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # may start at no later digit
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Generators of candidates: whole runs, however long. What is too long is for the trees to tell.
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)"
GENERATORS = {
    "address": re.compile(
        rf"(?<![\w.%+-])[\w.%+-]++\s?(?:@|\(at\)|\[at\]|\{{at\}})\s?[\w-]++(?:{_DOT}[\w-]++)*+", re.I
    ),
    "number": re.compile(r"(?<![\w.])\(?[0-9][0-9()\x20./-]{5,}(?<=[0-9])(?![\w])"),
    "account": re.compile(
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{6,}+|(?:\x20[A-Z0-9]{2,4}(?![A-Za-z0-9])){3,}+)(?![A-Za-z0-9])"
    ),
    "ip6": re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])"),
}
# Parts of a run of numbers that may stand for themselves.
PART_OF_NUMBERS = re.compile(r"\(?[0-9](?:[0-9().-]|[\x20/](?=[0-9(]))*+")
AT = re.compile(r"[@]|[(\[{]at[)\]}]", re.I)

CUES = {
    "call": r"tel|phone|call|mobile|cell|fax|reach|dial|contact|sms|whatsapp|teléfono|téléphone|telefon|handy",
    "mail": r"mail|contact|write|reach|correo|courriel|kontakt",
    "identity": r"ssn|social|passport|tax|nif|dni|national|licence|license|identity|insurance|birth",
    "bank": r"iban|account|bank|konto|compte|cuenta|transfer|card|payment",
    "network": r"\bip\b|ipv6|address|host|client|login|visitor",
    "other": r"isbn|issn|order|version|invoice|page|pages|serial|sku|item|total|price|date|year|model|ticket"
    r"|section|article|rfc|doi|build|tracking|range|score|ratio|time|at",
}
_CUES = {k: re.compile(v, re.I) for k, v in CUES.items()}
_AROUND = 32


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


def luhn(digits: str) -> bool:
    doubled = [d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2])]
    return (sum(doubled) + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Every match starts with the run of characters before its ``@``, as far as it is free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = list(emails(text))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def parts_of_numbers(text: str, start: int, stop: int) -> list[tuple[str, int, int]]:
    """Runs inside a run of numbers that more than one space or other mark sets apart."""
    inner = [m.span() for m in PART_OF_NUMBERS.finditer(text, start, stop)]
    inner = [(a, a + len(text[a:b].rstrip("().-"))) for a, b in inner]
    return [("number", a, b) for a, b in inner if b - a >= 7 and (a, b) != (start, stop)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the generators propose outside the base spans."""
    found = []
    digits = DIGIT.search(text) is not None
    for kind, pattern in GENERATORS.items():
        if (AT.search(text) if kind == "address" else digits):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    found += [s for c in found if c[0] == "number" for s in parts_of_numbers(text, *c[1:])]
    if not found or not base:
        return found
    taken = sorted((a, b) for _, a, b in base)
    reach = max(b - a for a, b in taken)

    def free(a: int, b: int) -> bool:
        near = taken[bisect_left(taken, (a - reach, 0)) : bisect_left(taken, (b, 0))]
        return not any(y > a for _, y in near)

    return [c for c in found if free(c[1], c[2])]


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    """The form of the span and the words around it."""
    span = text[start:stop]
    before, after = text[max(0, start - _AROUND) : start], text[stop : stop + _AROUND]
    digits = [c for c in span if c.isdigit()]
    groups = re.findall("[0-9]+", span)
    sizes = [len(g) for g in groups]
    marks = {c for c in span if not c.isalnum()}
    tail = re.split(r"\W+", span)[-1]
    dates = bool(re.fullmatch(r"(19|20)?[0-9]{2}[-/.][0-9]{1,2}[-/.]((19|20)[0-9]{2}|[0-9]{1,2})", span))
    return [
        *[float(kind == k) for k in ADDED_KINDS],
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(sizes, default=0)),
        float(min(sizes, default=0)),
        float(sizes[0] if sizes else 0),
        float(sizes[-1] if sizes else 0),
        float(len(marks)),
        *[float(c in marks) for c in "-. /():@"],
        float(span.startswith("(")),
        float(sum(c.isalpha() for c in span)),
        float(tail.isalpha() and 2 <= len(tail) <= 6),
        float(luhn("".join(groups)) if len(groups) and len(digits) > 1 else 0),
        float(dates),
        float(span.count(":")),
        float(any(c in "abcdefABCDEF" for c in span)),
        float(bool(re.search(r"[\w$€£#/:=]\s?$", before) and not before[-1:].isspace())),
        float(bool(re.match(r"\s?(%|€|\$|km|kg|mm|cm|ms|MB|GB|px|[:/=])", after))),
        *[float(bool(c.search(before))) for c in _CUES.values()],
        *[float(bool(c.search(after))) for c in _CUES.values()],
    ]


# Training


def snippets(rows: int, seed: int) -> Iterator[tuple[str, str, int, int, int]]:
    """Labelled spans ``(text, kind, start, stop, personal)`` in made-up sentences."""
    rng = random.Random(seed)
    names = "ana bo carla dmitri eve farid gil hana ivo jo kai lena marek nora otto pia".split()
    words = "the of and report was system when data value over again later la de une der und que".split()

    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def h(n: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def name() -> str:
        return rng.choice(names) + rng.choice(["", ".", "_"]) + rng.choice(names) + rng.choice(["", d(2)])

    def site() -> str:
        return rng.choice(["mail", "example", "inbox", "corp", "uni"]) + rng.choice(["", d(1)])

    def yes() -> tuple[str, str, str]:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", ".")])
        sep = rng.choice(["-", ".", " "])
        return rng.choice(
            [
                ("address", name() + at + site() + dot + rng.choice(["com", "org", "de"]),
                 rng.choice(["mail me: ", "contact ", "write to ", "e-mail ", ""])),
                ("number", f"({d(3)}) {d(3)}-{d(4)}", rng.choice(["call ", "phone: ", "tel. ", "fax ", ""])),
                ("number", sep.join([d(3), d(3), d(4)]), rng.choice(["call me at ", "mobile ", "tel ", "cell: "])),
                ("number", f"0{d(2)} {d(4)} {d(4)}", rng.choice(["phone ", "telefon ", "dial "])),
                ("number", f"{d(3)}-{d(2)}-{d(4)}", rng.choice(["ssn ", "social security ", "SSN: ", ""])),
                ("number", d(9), rng.choice(["passport no ", "tax id ", "ssn ", "national identity "])),
                ("account", rng.choice(["DE", "FR", "ES"]) + d(2) + " ".join(["", d(4), d(4), d(4), d(4), d(2)]),
                 rng.choice(["IBAN ", "account ", "transfer to ", ""])),
                ("account", rng.choice(["DE", "GB", "NL"]) + d(2) + d(18), rng.choice(["iban: ", "bank ", ""])),
                ("ip6", ":".join(h(4) for _ in range(8)), rng.choice(["ip ", "client ", "from host ", ""])),
                ("ip6", f"2001:db8:{h(4)}::{h(4)}", rng.choice(["ipv6 ", "visitor ", ""])),
            ]
        )

    def no() -> tuple[str, str, str]:
        year = str(rng.randint(1900, 2050))
        return rng.choice(
            [
                ("address", rng.choice(["foo", "see", "x", name()]) + "@" + rng.choice(["v1", "home", "param", "3"]),
                 rng.choice(["decorator ", "package ", "", "meet "])),
                ("address", rng.choice(words) + " @ " + rng.choice(words), ""),
                ("number", f"{year}-{d(2)}-{d(2)}", rng.choice(["on ", "date ", "since ", ""])),
                ("number", f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/{year}", rng.choice(["date: ", "", "until "])),
                ("number", f"{year}-{rng.randint(1900, 2050)}", rng.choice(["", "years ", "from "])),
                ("number", d(rng.randint(7, 20)), rng.choice(["order ", "serial ", "item no ", "total ", "", "", ""])),
                ("number", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", rng.choice(["ISBN ", "isbn: "])),
                ("number", ".".join([d(1), d(2), d(rng.randint(3, 5))]), rng.choice(["version ", "build ", "section "])),
                ("number", " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 9))), rng.choice(["", "score ", "values "])),
                ("number", f"{d(4)}-{d(4)}-{d(4)}", rng.choice(["ticket ", "tracking ", "model ", ""])),
                ("number", f"{d(3)} - {d(3)}", rng.choice(["pages ", "range "])),
                ("number", f"{d(3)} {d(3)} {d(3)}", rng.choice(["total ", "price ", ""])),
                ("number", d(16), rng.choice(["", "", "id ", "the "])),
                ("account", rng.choice(["AB", "QX", "ZZ"]) + d(2) + " " + " ".join(rng.choice(["ABC", "NEW", d(2)]) for _ in range(3)),
                 rng.choice(["model ", "sku ", ""])),
                ("ip6", ":".join(d(2) for _ in range(3)), rng.choice(["time ", "at ", ""])),
                ("ip6", f"{d(1)}:{d(2)}:{d(2)}", rng.choice(["time ", "ratio ", ""])),
                ("ip6", "::" + rng.choice(["", h(2)]), rng.choice(["std", "slice ", ""])),
            ]
        )

    for _ in range(rows):
        personal = rng.random() < 0.5
        kind, span, cue = yes() if personal else no()
        lead = " ".join(rng.choice(words) for _ in range(rng.randint(2, 8))) + " "
        if rng.random() < 0.15:
            cue = ""
        end = " " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        text = lead + cue + span + rng.choice(["", ".", ","]) + end
        at = len(lead + cue)
        yield text, kind, at, at + len(span), int(personal)


def train(rows: int = TRAINING_ROWS, seed: int = SEED, precision: float = PRECISION) -> Model:
    """Trees on two thirds of the snippets; calibration and, for each kind, the lowest threshold
    that keeps ``precision`` on the rest."""
    made = list(snippets(rows, seed))
    x = np.array([features(*s[:4]) for s in made])
    y = np.array([s[4] for s in made])
    kinds = np.array([s[1] for s in made])
    split = 2 * rows // 3
    trees = boosting.calibrate(boosting.fit(x[:split], y[:split]), x[split:], y[split:])
    p = trees.probability(x[split:])
    thresholds = {}
    for kind in ADDED_KINDS:
        of_kind = kinds[split:] == kind
        order = np.argsort(-p[of_kind])
        right = np.cumsum(y[split:][of_kind][order])
        enough = np.flatnonzero(right >= precision * np.arange(1, len(order) + 1))
        lowest = p[of_kind][order][enough[-1]] if len(enough) else 1.0
        thresholds[kind] = max(0.5, float(lowest))
    return Model(trees, thresholds)


# Judging


def _finder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, spans[i])]
            for at in range(0, len(proposed), 10_000):
                part = proposed[at : at + 10_000]
                x = np.array([features(texts[i], *c) for i, *c in part])
                for (i, *c), p in zip(part, model.trees.probability(x)):
                    if p >= model.thresholds[c[0]]:
                        spans[i].append(tuple(c))
            rows = [
                [
                    dict(zip(("kind", "start", "stop"), s))
                    for s in sorted(set(found), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                ]
                for found in spans
            ]
            columns = [batch.column(0), pa.array(rows, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "spans"])

    return run


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None
) -> DataFrame:
    """``(key, spans)`` for each row of ``docs``: the spans as an array of ``(kind, start, stop)``,
    by kind in the order of ``KINDS`` and then by start.

    Places are code points from 0, ``stop`` is exclusive. A null text is an empty one and has no
    spans. Rows are judged one by one: repeated rows and null keys come out as they are put in, an
    empty table gives an empty result, and other columns are left out.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("spans", SPANS)])
    found = narrow.mapInArrow(_finder(model or train()), schema)
    return found.withColumnRenamed("key", key)
