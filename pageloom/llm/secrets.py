"""Secrets in text, with linking of credentials that come in several parts.

Three patterns are secrets on their own: assignments to a telling name, access key ids, and long
hexadecimal runs. Other traces are weak: a name, a random-looking token or an address proves
nothing alone. They are candidates for one part of a credential - an identifier, a secret or an
endpoint - and an interval join within each scope reports them only where complementary parts
co-occur. A scope is a block of text without an empty line; parts of a credential lie within
``reach`` code points of each other.

All parts of a credential lie in one row, so the join is a sorted sweep inside the row and the
operator shuffles nothing.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import ARROW_SPANS, SPANS, apart, by_value

by_value(__name__)

BASE_KINDS = ("assign", "access", "hex")
PART_KINDS = ("identifier", "secret", "endpoint")
KINDS = BASE_KINDS + PART_KINDS
REACH = 200

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run is dropped, and none overlaps another
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

_NAMED = r"""["']?[\x20\t]*[:=][\x20\t]*["']?"""
IDENTIFIER = re.compile(
    r"(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|app_?id|user(?:_?name)?|login)"
    + _NAMED
    + r"([A-Za-z0-9._@+-]{3,})",
    re.I | re.A,
)
TEMPORARY_ID = re.compile(r"(?<![A-Z0-9])A[SG]IA[A-Z0-9]{16}(?![A-Z0-9])")
NAMED_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase)?|pwd|secret(?:_?access)?(?:_?key)?|token|api_?key|auth|credentials?"
    r"|private_?key|(?<!access_)key)" + _NAMED + r"([^\s\"',;]{3,})",
    re.I | re.A,
)
# A longer name with one of these is that of a secret, as in secret_access_key.
SECRET_NAME = re.compile(r"(?:secret|pass|pwd|token|private)[A-Za-z0-9_-]*$", re.I | re.A)
RANDOM_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{3,}"
    r"|(?<![A-Za-z0-9])(?:host|endpoint|server|url|region)" + _NAMED + r"[A-Za-z0-9._:/-]{3,}",
    re.I | re.A,
)
LOGIN_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@\"'<>]+):([^\s/@\"'<>]+)@([^\s/\"'<>]+)")
# Where one ends a token may begin; a comma, a bar or a bracket ends one too.
URL = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>,;|(){}\[\]]+", re.I | re.A)
# Every identifier holds one of these in lower case.
CUES = ("key", "id", "user", "login", "account", "asia", "agia", "://")


class Part(NamedTuple):
    kind: str
    start: int
    stop: int
    weak: bool


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [
            ("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12
        ]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def looks_random(token: str) -> bool:
    """Mixed classes of characters and at least 3.5 bits a character."""
    if not (re.search("[0-9]", token) and re.search("[A-Z]", token) and re.search("[a-z]", token)):
        return False
    counts, n = Counter(token), len(token)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) >= 3.5


def parts(text: str, base: list[tuple[str, int, int]]) -> list[Part]:
    """Candidates for parts of a credential; base spans are strong ones."""
    found = [
        Part("identifier" if kind == "access" else "secret", a, b, False) for kind, a, b in base
    ]
    lower = text.lower()
    if not base and not any(cue in lower for cue in CUES):
        return found
    taken = sorted((a, b) for _, a, b in base)

    ends = list(accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        """Whether no base span holds all of it; one that holds a part may leave the rest."""
        k = bisect_left(taken, (a + 1, 0))
        return not k or ends[k - 1] < b

    found += [
        Part("identifier", *m.span(1), True)
        for m in IDENTIFIER.finditer(text)
        if not SECRET_NAME.search(text, max(m.start() - 40, 0), m.start())
    ]
    found += [Part("identifier", *m.span(), True) for m in TEMPORARY_ID.finditer(text)]
    if not any(p.kind == "identifier" for p in found) and "://" not in text:
        return found
    for m in LOGIN_URL.finditer(text):
        found += [Part(k, *m.span(g), True) for g, k in ((1, "identifier"), (2, "secret"))]
    found += [Part("secret", *m.span(1), True) for m in NAMED_SECRET.finditer(text)]
    urls = [m.span() for m in URL.finditer(text)]

    def heads_url(a: int, b: int) -> bool:
        """Whether a token is the host or the first of the path of a URL that it lies in."""
        k = bisect_left(urls, (a, 0)) - 1
        return k >= 0 and b <= urls[k][1] and "://" in text[max(urls[k][0], a - 40) : a]

    found += [
        Part("secret", *m.span(), True)
        for m in RANDOM_TOKEN.finditer(text)
        if not heads_url(*m.span()) and looks_random(m.group())
    ]
    found += [Part("endpoint", *m.span(), True) for m in ENDPOINT.finditer(text)]
    return [p for p in found if not p.weak or p.kind == "endpoint" or free(p.start, p.stop)]


def linked(text: str, found: list[Part], reach: int) -> set[tuple[str, int, int]]:
    """The weak parts that complementary parts in their scope confirm.

    An identifier and a secret confirm each other if one of them is strong or an endpoint lies
    near either; every endpoint near either is confirmed by such a pair.
    """
    if not any(p.weak for p in found):
        return set()
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    scope = {p: bisect_left(breaks, p.start) for p in found}
    by_kind = {k: sorted((p for p in set(found) if p.kind == k), key=lambda p: p.start) for k in PART_KINDS}
    # how far the parts up to each one reach
    stops = {k: list(accumulate((p.stop for p in ps), max)) for k, ps in by_kind.items()}

    def near(part: Part, kind: str) -> Iterator[Part]:
        for k in range(bisect_left(stops[kind], part.start - reach), len(stops[kind])):
            other = by_kind[kind][k]
            if other.start > part.stop + reach:
                break
            overlaps = other.start < part.stop and part.start < other.stop
            inside = kind == "endpoint" or part.kind == "endpoint"
            if other.stop >= part.start - reach and scope[other] == scope[part]:
                if inside or not overlaps:
                    yield other

    pairs: set[Part] = set()
    served = {p: any(True for _ in near(p, "endpoint")) for k in PART_KINDS[:2] for p in by_kind[k]}
    for one in by_kind["identifier"]:
        for two in near(one, "secret"):
            if not (one.weak and two.weak) or served[one] or served[two]:
                pairs |= {one, two}
    ends = {e for p in pairs for e in near(p, "endpoint")}
    return {p[:3] for p in pairs | ends if p.weak}


def find(text: str | None, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans, by start and then kind."""
    text = text or ""
    base = base_spans(text)
    spans = {*base, *linked(text, parts(text, base), reach)}
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _finder(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("kind", "start", "stop"), s)) for s in find(t.as_py(), reach)]
                for t in batch.column(batch.num_columns - 1)
            ]
            columns = [*batch.columns[:-1], pa.array(rows, ARROW_SPANS)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "spans"])

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``(key, spans)`` for each row of ``docs``: the spans as an array of ``(kind, start, stop)``.

    Places are code points from 0, ``stop`` is exclusive. A null text is an empty one and has no
    spans. Rows are judged one by one: repeated rows and null keys come out as they are put in, an
    empty table gives an empty result, and other columns are left out.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["key"], T.StructField("spans", SPANS)])
    return narrow.mapInArrow(_finder(reach), schema).withColumnRenamed("key", key)


def _redacted(mark: str, reach: int):
    def change(text: str | None) -> str | None:
        spans = find(text, reach)
        if not spans:
            return text
        pieces, at = [], 0
        for _, start, stop in spans:
            if start >= at:
                pieces += [text[at:start], mark]
            at = max(at, stop)
        return "".join([*pieces, text[at:]])

    return lambda texts: texts.map(change, na_action="ignore")


def redact(
    docs: DataFrame,
    text: str = "text",
    length: str | None = "n_chars",
    mark: str = "[secret]",
    reach: int = REACH,
) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one.

    No row goes. ``length``, where there is such a column, is brought up to date in rows whose
    text changed.
    """
    new = f"{apart(docs, ())}text"
    changed = docs.withColumn(new, F.pandas_udf(_redacted(mark, reach), T.StringType())(F.col(text)))
    columns: list[Column] = []
    for name in docs.columns:
        if name == text:
            columns.append(F.col(new).alias(name))
        elif name == length:
            kind = docs.schema[name].dataType
            same = F.col(new).eqNullSafe(F.col(text))
            columns.append(
                F.when(same, F.col(name)).otherwise(F.length(new).cast(kind)).alias(name)
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return changed.select(*columns)
