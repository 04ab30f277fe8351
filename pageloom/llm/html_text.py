"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline elements only lend their text to the block
they are in. What is no article by its element or its name goes first. Every node that is left gets
its characters for each tag, adjusted for the share of them inside links, and the sum of its
children's densities. The node with the largest sum is the centre of the article; the least
density on its path to the body is the threshold, and below every node that reaches it the node
with the largest sum belongs to the article too.

One pass over the rows, page by page; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import by_value

by_value(__name__)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes svg xmp".split())
DROPPED = frozenset(
    "head title nav footer aside form dialog menu search fieldset button select datalist".split()
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
WHOLE = frozenset(["article", "main"])
# Parts of the tree though no blocks; a label only inside a form.
CONTROLS = frozenset("button select datalist label".split())
IN_HEAD = frozenset(
    "head title base basefont bgsound link meta noframes noscript script style template html".split()
)
# An open element of these is closed by the start of one of those.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"),
    "body": ("head",),
}
SCOPES = frozenset("table ul ol dl td th body html article section div".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations "
    "comment comments disqus respond replies widget toolbar pagination pager copyright".split()
)
# Those that say what an element is whatever its size, unless the name has a word like "no" or "open" too.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsored comment comments disqus respond "
    "replies notice notification alert cookie cookies consent gdpr".split()
)
COMMENTS = frozenset("comment comments disqus respond replies".split())
SWITCHES = frozenset(
    "has with no without show hide open opened closed enabled disabled allow allowed free on off".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(
    r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/\"']|$)",
    re.I,
)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Page:
    """The tree: parallel lists over nodes, and texts as ``(node, text, in a link)``."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.links = ["html"], [-1], [0]
        self.hinted, self.sure = [False], [False]
        self.hidden, self.comment = [False], [False]
        self.n_open: Counter[str] = Counter()  # open elements by name
        self.in_head = False
        self.implied: int | None = None  # the body that the page left out
        self.texts: list[tuple[int, str, bool]] = []
        self.open = [0]
        self.in_link = False
        self.read(source)

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                self.text(source[at:])
                return
            if mark > at:
                self.text(source[at:mark])
            if source.startswith("<!--", mark):
                stop = source.find("-->", mark + 4)
                at = end if stop < 0 else stop + 3
                continue
            following = source[mark + 1 : mark + 3]
            if following[:1] in ("!", "?"):
                stop = source.find(">", mark)
                at = end if stop < 0 else stop + 1
                continue
            if not (following.lstrip("/")[:1].isalpha() and following.lstrip("/")[:1].isascii()):
                self.text("<")
                at = mark + 1
                continue
            tag = _TAG.match(source, mark) or _LOOSE.match(source, mark)
            if tag is None:  # the page ends inside a tag
                return
            at, name = tag.end(), tag.group(2).lower()
            if tag.group(1):
                self.end(name)
                continue
            self.start(name, tag.group(3))
            if name in RAW and not tag.group(3).endswith("/"):
                stop = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(source, at)
                at = stop.start() if stop else end

    def leave_head(self) -> None:
        """Close an open head and open the body, whose tags a page may leave out."""
        self.in_head = False
        heads = [k for k, node in enumerate(self.open) if self.tag[node] == "head"]
        if heads:
            self.leave(heads[0])
            if self.open == [0] and "body" not in self.tag:
                self.implied = len(self.tag)
                self.start("body", "")

    def text(self, text: str) -> None:
        if self.in_head and self.tag[self.open[-1]] == "head" and not text.isspace():
            self.leave_head()
        self.texts.append((self.open[-1], html.unescape(text) if "&" in text else text, self.in_link))

    def close(self, names: tuple[str, ...]) -> None:
        """Close the nearest open element of ``names`` in reach, with all inside it."""
        if not any(self.n_open[n] for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in names:
                self.leave(k)
                self.in_link = False
                return
            if tag in SCOPES:
                return

    def leave(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        for node in self.open[depth:]:
            self.n_open[self.tag[node]] -= 1
        del self.open[depth:]

    def enter(self) -> None:
        self.open.append(len(self.tag) - 1)
        self.n_open[self.tag[-1]] += 1

    def start(self, name: str, attributes: str) -> None:
        if self.in_head and name not in IN_HEAD and name != "body":
            self.leave_head()
        if name in CONTROLS and (name != "label" or self.n_open["form"]):
            self.add(name)
            self.enter()
            return
        if name not in BLOCKS and name not in VOID and name not in RAW:
            hidden = bool(attributes) and concealed(attributes)
            if hidden or self.n_open[name]:  # one inside a hidden one of its name has an end of its own
                self.add(name, hidden=hidden)
                self.enter()
        if name == "a":
            self.in_link = True
            self.links[self.open[-1]] += 1
        elif name == "br":
            self.text(" ")
        if name not in BLOCKS or name == "html":
            return
        if name == "body":
            self.leave(1)
            self.in_head = False
            if self.implied is not None and self.implied < len(self.tag):
                self.open.append(self.implied)
                self.n_open["body"] += 1
                return
        self.in_head |= name == "head"
        self.close(("p",))
        if name in CLOSES:
            self.close(CLOSES[name])
        if name in HEADINGS:
            self.close(HEADINGS)
        self.add(name, *(unwanted(name, attributes) if attributes else ()))
        if name not in VOID:
            self.enter()
            self.in_link = False

    def add(
        self, name: str, hinted: bool = False, sure: bool = False, comment: bool = False, hidden: bool = False
    ) -> None:
        self.tag.append(name)
        self.parent.append(self.open[-1])
        self.links.append(0)
        self.hinted.append(hinted)
        self.sure.append(sure)
        self.comment.append(comment)
        self.hidden.append(hidden)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        if not self.n_open[name]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == name:
                self.leave(k)
                self.in_link &= name not in BLOCKS
                self.in_head &= name != "head"
                return


def concealed(attributes: str) -> bool:
    """Whether an element is not shown."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "")
        if name == "hidden" or name == "style" and re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I):
            return True
    return False


def unwanted(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role say that an element is no part of an article, whether that holds
    whatever its size, and whether it is for comments. Of an article only its name as a comment counts."""
    if tag in ("body", "main"):
        return False, False, False
    found = sure = comment = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            found = True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found = True
        elif name == "role" and ROLES.intersection(value.lower().split()):
            found = True
        elif name in ("class", "id"):
            for word in value.split():
                said = {part.lower() for part in _NAME_PARTS.findall(word)}
                found |= not said.isdisjoint(NAMES)
                if not said.isdisjoint(SURE) and said.isdisjoint(SWITCHES):
                    sure = True
                    comment |= not said.isdisjoint(COMMENTS)
    if tag == "article":
        return comment, comment, comment
    return found or sure, sure, comment


def _whole(page: Page) -> list[bool]:
    """Articles and the like that are taken whole: none for comments, and none beside the text, as in
    an aside, where there are others."""
    n = len(page.tag)
    heads = [t in ("main", "h1") for t in page.tag]
    for k in range(n - 1, 0, -1):
        heads[page.parent[k]] |= heads[k]
    beside, comment = [False] * n, [False] * n
    for k in range(1, n):
        up, named = page.parent[k], page.tag[k] in DROPPED and page.tag[k] not in ("form", "fieldset")
        # What holds the page's heading is no list of comments, whatever its name.
        comment[k] = comment[up] or (page.comment[k] and (not heads[k] or page.tag[k] == "article"))
        beside[k] = beside[up] or comment[k] or named or (page.sure[k] and not heads[k])
    first = [t in WHOLE and not b for t, b in zip(page.tag, beside)]
    return first if any(first) else [t in WHOLE and not c for t, c in zip(page.tag, comment)]


def _removed(page: Page, chars: list[int]) -> list[bool]:
    """What goes before densities are computed, by element or by name.

    A header goes unless it belongs to an article. A name alone is not enough against an element
    that holds an article, or more than half of the page's text; one that says comments, notice or
    advert is enough against the latter, if any text is left then. Of a form with more than half
    of the page's text outside controls only the controls go.
    """
    gone = _without(page, chars, True)
    if any(page.sure) and not any(t.strip() for node, t, _ in page.texts if not gone[node]):
        return _without(page, chars, False)
    return gone


def _large_forms(page: Page) -> list[bool]:
    """Forms, and their fieldsets, with more than half of the page's text outside controls."""
    n = len(page.tag)
    if "form" not in page.tag and "fieldset" not in page.tag:
        return [False] * n
    control, below = [False] * n, [0] * n
    for k in range(1, n):
        control[k] = control[page.parent[k]] or page.tag[k] in CONTROLS or page.tag[k] in ("head", "title")
    for node, text, _ in page.texts:
        if not control[node]:
            below[node] += len("".join(text.split()))
    for k in range(n - 1, 0, -1):
        below[page.parent[k]] += below[k]
    return [t in ("form", "fieldset") and 2 * b > below[0] for t, b in zip(page.tag, below)]


def _without(page: Page, chars: list[int], names_suffice: bool) -> list[bool]:
    n = len(page.tag)
    holds, inside, below, whole = [False] * n, [False] * n, list(chars), _whole(page)
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] |= holds[k] or whole[k]
        below[page.parent[k]] += below[k]
    body = next((k for k in range(n) if page.tag[k] == "body"), 0)
    large = _large_forms(page)
    gone = [False] * n
    for k in range(1, n):
        up, tag = page.parent[k], page.tag[k]
        inside[k] = inside[up] or whole[up]
        sure = names_suffice and page.sure[k]
        named = page.hinted[k] and not holds[k] and (sure or 2 * below[k] <= below[body])
        if named and inside[k] and tag == "header":
            named = False
        gone[k] = (
            gone[up]
            or (tag in DROPPED and not holds[k] and not large[k])
            or tag in CONTROLS
            or page.hidden[k]
            or (tag == "header" and not inside[k] and not holds[k])
            or named
        )
    return gone


def _densities(page: Page, gone: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density of each node, and the sum over its children and its own text."""
    n = len(page.tag)
    chars, linked, own = [0] * n, [0] * n, [0] * n
    for node, text, in_link in page.texts:
        if not gone[node]:
            size = len("".join(text.split()))
            chars[node] += size
            own[node] += size
            linked[node] += size if in_link else 0
    links = [0 if gone[k] else page.links[k] for k in range(n)]
    tags = list(links)
    for k in range(n - 1, 0, -1):
        if not gone[k]:
            up = page.parent[k]
            chars[up] += chars[k]
            linked[up] += linked[k]
            links[up] += links[k]
            tags[up] += tags[k] + 1
    share = linked[0] / chars[0] if chars[0] else 0.0

    def density(c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / math.log(base + 1)

    each = [density(chars[k], linked[k], tags[k], links[k]) for k in range(n)]
    sums = [density(own[k], 0, 1, 0) if own[k] else 0.0 for k in range(n)]
    for k in range(n - 1, 0, -1):
        if not gone[k]:
            sums[page.parent[k]] += each[k]
    return each, sums


def _article(page: Page, gone: list[bool]) -> list[bool]:
    """The nodes that belong to the article."""
    n = len(page.tag)
    each, sums = _densities(page, gone)
    best = list(range(n))  # the node with the largest sum in each subtree, the outermost of equals
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        if not gone[k] and sums[best[k]] > sums[best[up]]:
            best[up] = best[k]
    centre = node = best[0]
    threshold = each[centre]
    while node > 0:
        node = page.parent[node]
        if page.tag[node] != "html":
            threshold = min(threshold, each[node])
    chosen = [False] * n
    for k in range(n):
        if not gone[k] and each[k] >= threshold and each[k] > 0:
            chosen[best[k]] = True
    # A heading opens what follows it: all its siblings up to the last chosen one.
    last: dict[int, int] = {}
    for k in range(1, n):
        if chosen[k]:
            last[page.parent[k]] = k
    opened: set[int] = set()
    for k in range(1, n):
        up = page.parent[k]
        if page.tag[k] in HEADINGS and not gone[k]:
            opened.add(up)
        if up in opened and k < last.get(up, 0) and not gone[k]:
            chosen[k] = True
    around = [0] * n  # the nearest article
    for k in range(1, n):
        around[k] = k if page.tag[k] in WHOLE else around[page.parent[k]]
    for k in range(n):
        if chosen[k] and around[k]:  # an article is whole
            chosen[around[k]] = True
    kept = [False] * n
    for k in range(n):
        kept[k] = not gone[k] and (chosen[k] or (k > 0 and kept[page.parent[k]]))
    return kept


def main_text(source: str | None) -> str:
    """Blocks of the article in page order, white space in each turned into single spaces."""
    if not source:
        return ""
    page = Page(source)
    chars = [0] * len(page.tag)
    for node, text, _ in page.texts:
        chars[node] += len(text)
    kept = _article(page, _removed(page, chars))
    cells = ("td", "th", "thead", "tbody", "tfoot", "caption")
    blocks: list[list[str]] = []
    last = None
    for node, text, _ in page.texts:
        if not kept[node]:
            continue
        row = node
        while page.tag[row] in cells and page.parent[row] > 0 and page.tag[row] in ("td", "th"):
            row = page.parent[row]
        if row != last:
            blocks.append([])
            last = row
        elif blocks and node != row:
            blocks[-1].append(" ")
        blocks[-1].append(text)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        source = batch.column(batch.num_columns - 1)
        texts = pa.array([main_text(s.as_py()) for s in source], pa.string())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"]
        )


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """``(key, url, text)`` for each row of ``pages``.

    A null or empty page, and one without any text outside what is removed, has an empty text.
    Repeated rows, null keys and null urls come out as they are put in, an empty table gives an
    empty result, and other columns are left out.
    """
    narrow = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html")
    )
    fields = [narrow.schema["key"], narrow.schema["url"], T.StructField("text", T.StringType())]
    found = narrow.mapInArrow(_extract, T.StructType(fields))
    return found.withColumnsRenamed({"key": key, "url": url})
