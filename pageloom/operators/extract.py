"""Pages to content records and links.

Python reads each page once and returns its nodes in document order as an array column; an
element covers the nodes from ``pos`` up to ``stop``. Selecting, cleaning and assembling are
Column expressions over that array, so selectors are plain arguments and Catalyst sees them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom import config
from pageloom.functions import text as tx
from pageloom.functions import urls as ux
from pageloom.functions.chars import SPACE_LIST
from pageloom.functions.workers import node_batches

NODE_TYPE = (
    "struct<pos:int,stop:int,tag:string,attrs:map<string,string>,classes:array<string>,"
    "link:string,text:string,hidden:boolean,apart:boolean,first:int,last:int>"
)
def page_nodes(
    pages: DataFrame,
    keep: Sequence[str] = ("url",),
    removed_tags: Sequence[str] = config.REMOVED_TAGS,
    removed_classes: Sequence[str] = config.REMOVED_CLASSES,
) -> DataFrame:
    """The ``keep`` columns of each page with ``nodes``, one row a page.

    Elements to remove are marked ``hidden`` with all they hold. A class is removed if any listed
    name occurs in it, in any case and at any place.
    """
    kept = list(keep)
    narrow = pages.select(*kept, F.col("url").alias("_url"), "html")
    types = dict(narrow.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", nodes array<{NODE_TYPE}>"
    return narrow.mapInArrow(node_batches(kept, removed_tags, removed_classes), schema)


# The expressions below are SQL text: they run to hundreds of nodes, which the parser in the JVM
# builds far faster than one call from Python for each.
_SIMPLE = re.compile(
    r"""^(?:(?P<tag>[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
        |\[(?P<attr>[\w-]+)(?:="(?P<value>[^"]*)")?\])$""",
    re.X,
)


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _attr(node: str, name: str) -> str:
    return f"try_element_at({node}.attrs, {_quote(name)})"


def _test(selector: str, node: str) -> str:
    """Condition for one tag, class, id or attribute selector; never null."""
    found = _SIMPLE.match(selector)
    if not found:
        raise ValueError(f"unsupported selector: {selector}")
    if found["tag"]:
        rule = f"{node}.tag = {_quote(found['tag'].lower())}"
    elif found["cls"]:
        rule = f"array_contains({node}.classes, {_quote(found['cls'])})"
    elif found["id"]:
        rule = f"{_attr(node, 'id')} = {_quote(found['id'])}"
    elif found["value"] is None:
        rule = f"{_attr(node, found['attr'])} is not null"
    elif found["attr"] == "class":
        rule = f"array_join({node}.classes, ' ') = {_quote(found['value'])}"
    elif found["attr"] == "rel":  # a list of words, compared with single spaces
        words = f"filter(split({_attr(node, 'rel')}, '[ \\\\s]+'), w -> w <> '')"
        rule = f"array_join({words}, ' ') = {_quote(found['value'])}"
    else:
        rule = f"{_attr(node, found['attr'])} = {_quote(found['value'])}"
    return f"coalesce({rule}, false)"


def select_nodes(selector: str, elements: str = "elements") -> str:
    """Elements matching a simple selector, or two joined by a descendant space."""
    parts = selector.split()
    if len(parts) > 2:
        raise ValueError(f"unsupported selector: {selector}")
    matched = f"filter({elements}, n -> {_test(parts[-1], 'n')})"
    if len(parts) == 1:
        return matched
    inside = f"filter({matched}, n -> exists(outer, o -> o.pos < n.pos and n.pos < o.stop))"
    return _let("outer", f"filter({elements}, n -> {_test(parts[0], 'n')})", inside)


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and name it in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _first(selector: str, body: str) -> str:
    """``body`` of the first match ``e``; null if nothing matches."""
    return _let(
        "e", f"get({select_nodes(selector)}, 0)", f"case when e is not null then {body} end"
    )


def _filled(value: str) -> str:
    """The text, or null if it is empty."""
    return _let("v", value, "case when v <> '' then v end")


def node_text(element: str, separator: str = "") -> str:
    """Text inside ``element``: each text node trimmed, empty ones dropped.

    Texts are in document order, so those inside an element are a slice.
    """
    own = f"slice(texts, {element}.first + 1, {element}.last - {element}.first)"
    inside = f"filter({own}, t -> not t.apart or {element}.apart)"
    return f"array_join(transform({inside}, t -> t.text), {_quote(separator)})"


def _coalesce(*values: str) -> Column:
    return F.expr("coalesce(" + ", ".join(values) + ")")


def visible_nodes(nodes: DataFrame, keep: Sequence[str] = ("url",)) -> DataFrame:
    """What cleaning leaves of each page, as ``elements`` and ``texts`` in document order."""
    return nodes.select(
        *keep,
        F.expr("filter(nodes, n -> n.tag is not null and not n.hidden)").alias("elements"),
        F.expr(
            "transform(filter(nodes, n -> n.text is not null and not n.hidden),"
            " n -> struct(n.text, n.apart))"
        ).alias("texts"),
    )


def _first_text(selectors: Sequence[str], separator: str) -> list[str]:
    return [_first(s, _filled(node_text("e", separator))) for s in selectors]


def first_text_over(selector: str, size: int, separator: str = "") -> str:
    """Text of the first match if longer than ``size``, else null."""
    long = f"case when length(v) > {int(size)} then v end"
    return _first(selector, _let("v", node_text("e", separator), long))


def main_content(
    selectors: Sequence[str] = config.CONTENT_SELECTORS, separator: str = ""
) -> Column:
    """First element of a content selector with over 200 characters; else all paragraphs over 50,
    joined by spaces; else a body over 200; else null."""

    def long_text(selector: str) -> str:
        return first_text_over(selector, 200, separator)

    paragraphs = f"transform({select_nodes('p')}, p -> {node_text('p', separator)})"
    return _coalesce(
        *[long_text(s) for s in selectors],
        _filled(f"array_join(filter({paragraphs}, t -> length(t) > 50), ' ')"),
        long_text("body"),
    )


def page_title(
    selectors: Sequence[str] = config.TITLE_SELECTORS, separator: str = ""
) -> Column:
    return _coalesce(
        *_first_text(selectors, separator), _first("title", node_text("e", separator))
    )


def page_description() -> Column:
    def content(attr: str, value: str) -> str:
        rule = f"n.tag = 'meta' and {_attr('n', attr)} = {_quote(value)}"
        meta = f"get(filter(elements, n -> coalesce({rule}, false)), 0)"
        trimmed = f"trim(both {_quote(SPACE_LIST)} from v)"
        return _let("v", _attr(meta, "content"), f"case when v <> '' then {trimmed} end")

    return _coalesce(content("name", "description"), content("property", "og:description"))


def page_author(
    selectors: Sequence[str] = config.AUTHOR_SELECTORS, separator: str = ""
) -> Column:
    return _coalesce(*_first_text(selectors, separator))


def page_date_text(
    selectors: Sequence[str] = config.DATE_SELECTORS, separator: str = ""
) -> Column:
    """Raw date: ``datetime``, then ``content``, then the text of the first match that has any."""
    values = ", ".join(
        _filled(v)
        for v in (_attr("e", "datetime"), _attr("e", "content"), node_text("e", separator))
    )
    return _coalesce(*[_first(s, f"coalesce({values})") for s in selectors])


def page_tags(
    selectors: Sequence[str] = config.TAG_SELECTORS, limit: int = 10, separator: str = ""
) -> Column:
    """Texts of all matches, distinct in order of the selectors, at most ``limit``."""
    texts = ", ".join(
        f"transform({select_nodes(s)}, e -> {node_text('e', separator)})" for s in selectors
    )
    return F.expr(
        f"slice(array_distinct(filter(concat({texts}), t -> t <> '')), 1, {int(limit)})"
    )


def page_links(from_cleaned: bool = True) -> Column:
    """Target of every link, resolved, from what cleaning leaves or from the whole page."""
    rule = "n.link is not null" + (" and not n.hidden" if from_cleaned else "")
    return F.expr(f"transform(filter(nodes, n -> {rule}), n -> n.link)")


def content_records(
    nodes: DataFrame,
    extracted_at: Column | None = None,
    keep: Sequence[str] = ("url",),
    separator: str = "",
    content_selectors: Sequence[str] = config.CONTENT_SELECTORS,
    title_selectors: Sequence[str] = config.TITLE_SELECTORS,
    author_selectors: Sequence[str] = config.AUTHOR_SELECTORS,
    date_selectors: Sequence[str] = config.DATE_SELECTORS,
    tag_selectors: Sequence[str] = config.TAG_SELECTORS,
) -> DataFrame:
    """Content records of the pages in ``nodes``; pages without main text are dropped."""
    # Generating the text drops pages without one and evaluates it once, where a filter on it
    # would be pushed below and evaluate it again.
    texts = F.filter(
        F.array(main_content(content_selectors, separator)), lambda t: t.isNotNull()
    )
    found = visible_nodes(nodes, keep).select(
        *keep, "elements", "texts", F.explode(texts).alias("content")
    ).select(
        *keep,
        page_title(title_selectors, separator).alias("title"),
        page_description().alias("description"),
        "content",
        page_author(author_selectors, separator).alias("author"),
        page_date_text(date_selectors, separator).alias("date_text"),
        page_tags(tag_selectors, separator=separator).alias("tags"),
    )
    content = F.col("content")
    return found.select(
        *keep,
        "title",
        "description",
        "content",
        "author",
        tx.parse_date(F.col("date_text")).alias("publish_date"),
        "tags",
        tx.word_count(content).alias("word_count"),
        tx.reading_time(tx.word_count(content)).alias("reading_time"),
        tx.flesch_reading_ease(content).alias("readability_score"),
        (F.current_timestamp() if extracted_at is None else extracted_at).alias("extracted_at"),
        tx.content_hash(content).alias("content_hash"),
    )


def extract_pages(
    pages: DataFrame, extracted_at: Column | None = None, keep: Sequence[str] = ("url",), **selectors
) -> DataFrame:
    """Content records of fetched pages."""
    return content_records(page_nodes(pages, keep), extracted_at, keep, **selectors)


def useful(
    content: DataFrame, min_length: int = config.DEFAULTS.min_content_length
) -> DataFrame:
    """Records worth saving: enough text."""
    return content.where(F.length("content") >= min_length)


def links(
    nodes: DataFrame,
    from_cleaned: bool = True,
    patterns: Sequence[str] | None = config.USEFUL_URL_PATTERNS,
    extensions: Sequence[str] = config.EXCLUDED_EXTENSIONS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(src_url, dst_url)`` for every link that passes the crawl filter, copies kept.

    References were resolved when the page was read; they are filtered, then normalised.
    """
    full = F.col("full_url")
    found = nodes.select(
        *keep, F.col("url").alias("src_url"), F.explode(page_links(from_cleaned)).alias("full_url")
    )
    return found.where(ux.is_crawl_candidate(full, patterns, extensions)).select(
        *keep, "src_url", ux.normalize_url(full).alias("dst_url")
    )
