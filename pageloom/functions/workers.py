"""What Python workers run: read HTML into node lists, resolve references, put rows in order.

This module imports nothing of the package, and is pickled by value, so executors need no copy.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Text in these is no part of the text of the elements around them.
APART_TAGS = frozenset("script style template rt rp".split())

# Nodes take many times the memory of their page, so few pages are held as nodes at a time.
SLICE_BYTES = 500_000

ARROW_NODE = pa.struct(
    [
        ("pos", pa.int32()),
        ("stop", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("classes", pa.list_(pa.string())),
        ("link", pa.string()),
        ("text", pa.string()),
        ("hidden", pa.bool_()),
        ("apart", pa.bool_()),
        # How many texts that cleaning leaves stand before the node, and before its end.
        ("first", pa.int32()),
        ("last", pa.int32()),
    ]
)


class NodeReader(HTMLParser):
    """Flat node list of one page.

    Void tags close at once, an end tag closes the nearest open element of its name with all
    inside it, unknown end tags are ignored, and nothing else closes an element.
    """

    def __init__(self, url: str, removed_tags: frozenset, removed_class: re.Pattern | None):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.removed_tags, self.removed_class = removed_tags, removed_class
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.pending: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        values = {k: v or "" for k, v in attrs}
        gone = tag in self.removed_tags or bool(
            self.removed_class and self.removed_class.search(values.get("class", ""))
        )
        node = self.add(tag, values, None, gone)
        if tag not in VOID_TAGS:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        self.flush()
        while True:
            node = self.open.pop()
            self.names[node["tag"]] -= 1
            node["stop"] = len(self.nodes)
            if node["tag"] == tag:
                return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def flush(self):
        data, self.pending = "".join(self.pending).strip(), []
        if data:
            self.add(None, None, data, False)

    def add(self, tag, attrs, text, gone):
        parent = self.open[-1] if self.open else None
        node = {
            "pos": len(self.nodes),
            "stop": len(self.nodes) + 1,
            "tag": tag,
            "attrs": None if attrs is None else list(attrs.items()),
            "classes": attrs["class"].split() if attrs and "class" in attrs else None,
            "link": absolute(self.url, attrs["href"]) if tag == "a" and "href" in attrs else None,
            "text": text,
            "hidden": gone or bool(parent and parent["hidden"]),
            "apart": tag in APART_TAGS or bool(parent and parent["apart"]),
        }
        self.nodes.append(node)
        return node

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self.flush()
        for node in self.open:
            node["stop"] = len(self.nodes)
        before = [0]
        for node in self.nodes:
            before.append(before[-1] + (node["text"] is not None and not node["hidden"]))
        for node in self.nodes:
            node["first"], node["last"] = before[node["pos"]], before[node["stop"]]
        return self.nodes


def absolute(page: str | None, reference: str | None) -> str | None:
    if page is None or reference is None:
        return None
    try:
        return urljoin(page, reference)
    except ValueError:  # e.g. an unclosed bracket in the host
        return None


def node_batches(
    keep: Sequence[str], removed_tags: Sequence[str], removed_classes: Sequence[str]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batch function adding ``nodes`` to the ``keep`` columns."""
    kept, tags = list(keep), frozenset(removed_tags)
    pattern = re.compile("|".join(removed_classes), re.I) if removed_classes else None

    def slices(batch):
        """Runs of pages of about ``SLICE_BYTES`` of text, and one page at least."""
        start, size = 0, 0
        for place, html in enumerate(batch.column("html")):
            length = len(html.as_py() or "")
            if place > start and size + length > SLICE_BYTES:
                yield batch.slice(start, place - start)
                start, size = place, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)

    def read(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            pages = zip(batch.column("_url").to_pylist(), batch.column("html").to_pylist())
            nodes = [NodeReader(url, tags, pattern).read(html or "") for url, html in pages]
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array(nodes, pa.list_(ARROW_NODE)))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "nodes"])

    return read


def in_order(order: Sequence[str], rows: int = 1_000) -> Callable:
    """Batch function giving the rows of a partition by ``order``, nulls last. A partition is held as
    Arrow batches; ``rows`` at a time are copied."""
    names = list(order)

    def ordered(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = pa.Table.from_batches([b.select(names) for b in held])
        places = pc.sort_indices(
            keys, sort_keys=[(n, "ascending") for n in names], null_placement="at_end"
        ).to_numpy().astype(np.int64)
        starts = np.cumsum([0, *[b.num_rows for b in held]])
        for start in range(0, len(places), rows):
            wanted = places[start : start + rows]
            whose = np.searchsorted(starts, wanted, side="right") - 1
            numbers = np.unique(whose)
            found = pa.Table.from_batches([held[n].take(pa.array(wanted[whose == n] - starts[n])) for n in numbers])
            # Rows now stand batch by batch; each goes back to its place.
            back = np.empty(len(wanted), np.int64)
            back[np.argsort(whose, kind="stable")] = np.arange(len(wanted))
            yield from found.take(pa.array(back)).combine_chunks().to_batches()

    return ordered


def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([absolute(b, h) for b, h in zip(base, href)], dtype=object)


def _decoded(label: str) -> str:
    if label.startswith("xn--"):
        try:
            return label[4:].encode("ascii").decode("punycode")
        except UnicodeError:  # no such name; it stays as it is
            pass
    return label


def decode_labels(names: pd.Series) -> pd.Series:
    """Names with their ASCII-coded labels in Unicode; null stays null."""
    return names.map(lambda n: None if n is None else ".".join(map(_decoded, n.split("."))))


# Plain texts: of these characters the properties are written down here. Others are not looked at.
_LOWER, _UPPER, _DIGITS = "a-zªµºß-öø-ÿœ", "A-ZÀ-ÖØ-ÞŒ", "0-9²³¹¼½¾"
_NOT_PLAIN = re.compile("[^\x00-\xffŒœ–—‘’“”„…€]")
_LETTER_MARKS, _DIGIT_MARKS = ":·'.‘’", ",;'.‘’"
_PLAIN_WORD = re.compile(
    f"[{_LOWER}{_DIGITS}_]++(?:(?:(?<=[{_LOWER}])[{_LETTER_MARKS}](?=[{_LOWER}])"
    f"|(?<=[{_DIGITS}])[{_DIGIT_MARKS}](?=[{_DIGITS}]))[{_LOWER}{_DIGITS}_]++)*+"
)
_PLAIN_LETTERS = re.compile(f"[{_LOWER}]+")
_PLAIN_ENDS = re.compile("[.!?]+")
_PLAIN_RUN = re.compile(f"[{_LOWER}{_DIGITS}_]+")
_PLAIN_KEYWORD = re.compile("[a-z]{4,}")
_PLAIN_UNKEPT = re.compile(rf'[^{_LOWER}{_UPPER}{_DIGITS}_ .,!?;:()\-"]+')
# Words are held as Python objects for this much text at a time.
SLICE_CHARS = 1_000_000


def _plain(text: str | None) -> bool:
    return text is not None and (text.isascii() or not _NOT_PLAIN.search(text))


def _words(text: str) -> list[str]:
    found = _PLAIN_WORD.findall(text.lower())
    return [w for w in found if w.strip("_")] if "_" in text else found


def _text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``SLICE_CHARS``, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for place, length in enumerate(sizes.tolist()):
        if place > start and size + length > SLICE_CHARS:
            yield texts.slice(start, place - start)
            start, size = place, 0
        size += length
    yield texts.slice(start)


def _by_slices(made: Callable[[list[str | None]], pa.Array], texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([made(part.to_pylist()) for part in _text_slices(texts)])


def _lists(lists: list[list | None], values: pa.Array) -> pa.Array:
    """A list array of the sizes of ``lists`` over ``values``, null where a list is."""
    ends = np.cumsum([0, *[len(x) if x is not None else 0 for x in lists]])
    gone = np.array([*[x is None for x in lists], False])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=gone), values)


def _counts(found: list[Counter | None]) -> pa.Array:
    ordered = [None if c is None else sorted(c) for c in found]
    kept = [(c, words) for c, words in zip(found, ordered) if c is not None]
    values = pa.array([w for _, words in kept for w in words], pa.string())
    numbers = pa.array([c[w] for c, words in kept for w in words], pa.int32())
    return _lists(ordered, pa.StructArray.from_arrays([values, numbers], names=["value", "n"]))


def word_counts(texts: pa.Array) -> pa.Array:
    def made(part: list[str | None]) -> pa.Array:
        words = [_words(t) if _plain(t) else None for t in part]
        sizes = pa.array([None if w is None else len(w) for w in words], pa.int32())
        counts = _counts([None if w is None else Counter(w) for w in words])
        gone = pa.array([w is None for w in words], pa.bool_())
        return pa.StructArray.from_arrays([sizes, counts], names=["dl", "counts"], mask=gone)

    return _by_slices(made, texts)


def is_plain(texts: pa.Array) -> pa.Array:
    return _by_slices(lambda part: pa.array([None if t is None else _plain(t) for t in part], pa.bool_()), texts)


def word_number(texts: pa.Array) -> pa.Array:
    return _by_slices(lambda part: pa.array([len(_words(t)) if _plain(t) else None for t in part], pa.int32()), texts)


def term_counts(terms: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    def counted(text: str) -> list[int]:
        words = _words(text)
        return [len(words), *map(words.count, terms)]

    def made(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int32())
        return _by_slices(lambda part: pa.array([counted(t) if _plain(t) else None for t in part], kind), texts)

    made.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return made


def reading_counts(texts: pa.Array) -> pa.Array:
    def made(part: list[str | None]) -> pa.Array:
        kept = [t if _plain(t) else None for t in part]
        words = pa.array([None if t is None else len(t.split()) for t in kept], pa.int32())
        sentences = pa.array([None if t is None else len(_PLAIN_ENDS.findall(t)) for t in kept], pa.int32())
        runs = _counts([None if t is None else Counter(_PLAIN_LETTERS.findall(t.lower())) for t in kept])
        gone = pa.array([t is None for t in kept], pa.bool_())
        return pa.StructArray.from_arrays([words, sentences, runs], names=["words", "sentences", "runs"], mask=gone)

    return _by_slices(made, texts)


def clean_text(texts: pa.Array) -> pa.Array:
    def cleaned(text: str) -> str:
        # The spaces that ``str.split`` knows are those of ``chars.SPACE_LIST``.
        return _PLAIN_UNKEPT.sub("", " ".join(text.split())).strip(" ")

    return _by_slices(lambda part: pa.array([cleaned(t) if _plain(t) else None for t in part], pa.string()), texts)


def keywords(n: int, stop_words: Sequence[str]) -> Callable[[pa.Array], pa.Array]:
    stop = frozenset(stop_words)

    def best(text: str) -> list[str]:
        # A counter keeps the order of first occurrence, and sorting does not change that of equals.
        counts = Counter(_PLAIN_RUN.findall(text.lower()))
        kept = [(w, c) for w, c in counts.items() if w not in stop and _PLAIN_KEYWORD.fullmatch(w)]
        return [w for w, _ in sorted(kept, key=lambda x: -x[1])[:n]]

    def made(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        return _by_slices(lambda part: pa.array([best(t) if _plain(t) else None for t in part], kind), texts)

    made.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return made


def blocks(bits: int, rows: int = 200_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batch function making blocks of postings ``(_doc, field, term, tf, dl)`` that come by document: one
    for each range of ``2**bits`` documents, term and field, with the pairs ``(tf, dl)`` that no other pair
    has a larger count and a smaller length than. About ``rows`` postings are held at a time, and those of
    one range at least."""

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, tf, dl = (table[c].to_numpy() for c in ("_doc", "tf", "dl"))
        terms, fields = (table[c].combine_chunks().dictionary_encode() for c in ("term", "field"))
        span, term, field = doc >> bits, terms.indices.to_numpy(), fields.indices.to_numpy()
        order = np.lexsort((doc, field, term, span))
        doc, tf, dl, span, term, field = (x[order] for x in (doc, tf, dl, span, term, field))
        new = np.ones(len(doc), bool)
        new[1:] = (span[1:] != span[:-1]) | (term[1:] != term[:-1]) | (field[1:] != field[:-1])
        starts, block = np.flatnonzero(new), np.cumsum(new) - 1
        ends = np.append(starts, len(doc))
        # By falling count, a pair stands if its length is below all before it in its block. Later blocks
        # lie below earlier ones, so that one running minimum serves for all.
        best = np.lexsort((dl, -tf.astype(np.int64), block))
        height = dl[best] - (block[best].astype(np.int64) << 32)
        stands = np.ones(len(doc), bool)
        stands[1:] = height[1:] < np.minimum.accumulate(height)[:-1]
        pair_ends = np.append(0, np.cumsum(np.add.reduceat(stands, starts, dtype=np.int64)))
        best = best[stands]
        pairs = pa.StructArray.from_arrays([pa.array(tf[best]), pa.array(dl[best])], names=["tf", "dl"])
        found = pa.StructArray.from_arrays([pa.array(x) for x in (doc, tf, dl)], names=["_doc", "tf", "dl"])
        yield pa.RecordBatch.from_arrays(
            [
                terms.dictionary.take(pa.array(term[starts])),
                fields.dictionary.take(pa.array(field[starts])),
                pa.array(span[starts]),
                pa.array(np.diff(ends).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(pair_ends, pa.int32()), pairs),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
            ],
            ["term", "field", "range", "n", "impacts", "postings"],
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            span = table["_doc"].to_numpy() >> bits
            # The last range may go on in the next batch.
            others = np.flatnonzero(span != span[-1])
            whole = int(others[-1]) + 1 if len(others) else 0
            if whole:
                yield from made(table.slice(0, whole))
                held, size = table.slice(whole).to_batches(), table.num_rows - whole
        if size:
            yield from made(pa.Table.from_batches(held))

    return run


def text_postings(fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batch function giving the postings ``(_doc, field, term, tf, dl)`` of ``(_doc, text_<field>, counted_<field>)``
    by document; a text with counts of its own, as of ``word_counts``, is not taken apart."""

    def plain(doc: np.ndarray, texts: pa.Array) -> tuple:
        words = [_words(t) for t in texts.to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        named = pa.array([w for found in words for w in found], pa.string()).dictionary_encode()
        number = max(1, len(named.dictionary))
        pairs, counts = np.unique(np.repeat(np.arange(len(words)), sizes) * number + named.indices.to_numpy(), return_counts=True)
        row = pairs // number
        return doc[row], named.dictionary.take(pa.array(pairs % number)), counts, sizes[row]

    def counted(doc: np.ndarray, found: pa.StructArray) -> tuple:
        dl, counts = found.field("dl").to_numpy(), found.field("counts")
        row = np.repeat(np.arange(len(found)), pc.list_value_length(counts).to_numpy())
        values = counts.flatten()
        return doc[row], values.field("value"), values.field("n").to_numpy(), dl[row]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = batch.column("_doc").to_numpy()
        parts, names = [], []
        for f in fields:
            texts, own = batch.column(f"text_{f}"), batch.column(f"counted_{f}")
            for rows, values, count in (
                (pc.and_(texts.is_valid(), own.is_null()), texts, plain),
                (own.is_valid(), own, counted),
            ):
                parts.append(count(docs[rows.to_numpy(zero_copy_only=False)], values.filter(rows)))
                names.append(np.full(len(parts[-1][0]), len(names) // 2, np.int32))
        doc, tf, dl = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3))
        order = np.argsort(doc, kind="stable")
        terms = pa.concat_arrays([p[1] for p in parts]).take(pa.array(order))
        named = pa.array(list(fields)).take(pa.array(np.concatenate(names)[order]))
        columns = [pa.array(doc[order]), named, terms, pa.array(tf[order].astype(np.int32)), pa.array(dl[order].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["_doc", "field", "term", "tf", "dl"])

    def run(batches):
        for batch in batches:
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(f"text_{f}")), 0).to_numpy() for f in fields)
            # Cut where the running size passes a multiple of the limit, so a part is about that long.
            at = np.cumsum(sizes, dtype=np.int64) // SLICE_CHARS
            ends = np.flatnonzero(at[1:] != at[:-1]) + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                if end > start:
                    yield made(batch.slice(start, end - start))

    return run


def text_blocks(fields: Sequence[str], bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """:func:`blocks` of :func:`text_postings`, which stay in the worker."""
    postings, packed = text_postings(fields), blocks(bits)
    return lambda batches: packed(postings(batches))


# Near duplicates. Signatures are bits, a power of two of them and this many for each word at least.
SIGNATURE_BITS = 2
SIGNATURE_WORDS = 2_000_000  # 64-bit words of signatures that are compared at a time


def sorted_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in order and their counts, from a table ``(token, df)``."""
    tokens, counts = (table[c].to_numpy() for c in ("token", "df"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def prefixes(table, threshold: float, epsilon: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batch function giving ``(token, id, size, place)`` for the first tokens of each ``(id, size, hashes)``, by
    the counts of ``table``, a broadcast of :func:`sorted_counts`, and then by value; other tokens count 0."""

    def run(batches):
        tokens, counts = table.value
        for batch in batches:
            lists = batch.column("hashes")
            values = lists.flatten().to_numpy()
            sizes = batch.column("size").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            df = np.zeros(len(values), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, values), len(tokens) - 1)
                df = np.where(tokens[at] == values, counts[at], 0)
            order = np.lexsort((values, df, row))
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            place = np.arange(len(values)) - starts[row] + 1
            most = sizes - np.ceil(sizes * threshold - epsilon).astype(np.int64) + 1
            kept = np.flatnonzero(place <= most[row])
            rows = row[kept]
            columns = [
                pa.array(values[order[kept]]),
                batch.column("id").take(pa.array(rows)),
                pa.array(sizes[rows].astype(np.int32)),
                pa.array(place[kept].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "id", "size", "place"])

    return run


def signatures(hashes: pa.Array) -> pa.Array:
    """For each list of hashes 64-bit words with, for each bit, the parity of the hashes that fall to it.

    A bit that differs between two sets needs a token that only one of them has, so the number of
    differing bits never exceeds the size of their symmetric difference. The number of words is a power of
    two; the two halves of a signature, one on the other, are that of half the words."""
    sizes = pc.fill_null(pc.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = 1 << np.ceil(np.log2(np.maximum(1, sizes * SIGNATURE_BITS / 64))).astype(np.int64)
    ends = np.cumsum(np.append(0, words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bits = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & (words[row] * 64 - 1).astype(np.uint64)
    found = np.zeros(ends[-1], np.uint64)
    np.bitwise_xor.at(found, ends[row] + (bits >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bits & np.uint64(63)))
    offsets = pa.py_buffer((ends * 8).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(found)])


def likely_pairs(threshold: float, epsilon: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batch function giving the ``(id, partner)`` that signatures do not rule out. Rows come by ``tile``, in each
    ``(id, size, signature)`` first, then pairs. The signatures of a tile are held."""
    share = (1 - threshold) / (1 + threshold)

    class Tile:
        def __init__(self, held: list[pa.RecordBatch]):
            table = pa.Table.from_batches(held).combine_chunks()
            named = table["id"].combine_chunks().dictionary_encode()
            self.ids, places = named.dictionary, named.indices.to_numpy()
            self.sizes = np.zeros(len(self.ids), np.int64)
            self.sizes[places] = table["size"].to_numpy()
            # A key of several sets is never ruled out.
            self.several = np.bincount(places, minlength=len(self.ids)) > 1
            signed = table["signature"].combine_chunks()
            lengths = pc.binary_length(signed).to_numpy().astype(np.int64) // 8
            self.words = np.frombuffer(b"".join(signed.to_pylist()), np.uint64)
            self.starts, self.lengths = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
            self.starts[places] = np.cumsum(lengths) - lengths
            self.lengths[places] = lengths

        def of(self, at: np.ndarray, length: int, folded: int) -> np.ndarray:
            found = self.words[self.starts[at][:, None] + np.arange(length)]
            while found.shape[1] > folded:
                half = found.shape[1] // 2
                found = found[:, :half] ^ found[:, half:]
            return found

        def likely(self, pairs: pa.RecordBatch) -> pa.RecordBatch:
            a, b = (pc.index_in(pairs.column(c), value_set=self.ids).to_numpy() for c in ("id", "partner"))
            allowed = (self.sizes[a] + self.sizes[b]) * share + epsilon
            kept = self.several[a] | self.several[b]
            one, other = self.lengths[a], self.lengths[b]
            for x, y in np.unique(np.stack([one, other], 1), axis=0).tolist():
                chosen = np.flatnonzero((one == x) & (other == y))
                step = max(1, SIGNATURE_WORDS // max(x, y))
                for start in range(0, len(chosen), step):
                    at = chosen[start : start + step]
                    fewer = min(x, y)
                    apart = np.bitwise_count(self.of(a[at], x, fewer) ^ self.of(b[at], y, fewer)).sum(1, dtype=np.int64)
                    kept[at] |= apart <= allowed[at]
            return pairs.select(["id", "partner"]).filter(pa.array(kept))

    def run(batches):
        held: list[pa.RecordBatch] = []
        at, tile = None, None
        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            paired = batch.column("partner").is_valid().to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((tiles[1:] != tiles[:-1]) | (paired[1:] != paired[:-1])) + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if tiles[start] != at:
                    at, held, tile = tiles[start], [], None
                part = batch.slice(start, end - start)
                if not paired[start]:
                    held.append(part.select(["id", "size", "signature"]))
                    continue
                if tile is None:
                    tile, held = Tile(held), []
                yield tile.likely(part)

    return run
