"""Character classes spelled out, because Java, RE2 and Python disagree on \\w, \\b and \\s."""

from pyspark.sql import functions as F

# Inner parts of bracket expressions.
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = (
    r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same without the line feed, for text that is split at line feeds.
INLINE_SPACE_CHARS = (
    r" \t\r\f\x{0b}\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}"
)

SPACES = f"[{SPACE_CHARS}]+"
NON_WORDS = f"[^{WORD_CHARS}]+"


# Every white-space character, for per-character replacement (faster than a class of ranges).
SPACE_LIST = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)


def plain_spaces(col):
    """Every white-space character becomes a space."""
    return F.translate(col, SPACE_LIST, " " * len(SPACE_LIST))


def strip(col):
    """Trim every kind of white space at both ends."""
    return F.trim(col, F.lit(SPACE_LIST))
