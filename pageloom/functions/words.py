"""Word boundaries of the index analyzer, after the rules of Unicode Standard Annex 29.

Letters and digits stand together; a mark belongs to what it follows. An apostrophe, full stop, colon
or middle dot between two letters does not end a word (WB6, WB7), nor does an apostrophe, full stop,
comma or the like between two digits (WB11, WB12). Connectors such as ``_`` join words (WB13a, WB13b),
but are none alone. Scripts written without spaces give every two neighbouring characters, or one
that stands alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.arrays import let

# Fixed values of the annex: MidLetter, MidNum, both (MidNumLet and Single_Quote), ExtendNumLet, and
# what extends a character.
MID_LETTER = r":\x{b7}\x{387}\x{55f}\x{5f4}\x{2027}\x{fe13}\x{fe55}\x{ff1a}"
MID_NUM = r",;\x{37e}\x{589}\x{60c}\x{60d}\x{66c}\x{7f8}\x{2044}\x{fe10}\x{fe14}\x{fe50}\x{fe54}\x{ff0c}\x{ff1b}"
MID_BOTH = r"'.\x{2018}\x{2019}\x{2024}\x{fe52}\x{ff07}\x{ff0e}"
CONNECTORS = r"\p{Pc}"
EXTENDING = r"\p{M}\x{200c}\x{200d}"
UNSPACED_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
LONG_VOWEL = r"\x{30fc}"  # of two scripts, so of none by its property

_SCRIPTS = "".join(rf"\p{{Is{s}}}" for s in UNSPACED_SCRIPTS)
UNSPACED = f"[{_SCRIPTS}{LONG_VOWEL}]"


def _run(one: str) -> str:
    # Possessive, so that no engine needs a stack for the longest of words.
    return rf"{one}++(?:[{EXTENDING}]++{one}*+)*+"


# Lower-case Latin letters stand first, as looking up a script for each letter takes longer than all else.
_LATIN = r"a-z\x{df}-\x{f6}\x{f8}-\x{ff}"
_OTHERS = rf"[^\P{{L}}{_SCRIPTS}{LONG_VOWEL}]"
_LETTERS, _DIGITS = _run(f"[{_LATIN}{_OTHERS}]"), _run(r"\p{N}")
# Connectors alone match too, so that a long run of them is read once; they are left out afterwards.
_WORD = (
    rf"(?:{CONNECTORS}++|{_LETTERS}(?:[{MID_LETTER}{MID_BOTH}]{_LETTERS})*+"
    rf"|{_DIGITS}(?:[{MID_NUM}{MID_BOTH}]{_DIGITS})*+)++"
)
WORD = rf"{_WORD}|{UNSPACED}(?:{UNSPACED}|[{EXTENDING}])*+"
_CONNECTORS_ALONE = rf"^{CONNECTORS}++$"
# All scripts without spaces lie beyond the first of them.
_SPECIAL = rf"[{CONNECTORS}[\x{{e00}}-\x{{10ffff}}&&{UNSPACED}]]"


def portable(pattern: str) -> str:
    """``pattern`` for engines without possessive quantifiers and classes in classes, with their names
    of scripts."""
    return pattern.replace(f"[{_LATIN}{_OTHERS}]", _OTHERS).replace("++", "+").replace("*+", "*").replace(r"\p{Is", r"\p{")


def _pairs(run: Column) -> Column:
    return let(
        F.split(run, ""),
        lambda chars: F.transform(
            F.slice(chars, F.lit(2), F.size(chars)), lambda c, i: F.concat(F.get(chars, i), c)
        ),
    )


def words(text: Column) -> Column:
    """The lower-cased words of ``text``, in order; none of null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def parts(w: Column) -> Column:
        alone = (F.length(w) < 2) | ~F.rlike(w, F.lit("^" + UNSPACED))
        joined = F.filter(F.array(w), lambda x: ~F.rlike(x, F.lit(_CONNECTORS_ALONE)))
        return F.when(alone, joined).otherwise(_pairs(w))

    special = F.coalesce(F.rlike(text, F.lit(_SPECIAL)), F.lit(False))
    return F.when(special, F.flatten(F.transform(found, parts))).otherwise(found)


def words_sql(column: str) -> str:
    """The same in SQL of engines with lists and regular expressions as RE2 has them."""
    pattern, unspaced, joined = (portable(p).replace("'", "''") for p in (WORD, UNSPACED, _CONNECTORS_ALONE))
    found = (
        f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '{pattern}'),"
        f" lambda w: NOT regexp_matches(w, '{joined}'))"
    )
    return (
        f"CASE WHEN regexp_matches({column}, '{unspaced}') THEN flatten(list_transform({found}, lambda w:"
        f" CASE WHEN length(w) < 2 OR NOT regexp_matches(w, '^{unspaced}') THEN [w]"
        f" ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END)) ELSE {found} END"
    )
