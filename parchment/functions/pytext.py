"""Text semantics that reports rely on: Unicode white space, digits of any script, words, truthiness."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space inside a character class of a pattern with (?U): Unicode's and the four separators.
WS = r"\s\x1c-\x1f"
#: The same characters, one by one.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Latin-1 characters that are no white space but the space itself. Java looks such a class up in a table; ranges it would try one after another.
_EVEN = "".join(rf"\x{c:02x}" for c in range(256) if chr(c) == " " or chr(c) not in BLANKS)
#: White space other than the space.
UNEVEN = rf"[^{_EVEN}](?<=[{BLANKS.replace(' ', '')}])"
#: Those of Latin-1 that are in words, and the space.
_WORDS = "".join(rf"\x{c:02x}" for c in range(256) if chr(c) in " _" or unicodedata.category(chr(c))[0] in "LN")

_ND = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_FOREIGN, _ASCII = "".join(_ND), "".join(str(unicodedata.digit(c)) for c in _ND)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(c: Column) -> Column:
    """``c`` without white space at the ends. Behind a last byte that is a sign of ASCII there is none, and the text's characters need not be told apart."""
    solid = lambda t: F.substring(t.cast("binary"), -1, 1).between(F.lit(b"!"), F.lit(b"~"))
    return let(F.ltrim(c, F.lit(BLANKS)), lambda t: F.when(solid(t), t).otherwise(F.rtrim(t, F.lit(BLANKS))))


def filled(c: Column) -> Column:
    """Whether a text has more than white space; looks no further than the first such character."""
    return F.ltrim(c, F.lit(BLANKS)) != ""


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends; only texts that have other white space than single spaces are rewritten."""
    return strip(let(c, lambda t: F.when(F.contains(t, F.lit("  ")) | t.rlike(UNEVEN), F.regexp_replace(t, rf"(?U)[{WS}]+", " ")).otherwise(t)))


def ascii_digits(c: Column) -> Column:
    """Decimal digits of every script as 0-9; only texts that have such digits are rewritten."""
    return F.when(c.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(c, _FOREIGN, _ASCII)).otherwise(c)


def nonempty(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)/*$", 1)


def spaced_words(c: Column) -> Column:
    """The lower-cased words of letters, digits and underscores, with blanks between them."""
    return F.regexp_replace(F.lower(c), rf"(?=[^{_WORDS}])[^\p{{L}}\p{{N}}_ ]+", " ")
