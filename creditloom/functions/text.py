"""Array-of-lines and array-of-sentences helpers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditloom.functions.values import mentions, squeeze


def lines_of(text: Column) -> Column:
    """Trimmed, non-blank lines in order."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def holding(text: Column, words: Sequence[str], low: Column | None = None) -> Column:
    """The text where its lower case, if that is at hand, holds one of the words; else an empty text. A null text stays null.

    For patterns that match nothing without one of these words: a plain search spares most texts a pattern that is tried at each place.
    """
    if low is None:
        return text
    found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(found, text).when(text.isNotNull(), F.lit(""))


def sentences_with(text: Column, words: Sequence[str] | None = None, pattern: str | None = None, low: Column | None = None) -> Column:
    """Squeezed sentences (cut at full stops and line ends) holding a word, or matching a pattern, which holds one of the words if both are given.

    A text without any hit is not cut up at all. Words have no full stops or line ends.
    """
    keep: Callable[[Column], Column] = (lambda s: s.rlike(pattern)) if pattern is not None else (lambda s: mentions(s, words or []))
    some = F.when(keep(text), text).otherwise("") if low is None else F.coalesce(holding(text, words or [], low), F.lit(""))
    hits = F.filter(F.split(some, r"[.\n]"), keep)
    return F.transform(hits, squeeze)


def all_matches(text: Column, pattern: str) -> Column:
    """Groups 1 and 2 of all matches; the text is searched once, the groups are read off each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("first"), F.regexp_extract(m, pattern, 2).alias("second")))


def first_item(items: Column) -> Column:
    return F.get(items, 0)


def number_text(c: Column) -> Column:
    """'1,234.5' to 1234.5, null when it is no number."""
    return F.regexp_replace(c, ",", "").try_cast("double")


#: Named references with their closing mark, and what numbers 128 to 159 stand for on old pages; both from the standard library's tables.
_NAMED = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
_OLD = json.dumps({n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)})
_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def code_point(number: Column) -> Column:
    """The character of a number; the replacement character where there is none."""
    known = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def unescape(text: Column) -> Column:
    """Character references decoded once: decimal, hexadecimal and named ones that end with a semicolon. Unknown names stay as they are."""
    table = lambda known: F.from_json(F.lit(known), F.lit("map<string,string>"))

    def decoded(x: Column) -> Column:
        digits = F.regexp_extract(x, "([0-9a-fA-F]+);$", 1)
        hexed = F.lower(F.substring(x, 3, 1)) == "x"
        # Longer than any code point: no character.
        number = F.when(F.length(F.regexp_replace(digits, "^0+", "")) > 8, F.lit(0)).otherwise(F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint"))
        old = F.try_element_at(table(_OLD), number.cast("string"))
        named = F.try_element_at(table(_NAMED), F.substring(x, F.lit(2), F.length(x) - 2))
        return F.when(F.startswith(x, F.lit("&#")), F.coalesce(old, code_point(number))).otherwise(F.coalesce(named, x))

    pieces = F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0))
    joined = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(f"^{_REFERENCE}$"), decoded(x)).otherwise(x)), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)
