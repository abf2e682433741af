"""Column helpers for the number, text and missing-value conventions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names, worst first.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]


def lit_map(mapping: dict) -> Column:
    """A small constant lookup as a map column."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(lit_map(mapping), key), F.lit(default))


def severity_rank(c: Column) -> Column:
    """0 = worst. Unknown names rank behind all known ones."""
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, F.upper(c), len(SEVERITIES))


def to_number(c: Column, default: float | None = 0.0, strip: str = r"[,\s]") -> Column:
    """Text to double; blanks and unparsable text become the default."""
    parsed = F.regexp_replace(c.cast("string"), strip, "").try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def cell_number(c: Column, default: float | None = 0.0) -> Column:
    """Workbook form of `to_number`: the rupee and percent signs go as well."""
    return to_number(c, default, r"[,₹%\s]")


def zero_as_missing(c: Column, default: float) -> Column:
    return F.coalesce(F.nullif(c, F.lit(0).cast("double")), F.lit(float(default)))


def whole_steps(c: Column, n: int) -> Column:
    """A double in whole steps of 1/n, as a cast to that many decimals rounds it; null where it lies too near the middle of two steps to tell, or is no number."""
    scaled = c.cast("double") * float(n)
    nearest = F.floor(scaled + 0.5)
    return F.when(F.abs(scaled - nearest) < 0.25, nearest)


def floor_one(c: Column) -> Column:
    """Denominator guard."""
    return F.greatest(c, F.lit(1.0))


def round_to(c, decimals: int) -> Column:
    """Half-up rounding that ignores binary noise behind the tenth decimal (0.169574999... is 0.169575)."""
    return F.round(F.round(c, 10), decimals)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def percent_gap(a: Column, b: Column) -> Column:
    spread = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * 100
    return F.when((a <= 0) & (b <= 0), F.lit(0.0)).otherwise(spread)


def flag(c: Column) -> Column:
    """Boolean to 0/1 double, null counts as false."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def short_number(c: Column, decimals: int) -> Column:
    """Shortest text of a rounded number that keeps one decimal place: 2 -> 2.0, 1.50 -> 1.5."""
    fixed = round_to(c, decimals).cast(f"decimal(30,{max(decimals, 1)})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def _or_absent(c: Column, text: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit("Not Available")).otherwise(text)


def ratio_text(c: Column, decimals: int = 2, suffix: str = "x") -> Column:
    return _or_absent(c, F.concat(short_number(c, decimals), F.lit(suffix)))


def percent_text(c: Column) -> Column:
    return _or_absent(c, F.concat(short_number(c, 1), F.lit("%")))


def crore_text(c: Column) -> Column:
    return _or_absent(c, F.concat(F.lit("₹"), F.format_number(round_to(c, 2), 2), F.lit(" Cr")))


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def has_any(c: Column, words: Sequence[str]) -> Column:
    """True when the text holds one of the words. One pass, and the text expression appears once."""
    return c.rlike("|".join(re.escape(w) for w in words))


def mentions(c: Column, words: Sequence[str]) -> Column:
    """True when the text holds one of the words in any case; spares lower-casing long texts."""
    return c.rlike("(?i)" + "|".join(re.escape(w) for w in words))


def ends_with_any(c: Column, endings: Sequence[str]) -> Column:
    return c.rlike("(?:" + "|".join(re.escape(e) for e in endings) + r")\z")


def present(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))


def rlike_first(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex hit, null when there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
