"""Helpers for writing the checking SQL."""

from __future__ import annotations

from creditloom.sources.stand_ins import STAND_INS, with_clause

CTES: dict[str, str] = dict(STAND_INS)
SQL: dict[str, str] = {}


def r(expr: str, digits: int) -> str:
    """Rounding in decimal, halves away from zero, as double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def short(expr: str, digits: int) -> str:
    """1.50 -> 1.5, 2 -> 2.0."""
    return f"regexp_replace(CAST(CAST(round(CAST({expr} AS DECIMAL(28,10)), {digits}) AS DECIMAL(30,{max(digits, 1)})) AS VARCHAR), '(\\.\\d+?)0+$', '\\1')"


def ratio(expr: str, digits: int = 2, suffix: str = "x") -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'Not Available' ELSE concat({short(expr, digits)}, '{suffix}') END"


def pct(expr: str) -> str:
    return ratio(expr, 1, "%")


def crore(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'Not Available' ELSE concat('₹', format('{{:,.2f}}', {r(expr, 2)}), ' Cr') END"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(expr, w.replace("'", "''")) for w in words) + ")"


def finished() -> dict[str, str]:
    return {k: with_clause(v, CTES) for k, v in SQL.items()}
