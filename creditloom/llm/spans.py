"""Places of pattern matches in whole texts, with column functions only.

A text is split by a pattern into the stretches between its matches; running sums of the lengths of stretches and matches are the matches' places.
Matches become rows before their places are summed, so a text may hold any number of them. Places count code points; ends are exclusive.
Patterns are run by Java's regex engine: repeated groups in them are possessive, which keeps them from recursing on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCH = "array<struct<kind:string,k:int,gap:int,value:string,left:string,right:string>>"


def matches(kind: str, text: Column, pattern: str, guard: Column, context: tuple = (None, None)) -> Column:
    """Array of the pattern's leftmost non-overlapping matches; empty where `guard`, a cheaper necessary condition, is false.

    `context` may give two functions that take the stretch before and after a match and return what to keep of it.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    left, right = context

    def rows(g: Column) -> Column:
        after = F.slice(g, F.lit(2), F.size(g))
        return F.transform(
            F.arrays_zip(values.alias("v"), F.slice(g, F.lit(1), F.size(g) - 1).alias("b"), after.alias("a")),
            lambda x, k: F.struct(
                F.lit(kind).alias("kind"), k.alias("k"), F.length(x["b"]).alias("gap"), x["v"].alias("value"),
                (left(x["b"]) if left else F.lit(None).cast("string")).alias("left"), (right(x["a"]) if right else F.lit(None).cast("string")).alias("right"),
            ),
        )

    # The one-element array holds the split text, so that it is worked out once.
    return F.when(guard, F.transform(F.array(gaps), rows)[0]).otherwise(F.array().cast(MATCH)).cast(MATCH)


def placed(found: DataFrame) -> DataFrame:
    """Adds start and end to exploded matches (row, kind, k, gap, value, ...)."""
    by = Window.partitionBy("row", "kind").orderBy("k")
    before = F.sum("gap").over(by.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(F.sum(F.length("value")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("start", before + inside).withColumn("end", F.col("start") + F.length("value"))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def summaries(rows: DataFrame, spans: DataFrame, kinds: list[str], id_column: str) -> DataFrame:
    """One row per row of `rows` (row, id): counts of the base kinds, hash of the base spans, and all spans as kind:start:end.

    `spans` has row, kind, start, end. Spans are ordered by start, then by the base kinds as listed, then by the name of other kinds.
    """
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in enumerate(kinds) for x in p[::-1]]), F.col("kind")), F.lit(len(kinds)))
    listed = F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "kind", "end")))
    grouped = spans.groupBy("row").agg(listed.alias("all"))

    def text(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    every = F.coalesce(F.col("all"), none)
    out = rows.join(grouped, "row", "left").select("id", every.alias("all"))
    counts = [F.size(F.filter("all", _of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    base = text(F.filter("all", lambda s: s["place"] < len(kinds)))
    return out.select(F.col("id").alias(id_column), *counts, F.sha2(base, 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
