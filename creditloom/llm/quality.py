"""Quality rules with thresholds learned per language and source from mergeable quantile sketches; DataFrame functions only.

A sketch is a histogram over buckets whose width grows with the value: below 64 every integer has its own bucket, above, each power of two has 32.
Two sketches merge by adding counts, so tasks pre-aggregate and a group of any size ends as at most a few hundred rows. A quantile
read from it is the lower bound of its bucket, at most 1/32 below the true value, and does not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps

# Fixed values of the base rules.
BLANKS = r"\x20\x09-\x0D"
SYMBOLS = r"[^#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Measures that get a learned upper threshold, per thousand words (symbols, lines, repeats) or per hundred words (characters).
MEASURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
LOW = 0.25
#: Shares of rows, from the median up, at which a sketch is read: 1/2, 3/4, 7/8, ...
LADDER = tuple(1 - 2.0**-k for k in range(1, 11))
#: Values are compared by their ratio after this is added, so that differences near zero count little. One for all measures.
OFFSET = 16
REACH = 12
#: Largest ratio of two steps of the ladder, and of the threshold to the last step, for a measure without a spread below its median.
GAP = 4
#: One bucket width: texts that are all alike differ by so much in the sketch.
WIDTH = 1 / 32
MIN_GROUP = 50
#: The sketches of the language, the source and all rows weigh together as much as so many rows of the group.
PRIOR = 50


def held(value: Column, use) -> Column:
    """`use` of a value that is worked out once per row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text, in order."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more, its first place included.

    Windows are compared by 64-bit hash. Equal windows stand side by side once (hash, position) pairs are sorted; their
    positions, sorted again, cover three words each, less where the next one starts sooner.
    """
    n = F.size(words)

    def windows(w: Column) -> Column:
        first, second, third = F.slice(w, F.lit(1), n - 2), F.slice(w, F.lit(2), n - 2), F.slice(w, F.lit(3), n - 2)
        pairs = F.zip_with(first, second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(pairs, third, lambda p, c: F.xxhash64(p["a"], p["b"], c))

    def covered(places: Column) -> Column:
        following = F.slice(places, F.lit(2), F.size(places))
        return F.aggregate(F.zip_with(places, following, lambda p, q: F.least(F.coalesce(q - p, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda s, d: s + d)

    def places(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return held(pairs, lambda s: held(
            F.zip_with(
                F.zip_with(s, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, F.lit(1), F.size(s) - 1)), lambda x, before: F.struct(x.alias("x"), before["h"].alias("before"))),
                F.concat(F.slice(s, F.lit(2), F.size(s) - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
                lambda x, after: F.when(x["x"]["h"].eqNullSafe(x["before"]) | x["x"]["h"].eqNullSafe(after["h"]), x["x"]["i"]),
            ),
            lambda found: covered(F.sort_array(F.array_compact(found))),
        ))

    counted = held(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(places(h)))
    return F.when(n >= 4, counted).otherwise(F.lit(0).cast("long"))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """The base measures of a text that is not null and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    n_lines = held(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, f"[{BLANKS}]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS + "+", "")).cast("long"),
        "n_dup_lines": n_lines,
        "n_repeat_words": repeat_words(words),
    }


def bucket_of(value: Column) -> Column:
    """Number of the sketch bucket of a whole number from 0 on."""
    power = F.length(F.bin(value)) - 1
    above = F.lit(64) + (power - 6) * 32 + (F.floor(value / F.pow(F.lit(2.0), power - 5)) - 32)
    return F.when(value < 64, value).otherwise(above).cast("long")


def floor_of(bucket: Column) -> Column:
    """Smallest value of a bucket."""
    power = F.floor((bucket - 64) / 32).cast("int")
    return F.when(bucket < 64, bucket).otherwise((F.lit(32) + F.pmod(bucket - 64, F.lit(32))) * F.pow(F.lit(2.0), power + 1)).cast("long")


def sketches(rows: DataFrame, groups: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Rows (groups, measure, bucket, n). Sketches of several tables are merged by adding up n."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in measures])
    return rows.select(*groups, F.inline(cells)).groupBy(*groups, "measure", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """groups, measure, size, and one column per named share: the smallest value with at least that share of rows at or below it."""
    by = Window.partitionBy(*groups, "measure")
    upto = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("size", F.sum("n").over(by))
    found = [F.min(F.when(F.col("upto") >= F.col("size") * share, floor_of(F.col("bucket")))).alias(name) for name, share in shares.items()]
    return upto.groupBy(*groups, "measure", "size").agg(*found)


def reaches(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """groups, measure, size, middle (the median) and factor, the ratio of the threshold to the median that this sketch alone would set.

    The sketch is read at 3/4, 7/8, 15/16, ... of the rows; the first step that is over GAP times the one before it begins another population, and the threshold is at most
    GAP times the last step of the body. Where the lower quartile lies between zero and the median, the factor is also at most (median / lower quartile) ^ REACH and
    a bucket width, which junk above the median cannot move; a measure that starts at zero, or whose lower half is all alike, shows no such spread.
    """
    names = {f"step_{k}": share for k, share in enumerate(LADDER)}
    found = quantiles(sketch, groups, {"low": LOW, **names})
    middle, low = F.col("step_0") + OFFSET, F.col("low") + OFFSET
    body = F.aggregate(F.array(*names), F.col("step_0"), lambda top, step: F.when(step + OFFSET <= GAP * (top + OFFSET), step).otherwise(top))
    ladder, spread = float(GAP) * (body + OFFSET) / middle, F.pow(middle / low, F.lit(float(REACH))) + WIDTH
    factor = F.when((F.col("low") > 0) & (F.col("low") < F.col("step_0")), F.least(spread, ladder)).otherwise(ladder)
    return found.select(*groups, "measure", "size", F.col("step_0").alias("middle"), factor.alias("factor"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, measure and limit, the largest value that is kept, for every language and source of the sketch (lang, source, measure, bucket, n).

    Sketches of the languages, the sources and all rows are sums of the same rows. A group's median is its own, its factor is its own shrunk by size towards those
    of its language, its source and all rows. A group of fewer than MIN_GROUP rows takes median and factor of its language, a language of fewer those of all rows.
    """

    def level(name: str, groups: list[str]) -> DataFrame:
        merged = sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n")) if len(groups) < 2 else sketch
        return reaches(merged, groups).select(*[F.col(g).alias(f"{name}_{g}") for g in groups], *[F.col(c).alias(f"{name}_{c}") for c in ("measure", "size", "middle", "factor")])

    own, lang, source, every = level("own", ["lang", "source"]), level("l", ["lang"]), level("s", ["source"]), level("a", [])
    joined = own.join(every, F.col("own_measure") == F.col("a_measure"))
    joined = joined.join(lang, (F.col("own_measure") == F.col("l_measure")) & F.col("own_lang").eqNullSafe(F.col("l_lang")))
    joined = joined.join(source, (F.col("own_measure") == F.col("s_measure")) & F.col("own_source").eqNullSafe(F.col("s_source")))
    large, spoken = F.col("own_size") >= MIN_GROUP, F.col("l_size") >= MIN_GROUP
    middle = F.when(large, F.col("own_middle")).when(spoken, F.col("l_middle")).otherwise(F.col("a_middle"))
    own_factor = (F.col("own_size") * F.col("own_factor") + PRIOR * (F.col("l_factor") + F.col("s_factor") + F.col("a_factor")) / 3) / (F.col("own_size") + PRIOR)
    lang_factor = (F.col("l_size") * F.col("l_factor") + PRIOR * F.col("a_factor")) / (F.col("l_size") + PRIOR)
    factor = F.when(large, own_factor).when(spoken, lang_factor).otherwise(F.col("a_factor"))
    limit = F.floor((middle + OFFSET) * factor * (1 + 1e-9)).cast("long") - OFFSET
    return joined.select(F.col("own_lang").alias("lang"), F.col("own_source").alias("source"), F.col("own_measure").alias("measure"), limit.alias("limit"))


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", source_column: str = "source") -> DataFrame:
    """One row per row of `docs`: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and failed, the measures above their threshold.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT percent of them in repeated windows. Rows that pass teach the sketches of their language
    and source; a row is dropped where a measure exceeds the threshold of its group (see thresholds). Null languages
    and sources are groups of their own. Null and empty texts have 0 words and fail the base rule.
    Repeated rows stay repeated; a null id is kept as it is; further columns are neither read nor returned.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.col(language_column).alias("lang"), F.col(source_column).alias("source"), text.alias("text"))
    measured = held(words_of(F.col("text")), lambda w: F.struct(*[c.alias(name) for name, c in base_columns(F.col("text"), w).items()]))
    rows = rows.select("id", "lang", "source", measured.alias("m")).select("id", "lang", "source", "m.*")
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rate(value: Column, per: int) -> Column:
        return F.floor(value * per / n).cast("long")

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumns({
        "base_failed": failed, "symbol_rate": rate(F.col("n_symbols"), 1000), "dup_line_rate": rate(F.col("n_dup_lines"), 1000),
        "repeat_rate": rate(F.col("n_repeat_words"), 1000), "word_length": rate(F.col("word_chars"), 100),
    })
    steps = Steps(docs.sparkSession, "quality")
    rows = steps.write("measures", rows)  # a few numbers per text, read twice
    sketch = steps.write("sketch", sketches(rows.where(~F.col("base_failed")), ["lang", "source"]))
    wide = thresholds(sketch).groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("limit"))).alias(f"limit_{m}") for m in MEASURES])
    own = wide.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})  # a row per language and source
    rows = rows.join(own, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    above = F.array_compact(F.array(*[F.when(F.col(m) > F.col(f"limit_{m}"), F.lit(m)) for m in MEASURES]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = rows.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(above))
    return out.select(F.col("id").alias(id_column), *names, (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
