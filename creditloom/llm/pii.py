"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Base patterns give seed entities. The words beside the seeds are lexical patterns; a pattern-instance graph joins every word pattern with the values that
stand beside it anywhere in the corpus. Scores run over the graph until they accept nothing new: a pattern is as good as the share of its occurrences that lead to
accepted values, a value as good as its patterns together, and values above a threshold count as accepted in the next round.
Patterns of high confidence then mark the values beside them that no base pattern has found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps
from creditloom.llm.spans import matches, placed, summaries

# The base patterns, written so that the engine finds the same matches without recursion or rescans.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]

#: What may be an unseen identifier: a token with a digit or @, and the tokens with a digit that follow it after one blank each.
CANDIDATE = r"(?<!\S)\S*?[0-9@]\S*+(?:\x20(?=\S*[0-9])\S++)*+"
BEFORE = r"^[^A-Za-z0-9+@]+"
AFTER = r"^[^A-Za-z0-9@]+"  # read from the end
MIN_DIGITS = 5
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&=~`^\\/_-+@"
MIN_SEEDS = 3
PATTERN_CONFIDENCE = 0.6
VALUE_CONFIDENCE = 0.8


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check sum."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.cast("int"), F.lit(0)))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", value.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$"))
        .when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(True))
    )


def _plain(text: Column) -> Column:
    return F.translate(F.lower(text), PUNCTUATION, "")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(_plain(text), r"\s+"), lambda w: w != "")


def _beside(tokens: Column, at: int) -> Column:
    """First (1) or last (-1) word of a stretch; empty where it has none."""
    return F.transform(F.array(tokens), lambda t: F.coalesce(F.try_element_at(t, F.lit(at)), F.lit("")))[0]


def pattern_scores(edges: DataFrame, totals: DataFrame, steps: Steps) -> DataFrame:
    """pattern, kind, confidence of the high-confidence patterns. `edges`: pattern, value, kind (of a seed, else null); `totals`: pattern, n (occurrences of its word).

    Rounds go on until one accepts no value that was not accepted before. An accepted value counts as a seed does and stays accepted, so confidences only rise
    and the end does not depend on the order.
    """
    seeds = edges.where("kind IS NOT NULL").select("value", "kind").distinct()
    places = steps.write("edge-counts", edges.groupBy("pattern", "value").agg(F.count("*").alias("n")))
    accepted, k = steps.write("accepted-0", seeds), 0
    while True:
        support = places.join(accepted, "value").groupBy("pattern", "kind").agg(F.sum("n").alias("good"), F.count("*").alias("values"))
        scored = support.join(totals.withColumnRenamed("n", "all"), "pattern").where(F.col("values") >= MIN_SEEDS)
        scored = steps.write(f"patterns-{k}", scored.select("pattern", "kind", (F.col("good") / F.greatest("all", "good")).alias("confidence")))
        # A value's patterns speak together: 1 - product of (1 - confidence).
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        values = places.select("pattern", "value").join(scored, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        fresh = values.where(F.col("score") >= VALUE_CONFIDENCE).join(accepted, ["value", "kind"], "left_anti").join(seeds.select("value").distinct(), "value", "left_anti")
        fresh = steps.write(f"fresh-{k}", fresh.select("value", "kind"))
        if fresh.isEmpty():
            return scored.where(F.col("confidence") >= PATTERN_CONFIDENCE)
        accepted = steps.write(f"accepted-{k + 1}", accepted.unionByName(fresh))
        steps.drop(f"patterns-{k}", f"fresh-{k}", f"accepted-{k}")
        k += 1


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; spans of discovered values have the kinds context_email and so on.

    A discovered span stands beside a high-confidence pattern of its kind, has MIN_DIGITS digits or an @, and overlaps no base span. Null and empty
    texts have no spans (the hash of an empty list). Repeated rows stay repeated, and teach as often as they stand there; a null id is kept; further columns
    are neither read nor returned. Texts are read whole, whatever their length.
    """
    steps = Steps(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    digit, at = F.col("text").rlike("[0-9]"), F.contains("text", F.lit("@"))
    found = F.concat(
        matches("email", F.col("text"), EMAIL, at), matches("ip", F.col("text"), IP, digit), matches("card", F.col("text"), CARD, digit),
        matches("phone", F.col("text"), PHONE, F.contains("text", F.lit("+"))),
        matches("candidate", F.col("text"), CANDIDATE, digit | at, (lambda g: _beside(_tokens(g), -1), lambda g: _beside(_tokens(g), 1))),
    )
    # One scan of the texts: a row per text, with its matches.
    held = steps.write("matches", rows.select("row", "id", found.alias("found")))
    every = placed(held.select("row", F.inline("found")))
    every = steps.write("places", every.where(valid(F.col("kind"), F.col("value"))).drop("gap", "k"))
    base = every.where("kind <> 'candidate'").select("row", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    # A candidate's span without the marks at its edges.
    headed = F.regexp_replace("value", BEFORE, "")
    trimmed = F.reverse(F.regexp_replace(F.reverse(headed), AFTER, ""))
    lead = F.length("value") - F.length(headed)
    candidates = every.where("kind = 'candidate'").select("row", trimmed.alias("value"), "left", "right", (F.col("start") + lead).cast("long").alias("start"))
    candidates = candidates.withColumn("end", F.col("start") + F.length("value"))
    candidates = candidates.where((F.length(F.regexp_replace("value", "[^0-9]", "")) >= MIN_DIGITS) | F.col("value").rlike("[^@]@[^@]"))
    # Seeds: a candidate that covers or cuts a base span. Both lie in one text and overlap, so they share a hundred-character cell.
    cell = F.explode(F.sequence(F.floor(F.col("start") / 100), F.floor((F.col("end") - 1) / 100))).alias("cell")
    seed = base.select("row", F.col("kind").alias("seed"), F.col("start").alias("s"), F.col("end").alias("e"), cell)
    cut = candidates.select("row", "start", "end", cell).join(seed, ["row", "cell"]).where("s < end AND e > start")
    kinds = cut.groupBy("row", "start", "end").agg(F.min("seed").alias("kind"))
    candidates = steps.write("candidates", candidates.join(kinds, ["row", "start", "end"], "left"))

    edges = candidates.select("row", "start", "end", F.lower("value").alias("value"), "kind", F.explode(F.array(
        F.when(F.col("left") != "", F.concat(F.lit("<"), "left")), F.when(F.col("right") != "", F.concat(F.lit(">"), "right")))).alias("pattern")).where("pattern IS NOT NULL")
    edges = steps.write("edges", edges)
    # How often each pattern's word stands in the corpus at all. Words beside fewer than MIN_SEEDS values, seeds or not, can't be scored in any round and aren't counted.
    words = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= MIN_SEEDS)
    words = steps.write("words", words.select("pattern", F.substring("pattern", 2, 1 << 30).alias("word")))
    if words.isEmpty():
        extra = base.where(F.lit(False))
    else:
        spoken = rows.select(F.explode(_tokens(F.col("text"))).alias("word")).join(words.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("n"))
        totals = steps.write("totals", words.join(spoken, "word").select("pattern", "n"))
        good = pattern_scores(edges.select("pattern", "value", "kind"), totals, steps)
        marked = edges.where("kind IS NULL").join(good.withColumnRenamed("kind", "of"), "pattern")
        extra = marked.groupBy("row", "start", "end").agg(F.max_by("of", F.struct("confidence", "of")).alias("kind"))
        extra = extra.select("row", F.concat(F.lit("context_"), "kind").alias("kind"), "start", "end")
    return summaries(held.select("row", "id"), base.unionByName(extra), KINDS, id_column)
