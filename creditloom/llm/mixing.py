"""Mixing of sources to target weights by a low-discrepancy schedule; DataFrame functions only.

The mix is a row of slots of equal numbers of words. Slot k is given the golden-ratio point frac(k / phi); the cumulative weights of
the sources say whose it is, so any stretch of slots holds the sources close to their weights. A source's r-th slot takes
the r-th block of that source's documents in shuffled order, from the first block again after the last. A document gives the words that
its blocks cover, as often as they are taken. A source too small for the common block has smaller blocks of its own, taken in even steps along the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.shared import Steps

WORD = r"[^\x20\x09-\x0D]+"
# Fixed values of the mix.
WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST_EPOCHS = 2
#: 2^32 divided by the golden ratio, as a whole number: slot k's point is k * GOLDEN modulo 2^32.
GOLDEN = 2654435769
UNIT = 1 << 32
SLOTS = 1 << 18
#: A source whose target is under so many common blocks gets blocks of its own size: at least so many of them, or one of each word.
LEAST_BLOCKS = 1 << 10
SLOTS_PER_CHUNK = 1 << 10
CELLS = 1 << 10
SEED = "mix-1"


def source_targets(sizes: DataFrame) -> DataFrame:
    """pos (1, 2, ... by code point, null last), source, source_size, weight, target. `sizes` has source and size.

    Targets share TOTAL times all words by weight; those above MOST_EPOCHS times their source stop there and the excess is shared by weight among the rest.
    In the order of MOST_EPOCHS * size / weight the sources that stop come first, so one pass over running sums finds them.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("pos") - 1) % len(WEIGHTS) + 1).cast("int"))
    listed = sums.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    cap = F.col("source_size") * MOST_EPOCHS
    order = Window.orderBy(cap / F.col("weight"), "pos")
    every, before = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.col("all_words") * TOTAL - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    marked = listed.withColumn("all_words", F.sum("source_size").over(every)).withColumn("stops", cap / F.col("weight") <= share)
    stopped = F.sum(F.when(F.col("stops"), cap).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("stops"), cap.cast("double")).otherwise((F.col("all_words") * TOTAL - stopped) * F.col("weight") / open_weight)
    return marked.select("pos", "source", "source_size", "weight", target.alias("target"))


def _before(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def block_sizes(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`targets` with all (the sum of targets), common (words of a slot), small (whether the source has blocks of its own) and block_words."""
    total = F.sum("target").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sized = targets.withColumn("all", total).withColumn("common", F.greatest(F.ceil(F.col("all") / slots), F.lit(1)).cast("long"))
    sized = sized.withColumn("small", F.col("target") < F.col("common") * LEAST_BLOCKS)
    own = F.greatest(F.floor(F.col("target") / LEAST_BLOCKS), F.lit(1)).cast("long")
    return sized.withColumn("block_words", F.when(F.col("small"), own).otherwise(F.col("common")))


def slot_schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, pos, rank (0, 1, ... among the source's slots), block, epoch and block_words, the words of the source's blocks.

    The number of slots is fixed, so the table has the same size for any input, but for the small sources: each has fewer than 2 * LEAST_BLOCKS blocks of its own,
    in even steps, and slot says where they stand. Slots beyond a source's last epoch stay empty and are left out.
    """
    spark = targets.sparkSession
    ranges = block_sizes(targets, slots).withColumn("low", _before("target", Window.orderBy("pos"))).where("target > 0")
    n_slots = F.ceil(F.col("all") / F.col("common")).cast("long")
    few = ranges.where("small").withColumn("n", F.round(F.col("target") / F.col("block_words")).cast("long")).where("n > 0")
    few = few.select("pos", "source_size", "block_words", "n", n_slots.alias("n_slots"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rank"))
    few = few.select(F.floor((2 * F.col("rank") + 1) * F.col("n_slots") / (2 * F.col("n"))).alias("slot"), "pos", "source_size", "block_words", "rank")
    ranges = ranges.where("NOT small")
    ranges = ranges.withColumns({"first": F.col("low") / F.col("all") * UNIT, "last": (F.col("low") + F.col("target")) / F.col("all") * UNIT})
    ranges = ranges.withColumn("n_slots", n_slots)
    width = UNIT // CELLS
    cells = F.explode(F.sequence(F.floor(F.col("first") / width), F.least(F.floor(F.col("last") / width), F.lit(CELLS - 1)))).alias("cell")
    ranges = ranges.select("pos", "source_size", "block_words", "n_slots", "first", "last", cells)
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(UNIT))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"), F.floor(point / width).alias("cell"), F.floor(F.col("id") / SLOTS_PER_CHUNK).alias("chunk"))
    owned = points.join(ranges, "cell").where("slot < n_slots AND point >= first AND point < last")
    # Ranks in two steps, so that no window holds all slots of a source.
    counts = owned.groupBy("pos", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("pos", "chunk", _before("n", Window.partitionBy("pos").orderBy("chunk")).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("pos", "chunk").orderBy("slot")) - 1
    ranked = owned.join(counts, ["pos", "chunk"]).withColumn("rank", F.col("earlier") + within)
    ranked = ranked.select("slot", "pos", "source_size", "block_words", "rank").unionByName(few)
    blocks = F.ceil(F.col("source_size") / F.col("block_words"))
    ranked = ranked.withColumns({"block": F.col("rank") % blocks, "epoch": F.floor(F.col("rank") / blocks)})
    return ranked.where(F.col("epoch") < MOST_EPOCHS).select("slot", "pos", "rank", "block", "epoch", "block_words")


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", slots: int = SLOTS, seed: str = SEED, order_column: str | None = None) -> DataFrame:
    """One row per row of `docs`: id, size (words), source_size, target (its source's words in the mix) and taken (words the mix takes from the row, repeats counted).

    Null and empty texts have size 0 and give nothing. A null source is a source of its own, after the others. A source's order of documents follows the
    md5 of the seed and the id (or `order_column`), so reruns agree; rows of one id are put in order of size. A null id is kept. Further columns are neither read
    nor returned; an empty table gives no rows. taken is at most MOST_EPOCHS * size, and a source's sum of it differs from its target by a few blocks, each a small part of the target (LEAST_BLOCKS) or one word.
    """
    steps = Steps(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(order_column or id_column).cast("string"), F.lit(""))))
    sized = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), size.alias("size"), key.alias("key"))
    sized = steps.write("sizes", sized.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.substring("key", 1, 3)))
    targets = steps.write("targets", block_sizes(source_targets(sized), slots).select("pos", "source", "source_size", "target", "block_words"))
    schedule = steps.write("schedule", slot_schedule(targets.drop("block_words"), slots))
    rows = sized.join(targets.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    # Place of each document among its source's words: sums over hash buckets, then within a bucket.
    buckets = rows.groupBy("pos", "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.select("pos", "bucket", _before("in_bucket", Window.partitionBy("pos").orderBy("bucket")).alias("earlier"))
    placed = rows.withColumn("inside", _before("size", Window.partitionBy("pos", "bucket").orderBy("key", "size", "row"))).join(buckets, ["pos", "bucket"])
    placed = placed.select("row", "id", "pos", "size", "source_size", "target", "block_words", (F.col("earlier") + F.col("inside")).alias("start"))
    used = schedule.groupBy("pos", "block").agg(F.count("*").alias("times"))
    words = F.col("block_words")
    begin, end = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    cut = placed.where("size > 0").select("row", "pos", "start", "size", "block_words", F.explode(F.sequence(begin, end)).alias("block"))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words) - F.greatest(F.col("start"), F.col("block") * words)
    taken = cut.join(used, ["pos", "block"]).groupBy("row").agg(F.sum(part * F.col("times")).alias("taken"))
    out = placed.join(taken, "row", "left")
    return out.select(F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it: taken / size, rounded half up, so 0, 1 or 2 times.

    Each row counts by itself, through a written number of its own: rows that share an id, and rows with a null id, are taken as the mix takes them. Rows
    without words are not taken; an empty table gives no rows.
    """
    rows, key = Steps(docs.sparkSession, "mixed").keyed("rows", docs)
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    shares = mix_sources(rows, key, text_column, order_column=id_column, **options).where("size > 0")
    wanted = shares.select(F.col(key).alias("__row"), copies.alias("__copies")).where("__copies > 0")
    taken = rows.join(wanted, rows[key] == wanted["__row"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*[rows[c] for c in docs.columns])
