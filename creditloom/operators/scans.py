"""Running sums and last values along an order, however many rows one key holds.

A key is cut into segments, a coarse step of its order such as the day; what each segment adds is aggregated once, carried over the segments, and the rows of a
segment go on from there. A segment with more rows than one task should hold is cut further: its rows are sorted over range partitions and
written, and each partition's stretch of it is a slice with a sum and last values of its own. So no task holds more than a segment or a slice of any key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import scratch_path

#: A segment of more rows is cut into slices.
ROWS_TOGETHER = 1 << 20
AT, SLICE = "scan_at", "scan_slice"
#: The partition stands above these bits of monotonically_increasing_id.
PLACE_BITS = 33


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sliced(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The rows, written in the order of `columns`, with their place in it and their slice. There are at most spark.sql.shuffle.partitions slices."""
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn(AT, F.monotonically_increasing_id())
    return written(ordered, "slices").withColumn(SLICE, F.shiftright(AT, PLACE_BITS))


def spread(df: DataFrame, keys: Sequence[str], rows: int, limit: int = ROWS_TOGETHER) -> DataFrame:
    """The rows dealt by the keys, about `limit` of all `rows` to a task, however many shuffle partitions the session has. Rows that fit one task are left to the session's own count."""
    pieces = -(-rows // limit)
    if pieces <= 1:
        return df.repartition(*keys)
    return df.repartition(max(pieces, df.sparkSession.sparkContext.defaultParallelism), *keys)


def matching(a: DataFrame, b: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Null-safe join on `columns`, which come from `a`."""
    b = b.select(*[F.col(c).alias(f"scan_of_{c}") if c in columns else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for c in columns:
        cond = cond & a[c].eqNullSafe(b[f"scan_of_{c}"])
    joined = a.join(b, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"scan_of_{c}" for c in columns])


def crowded(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """Values of `columns` with more than `limit` rows. Only first columns with as many rows are looked at more closely."""
    first = df.groupBy(columns[0]).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(columns[0])
    if first.isEmpty():
        return df.select(*columns).limit(0)
    return matching(df.select(*columns), first, columns[:1], "left_semi").groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*columns)


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], segment: str | None = None, sums: dict[str, Column] | None = None, lasts: dict[str, str] | None = None, limit: int = ROWS_TOGETHER,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The rows with, per key and along `segment` and then `order`, running sums (`sums`: name, amount) and last known values (`lasts`: name, column), the row's own included.

    Without a segment, a key is one. With one, `order` must be ascending. Rows that `order` leaves tied come in any order, which is the same for all columns. Null keys are a key.
    `counted`: the same keys, where `df` has been spread so that the rows of one key lie together; it is cheaper to count, and the rows are not spread again.
    """
    sums, lasts = sums or {}, lasts or {}
    group = [*keys, *([segment] if segment else [])]
    names = [*sums, *lasts]

    def ends(rows: DataFrame, by: Sequence[str], place: Column) -> DataFrame:
        known = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place))
        return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(a).alias(n) for n, a in sums.items()], *[known(c).alias(n) for n, c in lasts.items()])

    def carried(found: DataFrame, within: Sequence[str], steps: Sequence[str]) -> DataFrame:
        before = Window.partitionBy(*within).orderBy(*steps).rowsBetween(Window.unboundedPreceding, -1)
        return found.select(*within, *steps, *[F.sum(n).over(before).alias(f"{n}_before") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in lasts])

    def run(rows: DataFrame, by: Sequence[str], along: Sequence[Column]) -> DataFrame:
        # Spread by the keys, then sorted by a hash of them first: rows of different keys are told apart by one number.
        rows = rows if counted is not None else rows.repartition(*by)
        here = Window.partitionBy(F.xxhash64(*by), *by).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
        # A sum is null while all amounts so far are null.
        running = lambda n, a: F.coalesce(F.col(f"{n}_before") + F.coalesce(F.sum(a).over(here), F.lit(0)), F.sum(a).over(here), F.col(f"{n}_before"))
        return rows.select(
            *df.columns, *[running(n, a).alias(n) for n, a in sums.items()],
            *[F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"{n}_before")).alias(n) for n, c in lasts.items()])

    if segment:
        of_segments = written(ends(df, group, F.struct(*order)), "segments")
        hot = of_segments.where(F.col("n") > limit).select(*group)
        rows = matching(df, carried(of_segments, keys, [segment]), group, "inner")
    else:
        hot = crowded(df if counted is None else counted, keys, limit)
        rows = df.withColumns({f"{n}_before": F.lit(None).cast(df.schema[c].dataType) for n, c in lasts.items()} | {f"{n}_before": F.lit(None).cast(df.select(F.sum(a)).schema[0].dataType) for n, a in sums.items()})
    if hot.isEmpty():
        return run(rows, group, order)
    # What a hot segment starts from is a value of its rows already; its slices add to that.
    slices = sliced(matching(rows, hot, group, "left_semi"), [*[F.col(c) for c in group], *order])
    starts = slices.select(*df.columns, *[F.col(f"{n}_before").alias(f"{n}_start") for n in names], AT, SLICE)
    steps = carried(ends(starts, [*group, SLICE], F.col(AT)).drop("n"), group, [SLICE])
    inside = matching(starts, steps, [*group, SLICE], "inner")
    both = [(F.coalesce(F.col(f"{n}_start") + F.coalesce(f"{n}_before", F.lit(0)), F.col(f"{n}_before")) if n in sums else F.coalesce(f"{n}_before", f"{n}_start")).alias(f"{n}_before") for n in names]
    inside = inside.select(*df.columns, AT, SLICE, *both)
    return run(matching(rows, hot, group, "left_anti"), group, order).unionByName(run(inside, [*group, SLICE], [F.col(AT)]))
