"""Running sums and last values, with and without hot segments, against a plain loop."""

import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from creditloom.operators import ledger as L
from creditloom.operators import scans
from creditloom.operators.scans import AT, SLICE, crowded, scan, sliced


def made(spark, n=600, hot=400):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.1 else rng.randrange(4), rng.randrange(5), i, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, None, f"v{i}"])) for i in range(n)]
    rows += [(2, 3, n + i, 1, f"h{i}" if i % 97 == 0 else None) for i in range(hot)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key long, day long, id long, amount long, v string").repartition(5)


def plain_scan(rows, key, order):
    out, sums, lasts = [], {}, {}
    for r in sorted(rows, key=order):
        k = key(r)
        if r[3] is not None:
            sums[k] = sums.get(k, 0) + r[3]
        if r[4] is not None:
            lasts[k] = r[4]
        out.append((*r, sums.get(k), lasts.get(k)))
    return sorted(map(str, out))


@pytest.mark.parametrize("limit", [20, 100, 1 << 20])
def test_scan_over_segments(spark, limit):
    rows, df = made(spark)
    got = scan(df, ["key"], [F.col("id")], "day", sums={"run": F.col("amount")}, lasts={"last_v": "v"}, limit=limit)
    assert sorted(map(str, map(tuple, got.collect()))) == plain_scan(rows, lambda r: r[0], lambda r: (r[1], r[2]))


@pytest.mark.parametrize("limit", [20, 1 << 20])
def test_scan_without_segments_downwards(spark, limit):
    rows, df = made(spark)
    got = scan(df, ["key", "day"], [F.col("id").desc()], sums={"run": F.col("amount")}, lasts={"last_v": "v"}, limit=limit)
    assert sorted(map(str, map(tuple, got.collect()))) == plain_scan(rows, lambda r: r[:2], lambda r: -r[2])


def test_empty_table(spark):
    _, df = made(spark)
    assert scan(df.limit(0), ["key"], [F.col("id")], "day", sums={"run": F.col("amount")}).collect() == []


def test_crowded_keys(spark):
    rows, df = made(spark)
    want = {k for k, n in Counter(r[:2] for r in rows).items() if n > 50}
    assert {tuple(r) for r in crowded(df, ["key", "day"], 50).collect()} == want
    assert crowded(df, ["key", "day"], 10_000).count() == 0


def test_a_hot_day_is_spread_evenly(spark):
    hot = spark.range(40_000).select(F.lit(1).alias("key"), F.lit(1).alias("day"), F.col("id"), F.lit(1).alias("amount")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sliced(hot, [F.col(c) for c in ("key", "day", "id")])
        sizes = [r["count"] for r in rows.groupBy(SLICE).count().collect()]
        assert len(sizes) > 4 and max(sizes) <= 2 * median(sizes)
        order = [r.id for r in rows.orderBy(AT).collect()]
        assert order == list(range(40_000))
        run = scan(hot, ["key"], [F.col("id")], "day", sums={"run": F.col("amount")}, limit=100).where("run <> id + 1")
        assert run.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_circular_pairs_of_a_hot_party_day(spark, monkeypatch):
    rng = random.Random(11)
    rows = [("c", f"t{i:05d}", f"2024-01-0{rng.randrange(1, 4)}", *rng.choice([(rng.randrange(100, 999_999), 0), (0, rng.randrange(100, 999_999))]), 0, "n", "Hot Party") for i in range(1500)]
    df = spark.createDataFrame([(*r[:2], __import__("datetime").date.fromisoformat(r[2]), *r[3:]) for r in rows], "company_id string, txn_id string, txn_date date, debit long, credit long, balance long, narration string, party string")
    df = df.withColumns({c: (F.col(c) / 100).cast("decimal(18,2)") for c in ("debit", "credit", "balance")})
    calm = sorted(map(tuple, L.circular_pairs(df).collect()))
    seen = []
    plain = scans.crowded
    monkeypatch.setattr(scans, "crowded", lambda d, c, limit: seen.append(1) or plain(d, c, 100))
    assert sorted(map(tuple, L.circular_pairs(df).collect())) == calm and seen
    low_high = [(r[1], r[3] * 98, r[3] * 102, r[2]) for r in rows if r[3]]
    want = set()
    for t, low, high, day in low_high:
        found = [(d, c, x) for x, d, c in ((r[1], r[2], r[4]) for r in rows if r[4]) if low <= c * 100 and day <= d <= f"{day[:-1]}{int(day[-1]) + 3}"]
        first = [min((c, x) for d2, c, x in found if d2 == d) for d in sorted({d for d, _, _ in found})]
        good = [x for c, x in first if c * 100 <= high]
        if good:
            want.add((t, good[0]))
    assert {(r[1], r[2]) for r in calm} == want and len(want) > 300


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_auc_of_scores_that_lie_close_together(spark, limit):
    from creditloom.operators.ml import auc

    rng = random.Random(12)
    rows = [(0.5 + rng.randrange(400) * 1e-9, float(rng.random() < 0.4)) for _ in range(600)]
    wins = sum((a > b) + 0.5 * (a == b) for a, y in rows if y for b, z in rows if not z)
    want = wins / (sum(y for _, y in rows) * sum(1 - y for _, y in rows))
    assert auc(spark.createDataFrame(rows, "score double, label double"), limit=limit).head()[0] == pytest.approx(want, abs=1e-6)
