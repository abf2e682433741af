"""Ledger jobs on small ledgers, against hand values and brute force."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditloom.operators import ledger as L

SCHEMA = "company_id long, txn_id string, txn_date date, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), narration string, party string"


def row(i, day, debit=0, credit=0, party="acme", narration="NEFT", company=1, balance=None):
    dec = lambda x: None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))
    return (company, f"t{i:05d}", day, dec(debit), dec(credit), dec(balance), narration, party)


def ledger(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def march(day):
    return dt.date(2025, 3, day)


def test_window_dressing_hand_case(spark):
    df = ledger(spark, [row(1, march(2), credit=200000), row(2, march(10), credit=250000), row(3, march(20), credit=1500000), row(4, march(27), credit=1800000)])
    got = L.ledger_totals(df, ["company_id"]).first()
    assert got.year_end_window_dressing is True
    assert got.banking_turnover == 3750000.0


@pytest.mark.parametrize("early,late,expected", [(0, 0, False), (0, 1, True), (100, 300, False), (100, 300.01, True)])
def test_window_dressing_bounds(spark, early, late, expected):
    df = ledger(spark, [row(1, march(15), credit=early), row(2, march(16), credit=late), row(3, dt.date(2025, 4, 20), credit=10**6)])
    assert L.window_dressing(df, ["company_id"]).first().year_end_window_dressing is expected


@pytest.mark.parametrize("cash,other,expected", [(35, 65, "SUSPICIOUS"), (36, 64, "ALARMING"), (20, 80, "NORMAL"), (21, 79, "SUSPICIOUS"), (0, 0, "NORMAL")])
def test_cash_pattern_bounds(spark, cash, other, expected):
    df = ledger(spark, [row(1, march(1), debit=cash, narration="Cash withdrawal"), row(2, march(1), debit=other)])
    assert L.cash_pattern(df).first().cash_pattern == expected


def test_average_balance_skips_missing(spark):
    df = ledger(spark, [row(1, march(1), balance=100), row(2, march(2), balance=None), row(3, march(3), balance=300), row(4, dt.date(2025, 4, 1), balance=50)])
    assert L.average_monthly_balance(df).first().average_monthly_balance == 125.0


def brute_pairs(rows):
    found = {}
    for d in rows:
        if d[3] <= 0 or not (d[7] or "").strip():
            continue
        best = None
        for c in rows:
            if c[4] > 0 and c[0] == d[0] and (c[7] or "").strip().lower() == d[7].strip().lower():
                if d[2] <= c[2] <= d[2] + dt.timedelta(days=3) and d[3] * Decimal("0.98") <= c[4] <= d[3] * Decimal("1.02"):
                    key = (c[2], c[4], c[1])
                    best = key if best is None or key < best else best
        if best:
            found[(d[0], d[1])] = best[2]
    return found


def test_circular_pairs_match_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(1200):
        amount = rng.choice([100, 98, 102, 97.99, 102.01, 5000, 5100, 4900, round(rng.uniform(90, 110), 2), round(rng.uniform(4800, 5200), 2)])
        day = march(1) + dt.timedelta(days=rng.randrange(12))
        party = rng.choice(["Acme", " acme ", "ACME", "beta", None, "", "  "])
        side = rng.random()
        rows.append(row(i, day, debit=amount if side < 0.55 else 0, credit=amount if side > 0.45 else 0, party=party, company=rng.choice([1, 1, 1, 2])))
    got = {(r.company_id, r.debit_txn_id): r.credit_txn_id for r in L.circular_pairs(ledger(spark, rows), cap=10**6).collect()}
    assert got == brute_pairs(rows)
    assert len(got) > 100


def test_one_party_one_day_holds_everything(spark):
    """Copies on one party and day fold, so the work does not grow with their product."""
    rows = [row(i, march(5), debit=500) for i in range(4000)] + [row(10000 + i, march(6), credit=505) for i in range(4000)]
    got = L.matched_debits(ledger(spark, rows))
    assert got.count() == 4000
    assert got.select("first.hit.txn_id").distinct().collect()[0][0] == "t10000"


def test_all_pairs_unless_a_report_asks_for_fewer(spark):
    rows = [row(i, march(1 + i % 20), debit=1000) for i in range(80)] + [row(500 + i, march(1 + i), credit=1000) for i in range(25)]
    got = L.circular_pairs(ledger(spark, rows))
    assert got.count() == 80
    assert L.circular_pairs(ledger(spark, rows), cap=50).count() == 50


def test_missing_party_never_pairs(spark):
    df = ledger(spark, [row(1, march(1), debit=10, party=None), row(2, march(1), credit=10, party=None)])
    assert L.circular_pairs(df).count() == 0


def test_round_transfers(spark):
    df = ledger(spark, [row(1, march(1), debit=100000, party=None), row(2, march(1), debit=300000, party="GST office"), row(3, march(2), debit=100000.5), row(4, march(3), debit=2500000, party="zed")])
    lines = [r.finding for r in L.round_transfers(df).orderBy("rank_no").collect()]
    assert lines == ["2025-03-01: round transfer ₹100,000 to Unknown", "2025-03-03: round transfer ₹2,500,000 to zed"]


def test_running_balance_and_fill(spark):
    rng = random.Random(3)
    rows = [row(i, march(1) + dt.timedelta(days=rng.randrange(20)), debit=rng.randrange(50), credit=rng.randrange(50), balance=rng.choice([None, i]), company=rng.choice([1, 2])) for i in range(400)]
    df = ledger(spark, rows)
    run = {r.txn_id: r.running_balance for r in L.running_balance(df, "10.00").collect()}
    fill = {r.txn_id: r.balance_filled for r in L.filled_balance(df).collect()}
    for company in (1, 2):
        total, last = Decimal("10.00"), None
        for r in sorted((x for x in rows if x[0] == company), key=lambda x: (x[2], x[1])):
            total += r[4] - r[3]
            last = r[5] if r[5] is not None else last
            assert run[r[1]] == float(total)
            assert fill[r[1]] == (None if last is None else float(last))


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [row(i, march(1 + rng.randrange(28)), debit=rng.choice([0, 100, 101]), credit=rng.choice([0, 100, 99]), company=rng.choice([1, 2, 3])) for i in range(600)]
    runs = [sorted(map(tuple, L.circular_pairs(ledger(spark, rows).repartition(n)).collect())) for n in (1, 7, 32)]
    assert runs[0] == runs[1] == runs[2]


def test_clean_ledger_drops_bad_dates(spark):
    raw = spark.createDataFrame(
        [(1, "a", "2025-01-31", "1,2", None, "x", "n", "p"), (1, "b", "31/01/2025", "5", None, None, "n", "p"), (1, "c", None, "5", None, None, "n", "p")],
        "company_id long, txn_id string, date_text string, debit_text string, credit_text string, balance_text string, narration string, party string")
    got = L.clean_ledger(raw).collect()
    assert [r.txn_id for r in got] == ["a"]
    assert got[0].debit == 0 and got[0].credit == 0 and got[0].balance is None


def test_plan_has_no_pair_product(spark):
    plan = L.circular_pairs(ledger(spark, [row(1, march(1), debit=1)]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rank_filter_runs_before_the_shuffle(spark):
    df = ledger(spark, [row(1, march(1), debit=1, narration="EMI")])
    assert "WindowGroupLimit" in L.emi_payments(df, cap=1)._jdf.queryExecution().executedPlan().toString()
    assert L.emi_payments(df.withColumn("narration", F.lit(None).cast("string"))).count() == 0


def test_bank_profile_builds_the_ledger_once(spark):
    """Every line is built once, though the sums and the circular pairs both read it; one that pairs and one without a party are among them."""
    from decimal import Decimal

    rows = [
        (1, "a", "2024-01-01", Decimal("100.00"), Decimal("0.00"), Decimal("5.00"), "pay", "X"), (1, "b", "2024-01-02", Decimal("0.00"), Decimal("101.00"), None, "in", "x "),
        (1, "c", "2024-01-02", Decimal("0.00"), Decimal("101.00"), None, "in", "x"), (2, "d", "2024-01-03", Decimal("7.00"), Decimal("0.00"), Decimal("9.00"), "cash", None)]
    plain = spark.createDataFrame(rows, "company_id long, txn_id string, day string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), narration string, party string")
    built = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    ledger = plain.select("company_id", "txn_id", F.to_date("day").alias("txn_date"), "debit", "credit", "balance", "narration", "party")
    ledger = ledger.mapInArrow(counted, ledger.schema)
    none = spark.createDataFrame([], "company_id long, annual_revenue double")
    got = L.bank_profile(spark.createDataFrame([(1,), (2,), (3,)], "company_id long"), ledger, none, none.withColumnRenamed("annual_revenue", "tax_turnover"))
    found = {r.company_id: (r.has_ledger, r.pair_count, r.pair_value, r.banking_turnover) for r in got.collect()}
    assert found == {1: (True, 1, 101.0, 202.0), 2: (True, 0, 0.0, 0.0), 3: (False, 0, 0.0, 0.0)}
    assert built.value == len(rows)


def test_bank_profile_builds_no_ids(spark):
    """No column of the profile needs the ids of the lines: they are neither built nor written, and the pairs are still counted."""
    from creditloom.operators import scans

    df = ledger(spark, [row(1, march(1), debit=100), row(2, march(2), credit=101), row(3, march(2), credit=101), row(4, march(9), credit=100)])
    df = df.withColumn("txn_id", F.raise_error(F.lit("ids built")).cast("string"))
    none = spark.createDataFrame([], "company_id long, annual_revenue double")
    got = L.bank_profile(df.select("company_id").distinct(), df, none, none.withColumnRenamed("annual_revenue", "tax_turnover")).first()
    assert (got.pair_count, got.pair_value, got.banking_turnover, got.has_ledger) == (1, 101.0, 302.0, True)
    assert scans.written(L.circular_pairs(L.numbered(df.drop("txn_id"))), "pairs").first().amount == 101.0


def test_pairs_of_null_companies_and_ids(spark):
    """A null company is a key, a null id is the smallest; the texts come from the chosen credit. Lines without a date never pair."""
    undated = [row(8, None, debit=100), row(9, None, credit=100)]
    assert L.circular_pairs(ledger(spark, undated)).count() == 0
    rows = [row(1, march(1), debit=100, company=None), row(2, march(1), credit=100, company=None), row(3, march(1), credit=100, company=None, party=" ACME ")]
    df = ledger(spark, rows).withColumn("txn_id", F.when(F.col("txn_id") != "t00003", F.col("txn_id")))
    got = [(r.company_id, r.debit_txn_id, r.credit_txn_id, r.party) for r in L.circular_pairs(df).collect()]
    assert got == [(None, "t00001", None, " ACME ")]
    totals = L.ledger_totals(df, ["company_id"]).collect()
    assert [(r.company_id, r.banking_turnover, str(r.first_month)) for r in totals] == [(None, 200.0, "2025-03-01")]


def test_returning_debits_meet_credits_across_blocks_of_days(spark):
    """A line travels once per block of days, not once per day that its debit looks into; matches across the blocks' borders stay."""
    start, rows, dice = dt.date(2024, 1, 1), [], random.Random(5)
    for i in range(240):
        amount, kind = Decimal(100 + dice.randint(0, 4)), dice.randint(0, 2)
        sides = [(amount, Decimal(0)), (Decimal(0), amount), (amount, 2 * amount)][kind]
        rows.append((dice.randint(0, 1), i, start + dt.timedelta(days=dice.randint(0, 59)), *sides, f"P{dice.randint(0, 1)}"))
    df = spark.createDataFrame(rows, "company_id long, line long, txn_date date, debit decimal(18,2), credit decimal(18,2), party string")
    found = L.returning_debits(df)
    want = []
    for company, line, day, debit, _, party in rows:
        fits = [(d, c) for k, _, d, _, c, p in rows if (k, p) == (company, party) and c > 0 and 0 <= (d - day).days <= 3 and debit > 0 and debit * Decimal("0.98") <= c <= debit * Decimal("1.02")]
        if fits:
            want.append((line, company, party.lower(), min(fits)[0], int(min(fits)[1] * 100)))
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(w[3] != rows[w[0]][2] for w in want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "block" in next(x for x in plan.split("\n")[::-1] if "hashpartitioning" in x)


def test_lines_of_circular_payments_are_dealt_by_their_number(spark):
    """With a limit of 5 lines a task, 200 lines go to 40 tasks, though the session has 8 shuffle partitions; the pairs stay the same."""
    rows = [row(i, march(1 + i % 25), debit=100 if i % 2 else 0, credit=0 if i % 2 else 101, party=f"p{i // 2 % 2}", company=i % 3) for i in range(200)]
    df = L.numbered(ledger(spark, rows).drop("txn_id"))
    found = L.returning_debits(df, limit=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[company_id#\d+L?, party_key#\d+, block#\d+L?\], (\d+)", plan) == ["40"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, L.returning_debits(df).collect())) != []
