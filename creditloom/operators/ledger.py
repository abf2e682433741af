"""Bank ledger jobs: cleaning, payment patterns, circular pairs, the one-row profile."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.values import floor_one, round_to
from creditloom.operators.scans import ROWS_TOGETHER, matching, scan, spread, written

CENTS = "decimal(18,2)"

# Narration and party words, and their thresholds.
EMI_WORDS = "(?i)emi|ecs|nach|loan"
CASH_WORDS = "(?i)cash|atm"
ROUTINE_PARTIES = "(?i)bank|gst|salary|tax"
ROUND_MULTIPLE = 100_000
#: Days of one company and party that circular payments are looked for in together.
DAYS_TOGETHER = 16
EMI_CONFIDENCE = 0.75


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str = "rank_no") -> DataFrame:
    """First n rows per key, numbered; without n all rows. The rank filter runs before the shuffle too, so a hot key sends n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def at_most(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """First n rows per key for a report; without n the rows as they are, unordered and unnumbered."""
    return df if n is None else first_n(df, keys, order, n)


def is_emi() -> Column:
    return (F.col("debit") > 0) & F.col("narration").rlike(EMI_WORDS)


def is_round_transfer(multiple: int = ROUND_MULTIPLE) -> Column:
    routine = F.coalesce(F.col("party"), F.lit("")).rlike(ROUTINE_PARTIES)
    return (F.col("debit") > 0) & (F.col("debit") % multiple == 0) & ~routine


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Text ledger to typed rows: rows without a readable date go, missing amounts are zero."""
    zero = F.lit(Decimal("0.00")).cast(CENTS)
    return (
        raw.select(
            "company_id",
            "txn_id",
            F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd")).cast("date").alias("txn_date"),
            F.coalesce(F.col("debit_text").try_cast(CENTS), zero).alias("debit"),
            F.coalesce(F.col("credit_text").try_cast(CENTS), zero).alias("credit"),
            F.col("balance_text").try_cast(CENTS).alias("balance"),
            "narration",
            "party",
        ).filter(F.col("txn_date").isNotNull())
    )


def emi_payments(ledger: DataFrame, cap: int | None = None) -> DataFrame:
    kept = at_most(ledger.filter(is_emi()), ["company_id"], [F.col("txn_date"), F.col("txn_id")], cap)
    return kept.select(
        "company_id",
        "txn_id",
        "txn_date",
        F.nullif("party", F.lit("")).alias("lender"),
        round_to(F.col("debit").cast("double"), 2).alias("amount"),
        F.lit(EMI_CONFIDENCE).alias("confidence"),
    )


def round_transfers(ledger: DataFrame, multiple: int = ROUND_MULTIPLE, cap: int | None = None) -> DataFrame:
    kept = first_n(ledger.filter(is_round_transfer(multiple)), ["company_id"], [F.col("txn_date"), F.col("txn_id")], cap)
    line = F.concat(
        F.col("txn_date").cast("string"),
        F.lit(": round transfer ₹"),
        F.format_number(F.col("debit"), 0),
        F.lit(" to "),
        F.coalesce(F.nullif("party", F.lit("")), F.lit("Unknown")),
    )
    return kept.select("company_id", "txn_id", F.col("rank_no").cast("bigint").alias("rank_no"), line.alias("finding"))


def _party_key() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("party"), F.lit(""))))


def numbered(ledger: DataFrame) -> DataFrame:
    """The ledger written with a number per row (`line`), so that what reads it several times builds it once."""
    return written(ledger.withColumn("line", F.monotonically_increasing_id()), "ledger-lines")


def returning_debits(ledger: DataFrame, tolerance: str = "0.02", days: int = 3, limit: int = ROWS_TOGETHER) -> DataFrame:
    """Each line of a `numbered` ledger whose debit comes back: `line`, `company_id`, `party_key`, and day and cents of the first credit of that party within the days and the amount band.

    No pairs are built. Lines travel by party and block of days; there, a row per credit and a row per debit and day that it looks into are sorted per party and day from the largest amount down. The last credit
    that a debit has seen on the way is the smallest one not below its lower bound, which is the match if it also lies below the upper bound.
    Only numbers and the party travel: a credit is known by its party, day and cents. About `limit` lines go to a task, so that what it sorts stays in memory.
    """
    low, high = Decimal(1) - Decimal(tolerance), Decimal(1) + Decimal(tolerance)
    # Whole cents: a credit lies in the band exactly if its cents lie between the bounds' cents, the lower rounded up, the upper down.
    lines = ledger.select(
        "company_id", "line", "txn_date", _party_key().alias("party_key"), _cents("credit").alias("credit_at"),
        F.when(F.col("debit") > 0, F.ceil(F.col("debit") * F.lit(100 * low)).cast("bigint")).alias("debit_from"), F.when(F.col("debit") > 0, F.floor(F.col("debit") * F.lit(100 * high)).cast("bigint")).alias("debit_to"),
    ).filter((F.col("party_key") != "") & F.col("txn_date").isNotNull() & (F.col("debit_from").isNotNull() | F.col("credit_at").isNotNull()))
    # Steps of a line: -1 is its credit, 0 and up the days that its debit looks into. A line travels once per block of days that it has a step in, and gets its steps there.
    steps = lambda first, last: F.array(*[F.lit(i) for i in range(first, last + 1)])
    step, debit, credit = F.col("step"), F.col("debit_from").isNotNull(), F.col("credit_at").isNotNull()
    block = lambda day: F.floor(F.unix_date(day) / DAYS_TOGETHER)
    blocks = F.sequence(block(F.col("txn_date")), F.when(debit, block(F.date_add("txn_date", days))).otherwise(block(F.col("txn_date"))))

    def stepped(of: DataFrame) -> DataFrame:
        of = of.withColumn("step", F.explode(F.when(debit & credit, steps(-1, days)).when(credit, steps(-1, -1)).otherwise(steps(0, days))))
        return of.withColumn("day", F.date_add("txn_date", F.greatest(step, F.lit(0))))

    dealt = spread(lines.withColumn("block", F.explode(blocks)), ["company_id", "party_key", "block"], ledger.count(), limit)
    entries = stepped(dealt).filter(block(F.col("day")) == F.col("block")).select(
        "company_id", "party_key", "block", "day", F.when(step < 0, F.col("credit_at")).otherwise(F.col("debit_from")).alias("place"),
        F.when(step < 0, F.col("credit_at")).alias("credit_cents"), F.when(step >= 0, F.col("line")).alias("looking"), F.when(step >= 0, F.col("debit_to")).alias("most"))
    counted = stepped(lines).select("company_id", "party_key", block(F.col("day")).alias("block"), "day")
    keys = ["company_id", "party_key", "block", "day"]
    seen = scan(entries, keys, [F.col("place").desc(), F.col("looking").asc_nulls_first()], lasts={"cents": "credit_cents"}, counted=counted)
    hits = seen.filter(F.col("looking").isNotNull() & (F.col("cents") <= F.col("most")))
    best = hits.groupBy(F.col("looking").alias("line")).agg(F.min(F.struct("day", "cents")).alias("b"), F.first("company_id").alias("company_id"), F.first("party_key").alias("party_key"))
    return best.select("line", "company_id", "party_key", "b.*")


def _cents(amount: str) -> Column:
    return F.when(F.col(amount) > 0, (F.col(amount) * 100).cast("bigint"))


def matched_debits(ledger: DataFrame, tolerance: str = "0.02", days: int = 3) -> DataFrame:
    """Each debit that comes back, and the first credit of the same party within the days and the amount band.

    Same-day candidates are taken by smallest amount, then smallest id. One pass over the ledger writes its lines, unless they are `numbered` already; the debits that come back
    are written, and the lines are then read for the texts and ids of these alone.
    """
    used = ["company_id", "txn_id", "txn_date", "debit", "credit", "narration", "party"]
    lines = ledger if "line" in ledger.columns else numbered(ledger.select(*used).filter((_party_key() != "") & ((F.col("debit") > 0) | (F.col("credit") > 0))))
    hits = written(returning_debits(lines, tolerance, days), "returning")
    cell = ["company_id", "party_key", "day", "cents"]
    credits = lines.select("company_id", _party_key().alias("party_key"), F.col("txn_date").alias("day"), _cents("credit").alias("cents"), "txn_id", "line", F.col("credit").alias("amount"), "party", "narration")
    # Ids of one cell may repeat; the number of the line then makes the choice the same for all columns.
    wanted = matching(credits.filter(F.col("cents").isNotNull()), hits.select(*cell).distinct(), cell, "left_semi")
    paid = wanted.groupBy(*cell).agg(F.min(F.struct("txn_id", "line", F.struct("amount", "txn_id", "party", "narration").alias("hit"))).alias("c")).select(*cell, "c.hit")
    debits = lines.select("line", F.col("txn_id").alias("debit_txn_id"), F.col("txn_date").alias("debit_date"), F.col("debit").alias("debit_amount"))
    found = matching(hits.join(debits, "line"), paid, cell, "inner")
    return found.select("company_id", "party_key", "debit_txn_id", "debit_date", "debit_amount", F.struct("day", "hit").alias("first"))


def circular_pairs(ledger: DataFrame, tolerance: str = "0.02", days: int = 3, cap: int | None = None) -> DataFrame:
    """The debits that come back with their credits. Lines `numbered` without ids give company, date and amount of every pair."""
    if "txn_id" not in ledger.columns:
        hits = returning_debits(ledger, tolerance, days)
        return hits.select("company_id", F.col("day").alias("txn_date"), round_to((F.col("cents").cast("decimal(20,0)") / 100).cast("double"), 2).alias("amount"))
    kept = at_most(matched_debits(ledger, tolerance, days), ["company_id"], [F.col("debit_date"), F.col("debit_txn_id")], cap)
    return kept.select(
        "company_id",
        "debit_txn_id",
        F.col("first.hit.txn_id").alias("credit_txn_id"),
        F.col("first.day").alias("txn_date"),
        F.col("first.hit.party").alias("party"),
        round_to(F.col("first.hit.amount").cast("double"), 2).alias("amount"),
        F.coalesce(F.col("first.hit.narration"), F.lit("")).alias("narration"),
    )


def _sum_if(cond: Column, amount: str) -> Column:
    return F.sum(F.when(cond, F.col(amount)))


def monthly_balances(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the months' mean balances, and the first and last month. Balances alone are summed per month, so little travels."""
    months = ledger.groupBy(*keys, F.trunc("txn_date", "MM").alias("period")).agg(F.sum("balance").cast("double").alias("balance_sum"), F.count("balance").alias("balance_rows"))
    return months.groupBy(*keys).agg(
        F.coalesce(round_to(F.avg(F.try_divide("balance_sum", "balance_rows")), 2), F.lit(0.0)).alias("average_monthly_balance"), F.min("period").alias("first_month"), F.max("period").alias("last_month"))


def ledger_sums(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of the profile that need no months, folded per key before the shuffle."""
    zero = F.lit(Decimal(0))
    march, early_day = F.month("txn_date") == 3, F.dayofmonth("txn_date") <= 15
    early, late = F.coalesce(_sum_if(march & early_day, "credit"), zero), F.coalesce(_sum_if(march & ~early_day, "credit"), zero)
    cash = _sum_if((F.col("debit") > 0) & F.col("narration").rlike(CASH_WORDS), "debit")
    cash_share = F.try_divide(cash.cast("double"), F.sum("debit").cast("double"))
    return ledger.groupBy(*keys).agg(
        round_to(F.sum("credit").cast("double"), 2).alias("banking_turnover"),
        round_to(F.max("debit").cast("double"), 2).alias("largest_debit"),
        F.when(cash_share > 0.35, "ALARMING").when(cash_share > 0.2, "SUSPICIOUS").otherwise("NORMAL").alias("cash_pattern"),
        F.when(early <= 0, late > 0).otherwise(late > early * 3).alias("year_end_window_dressing"),
        F.sum("debit").cast("double").alias("total_debits"),
        F.coalesce(cash, zero).cast("double").alias("cash_debits"),
        F.count_if(is_emi()).alias("emi_count"),
        F.coalesce(_sum_if(is_emi(), "debit"), zero).cast("double").alias("emi_total"),
        F.count_if(is_round_transfer()).alias("shell_count"),
    )


def ledger_totals(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """All sums of the profile. Both sides have the same keys, null ones included."""
    return matching(ledger_sums(ledger, keys), monthly_balances(ledger, keys), keys, "inner")


def average_monthly_balance(ledger: DataFrame) -> DataFrame:
    return monthly_balances(ledger, ["company_id"]).select("company_id", "average_monthly_balance")


def turnover_and_peak(ledger: DataFrame) -> DataFrame:
    return ledger_sums(ledger, ["company_id"]).select("company_id", "banking_turnover", "largest_debit")


def _coverage() -> list[Column]:
    return [
        round_to(F.col("average_monthly_balance") / floor_one(F.coalesce("annual_revenue", F.lit(0.0))), 4).alias("abb_to_revenue"),
        round_to(F.col("banking_turnover") / floor_one(F.coalesce("tax_turnover", F.lit(0.0))), 4).alias("banking_to_gst_ratio"),
    ]


def coverage_ratios(totals: DataFrame, revenue: DataFrame, tax_turnover: DataFrame) -> DataFrame:
    """Balance over declared revenue, bank turnover over tax turnover. Sides are (company_id, amount)."""
    joined = totals.join(revenue, "company_id", "left").join(tax_turnover, "company_id", "left")
    return joined.select("company_id", *_coverage())


def cash_pattern(ledger: DataFrame) -> DataFrame:
    return ledger_sums(ledger, ["company_id"]).select("company_id", "cash_debits", "total_debits", "cash_pattern")


def window_dressing(ledger: DataFrame, keys: list[str]) -> DataFrame:
    return ledger_sums(ledger, keys).select(*keys, "year_end_window_dressing")


def pair_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("company_id").agg(
        F.count("*").alias("pair_count"),
        F.sum(F.col("amount").cast(CENTS)).cast("double").alias("pair_value"),
        F.min("txn_date").alias("first_pair_date"),
        F.max("txn_date").alias("last_pair_date"),
    )


def pair_totals(pairs: DataFrame, emi: DataFrame) -> DataFrame:
    a = pair_sums(pairs)
    b = emi.groupBy("company_id").agg(F.count("*").alias("emi_count"), F.sum(F.col("amount").cast(CENTS)).cast("double").alias("emi_total"))
    return a.join(b, "company_id", "full").select(
        "company_id",
        F.coalesce("pair_count", F.lit(0)).alias("pair_count"),
        F.coalesce("pair_value", F.lit(0.0)).alias("pair_value"),
        "first_pair_date",
        "last_pair_date",
        F.coalesce("emi_count", F.lit(0)).alias("emi_count"),
        F.coalesce("emi_total", F.lit(0.0)).alias("emi_total"),
    )


def bank_profile(companies: DataFrame, ledger: DataFrame, revenue: DataFrame, tax_turnover: DataFrame) -> DataFrame:
    """One row per company; a company without a ledger gets zeros and has_ledger = false.

    One pass over the ledger writes its lines; all sums and the circular pairs are read off them. No column needs the ids of the lines, so these are not built.
    """
    ledger = numbered(ledger.drop("txn_id"))
    totals = ledger_totals(ledger, ["company_id"])
    pairs = pair_sums(circular_pairs(ledger))
    joined = (
        companies.select("company_id")
        .join(totals, "company_id", "left")
        .join(pairs, "company_id", "left")
        .join(revenue, "company_id", "left")
        .join(tax_turnover, "company_id", "left")
        .select("*", *_coverage())
    )
    zeroed = ["average_monthly_balance", "banking_turnover", "largest_debit", "pair_value", "emi_total", "abb_to_revenue", "banking_to_gst_ratio"]
    counts = ["pair_count", "emi_count", "shell_count"]
    return joined.select(
        "company_id",
        F.col("total_debits").isNotNull().alias("has_ledger"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zeroed],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("cash_pattern", F.lit("NORMAL")).alias("cash_pattern"),
        F.coalesce("year_end_window_dressing", F.lit(False)).alias("year_end_window_dressing"),
        "first_month",
        "last_month",
    )


def running_balance(ledger: DataFrame, opening: str = "0.00") -> DataFrame:
    """Opening plus credits minus debits in date order, then by id."""
    moves = ledger.select("company_id", "txn_id", "txn_date", (F.col("credit") - F.col("debit")).alias("delta"))
    run = scan(moves, ["company_id"], [F.col("txn_id")], "txn_date", sums={"run": F.col("delta")})
    return run.select("company_id", "txn_id", "txn_date", (F.lit(Decimal(opening)) + F.col("run")).cast("double").alias("running_balance"))


def carry_forward(df: DataFrame, keys: list[str], segment: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last known value per column in (segment, order) sequence, as `<column>_filled`."""
    return scan(df, keys, [F.col(c) for c in order], segment, lasts={f"{c}_filled": c for c in columns})


def filled_balance(ledger: DataFrame) -> DataFrame:
    rows = ledger.select("company_id", "txn_id", "txn_date", "balance")
    filled = carry_forward(rows, ["company_id"], "txn_date", ["txn_id"], ["balance"])
    return filled.select("company_id", "txn_id", "txn_date", F.col("balance_filled").cast("double").alias("balance_filled"))
