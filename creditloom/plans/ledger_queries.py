"""Registered queries over the bank ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators import ledger as L
from creditloom.sources.tables import Tables


def revenue_of(t: Tables):
    """Latest income-tax year per company."""
    return t.itr.groupBy("company_id").agg(F.max_by("gross_revenue", "assessment_year").alias("annual_revenue"))


def tax_turnover_of(t: Tables):
    return t.monthly["gstr3b"].groupBy("company_id").agg(
        F.sum(F.col("outward_supplies").cast("decimal(20,2)")).cast("double").alias("tax_turnover")
    )


def bank_profile_of(t: Tables):
    return L.bank_profile(t.company, t.ledger, revenue_of(t), tax_turnover_of(t))


def _typed(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("debit", "credit", "balance") else c for c in df.columns])


QUERIES = {
    "prj_1_clean_ledger": lambda t: _typed(L.clean_ledger(t.ledger_raw)),
    "prj_2_emi_payments": lambda t: L.emi_payments(t.ledger),
    "prj_3_round_transfers": lambda t: L.round_transfers(t.ledger_round),
    "join_1_circular_pairs": lambda t: L.circular_pairs(t.ledger),
    "agg_1_average_monthly_balance": lambda t: L.average_monthly_balance(t.ledger),
    "agg_2_turnover_and_peak": lambda t: L.turnover_and_peak(t.ledger),
    "agg_3_coverage_ratios": lambda t: L.coverage_ratios(L.ledger_totals(t.ledger, ["company_id"]), revenue_of(t), tax_turnover_of(t)),
    "agg_4_cash_pattern": lambda t: L.cash_pattern(t.ledger),
    "agg_5_window_dressing": lambda t: L.window_dressing(
        t.ledger.withColumn("txn_year", F.year("txn_date").cast("bigint")), ["company_id", "txn_year"]
    ),
    "agg_6_bank_profile": bank_profile_of,
    "agg_7_pair_totals": lambda t: L.pair_totals(L.circular_pairs(t.ledger), L.emi_payments(t.ledger)),
    "win_6_filled_balance": lambda t: L.filled_balance(t.ledger),
    "win_7_running_balance": lambda t: L.running_balance(t.ledger),
}
