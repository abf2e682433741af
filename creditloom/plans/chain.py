"""Shared upstream steps, one row per company each; the ones that several plans read are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import reconcile as R
from creditloom.operators import workbook as W
from creditloom.plans.ledger_queries import bank_profile_of, tax_turnover_of
from creditloom.sources.tables import Tables

MONEY = "decimal(24,4)"


def _total(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy("company_id").agg(F.sum(F.col(column).cast(MONEY)).cast("double").alias(name))


def itr_total(t: Tables) -> DataFrame:
    return _total(t.itr, "gross_revenue", "itr_revenue")


def monthly_mismatch(t: Tables) -> DataFrame:
    keys = ["company_id", "period"]
    return R.tax_mismatch(R.tax_sides(*t.monthly.values(), keys), keys)


def company_mismatch(t: Tables) -> DataFrame:
    sums = t.monthly
    sides = R.tax_sides(
        _total(sums["gstr3b"], "itc_claimed", "itc_claimed"),
        _total(sums["gstr2a"], "available_itc", "available_itc"),
        _total(sums["gstr1"], "invoice_sales_total", "invoice_sales_total"),
        _total(sums["credits"], "bank_credits", "bank_credits"),
        ["company_id"],
    )
    return R.tax_mismatch(sides, ["company_id"])


def bank(t: Tables) -> DataFrame:
    return t.staged("bank", lambda: bank_profile_of(t))


def mismatch(t: Tables) -> DataFrame:
    return t.staged("mismatch", lambda: company_mismatch(t))


def recon(t: Tables) -> DataFrame:
    return t.staged("recon", lambda: W.credit_reconciliation(t.cells))


def holding(t: Tables) -> DataFrame:
    return t.staged("holding", lambda: W.promoter_holding(t.cells))


def figures(t: Tables) -> DataFrame:
    return t.staged("figures", lambda: W.statement_facts(t.cells))


def assembled(t: Tables) -> DataFrame:
    return t.staged("assembled", lambda: _assembled(t))


def _assembled(t: Tables) -> DataFrame:
    t.together(lambda: bank(t), lambda: mismatch(t), lambda: recon(t), lambda: holding(t), lambda: figures(t))
    return (R.assemble(
        t.company, bank(t), tax_turnover_of(t), itr_total(t), mismatch(t), recon(t), holding(t), figures(t)
    ))


def report(t: Tables) -> DataFrame:
    return R.reconcile(assembled(t))
