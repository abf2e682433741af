"""Tax-credit mismatch and cross-source reconciliation, one row per company (or company and month)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import clip, floor_one, percent_gap, present, round_to

# Mismatch thresholds and reconciliation defaults.
ITC_CRITICAL, ITC_FRAUD, ITC_MEDIUM, SALES_RATIO = 0.15, 0.05, 0.02, 1.3
RECEIVABLE_DAYS, INVENTORY_DAYS, PAYABLE_DAYS = 45, 35, 30


def tax_sides(summary: DataFrame, register: DataFrame, sales: DataFrame, credits: DataFrame, keys: list[str]) -> DataFrame:
    """Claimed against available credit; a report needs both, sales and bank credits are optional."""
    return (
        summary.select(*keys, "itc_claimed")
        .join(register.select(*keys, "available_itc"), keys)
        .join(sales.select(*keys, "invoice_sales_total"), keys, "left")
        .join(credits.select(*keys, "bank_credits"), keys, "left")
    )


def tax_mismatch(sides: DataFrame, keys: list[str]) -> DataFrame:
    available = floor_one(F.col("available_itc"))
    inflation = F.greatest(F.lit(0.0), (F.col("itc_claimed") - available) / available)
    ratio = F.when(F.col("bank_credits") > 0, F.col("invoice_sales_total") / F.col("bank_credits"))
    inflated = F.coalesce(ratio > SALES_RATIO, F.lit(False))
    circular = (inflation > ITC_FRAUD) & inflated
    money = lambda c: F.format_number(round_to(F.col(c), 2), 2)
    return sides.select(
        *keys,
        round_to(inflation * 100, 2).alias("itc_inflation_pct"),
        inflated.alias("revenue_inflation_flag"),
        circular.alias("suspected_circular"),
        F.when(inflation >= ITC_CRITICAL, "CRITICAL")
        .when((inflation >= ITC_FRAUD) | inflated, "HIGH")
        .when(inflation >= ITC_MEDIUM, "MEDIUM")
        .otherwise("LOW")
        .alias("risk_level"),
        F.concat_ws(
            " ",
            F.concat(F.lit("ITC claimed ₹"), money("itc_claimed"), F.lit(" vs available ₹"), money("available_itc"), F.lit(".")),
            F.when(inflated, "GSTR-1 outward supplies appear materially higher than observed banking credits."),
            F.when(circular, "Pattern suggests possible fake invoicing / circular trading chain."),
        ).alias("explanation"),
    )


def turnover_by_month(summary: DataFrame, credits: DataFrame) -> DataFrame:
    """Tax turnover beside bank credits per company and month, either side may be missing."""
    joined = summary.select("company_id", "period", "outward_supplies").join(credits, ["company_id", "period"], "full")
    tax, bank = F.coalesce("outward_supplies", F.lit(0.0)), F.coalesce("bank_credits", F.lit(0.0))
    return joined.select(
        "company_id", "period", tax.alias("tax_turnover"), bank.alias("bank_credits"), round_to(percent_gap(tax, bank), 2).alias("gap_pct")
    )


def assemble(companies: DataFrame, bank: DataFrame, tax: DataFrame, itr: DataFrame, mismatch: DataFrame,
             recon: DataFrame, holding: DataFrame, figures: DataFrame) -> DataFrame:
    """All reconciliation inputs on one row per company, with the stated fallbacks for missing sides.

    Every side is one row per company, so these are key joins without fan-out.
    """
    joined = (
        companies.select("company_id")
        .join(bank.select("company_id", "has_ledger", "banking_turnover", "year_end_window_dressing", "pair_count", "pair_value"), "company_id", "left")
        .join(tax.select("company_id", "tax_turnover"), "company_id", "left")
        .join(itr.select("company_id", "itr_revenue"), "company_id", "left")
        .join(mismatch.select("company_id", "risk_level", "suspected_circular"), "company_id", "left")
        .join(recon.select("company_id", "itc_mismatch_pct", "itc_excess", "itc_available"), "company_id", "left")
        .join(holding.select("company_id", "promoter_pledge_pct"), "company_id", "left")
        .join(figures.select("company_id", "contingent", "net_worth"), "company_id", "left")
    )
    zero, has_bank = F.lit(0.0), F.coalesce("has_ledger", F.lit(False))
    tax_turnover = F.coalesce("tax_turnover", zero)
    return joined.select(
        "company_id",
        has_bank.alias("has_bank"),
        tax_turnover.alias("tax_turnover"),
        F.when(has_bank, F.col("banking_turnover")).otherwise(tax_turnover).alias("bank_turnover"),
        F.coalesce("itr_revenue", zero).alias("itr_revenue"),
        (has_bank & F.coalesce("year_end_window_dressing", F.lit(False))).alias("window_dressing"),
        F.when(has_bank, F.col("pair_count")).otherwise(F.lit(0)).cast("bigint").alias("pair_count"),
        F.when(has_bank, F.col("pair_value")).otherwise(zero).alias("pair_value"),
        F.col("risk_level").alias("tax_risk"),
        F.coalesce("suspected_circular", F.lit(False)).alias("tax_circular"),
        F.coalesce("itc_mismatch_pct", zero).alias("itc_mismatch_pct"),
        F.coalesce("itc_excess", zero).alias("itc_excess"),
        F.coalesce("itc_available", zero).alias("itc_available"),
        F.coalesce("promoter_pledge_pct", zero).alias("pledge_pct"),
        F.coalesce("contingent", zero).alias("contingent"),
        F.coalesce("net_worth", zero).alias("net_worth"),
        F.when(has_bank, F.greatest(F.lit(6.0), F.col("banking_turnover") * 0.08)).otherwise(F.lit(8.0)).alias("obligation"),
        F.lit(None).cast("double").alias("net_cash_flow"),
    )


def bank_gap() -> Column:
    return percent_gap(F.col("tax_turnover"), F.col("bank_turnover"))


def itr_gap() -> Column:
    return percent_gap(F.col("itr_revenue"), F.col("tax_turnover"))


def gaps(assembled: DataFrame) -> DataFrame:
    return assembled.select(
        "company_id", round_to(bank_gap(), 2).alias("gst_vs_bank_gap"), round_to(itr_gap(), 2).alias("itr_vs_gst_gap")
    )


def _note(title: str, details: Column, severity: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), details.alias("details"), severity.alias("severity"))


def _fixed(c: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", round_to(c, decimals))


def _whole(c: Column) -> Column:
    return F.format_number(round_to(c, 0), 0)


def anomaly_list() -> Column:
    bank, itr = bank_gap(), itr_gap()
    itc, pledge = F.col("itc_mismatch_pct"), F.col("pledge_pct")
    weight = F.when((F.col("net_worth") > 0) & (F.col("contingent") > 0), F.col("contingent") / F.col("net_worth"))
    high = F.lit("HIGH")
    worse = lambda cond: F.when(cond, "CRITICAL").otherwise("HIGH")
    return present([
        (~F.col("has_bank"), _note(
            "Bank statement unavailable",
            F.lit("Bank statement metrics missing; GST vs banking reconciliation used fallback estimates."), F.lit("MEDIUM"))),
        (F.col("has_bank") & (bank > 15), _note(
            "GST vs Banking mismatch",
            F.concat(F.lit("Gap is "), _fixed(bank, 2), F.lit("% between reported GST turnover and bank credits.")), high)),
        (itr > 10, _note(
            "ITR vs GST mismatch", F.concat(F.lit("Tax filing turnover differs by "), _fixed(itr, 2), F.lit("%.")), F.lit("MEDIUM"))),
        (itc > 5, _note(
            "GST ITC Mismatch",
            F.concat(F.lit("ITC claimed exceeds available by "), _fixed(itc, 1), F.lit("%. Excess: ₹"), _fixed(F.col("itc_excess"), 0),
                     F.lit(" Cr over ₹"), _fixed(F.col("itc_available"), 0), F.lit(" Cr available in GSTR-2A.")), worse(itc > 20))),
        (F.col("pair_count") > 0, _note(
            "Round-trip Bank Transfers Detected",
            F.concat(F.col("pair_count").cast("string"), F.lit(" circular credit-debit pair(s) found. Total amount: ₹"),
                     _whole(F.col("pair_value")), F.lit(" Cr. Same counterparty, matching amounts within 2%, within 3 calendar days.")), high)),
        (pledge > 75, _note(
            "Promoter Pledge Critical",
            F.concat(F.lit("Promoter has pledged "), _fixed(pledge, 1), F.lit("% of holdings. "),
                     F.when(pledge > 90, "CRITICAL: >90% pledge indicates extreme financial stress.")
                     .otherwise("HIGH: >75% pledge indicates significant stress.")), worse(pledge > 90))),
        (weight > 5, _note(
            "Contingent Liability Concentration",
            F.concat(F.lit("Contingent liabilities (₹"), _whole(F.col("contingent")), F.lit(" Cr) are "), _fixed(weight, 1),
                     F.lit("x net worth (₹"), _whole(F.col("net_worth")), F.lit(" Cr). "),
                     F.when(weight > 10, "CRITICAL risk of capital erosion.").otherwise("HIGH concentration risk.")), worse(weight > 10))),
    ])


def indicator_list() -> Column:
    make = lambda text, source, sev, conf: F.struct(
        F.lit(text).alias("indicator"), F.lit(source).alias("source"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"))
    return present([
        (F.col("window_dressing"), make("Year-end window dressing detected", "bank_statement", "HIGH", 0.82)),
        (F.col("pair_count") > 0, make("Circular credit-debit transaction pattern", "bank_statement", "CRITICAL", 0.86)),
        (F.col("tax_circular"), make("GST ITC anomaly indicates potential circular trading", "gst_mismatch", "CRITICAL", 0.88)),
    ])


def consistency() -> Column:
    penalty = (
        F.when(F.col("has_bank"), F.least(F.lit(35.0), bank_gap() * 0.8)).otherwise(F.lit(8.0))
        + F.least(F.lit(25.0), itr_gap() * 0.7)
        + F.when(F.col("window_dressing"), 20.0).otherwise(0.0)
        + F.least(F.lit(20.0), F.col("pair_count") * 2.0)
        + F.when(F.col("tax_risk").isin("CRITICAL", "HIGH"), 15.0).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), round_to(F.lit(100.0) - penalty, 2))


def advice_list(score: Column) -> Column:
    return present([
        (~F.col("has_bank"), F.lit("Collect at least 6-12 months of bank statements for stronger cross-validation.")),
        (F.col("has_bank") & (bank_gap() > 15), F.lit("Investigate revenue recognition and cash realization.")),
        (F.col("window_dressing"), F.lit("Impose monthly stock and debtor statement covenant.")),
        (F.col("itc_mismatch_pct") > 20, F.lit("Investigate circular trading and fake invoicing risk.")),
        (F.col("pledge_pct") > 75, F.lit("Obtain pledge reduction plan from promoter before sanction.")),
        (score < 55, F.lit("Enhanced forensic review before sanction.")),
        ((score >= 55) & (score < 75), F.lit("Conditional approval with tighter monitoring.")),
    ])


def service_cover() -> Column:
    cash = F.coalesce(
        F.col("net_cash_flow"),
        F.when(F.col("bank_turnover") > 0, F.col("bank_turnover") * 0.1).otherwise(F.greatest(F.col("tax_turnover"), F.lit(0.0)) * 0.08),
    )
    return round_to(cash / floor_one(F.col("obligation")), 3)


def reconcile(assembled: DataFrame) -> DataFrame:
    """The full report: gaps, cover, score, and the three lists."""
    return assembled.select(
        "company_id",
        round_to(bank_gap(), 2).alias("gst_vs_bank_gap"),
        round_to(itr_gap(), 2).alias("itr_vs_gst_gap"),
        service_cover().alias("dscr"),
        F.lit(RECEIVABLE_DAYS + INVENTORY_DAYS - PAYABLE_DAYS).cast("bigint").alias("cycle_days"),
        consistency().alias("consistency_score"),
        anomaly_list().alias("anomalies"),
        indicator_list().alias("indicators"),
        advice_list(consistency()).alias("advice"),
    )


def long_list(report: DataFrame, column: str) -> DataFrame:
    """One row per list entry, numbered from 1."""
    rows = report.select("company_id", F.posexplode(column).alias("pos", "item"))
    seq = (F.col("pos") + 1).cast("bigint").alias("seq")
    return rows.select("company_id", seq, "item") if column == "advice" else rows.select("company_id", seq, "item.*")


def annual_tax_rows(monthly: DataFrame, mismatch: DataFrame, ingested_at: Column) -> DataFrame:
    """Yearly tax summary rows for the lake; months with a critical gap are named.

    `monthly`: company_id, period, outward_supplies, itc_claimed, available_itc.
    """
    joined = monthly.join(mismatch.select("company_id", "period", "risk_level", "suspected_circular"), ["company_id", "period"], "left")
    yearly = joined.groupBy("company_id", F.year("period").alias("y")).agg(
        F.sum(F.col("outward_supplies").cast("decimal(24,4)")).cast("double").alias("turnover"),
        F.sum(F.col("itc_claimed").cast("decimal(24,4)")).cast("double").alias("claimed"),
        F.sum(F.col("available_itc").cast("decimal(24,4)")).cast("double").alias("available"),
        F.countDistinct("period").alias("filed"),
        # at most twelve months
        F.array_sort(F.collect_set(F.when(F.col("risk_level") == "CRITICAL", F.date_format("period", "yyyy-MM")))).alias("critical_months"),
        F.bool_or("suspected_circular").alias("circular"),
    )
    base = floor_one(F.col("available"))
    return yearly.select(
        F.col("company_id").cast("string").alias("company_id"),
        F.concat(F.lit("FY"), F.col("y").cast("string")).alias("financial_year"),
        F.col("turnover").alias("gst_annual_turnover"),
        F.col("claimed").alias("total_itc_claimed"),
        F.col("available").alias("total_itc_available_2a"),
        F.greatest(F.lit(0.0), F.col("claimed") - F.col("available")).alias("itc_overclaim_amount"),
        round_to(F.greatest(F.lit(0.0), (F.col("claimed") - base) / base) * 100, 2).alias("overall_itc_gap_pct"),
        round_to(F.col("filed") / 12.0 * 100, 2).alias("filing_compliance_pct"),
        F.col("critical_months").alias("critical_flag_months"),
        F.coalesce("circular", F.lit(False)).alias("has_circular_trading"),
        ingested_at.alias("ingested_at"),
    )


def bank_rows(bank: DataFrame, ingested_at: Column) -> DataFrame:
    """Bank analytics rows for the lake; the period comes from the ledger's own dates."""
    return bank.filter("has_ledger").select(
        F.col("company_id").cast("string").alias("company_id"),
        F.col("first_month").alias("period_start"),
        F.last_day("last_month").alias("period_end"),
        F.col("banking_turnover").alias("banking_turnover_credits"),
        F.col("average_monthly_balance").alias("avg_monthly_balance"),
        F.col("pair_count").alias("circular_transaction_count"),
        F.col("pair_value").alias("circular_transaction_value"),
        F.col("year_end_window_dressing").alias("window_dressing_detected"),
        F.lit(0.0).alias("window_dressing_amount"),
        F.col("emi_total").alias("emi_payments_annual"),
        "banking_to_gst_ratio",
        ingested_at.alias("ingested_at"),
    )


def report_rows(report: DataFrame, validated_at: Column) -> DataFrame:
    """Cross-validation rows for the lake."""
    score = F.col("consistency_score")
    return report.select(
        F.col("company_id").cast("string").alias("company_id"),
        F.col("gst_vs_bank_gap").alias("gst_vs_bank_gap_pct"),
        F.col("itr_vs_gst_gap").alias("gst_vs_itr_gap_pct"),
        F.lit(0.0).alias("itr_vs_bank_gap_pct"),
        "dscr",
        score.alias("data_consistency_score"),
        F.transform("indicators", lambda i: F.concat(i["indicator"], F.lit(" ("), i["severity"], F.lit(")"))).alias("fraud_indicators"),
        F.to_json("anomalies").alias("anomalies_json"),
        F.when(score < 50, "HIGH_RISK").when(score < 75, "MEDIUM_RISK").otherwise("LOW_RISK").alias("overall_verdict"),
        validated_at.alias("validated_at"),
    )


def stress(score: Column) -> Column:
    """Credit score of up to 900 as a stress share."""
    return clip((F.lit(900.0) - score) / 600.0, 0.0, 1.0)
