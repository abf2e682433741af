"""Feature tables: sector lookups, growth, the assembled blocks, the two feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import flag, lookup, round_to, zero_as_missing

# Sector weights and the order of the features.
SECTOR_MULTIPLIER = {
    "real_estate": 1.4, "nbfc": 1.3, "construction": 1.3, "textiles": 1.0, "agri_processing": 0.9, "it_services": 0.8,
    "pharma": 0.85, "manufacturing": 1.0, "other": 1.0,
}
SECTOR_RISK_INDEX = {
    "nbfc": 8, "real_estate": 7, "construction": 7, "aviation": 9, "telecom": 6, "steel": 5, "fmcg": 3, "pharma": 3, "it": 2,
    "manufacturing": 4, "agriculture": 5, "textile": 5, "other": 5, "energy": 4,
}
CREDIT_FEATURES = [
    "revenue_cagr_3yr", "ebitda_margin", "debt_equity_ratio", "current_ratio", "interest_coverage_ratio", "dscr", "gst_banking_ratio",
    "itr_gst_consistency_score", "average_bank_balance_to_limit_ratio", "has_auditor_qualification", "has_going_concern_doubt",
    "has_litigation", "has_mca_struck_off_associates", "has_circular_trading_signals", "has_revenue_inflation_signals",
    "has_promoter_fraud_news", "has_sector_headwinds", "has_nclt_proceedings", "gstr3b_vs_2a_itc_gap", "gst_return_filing_consistency",
    "mca_filing_compliance_score", "cibil_commercial_score", "management_integrity_score", "factory_capacity_utilization",
    "due_diligence_risk_adjustment", "collateral_coverage_ratio", "collateral_type_score",
]
EXTRA_FEATURES = [
    "alm_liquidity_gap_cr", "alm_short_term_borrow_pct", "promoter_holding_pct", "pledged_pct", "existing_debt_cr",
    "avg_cost_of_debt_pct", "gnpa_pct", "collection_efficiency",
]
CALIBRATOR_FEATURES = [
    "dscr", "ebitda_margin_pct", "current_ratio", "debt_to_equity", "revenue_growth_yoy", "gst_bank_mismatch_pct", "active_litigation_count",
    "promoter_red_flag", "factory_capacity_pct", "auditor_qualified", "charge_count", "bounced_cheques_12m", "sector_risk_index",
]
NEWS_FLAGS = ["has_promoter_fraud_news", "has_nclt_proceedings", "has_litigation", "has_sector_headwinds", "has_mca_struck_off_associates"]


def sector_factors(companies: DataFrame) -> DataFrame:
    sector = F.lower("sector")
    return companies.select(
        "company_id", "sector", lookup(SECTOR_MULTIPLIER, sector, 1.0).alias("risk_multiplier"),
        lookup(SECTOR_RISK_INDEX, sector, 5).cast("bigint").alias("risk_index"))


def growth(yearly: DataFrame) -> DataFrame:
    """Newest three years per company, padded with the oldest known, and the growth rates.

    `yearly`: company_id, assessment_year, gross_revenue - a handful of rows per company.
    """
    series = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("assessment_year")).alias("y"), "gross_revenue"))), lambda s: s["gross_revenue"])
    at = lambda i: F.coalesce(F.get("series", i), F.element_at("series", -1))
    base = yearly.groupBy("company_id").agg(series.alias("series")).select("company_id", at(0).alias("r0"), at(1).alias("r1"), at(2).alias("r2"))
    one = F.lit(1.0)
    return base.select(
        "*",
        (F.sqrt(F.greatest("r0", one) / F.greatest("r2", one)) - 1).alias("revenue_cagr_3yr"),
        F.when(F.col("r1") != 0, (F.col("r0") - F.col("r1")) / F.col("r1")).otherwise(0.0).alias("revenue_growth_yoy"),
        ((F.col("r0") < F.col("r1")) & (F.col("r1") < F.col("r2"))).alias("is_declining"))


def filing_consistency(summary: DataFrame) -> DataFrame:
    """Filed months out of the months between the first and the last return."""
    return summary.groupBy("company_id").agg(
        round_to(F.count_distinct("period") / (round_to(F.months_between(F.max("period"), F.min("period")), 0) + 1) * 100, 2).alias("filing_consistency_pct"))


def tax_block(mismatch: DataFrame, recon: DataFrame) -> DataFrame:
    """Return-based mismatch, replaced by the workbook's gap where that is positive; flags are joined with or, and a
    mismatch that the workbook shows counts as revenue inflation."""
    joined = mismatch.join(recon.select("company_id", "itc_mismatch_pct", "has_itc_mismatch", "has_circular_signals"), "company_id", "full")
    off = F.lit(False)
    return joined.select(
        "company_id",
        F.when(F.col("itc_mismatch_pct") > 0, F.col("itc_mismatch_pct")).otherwise(F.coalesce("itc_inflation_pct", F.lit(0.0))).alias("itc_gap_pct"),
        (F.coalesce("suspected_circular", off) | F.coalesce("has_circular_signals", off)).alias("circular_signals"),
        (F.coalesce("revenue_inflation_flag", off) | F.coalesce(F.col("has_itc_mismatch") & (F.col("itc_mismatch_pct") > 0), off)).alias("revenue_inflation"))


def assemble_blocks(companies: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """One row per company with the columns of all blocks. Every block has one row per company."""
    out = companies.select("company_id", "company_name", "sector", "declared_turnover_cr", "requested_cr")
    for b in blocks:
        out = out.join(b, "company_id", "left")
    return out


def credit_vector(blocks: DataFrame) -> DataFrame:
    """The 27 scoring features and 8 further ones, with the stated defaults."""
    d = lambda c, v: F.coalesce(F.col(c), F.lit(float(v)))
    multiplier = lookup(SECTOR_MULTIPLIER, F.lower(F.coalesce("sector", F.lit("other"))), 1.0)
    cover = F.when(F.col("dscr") > 0, F.col("dscr")).when(F.col("reconciled_dscr") > 0, F.col("reconciled_dscr")).otherwise(1.3)
    positive = lambda c: flag(F.col(c) > 0)
    values = {
        "revenue_cagr_3yr": d("revenue_cagr_3yr", 0),
        "ebitda_margin": d("ebitda_margin", 10),
        "debt_equity_ratio": d("debt_equity_ratio", 1.5) * multiplier,
        "current_ratio": d("current_ratio", 1.4),
        "interest_coverage_ratio": d("interest_coverage", 2),
        "dscr": cover / F.greatest(multiplier, F.lit(0.8)),
        "gst_banking_ratio": d("banking_to_gst_ratio", 1),
        "itr_gst_consistency_score": F.lit(100.0) - d("itr_vs_gst_gap", 0),
        "average_bank_balance_to_limit_ratio": d("abb_to_revenue", 0.15),
        "has_auditor_qualification": flag(F.col("auditor_qualified")),
        "has_going_concern_doubt": flag(F.col("going_concern")),
        "has_litigation": positive("litigation_count"),
        "has_mca_struck_off_associates": flag(F.col("struck_off")),
        "has_circular_trading_signals": flag(F.col("circular_signals")),
        "has_revenue_inflation_signals": flag(F.col("revenue_inflation")),
        "has_promoter_fraud_news": positive("fraud_hits"),
        "has_sector_headwinds": flag(F.col("sector_headwinds")),
        "has_nclt_proceedings": flag(F.col("has_nclt")),
        "gstr3b_vs_2a_itc_gap": d("itc_gap_pct", 0),
        "gst_return_filing_consistency": d("filing_consistency_pct", 85),
        "mca_filing_compliance_score": d("compliance_score", 80),
        "cibil_commercial_score": d("bureau_score", 700),
        "management_integrity_score": d("management_integrity_score", 6),
        "factory_capacity_utilization": d("factory_capacity_utilization", 65),
        "due_diligence_risk_adjustment": d("due_diligence_risk_adjustment", 0),
        "collateral_coverage_ratio": d("collateral_coverage_ratio", 1.1),
        "collateral_type_score": d("collateral_type_score", 6),
        "alm_liquidity_gap_cr": d("liquidity_gap_cr", 0),
        "alm_short_term_borrow_pct": d("within_1yr_pct", 0),
        "promoter_holding_pct": d("promoter_holding_pct", 50),
        "pledged_pct": d("promoter_pledge_pct", 0),
        "existing_debt_cr": d("existing_debt_cr", 0),
        "avg_cost_of_debt_pct": d("weighted_cost_pct", 0),
        "gnpa_pct": d("gnpa_pct", 0),
        "collection_efficiency": d("collection_efficiency_pct", 90),
    }
    return blocks.select("company_id", *[values[f].alias(f) for f in CREDIT_FEATURES + EXTRA_FEATURES])


def calibrator_vector(profiles: DataFrame) -> DataFrame:
    """The 13 calibrator features; zero counts as missing where the default is not zero."""
    equity = zero_as_missing(F.col("net_worth"), 1.0)
    leverage = F.least(F.when(equity > 0, F.coalesce("total_debt", F.lit(0.0)) / equity).otherwise(10.0), F.lit(10.0))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    values = {
        "dscr": zero_as_missing(F.col("dscr"), 1.0), "ebitda_margin_pct": zero("ebitda_margin"), "current_ratio": zero_as_missing(F.col("current_ratio"), 1.0),
        "debt_to_equity": leverage, "revenue_growth_yoy": zero("revenue_growth_yoy"), "gst_bank_mismatch_pct": zero("gst_vs_bank_gap"),
        "active_litigation_count": zero("litigation_count"), "promoter_red_flag": flag(F.col("fraud_hits") > 0),
        "factory_capacity_pct": zero_as_missing(F.col("factory_capacity_utilization"), 80.0),
        "auditor_qualified": flag(F.col("auditor_opinion").isin("qualified", "adverse")), "charge_count": zero("charge_count"),
        "bounced_cheques_12m": zero("bounced_cheques"),
        "sector_risk_index": lookup(SECTOR_RISK_INDEX, F.lower("sector"), 5).cast("double"),
    }
    return profiles.select("company_id", *[values[f].alias(f) for f in CALIBRATOR_FEATURES])


def aligned(df: DataFrame, names: list[str] = CALIBRATOR_FEATURES, key: str = "company_id") -> DataFrame:
    """Exactly the named columns as doubles: nulls and absent columns become zero."""
    column = lambda n: F.coalesce(F.col(n).try_cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    return df.select(key, *[column(n).alias(n) for n in names])


def completeness(names: list[str]) -> Column:
    """Share of non-zero features."""
    filled = sum((F.when(F.col(n) != 0, 1.0).otherwise(0.0) for n in names), F.lit(0.0))
    return filled / float(len(names))


def without_news(vector: DataFrame) -> DataFrame:
    """The vector used for scoring: news flags are advisory and set to zero."""
    return vector.withColumns({c: F.lit(0.0) for c in NEWS_FLAGS})
