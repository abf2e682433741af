"""Contributions, top factors and the decision narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.values import clip, percent_text, ratio_text, round_to, short_number, zero_as_missing
from creditloom.operators.features import completeness
from creditloom.operators.ledger import first_n
from creditloom.operators.scoring import ALL_FEATURES

# How features are read, and the contribution slopes.
RISK_FEATURES = [
    "has_going_concern_doubt", "has_nclt_proceedings", "has_auditor_qualification", "promoter_pledge_pct", "litigation_exposure_cr",
    "has_mca_struck_off_associates", "net_debt_to_ebitda", "due_diligence_risk_adjustment",
]
STRENGTH_FEATURES = [
    "ebitda_margin", "revenue_cagr_3yr", "interest_coverage_ratio", "current_ratio", "gst_banking_ratio", "average_bank_balance_to_limit_ratio",
    "collateral_type_score", "management_integrity_score", "factory_capacity_utilization",
]


def approximations(profiles: DataFrame) -> DataFrame:
    """Thirteen rule-based contributions per company, largest first."""
    z = lambda c, v: zero_as_missing(F.col(c), v)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    equity = z("net_worth", 1.0)
    leverage = F.when(equity > 0, zero("total_debt") / equity).otherwise(5.0)
    values = {
        "dscr": -(z("dscr", 1.25) - 1.25) * 0.5,
        "ebitda_margin_pct": -(z("ebitda_margin", 10.0) - 10.0) * 0.02,
        "current_ratio": -(z("current_ratio", 1.5) - 1.5) * 0.15,
        "debt_to_equity": (leverage - 2.0) * 0.1,
        "revenue_growth_yoy": F.lit(-0.05),
        "gst_bank_mismatch_pct": zero("gst_vs_bank_gap") * 0.005,
        "active_litigation_count": zero("litigation_count") * 0.05,
        "promoter_red_flag": F.when(F.col("fraud_hits") > 0, 0.15).otherwise(0.0),
        "factory_capacity_pct": (F.lit(80.0) - z("factory_capacity_utilization", 80.0)) * 0.003,
        "auditor_qualified": F.when(F.col("auditor_opinion").isin("qualified", "adverse"), 0.12).otherwise(0.0),
        "charge_count": zero("charge_count") * 0.02,
        "bounced_cheques_12m": zero("bounced_cheques") * 0.03,
        "sector_risk_index": F.lit(0.02),
    }
    wide = profiles.select("company_id", *[round_to(v, 4).alias(k) for k, v in values.items()])
    return _ranked(wide.unpivot(["company_id"], list(values), "feature", "contribution"))


def _ranked(long: DataFrame) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.abs("contribution").desc(), F.col("feature"))
    return long.withColumn("rank_no", F.row_number().over(w).cast("bigint"))


def contributions(vector: DataFrame) -> DataFrame:
    """One hundredth of each feature value, the default where no tree explanation is at hand."""
    long = vector.unpivot(["company_id"], ALL_FEATURES, "feature", "feature_value")
    return long.select("company_id", "feature", "feature_value", round_to(F.col("feature_value") * 0.01, 6).alias("contribution"))


def _sentence() -> Column:
    readable = F.initcap(F.replace("feature", F.lit("_"), F.lit(" ")))
    value = short_number(F.col("feature_value"), 4)
    risk, strength = F.col("feature").isin(RISK_FEATURES), F.col("feature").isin(STRENGTH_FEATURES)
    return (
        F.when(risk & (F.col("feature_value") == 0), F.concat(F.lit("No "), readable, F.lit(" detected - positive governance signal")))
        .when(risk, F.concat(readable, F.lit(" flagged - increases credit risk")))
        .when(strength & (F.col("contribution") > 0), F.concat(readable, F.lit(" supports credit quality (value: "), value, F.lit(")")))
        .when(strength, F.concat(readable, F.lit(" constrains credit quality (value: "), value, F.lit(")")))
        .otherwise(F.concat(readable, F.lit(" observed at "), value))
    )


def factors(vector: DataFrame, n: int | None = 3) -> DataFrame:
    """Leading positive and negative factors per company as sentences."""
    positive = (F.col("feature").isin(RISK_FEATURES) & (F.col("feature_value") == 0)) | (F.col("feature").isin(STRENGTH_FEATURES) & (F.col("contribution") > 0))
    long = contributions(vector).withColumn("side", F.when(positive, "positive").otherwise("negative"))
    kept = first_n(long, ["company_id", "side"], [F.abs("contribution").desc(), F.col("feature")], n)
    return kept.select("company_id", "side", F.col("rank_no").cast("bigint").alias("rank_no"), "feature", "contribution", _sentence().alias("sentence"))


def drivers(approximated: DataFrame, n: int = 8) -> DataFrame:
    return approximated.filter(F.col("rank_no") <= n).select(
        "company_id", "rank_no", "feature", "contribution", F.when(F.col("contribution") > 0, "▲ RISK").otherwise("▼ RISK").alias("direction"))


def narratives(vector: DataFrame, n: int = 3) -> DataFrame:
    """Decision paragraph and confidence per company."""
    tops = factors(vector, n).groupBy("company_id", "side").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "sentence"))), lambda s: s["sentence"]), "; ").alias("text"))
    sides = tops.groupBy("company_id").agg(
        F.max(F.when(F.col("side") == "positive", F.col("text"))).alias("good"), F.max(F.when(F.col("side") == "negative", F.col("text"))).alias("bad"))
    c = F.col
    cover = F.when(c("dscr") >= 1.3, "comfortable").when(c("dscr") >= 1.1, "watchlist").otherwise("stressed")
    gap = F.when(c("gstr3b_vs_2a_itc_gap") <= 5, "clean").when(c("gstr3b_vs_2a_itc_gap") <= 20, "moderate mismatch").otherwise("severe mismatch")
    lever = F.when(c("debt_equity_ratio") <= 1.0, "conservative").when(c("debt_equity_ratio") <= 2.0, "moderate").otherwise("elevated")
    text = F.concat(
        F.lit("Decision rationale is based on document-derived repayment capacity and balance-sheet resilience. Debt service coverage is "), ratio_text(c("dscr")),
        F.lit(" ("), cover, F.lit("), interest coverage is "), ratio_text(c("interest_coverage_ratio")), F.lit(", leverage is "), ratio_text(c("debt_equity_ratio")),
        F.lit(" ("), lever, F.lit("), GST ITC gap is "), percent_text(c("gstr3b_vs_2a_itc_gap")), F.lit(" ("), gap, F.lit("), and capacity utilization is "),
        percent_text(c("factory_capacity_utilization")), F.lit(". Primary strengths considered: "), F.coalesce("good", F.lit("none materially above threshold.")),
        F.lit(" Primary constraints considered: "), F.coalesce("bad", F.lit("no material adverse trigger.")),
        F.lit(" Recommendation and pricing are therefore calibrated to these quantified signals."))
    return vector.join(sides, "company_id", "left").select(
        "company_id", text.alias("narrative"), round_to(clip(round_to(completeness(ALL_FEATURES), 6), 0.5, 0.95), 2).alias("confidence"))
