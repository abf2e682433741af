"""Policy rules, blended score, decision row, limits, Five Cs, stress grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import clip, lookup, present, round_to, zero_as_missing
from creditloom.operators.features import CREDIT_FEATURES, EXTRA_FEATURES, completeness

# Weights, bands, grades, prices, limit shares, Five C benchmark, scenarios.
RULE_WEIGHT, MODEL_WEIGHT = 0.6, 0.4
BANDS = [(75, "LOW"), (55, "MODERATE"), (35, "HIGH")]
PREMIUM_BY_BAND = {"LOW": 50, "MODERATE": 150, "HIGH": 300}
GRADES = [
    (90, "AAA"), (80, "AA"), (75, "AA-"), (70, "A+"), (65, "A"), (60, "A-"), (55, "BBB+"), (50, "BBB"), (45, "BB+"), (40, "BB"),
]
PREMIUM_BY_GRADE = {
    "AAA": 50, "AA+": 60, "AA": 100, "AA-": 100, "A+": 125, "A": 150, "A-": 175, "BBB+": 200, "BBB": 225, "BBB-": 250,
    "BB+": 275, "BB": 300, "BB-": 325, "B+": 350, "B": 400, "B-": 450, "C": 600, "D": 0,
}
LIMIT_BY_GRADE = {
    "AAA": 1.0, "AA+": 1.0, "AA": 1.0, "AA-": 1.0, "A+": 0.95, "A": 0.90, "BBB+": 0.80, "BBB": 0.75, "BB+": 0.65, "BB": 0.60, "B": 0.45, "D": 0.0,
}
BASE_RATE, OTHER_PREMIUM, OTHER_LIMIT, REVENUE_SHARE = 8.5, 300, 0.70, 0.25
BENCHMARK = {"character": 7.2, "capacity": 7.0, "capital": 6.8, "collateral": 6.5, "conditions": 6.9}
SCENARIOS = [0, 10, 20, 30, 40]
FALLBACK_WARNING = (
    "WARNING: Using form turnover as revenue fallback. Document extraction may have failed. Score may be inaccurate."
)


def policy_rules() -> list[tuple[str, str, int, Column, str]]:
    """(id, severity, penalty, condition, message). Zero counts as missing in the ratios."""
    z = lambda c, v: zero_as_missing(F.col(c), v)
    equity = z("net_worth", 1.0)
    leverage = F.when(equity > 0, F.coalesce("total_debt", F.lit(0.0)) / equity).otherwise(999.0)
    capacity = z("factory_capacity_utilization", 100.0)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    dscr = z("dscr", 999.0)
    return [
        ("CAP_001", "CRITICAL", 40, dscr < 1.0, "DSCR below 1.0 — company cannot service debt from operations (hard stop)"),
        ("CAP_002", "HIGH", 20, (dscr >= 1.0) & (dscr < 1.25), "DSCR between 1.0–1.25: thin coverage margin, vulnerable to cash flow stress"),
        ("CAP_003", "HIGH", 15, z("ebitda_margin", 999.0) < 5.0, "EBITDA margin below 5% — low operational profitability"),
        ("CAP_004", "MEDIUM", 10, yes("is_declining"), "Revenue declining for 3 consecutive years — business contraction signal"),
        ("CAP_005", "HIGH", 20, leverage > 3.0, "Debt-to-Equity above 3x — highly leveraged balance sheet"),
        ("CAP_006", "HIGH", 15, z("current_ratio", 999.0) < 1.0, "Current ratio below 1.0 — negative working capital, liquidity risk"),
        ("CAP_007", "CRITICAL", 50, equity < 0, "Negative net worth — company is technically insolvent (hard stop)"),
        ("CHAR_001", "HIGH", 25, count("fraud_hits") > 0, "Promoter has active fraud/default news — character risk"),
        ("CHAR_002", "CRITICAL", 50, yes("director_disqualified"), "Director DIN disqualified by MCA — regulatory red flag (hard stop)"),
        ("CHAR_003", "HIGH", 20, F.coalesce(F.col("auditor_opinion").isin("qualified", "adverse", "disclaimer"), F.lit(False)),
         "Auditor gave qualified/adverse opinion — financial statement reliability risk"),
        ("FRAUD_001", "CRITICAL", 60, yes("circular_signals"), "Circular GST trading pattern detected — revenue inflation suspected (hard stop)"),
        ("FRAUD_002", "HIGH", 25, F.coalesce("gst_vs_bank_gap", F.lit(0.0)) > 25, "GST declared revenue and bank credits mismatch by more than 25%"),
        ("LIT_001", "HIGH", 20, count("litigation_count") >= 3, "3 or more active litigation cases — legal contingency risk"),
        ("LIT_002", "CRITICAL", 40, yes("recovery_suit"), "Active recovery suit / DRT case — prior loan default indicator (hard stop)"),
        ("COND_001", "MEDIUM", 15, (capacity > 0) & (capacity < 50), "Factory operating below 50% capacity — underutilization, projected cash flows adjusted"),
        ("COND_002", "LOW", 5, yes("sector_headwinds"), "Active RBI/SEBI regulatory restriction on sector"),
    ]


def violations() -> Column:
    return present([
        (cond, F.struct(F.lit(i).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(pen).cast("bigint").alias("penalty"), F.lit(text).alias("message")))
        for i, sev, pen, cond, text in policy_rules()
    ])


def violation_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select("company_id", F.inline(violations()))


def rule_scores(profiles: DataFrame) -> DataFrame:
    strengths = present([
        (F.coalesce("dscr", F.lit(0.0)) >= 1.5, F.lit("Strong DSCR above 1.5x — comfortable debt servicing capacity")),
        (F.coalesce("current_ratio", F.lit(0.0)) >= 2.0, F.lit("Healthy current ratio above 2.0 — good liquidity position")),
        (~F.coalesce("circular_signals", F.lit(False)), F.lit("No circular trading detected — GST transactions appear genuine")),
        (F.col("auditor_opinion") == "unqualified", F.lit("Clean unqualified auditor opinion — financial statements reliable")),
    ])
    v = profiles.select("*", violations().alias("violations"))
    penalty = F.aggregate("violations", F.lit(0).cast("bigint"), lambda s, x: s + x["penalty"])
    return v.select(
        "company_id",
        F.greatest(F.lit(100) - penalty, F.lit(0)).cast("double").alias("rule_score"),
        F.exists("violations", lambda x: x["severity"] == "CRITICAL").alias("critical_hit"),
        F.size("violations").cast("bigint").alias("n_violations"),
        F.array_join(strengths, " | ").alias("strengths"))


def hard_rules(vector: DataFrame) -> Column:
    return present([
        (F.col("has_going_concern_doubt") >= 1.0, F.lit("going_concern_doubt")),
        (F.col("gstr3b_vs_2a_itc_gap") > 25.0, F.lit("severe_gst_mismatch")),
    ])


def band(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= low, F.lit(name)) for low, name in BANDS], F.lit("CRITICAL"))


def blend(scores: DataFrame) -> DataFrame:
    """`scores`: company_id, rule_score, stress_probability, critical_hit."""
    final = clip(round_to(F.col("rule_score") * RULE_WEIGHT + (F.lit(1.0) - F.col("stress_probability")) * 100 * MODEL_WEIGHT, 1), 0, 100)
    out = scores.withColumn("final_score", final).withColumn("risk_category", band(F.col("final_score")))
    decision = F.when(F.col("critical_hit") | (F.col("risk_category") == "CRITICAL"), "REJECT").when(F.col("risk_category") == "LOW", "APPROVE").otherwise("CONDITIONAL_APPROVE")
    return out.withColumn("decision", decision).withColumn("premium_bps", F.try_element_at(_bps(PREMIUM_BY_BAND), F.col("risk_category")))


def _bps(table: dict) -> Column:
    return F.create_map(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.lit(x) for kv in table.items() for x in kv])


def working_capital_limit(blended: DataFrame, figures: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    gap = F.greatest(F.coalesce("current_assets", zero) - F.coalesce("current_liabilities", zero), zero)
    limit = F.when(F.col("final_score") < 35, zero).otherwise(round_to(gap * 0.75 * (F.col("final_score") / 100), 1))
    return blended.select("company_id", "final_score").join(figures.select("company_id", "current_assets", "current_liabilities"), "company_id", "left").select(
        "company_id", limit.alias("limit_cr"))


def grade(score: Column) -> Column:
    s = clip(score, 0, 100)
    return F.coalesce(*[F.when(s >= low, F.lit(name)) for low, name in GRADES], F.lit("B"))


def premium(grade_name: Column) -> Column:
    return F.coalesce(F.try_element_at(_bps(PREMIUM_BY_GRADE), grade_name), F.lit(OTHER_PREMIUM).cast("bigint"))


def interest_rate(grade_name: Column) -> Column:
    return round_to(F.lit(BASE_RATE) + premium(grade_name) / 100.0, 2)


def approved_limit(requested: Column, revenue: Column, grade_name: Column) -> Column:
    cap = F.greatest(F.coalesce(revenue, F.lit(0.0)), F.lit(0.0)) * REVENUE_SHARE
    return round_to(F.least(F.greatest(F.coalesce(requested, F.lit(0.0)), F.lit(0.0)), cap) * lookup(LIMIT_BY_GRADE, grade_name, OTHER_LIMIT), 2)


def decide(inputs: DataFrame) -> DataFrame:
    """Decision row per company.

    `inputs` is the credit vector (news flags already zeroed) plus model_score, stress_probability,
    completeness, requested_cr, revenue_used_cr, is_fallback.
    """
    hits = hard_rules(inputs)
    rejected = F.size("rule_hits") > 0
    impact = F.col("due_diligence_risk_adjustment") * 3.0
    raw = clip(F.col("model_score") - F.col("stress_probability") * 220.0 + impact, 0, 900)
    step = inputs.withColumn("rule_hits", hits).withColumn("raw_score", raw)
    step = step.withColumn("raw_normalized", round_to(F.col("raw_score") / 900.0 * 100, 1))
    over = F.col("is_fallback") & (F.col("raw_normalized") > 70)
    step = step.withColumns({
        "credit_score": F.when(rejected, 450.0).when(over, F.least(F.col("raw_score"), F.lit(630.0))).otherwise(F.col("raw_score")),
        "normalized_score": F.when(rejected, 50.0).when(over, 70.0).otherwise(F.col("raw_normalized")),
    })
    n = F.col("normalized_score")
    step = step.withColumn(
        "recommendation", F.when(rejected | (n < 50), "REJECT").when((n >= 60) & (n < 70), "CONDITIONAL_APPROVE").otherwise("APPROVE"))
    step = step.withColumn("risk_grade", F.when(F.col("recommendation") == "REJECT", "D").otherwise(grade(n)))
    half = F.greatest(F.lit(12.0), (F.lit(1.0) - F.col("completeness")) * 70)
    whole = lambda c: F.floor(c).cast("string")
    return step.select(
        "company_id",
        round_to("credit_score", 2).alias("credit_score"),
        "normalized_score",
        F.when(rejected, "300-599").otherwise(F.concat(whole(F.greatest(F.lit(0.0), n - 5)), F.lit("-"), whole(F.least(F.lit(100.0), n + 5)))).alias("score_band"),
        "risk_grade",
        "recommendation",
        approved_limit(F.col("requested_cr"), F.col("revenue_used_cr"), F.col("risk_grade")).alias("recommended_limit_cr"),
        interest_rate(F.col("risk_grade")).alias("interest_rate"),
        premium(F.col("risk_grade")).alias("premium_bps"),
        F.when(rejected, 420.0).otherwise(round_to(F.greatest(F.lit(0.0), F.col("credit_score") - half), 2)).alias("confidence_low"),
        F.when(rejected, 480.0).otherwise(round_to(F.least(F.lit(900.0), F.col("credit_score") + half), 2)).alias("confidence_high"),
        F.when(rejected, 0.0).otherwise(round_to(impact, 2)).alias("human_input_points"),
        F.array_join("rule_hits", ",").alias("rule_hits"),
        F.when(F.col("is_fallback"), FALLBACK_WARNING).otherwise("").alias("warnings"),
    )


def derived_scores(decisions: DataFrame) -> DataFrame:
    s = F.col("credit_score")
    return decisions.select(
        "company_id", round_to(clip((F.lit(900.0) - s) / 600.0, 0, 1), 6).alias("stress_share"), round_to(clip((s - 300.0) / 6.0, 0, 100), 6).alias("swot_score"))


def five_cs(vector: DataFrame) -> DataFrame:
    """Five axes, 1 to 10 each, in wide form."""
    c = F.col
    step = lambda cond, v: F.when(cond, v).otherwise(0.0)
    character = F.greatest(F.lit(1.0), F.lit(10.0) - (
        c("has_promoter_fraud_news") * 3.5 + c("has_mca_struck_off_associates") * 2.5 + c("has_auditor_qualification") * 2.0
        + c("has_going_concern_doubt") * 2.0 + c("has_litigation") * 1.5 + step(c("management_integrity_score") < 5, 1.5) + step(c("gstr3b_vs_2a_itc_gap") > 20, 1.0)))
    capacity = c("dscr") * 2.5 + c("interest_coverage_ratio") * 0.8 + c("factory_capacity_utilization") / 100.0 * 3 + c("ebitda_margin") / 100.0 * 8
    capital = F.lit(10.0) - c("debt_equity_ratio") * 1.5 + c("current_ratio") * 1.2
    collateral = c("collateral_coverage_ratio") * 3.5 + c("collateral_type_score") / 2.5
    conditions = F.lit(8.0) - (c("has_sector_headwinds") * 2.5 + c("has_revenue_inflation_signals") * 2.0 + c("has_nclt_proceedings") * 1.5 + c("has_circular_trading_signals") * 1.5)
    axes = {"character": character, "capacity": clip(capacity, 1, 10), "capital": clip(capital, 1, 10), "collateral": clip(collateral, 1, 10), "conditions": clip(conditions, 1, 10)}
    return vector.select("company_id", *[round_to(v, 2).alias(k) for k, v in axes.items()])


def _axes_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["company_id"], list(BENCHMARK), "axis", "score")


def five_c_levels(wide: DataFrame) -> DataFrame:
    s = F.col("score")
    return _axes_long(wide).select("company_id", "axis", "score", F.when(s >= 7.5, "LOW").when(s >= 5.0, "MEDIUM").otherwise("HIGH").alias("risk_level"))


def five_c_benchmark(wide: DataFrame) -> DataFrame:
    mark = lookup(BENCHMARK, F.col("axis"), None)
    return _axes_long(wide).select("company_id", "axis", "score", mark.alias("benchmark"), round_to(F.col("score") - mark, 2).alias("difference"))


def five_cs_short(vector: DataFrame) -> DataFrame:
    """The simpler axes used where the full ones are missing; zero counts as missing."""
    z = lambda name, v: zero_as_missing(F.col(name), v)
    axes = {
        "character": F.lit(10.0) - F.col("has_promoter_fraud_news") * 4 - F.col("has_mca_struck_off_associates") * 3
        - F.when(z("management_integrity_score", 6.0) < 5, 2.0).otherwise(0.0),
        "capacity": z("dscr", 1.2) * 3 + z("interest_coverage_ratio", 2.0) + z("factory_capacity_utilization", 60.0) / 20,
        "capital": F.lit(9.0) - z("debt_equity_ratio", 1.5) + z("current_ratio", 1.3),
        "collateral": z("collateral_coverage_ratio", 1.1) * 4 + z("collateral_type_score", 5.0) / 2,
        "conditions": F.lit(8.0) - F.col("has_sector_headwinds") * 2.5 - F.col("has_revenue_inflation_signals") * 2,
    }
    return vector.select("company_id", *[round_to(clip(v, 1, 10), 4).alias(k) for k, v in axes.items()])


def stress_grid(scores: DataFrame, drops: list[int] = SCENARIOS) -> DataFrame:
    """Each company under each revenue drop; the scenarios are a short constant list."""
    drop = F.col("drop_pct")
    stressed = clip(F.col("final_score") - drop / 10.0 * 8, 0, 100)
    return scores.select("company_id", "final_score", F.explode(F.array(*[F.lit(d).cast("bigint") for d in drops])).alias("drop_pct")).select(
        "company_id", "drop_pct",
        round_to(stressed, 0).alias("stressed_score"),
        F.when(stressed >= 75, "APPROVE").when(stressed >= 50, "CONDITIONAL APPROVE").otherwise("REJECT").alias("stressed_decision"),
        round_to(drop / 10.0 * 8, 0).alias("score_reduction"),
        round_to(drop * 0.8, 4).alias("ebitda_impact_pct"),
        round_to(drop * 0.6, 4).alias("dscr_impact_pct"))


def label_score(vector: DataFrame) -> DataFrame:
    """Rule-made training targets from a real feature table: stress signal, label and score."""
    c = F.col
    step = lambda cond, v: F.when(cond, v).otherwise(0.0)
    signal = (
        (c("has_going_concern_doubt") + c("has_nclt_proceedings")) * 0.8 + c("has_promoter_fraud_news") * 0.5 + step(c("gstr3b_vs_2a_itc_gap") > 15, 0.4)
        + step(c("dscr") < 1.1, 0.3) + step(c("debt_equity_ratio") > 2.5, 0.25))
    score = (
        F.lit(780.0) + c("dscr") * 40 + c("interest_coverage_ratio") * 25 + c("management_integrity_score") * 8 - c("gstr3b_vs_2a_itc_gap") * 3
        - c("has_litigation") * 35 - c("has_promoter_fraud_news") * 60 + c("due_diligence_risk_adjustment") * 1.5)
    return vector.select(
        "company_id", round_to(signal, 4).alias("stress_signal"), (round_to(signal, 4) > 0.9).cast("int").cast("double").alias("stress_label"),
        round_to(clip(score, 300, 900), 6).alias("target_score"))


def stress_rule(calibrator: DataFrame, profiles: DataFrame) -> DataFrame:
    """Second label rule: thin cover, recovery suit, large mismatch or promoter flag."""
    joined = calibrator.join(profiles.select("company_id", F.coalesce("recovery_suit", F.lit(False)).alias("recovery_suit")), "company_id")
    hit = (F.col("dscr") < 1.2) | F.col("recovery_suit") | (F.col("gst_bank_mismatch_pct") > 30) | (F.col("promoter_red_flag") == 1)
    return joined.select("company_id", hit.cast("int").cast("double").alias("stress_label"))


ALL_FEATURES = CREDIT_FEATURES + EXTRA_FEATURES


def feature_completeness(vector: DataFrame) -> DataFrame:
    return vector.select("company_id", round_to(completeness(ALL_FEATURES), 6).alias("completeness"))
