"""Due-diligence notes: enrichment, pattern scoring, carry-forward, the score block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import clip, has_any, present, rlike_first
from creditloom.operators.ledger import carry_forward

# Note patterns and labels.
RISK_PATTERNS = [
    "idle machinery", "overstated inventory", "power outage", "payment delay", "evasiv", "refused", r"non[-\s]?cooperative",
    "low inventory", "suspicious", "contingent liabilit", "worker unrest", "compliance gap",
]
GOOD_PATTERNS = [
    "new order", "export growth", "automation", "cooperative", "adequate inventory", "healthy inventory", "timely", "healthy demand", "expansion",
]
LABELLED = [
    ("capacity_utilization_percent", "capacity_utilization_percent"), ("inventory_levels", "inventory_levels"),
    ("management_cooperation", "management_cooperation"), ("management_interview_rating", "management_interview_rating"),
    ("finance_officer_name", "borrower_finance_officer_name"), ("business_highlights", "borrower_business_highlights"),
    ("major_customers", "borrower_major_customers"), ("contingent_liabilities", "borrower_contingent_liabilities"),
    ("planned_capex", "borrower_planned_capex"), ("disclosed_risks", "borrower_disclosed_risks"),
]
CARRIED_FIELDS = ["officer_name", "officer_role"]


def _hits(text: Column, patterns: list[str]) -> Column:
    return sum((F.when(text.rlike(p), 1.0).otherwise(0.0) for p in patterns), F.lit(0.0))


def score_notes(notes: DataFrame) -> DataFrame:
    """Score adjustment, sentiment and concerns per note. `notes`: company_id, seq, note."""
    low = F.lower("note")
    cap = rlike_first(low, r"capacity_utilization_percent:\s*(\d+)").try_cast("bigint")
    rating = rlike_first(low, r"management_interview_rating:\s*(\d+)").try_cast("bigint")
    says = lambda s: F.contains(low, F.lit(s))
    zero = F.lit(0.0)
    cap_points = F.when(cap < 45, -12.0).when(cap < 60, -6.0).when(cap >= 80, 6.0).otherwise(zero)
    rating_points = F.when(rating <= 2, -10.0).when(rating >= 4, 4.0).otherwise(zero)
    stock = F.when(says("inventory_levels: suspicious"), -10.0).when(says("inventory_levels: low"), -5.0).when(says("inventory_levels: adequate"), 2.0).otherwise(zero)
    manner = F.when(says("management_cooperation: refused"), -12.0).when(says("management_cooperation: evasive"), -8.0).when(says("management_cooperation: cooperative"), 3.0).otherwise(zero)
    risks, goods = _hits(low, RISK_PATTERNS), _hits(low, GOOD_PATTERNS)
    points = clip(clip(goods * 4.0 - risks * 10.0, -50, 20) + F.coalesce(cap_points, zero) + F.coalesce(rating_points, zero) + stock + manner, -50, 20)
    labelled = [cap_points, rating_points, stock, manner]
    risk_count = risks + sum((F.when(p < 0, 1.0).otherwise(0.0) for p in labelled), zero)
    good_count = goods + sum((F.when(p > 0, 1.0).otherwise(0.0) for p in labelled), zero)
    concerns = present([
        (risk_count > 0, F.lit("Field visit identified operational risk signals.")),
        (says("inventory"), F.lit("Inventory quality and valuation to be validated quarterly.")),
        (says("capacity") & says("40"), F.lit("Low observed capacity utilization may pressure debt servicing.")),
    ])
    return notes.select(
        "company_id", "seq", points.alias("score_adjustment"),
        F.when(points <= -10, "NEGATIVE").when(points >= 8, "POSITIVE").otherwise("NEUTRAL").alias("sentiment"),
        risk_count.cast("bigint").alias("risk_count"), good_count.cast("bigint").alias("positive_count"), F.array_join(concerns, " | ").alias("concerns"))


def enriched_note(submissions: DataFrame) -> DataFrame:
    """Free text plus ten labelled fields, one per line; a missing field prints None, empty free text is left out."""
    parts = [F.nullif(F.coalesce("free_text_notes", F.lit("")), F.lit(""))]
    for label, field in LABELLED:
        value = F.col(field).cast("string") if field in submissions.columns else F.lit(None).cast("string")
        parts.append(F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("None"))))
    return submissions.select("company_id", "seq", F.concat_ws("\n", *parts).alias("note"))


def carried_fields(versions: DataFrame) -> DataFrame:
    """Blank borrower fields take the value of the nearest earlier submission that had one."""
    blank_free = versions.select("company_id", "version_id", "created_at", *[F.nullif(F.trim(c), F.lit("")).alias(c) for c in CARRIED_FIELDS])
    filled = carry_forward(blank_free, ["company_id"], "created_at", ["version_id"], CARRIED_FIELDS)
    return filled.select("company_id", "version_id", *[F.col(f"{c}_filled").alias(c) for c in CARRIED_FIELDS])


def latest_record(versions: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Newest record per company. A plain aggregate, combined before the shuffle."""
    return versions.groupBy("company_id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select("company_id", "v.*")


def diligence_block(companies: DataFrame, submissions: DataFrame) -> DataFrame:
    """Integrity, capacity and adjustment from the latest submission; fixed values without one."""
    scored = score_notes(enriched_note(submissions)).select("company_id", "seq", "score_adjustment")
    latest = latest_record(
        submissions, ["seq"], ["seq", "management_interview_rating", "capacity_utilization_percent"]
    ).join(scored, ["company_id", "seq"])
    known = F.col("seq").isNotNull()
    return companies.select("company_id").join(latest, "company_id", "left").select(
        "company_id",
        F.when(known, F.coalesce(F.col("management_interview_rating").cast("double"), F.lit(3.0)) * 2).otherwise(6.0).alias("management_integrity_score"),
        F.when(known, F.coalesce(F.col("capacity_utilization_percent").cast("double"), F.lit(65.0))).otherwise(65.0).alias("factory_capacity_utilization"),
        F.when(known, F.col("score_adjustment")).otherwise(0.0).alias("due_diligence_risk_adjustment"),
    )
