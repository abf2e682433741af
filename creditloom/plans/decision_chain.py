"""From sources to decisions: the blocks of a company, its vectors and its decision. Small steps are staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import round_to
from creditloom.operators import diligence as D
from creditloom.operators import features as E
from creditloom.operators import findings as N
from creditloom.operators import memo as M
from creditloom.operators import payloads as P
from creditloom.operators import scoring as S
from creditloom.operators import textjobs as X
from creditloom.operators import workbook as W
from creditloom.plans import chain
from creditloom.plans.findings_queries import gathered
from creditloom.plans.text_queries import _portfolio
from creditloom.sources.tables import Tables


def doc_facts(t: Tables) -> DataFrame:
    return t.staged("doc_facts", lambda: X.facts(t.doc_text))


def doc_block(t: Tables) -> DataFrame:
    """Document facts folded to one row per company."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    some = lambda c: F.bool_or(F.size(c) > 0)
    return doc_facts(t).groupBy("company_id").agg(
        F.bool_or("going_concern").alias("going_concern"), some("auditor_notes").alias("auditor_qualified"),
        F.when(some("auditor_notes"), "qualified").otherwise("unqualified").alias("auditor_opinion"),
        F.sum(F.size("bank_limits")).alias("charge_count"), F.max("concentration_pct").alias("concentration_pct"),
        first("rating_action"), first("rating_grade"), first("partner"),
        F.when(some("collateral"), 1.35).alias("collateral_coverage_ratio"), F.when(some("collateral"), 7.5).alias("collateral_type_score"))


def research_block(t: Tables) -> DataFrame:
    """Summary over all findings."""
    return N.research_summary(gathered(t, N.SUMMED)).select(
        "company_id", "fraud_hits", "litigation_count", "sector_headwinds", "has_nclt", F.col("has_nclt").alias("recovery_suit"))


def blocks(t: Tables) -> DataFrame:
    return t.staged("blocks", lambda: _blocks(t))


def _blocks(t: Tables) -> DataFrame:
    sums = lambda: t.staged("facility_sums", lambda: P.facility_sums(t.facilities))
    t.together(lambda: chain.assembled(t), lambda: doc_facts(t), sums)
    figures = chain.figures(t).select(
        "company_id", "interest_coverage", "current_ratio", "ebitda_margin", "revenue", "profit_after_tax", "current_assets", "current_liabilities",
        "contingent", "net_worth", "total_debt", "debt_equity_ratio", "dscr")
    report = chain.report(t).select("company_id", "gst_vs_bank_gap", "itr_vs_gst_gap", F.col("dscr").alias("reconciled_dscr"), "consistency_score")
    bank = chain.bank(t).filter("has_ledger").select("company_id", "banking_to_gst_ratio", "abb_to_revenue", F.col("shell_count").alias("bounced_cheques"))
    borrowing = P.borrowing_summary(sums()).select(
        "company_id", "within_1yr_pct", "weighted_cost_pct", round_to(F.col("total_outstanding") / 1e7, 4).alias("existing_debt_cr"))
    registry = t.registry.select(
        "company_id", F.col("struck_off").isNotNull().alias("struck_off"), "compliance_score",
        (F.col("struck_off").isNotNull() & (F.col("compliance_score") < 70)).alias("director_disqualified"))
    return E.assemble_blocks(t.company, [
        figures, report, bank, E.tax_block(chain.mismatch(t), chain.recon(t)), E.filing_consistency(t.monthly["gstr3b"]), E.growth(t.itr),
        doc_block(t), research_block(t), registry, D.diligence_block(t.company, t.diligence),
        chain.holding(t).select("company_id", "promoter_holding_pct", "promoter_pledge_pct"), borrowing, _portfolio(sums()).drop("red_flags", "stage_3_pct"),
    ]).withColumns({"bureau_score": F.lit(None).cast("double"), "liquidity_gap_cr": F.lit(None).cast("double")})


def vector(t: Tables) -> DataFrame:
    return E.credit_vector(blocks(t))


def merged(t: Tables) -> DataFrame:
    return M.merged_scalars(doc_facts(t), chain.figures(t))


def limit_revenue(t: Tables) -> DataFrame:
    none = F.lit(None).cast("double")
    series = doc_facts(t).groupBy("company_id").agg(F.max(F.array_max(F.transform("revenue_series", lambda x: x["amount"]))).alias("largest"))
    rows = t.company.select("company_id", "declared_turnover_cr").join(merged(t).select("company_id", "revenue_cr"), "company_id", "left").join(series, "company_id", "left")
    return W.revenue_for_limit(rows.select(
        "company_id", "revenue_cr", none.alias("annual_revenue_cr"), none.alias("gross_receipts_cr"), none.alias("revenue_crore"),
        F.array_compact(F.array("largest")).alias("revenue_figures"), "declared_turnover_cr"))


def rule_model(t: Tables) -> DataFrame:
    """Score and stress share made by the label rules; stands where no trained model is given."""
    labels = S.label_score(vector(t))
    return labels.select("company_id", F.col("target_score").alias("model_score"), F.least(F.col("stress_signal"), F.lit(1.0)).alias("stress_probability"))


def decisions(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """Decision rows. `scores`: company_id, model_score, stress_probability."""
    full = vector(t)
    share = S.feature_completeness(full)
    inputs = (
        E.without_news(full).join(share, "company_id").join(scores if scores is not None else rule_model(t), "company_id")
        .join(limit_revenue(t).select("company_id", "revenue_used_cr", "is_fallback"), "company_id")
        .join(t.company.select("company_id", "requested_cr"), "company_id"))
    return S.decide(inputs)


def staged_decisions(t: Tables) -> DataFrame:
    return t.staged("decisions", lambda: decisions(t))


def blended(t: Tables) -> DataFrame:
    rules = S.rule_scores(blocks(t)).select("company_id", "rule_score", "critical_hit")
    return S.blend(rules.join(rule_model(t).select("company_id", "stress_probability"), "company_id"))
