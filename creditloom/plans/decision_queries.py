"""Registered queries: features, rules, scores, explanations, graph, SWOT, memo tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import diligence as D
from creditloom.operators import explain as H
from creditloom.operators import features as E
from creditloom.operators import graph as G
from creditloom.operators import memo as M
from creditloom.operators import reconcile as R
from creditloom.operators import scoring as S
from creditloom.operators import textjobs as X
from creditloom.plans import chain
from creditloom.plans import decision_chain as C
from creditloom.plans.findings_queries import as_of
from creditloom.sources.tables import Tables


def _managed(t: Tables) -> DataFrame:
    return t.company.withColumn("managers", F.array_compact(F.array("promoter_a", "promoter_b")))


def _sentences(t: Tables) -> DataFrame:
    return C.doc_facts(t).select("company_id", "doc_id", F.posexplode("related_parties").alias("pos", "sentence"))


def _limits(t: Tables) -> DataFrame:
    return C.doc_facts(t).select("company_id", "doc_id", F.posexplode("bank_limits").alias("pos", "b")).select("company_id", "doc_id", "pos", "b.lender", "b.limit_amount")


def _promoters(t: Tables) -> DataFrame:
    return G.promoters(_managed(t), X.holders(t.doc_text), chain.holding(t))


def _members(t: Tables) -> DataFrame:
    c, s = t.company, _sentences(t)
    return G.members(_promoters(t), G.subsidiaries(c, s), G.lenders(c, _limits(t)), G.partners(c, s), G.agencies(c, s))


def _candidate_names(t: Tables) -> DataFrame:
    names = X.holders(t.doc_text).select("company_id", "name").unionByName(_limits(t).select("company_id", F.col("lender").alias("name"))).distinct()
    return names.join(t.company.select("company_id", "company_name"), "company_id").select(
        "company_id", "name", G.valid_entity(F.col("name"), F.col("company_name")).alias("is_valid"))


def _swot(t: Tables) -> DataFrame:
    return M.swot(M.swot_input(C.blocks(t)), C.staged_decisions(t))


def _grades(t: Tables) -> DataFrame:
    d = C.staged_decisions(t)
    return d.select("company_id", "normalized_score", S.grade(F.col("normalized_score")).alias("grade"))


def _prices(t: Tables) -> DataFrame:
    g = _grades(t)
    return g.select("company_id", "grade", S.premium(F.col("grade")).alias("premium_bps"), S.interest_rate(F.col("grade")).alias("interest_rate"))


def _limits_by_grade(t: Tables) -> DataFrame:
    rows = _grades(t).join(t.company.select("company_id", "requested_cr"), "company_id").join(C.limit_revenue(t), "company_id")
    return rows.select("company_id", S.approved_limit(F.col("requested_cr"), F.col("revenue_used_cr"), F.col("grade")).alias("approved_cr"))


def _join_4(t: Tables) -> DataFrame:
    return C.blocks(t).select(
        "company_id", "sector", "dscr", "reconciled_dscr", "banking_to_gst_ratio", "itc_gap_pct", "circular_signals", "filing_consistency_pct", "r0", "r1", "r2",
        "auditor_opinion", "fraud_hits", "litigation_count", "has_nclt", "struck_off", "management_integrity_score", "promoter_pledge_pct", "existing_debt_cr", "gnpa_pct")


QUERIES = {
    "join_4_feature_blocks": _join_4,
    "join_5_tax_block": lambda t: E.tax_block(chain.mismatch(t), chain.recon(t)),
    "join_9_sector_factors": lambda t: E.sector_factors(t.company),
    "win_9_growth": lambda t: E.growth(t.itr),
    "fea_1_credit_vector": C.vector,
    "fea_2_calibrator_vector": lambda t: E.calibrator_vector(C.blocks(t)),
    "agg_11_completeness": lambda t: S.feature_completeness(C.vector(t)),
    "agg_12_label_summary": lambda t: S.label_score(C.vector(t)).groupBy("stress_label").agg(
        F.count("*").alias("n"), F.min("target_score").alias("min_score"), F.max("target_score").alias("max_score"),
        F.round(F.avg("target_score"), 4).alias("mean_score")),
    "set_6_aligned_frame": lambda t: E.aligned(C.blocks(t)),
    "prj_14_hard_rules": lambda t: C.vector(t).select("company_id", F.array_join(S.hard_rules(C.vector(t)), ",").alias("rule_hits")),
    "prj_15_without_news": lambda t: E.without_news(C.vector(t)),
    "rul_1_policy_rules": lambda t: S.violation_rows(C.blocks(t)),
    "rul_2_rule_scores": lambda t: S.rule_scores(C.blocks(t)),
    "scr_1_blended_score": lambda t: C.blended(t).select("company_id", "rule_score", "stress_probability", "final_score", "risk_category"),
    "scr_2_decision": lambda t: C.blended(t).select("company_id", "critical_hit", "risk_category", "decision", "premium_bps"),
    "scr_3_working_capital_limit": lambda t: S.working_capital_limit(C.blended(t), chain.figures(t)),
    "scr_4_grades": _grades,
    "scr_5_prices": _prices,
    "scr_6_approved_limits": _limits_by_grade,
    "scr_7_decision_rows": lambda t: C.decisions(t),
    "scr_8_derived_scores": lambda t: S.derived_scores(C.staged_decisions(t)),
    "scr_9_five_cs": lambda t: S.five_c_levels(S.five_cs(C.vector(t))),
    "scr_10_five_c_benchmark": lambda t: S.five_c_benchmark(S.five_cs(C.vector(t))),
    "scr_11_stress_grid": lambda t: S.stress_grid(C.blended(t)),
    "scr_12_five_cs_short": lambda t: S.five_cs_short(C.vector(t)),
    "exp_1_approximations": lambda t: H.approximations(C.blocks(t)),
    "exp_2_contributions": lambda t: H.contributions(C.vector(t)),
    "exp_3_narratives": lambda t: H.narratives(C.vector(t)),
    "top_5_factors": lambda t: H.factors(C.vector(t)),
    "top_6_drivers": lambda t: H.drivers(H.approximations(C.blocks(t))),
    "ml_5_labels": lambda t: S.label_score(C.vector(t)).join(
        S.stress_rule(E.calibrator_vector(C.blocks(t)), C.blocks(t)).withColumnRenamed("stress_label", "calibrator_label"), "company_id"),
    "wb_9_merged_facts": C.merged,
    "set_4_merged_lists": lambda t: M.merged_lists(C.doc_facts(t)),
    "wb_10_limit_revenue": C.limit_revenue,
    "prj_13_valid_entities": _candidate_names,
    "gra_1_promoters": _promoters,
    "gra_2_subsidiaries": lambda t: G.subsidiaries(t.company, _sentences(t)),
    "gra_3_partners": lambda t: G.partners(t.company, _sentences(t)),
    "gra_4_agencies": lambda t: G.agencies(t.company, _sentences(t)),
    "gra_5_lenders": lambda t: G.lenders(t.company, _limits(t)),
    "gra_6_nodes": lambda t: G.graph_nodes(t.company, _members(t)),
    "gra_6_links": lambda t: G.graph_links(_members(t)),
    "gra_7_managers": lambda t: G.managers(_managed(t)),
    "agg_14_graph_counts": lambda t: G.graph_counts(t.company, _members(t)),
    "swo_1_swot_input": lambda t: M.swot_input(C.blocks(t)),
    "swo_2_swot_points": lambda t: M.swot_points(_swot(t)),
    "mem_1_risk_matrix": lambda t: M.risk_matrix(
        H.factors(C.vector(t), None).filter("side = 'negative'"), R.long_list(chain.report(t), "anomalies"), R.long_list(chain.report(t), "indicators")),
    "mem_2_covenants": lambda t: M.covenants(C.vector(t), chain.report(t)),
    "mem_5_profile_rows": lambda t: M.profile_rows(
        t.company, D.latest_record(t.versions, ["created_at", "version_id"], ["version_id", "status", "amount"]),
        C.staged_decisions(t).select("company_id", "credit_score", "normalized_score", "risk_grade", "recommendation"), as_of()),
    "mem_6_metric_rows": lambda t: M.metric_rows(C.vector(t), chain.report(t)),
    "mem_6_executive_lines": lambda t: M.executive_lines(C.staged_decisions(t)),
}
