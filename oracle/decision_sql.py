from creditloom.operators import features as E
from creditloom.operators import graph as G
from creditloom.operators import memo as M
from creditloom.operators import scoring as S
from creditloom.operators import textjobs as X
from creditloom.operators.explain import RISK_FEATURES, STRENGTH_FEATURES
from oracle import findings_sql, reconcile_sql, text_sql  # noqa: F401
from oracle.findings_sql import summary
from oracle.kit import CTES, SQL, any_of, crore, pct, r, ratio, short, squeeze
from oracle.text_sql import ex

q = lambda s: s.replace("'", "''")
inlist = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
case_map = lambda e, m, d: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" ELSE {d} END"
dbl = lambda e: f"CAST({e} AS DOUBLE)"
MULT = dbl(case_map("sector", E.SECTOR_MULTIPLIER, 1.0))

CTES["c_growth"] = """
SELECT company_id, r0, r1, r2, sqrt(greatest(r0, 1) / greatest(r2, 1)) - 1 AS revenue_cagr_3yr, CASE WHEN r1 <> 0 THEN (r0 - r1) / r1 ELSE 0 END AS revenue_growth_yoy, r0 < r1 AND r1 < r2 AS is_declining
FROM (SELECT company_id, s[1] AS r0, coalesce(s[2], s[-1]) AS r1, coalesce(s[3], s[-1]) AS r2 FROM (SELECT company_id, list(gross_revenue ORDER BY assessment_year DESC) AS s FROM c_itr GROUP BY 1) a) b"""
CTES["c_filing"] = f"SELECT company_id, {r('count(DISTINCT period) / (date_diff(\'month\', min(period), max(period)) + 1) * 100', 2)} AS filing_consistency_pct FROM c_gstr3b GROUP BY 1"
CTES["c_taxblock"] = """
SELECT coalesce(m.company_id, x.company_id) AS company_id, CASE WHEN itc_mismatch_pct > 0 THEN itc_mismatch_pct ELSE coalesce(itc_inflation_pct, 0) END AS itc_gap_pct,
  coalesce(suspected_circular, false) OR coalesce(has_circular_signals, false) AS circular_signals, coalesce(revenue_inflation_flag, false) OR coalesce(has_itc_mismatch AND itc_mismatch_pct > 0, false) AS revenue_inflation
FROM c_mismatch_all m FULL JOIN c_recon x ON m.company_id = x.company_id"""
CTES["c_rating"] = f"SELECT doc_id, company_id, TRY_CAST({ex(X.CONCENTRATION)} AS DOUBLE) AS concentration_pct, upper({ex(X.RATING_ACTION)}) AS rating_action, upper({ex(X.RATING_GRADE)}) AS rating_grade, {squeeze(ex(X.PARTNER))} AS partner FROM c_doc_text"
CTES["c_collateral"] = f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(doc_text, chr(10))) AS s FROM c_doc_text) x WHERE {any_of('lower(s)', X.COLLATERAL_WORDS)} AND length({squeeze('s')}) > 12"
CTES["c_docblock"] = """
SELECT f.company_id, bool_or(going_concern) AS going_concern, bool_or(has_auditor) AS auditor_qualified, CASE WHEN bool_or(has_auditor) THEN 'qualified' ELSE 'unqualified' END AS auditor_opinion,
  CAST(sum(coalesce(n_limits, 0)) AS BIGINT) AS charge_count, max(concentration_pct) AS concentration_pct, arg_min(rating_action, f.doc_id) FILTER (WHERE rating_action IS NOT NULL) AS rating_action,
  arg_min(rating_grade, f.doc_id) FILTER (WHERE rating_grade IS NOT NULL) AS rating_grade, arg_min(partner, f.doc_id) FILTER (WHERE partner IS NOT NULL) AS partner, bool_or(c.doc_id IS NOT NULL) AS has_collateral
FROM c_docfacts f JOIN c_rating g ON f.doc_id = g.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n_limits FROM c_limits GROUP BY 1) l ON f.doc_id = l.doc_id LEFT JOIN c_collateral c ON f.doc_id = c.doc_id GROUP BY 1"""
CTES["c_research"] = summary("c_gathered")
CTES["c_blocks"] = f"""
SELECT c.company_id, c.company_name, c.sector, c.declared_turnover_cr, c.requested_cr, interest_coverage, current_ratio, ebitda_margin, revenue, profit_after_tax, current_assets, current_liabilities, contingent, net_worth, total_debt, debt_equity_ratio, w.dscr,
  gst_vs_bank_gap, itr_vs_gst_gap, p.dscr AS reconciled_dscr, consistency_score, CASE WHEN has_ledger THEN banking_to_gst_ratio END AS banking_to_gst_ratio, CASE WHEN has_ledger THEN abb_to_revenue END AS abb_to_revenue, CASE WHEN has_ledger THEN shell_count END AS bounced_cheques,
  itc_gap_pct, circular_signals, revenue_inflation, filing_consistency_pct, r0, r1, r2, revenue_cagr_3yr, revenue_growth_yoy, is_declining, going_concern, auditor_qualified, auditor_opinion, charge_count, concentration_pct, rating_action, rating_grade, partner,
  CASE WHEN has_collateral THEN 1.35 END AS collateral_coverage_ratio, CASE WHEN has_collateral THEN 7.5 END AS collateral_type_score, fraud_hits, litigation_count, sector_headwinds, has_nclt, has_nclt AS recovery_suit,
  struck_off IS NOT NULL AS struck_off, compliance_score, struck_off IS NOT NULL AND compliance_score < 70 AS director_disqualified, management_integrity_score, factory_capacity_utilization, due_diligence_risk_adjustment,
  promoter_holding_pct, promoter_pledge_pct, within_1yr_pct, weighted_cost_pct, {r('total_outstanding / 10000000', 4)} AS existing_debt_cr, gnpa_pct, collection_efficiency_pct
FROM c_company c LEFT JOIN c_wb_facts w ON c.company_id = w.company_id LEFT JOIN c_report p ON c.company_id = p.company_id LEFT JOIN c_bank b ON c.company_id = b.company_id LEFT JOIN c_taxblock t ON c.company_id = t.company_id
LEFT JOIN c_filing fl ON c.company_id = fl.company_id LEFT JOIN c_growth g ON c.company_id = g.company_id LEFT JOIN c_docblock d ON c.company_id = d.company_id LEFT JOIN c_research s ON c.company_id = s.company_id
LEFT JOIN c_registry y ON c.company_id = y.company_id LEFT JOIN c_due u ON c.company_id = u.company_id LEFT JOIN c_holding h ON c.company_id = h.company_id LEFT JOIN c_borrowing o ON c.company_id = o.company_id LEFT JOIN c_portfolio k ON c.company_id = k.company_id"""
f01 = lambda cond: f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"
_values = {
    "revenue_cagr_3yr": "coalesce(revenue_cagr_3yr, 0)", "ebitda_margin": "coalesce(ebitda_margin, 10)", "debt_equity_ratio": f"coalesce(debt_equity_ratio, 1.5) * {MULT}", "current_ratio": "coalesce(current_ratio, 1.4)",
    "interest_coverage_ratio": "coalesce(interest_coverage, 2)", "dscr": f"CAST(CASE WHEN dscr > 0 THEN dscr WHEN reconciled_dscr > 0 THEN reconciled_dscr ELSE 1.3 END AS DOUBLE) / greatest({MULT}, CAST(0.8 AS DOUBLE))",
    "gst_banking_ratio": "coalesce(banking_to_gst_ratio, 1)", "itr_gst_consistency_score": "100 - coalesce(itr_vs_gst_gap, 0)", "average_bank_balance_to_limit_ratio": "coalesce(abb_to_revenue, 0.15)",
    "has_auditor_qualification": f01("auditor_qualified"), "has_going_concern_doubt": f01("going_concern"), "has_litigation": f01("litigation_count > 0"), "has_mca_struck_off_associates": f01("struck_off"),
    "has_circular_trading_signals": f01("circular_signals"), "has_revenue_inflation_signals": f01("revenue_inflation"), "has_promoter_fraud_news": f01("fraud_hits > 0"), "has_sector_headwinds": f01("sector_headwinds"), "has_nclt_proceedings": f01("has_nclt"),
    "gstr3b_vs_2a_itc_gap": "coalesce(itc_gap_pct, 0)", "gst_return_filing_consistency": "coalesce(filing_consistency_pct, 85)", "mca_filing_compliance_score": "coalesce(compliance_score, 80)", "cibil_commercial_score": "700",
    "management_integrity_score": "coalesce(management_integrity_score, 6)", "factory_capacity_utilization": "coalesce(factory_capacity_utilization, 65)", "due_diligence_risk_adjustment": "coalesce(due_diligence_risk_adjustment, 0)",
    "collateral_coverage_ratio": "coalesce(collateral_coverage_ratio, 1.1)", "collateral_type_score": "coalesce(collateral_type_score, 6)", "alm_liquidity_gap_cr": "0", "alm_short_term_borrow_pct": "coalesce(within_1yr_pct, 0)",
    "promoter_holding_pct": "coalesce(promoter_holding_pct, 50)", "pledged_pct": "coalesce(promoter_pledge_pct, 0)", "existing_debt_cr": "coalesce(existing_debt_cr, 0)", "avg_cost_of_debt_pct": "coalesce(weighted_cost_pct, 0)",
    "gnpa_pct": "coalesce(gnpa_pct, 0)", "collection_efficiency": "coalesce(collection_efficiency_pct, 90)",
}
CTES["c_vector"] = "SELECT company_id, " + ", ".join(f"{dbl(v)} AS {k}" for k, v in _values.items()) + " FROM c_blocks"
z = lambda c, d: f"coalesce(nullif({c}, 0), {d})"
EQ = z("net_worth", 1)
_cal = {
    "dscr": z("dscr", 1), "ebitda_margin_pct": "coalesce(ebitda_margin, 0)", "current_ratio": z("current_ratio", 1), "debt_to_equity": f"least(CASE WHEN {EQ} > 0 THEN coalesce(total_debt, 0) / {EQ} ELSE 10 END, 10)",
    "revenue_growth_yoy": "coalesce(revenue_growth_yoy, 0)", "gst_bank_mismatch_pct": "coalesce(gst_vs_bank_gap, 0)", "active_litigation_count": "coalesce(litigation_count, 0)", "promoter_red_flag": f01("fraud_hits > 0"),
    "factory_capacity_pct": z("factory_capacity_utilization", 80), "auditor_qualified": f01("auditor_opinion IN ('qualified', 'adverse')"), "charge_count": "coalesce(charge_count, 0)", "bounced_cheques_12m": "coalesce(bounced_cheques, 0)",
    "sector_risk_index": case_map("sector", E.SECTOR_RISK_INDEX, 5),
}
CTES["c_calibrator"] = "SELECT company_id, " + ", ".join(f"{dbl(v)} AS {k}" for k, v in _cal.items()) + " FROM c_blocks"
_LEV = f"CASE WHEN {EQ} > 0 THEN coalesce(total_debt, 0) / {EQ} ELSE 999 END"
_rule_sql = [
    f"{z('dscr', 999)} < 1", f"{z('dscr', 999)} >= 1 AND {z('dscr', 999)} < 1.25", f"{z('ebitda_margin', 999)} < 5", "coalesce(is_declining, false)", f"{_LEV} > 3", f"{z('current_ratio', 999)} < 1", f"{EQ} < 0",
    "coalesce(fraud_hits, 0) > 0", "coalesce(director_disqualified, false)", "coalesce(auditor_opinion IN ('qualified', 'adverse', 'disclaimer'), false)", "coalesce(circular_signals, false)", "coalesce(gst_vs_bank_gap, 0) > 25",
    "coalesce(litigation_count, 0) >= 3", "coalesce(recovery_suit, false)", f"{z('factory_capacity_utilization', 100)} > 0 AND {z('factory_capacity_utilization', 100)} < 50", "coalesce(sector_headwinds, false)",
]


_RULE_TEXT = [
    ("CAP_001", "CRITICAL", 40, "DSCR below 1.0 — company cannot service debt from operations (hard stop)"), ("CAP_002", "HIGH", 20, "DSCR between 1.0–1.25: thin coverage margin, vulnerable to cash flow stress"),
    ("CAP_003", "HIGH", 15, "EBITDA margin below 5% — low operational profitability"), ("CAP_004", "MEDIUM", 10, "Revenue declining for 3 consecutive years — business contraction signal"),
    ("CAP_005", "HIGH", 20, "Debt-to-Equity above 3x — highly leveraged balance sheet"), ("CAP_006", "HIGH", 15, "Current ratio below 1.0 — negative working capital, liquidity risk"),
    ("CAP_007", "CRITICAL", 50, "Negative net worth — company is technically insolvent (hard stop)"), ("CHAR_001", "HIGH", 25, "Promoter has active fraud/default news — character risk"),
    ("CHAR_002", "CRITICAL", 50, "Director DIN disqualified by MCA — regulatory red flag (hard stop)"), ("CHAR_003", "HIGH", 20, "Auditor gave qualified/adverse opinion — financial statement reliability risk"),
    ("FRAUD_001", "CRITICAL", 60, "Circular GST trading pattern detected — revenue inflation suspected (hard stop)"), ("FRAUD_002", "HIGH", 25, "GST declared revenue and bank credits mismatch by more than 25%"),
    ("LIT_001", "HIGH", 20, "3 or more active litigation cases — legal contingency risk"), ("LIT_002", "CRITICAL", 40, "Active recovery suit / DRT case — prior loan default indicator (hard stop)"),
    ("COND_001", "MEDIUM", 15, "Factory operating below 50% capacity — underutilization, projected cash flows adjusted"), ("COND_002", "LOW", 5, "Active RBI/SEBI regulatory restriction on sector"),
]
CTES["c_violations"] = " UNION ALL ".join(
    f"SELECT company_id, '{i}' AS rule_id, '{s}' AS severity, CAST({p} AS BIGINT) AS penalty, '{q(m)}' AS message FROM c_blocks WHERE {c}" for (i, s, p, m), c in zip(_RULE_TEXT, _rule_sql))
CTES["c_rulescore"] = """
SELECT b.company_id, CAST(greatest(100 - coalesce(p, 0), 0) AS DOUBLE) AS rule_score, coalesce(crit, false) AS critical_hit, coalesce(n, 0) AS n_violations,
  concat_ws(' | ', CASE WHEN dscr >= 1.5 THEN 'Strong DSCR above 1.5x — comfortable debt servicing capacity' END, CASE WHEN current_ratio >= 2 THEN 'Healthy current ratio above 2.0 — good liquidity position' END,
    CASE WHEN NOT coalesce(circular_signals, false) THEN 'No circular trading detected — GST transactions appear genuine' END, CASE WHEN auditor_opinion = 'unqualified' THEN 'Clean unqualified auditor opinion — financial statements reliable' END) AS strengths
FROM c_blocks b LEFT JOIN (SELECT company_id, sum(penalty) AS p, bool_or(severity = 'CRITICAL') AS crit, count(*) AS n FROM c_violations GROUP BY 1) v ON b.company_id = v.company_id"""
D = lambda x: f"CAST({x} AS DOUBLE)"
CTES["c_labels"] = f"""
SELECT company_id, signal AS stress_signal, CAST(signal > 0.9 AS INT)::DOUBLE AS stress_label, {r("greatest(300, least(900, raw))", 6)} AS target_score FROM (
SELECT company_id, {r("(has_going_concern_doubt + has_nclt_proceedings) * 0.8 + has_promoter_fraud_news * 0.5 + CASE WHEN gstr3b_vs_2a_itc_gap > 15 THEN 0.4 ELSE 0 END + CASE WHEN dscr < 1.1 THEN 0.3 ELSE 0 END + CASE WHEN debt_equity_ratio > 2.5 THEN 0.25 ELSE 0 END", 4)} AS signal,
  780 + dscr * 40 + interest_coverage_ratio * 25 + management_integrity_score * 8 - gstr3b_vs_2a_itc_gap * 3 - has_litigation * 35 - has_promoter_fraud_news * 60 + due_diligence_risk_adjustment * 1.5 AS raw FROM c_vector) x"""
_bands = " ".join(f"WHEN final_score >= {lo} THEN '{n}'" for lo, n in S.BANDS)
CTES["c_blended"] = f"""
SELECT *, CASE WHEN critical_hit OR risk_category = 'CRITICAL' THEN 'REJECT' WHEN risk_category = 'LOW' THEN 'APPROVE' ELSE 'CONDITIONAL_APPROVE' END AS decision,
  CAST(CASE risk_category WHEN 'LOW' THEN 50 WHEN 'MODERATE' THEN 150 WHEN 'HIGH' THEN 300 END AS BIGINT) AS premium_bps FROM (
SELECT *, CASE {_bands} ELSE 'CRITICAL' END AS risk_category FROM (SELECT s.company_id, rule_score, critical_hit, least(stress_signal, 1) AS stress_probability, greatest(0, least(100, {r('0.6 * rule_score + 0.4 * (1 - least(stress_signal, 1)) * 100', 1)})) AS final_score
  FROM c_rulescore s JOIN c_labels l ON s.company_id = l.company_id) a) b"""
_all = E.CREDIT_FEATURES + E.EXTRA_FEATURES
CTES["c_complete"] = "SELECT company_id, " + r("(" + " + ".join(f"CAST({f} <> 0 AS INT)" for f in _all) + f") / {len(_all)}", 6) + " AS completeness FROM c_vector"
CTES["c_docmerge"] = """
SELECT company_id, arg_min(cin, o) FILTER (WHERE cin IS NOT NULL) AS cin, arg_min(pan, o) FILTER (WHERE pan IS NOT NULL) AS pan, arg_min(revenue_cr, o) FILTER (WHERE coalesce(revenue_cr, 0) <> 0) AS revenue_cr,
  arg_min(total_debt, o) FILTER (WHERE coalesce(total_debt, 0) <> 0) AS total_debt, bool_or(going_concern) AS going_concern, count(*) AS n_documents
FROM (SELECT *, row_number() OVER (ORDER BY CASE content_type WHEN 'ANNUAL_REPORT' THEN 0 WHEN 'FINANCIAL_STATEMENT' THEN 1 ELSE 2 END, coalesce(revenue_cr, 0) DESC, doc_id) AS o FROM c_docfacts) x GROUP BY 1"""
CTES["c_merged"] = """
SELECT coalesce(d.company_id, w.company_id) AS company_id, cin, pan, coalesce(revenue_cr, nullif(w.revenue, 0)) AS revenue_cr, coalesce(nullif(w.total_debt, 0), d.total_debt) AS total_debt, coalesce(going_concern, false) AS going_concern, coalesce(n_documents, 0) AS n_documents
FROM c_docmerge d FULL JOIN c_wb_facts w ON d.company_id = w.company_id"""
CTES["c_limitrev"] = """
SELECT c.company_id, coalesce(CASE WHEN revenue_cr > 0 THEN revenue_cr END, CASE WHEN largest > 0 THEN largest END, declared_turnover_cr, 0) AS revenue_used_cr,
  CASE WHEN revenue_cr > 0 THEN 'revenue_cr' WHEN largest > 0 THEN 'revenue_figures' ELSE 'declared_turnover' END AS revenue_source, NOT (coalesce(revenue_cr > 0, false) OR coalesce(largest > 0, false)) AS is_fallback
FROM c_company c LEFT JOIN c_merged m ON c.company_id = m.company_id LEFT JOIN (SELECT d.company_id, max(amount) AS largest FROM c_money y JOIN c_doc_text d ON y.doc_id = d.doc_id WHERE kind = 'revenue' GROUP BY 1) s ON c.company_id = s.company_id"""
_grade = lambda e: "CASE " + " ".join(f"WHEN {e} >= {lo} THEN '{g}'" for lo, g in S.GRADES) + " ELSE 'B' END"
PREM = lambda g: f"CAST({case_map(g, S.PREMIUM_BY_GRADE, 300)} AS BIGINT)"
LIM = lambda g: dbl(case_map(g, S.LIMIT_BY_GRADE, 0.7))
_limit = lambda g: r(f"least(greatest(requested_cr, 0), greatest(revenue_used_cr, 0) * 0.25) * {LIM(g)}", 2)
CTES["c_decisions"] = f"""
SELECT company_id, {r('score', 2)} AS credit_score, n AS normalized_score, CASE WHEN hits <> '' THEN '300-599' ELSE concat(CAST(floor(greatest(0, n - 5)) AS BIGINT), '-', CAST(floor(least(100, n + 5)) AS BIGINT)) END AS score_band, risk_grade, recommendation,
  {_limit('risk_grade')} AS recommended_limit_cr, {r('8.5 + ' + PREM('risk_grade') + ' / 100', 2)} AS interest_rate, {PREM('risk_grade')} AS premium_bps,
  CASE WHEN hits <> '' THEN 420 ELSE {r('greatest(0, score - half)', 2)} END AS confidence_low, CASE WHEN hits <> '' THEN 480 ELSE {r('least(900, score + half)', 2)} END AS confidence_high,
  CASE WHEN hits <> '' THEN 0 ELSE {r('impact', 2)} END AS human_input_points, hits AS rule_hits, CASE WHEN is_fallback THEN '{S.FALLBACK_WARNING}' ELSE '' END AS warnings
FROM (SELECT *, CASE WHEN recommendation = 'REJECT' THEN 'D' ELSE {_grade('n')} END AS risk_grade FROM (
SELECT *, CASE WHEN hits <> '' OR n < 50 THEN 'REJECT' WHEN n >= 60 AND n < 70 THEN 'CONDITIONAL_APPROVE' ELSE 'APPROVE' END AS recommendation FROM (
SELECT *, CASE WHEN hits <> '' THEN 450 WHEN is_fallback AND rn > 70 THEN least(raw, 630) ELSE raw END AS score, CASE WHEN hits <> '' THEN 50 WHEN is_fallback AND rn > 70 THEN 70 ELSE rn END AS n FROM (
SELECT *, {r('raw / 900 * 100', 1)} AS rn FROM (
SELECT v.company_id, requested_cr, revenue_used_cr, is_fallback, greatest(12, (1 - completeness) * 70) AS half, due_diligence_risk_adjustment * 3 AS impact,
  concat_ws(',', CASE WHEN has_going_concern_doubt >= 1 THEN 'going_concern_doubt' END, CASE WHEN gstr3b_vs_2a_itc_gap > 25 THEN 'severe_gst_mismatch' END) AS hits,
  greatest(0, least(900, target_score - least(stress_signal, 1) * 220 + due_diligence_risk_adjustment * 3)) AS raw
FROM c_vector v JOIN c_labels l ON v.company_id = l.company_id JOIN c_limitrev m ON v.company_id = m.company_id JOIN c_complete k ON v.company_id = k.company_id JOIN c_company c ON v.company_id = c.company_id) a) b) d) e) f"""
CTES["c_fivec"] = f"""
SELECT company_id, {r('greatest(1, 10 - (has_promoter_fraud_news * 3.5 + has_mca_struck_off_associates * 2.5 + has_auditor_qualification * 2 + has_going_concern_doubt * 2 + has_litigation * 1.5 + CASE WHEN management_integrity_score < 5 THEN 1.5 ELSE 0 END + CASE WHEN gstr3b_vs_2a_itc_gap > 20 THEN 1 ELSE 0 END))', 2)} AS character,
  {r('least(10, greatest(1, dscr * 2.5 + interest_coverage_ratio * 0.8 + factory_capacity_utilization / 100 * 3 + ebitda_margin / 100 * 8))', 2)} AS capacity, {r('greatest(1, least(10, 10 - debt_equity_ratio * 1.5 + current_ratio * 1.2))', 2)} AS capital,
  {r('least(10, greatest(1, collateral_coverage_ratio * 3.5 + collateral_type_score / 2.5))', 2)} AS collateral, {r('greatest(1, least(10, 8 - (has_sector_headwinds * 2.5 + has_revenue_inflation_signals * 2 + has_nclt_proceedings * 1.5 + has_circular_trading_signals * 1.5)))', 2)} AS conditions FROM c_vector"""
CTES["c_fivelong"] = " UNION ALL ".join(f"SELECT company_id, '{a}' AS axis, {a} AS score FROM c_fivec" for a in S.BENCHMARK)
_apx = {
    "dscr": f"-({z('dscr', 1.25)} - 1.25) * 0.5", "ebitda_margin_pct": f"-({z('ebitda_margin', 10)} - 10) * 0.02", "current_ratio": f"-({z('current_ratio', 1.5)} - 1.5) * 0.15",
    "debt_to_equity": f"(CASE WHEN {EQ} > 0 THEN coalesce(total_debt, 0) / {EQ} ELSE 5 END - 2) * 0.1", "revenue_growth_yoy": "-0.05", "gst_bank_mismatch_pct": "coalesce(gst_vs_bank_gap, 0) * 0.005",
    "active_litigation_count": "coalesce(litigation_count, 0) * 0.05", "promoter_red_flag": "CASE WHEN fraud_hits > 0 THEN 0.15 ELSE 0 END", "factory_capacity_pct": f"(80 - {z('factory_capacity_utilization', 80)}) * 0.003",
    "auditor_qualified": "CASE WHEN auditor_opinion IN ('qualified', 'adverse') THEN 0.12 ELSE 0 END", "charge_count": "coalesce(charge_count, 0) * 0.02", "bounced_cheques_12m": "coalesce(bounced_cheques, 0) * 0.03", "sector_risk_index": "0.02",
}
CTES["c_approx"] = "SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY abs(contribution) DESC, feature) AS rank_no FROM (" + " UNION ALL ".join(
    f"SELECT company_id, '{k}' AS feature, {r(v, 4)} AS contribution FROM c_blocks" for k, v in _apx.items()) + ") x"
CTES["c_contrib"] = " UNION ALL ".join(f"SELECT company_id, '{f}' AS feature, {f} AS feature_value, {r(f + ' * 0.01', 6)} AS contribution FROM c_vector" for f in _all)
_read = lambda: "array_to_string(list_transform(string_split(feature, '_'), lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), ' ')"
CTES["c_factors"] = f"""
SELECT company_id, side, row_number() OVER (PARTITION BY company_id, side ORDER BY abs(contribution) DESC, feature) AS rank_no, feature, contribution, sentence FROM (
SELECT *, CASE WHEN (feature IN {inlist(RISK_FEATURES)} AND feature_value = 0) OR (feature IN {inlist(STRENGTH_FEATURES)} AND contribution > 0) THEN 'positive' ELSE 'negative' END AS side,
  CASE WHEN feature IN {inlist(RISK_FEATURES)} AND feature_value = 0 THEN concat('No ', {_read()}, ' detected - positive governance signal') WHEN feature IN {inlist(RISK_FEATURES)} THEN concat({_read()}, ' flagged - increases credit risk')
    WHEN feature IN {inlist(STRENGTH_FEATURES)} AND contribution > 0 THEN concat({_read()}, ' supports credit quality (value: ', {short('feature_value', 4)}, ')') WHEN feature IN {inlist(STRENGTH_FEATURES)} THEN concat({_read()}, ' constrains credit quality (value: ', {short('feature_value', 4)}, ')')
    ELSE concat({_read()}, ' observed at ', {short('feature_value', 4)}) END AS sentence FROM c_contrib) x"""
_side = lambda s: f"(SELECT company_id, string_agg(sentence, '; ' ORDER BY rank_no) AS t FROM c_factors WHERE rank_no <= 3 AND side = '{s}' GROUP BY 1)"
CTES["c_swotin"] = f"""
SELECT company_id, company_name, promoter_pledge_pct AS pledge, coalesce(rating_action, '') AS rating_action, coalesce(rating_grade, '') AS rating, coalesce(ebitda_margin, 0) AS ebitda_margin, coalesce(interest_coverage, 0) AS interest_coverage,
  debt_equity_ratio AS de_ratio, {r('coalesce(revenue_cagr_3yr, 0) * 100', 4)} AS cagr_pct, coalesce(itc_gap_pct, 100) AS gst_mismatch, coalesce(concentration_pct, 0) AS concentration, coalesce(current_ratio, 0) AS current_ratio,
  {r('coalesce(profit_after_tax / nullif(revenue, 0), 0) * 100', 4)} AS pat_margin, CAST(0 AS DOUBLE) AS loi_cr, CAST(0 AS DOUBLE) AS export_growth, CAST(0 AS DOUBLE) AS expansion_irr, coalesce(partner, '') AS partner, coalesce(contingent, 0) AS litigation_cr,
  coalesce(nullif(net_worth, 0), 1) AS net_worth, coalesce(sector_headwinds, false) AS commodity_risk, false AS parent_risk FROM c_blocks"""
_SC = f"CAST(CAST({r('normalized_score', 0)} AS BIGINT) AS VARCHAR)"
_swot = {
    "strengths": [("pledge = 0", "'Zero promoter pledge - shares fully unencumbered'"), ("pledge > 0 AND pledge <= 20", f"concat('Low promoter pledge at ', {pct('pledge')})"),
                  ("rating_action = 'UPGRADED' AND rating <> ''", "concat('Credit rating upgraded to ', rating, ' - improving profile')"),
                  (f"NOT (rating_action = 'UPGRADED' AND rating <> '') AND rating IN {inlist(M.INVESTMENT_GRADES)}", "concat('Investment grade rating: ', rating)"),
                  ("ebitda_margin > 20", f"concat('Strong EBITDA margin of ', {pct('ebitda_margin')}, ' (sector benchmark ~15%)')"), ("interest_coverage > 5", f"concat('Comfortable interest coverage of ', {ratio('interest_coverage', 1)})"),
                  ("de_ratio < 0.5", f"concat('Conservative leverage at D/E ', {ratio('de_ratio')})"), ("cagr_pct > 12", f"concat('Revenue CAGR of ', {pct('cagr_pct')}, ' over 3 years')"),
                  ("gst_mismatch = 0", "'GST reconciliation clean - 0% mismatch, no circular trading'")],
    "weaknesses": [("concentration > 50", f"concat('Customer concentration risk - top 5 = ', {pct('concentration')}, ' of revenue')"), ("de_ratio > 1.5", f"concat('Elevated leverage at D/E ', {ratio('de_ratio')})"),
                   ("current_ratio > 1 AND current_ratio < 1.3", f"concat('Tight current ratio of ', {ratio('current_ratio')})"), ("pat_margin > 0 AND pat_margin < 7", f"concat('Thin PAT margin of ', {pct('pat_margin')})")],
    "opportunities": [("partner <> ''", "concat('Strategic partnership discussions with ', partner)")],
    "threats": [("litigation_cr > net_worth * 0.5", f"concat('Litigation exposure ', {crore('litigation_cr')}, ' = ', {ratio('litigation_cr / net_worth', 1)}, ' net worth')"),
                ("NOT litigation_cr > net_worth * 0.5 AND litigation_cr > 0", f"concat('Contingent liabilities of ', {crore('litigation_cr')}, ' under appeal')"), ("commodity_risk", "'Input cost volatility from commodity price movements'"),
                ("pledge > 75", f"concat('Promoter pledge ', {pct('pledge')}, ' - forced selling risk if share price falls')"), ("parent_risk", "'Parent company debt obligations may require dividend upstreaming'")],
}
CTES["c_swotpoints"] = " UNION ALL ".join(f"SELECT company_id, '{k}' AS quadrant, {i} AS ord, {text} AS point FROM c_swotin WHERE {cond}" for k, items in _swot.items() for i, (cond, text) in enumerate(items))
_fallback = {"strengths": f"concat('Score of ', {_SC}, '/100 indicates acceptable credit quality')", "weaknesses": "'No material weaknesses identified from available documents'",
             "opportunities": "'Sector growth trajectory supports future revenue expansion'", "threats": "'Standard macro and sector risks apply'"}
_swot_all = "SELECT company_id, quadrant, row_number() OVER (PARTITION BY company_id, quadrant ORDER BY ord) - 1 AS pos, point FROM c_swotpoints" + "".join(
    f" UNION ALL SELECT company_id, '{k}', 0, {v} FROM c_decisions d WHERE NOT EXISTS (SELECT 1 FROM c_swotpoints p WHERE p.company_id = d.company_id AND p.quadrant = '{k}')" for k, v in _fallback.items()
) + f" UNION ALL SELECT d.company_id, 'thesis', 0, concat(company_name, ' is rated ', risk_grade, ' with a credit score of ', {_SC}, '/100. ', CASE WHEN normalized_score >= 75 THEN 'Strong fundamentals support full approval.' ELSE 'Conditional approval recommended with covenants.' END) FROM c_decisions d JOIN c_company c ON d.company_id = c.company_id"

_clean = lambda n: f"trim({squeeze(n)}, ' -,:;.')"
VALID = lambda n: f"""(length({_clean(n)}) >= 3 AND lower({_clean(n)}) <> lower(trim(company_name)) AND NOT regexp_matches(lower({_clean(n)}), '{G.MONTH_YEAR}') AND NOT regexp_matches(lower({_clean(n)}), '{G.DAY_DATE}')
  AND NOT regexp_matches(lower({_clean(n)}), '^(rs |rs\\.|₹)') AND NOT regexp_matches(lower({_clean(n)}), '{G.UNIT_WORDS}') AND NOT {any_of(f'lower({_clean(n)})', G.BAD_WORDS)} AND regexp_matches({_clean(n)}, '[a-zA-Z]'))"""
CTES["c_sentences"] = "SELECT d.company_id, s.doc_id, s.pos, s.sentence FROM c_related s JOIN c_doc_text d ON s.doc_id = d.doc_id"
CTES["c_colimits"] = "SELECT d.company_id, l.doc_id, l.pos, l.lender, l.limit_amount FROM c_limits l JOIN c_doc_text d ON l.doc_id = d.doc_id"


def orgs(pattern: str, words, label: str) -> str:
    return f"""SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY doc_id, pos, hit) AS rank_no, name, relationship FROM (
SELECT *, {squeeze('raw')} AS name, {label} AS relationship FROM (SELECT s.company_id, company_name, doc_id, pos, lower(sentence) AS low, unnest(regexp_extract_all(sentence, '{pattern}', 1)) AS raw, generate_subscripts(regexp_extract_all(sentence, '{pattern}', 1), 1) AS hit
  FROM c_sentences s JOIN c_company c ON s.company_id = c.company_id WHERE {any_of('lower(sentence)', words)}) x WHERE {VALID('raw')}
QUALIFY row_number() OVER (PARTITION BY company_id, lower(name) ORDER BY doc_id, pos, hit) = 1) y"""


CTES["c_subs"] = orgs(G.ORGANISATION, G.RELATION_WORDS + G.ENTITY_HINTS, "CASE WHEN contains(low, 'associate') THEN 'Associate' WHEN contains(low, 'joint venture') THEN 'Joint Venture' ELSE 'Subsidiary' END")
CTES["c_partners"] = orgs(G.PARTNER_ORGANISATION, G.PARTNER_WORDS, "'Strategic Partner'")
CTES["c_agencies"] = "SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY doc_id, pos, hit) AS rank_no, name, 'Rating Agency' AS relationship FROM (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT company_id, doc_id, pos, {i} AS hit, '{q(label)}' AS name FROM c_sentences WHERE contains(lower(sentence), '{q(w)}')" for i, (w, label) in enumerate(G.AGENCIES)) + """) x
JOIN (SELECT company_id AS cid FROM c_company) c ON x.company_id = c.cid QUALIFY row_number() OVER (PARTITION BY company_id, lower(name) ORDER BY doc_id, pos, hit) = 1) y"""
CTES["c_lenders"] = f"""SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY doc_id, pos) AS rank_no, name, amount_cr FROM (SELECT l.company_id, doc_id, pos, trim(lender) AS name, CASE WHEN limit_amount > 100000 THEN {r('limit_amount / 10000000', 2)} ELSE {r('limit_amount', 2)} END AS amount_cr
FROM c_colimits l JOIN c_company c ON l.company_id = c.company_id WHERE {VALID('lender')} QUALIFY row_number() OVER (PARTITION BY l.company_id, lower(trim(lender)) ORDER BY doc_id, pos) = 1) x"""
CTES["c_promoters"] = f"""
WITH listed AS (SELECT h.company_id, arg_max(name, pct * 1000000000 - doc_id - pos / 100000) AS name, max(pct) AS holding_pct FROM c_holders h JOIN c_company c ON h.company_id = c.company_id WHERE {VALID('name')} GROUP BY h.company_id, lower(name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY holding_pct DESC, name) AS rank_no FROM listed)
SELECT l.company_id, rank_no, name, holding_pct, coalesce(promoter_pledge_pct, 0) AS pledge_pct FROM ranked l LEFT JOIN c_holding h ON l.company_id = h.company_id
UNION ALL SELECT c.company_id, 1, 'Promoter Group', promoter_holding_pct, promoter_pledge_pct FROM c_company c JOIN c_holding h ON c.company_id = h.company_id WHERE c.company_id NOT IN (SELECT company_id FROM listed)
UNION ALL SELECT company_id, no, name, 0, 0 FROM (SELECT company_id, 1 AS no, promoter_a AS name FROM c_company UNION ALL SELECT company_id, 2, promoter_b FROM c_company WHERE promoter_b IS NOT NULL) m
  WHERE company_id NOT IN (SELECT company_id FROM listed) AND company_id NOT IN (SELECT company_id FROM c_holding)"""
one = lambda e, n: f"format('{{:.{n}f}}', {r(e, n)})"
CTES["c_members"] = f"""
SELECT company_id, concat('promoter_', rank_no - 1) AS node_id, name, CASE WHEN pledge_pct > 75 THEN 'HIGH' WHEN pledge_pct > 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk, 20 AS weight, concat({one('holding_pct', 1)}, '% holding') AS label FROM c_promoters
UNION ALL SELECT company_id, concat('sub_', rank_no - 1), name, 'LOW', 18, relationship FROM c_subs UNION ALL SELECT company_id, concat('lender_', rank_no - 1), name, 'LOW', 16, concat('₹', {one('amount_cr', 2)}, ' Cr charge') FROM c_lenders
UNION ALL SELECT company_id, concat('partner_', rank_no - 1), name, 'LOW', 14, relationship FROM c_partners UNION ALL SELECT company_id, concat('rating_', rank_no - 1), name, 'LOW', 12, relationship FROM c_agencies"""
_items = " UNION ALL ".join([
    "SELECT doc_id, 'related_parties' AS list_name, sentence AS item, pos FROM c_related", "SELECT doc_id, 'disputes', title, pos FROM c_disputes", "SELECT doc_id, 'auditor_notes', sentence, pos FROM c_auditor",
    "SELECT * FROM (" + text_sql.SQL["txt_12_collateral"].replace("SELECT * FROM (SELECT doc_id, unnest", "SELECT doc_id, 'collateral', line, pos FROM (SELECT doc_id, unnest", 1) + ") z"])
_num = lambda t: f"CAST({t} AS DOUBLE)"
SQL.update({
    "join_4_feature_blocks": "SELECT company_id, sector, dscr, reconciled_dscr, banking_to_gst_ratio, itc_gap_pct, circular_signals, filing_consistency_pct, r0, r1, r2, auditor_opinion, fraud_hits, litigation_count, has_nclt, struck_off, management_integrity_score, promoter_pledge_pct, existing_debt_cr, gnpa_pct FROM c_blocks",
    "join_5_tax_block": "SELECT * FROM c_taxblock",
    "join_9_sector_factors": f"SELECT company_id, sector, {MULT} AS risk_multiplier, CAST({case_map('sector', E.SECTOR_RISK_INDEX, 5)} AS BIGINT) AS risk_index FROM c_company",
    "win_9_growth": "SELECT * FROM c_growth",
    "fea_1_credit_vector": "SELECT * FROM c_vector",
    "fea_2_calibrator_vector": "SELECT * FROM c_calibrator",
    "agg_11_completeness": "SELECT * FROM c_complete",
    "agg_12_label_summary": f"SELECT stress_label, count(*) AS n, min(target_score) AS min_score, max(target_score) AS max_score, {r('avg(target_score)', 4)} AS mean_score FROM c_labels GROUP BY 1",
    "set_6_aligned_frame": "SELECT company_id, coalesce(dscr, 0) AS dscr, CAST(0 AS DOUBLE) AS ebitda_margin_pct, coalesce(current_ratio, 0) AS current_ratio, CAST(0 AS DOUBLE) AS debt_to_equity, coalesce(revenue_growth_yoy, 0) AS revenue_growth_yoy, CAST(0 AS DOUBLE) AS gst_bank_mismatch_pct, CAST(0 AS DOUBLE) AS active_litigation_count, CAST(0 AS DOUBLE) AS promoter_red_flag, CAST(0 AS DOUBLE) AS factory_capacity_pct, CAST(coalesce(CAST(auditor_qualified AS INT), 0) AS DOUBLE) AS auditor_qualified, CAST(coalesce(charge_count, 0) AS DOUBLE) AS charge_count, CAST(0 AS DOUBLE) AS bounced_cheques_12m, CAST(0 AS DOUBLE) AS sector_risk_index FROM c_blocks",
    "prj_14_hard_rules": "SELECT company_id, concat_ws(',', CASE WHEN has_going_concern_doubt >= 1 THEN 'going_concern_doubt' END, CASE WHEN gstr3b_vs_2a_itc_gap > 25 THEN 'severe_gst_mismatch' END) AS rule_hits FROM c_vector",
    "prj_15_without_news": "SELECT company_id, " + ", ".join(f"CAST(0 AS DOUBLE) AS {f}" if f in E.NEWS_FLAGS else f for f in _all) + " FROM c_vector",
    "rul_1_policy_rules": "SELECT * FROM c_violations",
    "rul_2_rule_scores": "SELECT * FROM c_rulescore",
    "scr_1_blended_score": "SELECT company_id, rule_score, stress_probability, final_score, risk_category FROM c_blended",
    "scr_2_decision": "SELECT company_id, critical_hit, risk_category, decision, premium_bps FROM c_blended",
    "scr_3_working_capital_limit": f"SELECT b.company_id, CASE WHEN final_score < 35 THEN 0 ELSE {r('0.75 * greatest(coalesce(current_assets, 0) - coalesce(current_liabilities, 0), 0) * (final_score / 100)', 1)} END AS limit_cr FROM c_blended b LEFT JOIN c_wb_facts w ON b.company_id = w.company_id",
    "scr_4_grades": f"SELECT company_id, normalized_score, {_grade('normalized_score')} AS grade FROM c_decisions",
    "scr_5_prices": f"SELECT company_id, grade, {PREM('grade')} AS premium_bps, {r('8.5 + ' + PREM('grade') + ' / 100', 2)} AS interest_rate FROM (SELECT company_id, {_grade('normalized_score')} AS grade FROM c_decisions) x",
    "scr_6_approved_limits": f"SELECT g.company_id, {_limit('grade')} AS approved_cr FROM (SELECT company_id, {_grade('normalized_score')} AS grade FROM c_decisions) g JOIN c_company c ON g.company_id = c.company_id JOIN c_limitrev l ON g.company_id = l.company_id",
    "scr_7_decision_rows": "SELECT * FROM c_decisions",
    "scr_8_derived_scores": f"SELECT company_id, {r('greatest(0, least(1, (900 - credit_score) / 600))', 6)} AS stress_share, {r('greatest(0, least(100, (credit_score - 300) / 6))', 6)} AS swot_score FROM c_decisions",
    "scr_9_five_cs": "SELECT company_id, axis, score, CASE WHEN score >= 7.5 THEN 'LOW' WHEN score >= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM c_fivelong",
    "scr_10_five_c_benchmark": f"SELECT company_id, axis, score, benchmark, {r('score - benchmark', 2)} AS difference FROM (SELECT *, {dbl(case_map('axis', S.BENCHMARK, 0))} AS benchmark FROM c_fivelong) x",
    "scr_11_stress_grid": f"""SELECT company_id, d AS drop_pct, {r('s', 0)} AS stressed_score, CASE WHEN s >= 75 THEN 'APPROVE' WHEN s >= 50 THEN 'CONDITIONAL APPROVE' ELSE 'REJECT' END AS stressed_decision, CAST(d / 10 * 8 AS DOUBLE) AS score_reduction, {r('d * 0.8', 4)} AS ebitda_impact_pct, {r('d * 0.6', 4)} AS dscr_impact_pct
FROM (SELECT company_id, d, greatest(0, least(100, final_score - d / 10 * 8)) AS s FROM c_blended CROSS JOIN (SELECT unnest([0, 10, 20, 30, 40])::BIGINT AS d) g) x""",
    "scr_12_five_cs_short": f"""SELECT company_id, {r(f"greatest(1, least(10, 10 - has_promoter_fraud_news * 4 - has_mca_struck_off_associates * 3 - CASE WHEN {z('management_integrity_score', 6)} < 5 THEN 2 ELSE 0 END))", 4)} AS character,
  {r(f"greatest(1, least(10, {z('dscr', 1.2)} * 3 + {z('interest_coverage_ratio', 2)} + {z('factory_capacity_utilization', 60)} / 20))", 4)} AS capacity, {r(f"greatest(1, least(10, 9 - {z('debt_equity_ratio', 1.5)} + {z('current_ratio', 1.3)}))", 4)} AS capital,
  {r(f"greatest(1, least(10, {z('collateral_coverage_ratio', 1.1)} * 4 + {z('collateral_type_score', 5)} / 2))", 4)} AS collateral, {r("greatest(1, least(10, 8 - has_sector_headwinds * 2.5 - has_revenue_inflation_signals * 2))", 4)} AS conditions FROM c_vector""",
    "exp_1_approximations": "SELECT * FROM c_approx",
    "exp_2_contributions": "SELECT * FROM c_contrib",
    "exp_3_narratives": f"""SELECT v.company_id, concat('Decision rationale is based on document-derived repayment capacity and balance-sheet resilience. Debt service coverage is ', {ratio('dscr')}, ' (', CASE WHEN dscr >= 1.3 THEN 'comfortable' WHEN dscr >= 1.1 THEN 'watchlist' ELSE 'stressed' END, '), interest coverage is ', {ratio('interest_coverage_ratio')},
  ', leverage is ', {ratio('debt_equity_ratio')}, ' (', CASE WHEN debt_equity_ratio <= 1 THEN 'conservative' WHEN debt_equity_ratio <= 2 THEN 'moderate' ELSE 'elevated' END, '), GST ITC gap is ', {pct('gstr3b_vs_2a_itc_gap')}, ' (', CASE WHEN gstr3b_vs_2a_itc_gap <= 5 THEN 'clean' WHEN gstr3b_vs_2a_itc_gap <= 20 THEN 'moderate mismatch' ELSE 'severe mismatch' END,
  '), and capacity utilization is ', {pct('factory_capacity_utilization')}, '. Primary strengths considered: ', coalesce(a.t, 'none materially above threshold.'), ' Primary constraints considered: ', coalesce(b.t, 'no material adverse trigger.'), ' Recommendation and pricing are therefore calibrated to these quantified signals.') AS narrative,
  {r('greatest(0.5, least(0.95, completeness))', 2)} AS confidence FROM c_vector v JOIN c_complete k ON v.company_id = k.company_id LEFT JOIN {_side('positive')} a ON v.company_id = a.company_id LEFT JOIN {_side('negative')} b ON v.company_id = b.company_id""",
    "top_5_factors": "SELECT * FROM c_factors WHERE rank_no <= 3",
    "top_6_drivers": "SELECT company_id, rank_no, feature, contribution, CASE WHEN contribution > 0 THEN '▲ RISK' ELSE '▼ RISK' END AS direction FROM c_approx WHERE rank_no <= 8",
    "ml_5_labels": "SELECT l.company_id, stress_signal, stress_label, target_score, CAST(k.dscr < 1.2 OR coalesce(recovery_suit, false) OR gst_bank_mismatch_pct > 30 OR promoter_red_flag = 1 AS INT)::DOUBLE AS calibrator_label FROM c_labels l JOIN c_calibrator k ON l.company_id = k.company_id JOIN c_blocks b ON l.company_id = b.company_id",
    "wb_9_merged_facts": "SELECT * FROM c_merged",
    "set_4_merged_lists": f"""SELECT company_id, list_name, item, arg_min(doc_id, o) AS first_doc_id, arg_min(pos, o) AS first_pos FROM (SELECT f.company_id, list_name, item, i.doc_id, pos,
  row_number() OVER (ORDER BY CASE content_type WHEN 'ANNUAL_REPORT' THEN 0 WHEN 'FINANCIAL_STATEMENT' THEN 1 ELSE 2 END, coalesce(revenue_cr, 0) DESC, i.doc_id, pos) AS o FROM ({_items}) i JOIN c_docfacts f ON i.doc_id = f.doc_id) x GROUP BY 1, 2, 3""",
    "wb_10_limit_revenue": "SELECT * FROM c_limitrev",
    "prj_13_valid_entities": f"SELECT n.company_id, name, {VALID('name')} AS is_valid FROM (SELECT company_id, name FROM c_holders UNION SELECT company_id, lender FROM c_colimits) n JOIN c_company c ON n.company_id = c.company_id",
    "gra_1_promoters": "SELECT * FROM c_promoters",
    "gra_2_subsidiaries": "SELECT * FROM c_subs",
    "gra_3_partners": "SELECT * FROM c_partners",
    "gra_4_agencies": "SELECT * FROM c_agencies",
    "gra_5_lenders": "SELECT * FROM c_lenders",
    "gra_6_nodes": "SELECT company_id, 'main' AS node_id, company_name AS label, 'company' AS node_type, 'LOW' AS risk FROM c_company UNION ALL SELECT company_id, node_id, name, 'counterparty', risk FROM c_members",
    "gra_6_links": "SELECT company_id, 'main' AS source, node_id AS target, CAST(weight AS BIGINT) AS weight, risk AS confidence, label FROM c_members",
    "gra_7_managers": "SELECT company_id, CAST(1 AS BIGINT) AS seq, promoter_a AS name FROM c_company UNION ALL SELECT company_id, 2, promoter_b FROM c_company WHERE promoter_b IS NOT NULL",
    "agg_14_graph_counts": "SELECT c.company_id, count(node_id) + 1 AS entity_count, count(node_id) AS connection_count FROM c_company c LEFT JOIN c_members m ON c.company_id = m.company_id GROUP BY 1",
    "swo_1_swot_input": "SELECT * FROM c_swotin",
    "swo_2_swot_points": _swot_all,
    "mem_1_risk_matrix": """SELECT company_id, 'factor' AS section, rank_no, sentence AS risk, 'Medium/High' AS impact, 'Quarterly covenant tracking and early warning triggers.' AS mitigation FROM c_factors WHERE side = 'negative'
UNION ALL SELECT company_id, 'anomaly', seq, concat(title, ': ', details), severity, 'Targeted forensic validation and covenant tightening.' FROM c_anomalies
UNION ALL SELECT company_id, 'indicator', seq, concat(indicator, ' (source: ', source, ')'), severity, 'Escalate to enhanced monitoring and transaction-level verification.' FROM c_indicators""",
    "mem_2_covenants": """SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY k) AS seq, covenant FROM (
SELECT company_id, k, covenant FROM c_vector CROSS JOIN (VALUES (1, 'Monthly stock and receivable statements to lender.'), (2, 'Quarterly GST vs banking reconciliation with management certification.'), (3, 'DSCR floor covenant at 1.20x; breach to trigger corrective action plan.')) g(k, covenant)
UNION ALL SELECT company_id, 4, 'Monthly GST ITC reconciliation submission until mismatch normalizes below 5%.' FROM c_vector WHERE gstr3b_vs_2a_itc_gap > 5 UNION ALL SELECT company_id, 5, 'No incremental unsecured debt without lender approval.' FROM c_vector WHERE debt_equity_ratio > 1.5
UNION ALL SELECT DISTINCT company_id, 6, 'Enhanced transaction monitoring on related-party and round-amount transfers.' FROM c_indicators) x""",
    "mem_5_profile_rows": f"""SELECT c.company_id, company_name, cin, sector, {crore('requested_cr')} AS requested, version_id AS loan_id, status AS loan_status, amount AS loan_amount, credit_score, normalized_score, risk_grade, recommendation, DATE '2025-01-31' AS valid_till
FROM c_company c LEFT JOIN (SELECT * FROM c_versions QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, version_id DESC) = 1) v ON c.company_id = v.company_id LEFT JOIN c_decisions d ON c.company_id = d.company_id""",
    "mem_6_metric_rows": " UNION ALL ".join(f"SELECT v.company_id, '{n}' AS metric, {e} AS value FROM c_vector v LEFT JOIN c_report p ON v.company_id = p.company_id" for n, e in {
        "DSCR": ratio("v.dscr"), "Debt/Equity": ratio("debt_equity_ratio"), "Current Ratio": ratio("current_ratio"), "GST-Banking Ratio": ratio("gst_banking_ratio"), "Consistency Score": pct("consistency_score")}.items()),
    "mem_6_executive_lines": f"""SELECT company_id, CASE WHEN recommendation = 'REJECT' THEN concat('Recommendation: REJECT | Limit: Not Sanctioned (Requested: ', {crore('recommended_limit_cr')}, ') | Rate: N/A')
  ELSE concat('Recommendation: ', recommendation, ' | Amount: ', {crore('recommended_limit_cr')}, ' | Rate: ', format('{{:.2f}}', interest_rate), '% p.a.') END AS line, CASE WHEN recommendation = 'REJECT' AND rule_hits <> '' THEN concat('Rejection reasons: ', replace(rule_hits, ',', ', ')) END AS reasons FROM c_decisions""",
})
