from oracle import ledger_sql, workbook_sql  # noqa: F401
from oracle.kit import CTES, SQL, r


def mismatch(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, {r('infl * 100', 2)} AS itc_inflation_pct, inflated AS revenue_inflation_flag, infl > 0.05 AND inflated AS suspected_circular,
  CASE WHEN infl >= 0.15 THEN 'CRITICAL' WHEN infl >= 0.05 OR inflated THEN 'HIGH' WHEN infl >= 0.02 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  concat('ITC claimed ₹', format('{{:,.2f}}', {r('itc_claimed', 2)}), ' vs available ₹', format('{{:,.2f}}', {r('available_itc', 2)}), '.',
    CASE WHEN inflated THEN ' GSTR-1 outward supplies appear materially higher than observed banking credits.' ELSE '' END,
    CASE WHEN infl > 0.05 AND inflated THEN ' Pattern suggests possible fake invoicing / circular trading chain.' ELSE '' END) AS explanation
FROM (SELECT *, greatest(0, (itc_claimed - greatest(available_itc, 1)) / greatest(available_itc, 1)) AS infl,
  coalesce(bank_credits > 0 AND invoice_sales_total / bank_credits > 1.3, false) AS inflated FROM {source}) x"""


def total(table: str, col: str) -> str:
    return f"SELECT company_id, CAST(sum(CAST({col} AS DECIMAL(24,4))) AS DOUBLE) AS {col} FROM {table} GROUP BY 1"


CTES["c_sides"] = """
SELECT b.company_id, b.period, itc_claimed, available_itc, invoice_sales_total, bank_credits FROM c_gstr3b b JOIN c_gstr2a a ON b.company_id = a.company_id AND b.period = a.period
LEFT JOIN c_gstr1 s ON b.company_id = s.company_id AND b.period = s.period LEFT JOIN c_credits k ON b.company_id = k.company_id AND b.period = k.period"""
CTES["c_sides_all"] = f"""
SELECT b.company_id, itc_claimed, available_itc, invoice_sales_total, bank_credits FROM ({total('c_gstr3b', 'itc_claimed')}) b JOIN ({total('c_gstr2a', 'available_itc')}) a ON b.company_id = a.company_id
LEFT JOIN ({total('c_gstr1', 'invoice_sales_total')}) s ON b.company_id = s.company_id LEFT JOIN ({total('c_credits', 'bank_credits')}) k ON b.company_id = k.company_id"""
CTES["c_mismatch"] = mismatch("c_sides", "company_id, period")
CTES["c_mismatch_all"] = mismatch("c_sides_all", "company_id")
CTES["c_itr_total"] = total("c_itr", "gross_revenue").replace("AS gross_revenue", "AS itr_revenue")
CTES["c_assembled"] = """
SELECT c.company_id, coalesce(has_ledger, false) AS has_bank, coalesce(tax_turnover, 0) AS tax_turnover,
  CASE WHEN has_ledger THEN banking_turnover ELSE coalesce(tax_turnover, 0) END AS bank_turnover, coalesce(itr_revenue, 0) AS itr_revenue,
  coalesce(has_ledger AND year_end_window_dressing, false) AS window_dressing, CASE WHEN has_ledger THEN pair_count ELSE 0 END AS pair_count,
  CASE WHEN has_ledger THEN pair_value ELSE 0 END AS pair_value, risk_level AS tax_risk, coalesce(suspected_circular, false) AS tax_circular,
  coalesce(itc_mismatch_pct, 0) AS itc_mismatch_pct, coalesce(itc_excess, 0) AS itc_excess, coalesce(itc_available, 0) AS itc_available,
  coalesce(promoter_pledge_pct, 0) AS pledge_pct, coalesce(contingent, 0) AS contingent, coalesce(net_worth, 0) AS net_worth,
  CASE WHEN has_ledger THEN greatest(6, banking_turnover * 0.08) ELSE 8 END AS obligation
FROM c_company c LEFT JOIN c_bank b ON c.company_id = b.company_id LEFT JOIN c_turnover t ON c.company_id = t.company_id LEFT JOIN c_itr_total i ON c.company_id = i.company_id
LEFT JOIN c_mismatch_all m ON c.company_id = m.company_id LEFT JOIN c_recon x ON c.company_id = x.company_id LEFT JOIN c_holding h ON c.company_id = h.company_id
LEFT JOIN c_wb_facts f ON c.company_id = f.company_id"""


def gap(a: str, b: str) -> str:
    return f"(CASE WHEN {a} <= 0 AND {b} <= 0 THEN 0 ELSE abs({a} - {b}) / greatest(abs({a}), abs({b}), 1) * 100 END)"


CTES["c_gapped"] = f"""SELECT *, {gap('tax_turnover', 'bank_turnover')} AS bank_gap, {gap('itr_revenue', 'tax_turnover')} AS itr_gap,
  CASE WHEN net_worth > 0 AND contingent > 0 THEN contingent / net_worth END AS weight FROM c_assembled"""
f2 = lambda e, n: f"format('{{:.{n}f}}', {r(e, n)})"
w0 = lambda e: f"format('{{:,.0f}}', {r(e, 0)})"
CTES["c_anomalies"] = f"""
SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY k) AS seq, title, details, severity FROM (
SELECT company_id, 1 AS k, 'Bank statement unavailable' AS title, 'Bank statement metrics missing; GST vs banking reconciliation used fallback estimates.' AS details, 'MEDIUM' AS severity FROM c_gapped WHERE NOT has_bank
UNION ALL SELECT company_id, 2, 'GST vs Banking mismatch', concat('Gap is ', {f2('bank_gap', 2)}, '% between reported GST turnover and bank credits.'), 'HIGH' FROM c_gapped WHERE has_bank AND bank_gap > 15
UNION ALL SELECT company_id, 3, 'ITR vs GST mismatch', concat('Tax filing turnover differs by ', {f2('itr_gap', 2)}, '%.'), 'MEDIUM' FROM c_gapped WHERE itr_gap > 10
UNION ALL SELECT company_id, 4, 'GST ITC Mismatch', concat('ITC claimed exceeds available by ', {f2('itc_mismatch_pct', 1)}, '%. Excess: ₹', {f2('itc_excess', 0)}, ' Cr over ₹', {f2('itc_available', 0)}, ' Cr available in GSTR-2A.'), CASE WHEN itc_mismatch_pct > 20 THEN 'CRITICAL' ELSE 'HIGH' END FROM c_gapped WHERE itc_mismatch_pct > 5
UNION ALL SELECT company_id, 5, 'Round-trip Bank Transfers Detected', concat(pair_count, ' circular credit-debit pair(s) found. Total amount: ₹', {w0('pair_value')}, ' Cr. Same counterparty, matching amounts within 2%, within 3 calendar days.'), 'HIGH' FROM c_gapped WHERE pair_count > 0
UNION ALL SELECT company_id, 6, 'Promoter Pledge Critical', concat('Promoter has pledged ', {f2('pledge_pct', 1)}, '% of holdings. ', CASE WHEN pledge_pct > 90 THEN 'CRITICAL: >90% pledge indicates extreme financial stress.' ELSE 'HIGH: >75% pledge indicates significant stress.' END), CASE WHEN pledge_pct > 90 THEN 'CRITICAL' ELSE 'HIGH' END FROM c_gapped WHERE pledge_pct > 75
UNION ALL SELECT company_id, 7, 'Contingent Liability Concentration', concat('Contingent liabilities (₹', {w0('contingent')}, ' Cr) are ', {f2('weight', 1)}, 'x net worth (₹', {w0('net_worth')}, ' Cr). ', CASE WHEN weight > 10 THEN 'CRITICAL risk of capital erosion.' ELSE 'HIGH concentration risk.' END), CASE WHEN weight > 10 THEN 'CRITICAL' ELSE 'HIGH' END FROM c_gapped WHERE weight > 5) u"""
CTES["c_indicators"] = """
SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY k) AS seq, indicator, source, severity, confidence FROM (
SELECT company_id, 1 AS k, 'Year-end window dressing detected' AS indicator, 'bank_statement' AS source, 'HIGH' AS severity, CAST(0.82 AS DOUBLE) AS confidence FROM c_assembled WHERE window_dressing
UNION ALL SELECT company_id, 2, 'Circular credit-debit transaction pattern', 'bank_statement', 'CRITICAL', 0.86 FROM c_assembled WHERE pair_count > 0
UNION ALL SELECT company_id, 3, 'GST ITC anomaly indicates potential circular trading', 'gst_mismatch', 'CRITICAL', 0.88 FROM c_assembled WHERE tax_circular) u"""
CTES["c_report"] = f"""
SELECT company_id, {r('bank_gap', 2)} AS gst_vs_bank_gap, {r('itr_gap', 2)} AS itr_vs_gst_gap,
  {r('CASE WHEN bank_turnover > 0 THEN bank_turnover * 0.1 ELSE greatest(tax_turnover, 0) * 0.08 END / greatest(obligation, 1)', 3)} AS dscr, CAST(50 AS BIGINT) AS cycle_days,
  greatest(0, {r("100 - (CASE WHEN has_bank THEN least(35, bank_gap * 0.8) ELSE 8 END) - least(25, itr_gap * 0.7) - (CASE WHEN window_dressing THEN 20 ELSE 0 END) - least(20, pair_count * 2) - (CASE WHEN tax_risk IN ('HIGH', 'CRITICAL') THEN 15 ELSE 0 END)", 2)}) AS consistency_score
FROM c_gapped"""
CTES["c_advice"] = """
SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY k) AS seq, item FROM (
SELECT company_id, 1 AS k, 'Collect at least 6-12 months of bank statements for stronger cross-validation.' AS item FROM c_gapped WHERE NOT has_bank
UNION ALL SELECT company_id, 2, 'Investigate revenue recognition and cash realization.' FROM c_gapped WHERE has_bank AND bank_gap > 15
UNION ALL SELECT company_id, 3, 'Impose monthly stock and debtor statement covenant.' FROM c_gapped WHERE window_dressing
UNION ALL SELECT company_id, 4, 'Investigate circular trading and fake invoicing risk.' FROM c_gapped WHERE itc_mismatch_pct > 20
UNION ALL SELECT company_id, 5, 'Obtain pledge reduction plan from promoter before sanction.' FROM c_gapped WHERE pledge_pct > 75
UNION ALL SELECT company_id, 6, CASE WHEN consistency_score < 55 THEN 'Enhanced forensic review before sanction.' ELSE 'Conditional approval with tighter monitoring.' END FROM c_report WHERE consistency_score < 75) u"""
P = "CASE WHEN month(period) = 12 THEN 'unknown' ELSE CAST(period AS VARCHAR) END AS period"

SQL.update({
    "src_1_ledger_csv": "SELECT company_id, CAST(txn_date AS VARCHAR) AS date, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit, CAST(NULL AS VARCHAR) AS balance, narration, party FROM c_ledger",
    "src_2_return_kinds": """SELECT company_id, kind, count(*) AS n_returns FROM (SELECT company_id, '3B' AS kind FROM c_gstr3b UNION ALL SELECT company_id, '2A' FROM c_gstr2a UNION ALL SELECT company_id, '1' FROM c_gstr1 WHERE month(period) <> 99
UNION ALL SELECT company_id, 'REJECT' FROM c_itr) x GROUP BY 1, 2""",
    "src_3_returns_xml": "SELECT company_id, CAST(period AS VARCHAR) AS period, outward_supplies, itc_claimed FROM c_gstr3b",
    "src_3_xml_leaves": """SELECT company_id, CAST(period AS VARCHAR) AS filed, tag, value, CAST(position AS BIGINT) AS position FROM (
  SELECT company_id, period, 'company_id' AS tag, CAST(company_id AS VARCHAR) AS value, 0 AS position FROM c_gstr3b UNION ALL SELECT company_id, period, 'return_type', 'GSTR3B', 1 FROM c_gstr3b
  UNION ALL SELECT company_id, period, 'period', 'draft', 2 FROM c_gstr3b UNION ALL SELECT company_id, period, 'period', CAST(period AS VARCHAR), 5 FROM c_gstr3b
  UNION ALL SELECT company_id, period, 'filing_note', concat('late & <unsigned> ', company_id), 6 FROM c_gstr3b WHERE month(period) > 6) x""",
    "src_3_xml_vendors": "SELECT company_id, CAST(period AS VARCHAR) AS period, CASE WHEN month(period) > 6 THEN available_itc ELSE vendor_a + vendor_n + vendor_r END AS available_itc, vendor_a, vendor_n, vendor_r FROM c_gstr2a",
    "src_4_summary_return": f"SELECT company_id, {P}, outward_supplies, itc_claimed, tax_paid FROM c_gstr3b",
    "src_5_sales_return": f"SELECT company_id, {P}, invoice_sales_total, '7208' AS hsn_summary FROM c_gstr1",
    "src_6_purchase_register": f"SELECT company_id, {P}, CASE WHEN month(period) > 6 OR month(period) = 1 THEN available_itc ELSE vendor_a + vendor_n + vendor_r END AS available_itc, vendor_a, vendor_n, vendor_r FROM c_gstr2a",
    "src_7_itr_json": "SELECT company_id, CAST(assessment_year AS VARCHAR) AS assessment_year, CASE WHEN assessment_year % 2 = 0 THEN 'ABCDE1234F' END AS pan, gross_revenue, CAST(0 AS DOUBLE) AS taxable_income, tax_paid, CAST(0 AS DOUBLE) AS depreciation FROM c_itr",
    "src_8_cells": "SELECT company_id, file_name, sheet, CAST(row_idx AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, cell_text FROM c_cells",
    "src_9_text_rows": "SELECT 'document' AS kind, doc_id AS source_id, length(text) AS n_chars, md5(text) AS digest FROM documents UNION ALL SELECT 'page', page_id, length(html), md5(html) FROM pages",
    "src_10_predicate_read": "SELECT company_id, assessment_year, gross_revenue FROM c_itr WHERE assessment_year >= 1998 AND gross_revenue > 1000000",
    "src_11_append_overwrite": """SELECT company_id, count(*) AS n_rows, CAST(sum(CAST(v AS DECIMAL(24,4))) AS DOUBLE) AS total FROM (SELECT company_id, invoice_sales_total AS v FROM c_gstr1 UNION ALL SELECT company_id, outward_supplies FROM c_gstr3b) x GROUP BY 1""",
    "src_11_named_table": """SELECT company_id, count(*) AS n_rows, CAST(sum(CAST(v AS DECIMAL(24,4))) AS DOUBLE) AS total FROM (SELECT company_id, invoice_sales_total AS v FROM c_gstr1 UNION ALL SELECT company_id, outward_supplies FROM c_gstr3b) x GROUP BY 1""",
    "src_12_one_key": "SELECT status, count(*) AS n_rows, CAST(sum(CAST(CASE WHEN version_id = (SELECT max(version_id) FROM c_versions) THEN 0 ELSE amount END AS DECIMAL(24,4))) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS buckets_written FROM c_versions GROUP BY 1",
    "src_12_upsert": "SELECT version_id, company_id, status, CASE WHEN status = 'F' THEN amount ELSE amount * 2 END AS amount FROM c_versions",
    "src_13_annual_tax_table": f"""SELECT CAST(company_id AS VARCHAR) AS company_id, 'FY' || CAST(y AS VARCHAR) AS financial_year, turnover AS gst_annual_turnover, claimed AS total_itc_claimed, available AS total_itc_available_2a,
  greatest(0, claimed - available) AS itc_overclaim_amount, {r('greatest(0, (claimed - greatest(available, 1)) / greatest(available, 1)) * 100', 2)} AS overall_itc_gap_pct, {r('filed / 12 * 100', 2)} AS filing_compliance_pct,
  coalesce(months, '') AS critical_flag_months, has_circular_trading
FROM (SELECT b.company_id, year(b.period) AS y, CAST(sum(CAST(outward_supplies AS DECIMAL(24,4))) AS DOUBLE) AS turnover, CAST(sum(CAST(itc_claimed AS DECIMAL(24,4))) AS DOUBLE) AS claimed,
  CAST(sum(CAST(available_itc AS DECIMAL(24,4))) AS DOUBLE) AS available, count(*) AS filed, string_agg(strftime(b.period, '%Y-%m'), ',' ORDER BY b.period) FILTER (WHERE risk_level = 'CRITICAL') AS months, bool_or(suspected_circular) AS has_circular_trading
  FROM c_gstr3b b JOIN c_gstr2a a ON b.company_id = a.company_id AND b.period = a.period JOIN c_mismatch m ON b.company_id = m.company_id AND b.period = m.period GROUP BY 1, 2) x""",
    "src_14_bank_table": """SELECT CAST(company_id AS VARCHAR) AS company_id, first_month AS period_start, CAST(last_day(last_month) AS DATE) AS period_end, banking_turnover AS banking_turnover_credits, average_monthly_balance AS avg_monthly_balance,
  pair_count AS circular_transaction_count, pair_value AS circular_transaction_value, year_end_window_dressing AS window_dressing_detected, CAST(0 AS DOUBLE) AS window_dressing_amount, emi_total AS emi_payments_annual, banking_to_gst_ratio FROM c_bank WHERE has_ledger""",
    "src_15_report_table": """SELECT CAST(p.company_id AS VARCHAR) AS company_id, gst_vs_bank_gap AS gst_vs_bank_gap_pct, itr_vs_gst_gap AS gst_vs_itr_gap_pct, CAST(0 AS DOUBLE) AS itr_vs_bank_gap_pct, dscr, consistency_score AS data_consistency_score,
  coalesce(i.s, '') AS fraud_indicators, coalesce(a.s, '[]') AS anomalies_json, CASE WHEN consistency_score < 50 THEN 'HIGH_RISK' WHEN consistency_score < 75 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS overall_verdict
FROM c_report p LEFT JOIN (SELECT company_id, string_agg(concat(indicator, ' (', severity, ')'), '; ' ORDER BY seq) AS s FROM c_indicators GROUP BY 1) i ON p.company_id = i.company_id
LEFT JOIN (SELECT company_id, concat('[', string_agg(concat('{"title":"', title, '","details":"', details, '","severity":"', severity, '"}'), ',' ORDER BY seq), ']') AS s FROM c_anomalies GROUP BY 1) a ON p.company_id = a.company_id""",
    "src_18_cell_lines": """SELECT company_id, file_name, sheet, CAST(0 AS BIGINT) AS part, concat('[', sheet, ']\n', string_agg(line, '\n' ORDER BY row_idx)) AS text
FROM (SELECT company_id, file_name, sheet, row_idx, string_agg(coalesce(cell_text, ''), '\t' ORDER BY col_idx) AS line FROM c_cells GROUP BY 1, 2, 3, 4) x GROUP BY 1, 2, 3""",
    "agg_10_vendor_total": "SELECT company_id, period, vendor_a + vendor_n + vendor_r AS vendor_total FROM c_gstr2a",
    "join_2_tax_sides": "SELECT * FROM c_sides",
    "join_3_assembled": "SELECT * FROM c_assembled",
    "join_10_turnover_by_month": f"""SELECT company_id, period, tax_turnover, bank_credits, {r(gap('tax_turnover', 'bank_credits'), 2)} AS gap_pct
FROM (SELECT coalesce(b.company_id, k.company_id) AS company_id, coalesce(b.period, k.period) AS period, coalesce(outward_supplies, 0) AS tax_turnover, coalesce(bank_credits, 0) AS bank_credits
  FROM c_gstr3b b FULL JOIN c_credits k ON b.company_id = k.company_id AND b.period = k.period) x""",
    "rec_1_gaps": "SELECT company_id, gst_vs_bank_gap, itr_vs_gst_gap FROM c_report",
    "rec_2_tax_mismatch": "SELECT * FROM c_mismatch",
    "rec_3_anomalies": "SELECT * FROM c_anomalies",
    "rec_4_indicators": "SELECT * FROM c_indicators",
    "rec_5_advice": "SELECT * FROM c_advice",
    "rec_6_service_cover": "SELECT company_id, dscr, cycle_days FROM c_report",
    "rec_7_consistency": "SELECT company_id, consistency_score FROM c_report",
})
