from oracle.kit import CTES, SQL, r

CTES["c_emi"] = f"""
SELECT company_id, txn_id, txn_date, party AS lender, {r('debit', 2)} AS amount, CAST(0.75 AS DOUBLE) AS confidence
FROM c_ledger WHERE debit > 0 AND regexp_matches(narration, '(?i)emi|ecs|nach|loan')"""
_ROUND = """
SELECT company_id, txn_id, rank_no, concat(CAST(txn_date AS VARCHAR), ': round transfer ₹', format('{:,d}', CAST(debit AS BIGINT)), ' to ', coalesce(party, 'Unknown')) AS finding
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY txn_date, txn_id) AS rank_no FROM SRC
  WHERE debit > 0 AND CAST(debit AS DOUBLE) % 100000 = 0 AND NOT regexp_matches(lower(coalesce(party, '')), 'bank|gst|salary|tax')) x"""
CTES["c_pairs"] = """
SELECT company_id, debit_txn_id, credit_txn_id, txn_date, party, CAST(amount AS DOUBLE) AS amount, narration
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY debit_date, debit_txn_id) AS k FROM (
  SELECT d.company_id, d.txn_id AS debit_txn_id, d.txn_date AS debit_date, c.txn_id AS credit_txn_id, c.txn_date, c.party, c.credit AS amount, c.narration,
    row_number() OVER (PARTITION BY d.company_id, d.txn_id ORDER BY c.txn_date, c.credit, c.txn_id) AS j
  FROM c_ledger d JOIN c_ledger c ON d.company_id = c.company_id AND lower(trim(d.party)) = lower(trim(c.party)) AND trim(d.party) <> ''
    AND c.txn_date BETWEEN d.txn_date AND d.txn_date + 3 AND c.credit >= d.debit * 0.98 AND c.credit <= d.debit * 1.02
  WHERE d.debit > 0 AND c.credit > 0) x WHERE j = 1) y"""
CTES["c_ledger_totals"] = f"""
SELECT s.company_id, {r('avg_balance', 2)} AS average_monthly_balance, banking_turnover, largest_debit, cash_debits, total_debits,
  CASE WHEN total_debits > 0 AND cash_debits / total_debits > 0.35 THEN 'ALARMING' WHEN total_debits > 0 AND cash_debits / total_debits > 0.2 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS cash_pattern,
  CASE WHEN early <= 0 THEN late > 0 ELSE late > 3 * early END AS year_end_window_dressing, first_month, last_month
FROM (SELECT company_id, CAST(sum(credit) AS DOUBLE) AS banking_turnover, CAST(max(debit) AS DOUBLE) AS largest_debit, CAST(sum(debit) AS DOUBLE) AS total_debits,
  CAST(coalesce(sum(debit) FILTER (WHERE debit > 0 AND (contains(lower(narration), 'cash') OR contains(lower(narration), 'atm'))), 0) AS DOUBLE) AS cash_debits,
  coalesce(sum(credit) FILTER (WHERE month(txn_date) = 3 AND day(txn_date) <= 15), 0) AS early,
  coalesce(sum(credit) FILTER (WHERE month(txn_date) = 3 AND day(txn_date) > 15), 0) AS late,
  CAST(date_trunc('month', min(txn_date)) AS DATE) AS first_month, CAST(date_trunc('month', max(txn_date)) AS DATE) AS last_month
  FROM c_ledger GROUP BY company_id) s
JOIN (SELECT company_id, avg(m) AS avg_balance FROM (SELECT company_id, date_trunc('month', txn_date) AS mm, CAST(sum(balance) AS DOUBLE) / count(balance) AS m
  FROM c_ledger GROUP BY 1, 2) q GROUP BY company_id) b ON s.company_id = b.company_id"""
CTES["c_revenue"] = "SELECT company_id, arg_max(gross_revenue, assessment_year) AS annual_revenue FROM c_itr GROUP BY company_id"
CTES["c_turnover"] = "SELECT company_id, CAST(sum(CAST(outward_supplies AS DECIMAL(20,2))) AS DOUBLE) AS tax_turnover FROM c_gstr3b GROUP BY company_id"
CTES["c_coverage"] = f"""
SELECT l.company_id, {r('average_monthly_balance / greatest(coalesce(annual_revenue, 0), 1)', 4)} AS abb_to_revenue,
  {r('banking_turnover / greatest(coalesce(tax_turnover, 0), 1)', 4)} AS banking_to_gst_ratio
FROM c_ledger_totals l LEFT JOIN c_revenue v ON l.company_id = v.company_id LEFT JOIN c_turnover g ON l.company_id = g.company_id"""
CTES["c_pair_totals"] = """
SELECT coalesce(p.company_id, e.company_id) AS company_id, coalesce(pair_count, 0) AS pair_count, coalesce(pair_value, 0) AS pair_value, first_pair_date, last_pair_date,
  coalesce(emi_count, 0) AS emi_count, coalesce(emi_total, 0) AS emi_total
FROM (SELECT company_id, count(*) AS pair_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS pair_value, min(txn_date) AS first_pair_date, max(txn_date) AS last_pair_date FROM c_pairs GROUP BY 1) p
FULL JOIN (SELECT company_id, count(*) AS emi_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS emi_total FROM c_emi GROUP BY 1) e ON p.company_id = e.company_id"""
CTES["c_shell"] = _ROUND.replace("SRC", "c_ledger")
CTES["c_bank"] = """
SELECT c.company_id, total_debits IS NOT NULL AS has_ledger, coalesce(average_monthly_balance, 0) AS average_monthly_balance, coalesce(banking_turnover, 0) AS banking_turnover,
  coalesce(largest_debit, 0) AS largest_debit, coalesce(pair_value, 0) AS pair_value, coalesce(emi_total, 0) AS emi_total, coalesce(abb_to_revenue, 0) AS abb_to_revenue,
  coalesce(banking_to_gst_ratio, 0) AS banking_to_gst_ratio, coalesce(pair_count, 0) AS pair_count, coalesce(emi_count, 0) AS emi_count, coalesce(shell_count, 0) AS shell_count,
  coalesce(cash_pattern, 'NORMAL') AS cash_pattern, coalesce(year_end_window_dressing, false) AS year_end_window_dressing, first_month, last_month
FROM c_company c LEFT JOIN c_ledger_totals l ON c.company_id = l.company_id LEFT JOIN c_pair_totals p ON c.company_id = p.company_id
LEFT JOIN (SELECT company_id, count(*) AS shell_count FROM c_shell GROUP BY 1) s ON c.company_id = s.company_id LEFT JOIN c_coverage v ON c.company_id = v.company_id"""

SQL.update({
    "prj_1_clean_ledger": """SELECT company_id, txn_id, txn_date, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit, CAST(balance AS DOUBLE) AS balance, narration, party
FROM c_ledger WHERE NOT coalesce(narration = 'CASH WITHDRAWAL ATM' AND balance > 45000, false)""",
    "prj_2_emi_payments": "SELECT * FROM c_emi",
    "prj_3_round_transfers": _ROUND.replace("SRC", "c_ledger_round"),
    "join_1_circular_pairs": "SELECT * FROM c_pairs",
    "agg_1_average_monthly_balance": "SELECT company_id, average_monthly_balance FROM c_ledger_totals",
    "agg_2_turnover_and_peak": "SELECT company_id, banking_turnover, largest_debit FROM c_ledger_totals",
    "agg_3_coverage_ratios": "SELECT * FROM c_coverage",
    "agg_4_cash_pattern": "SELECT company_id, cash_debits, total_debits, cash_pattern FROM c_ledger_totals",
    "agg_5_window_dressing": """SELECT company_id, txn_year, CASE WHEN early <= 0 THEN late > 0 ELSE late > 3 * early END AS year_end_window_dressing FROM (
  SELECT company_id, year(txn_date) AS txn_year, sum(CASE WHEN month(txn_date) = 3 AND day(txn_date) <= 15 THEN credit ELSE 0 END) AS early,
  sum(CASE WHEN month(txn_date) = 3 AND day(txn_date) > 15 THEN credit ELSE 0 END) AS late FROM c_ledger GROUP BY 1, 2) x""",
    "agg_6_bank_profile": "SELECT * FROM c_bank",
    "agg_7_pair_totals": "SELECT * FROM c_pair_totals",
    "win_6_filled_balance": """SELECT company_id, txn_id, txn_date, CAST(last_value(balance IGNORE NULLS) OVER (PARTITION BY company_id ORDER BY txn_date, txn_id) AS DOUBLE) AS balance_filled FROM c_ledger""",
    "win_7_running_balance": """SELECT company_id, txn_id, txn_date, CAST(sum(credit - debit) OVER (PARTITION BY company_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance FROM c_ledger""",
})
