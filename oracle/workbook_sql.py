from creditloom.operators.workbook import FIGURES, LABELS, RECON_LABELS, SHEET_CLASSES
from oracle.kit import CTES, SQL, any_of, r

NUM = "TRY_CAST(regexp_replace({0}, '[,₹%\\s]', '', 'g') AS DOUBLE)"
CTES["c_sheets"] = "SELECT DISTINCT company_id, file_name, sheet, CAST(sheet_no AS BIGINT) AS sheet_no FROM c_cells"
CTES["c_wb_col"] = """
SELECT company_id, file_name, sheet, coalesce((SELECT col_idx FROM (SELECT h.col_idx, CAST(regexp_extract(h.cell_text, '(\\d{4})', 1) AS INT) AS y
  FROM c_cells h WHERE h.company_id = s.company_id AND h.file_name = s.file_name AND h.sheet = s.sheet AND h.row_idx = 1 AND h.col_idx >= 2
    AND regexp_matches(h.cell_text, '\\d{4}')) q ORDER BY y DESC, col_idx LIMIT 1), 2) AS value_col
FROM (SELECT DISTINCT company_id, file_name, sheet FROM c_cells) s"""


def _lookup(kind: str, rules: dict, klass: str, columns: str) -> str:
    parts = []
    for figure, words in rules.items():
        parts.append(f"""SELECT '{figure}' AS figure, l.company_id, l.file_name, l.sheet, min(l.row_idx) AS row_idx FROM c_cells l
  WHERE l.col_idx = 1 AND {klass} AND {any_of('lower(trim(l.cell_text))', words)} GROUP BY 2, 3, 4""")
    return " UNION ALL ".join(parts)


_hits = " UNION ALL ".join(_lookup(k, rules, any_of("lower(l.sheet)", SHEET_CLASSES[k]), "") for k, rules in LABELS.items())
_VALUE = f"""
SELECT h.company_id, h.file_name, h.sheet, h.figure,
  coalesce(arg_min(v.num, v.col_idx) FILTER (WHERE v.num <> 0), max(v.num) FILTER (WHERE v.col_idx = k.value_col), 0) AS value
FROM HITS h JOIN COLS k ON h.company_id = k.company_id AND h.file_name = k.file_name AND h.sheet = k.sheet
LEFT JOIN (SELECT *, {NUM.format('cell_text')} AS num FROM c_cells) v ON v.company_id = h.company_id AND v.file_name = h.file_name AND v.sheet = h.sheet
  AND v.row_idx = h.row_idx AND v.col_idx BETWEEN k.value_col AND k.value_col + 4
GROUP BY h.company_id, h.file_name, h.sheet, h.figure"""
CTES["c_wb_hits"] = _hits
CTES["c_wb_values"] = _VALUE.replace("HITS", "c_wb_hits").replace("COLS", "c_wb_col")
CTES["c_wb_wide"] = "SELECT company_id, file_name, " + ", ".join(
    f"arg_max(value, sheet_no) FILTER (WHERE figure = '{f}') AS {f}" for f in FIGURES
) + " FROM c_wb_values JOIN c_sheets USING (company_id, file_name, sheet) GROUP BY company_id, file_name"
CTES["c_wb_lev"] = f"""
SELECT *, CASE WHEN ratio IS NULL THEN stated_equity ELSE {r('equity', 3)} END AS net_worth,
  CASE WHEN ratio IS NULL THEN stated_debt ELSE {r('debt', 3)} END AS total_debt,
  CASE WHEN ratio IS NULL THEN stated_de WHEN ratio <= 20 THEN {r('ratio', 3)} END AS debt_equity_ratio
FROM (SELECT *, CASE WHEN equity > 0 AND debt IS NOT NULL THEN debt / equity END AS ratio FROM (
  SELECT *, CASE WHEN share_capital IS NOT NULL AND reserves IS NOT NULL THEN share_capital + reserves ELSE stated_equity END AS equity,
    CASE WHEN long_borrowings IS NOT NULL AND short_borrowings IS NOT NULL THEN long_borrowings + short_borrowings ELSE stated_debt END AS debt FROM c_wb_wide) a) b"""
_COMPUTED = r("ebitda / (finance_cost + CASE WHEN current_maturities > 0 THEN current_maturities ELSE 0 END)", 3)
CTES["c_wb_facts"] = f"""
SELECT *, CASE WHEN coalesce(stated_dscr, 0) <> 0 THEN stated_dscr WHEN interest_coverage > 0 THEN interest_coverage
    WHEN finance_cost > 0 AND ebitda IS NOT NULL THEN {_COMPUTED} ELSE stated_dscr END AS dscr,
  CASE WHEN coalesce(stated_dscr, 0) <> 0 THEN 'stated' WHEN interest_coverage > 0 THEN 'interest_coverage_proxy'
    WHEN finance_cost > 0 AND ebitda IS NOT NULL THEN 'ebitda_over_finance_costs' END AS dscr_source
FROM c_wb_lev"""
CTES["c_recon_hits"] = _lookup("", RECON_LABELS, "l.sheet = 'Recon 2A vs 3B'", "")
CTES["c_recon_col"] = f"""
SELECT company_id, file_name, sheet, coalesce(min(col_idx) FILTER (WHERE row_idx = 2 AND col_idx BETWEEN 2 AND 9 AND {NUM.format('cell_text')} IS NOT NULL), 2) AS value_col
FROM c_cells WHERE sheet = 'Recon 2A vs 3B' GROUP BY 1, 2, 3"""
CTES["c_recon_values"] = _VALUE.replace("HITS", "c_recon_hits").replace("COLS", "c_recon_col")
CTES["c_recon"] = f"""
SELECT company_id, file_name, fiscal_year, itc_available, itc_claimed, itc_excess, gap AS itc_mismatch_pct, gap > 5 AS has_itc_mismatch, gap > 20 AS has_circular_signals
FROM (SELECT *, coalesce(stated, CASE WHEN itc_available > 0 THEN {r('itc_excess / itc_available * 100', 2)} ELSE 0 END) AS gap FROM (
  SELECT y.company_id, y.file_name, y.fiscal_year, coalesce(max(value) FILTER (WHERE figure = 'itc_available'), 0) AS itc_available,
    coalesce(max(value) FILTER (WHERE figure = 'itc_claimed'), 0) AS itc_claimed, coalesce(max(value) FILTER (WHERE figure = 'itc_excess'), 0) AS itc_excess,
    max(value) FILTER (WHERE figure = 'stated_mismatch') AS stated
  FROM (SELECT company_id, file_name, arg_min('FY' || regexp_extract(cell_text, 'FY(\\d{{4}}-?\\d{{2,4}})', 1), sheet_no) FILTER (WHERE row_idx = 1 AND col_idx = 1 AND regexp_matches(cell_text, 'FY\\d{{4}}-?\\d{{2,4}}')) AS fiscal_year
    FROM c_cells GROUP BY 1, 2) y LEFT JOIN c_recon_values v ON y.company_id = v.company_id AND y.file_name = v.file_name GROUP BY 1, 2, 3) a) b"""
CTES["c_holding"] = f"""
SELECT f.company_id, f.file_name, coalesce(h, 0) AS promoter_holding_pct, coalesce(p, 0) AS promoter_pledge_pct,
  CASE WHEN hp > 90 THEN 'CRITICAL' WHEN hp > 75 THEN 'HIGH' WHEN hp > 50 THEN 'MEDIUM' END AS pledge_severity
FROM (SELECT DISTINCT company_id, file_name FROM c_cells) f LEFT JOIN (
  SELECT b.company_id, b.file_name,
    arg_max(num, ord) FILTER (WHERE num > 0 AND num <= 100 AND (contains(head, 'holding') OR contains(head, '%'))) AS h,
    arg_max(num, ord) FILTER (WHERE num > 0 AND contains(head, 'pledge')) AS p,
    arg_max(num, ord) FILTER (WHERE num > 50 AND contains(head, 'pledge')) AS hp
  FROM (SELECT v.company_id, v.file_name, {NUM.format('v.cell_text')} AS num, lower(hd.cell_text) AS head, concat(lpad(CAST(v.sheet_no AS VARCHAR), 5, '0'), lpad(CAST(v.row_idx AS VARCHAR), 5, '0'), lpad(CAST(v.col_idx AS VARCHAR), 5, '0')) AS ord
    FROM c_cells l JOIN c_cells v ON l.company_id = v.company_id AND l.file_name = v.file_name AND l.sheet = v.sheet AND l.row_idx = v.row_idx
    JOIN c_cells hd ON hd.company_id = v.company_id AND hd.file_name = v.file_name AND hd.sheet = v.sheet AND hd.row_idx = 1 AND hd.col_idx = v.col_idx
    WHERE l.col_idx = 1 AND v.col_idx >= 2 AND contains(lower(l.cell_text), 'promoter') AND NOT contains(lower(l.cell_text), 'group')) b
  GROUP BY 1, 2) q ON f.company_id = q.company_id AND f.file_name = q.file_name"""

SQL.update({
    "wb_1_value_columns": "SELECT company_id, file_name, sheet_no, sheet, CAST(value_col AS BIGINT) AS value_col FROM c_wb_col JOIN c_sheets USING (company_id, file_name, sheet)",
    "wb_2_label_values": "SELECT company_id, file_name, sheet_no, sheet, figure, value FROM c_wb_values JOIN c_sheets USING (company_id, file_name, sheet)",
    "wb_3_statement_figures": "SELECT * FROM c_wb_wide",
    "wb_4_leverage": "SELECT company_id, file_name, net_worth, total_debt, debt_equity_ratio FROM c_wb_lev",
    "wb_5_debt_service": "SELECT company_id, file_name, dscr, dscr_source FROM c_wb_facts",
    "wb_6_credit_reconciliation": "SELECT * FROM c_recon",
    "wb_7_monthly_returns": f"""SELECT m.company_id, m.file_name, CAST(m.row_idx AS BIGINT) AS row_idx, trim(m.cell_text) AS month, coalesce({NUM.format('o.cell_text')}, 0) AS outward_supplies, coalesce({NUM.format('i.cell_text')}, 0) AS itc_claimed
FROM c_cells m LEFT JOIN c_cells o ON m.company_id = o.company_id AND m.file_name = o.file_name AND m.sheet = o.sheet AND m.row_idx = o.row_idx AND o.col_idx = 2
LEFT JOIN c_cells i ON m.company_id = i.company_id AND m.file_name = i.file_name AND m.sheet = i.sheet AND m.row_idx = i.row_idx AND i.col_idx = 3
WHERE m.sheet = 'GSTR-3B Monthly' AND m.col_idx = 1 AND m.row_idx >= 3 AND trim(m.cell_text) <> ''""",
    "wb_8_promoter_holding": "SELECT * FROM c_holding",
})
