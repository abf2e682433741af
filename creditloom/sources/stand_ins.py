"""Domain tables as projections of the given tables.

Each text runs unchanged in Spark SQL and in the SQL engine that checks results,
so the two sides of a check start from the same rows. Nothing here is an operator.
"""

from __future__ import annotations

import re

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

SECTORS = [
    "real_estate", "nbfc", "construction", "textiles", "agri_processing",
    "it_services", "pharma", "manufacturing", "other",
]

CENTS = "cast(l_extendedprice as decimal(18,2))"


def _case(selector: str, values: list[str], otherwise: str = "''") -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {selector} {arms} ELSE {otherwise} END"


def _cin(key: str) -> str:
    return (
        f"concat('L', lpad(cast({key} % 100000 as string), 5, '0'), 'MH2010PLC', "
        f"lpad(cast({key} % 1000000 as string), 6, '0'))"
    )


_DOC_LINES = [
    "concat('Revenue from Operations: ₹ ', cast(n_chars as string), '.5 crore (FY25). Net profit ', cast(n_chars % 500 + 1 as string), ' crore.')",
    "concat('Revenue stood at ', cast(n_chars * 10 as string), ' lakhs for the year. PAT ', cast(n_chars % 90 + 1 as string), ' lakhs.')",
    "concat('Gross Receipts: ', cast(n_chars as string), '.0 for the year')",
    "concat('Name: Acme', cast(doc_id as string), ' Components Pvt Ltd, CIN ', CASE WHEN doc_id % 24 = 3 THEN "
    + _cin("cast(substr(source, 4) as bigint)") + " ELSE " + _cin("doc_id + 7")
    + " END, ' PAN ABCDE', lpad(cast(doc_id % 10000 as string), 4, '0'), 'F')",
    "concat('Total debt ', cast(n_chars as string), ' outstanding. Top 5 customers contribute ', cast(n_chars % 90 + 5 as string), '% of sales. Rating reaffirmed by CRISIL AA-')",
    "concat('Sanctioned by State Bank limit ', cast(n_chars * 100000 as string), ' and Union Bank of ', cast(n_chars as string), '. Sanctioned amount at rate of interest 9')",
    "concat('A petition is pending before the High Court regarding supply case ', cast(doc_id as string), '. Legal notice served by the vendor advocate in a dispute')",
    "concat('Related party: Beta', cast(doc_id % 50 as string), ' Steel Limited is a wholly owned subsidiary. Strategic alliance with Gamma', cast(doc_id % 40 as string), ' Corp\nRated by ICRA after credit rating review')",
    "concat('The auditors issued a qualified opinion on stock ', cast(n_chars as string), '. Emphasis of matter on inventories\nBalance sheet and cash flow attached')",
    "concat('Zeta Holdings Limited\nPromoter Group holding ', cast(n_chars % 60 + 10 as string), '.5%\n1. Asha Family Trust - 12.25%\n2) Delta', cast(doc_id % 30 as string), ' Holdings: 8.75%\nCategory total 100%\nPledge of promoter shares ', cast(n_chars % 80 + 1 as string), '.0%')",
    "concat('No going concern uncertainty noted. Balance sheet and cash flow statements of ', cast(n_chars as string), ' pages; annual turnover of ', cast(n_chars * 20 as string), '. Profit after tax ', cast(n_chars % 700 as string))",
    "concat('Collateral: first charge on plant and machinery worth ', cast(n_chars as string), '\nSecurity by way of hypothecation of stock\nsecurity: x')",
]

_FINDING_SUMMARIES = [
    "concat('Benami holding and hawala links alleged in story ', cast(event_id % 41 as string), '. Inquiry on.')",
    "concat('NCLT admits plea number ', cast(event_id % 37 as string), ' under CIRP. Hearing next month.')",
    "concat('Quarterly results steady ', cast(event_id % 31 as string))",
    "concat('Company wins export growth award ', cast(event_id % 29 as string), '. Order book strong.')",
    "'Sector margins under pressure. Analysts cautious.'",
    "concat('Shell company trail and round-tripping with money laundering angle under PMLA, item ', cast(event_id % 23 as string))",
    "'Regulator seeks details of related transactions'",
    "concat('Director struck off list mention ', cast(event_id % 19 as string), '. Denied.')",
    "''",
    "'Plant expansion on schedule. No dispute.'",
    "concat('Arbitration with supplier ', cast(event_id % 17 as string), ' continues')",
    "'Attachment order issued by tribunal. Liquidation feared.'",
    "concat('Routine filing ', cast(event_id % 13 as string))",
]

_NOTE_LINES = [
    "concat('\nIdle machinery seen. capacity_utilization_percent: ', cast(conv_id % 100 as string))",
    "concat('\nHealthy demand and new order wins. management_interview_rating: ', cast(conv_id % 5 + 1 as string))",
    "'\ninventory_levels: suspicious'",
    "'\ninventory_levels: adequate, automation and timely payments, expansion planned'",
    "'\nmanagement_cooperation: refused'",
    "'\nmanagement_cooperation: cooperative'",
    "concat('\ncapacity_utilization_percent: ', cast(40 + conv_id % 3 as string), ' inventory_levels: low management_interview_rating: 2')",
    "'\nmanagement_cooperation: evasive and worker unrest, compliance gap'",
]

_PAGE_LINES = [
    "'<p>ED raid on promoters and NCLT hearing; RBI and court orders follow</p>'", "'<p>Loan default and cheque bounce reported</p>'",
    "'<p>Insolvency plea filed</p>'", "'<p>Strong demand and expansion</p>'", "'<p>SEBI regulatory note</p>'",
    "'<div>arbitration award</div>'", "'<aside>fake invoice</aside>'", "'<p>Steady quarter</p>'", "'<!-- cbi -->'",
]

_HOSTS = "www.thehindu.com economictimes.indiatimes.com ecourts.gov.in www.mca.gov.in rbi.org.in m.reuters.com www.youtube.com blog.example.org"
_HOST = f"split_part('{_HOSTS}', ' ', cast(event_id % 8 + 1 as int))"


def _amount(expr: str) -> str:
    """Text of a number cut (not rounded) to two decimals; all arithmetic in double."""
    in_double = re.sub(r"\b(\d+\.\d+)\b", r"cast(\1 as double)", expr)
    return f"cast(cast(cast(floor(({in_double}) * 100) as decimal(20,0)) / 100 as decimal(18,2)) as string)"


def sheet_numbers() -> dict[str, int]:
    """Place of each sheet in the workbook, which is not the order of their names."""
    return {name: i + 1 for i, name in enumerate(dict.fromkeys(cell[0] for cell in cell_grid()))}


def cell_grid() -> list[tuple[str, int, int, str, str]]:
    """Workbook cells per company as (sheet, row, column, text, condition) over the company totals."""
    put: list[tuple[str, int, int, str, str]] = []

    def row(sheet: str, r: int, label: str, older: str, newer: str, when: str = "true") -> None:
        put.append((sheet, r, 1, f"'{label}'", when))
        put.append((sheet, r, 2, older, when))
        put.append((sheet, r, 3, newer, when))

    for sheet in ("Financial Ratios", "P&L", "Balance Sheet"):
        row(sheet, 1, "Particulars", "'FY2023'", "'FY2024'")
    row("Financial Ratios", 2, "EBITDA / Interest (ICR)", "'2.0'", _amount("1 + n_rows % 7"))
    row("Financial Ratios", 3, "Debt Service Coverage", "'1.10'", _amount("(n_rows % 19) / 10.0"), "company_id % 3 <> 1")
    row("Financial Ratios", 4, "Debt Equity Ratio", "'1.5'", _amount("(n_rows % 40) / 10.0"))
    row("Financial Ratios", 5, "Current Ratio (times)", "'1.2'", _amount("0.8 + (n_rows % 15) / 10.0"))
    row("Financial Ratios", 6, "EBITDA Margin %", "'11%'", "concat(" + _amount("n_rows % 30") + ", '%')")
    row("P&L", 2, "Revenue from Operations", "'100'", "concat('₹', " + _amount("gross / 1000000.0") + ")", "company_id % 7 <> 3")
    row("P&L", 3, "EBITDA", "'12'", _amount("gross / 9000000.0"))
    row("P&L", 4, "Finance Cost", "'4'", _amount("gross / 40000000.0"))
    row("P&L", 5, "Profit for the year", "'3'", _amount("gross / 30000000.0"))
    row("Balance Sheet", 2, "Equity Share Capital", "'10'", _amount("qty / 400.0"))
    row("Balance Sheet", 3, "Reserves and Surplus", "'5'", _amount("qty / 300.0"), "company_id % 5 <> 2")
    row("Balance Sheet", 4, "Net Worth", "'15'", _amount("qty / 150.0"))
    row("Balance Sheet", 5, "Long Term Borrowings", "'20'", _amount("qty / 100.0"))
    row("Balance Sheet", 6, "Short Term Borrowings", "'7'", "'-'", "company_id % 4 = 3")
    row("Balance Sheet", 6, "Short Term Borrowings", "'7'", _amount("qty / 700.0"), "company_id % 4 < 3")
    row("Balance Sheet", 7, "Total Current Assets", "'30'", _amount("qty / 90.0"))
    row("Balance Sheet", 8, "Total Current Liabilities", "'25'", _amount("qty / 110.0"))
    row("Balance Sheet", 9, "Current Maturities of Long-Term debt", "'2'", "'3.5'", "company_id % 2 = 0")
    row("Balance Sheet", 10, "Contingent Liabilities", "'1'", _amount("qty / 150.0 * (n_rows % 12)"))
    recon = "Recon 2A vs 3B"
    put.append((recon, 1, 1, "'GST reconciliation FY2023-24'", "true"))
    put.append((recon, 2, 1, "'Particulars'", "true"))
    put.append((recon, 2, 2, "'0'", "true"))
    put.append((recon, 3, 1, "'ITC available per GSTR-2A'", "true"))
    put.append((recon, 3, 2, _amount("gross / 1000000.0"), "true"))
    put.append((recon, 4, 1, "'ITC claimed in GSTR-3B'", "true"))
    put.append((recon, 4, 2, _amount("gross / 1000000.0 * (1 + (n_rows % 30) / 100.0)"), "true"))
    put.append((recon, 5, 1, "'Excess ITC claimed'", "true"))
    put.append((recon, 5, 2, _amount("gross / 1000000.0 * ((n_rows % 30) / 100.0)"), "true"))
    put.append((recon, 6, 1, "'Mismatch as %'", "company_id % 2 = 1"))
    put.append((recon, 6, 2, "concat(" + _amount("n_rows % 30") + ", '%')", "company_id % 2 = 1"))
    monthly = "GSTR-3B Monthly"
    put += [(monthly, 2, 1, "'Month'", "true"), (monthly, 2, 2, "'Outward Supplies'", "true"), (monthly, 2, 3, "'ITC Claimed'", "true")]
    for m in range(1, 13):
        put.append((monthly, 2 + m, 1, f"'2024-{m:02d}'", "true" if m != 7 else "company_id % 2 = 0"))
        put.append((monthly, 2 + m, 2, _amount(f"gross / 12000000.0 + {m}"), "true"))
        put.append((monthly, 2 + m, 3, "'n/a'" if m == 4 else _amount(f"gross / 90000000.0 + {m}"), "true"))
    holding = "Shareholding"
    put += [(holding, 1, 1, "'Category'", "true"), (holding, 1, 2, "'Holding %'", "true"), (holding, 1, 3, "'Pledge (pct)'", "true")]
    put += [(holding, 2, 1, "'Promoter'", "true"), (holding, 2, 2, _amount("20 + n_rows % 60"), "true"),
            (holding, 2, 3, _amount("n_rows % 100"), "true"),
            (holding, 3, 1, "'Promoter Group'", "true"), (holding, 3, 2, "'99'", "true"),
            (holding, 4, 1, "'Promoter Trust'", "company_id % 6 = 0"), (holding, 4, 2, "'101'", "company_id % 6 = 0"),
            (holding, 4, 3, "'55'", "company_id % 6 = 0")]
    return put


def _cells_sql() -> str:
    put = cell_grid()
    grid = " UNION ALL ".join(f"SELECT {i} AS cell_no" for i in range(len(put)))
    pick = lambda k, quote: "CASE cell_no " + " ".join(
        f"WHEN {i} THEN " + (f"'{p[k]}'" if quote else str(p[k])) for i, p in enumerate(put)) + " END"
    numbers = sheet_numbers()
    sheet_no = "CASE cell_no " + " ".join(f"WHEN {i} THEN {numbers[p[0]]}" for i, p in enumerate(put)) + " END"
    return (
        f"SELECT company_id, concat('co', cast(company_id as string), '_book.xlsx') AS file_name, {sheet_no} AS sheet_no, {pick(0, True)} AS sheet, "
        f"{pick(1, False)} AS row_idx, {pick(2, False)} AS col_idx, {pick(3, False)} AS cell_text "
        f"FROM c_totals CROSS JOIN ({grid}) g WHERE {pick(4, False)}"
    )


STAND_INS: dict[str, str] = {
    "c_company": f"""
SELECT s_suppkey AS company_id, s_name AS company_name,
  {_case('s_nationkey % 9', [f"'{s}'" for s in SECTORS])} AS sector,
  {_cin('s_suppkey')} AS cin,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('27ABCDE', lpad(cast(s_suppkey % 10000 as string), 4, '0'), 'F1Z5') END AS gstin,
  cast(cast(abs(s_acctbal) as decimal(18,2)) as double) AS declared_turnover_cr,
  cast(cast(abs(s_acctbal) as decimal(18,2)) as double) / 20 AS requested_cr,
  concat('Promoter A', cast(s_suppkey as string)) AS promoter_a,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('Promoter B', cast(s_suppkey as string)) ELSE NULL END AS promoter_b
FROM supplier""",
    "c_ledger": f"""
SELECT l_suppkey AS company_id,
  concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string),
    cast(l_suppkey as string), cast(cast(l_shipdate as date) as string), cast({CENTS} as string)) AS txn_id,
  cast(l_shipdate as date) AS txn_date,
  CASE WHEN l_returnflag = 'R' THEN {CENTS} ELSE cast(0 as decimal(18,2)) END AS debit,
  CASE WHEN l_returnflag = 'R' THEN cast(0 as decimal(18,2)) ELSE {CENTS} END AS credit,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE cast(l_quantity * 1000 as decimal(18,2)) END AS balance,
  {_case('l_linenumber % 4', ["'NACH EMI TERM LOAN'", "'CASH WITHDRAWAL ATM'", "'NEFT Customer Receipts'", "'Inter-Corporate Deposit'"])} AS narration,
  p_type AS party
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "c_ledger_raw": """
SELECT company_id, txn_id,
  CASE WHEN narration = 'CASH WITHDRAWAL ATM' AND balance > 45000 THEN 'not a date' ELSE cast(txn_date as string) END AS date_text,
  CASE WHEN debit > 0 THEN cast(debit as string) ELSE NULL END AS debit_text,
  CASE WHEN credit > 0 THEN cast(credit as string) ELSE NULL END AS credit_text,
  cast(balance as string) AS balance_text, narration, party
FROM c_ledger""",
    "c_ledger_round": """
SELECT l_suppkey AS company_id,
  concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string),
    cast(cast(l_shipdate as date) as string), cast(cast(l_extendedprice as decimal(18,2)) as string)) AS txn_id,
  cast(l_shipdate as date) AS txn_date,
  CASE WHEN l_returnflag = 'R' THEN cast(l_quantity * 10000 as decimal(18,2)) ELSE cast(0 as decimal(18,2)) END AS debit,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'Salary pool' ELSE p_type END AS party
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "c_month": f"""
SELECT l_suppkey AS company_id, cast(date_trunc('month', l_shipdate) as date) AS period,
  sum({CENTS}) AS outward,
  sum({CENTS} * cast(l_tax as decimal(4,2))) AS claimed,
  sum({CENTS} * cast(l_discount as decimal(4,2))) AS paid,
  sum({CENTS} * cast(1 - l_discount as decimal(4,2))) AS sales,
  sum(CASE WHEN l_returnflag = 'R' THEN cast(0 as decimal(18,2)) ELSE {CENTS} END) AS credits,
  sum(CASE WHEN l_returnflag = 'A' THEN {CENTS} * cast(CASE WHEN l_linenumber = 1 THEN l_tax * 0.8 ELSE l_tax END as decimal(6,3)) ELSE 0 END) AS vendor_a,
  sum(CASE WHEN l_returnflag = 'N' THEN {CENTS} * cast(CASE WHEN l_linenumber = 1 THEN l_tax * 0.8 ELSE l_tax END as decimal(6,3)) ELSE 0 END) AS vendor_n,
  sum(CASE WHEN l_returnflag = 'R' THEN {CENTS} * cast(CASE WHEN l_linenumber = 1 THEN l_tax * 0.8 ELSE l_tax END as decimal(6,3)) ELSE 0 END) AS vendor_r
FROM lineitem GROUP BY l_suppkey, cast(date_trunc('month', l_shipdate) as date)""",
    "c_gstr3b": """
SELECT company_id, period, cast(outward as double) AS outward_supplies, cast(claimed as double) AS itc_claimed,
  cast(paid as double) AS tax_paid FROM c_month""",
    "c_gstr2a": """
SELECT company_id, period, cast(vendor_a + vendor_n + vendor_r as double) AS available_itc,
  cast(vendor_a as double) AS vendor_a, cast(vendor_n as double) AS vendor_n, cast(vendor_r as double) AS vendor_r FROM c_month""",
    "c_gstr1": """
SELECT company_id, period, cast(sales as double) AS invoice_sales_total FROM c_month WHERE company_id % 10 <> 9""",
    "c_credits": """
SELECT company_id, period, cast(credits as double) AS bank_credits FROM c_month WHERE credits > 0""",
    "c_itr": """
SELECT l_suppkey AS company_id, year(l_shipdate) AS assessment_year,
  cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(1 - l_discount as decimal(4,2))) as double) AS gross_revenue,
  cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as double) AS taxable_income,
  cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2))) as double) AS tax_paid
FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
    "c_totals": f"""
SELECT l_suppkey AS company_id, count(*) AS n_rows, cast(sum({CENTS}) as double) AS gross,
  cast(sum(cast(l_quantity as decimal(18,0))) as double) AS qty
FROM lineitem GROUP BY l_suppkey""",
    "c_cells": _cells_sql(),
    "c_versions": """
SELECT o_custkey AS company_id, o_orderkey AS version_id, o_orderdate AS created_at, o_orderstatus AS status,
  cast(cast(o_totalprice as decimal(18,2)) as double) AS amount,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '  ' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS officer_name,
  CASE WHEN o_orderstatus = 'F' THEN concat('role-', o_orderstatus, cast(o_orderkey % 7 as string)) ELSE '' END AS officer_role
FROM orders""",
    "c_findings": f"""
SELECT user_id AS company_id, event_id AS seq, cast(ts as date) AS finding_date,
  CASE event_type WHEN 'error' THEN 'FRAUD_ALERT' WHEN 'signup' THEN 'SECTOR' WHEN 'click' THEN 'LITIGATION'
    WHEN 'view' THEN 'REGULATORY' ELSE 'COMPANY_NEWS' END AS finding_type,
  CASE WHEN value >= 150 THEN 'CRITICAL' WHEN value >= 70 THEN 'HIGH' WHEN value >= 35 THEN 'MEDIUM'
    WHEN value >= 15 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity,
  concat('https://', {_HOST}, '/Item/', cast(event_id % 97 as string)) AS source_url,
  {_HOST} AS source_name,
  {_case('event_id % 13', _FINDING_SUMMARIES)} AS summary,
  concat('raw ', props, ' ', event_type) AS raw_snippet,
  cast(cast(0.5 + (event_id % 50) / 100.0 as decimal(4,2)) as double) AS confidence,
  CASE WHEN event_id % 13 IN (3, 9) THEN 2.0 WHEN value >= 150 THEN -20.0 WHEN value >= 70 THEN -12.0
    WHEN value >= 35 THEN -6.0 ELSE -1.0 END AS score_impact
FROM events""",
    "c_landed": f"""
SELECT user_id AS company_id, event_id AS seq,
  concat(CASE event_id % 4 WHEN 0 THEN 'Fraud Check ' WHEN 1 THEN 'fraud check ' ELSE 'news ' END, cast(event_id % 11 as string)) AS query,
  CASE event_id % 5 WHEN 0 THEN 'LITIGATION' WHEN 1 THEN 'MCA_FILING' WHEN 2 THEN 'REGULATORY_ACTION' WHEN 3 THEN 'COMPANY_NEWS' ELSE 'OTHER' END AS query_type,
  CASE WHEN event_id % 3 = 0 THEN concat('https://', {_HOST}, '/a', cast(event_id % 23 as string),
    CASE WHEN event_id % 9 = 0 THEN '.png?x=1' ELSE '' END) ELSE '' END AS url,
  CASE WHEN event_id % 3 = 1 THEN concat('https://', {_HOST}, '/b', cast(event_id % 19 as string)) ELSE NULL END AS source_url,
  CASE WHEN event_id % 2 = 0 THEN concat('desc ', event_type) ELSE '' END AS description,
  CASE WHEN event_id % 2 = 1 THEN concat('snip ', event_type) ELSE NULL END AS snippet,
  CASE WHEN event_id % 5 = 0 THEN concat('# page ', event_type) ELSE '' END AS markdown,
  CASE WHEN event_id % 5 < 3 THEN concat('content ', event_type) ELSE NULL END AS content
FROM events""",
    "c_doc_text": f"""
SELECT doc_id, cast(substr(source, 4) as bigint) AS company_id, concat(text, '\n', {_case('doc_id % 12', _DOC_LINES)}) AS doc_text
FROM documents""",
    "c_reviews": """
SELECT d.doc_id, cast(substr(d.source, 4) as bigint) AS company_id,
  CASE d.doc_id % 5 WHEN 0 THEN 'ALM' WHEN 1 THEN 'SHAREHOLDING' WHEN 2 THEN 'BORROWING_PROFILE' WHEN 3 THEN 'ANNUAL_REPORT' ELSE 'PORTFOLIO' END AS auto_type,
  CASE WHEN toxic = 1 THEN 'SHAREHOLDING_PATTERN' ELSE NULL END AS human_override,
  CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS human_approved
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "c_web_pages": f"""
SELECT page_id, url, concat(html, {_case('page_id % 9', _PAGE_LINES)}) AS html FROM pages""",
    "c_registry": """
SELECT s_suppkey AS company_id, CASE WHEN s_nationkey % 5 = 0 THEN concat('Gone', cast(s_suppkey as string), ' Traders, Closed Mills') ELSE NULL END AS struck_off,
  cast(cast(60 + s_nationkey as decimal(6,1)) as double) AS compliance_score FROM supplier""",
    "c_scans": """
SELECT conv_id AS doc_id, turn AS page_no, CASE WHEN role = 'user' THEN text ELSE '' END AS native_text,
  CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN text ELSE '' END AS table_text, text AS ocr_text,
  cast(length(text) % 70 as double) / 100 + cast(0.3 as double) AS ocr_confidence
FROM conversations""",
    "c_files": """
SELECT doc_id, cast(substr(source, 4) as bigint) AS company_id, n_chars * 30000 AS size_bytes,
  concat(CASE doc_id % 10 WHEN 0 THEN 'ALM-liquidity' WHEN 1 THEN 'Share Pattern Q' WHEN 2 THEN 'debt schedule' WHEN 3 THEN 'Annual.Report'
    WHEN 4 THEN 'GSTR3B_return' WHEN 5 THEN 'itr_ack' WHEN 6 THEN 'bank statement' WHEN 7 THEN 'FS_key_credit' WHEN 8 THEN 'npa report' ELSE 'scan' END,
    '_', cast(doc_id as string),
    CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.JSON' WHEN 3 THEN '.csv' WHEN 4 THEN '.docx' WHEN 5 THEN '.xml' ELSE '.exe' END) AS file_name,
  CASE doc_id % 7 WHEN 0 THEN 'application/pdf' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/csv' WHEN 6 THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type
FROM documents""",
    "c_notes": f"""
SELECT conv_id AS company_id, turn AS seq, role, concat(text, {_case('(conv_id + turn) % 8', _NOTE_LINES)}) AS note FROM conversations""",
    "c_diligence": """
SELECT conv_id AS company_id, turn AS seq, CASE WHEN turn % 3 = 2 THEN NULL ELSE text END AS free_text_notes,
  CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 100 END AS capacity_utilization_percent,
  CASE conv_id % 4 WHEN 0 THEN 'suspicious' WHEN 1 THEN 'low' WHEN 2 THEN 'adequate' ELSE NULL END AS inventory_levels,
  CASE turn % 3 WHEN 0 THEN 'cooperative' WHEN 1 THEN 'evasive' ELSE 'refused' END AS management_cooperation,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE conv_id % 5 + 1 END AS management_interview_rating,
  role AS borrower_finance_officer_name,
  CASE WHEN turn % 2 = 0 THEN 'new order book' ELSE NULL END AS borrower_business_highlights
FROM conversations""",
    "c_chunks": """
SELECT doc_id AS chunk_id, cast(substr(source, 4) as bigint) AS company_id, lang AS doc_type, text AS chunk_text FROM documents""",
    "c_questions": "SELECT item_id AS question_id, item_id % 20 AS company_id, text AS question FROM benchmark",
    "c_vectors": "SELECT vec_id AS chunk_id, label AS company_id, embedding FROM embeddings",
    "c_facilities": """
SELECT l_suppkey AS company_id, concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string)) AS facility_id,
  cast(l_extendedprice as decimal(18,2)) AS outstanding, cast(5 + l_discount * 100 as decimal(6,2)) AS rate_pct,
  l_linestatus = 'O' AND l_returnflag = 'R' AS overdue,
  CASE WHEN l_tax >= 0.04 THEN 'hypothecation' ELSE NULL END AS security,
  l_linenumber <= 3 AS due_within_1yr
FROM lineitem""",
}


def expand(names: list[str], texts: dict[str, str]) -> list[str]:
    """The named texts and all they refer to, each after what it uses."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for used in re.findall(r"\bc_\w+\b", texts[name]):
            if used in texts and used != name:
                visit(used)
        order.append(name)

    for n in names:
        visit(n)
    return order


def with_clause(select: str, texts: dict[str, str]) -> str:
    """A select plus the texts it refers to, as one statement."""
    used = [n for n in dict.fromkeys(re.findall(r"\bc_\w+\b", select)) if n in texts]
    order = expand(used, texts)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({texts[n]})" for n in order) + "\n" + select
