from creditloom.operators import diligence as D
from creditloom.operators import intake as I
from creditloom.operators import textjobs as X
from oracle.kit import CTES, SQL, any_of, r, squeeze

q = lambda s: s.replace("'", "''")
T = "doc_text"


def ex(pattern: str, group: int = 1, text: str = T) -> str:
    return f"nullif(regexp_extract({text}, '{q(pattern)}', {group}), '')"


def num(e: str) -> str:
    return f"TRY_CAST(replace({e}, ',', '') AS DOUBLE)"


def crore(n: str, u: str) -> str:
    u = f"lower(coalesce({u}, ''))"
    v = num(n)
    return f"""coalesce(CASE WHEN contains({u}, 'lakh') OR contains({u}, 'lac') THEN {v} / 100 WHEN contains({u}, 'million') OR contains({u}, 'mn') THEN {v} / 10
  WHEN contains({u}, 'crore') OR contains(concat(' ', {u}), ' cr') THEN {v} WHEN {v} > 100000 THEN {v} / 100 WHEN {v} > 10000 THEN {v} / 10 ELSE {v} END, 0)"""


def unnested(list_expr: str, name: str, source: str = "c_doc_text", key: str = "doc_id") -> str:
    return f"SELECT {key}, unnest(l) AS {name}, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT {key}, {list_expr} AS l FROM {source}) z"


SENT = f"list_transform(list_filter(string_split_regex({T}, '[.\\n]'), lambda s: COND), lambda s: {squeeze('s')})"


def sentences(cond: str) -> str:
    return SENT.replace("COND", cond)


LINES = f"list_filter(list_transform(string_split({T}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
REV = f"coalesce({num(ex(X.REVENUE_CRORE))}, {num(ex(X.REVENUE_LAKH))} / 100, {num(ex(X.GROSS_RECEIPTS))})"
_series = []
for kind, patterns in (("revenue", X.REVENUE_SERIES), ("profit", X.PROFIT_SERIES)):
    for i, p in enumerate(patterns):
        _series.append(f"""SELECT doc_id, '{kind}' AS kind, {0 if kind == 'revenue' else 9} + {i} AS pat, i, {r(crore('n', 'u'), 2)} AS amount FROM (
  SELECT doc_id, unnest(a) AS n, unnest(b) AS u, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all({T}, '{q(p)}', 1) AS a, regexp_extract_all({T}, '{q(p)}', 2) AS b FROM c_doc_text) y) x""")
CTES["c_money"] = "SELECT * FROM (" + " UNION ALL ".join(_series) + ") m WHERE amount > 0"
CTES["c_disputes"] = f"SELECT * FROM ({unnested('list_transform(list_filter(' + sentences(any_of('lower(s)', X.DISPUTE_WORDS)) + ', lambda s: length(s) >= 20), lambda s: s)', 'title')}) w"
CTES["c_related"] = f"""SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS pos FROM (
  SELECT doc_id, sentence, min(pos) AS first_pos FROM ({unnested('list_transform(list_filter(' + sentences(any_of('lower(s)', X.RELATED_WORDS)) + ", lambda s: s <> ''), lambda s: s)", 'sentence')}) w GROUP BY 1, 2) v"""
CTES["c_auditor"] = f"""SELECT * FROM ({unnested("list_transform(list_filter(" + sentences(f"regexp_matches(s, '{X.AUDITOR_PATTERN}')") + ", lambda s: s <> ''), lambda s: s)", 'sentence')}) w"""
CTES["c_limits"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, {squeeze('n')} AS lender, {num('a')} AS limit_amount FROM (
  SELECT doc_id, unnest(x) AS n, unnest(y) AS a, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all({T}, '{X.BANK_LIMIT}', 1) AS x, regexp_extract_all({T}, '{X.BANK_LIMIT}', 2) AS y FROM c_doc_text) z) w
  WHERE {num('a')} IS NOT NULL"""
_counts = {n: " + ".join(f"CAST(contains(lower({T}), '{q(w)}') AS INT)" for w in words) for n, words in X.CONTENT_WORDS.items()}
_best = "greatest(" + ", ".join(f"({c})" for c in _counts.values()) + ")"
CTES["c_content"] = f"SELECT doc_id, CASE WHEN {_best} = 0 THEN 'UNKNOWN' " + " ".join(f"WHEN ({c}) = {_best} THEN '{n}'" for n, c in _counts.items()) + " END AS content_type FROM c_doc_text"
CTES["c_docfacts"] = f"""
SELECT d.doc_id, d.company_id, {ex(X.CIN)} AS cin, {ex(X.PAN)} AS pan, {REV} AS revenue_cr, {num(ex(X.TOTAL_DEBT))} AS total_debt, regexp_matches({T}, '(?i)going concern') AS going_concern,
  length({T}) AS n_text, content_type, EXISTS (SELECT 1 FROM c_money m WHERE m.doc_id = d.doc_id AND kind = 'revenue') AS has_series, EXISTS (SELECT 1 FROM c_money m WHERE m.doc_id = d.doc_id AND kind = 'profit') AS has_profit,
  EXISTS (SELECT 1 FROM c_auditor a WHERE a.doc_id = d.doc_id) AS has_auditor
FROM c_doc_text d JOIN c_content k ON d.doc_id = k.doc_id"""
CTES["c_confidence"] = f"""
SELECT *, conf < 0.7 AS needs_review FROM (SELECT *, {r("greatest(0.1, least(1, (round(least(0.95, 0.55 + CASE WHEN cin IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN pan IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN coalesce(revenue_cr > 0, false) OR has_series THEN 0.1 ELSE 0 END + CASE WHEN has_profit THEN 0.1 ELSE 0 END + CASE WHEN content_type <> 'UNKNOWN' THEN 0.1 ELSE 0 END), 3) + SRC) / 2))", 6)} AS conf FROM c_docfacts) x"""
CTES["c_holders"] = f"""
SELECT doc_id, company_id, name_key, min(pos) AS pos, arg_min(name, pos) AS name, {r('arg_min(pct, pos)', 2)} AS pct FROM (
  SELECT doc_id, company_id, pos, pct, name, lower(name) AS name_key FROM (SELECT doc_id, company_id, pos, TRY_CAST(regexp_extract(line, '(\\d{{1,2}}(?:\\.\\d{{1,2}})?)\\s*%', 1) AS DOUBLE) AS pct,
    regexp_replace(trim(regexp_replace(trim(regexp_extract(line, '^(.*?)(\\d{{1,2}}(?:\\.\\d{{1,2}})?)\\s*%', 1), ' -:|'), '^\\d+\\s*[).:-]\\s*', '')), '\\s{{2,}}', ' ', 'g') AS name
    FROM (SELECT d.company_id, w.* FROM c_doc_text d JOIN ({unnested(LINES, 'line')}) w ON d.doc_id = w.doc_id) y WHERE contains(line, '%')) x
  WHERE pct > 0 AND length(name) >= 3 AND NOT {any_of('lower(name)', X.NOT_HOLDERS)}) h GROUP BY 1, 2, 3"""
CTES["c_top_holders"] = "SELECT doc_id, company_id, row_number() OVER (PARTITION BY doc_id ORDER BY pct DESC, pos) AS rank_no, name, pct FROM c_holders"


def line_pct(word: str) -> str:
    return f"""SELECT doc_id, arg_min({r("CAST(regexp_extract(line, '(\\d{1,2}(?:\\.\\d{1,2})?)\\s*%', 1) AS DOUBLE)", 2)}, pos) AS v FROM ({unnested(LINES, 'line')}) w
  WHERE contains(lower(line), '{word}') AND regexp_matches(line, '\\d{{1,2}}(?:\\.\\d{{1,2}})?\\s*%') GROUP BY 1"""


CTES["c_holding_facts"] = f"""
SELECT doc_id, company_id, held AS promoter_holding_pct, coalesce(pledged, 0) AS pledged_pct,
  concat_ws(' | ', CASE WHEN pledged > 25 THEN concat('Promoter pledge is high at ', format('{{:.2f}}', pledged), '%') END, CASE WHEN held < 26 THEN concat('Promoter holding is low at ', format('{{:.2f}}', held), '%') END) AS red_flags,
  coalesce(n, 0) AS n_holders, CAST(CASE WHEN n > 0 THEN 0.72 ELSE 0.35 END AS DOUBLE) AS confidence
FROM (SELECT d.doc_id, d.company_id, coalesce(a.v, l.listed, 0) AS held, b.v AS pledged, n FROM c_doc_text d LEFT JOIN ({line_pct('promoter')}) a ON d.doc_id = a.doc_id
  LEFT JOIN ({line_pct('pledge')}) b ON d.doc_id = b.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(CAST(pct AS DECIMAL(9,2))) FILTER (WHERE {any_of('name_key', X.PROMOTER_NAMES)}) AS DOUBLE) AS listed FROM c_holders GROUP BY 1) l ON d.doc_id = l.doc_id) x"""
_html = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for _t in X.DROPPED_TAGS:
    _html = f"regexp_replace({_html}, '(?is)<{_t}(\\s[^>]*)?>.*?</{_t}\\s*>', chr(10), 'g')"
_html = f"regexp_replace({_html}, '<[^>]*>', chr(10), 'g')"
# The references that the pages may hold; "&amp;" comes last, so that nothing is decoded twice.
for _a, _b in {"&lt;": 60, "&gt;": 62, "&quot;": 34, "&#39;": 39, "&apos;": 39, "&nbsp;": 160, "&copy;": 169, "&reg;": 174, "&middot;": 183, "&#8377;": 8377, "&amp;": 38}.items():
    _html = f"replace({_html}, '{_a}', chr({_b}))"
_blanks = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
CTES["c_pagetext"] = f"""SELECT page_id, url, concat('query for page ', page_id) AS query,
  array_to_string(list_filter(list_transform(string_split_regex({_html}, '[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_replace(s, '^{_blanks}|{_blanks}$', '', 'g')), lambda s: s <> ''), chr(10)) AS content FROM c_web_pages"""
CTES["c_headline"] = """SELECT page_id, content, coalesce(list_filter(string_split(content, chr(10)), lambda s: length(s) BETWEEN 15 AND 180)[1], query) AS headline,
  array_to_string(list_transform(string_split(lab, '-'), lambda s: concat(upper(substr(s, 1, 1)), lower(substr(s, 2)))), '-') AS source_name FROM (SELECT *, split_part(replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), 'www.', ''), '.', 1) AS lab FROM c_pagetext) x"""
CTES["c_pagefind"] = "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, finding_type, severity, score_impact, headline, trim(replace(content, chr(10), ' ')) AS summary, source_name, content AS raw_snippet FROM (" + " UNION ALL ".join(
    f"SELECT page_id, content, headline, source_name, {i} AS k, '{t}' AS finding_type, '{s}' AS severity, CAST({v} AS DOUBLE) AS score_impact FROM c_headline WHERE regexp_matches(lower(content), '{p}')"
    for i, (p, t, s, v) in enumerate(X.PAGE_RULES)) + ") x"


def notes_sql(source: str, note: str) -> str:
    low = f"lower({note})"
    hits = lambda ps: " + ".join(f"CAST(regexp_matches(low, '{p}') AS INT)" for p in ps)
    return f"""
SELECT company_id, seq, CAST(points AS DOUBLE) AS score_adjustment, CASE WHEN points <= -10 THEN 'NEGATIVE' WHEN points >= 8 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
  CAST(bad AS BIGINT) AS risk_count, CAST(good AS BIGINT) AS positive_count,
  concat_ws(' | ', CASE WHEN bad > 0 THEN 'Field visit identified operational risk signals.' END, CASE WHEN contains(low, 'inventory') THEN 'Inventory quality and valuation to be validated quarterly.' END,
    CASE WHEN contains(low, 'capacity') AND contains(low, '40') THEN 'Low observed capacity utilization may pressure debt servicing.' END) AS concerns
FROM (SELECT *, greatest(-50, least(20, greatest(-50, least(20, 4 * g - 10 * b)) + p1 + p2 + p3 + p4)) AS points,
  b + CAST(p1 < 0 AS INT) + CAST(p2 < 0 AS INT) + CAST(p3 < 0 AS INT) + CAST(p4 < 0 AS INT) AS bad, g + CAST(p1 > 0 AS INT) + CAST(p2 > 0 AS INT) + CAST(p3 > 0 AS INT) + CAST(p4 > 0 AS INT) AS good
FROM (SELECT *, {hits(D.RISK_PATTERNS)} AS b, {hits(D.GOOD_PATTERNS)} AS g,
  CASE WHEN cap < 45 THEN -12 WHEN cap < 60 THEN -6 WHEN cap >= 80 THEN 6 ELSE 0 END AS p1, CASE WHEN rating <= 2 THEN -10 WHEN rating >= 4 THEN 4 ELSE 0 END AS p2,
  CASE WHEN contains(low, 'inventory_levels: suspicious') THEN -10 WHEN contains(low, 'inventory_levels: low') THEN -5 WHEN contains(low, 'inventory_levels: adequate') THEN 2 ELSE 0 END AS p3,
  CASE WHEN contains(low, 'management_cooperation: refused') THEN -12 WHEN contains(low, 'management_cooperation: evasive') THEN -8 WHEN contains(low, 'management_cooperation: cooperative') THEN 3 ELSE 0 END AS p4
FROM (SELECT company_id, seq, {low} AS low, TRY_CAST(regexp_extract({low}, 'capacity_utilization_percent:\\s*(\\d+)', 1) AS BIGINT) AS cap, TRY_CAST(regexp_extract({low}, 'management_interview_rating:\\s*(\\d+)', 1) AS BIGINT) AS rating FROM {source}) a) c) e"""


_known = {"capacity_utilization_percent", "inventory_levels", "management_cooperation", "management_interview_rating", "borrower_finance_officer_name", "borrower_business_highlights"}
CTES["c_enriched"] = "SELECT company_id, seq, concat_ws(chr(10), nullif(free_text_notes, ''), " + ", ".join(
    f"concat('{l}: ', coalesce(CAST({f} AS VARCHAR), 'None'))" if f in _known else f"'{l}: None'" for l, f in D.LABELLED) + ") AS note FROM c_diligence"
CTES["c_scored_notes"] = notes_sql("c_enriched", "note")
CTES["c_due"] = """
SELECT c.company_id, CAST(CASE WHEN d.company_id IS NULL THEN 6 ELSE coalesce(management_interview_rating, 3) * 2 END AS DOUBLE) AS management_integrity_score,
  CAST(coalesce(capacity_utilization_percent, 65) AS DOUBLE) AS factory_capacity_utilization, CAST(coalesce(score_adjustment, 0) AS DOUBLE) AS due_diligence_risk_adjustment
FROM c_company c LEFT JOIN (SELECT * FROM c_diligence QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY seq DESC) = 1) d ON c.company_id = d.company_id
LEFT JOIN c_scored_notes s ON d.company_id = s.company_id AND d.seq = s.seq"""
rule = lambda text, rules: "CASE " + " ".join(f"WHEN {any_of(text, w)} THEN '{n}'" for n, w in rules) + " END"
ends = lambda e, xs: "(" + " OR ".join(f"ends_with({e}, '{x}')" for x in xs) + ")"
CTES["c_effective"] = "SELECT *, coalesce(human_override, auto_type) AS effective_type FROM c_reviews"
CTES["c_facility_share"] = f"""
SELECT company_id, {r("coalesce(sum(outstanding) FILTER (WHERE overdue AND security IS NULL), 0)::DOUBLE / sum(outstanding)::DOUBLE * 100", 4)} AS gnpa_pct,
  100 - {r("coalesce(sum(outstanding) FILTER (WHERE overdue), 0)::DOUBLE / sum(outstanding)::DOUBLE * 100", 4)} AS collection_efficiency_pct,
  {r("coalesce(sum(outstanding) FILTER (WHERE overdue AND security IS NOT NULL), 0)::DOUBLE / sum(outstanding)::DOUBLE * 100", 4)} AS stage_3_pct FROM c_facilities GROUP BY 1"""
CTES["c_portfolio"] = """SELECT *, concat_ws(' | ', CASE WHEN gnpa_pct > 5 THEN 'GNPA above 5%' END, CASE WHEN collection_efficiency_pct < 90 THEN 'Collection efficiency below 90%' END, CASE WHEN stage_3_pct > 5 THEN 'Stage 3 above 5%' END) AS red_flags FROM c_facility_share"""
CTES["c_borrowing"] = f"""
SELECT company_id, total AS total_outstanding, secured, total - secured AS unsecured, {r('near / total * 100', 4)} AS within_1yr_pct, {r('cost / total', 4)} AS weighted_cost_pct, any_overdue,
  concat_ws(' | ', CASE WHEN any_overdue THEN 'Overdue facility' END, CASE WHEN near / total * 100 > 40 THEN 'More than 40% due within one year' END, CASE WHEN secured = 0 THEN 'No security provided' END) AS red_flags
FROM (SELECT company_id, sum(outstanding)::DOUBLE AS total, coalesce(sum(outstanding) FILTER (WHERE security IS NOT NULL), 0)::DOUBLE AS secured, coalesce(sum(outstanding) FILTER (WHERE due_within_1yr), 0)::DOUBLE AS near,
  sum(outstanding * rate_pct)::DOUBLE AS cost, bool_or(overdue) AS any_overdue FROM c_facilities GROUP BY 1) x"""
_scan = "array_to_string(list(COL ORDER BY page_no), chr(10))"
SQL.update({
    "txt_1_revenue": f"SELECT doc_id, {REV} AS revenue_cr FROM c_doc_text",
    "txt_2_unit_values": f"SELECT doc_id, n AS raw_number, u AS unit, {crore('n', 'u')} AS crore FROM (SELECT doc_id, {ex(X.ANY_MONEY)} AS n, {ex(X.ANY_MONEY, 2)} AS u FROM c_doc_text) x WHERE n IS NOT NULL",
    "txt_3_money_series": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pat, i) - 1 AS pos, kind, amount, concat('annual_', i) AS period, CAST(0.72 AS DOUBLE) AS confidence FROM c_money",
    "txt_4_identifiers": "SELECT doc_id, cin, pan FROM c_docfacts",
    "txt_5_company_name": f"SELECT doc_id, {squeeze('coalesce(' + ex(X.NAME_SUFFIX) + ', ' + ex(X.NAME_LABEL) + ')')} AS company_name FROM c_doc_text",
    "txt_6_total_debt": "SELECT doc_id, total_debt FROM c_docfacts",
    "txt_7_rating_facts": f"SELECT doc_id, TRY_CAST({ex(X.CONCENTRATION)} AS DOUBLE) AS concentration_pct, upper({ex(X.RATING_ACTION)}) AS rating_action, upper({ex(X.RATING_GRADE)}) AS rating_grade, {squeeze(ex(X.PARTNER))} AS partner FROM c_doc_text",
    "txt_8_bank_limits": "SELECT *, 'Working Capital' AS facility_type, CAST(0.7 AS DOUBLE) AS confidence FROM c_limits",
    "txt_9_disputes": "SELECT * FROM c_disputes",
    "txt_10_related_parties": "SELECT * FROM c_related",
    "txt_11_auditor_notes": "SELECT * FROM c_auditor",
    "txt_12_collateral": f"""SELECT * FROM ({unnested('list_transform(list_filter(list_transform(list_filter(string_split(' + T + ', chr(10)), lambda s: ' + any_of('lower(s)', X.COLLATERAL_WORDS) + '), lambda s: ' + squeeze('s') + '), lambda s: length(s) > 12), lambda s: s)', 'line')}) w""",
    "txt_13_going_concern": "SELECT doc_id, going_concern FROM c_docfacts",
    "txt_14_confidence": f"""SELECT doc_id, conf AS confidence, needs_review, concat_ws(' | ', CASE WHEN needs_review THEN 'Low extraction confidence (<0.7). Manual credit analyst review required.' END,
  CASE WHEN has_auditor THEN 'CRITICAL: Auditor qualifications present in submitted document.' END, CASE WHEN going_concern THEN 'CRITICAL: Going concern doubt observed in auditor commentary.' END) AS risk_notes FROM ({CTES['c_confidence'].replace('SRC', 'CASE WHEN n_text >= 120 THEN 0.9 ELSE 0.45 END')}) z""",
    "txt_15_holders": "SELECT * FROM c_top_holders",
    "txt_16_holding_facts": "SELECT * FROM c_holding_facts",
    "txt_17_page_text": "SELECT page_id, content FROM c_pagetext",
    "txt_18_declared_fields": "SELECT company_id, CASE WHEN n_rows % 5 <> 0 THEN gross / 100 END AS total_outstanding_cr, CASE WHEN n_rows % 5 <> 0 AND n_rows % 3 > 0 THEN n_rows END AS facility_count, CASE WHEN n_rows % 5 <> 0 THEN 'State Bank' END AS lender, CAST(NULL AS BOOLEAN) AS overdue, CASE WHEN n_rows % 5 = 0 THEN 'parse_failed' END AS error, CASE WHEN n_rows % 5 = 0 THEN concat('Sorry, no data for ', company_id) END AS raw_snippet FROM c_totals",
    "txt_19_liquidity_flags": """SELECT company_id, concat_ws(' | ', CASE WHEN near / total * 100 > 40 THEN 'Short-term borrowing above 40%' END, CASE WHEN gap < 0 THEN 'Negative cumulative gap within 30 days' END) AS red_flags FROM (
  SELECT company_id, (sum(outstanding) FILTER (WHERE due_within_1yr))::DOUBLE AS near, sum(outstanding)::DOUBLE AS total, sum(CASE WHEN overdue THEN outstanding::DOUBLE ELSE -outstanding::DOUBLE / 6 END) AS gap FROM c_facilities GROUP BY 1) x""",
    "txt_20_borrowing_flags": "SELECT * FROM c_borrowing",
    "txt_21_portfolio_flags": "SELECT * FROM c_portfolio",
    "txt_22_page_findings": "SELECT * FROM c_pagefind",
    "txt_23_headlines": "SELECT page_id, headline, source_name FROM c_headline",
    "txt_24_dates": "SELECT company_id, seq, CASE WHEN day(finding_date) <= 24 THEN finding_date END AS parsed_date FROM c_findings",
    "txt_25_note_scores": notes_sql("c_notes", "note"),
    "txt_26_enriched_notes": "SELECT * FROM c_enriched",
    "txt_27_chosen_holding": """SELECT doc_id, CASE WHEN ok THEN CAST(doc_id % 70 AS DOUBLE) ELSE promoter_holding_pct END AS promoter_holding_pct, CASE WHEN ok THEN mc ELSE confidence END AS confidence, NOT ok AS fallback_used
FROM (SELECT *, doc_id % 4 >= 2 OR coalesce(mc >= 0.6, false) AS ok FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS mc FROM c_holding_facts) a) b""",
    "txt_28_chosen_text": f"""SELECT doc_id, CASE WHEN length(native) >= 120 THEN native WHEN length(pair) >= 120 THEN pair ELSE every END AS text, CASE WHEN length(native) >= 120 THEN 'native' WHEN length(pair) >= 120 THEN 'native+tables' ELSE 'ocr' END AS method,
  CAST(CASE WHEN length(native) >= 120 THEN 0.9 WHEN length(pair) >= 120 THEN 0.78 WHEN length(every) = 0 THEN 0.3 WHEN length(every) < 120 THEN least(c, 0.45) ELSE c END AS DOUBLE) AS confidence
FROM (SELECT *, trim(concat(pair, chr(10), ocr)) AS every FROM (SELECT *, trim(concat(native, chr(10), tables)) AS pair FROM (SELECT doc_id, trim({_scan.replace('COL', 'native_text')}) AS native, trim({_scan.replace('COL', 'table_text')}) AS tables, trim({_scan.replace('COL', 'ocr_text')}) AS ocr,
  least(greatest({r('avg(ocr_confidence)', 6)}, 0.35), 0.98) AS c FROM c_scans GROUP BY 1) a) b) d""",
    "txt_29_response_findings": """SELECT page_id, pos, concat('Headline ', page_id) AS headline, url AS summary, CASE WHEN page_id % 2 = 0 THEN 'LITIGATION' ELSE 'INFORMATIONAL' END AS finding_type, CASE WHEN page_id % 4 < 2 THEN 'HIGH' ELSE 'INFORMATIONAL' END AS severity,
  CAST(CASE WHEN page_id % 2 = 0 THEN -3.5 ELSE 0 END AS DOUBLE) AS score_impact, CASE WHEN page_id % 3 = 1 THEN DATE '2024-03-05' ELSE DATE '2023-11-07' END AS source_date, 'model' AS origin
FROM pages CROSS JOIN (SELECT unnest([0, 1])::BIGINT AS pos) g WHERE page_id % 3 <> 0 AND page_id % 7 <> 0
UNION ALL SELECT page_id, pos, headline, summary, finding_type, severity, score_impact, NULL, 'rules' FROM c_pagefind WHERE page_id % 3 = 0 OR page_id % 7 = 0""",
    "txt_30_holding_company": f"""SELECT doc_id, {squeeze("list_filter((" + LINES + "), lambda s: length(s) <= 80 AND " + any_of('lower(s)', ['limited', 'pvt', 'llp']) + ")[1]")} AS company_name FROM c_doc_text""",
    "prj_4_routes": f"""SELECT f.doc_id, f.company_id, f.file_name, effective_type, CASE {" ".join(f"WHEN upper(effective_type) = '{k}' THEN '{v}'" for k, v in I.CLASS_ROUTES.items())}
  WHEN {ends('lower(file_name)', I.TEXT_EXTENSIONS)} THEN 'text' WHEN {ends('lower(file_name)', ['.json', '.xml'])} THEN CASE WHEN contains(lower(file_name), 'gstr') THEN 'tax_return' WHEN contains(lower(file_name), 'itr') THEN 'income_tax_return' ELSE 'unrouted' END
  WHEN {ends('lower(file_name)', I.BOOK_EXTENSIONS)} THEN coalesce({rule('lower(file_name)', I.BOOK_NAME_RULES)}, 'bank_statement') ELSE 'unrouted' END AS route FROM c_files f LEFT JOIN c_effective e ON f.doc_id = e.doc_id""",
    "prj_5_right_company": "SELECT d.doc_id, d.company_id, d.cin FROM c_docfacts d LEFT JOIN c_company c ON d.company_id = c.company_id WHERE d.cin IS NULL OR c.cin IS NULL OR upper(d.cin) = c.cin",
    "prj_6_name_class": f"""SELECT doc_id, file_name, coalesce(hit, 'ANNUAL_REPORT') AS auto_type, CAST(CASE WHEN hit IS NULL THEN 0.4 ELSE 0.92 END AS DOUBLE) AS confidence FROM (SELECT *, {rule("regexp_replace(lower(file_name), '[\\s\\-.]', '_', 'g')", I.NAME_RULES)} AS hit FROM c_files) x""",
    "prj_7_book_type": f"""SELECT f.file_name, coalesce({rule('lower(f.file_name)', I.BOOK_NAME_RULES)}, {rule("coalesce(s.names, '')", I.BOOK_SHEET_RULES)}, 'bank_statement') AS book_type
FROM (SELECT file_name FROM c_files UNION ALL SELECT DISTINCT file_name FROM c_cells) f LEFT JOIN (SELECT file_name, string_agg(DISTINCT lower(sheet), '~') AS names FROM c_cells GROUP BY 1) s ON f.file_name = s.file_name""",
    "prj_8_content_type": "SELECT * FROM c_content",
    "prj_9_effective_class": "SELECT doc_id, auto_type, human_override, effective_type FROM c_effective",
    "prj_18_upload_check": f"""SELECT doc_id, file_name, why IS NULL AS accepted, why AS reject_reason FROM (SELECT *, CASE WHEN NOT (mime_type IN ({", ".join(f"'{m}'" for m in I.ALLOWED_MIME)}) OR {ends('lower(file_name)', I.ALLOWED_EXTENSIONS)}) THEN 'type not allowed' WHEN size_bytes > 52428800 THEN 'too large' END AS why FROM c_files) x""",
    "join_6_listed_documents": "SELECT f.doc_id, f.company_id, f.file_name, auto_type, effective_type, human_approved FROM c_files f LEFT JOIN c_effective e ON f.doc_id = e.doc_id",
    "join_7_not_rejected": "SELECT doc_id, company_id, effective_type, CASE WHEN human_approved THEN 'APPROVED' ELSE 'PENDING' END AS status FROM c_effective WHERE human_approved IS DISTINCT FROM false",
    "agg_9_review_summary": "SELECT company_id, count(*) AS total, count(*) FILTER (WHERE human_approved) AS approved, count(*) FILTER (WHERE human_approved IS NULL) AS pending, count(*) FILTER (WHERE NOT human_approved) AS rejected, count(*) FILTER (WHERE human_approved IS NULL) = 0 AS all_reviewed FROM c_reviews GROUP BY 1",
    "win_1_latest_record": "SELECT company_id, version_id, status, amount FROM c_versions QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, version_id DESC) = 1",
    "win_2_carried_fields": """SELECT company_id, version_id, last_value(nullif(trim(officer_name), '') IGNORE NULLS) OVER w AS officer_name, last_value(nullif(trim(officer_role), '') IGNORE NULLS) OVER w AS officer_role FROM c_versions
WINDOW w AS (PARTITION BY company_id ORDER BY created_at, version_id ROWS UNBOUNDED PRECEDING)""",
    "win_8_ranked_holders": "SELECT doc_id, rank_no, name FROM c_top_holders",
    "fea_3_diligence_block": "SELECT * FROM c_due",
})
