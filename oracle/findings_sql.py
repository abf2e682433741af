from creditloom.operators import findings as N
from oracle import reconcile_sql  # noqa: F401
from oracle.kit import CTES, SQL, any_of, r
from oracle.text_sql import ends

CTES["c_results"] = """SELECT company_id, seq, query, query_type, coalesce(nullif(url, ''), source_url) AS url, coalesce(nullif(description, ''), nullif(snippet, ''), nullif(content, ''), '') AS description,
  coalesce(nullif(markdown, ''), nullif(content, ''), '') AS markdown FROM c_landed WHERE coalesce(nullif(url, ''), source_url) IS NOT NULL"""
_EXC = f"({any_of('lower(url)', N.EXCLUDED_DOMAINS)} OR {ends("split_part(lower(url), '?', 1)", N.BLOCKED_EXTENSIONS)})"
_HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '')"


def _in(domains) -> str:
    return "(" + " OR ".join(f"{_HOST} = '{d}' OR ends_with({_HOST}, '.{d}')" for d in domains) + ")"


_ALLOW = "CASE query_type " + " ".join(f"WHEN '{k}' THEN {_in(v)}" for ks, v in N.ALLOWED for k in ks) + f" ELSE {_in(N.NEWS + N.LEGAL + N.REGISTRY + N.REGULATORS)} END"
CTES["c_usable"] = f"SELECT *, NOT {_EXC} AND {_ALLOW} AS usable FROM c_results"
CTES["c_owners"] = "SELECT company_id, url, min(seq) AS seq, arg_min(query, seq) AS query FROM c_usable WHERE usable GROUP BY 1, 2"
CTES["c_alerts"] = """SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY seq) AS rank_no, seq, 'External Critical Red Flag' AS title, summary, severity, source_name, source_url, true AS advisory_only
FROM c_findings WHERE severity IN ('CRITICAL', 'HIGH') AND finding_type IN ('FRAUD_ALERT', 'LITIGATION', 'REGULATORY', 'REGULATORY_ACTION')"""
_hits = "list_filter([" + ", ".join(f"'{w}'" for w in N.RED_FLAG_WORDS) + "], lambda w: contains(lower(concat(summary, ' ', raw_snippet)), w))"
CTES["c_keyword"] = f"""SELECT company_id, seq, finding_date, 'FRAUD_ALERT' AS finding_type, 'HIGH' AS severity, source_url, concat(source_name, ' (Keyword Classifier)') AS source_name,
  concat('Potential red-flag term(s) detected: ', array_to_string(hits, ', '), '.') AS summary, raw_snippet, {r('least(0.95, confidence + 0.1)', 4)} AS confidence, CAST(-8 AS DOUBLE) AS score_impact
FROM (SELECT *, {_hits} AS hits FROM c_before_alerts) x WHERE len(hits) > 0"""
CTES["c_registry_findings"] = f"""SELECT company_id, CAST(0 AS BIGINT) AS seq, DATE '2025-01-01' AS finding_date, CASE WHEN struck_off IS NULL THEN 'NEUTRAL' ELSE 'FRAUD_ALERT' END AS finding_type, CASE WHEN struck_off IS NULL THEN 'INFORMATIONAL' ELSE 'HIGH' END AS severity,
  '{N.REGISTRY_URL}' AS source_url, 'MCA' AS source_name, CASE WHEN struck_off IS NULL THEN 'MCA records show compliant filing history with no struck-off associations.' ELSE 'Director linkage with struck-off entities detected from MCA records.' END AS summary,
  coalesce(struck_off, concat('Filing compliance score: ', format('{{:.1f}}', compliance_score), '%')) AS raw_snippet, CAST(CASE WHEN struck_off IS NULL THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence, CAST(CASE WHEN struck_off IS NULL THEN 0 ELSE -10 END AS DOUBLE) AS score_impact FROM c_registry"""
CTES["c_sector_findings"] = f"""SELECT company_id, CAST(0 AS BIGINT) AS seq, DATE '2025-01-01' AS finding_date, 'REGULATORY' AS finding_type, CASE WHEN sector = 'real_estate' THEN 'MEDIUM' ELSE 'LOW' END AS severity, '{N.REGULATOR_URL}' AS source_url, 'Regulatory Intel' AS source_name,
  CASE WHEN sector = 'real_estate' THEN 'Sector-level regulatory tightening observed for real-estate debt underwriting.' ELSE 'No direct RBI/SEBI enforcement action found in sampled sources.' END AS summary,
  concat(company_name, ' screened against RBI/SEBI/FSSAI alerts.') AS raw_snippet, CAST(0.68 AS DOUBLE) AS confidence, CAST(CASE WHEN sector = 'real_estate' THEN -5 ELSE -1 END AS DOUBLE) AS score_impact FROM c_company"""
_F = ", ".join(N.FINDING)
_key = "concat_ws('|', " + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in ["company_id", "finding_type", "severity", "source_url", "source_name", "summary", "finding_date", "raw_snippet"]) + ")"
CTES["c_before_alerts"] = " UNION ALL ".join(f"SELECT {_F} FROM {n}" for n in ["c_registry_findings", "c_findings", "c_sector_findings"])
CTES["c_keyword"] = CTES.pop("c_keyword")  # reads the three above
_dedupe = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY company_id, lower(source_url), lower(summary) ORDER BY {1}) = 1"
CTES["c_union"] = " UNION ALL ".join(f"SELECT {_F}, CAST({i} AS BIGINT) AS source_order FROM {n}" for i, n in enumerate(["c_registry_findings", "c_findings", "c_sector_findings", "c_keyword"]))
CTES["c_gathered"] = _dedupe.format("c_union", "source_order, seq")


def summary(source: str) -> str:
    return f"""SELECT company_id, fraud_hits, litigation_count, sector_headwinds, has_nclt, CASE WHEN fraud_hits >= 2 OR has_nclt THEN 'HIGH_RISK' WHEN fraud_hits >= 1 OR litigation_count >= 2 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS research_verdict, total_findings, total_score_impact
FROM (SELECT company_id, count(*) FILTER (WHERE finding_type IN ('FRAUD_ALERT', 'PROMOTER_BACKGROUND')) AS fraud_hits, count(*) FILTER (WHERE finding_type = 'LITIGATION') AS litigation_count,
  bool_or(finding_type IN ('SECTOR', 'SECTOR_NEWS') AND severity IN ('MEDIUM', 'HIGH')) AS sector_headwinds, bool_or(contains(lower(summary), 'nclt')) AS has_nclt, count(*) AS total_findings, {r('sum(CAST(score_impact AS DECIMAL(18,4)))', 1)} AS total_score_impact FROM {source} GROUP BY 1) x"""


CTES["c_summary"] = summary("c_gathered")
CTES["c_narrative"] = f"""
SELECT c.company_id, company_name, coalesce(research_verdict, 'LOW_RISK') AS research_verdict, coalesce(total_findings, 0) AS total_findings, coalesce(total_score_impact, 0) AS total_score_impact,
  concat('Secondary research for ', company_name, ' indicates a ', coalesce(research_verdict, 'LOW_RISK'), ' profile based on ', coalesce(total_findings, 0), ' sourced findings across litigation, regulatory, promoter, and sector intelligence. ',
  CASE WHEN bad IS NOT NULL THEN concat('Key adverse findings: ', bad, '.') ELSE 'No critical enforcement, insolvency, or fraud signal was identified in the reviewed source set.' END, ' ',
  CASE WHEN good IS NOT NULL THEN concat('Offsetting comfort signals: ', good, '.') ELSE 'No strong external positive catalyst was identified to offset adverse intelligence.' END,
  ' Research should be treated as an advisory overlay to credit governance: flagged items require analyst verification, covenant calibration, and tighter post-disbursement monitoring.') AS narrative
FROM c_company c LEFT JOIN ({summary('c_findings')}) s ON c.company_id = s.company_id
LEFT JOIN (SELECT company_id, string_agg(concat('[', severity, '] ', source_name, ': ', summary), ' | ' ORDER BY seq) AS bad FROM (SELECT * FROM c_findings WHERE severity IN ('CRITICAL', 'HIGH')) x GROUP BY 1) a ON c.company_id = a.company_id
LEFT JOIN (SELECT company_id, string_agg(concat(source_name, ': ', summary), ' | ' ORDER BY seq) AS good FROM (SELECT * FROM c_findings WHERE score_impact > 0) x GROUP BY 1) g ON c.company_id = g.company_id"""

# The plan as one row per template, ordered by (block, promoter, line).
_plan = []


def _add(block: int, line: int, t, who: str | None = None, cond: str = "true") -> None:
    text = "'" + t[0].replace("'", "''") + "'"
    for mark, col in {"{c}": "company_name", "{s}": "sector", "{g}": "gstin", "{n}": "cin", "{y}": "'2025'", "{p}": who or "''"}.items():
        text = f"replace({text}, '{mark}', {col})" if mark in t[0] else text
    no = {"promoter_a": 0, "promoter_b": 1}.get(who or "", 0)
    _plan.append(f"SELECT company_id, {block} AS b, {no} AS pn, {line} AS ln, {text} AS query, '{t[1]}' AS query_type, CAST({t[2]} AS BIGINT) AS priority FROM c_company WHERE {cond}" + (f" AND {who} IS NOT NULL" if who else ""))


def _people(block: int, ts) -> None:
    for who in ("promoter_a", "promoter_b"):
        for i, t in enumerate(ts):
            _add(block, i, t, who)


for _i, _t in enumerate(N.FRAUD_SEARCH):
    _add(1, _i, _t)
_people(2, N.PROMOTER_SEARCH)
_add(3, 0, N.TAX_ID_SEARCH, None, "gstin IS NOT NULL")
for _i, _t in enumerate(N.COURT_SEARCH):
    _add(4, _i, _t)
_people(5, [N.COURT_PROMOTER_SEARCH])
_add(6, 0, N.COURT_CIN_SEARCH)
for _i, _t in enumerate(N.REGULATOR_SEARCH):
    _add(7, _i, _t)
for _k, _texts in N.SECTOR_SEARCH.items():
    for _i, _t in enumerate(_texts):
        _add(8, _i, (_t, "SECTOR_NEWS", 3), None, f"sector = '{_k}'")
_add(8, 0, (N.OTHER_SECTOR_SEARCH[0], "SECTOR_NEWS", 3), None, "sector NOT IN (" + ", ".join(f"'{k}'" for k in N.SECTOR_SEARCH) + ")")
for _i, _t in enumerate(N.REGISTRY_SEARCH):
    _add(9, _i, _t)
_add(10, 0, N.REGISTRY_CIN_SEARCH)
_people(11, [N.DIRECTOR_SEARCH])
for _i, _t in enumerate(N.NEWS_SEARCH):
    _add(12, _i, _t)
CTES["c_plan"] = "SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY b, pn, ln) AS seq, query, query_type, priority FROM (" + " UNION ALL ".join(_plan) + ") p"


def side(col: str) -> str:
    return f"(SELECT company_id, coalesce(nullif(url, ''), source_url) AS url, arg_min({col}, seq) AS t FROM {'c_results' if col == 'description' else 'c_landed'} WHERE coalesce({col}, '') <> '' GROUP BY 1, 2)".replace(
        "coalesce(nullif(url, ''), source_url) AS url" if col == "description" else "\0", "url")


SQL.update({
    "prj_10_excluded_sources": f"SELECT company_id, seq, url, {_EXC} AS is_excluded FROM c_results",
    "prj_11_allowed_sources": f"SELECT company_id, seq, url, query_type, {_ALLOW} AS is_allowed FROM c_results",
    "prj_12_alerts": "SELECT * FROM c_alerts",
    "prj_16_normal_findings": """SELECT company_id, seq, CASE WHEN finding_type = 'FRAUD_ALERT' THEN 'FRAUD_ALERT' WHEN finding_type = 'LITIGATION' THEN 'LITIGATION' ELSE 'NEUTRAL' END AS finding_type, severity, CAST(CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 0.82 ELSE 0.72 END AS DOUBLE) AS confidence FROM c_findings""",
    "prj_17_normal_results": "SELECT * FROM c_results",
    "join_8_keyword_alerts": "SELECT * FROM c_keyword",
    "join_11_best_content": f"""SELECT o.company_id, o.url, coalesce(a.t, b.t, d.t) AS content, CASE WHEN a.t IS NOT NULL THEN 'primary' WHEN b.t IS NOT NULL THEN 'secondary' ELSE 'snippet' END AS origin FROM c_owners o
LEFT JOIN {side('markdown')} a ON o.company_id = a.company_id AND o.url = a.url LEFT JOIN {side('content')} b ON o.company_id = b.company_id AND o.url = b.url LEFT JOIN {side('description')} d ON o.company_id = d.company_id AND o.url = d.url WHERE coalesce(a.t, b.t, d.t) IS NOT NULL""",
    "win_3_deduplicated": _dedupe.format("c_findings", "seq"),
    "win_4_distinct_queries": "SELECT company_id, min(seq) AS seq, arg_min(query, seq) AS query FROM c_landed GROUP BY company_id, lower(trim(query))",
    "win_5_url_owners": "SELECT * FROM c_owners",
    "set_1_all_findings": "SELECT * FROM c_gathered",
    "set_2_flag_list": """SELECT company_id, 'anomaly' AS origin, seq, title, details, severity FROM c_anomalies
UNION ALL SELECT company_id, 'indicator', seq, indicator, concat('Source: ', source, ' · confidence ', CAST(round(confidence * 100) AS BIGINT), '%'), severity FROM c_indicators
UNION ALL SELECT company_id, 'research', rank_no, concat('Research Alert: ', title), concat('Advisory only (does not change score). ', summary, ' Source: ', source_name), severity FROM c_alerts""",
    "set_3_search_plan": "SELECT * FROM c_plan",
    "set_5_source_types": "SELECT DISTINCT company_id, finding_type FROM c_findings",
    "agg_8_research_summary": "SELECT * FROM c_summary",
    "agg_15_run_metrics": """SELECT q.company_id, results_landed, queries_executed, coalesce(filtered_out, 0) AS filtered_out, coalesce(urls_selected, 0) AS urls_selected, coalesce(fb, 0) AS findings_returned, coalesce(fd, 0) AS findings_deduplicated
FROM (SELECT company_id, count(*) AS results_landed, count(DISTINCT lower(trim(query))) AS queries_executed FROM c_landed GROUP BY 1) q
LEFT JOIN (SELECT company_id, count(*) FILTER (WHERE NOT usable) AS filtered_out, count(DISTINCT url) FILTER (WHERE usable) AS urls_selected FROM c_usable GROUP BY 1) u ON q.company_id = u.company_id
LEFT JOIN (SELECT company_id, count(*) AS fb, count(DISTINCT concat(lower(source_url), chr(1), lower(summary))) AS fd FROM c_findings GROUP BY 1) f ON q.company_id = f.company_id""",
    "mem_3_narrative": "SELECT * FROM c_narrative",
    "mem_7_registry_findings": "SELECT * FROM c_registry_findings",
    "mem_8_sector_findings": "SELECT * FROM c_sector_findings",
    "top_7_by_severity": """SELECT company_id, urgent, rank_no, seq, severity, source_name, summary, source_url FROM (SELECT *, severity IN ('CRITICAL', 'HIGH') AS urgent,
  row_number() OVER (PARTITION BY company_id, severity IN ('CRITICAL', 'HIGH') ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, seq) AS rank_no FROM c_findings) x WHERE rank_no <= CASE WHEN urgent THEN 6 ELSE 4 END""",
    "top_8_ordered_plan": "SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY priority, seq) AS position, query, query_type, priority FROM c_plan WHERE priority <= 2",
    "top_9_latest_findings": "SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY finding_date DESC, seq DESC) AS rank_no, seq, finding_date, severity, finding_type, summary FROM c_findings QUALIFY rank_no <= 5",
    "src_16_finding_table": f"""SELECT sha256({_key}) AS finding_id, CAST(company_id AS VARCHAR) AS company_id, finding_type, severity, CASE WHEN summary <> '' THEN split_part(summary, '.', 1) ELSE source_name END AS headline,
  summary, source_url, source_name, finding_date AS source_date, raw_snippet AS raw_content, CAST(CASE severity WHEN 'CRITICAL' THEN -20 WHEN 'HIGH' THEN -12 WHEN 'MEDIUM' THEN -6 WHEN 'LOW' THEN -1 ELSE 0 END AS DOUBLE) AS score_impact, 'research_summary' AS cam_section, 'run-1' AS research_job_id
FROM c_findings QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY seq) = 1""",
    "src_17_narrative_table": "SELECT CAST(company_id AS VARCHAR) AS company_id, company_name, 'run-1' AS research_job_id, research_verdict, total_findings, total_score_impact, narrative AS cam_narrative FROM c_narrative",
})
