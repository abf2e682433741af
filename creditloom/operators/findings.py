"""Research findings: source rules, dedupe, alerts, summaries, the search plan.

A findings table has company_id, seq, finding_date, finding_type, severity, source_url, source_name,
summary, raw_snippet, confidence, score_impact; seq orders the findings of a company.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions.values import ends_with_any, has_any, lookup, present, round_to, severity_rank
from creditloom.operators.ledger import at_most, first_n
from creditloom.operators.payloads import report_type, severity_or_info

# Source lists, red-flag words, impacts, search templates.
EXCLUDED_DOMAINS = [
    "amazon.in", "flipkart.com", "justdial.com", "tradeindia.com", "indiamart.com", "instagram.com", "facebook.com", "x.com", "twitter.com", "youtube.com",
]
BLOCKED_EXTENSIONS = [
    ".zip", ".rar", ".7z", ".tar", ".gz", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".mp3", ".mp4", ".avi", ".mov",
]
NEWS = ["economictimes.indiatimes.com", "thehindu.com", "business-standard.com", "livemint.com", "moneycontrol.com", "reuters.com"]
LEGAL, REGISTRY, REGULATORS = ["ecourts.gov.in"], ["mca.gov.in"], ["rbi.org.in", "sebi.gov.in", "fssai.gov.in"]
ALLOWED = [
    (["LITIGATION"], LEGAL), (["MCA_FILING"], REGISTRY), (["REGULATORY_ACTION"], REGULATORS),
    (["SECTOR_NEWS", "COMPANY_NEWS", "FRAUD_ALERT", "PROMOTER_BACKGROUND"], NEWS),
]
RED_FLAG_WORDS = [
    "benami", "hawala", "round-tripping", "shell company", "struck off", "cirp", "liquidation", "attachment order",
    "lookout notice", "money laundering", "pmla",
]
ALERT_TYPES = ["FRAUD_ALERT", "LITIGATION", "REGULATORY", "REGULATORY_ACTION"]
SEVERITY_IMPACT = {"CRITICAL": -20.0, "HIGH": -12.0, "MEDIUM": -6.0, "LOW": -1.0, "INFORMATIONAL": 0.0}
FRAUD_SEARCH = [
    ('"{c}" fraud OR scam OR default OR NPA OR insolvency', "FRAUD_ALERT", 1),
    ('"{c}" ED raid OR CBI OR SFIO OR income tax raid', "FRAUD_ALERT", 1),
    ('"{c}" GST fraud OR fake invoice OR circular trading', "FRAUD_ALERT", 1),
]
PROMOTER_SEARCH = [
    ('"{p}" fraud OR arrest OR ED OR CBI OR chargesheet', "PROMOTER_BACKGROUND", 1),
    ('"{p}" income tax raid OR benami OR PMLA', "PROMOTER_BACKGROUND", 2),
]
TAX_ID_SEARCH = ('"{g}" GSTIN fake invoice OR ITC fraud', "FRAUD_ALERT", 1)
COURT_SEARCH = [
    ('site:ecourts.gov.in "{c}" NCLT OR CIRP OR insolvency OR liquidation', "LITIGATION", 1),
    ('site:ecourts.gov.in "{c}" DRT OR debt recovery tribunal OR SARFAESI', "LITIGATION", 1),
    ('site:ecourts.gov.in "{c}"', "LITIGATION", 1),
    ('site:ecourts.gov.in "{c}" court case OR legal notice OR arbitration', "LITIGATION", 2),
]
COURT_PROMOTER_SEARCH = ('site:ecourts.gov.in "{p}" court case OR FIR OR conviction', "LITIGATION", 2)
COURT_CIN_SEARCH = ('site:ecourts.gov.in "{n}" NCLT OR winding up', "LITIGATION", 2)
REGULATOR_SEARCH = [
    ('"{c}" RBI OR SEBI OR FSSAI OR regulatory notice', "REGULATORY_ACTION", 2),
    ('"{c}" blacklisted OR debarred OR licence cancelled', "REGULATORY_ACTION", 1),
]
SECTOR_SEARCH = {
    "agri_processing": [
        "India agri processing sector outlook {y}", "MSP policy impact agri processing India {y}", "FSSAI compliance updates food processing India {y}",
    ],
    "nbfc": ["RBI NBFC regulation update {y}", "NBFC asset quality stress India {y}"],
    "real_estate": ["India real estate debt outlook {y}", "RERA enforcement actions India {y}"],
    "textile": ["India textile margins export outlook {y}", "cotton price volatility India textile {y}"],
}
OTHER_SECTOR_SEARCH = ["{s} India outlook {y} regulation"]
REGISTRY_SEARCH = [
    ('site:mca.gov.in "{c}"', "MCA_FILING", 1),
    ('site:mca.gov.in "{c}" struck off OR dormant OR ROC notice', "MCA_FILING", 1),
]
REGISTRY_CIN_SEARCH = ('site:mca.gov.in "{n}" MCA master data OR charges', "MCA_FILING", 1)
DIRECTOR_SEARCH = ('site:mca.gov.in "{p}" DIN MCA disqualified director', "MCA_FILING", 2)
NEWS_SEARCH = [('"{c}" latest news {y}', "COMPANY_NEWS", 3), ('"{s}" India growth outlook {y}', "SECTOR_NEWS", 3)]
DEPTH = {"shallow": 1, "medium": 2, "deep": 3}
REGISTRY_URL = "https://www.mca.gov.in/content/mca/global/en/mca/master-data.html"
REGULATOR_URL = "https://www.rbi.org.in/"
KEY_FIELDS = ["company_id", "finding_type", "severity", "source_url", "source_name", "summary", "finding_date", "raw_snippet"]
SUMMED = ["company_id", "finding_type", "severity", "summary", "score_impact"]
FINDING = ["company_id", "seq", "finding_date", "finding_type", "severity", "source_url", "source_name", "summary", "raw_snippet", "confidence", "score_impact"]


def normal_results(landed: DataFrame) -> DataFrame:
    """One shape for search results of any provider; results without a url go."""
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    url = first("url", "source_url")
    return landed.filter(url.isNotNull()).select(
        "company_id", "seq", "query", "query_type", url.alias("url"),
        F.coalesce(first("description", "snippet", "content"), F.lit("")).alias("description"),
        F.coalesce(first("markdown", "content"), F.lit("")).alias("markdown"))


def is_excluded(url: Column) -> Column:
    low = F.lower(url)
    return has_any(low, EXCLUDED_DOMAINS) | ends_with_any(F.split(low, r"\?")[0], BLOCKED_EXTENSIONS)


def is_allowed(url: Column, query_type: Column) -> Column:
    """Host equals or lies below a domain listed for the query type; other types may use every list."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    within = lambda domains: host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in domains) + r")\z")
    listed = [F.when(F.upper(query_type).isin(kinds), within(domains)) for kinds, domains in ALLOWED]
    return F.coalesce(*listed, within(NEWS + LEGAL + REGISTRY + REGULATORS))


def usable_results(landed: DataFrame) -> DataFrame:
    return normal_results(landed).withColumn("usable", ~is_excluded(F.col("url")) & is_allowed(F.col("url"), F.col("query_type")))


def distinct_queries(landed: DataFrame, cap: int | None = None) -> DataFrame:
    """First spelling of each query per company."""
    firsts = landed.groupBy("company_id", F.lower(F.trim("query")).alias("query_key")).agg(F.min("seq").alias("seq"), F.min_by("query", "seq").alias("query"))
    return at_most(firsts, ["company_id"], [F.col("seq")], cap).select("company_id", "seq", "query")


def url_owners(landed: DataFrame, cap: int | None = None) -> DataFrame:
    """The first query that reached a url owns it."""
    owners = usable_results(landed).filter("usable").groupBy("company_id", "url").agg(F.min("seq").alias("seq"), F.min_by("query", "seq").alias("query"))
    return at_most(owners, ["company_id"], [F.col("seq")], cap).select("company_id", "url", "seq", "query")


def best_content(owners: DataFrame, primary: DataFrame, secondary: DataFrame, snippets: DataFrame) -> DataFrame:
    """Primary scrape, else secondary, else the search snippet. Sides are (company_id, url, text)."""
    keys = ["company_id", "url"]
    named = lambda df, n: df.select(*keys, F.nullif(F.trim("text"), F.lit("")).alias(n))
    joined = owners.select(*keys)
    for df, n in ((primary, "a"), (secondary, "b"), (snippets, "c")):
        joined = joined.join(named(df, n), keys, "left")
    content = F.coalesce("a", "b", "c")
    return joined.filter(content.isNotNull()).select(
        *keys, content.alias("content"), F.when(F.col("a").isNotNull(), "primary").when(F.col("b").isNotNull(), "secondary").otherwise("snippet").alias("origin"))


def normal_findings(findings: DataFrame) -> DataFrame:
    """Report types and severities, with the confidence they imply."""
    severity = severity_or_info(F.col("severity"))
    return findings.select(
        "company_id", "seq", report_type(F.col("finding_type")).alias("finding_type"), severity.alias("severity"),
        F.when(severity.isin("CRITICAL", "HIGH"), 0.82).otherwise(0.72).alias("confidence"))


def deduplicated(findings: DataFrame, order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """First finding per company, url and summary, in any case; `columns` are those wanted of it, all by default. Copies fold before the shuffle."""
    at = F.struct(*(order or ["seq"]))
    rest = [c for c in columns or findings.columns if c != "company_id"]
    key = F.lower
    return (
        findings.groupBy("company_id", key("source_url").alias("url_key"), key("summary").alias("summary_key"))
        .agg(F.min_by(F.struct(*rest), at).alias("f"))
        .select("company_id", "f.*")
    )


def alerts(findings: DataFrame, cap: int | None = None) -> DataFrame:
    hits = findings.filter(F.col("severity").isin("CRITICAL", "HIGH") & F.col("finding_type").isin(ALERT_TYPES))
    return first_n(hits, ["company_id"], [F.col("seq")], cap).select(
        "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "seq",
        F.lit("External Critical Red Flag").alias("title"), "summary", "severity", "source_name", "source_url", F.lit(True).alias("advisory_only"))


def keyword_alerts(findings: DataFrame, cap: int | None = None) -> DataFrame:
    """One alert per finding that holds a red-flag word."""
    low = F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("raw_snippet", F.lit(""))))
    # One pattern picks the findings; the words are looked up one by one in those only.
    some = low.rlike("|".join(re.escape(w) for w in RED_FLAG_WORDS))
    hits = present([(F.contains("low", F.lit(w)), F.lit(w)) for w in RED_FLAG_WORDS])
    scanned = findings.filter(some).withColumn("low", low).withColumn("hits", hits)
    return at_most(scanned, ["company_id"], [F.col("seq")], cap).select(
        "company_id", "seq", "finding_date", F.lit("FRAUD_ALERT").alias("finding_type"), F.lit("HIGH").alias("severity"), "source_url",
        F.concat(F.col("source_name"), F.lit(" (Keyword Classifier)")).alias("source_name"),
        F.concat(F.lit("Potential red-flag term(s) detected: "), F.array_join("hits", ", "), F.lit(".")).alias("summary"),
        "raw_snippet",
        round_to(F.least(F.lit(0.95), F.col("confidence") + 0.1), 4).alias("confidence"), F.lit(-8.0).alias("score_impact"))


def registry_findings(registry: DataFrame, as_of: Column) -> DataFrame:
    """One registry finding per company: struck-off links or a clean record."""
    linked = F.col("struck_off").isNotNull()
    return registry.select(
        "company_id", F.lit(0).cast("bigint").alias("seq"), as_of.alias("finding_date"),
        F.when(linked, "FRAUD_ALERT").otherwise("NEUTRAL").alias("finding_type"), F.when(linked, "HIGH").otherwise("INFORMATIONAL").alias("severity"),
        F.lit(REGISTRY_URL).alias("source_url"), F.lit("MCA").alias("source_name"),
        F.when(linked, "Director linkage with struck-off entities detected from MCA records.")
        .otherwise("MCA records show compliant filing history with no struck-off associations.").alias("summary"),
        F.when(linked, F.col("struck_off")).otherwise(
            F.concat(F.lit("Filing compliance score: "), F.format_string("%.1f", round_to("compliance_score", 1)), F.lit("%"))).alias("raw_snippet"),
        F.when(linked, 0.9).otherwise(0.75).alias("confidence"), F.when(linked, -10.0).otherwise(0.0).alias("score_impact"))


def sector_findings(companies: DataFrame, as_of: Column) -> DataFrame:
    """One regulatory context finding per company, harder for real estate."""
    hard = F.contains(F.lower("sector"), F.lit("real_estate"))
    return companies.select(
        "company_id", F.lit(0).cast("bigint").alias("seq"), as_of.alias("finding_date"), F.lit("REGULATORY").alias("finding_type"),
        F.when(hard, "MEDIUM").otherwise("LOW").alias("severity"), F.lit(REGULATOR_URL).alias("source_url"), F.lit("Regulatory Intel").alias("source_name"),
        F.when(hard, "Sector-level regulatory tightening observed for real-estate debt underwriting.")
        .otherwise("No direct RBI/SEBI enforcement action found in sampled sources.").alias("summary"),
        F.concat(F.col("company_name"), F.lit(" screened against RBI/SEBI/FSSAI alerts.")).alias("raw_snippet"),
        F.lit(0.68).alias("confidence"), F.when(hard, -5.0).otherwise(-1.0).alias("score_impact"))


def gathered_findings(companies: DataFrame, registry: DataFrame, web: DataFrame, as_of: Column) -> DataFrame:
    """Registry, web and regulatory findings with the place of their source; what the keyword scan reads."""
    union = None
    for i, part in enumerate([registry_findings(registry, as_of), web, sector_findings(companies, as_of)]):
        tagged = part.select(*FINDING).withColumn("source_order", F.lit(i).cast("bigint"))
        union = tagged if union is None else union.unionByName(tagged)
    return union


def all_findings(companies: DataFrame, registry: DataFrame, web: DataFrame, as_of: Column, columns: list[str] | None = None) -> DataFrame:
    """Union of the sources in their order, without repeats: registry, web, regulatory, keyword alerts."""
    found = gathered_findings(companies, registry, web, as_of)
    alerts_found = keyword_alerts(found).select(*FINDING).withColumn("source_order", F.lit(3).cast("bigint"))
    return deduplicated(found.unionByName(alerts_found), ["source_order", "seq"], columns)


def research_summary(findings: DataFrame) -> DataFrame:
    kind, low = F.col("finding_type"), F.lower("summary")
    hits = F.count_if(kind.isin("FRAUD_ALERT", "PROMOTER_BACKGROUND"))
    suits = F.count_if(kind == "LITIGATION")
    nclt = F.coalesce(F.bool_or(F.contains(low, F.lit("nclt"))), F.lit(False))
    return findings.groupBy("company_id").agg(
        hits.alias("fraud_hits"), suits.alias("litigation_count"),
        F.bool_or(kind.isin("SECTOR", "SECTOR_NEWS") & F.col("severity").isin("MEDIUM", "HIGH")).alias("sector_headwinds"),
        nclt.alias("has_nclt"),
        F.when((hits >= 2) | nclt, "HIGH_RISK").when((hits >= 1) | (suits >= 2), "MEDIUM_RISK").otherwise("LOW_RISK").alias("research_verdict"),
        F.count("*").alias("total_findings"),
        round_to(F.sum(F.col("score_impact").cast("decimal(18,4)")).cast("double"), 1).alias("total_score_impact"))


def by_severity(findings: DataFrame, urgent: int = 6, other: int = 4) -> DataFrame:
    """Most severe first; so many urgent ones and so many others per company."""
    is_urgent = F.col("severity").isin("CRITICAL", "HIGH")
    ranked = first_n(findings.withColumn("urgent", is_urgent), ["company_id", "urgent"], [severity_rank(F.col("severity")), F.col("seq")], max(urgent, other))
    return ranked.filter(F.col("rank_no") <= F.when(F.col("urgent"), urgent).otherwise(other)).select(
        "company_id", "urgent", F.col("rank_no").cast("bigint").alias("rank_no"), "seq", "severity", "source_name", "summary", "source_url")


def latest(findings: DataFrame, n: int = 5) -> DataFrame:
    return first_n(findings, ["company_id"], [F.col("finding_date").desc(), F.col("seq").desc()], n).select(
        "company_id", F.col("rank_no").cast("bigint").alias("rank_no"), "seq", "finding_date", "severity", "finding_type", "summary")


def narrative(companies: DataFrame, findings: DataFrame) -> DataFrame:
    """Deterministic research paragraph: count, adverse and positive findings, closing."""
    adverse = first_n(findings.filter(F.col("severity").isin("CRITICAL", "HIGH")), ["company_id"], [F.col("seq")], None)
    good = first_n(findings.filter(F.col("score_impact") > 0), ["company_id"], [F.col("seq")], None)
    said = F.concat(F.col("source_name"), F.lit(": "), F.coalesce("summary", F.lit("N/A")))
    joined = lambda df, line: df.groupBy("company_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", line.alias("line")))), lambda s: s["line"]), " | ").alias("lines"))
    a = joined(adverse, F.concat(F.lit("["), F.col("severity"), F.lit("] "), said)).withColumnRenamed("lines", "bad")
    g = joined(good, said).withColumnRenamed("lines", "good")
    s = research_summary(findings).select("company_id", "research_verdict", "total_findings", "total_score_impact")
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Secondary research for "), F.col("company_name"), F.lit(" indicates a "), F.coalesce("research_verdict", F.lit("LOW_RISK")),
                 F.lit(" profile based on "), F.coalesce("total_findings", F.lit(0)).cast("string"),
                 F.lit(" sourced findings across litigation, regulatory, promoter, and sector intelligence.")),
        F.when(F.col("bad").isNotNull(), F.concat(F.lit("Key adverse findings: "), F.col("bad"), F.lit(".")))
        .otherwise("No critical enforcement, insolvency, or fraud signal was identified in the reviewed source set."),
        F.when(F.col("good").isNotNull(), F.concat(F.lit("Offsetting comfort signals: "), F.col("good"), F.lit(".")))
        .otherwise("No strong external positive catalyst was identified to offset adverse intelligence."),
        F.lit("Research should be treated as an advisory overlay to credit governance: flagged items require analyst verification, "
              "covenant calibration, and tighter post-disbursement monitoring."))
    return (
        companies.select("company_id", "company_name").join(s, "company_id", "left").join(a, "company_id", "left").join(g, "company_id", "left")
        .select("company_id", "company_name", F.coalesce("research_verdict", F.lit("LOW_RISK")).alias("research_verdict"),
                F.coalesce("total_findings", F.lit(0)).alias("total_findings"), F.coalesce("total_score_impact", F.lit(0.0)).alias("total_score_impact"), text.alias("narrative"))
    )


def finding_rows(findings: DataFrame, job_id: str, ingested_at: Column) -> DataFrame:
    """Lake rows keyed by a hash of their content, so a second run replaces and does not repeat."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in KEY_FIELDS]
    key = F.sha2(F.concat_ws("|", *marked), 256)
    rest = [c for c in findings.columns if c != "company_id"]
    unique = findings.groupBy("company_id", key.alias("finding_id")).agg(F.min_by(F.struct(*rest), "seq").alias("f")).select("company_id", "finding_id", "f.*")
    head = F.split("summary", r"\.")[0]
    return unique.select(
        "finding_id", F.col("company_id").cast("string").alias("company_id"), "finding_type", "severity",
        F.when(F.coalesce("summary", F.lit("")) != "", head).otherwise(F.col("source_name")).alias("headline"), "summary", "source_url", "source_name",
        F.col("finding_date").alias("source_date"), F.coalesce("raw_snippet", F.lit("")).alias("raw_content"),
        lookup(SEVERITY_IMPACT, F.upper("severity"), 0.0).alias("score_impact"), F.lit("research_summary").alias("cam_section"),
        F.lit(job_id).alias("research_job_id"), ingested_at.alias("ingested_at"))


def narrative_rows(narratives: DataFrame, job_id: str, generated_at: Column) -> DataFrame:
    return narratives.select(
        F.col("company_id").cast("string").alias("company_id"), "company_name", F.lit(job_id).alias("research_job_id"), "research_verdict",
        "total_findings", "total_score_impact", F.col("narrative").alias("cam_narrative"), generated_at.alias("generated_at"))


def run_metrics(landed: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts along one research run per company."""
    queries = landed.groupBy("company_id", F.lower(F.trim("query")).alias("k")).agg(F.count("*").alias("n")).groupBy("company_id").agg(
        F.sum("n").alias("results_landed"), F.count("*").alias("queries_executed"))
    results = usable_results(landed)
    dropped = results.groupBy("company_id").agg(F.count_if(~F.col("usable")).alias("filtered_out"))
    urls = results.filter("usable").select("company_id", "url").distinct().groupBy("company_id").agg(F.count("*").alias("urls_selected"))
    found = findings.groupBy("company_id").agg(F.count("*").alias("findings_returned"))
    kept = deduplicated(findings).groupBy("company_id").agg(F.count("*").alias("findings_deduplicated"))
    out = queries
    for side in (dropped, urls, found, kept):
        out = out.join(side, "company_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "company_id", n("results_landed"), n("queries_executed"), n("filtered_out"), n("urls_selected"), n("findings_returned"), n("findings_deduplicated"))


def _filled(template: str, year: int, promoter: Column | None = None) -> Column:
    sides = {"{c}": F.col("company_name"), "{s}": F.col("sector"), "{g}": F.col("gstin"), "{n}": F.col("cin"), "{y}": F.lit(str(year))}
    if promoter is not None:
        sides["{p}"] = promoter
    out: Column = F.lit(template)
    for mark, value in sides.items():
        if mark in template:
            out = F.replace(out, F.lit(mark), value)
    return out


def search_plan(companies: DataFrame, year: int) -> DataFrame:
    """All searches per company in their order. `companies` has promoters: array<string>."""
    entry = lambda t, who=None: F.struct(_filled(t[0], year, who).alias("query"), F.lit(t[1]).alias("query_type"), F.lit(t[2]).alias("priority"))
    fixed = lambda ts: F.array(*[entry(t) for t in ts])
    none = F.slice(fixed(FRAUD_SEARCH), 1, 0)
    people = lambda ts: F.flatten(F.transform("promoters", lambda p: F.array(*[entry(t, p) for t in ts])))
    given = lambda c, t: F.when(F.coalesce(F.col(c), F.lit("")) != "", fixed([t])).otherwise(none)
    sector = lambda texts: fixed([(x, "SECTOR_NEWS", 3) for x in texts])
    key = F.replace(F.lower("sector"), F.lit(" "), F.lit("_"))
    by_sector = F.coalesce(*[F.when(key == k, sector(v)) for k, v in SECTOR_SEARCH.items()], sector(OTHER_SECTOR_SEARCH))
    plan = F.concat(
        fixed(FRAUD_SEARCH), people(PROMOTER_SEARCH), given("gstin", TAX_ID_SEARCH),
        fixed(COURT_SEARCH), people([COURT_PROMOTER_SEARCH]), given("cin", COURT_CIN_SEARCH),
        fixed(REGULATOR_SEARCH), by_sector,
        fixed(REGISTRY_SEARCH), given("cin", REGISTRY_CIN_SEARCH), people([DIRECTOR_SEARCH]), fixed(NEWS_SEARCH))
    return companies.select("company_id", F.posexplode(plan).alias("pos", "q")).select(
        "company_id", (F.col("pos") + 1).cast("bigint").alias("seq"), "q.query", "q.query_type", F.col("q.priority").cast("bigint").alias("priority"))


def ordered_plan(plan: DataFrame, depth: str = "deep") -> DataFrame:
    """Searches up to the depth's priority, most important first, otherwise in plan order."""
    limit = DEPTH.get(depth.lower(), 3)
    position = F.row_number().over(Window.partitionBy("company_id").orderBy("priority", "seq")).cast("bigint")
    return plan.filter(F.col("priority") <= limit).select("company_id", position.alias("position"), "query", "query_type", "priority")


def flag_list(anomalies: DataFrame, indicators: DataFrame, research_alerts: DataFrame) -> DataFrame:
    """Anomalies, fraud indicators and research alerts in one shape."""
    percent = round_to(F.col("confidence") * 100, 0).cast("bigint").cast("string")
    a = anomalies.select("company_id", F.lit("anomaly").alias("origin"), "seq", "title", "details", "severity")
    b = indicators.select(
        "company_id", F.lit("indicator").alias("origin"), "seq", F.col("indicator").alias("title"),
        F.concat(F.lit("Source: "), F.col("source"), F.lit(" · confidence "), percent, F.lit("%")).alias("details"), "severity")
    c = research_alerts.select(
        "company_id", F.lit("research").alias("origin"), F.col("rank_no").alias("seq"), F.concat(F.lit("Research Alert: "), F.col("title")).alias("title"),
        F.concat(F.lit("Advisory only (does not change score). "), F.col("summary"), F.lit(" Source: "), F.col("source_name")).alias("details"), "severity")
    return a.unionByName(b).unionByName(c)


