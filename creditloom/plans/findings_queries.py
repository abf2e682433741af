"""Registered queries over research findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import findings as N
from creditloom.operators import reconcile as R
from creditloom.plans import chain
from creditloom.plans.reconcile_queries import _stored, stamp
from creditloom.sources.tables import Tables

YEAR = 2025


def as_of():
    """Report date; fixed, so results repeat."""
    return F.lit(f"{YEAR}-01-01").cast("date")


def _companies(t: Tables) -> DataFrame:
    return t.company.withColumn("promoters", F.array_compact(F.array("promoter_a", "promoter_b")))


def gathered(t: Tables, columns: list[str] | None = None) -> DataFrame:
    return N.all_findings(t.company, t.registry, t.findings, as_of(), columns)


def summary(t: Tables) -> DataFrame:
    return N.research_summary(gathered(t, N.SUMMED))


def _content_sides(t: Tables, column: str) -> DataFrame:
    rows = N.normal_results(t.landed) if column == "description" else t.landed.withColumn("url", F.coalesce(F.nullif("url", F.lit("")), "source_url"))
    return rows.filter(F.coalesce(column, F.lit("")) != "").groupBy("company_id", "url").agg(F.min_by(column, "seq").alias("text"))


def _plan(t: Tables) -> DataFrame:
    return N.search_plan(_companies(t), YEAR)


QUERIES = {
    "prj_10_excluded_sources": lambda t: N.normal_results(t.landed).select("company_id", "seq", "url", N.is_excluded(F.col("url")).alias("is_excluded")),
    "prj_11_allowed_sources": lambda t: N.normal_results(t.landed).select("company_id", "seq", "url", "query_type", N.is_allowed(F.col("url"), F.col("query_type")).alias("is_allowed")),
    "prj_12_alerts": lambda t: N.alerts(t.findings),
    "prj_16_normal_findings": lambda t: N.normal_findings(t.findings),
    "prj_17_normal_results": lambda t: N.normal_results(t.landed),
    "join_8_keyword_alerts": lambda t: N.keyword_alerts(N.gathered_findings(t.company, t.registry, t.findings, as_of())),
    "join_11_best_content": lambda t: N.best_content(
        N.url_owners(t.landed), _content_sides(t, "markdown"), _content_sides(t, "content"), _content_sides(t, "description")),
    "win_3_deduplicated": lambda t: N.deduplicated(t.findings),
    "win_4_distinct_queries": lambda t: N.distinct_queries(t.landed),
    "win_5_url_owners": lambda t: N.url_owners(t.landed),
    "set_1_all_findings": gathered,
    "set_2_flag_list": lambda t: N.flag_list(
        R.long_list(chain.report(t), "anomalies"), R.long_list(chain.report(t), "indicators"), N.alerts(t.findings)),
    "set_3_search_plan": _plan,
    "set_5_source_types": lambda t: t.findings.select("company_id", "finding_type").distinct(),
    "agg_8_research_summary": summary,
    "agg_15_run_metrics": lambda t: N.run_metrics(t.landed, t.findings),
    "mem_3_narrative": lambda t: N.narrative(t.company, t.findings),
    "mem_7_registry_findings": lambda t: N.registry_findings(t.registry, as_of()),
    "mem_8_sector_findings": lambda t: N.sector_findings(t.company, as_of()),
    "top_7_by_severity": lambda t: N.by_severity(t.findings),
    "top_8_ordered_plan": lambda t: N.ordered_plan(_plan(t), "medium"),
    "top_9_latest_findings": lambda t: N.latest(t.findings),
    "src_16_finding_table": lambda t: _stored(t, N.finding_rows(t.findings, "run-1", stamp()), "research_findings"),
    "src_17_narrative_table": lambda t: _stored(t, N.narrative_rows(N.narrative(t.company, t.findings), "run-1", stamp()), "cam_research"),
}
