"""Registered queries: text jobs, intake, landed responses, due diligence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import round_to
from creditloom.operators import diligence as D
from creditloom.operators import intake as I
from creditloom.operators import payloads as P
from creditloom.operators import textjobs as X
from creditloom.sources.tables import Tables

TEXT = "doc_text"
RESPONSE_FIELDS = [
    {"name": "total_outstanding_cr", "type": "number"}, {"name": "facility_count", "type": "integer"},
    {"name": "lender", "type": "string"}, {"name": "overdue", "type": "boolean"},
]


def _pages(t: Tables) -> DataFrame:
    return t.web_pages.select(
        "page_id", "url", X.page_text(F.col("html")).alias("content"), F.concat(F.lit("query for page "), F.col("page_id").cast("string")).alias("query"))


def _declared(t: Tables) -> DataFrame:
    body = F.to_json(F.struct(
        (F.col("gross") / 100).alias("total_outstanding_cr"), F.when(F.col("n_rows") % 3 > 0, F.col("n_rows")).alias("facility_count"), F.lit("State Bank").alias("lender")))
    text = F.when(F.col("n_rows") % 5 == 0, F.concat(F.lit("Sorry, no data for "), F.col("company_id").cast("string"))).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return P.extract_declared(t.totals.select("company_id", text.alias("response")), RESPONSE_FIELDS)


def _liquidity(t: Tables) -> DataFrame:
    """Near and far maturities per company from its facilities."""
    sums = t.facilities.groupBy("company_id").agg(
        F.sum(F.when(F.col("due_within_1yr"), F.col("outstanding"))).cast("double").alias("near"),
        F.sum("outstanding").cast("double").alias("total"),
        F.sum(F.when(F.col("overdue"), F.col("outstanding")).otherwise(-F.col("outstanding") / 6)).cast("double").alias("gap"))
    body = F.to_json(F.struct(
        (F.col("near") / F.col("total") * 100).alias("short_term_pct"),
        F.array(F.struct(F.lit("15-30 days").alias("bucket"), F.col("gap").alias("cumulative_gap_cr")),
                F.struct(F.lit("1-3yr").alias("bucket"), F.lit(-5.0).alias("cumulative_gap_cr"))).alias("buckets")))
    parsed = F.from_json(body, "short_term_pct double, buckets array<struct<bucket:string,cumulative_gap_cr:double>>")
    return P.liquidity_flags(sums.select("company_id", parsed.alias("p")).select("company_id", "p.*"))


def _portfolio(sums: DataFrame) -> DataFrame:
    return P.portfolio_flags(P.portfolio(sums))


def holding_facts(t: Tables) -> DataFrame:
    return X.holding_facts(t.doc_text)


def _chosen_holding(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    model = t.doc_text.select(
        "doc_id", (k % 4).alias("n_listed"), F.when(k % 10 < 8, (k % 10).cast("double") / 10).alias("confidence"), (k % 70).cast("double").alias("holding_pct"))
    return P.choose_holding(model, X.holding_facts(t.doc_text))


def _responses(t: Tables) -> DataFrame:
    """A response per page: none, one or two findings."""
    k = F.col("page_id")
    one = F.struct(
        F.concat(F.lit("Headline "), k.cast("string")).alias("headline"), F.col("url").alias("summary"),
        F.when(k % 2 == 0, "litigation").otherwise("rumour").alias("finding_type"), F.when(k % 4 < 2, "high").otherwise("odd").alias("severity"),
        F.when(k % 3 == 1, "2024-03-05").otherwise("07/11/2023").alias("source_date"),
        F.when(k % 2 == 0, F.lit(-3.5)).alias("score_impact"), F.lit("research_summary").alias("cam_section"), (k % 7 != 0).alias("is_relevant"))
    body = F.when(k % 3 == 0, F.lit('{"findings": []}')).otherwise(F.to_json(F.struct(F.array(one, one).alias("findings"))))
    return t.raw("pages").select("page_id", F.concat(F.lit("```json"), body, F.lit("```")).alias("response"))


def _any_dates(t: Tables) -> DataFrame:
    m = F.month("finding_date"), F.dayofmonth("finding_date")
    text = (
        F.when(m[1] <= 8, F.date_format("finding_date", "yyyy-MM-dd")).when(m[1] <= 16, F.date_format("finding_date", "dd/MM/yyyy"))
        .when(m[1] <= 24, F.date_format("finding_date", "dd-MM-yyyy")).when(m[1] <= 28, F.lit("null")).otherwise("31/02/2024"))
    return t.findings.select("company_id", "seq", X.any_date(text).alias("parsed_date"))


def _doc_identifiers(t: Tables) -> DataFrame:
    return t.doc_text.select("doc_id", "company_id", X.rlike_first(F.col(TEXT), X.CIN).alias("cin"))


def _book_types(t: Tables) -> DataFrame:
    files = t.files.select("file_name").unionByName(t.cells.select("file_name").distinct())
    return I.book_type(files, t.cells.select("file_name", "sheet").distinct())


QUERIES = {
    "txt_1_revenue": lambda t: X.revenues(t.doc_text),
    "txt_2_unit_values": lambda t: X.unit_values(t.doc_text),
    "txt_3_money_series": lambda t: X.money_rows(t.doc_text),
    "txt_4_identifiers": lambda t: X.identifiers(t.doc_text),
    "txt_5_company_name": lambda t: t.doc_text.select("doc_id", X.company_name(F.col(TEXT)).alias("company_name")),
    "txt_6_total_debt": lambda t: t.doc_text.select("doc_id", X.total_debt(F.col(TEXT)).alias("total_debt")),
    "txt_7_rating_facts": lambda t: X.rating_facts(t.doc_text),
    "txt_8_bank_limits": lambda t: X.bank_limit_rows(t.doc_text),
    "txt_9_disputes": lambda t: X.exploded(t.doc_text, X.disputes(F.col(TEXT)), "title"),
    "txt_10_related_parties": lambda t: X.exploded(t.doc_text, X.related_parties(F.col(TEXT)), "sentence"),
    "txt_11_auditor_notes": lambda t: X.exploded(t.doc_text, X.auditor_notes(F.col(TEXT)), "sentence"),
    "txt_12_collateral": lambda t: X.exploded(t.doc_text, X.collateral_lines(F.col(TEXT)), "line"),
    "txt_13_going_concern": lambda t: t.doc_text.select("doc_id", X.going_concern(F.col(TEXT)).alias("going_concern")),
    "txt_14_confidence": lambda t: X.confidence_rows(t.doc_text),
    "txt_15_holders": lambda t: X.top_holders(t.doc_text),
    "txt_16_holding_facts": holding_facts,
    "txt_17_page_text": lambda t: _pages(t).select("page_id", "content"),
    "txt_18_declared_fields": _declared,
    "txt_19_liquidity_flags": _liquidity,
    "txt_20_borrowing_flags": lambda t: P.borrowing_summary(P.facility_sums(t.facilities)),
    "txt_21_portfolio_flags": lambda t: _portfolio(P.facility_sums(t.facilities)),
    "txt_22_page_findings": lambda t: X.page_findings(_pages(t)),
    "txt_23_headlines": lambda t: _pages(t).select("page_id", X.headline(F.col("content"), F.col("query")).alias("headline"), X.source_name(F.col("url")).alias("source_name")),
    "txt_24_dates": _any_dates,
    "txt_25_note_scores": lambda t: D.score_notes(t.notes),
    "txt_26_enriched_notes": lambda t: D.enriched_note(t.diligence),
    "txt_27_chosen_holding": _chosen_holding,
    "txt_28_chosen_text": lambda t: P.choose_text(t.scans),
    "txt_29_response_findings": lambda t: P.findings_or_rules(P.response_findings(_responses(t), X.any_date), X.page_findings(_pages(t))),
    "txt_30_holding_company": lambda t: t.doc_text.select("doc_id", X.holding_company_name(F.col(TEXT)).alias("company_name")),
    "prj_4_routes": lambda t: I.route(t.files, t.reviews),
    "prj_5_right_company": lambda t: I.right_company(_doc_identifiers(t), t.company),
    "prj_6_name_class": lambda t: I.name_class(t.files),
    "prj_7_book_type": _book_types,
    "prj_8_content_type": lambda t: t.doc_text.select("doc_id", X.content_type(F.col(TEXT)).alias("content_type")),
    "prj_9_effective_class": lambda t: I.effective_class(t.reviews).select("doc_id", "auto_type", "human_override", "effective_type"),
    "prj_18_upload_check": lambda t: I.upload_check(t.files),
    "join_6_listed_documents": lambda t: I.listed_documents(t.files, t.reviews),
    "join_7_not_rejected": lambda t: I.not_rejected(t.reviews),
    "agg_9_review_summary": lambda t: I.review_summary(t.reviews),
    "win_1_latest_record": lambda t: D.latest_record(t.versions, ["created_at", "version_id"], ["version_id", "status", "amount"]),
    "win_2_carried_fields": lambda t: D.carried_fields(t.versions),
    "win_8_ranked_holders": lambda t: X.top_holders(t.doc_text).select("doc_id", "rank_no", "name"),
    "fea_3_diligence_block": lambda t: D.diligence_block(t.company, t.diligence),
}
