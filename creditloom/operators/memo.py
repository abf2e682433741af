"""Content tables of the credit memo: merged facts, SWOT, risk matrix, covenants, profile and metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.values import crore_text, percent_text, present, ratio_text, round_to

# Texts and limits of the memo.
INVESTMENT_GRADES = ["AAA", "AA+", "AA", "AA-", "A+", "A"]
COVENANTS = [
    "Monthly stock and receivable statements to lender.",
    "Quarterly GST vs banking reconciliation with management certification.",
    "DSCR floor covenant at 1.20x; breach to trigger corrective action plan.",
]
VALIDITY_DAYS = 30
LIST_FIELDS = ["related_parties", "collateral", "disputes", "auditor_notes"]


def document_rank(facts: DataFrame) -> Column:
    """Order in which a company's documents are believed: class, then larger revenue, then id."""
    kind = F.when(F.col("content_type") == "ANNUAL_REPORT", 0).when(F.col("content_type") == "FINANCIAL_STATEMENT", 1).otherwise(2)
    return F.struct(kind.alias("kind"), (-F.coalesce("revenue_cr", F.lit(0.0))).alias("less_revenue"), F.col("doc_id").alias("doc_id"))


def merged_scalars(facts: DataFrame, figures: DataFrame) -> DataFrame:
    """First non-empty value per field over the company's documents; workbook numbers override all but revenue."""
    at = document_rank(facts)
    number = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, at)).alias(c)
    text = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", at)).alias(c)
    docs = facts.groupBy("company_id").agg(
        text("cin"), text("pan"), number("revenue_cr"), number("total_debt"),
        F.bool_or("going_concern").alias("going_concern"), F.count("*").alias("n_documents"))
    book = figures.select("company_id", F.nullif("revenue", F.lit(0.0)).alias("book_revenue"), F.nullif("total_debt", F.lit(0.0)).alias("book_debt"))
    return docs.join(book, "company_id", "full").select(
        "company_id", "cin", "pan", F.coalesce("revenue_cr", "book_revenue").alias("revenue_cr"), F.coalesce("book_debt", "total_debt").alias("total_debt"),
        F.coalesce("going_concern", F.lit(False)).alias("going_concern"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def merged_lists(facts: DataFrame) -> DataFrame:
    """Distinct list entries per company in document order, one row per entry.

    Kept long: a company's list may be as long as its documents are many.
    """
    long = None
    for name in LIST_FIELDS:
        part = facts.select("company_id", F.lit(name).alias("list_name"), document_rank(facts).alias("rank"), F.posexplode(name).alias("pos", "item"))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("company_id", "list_name", "item").agg(F.min(F.struct("rank", "pos")).alias("at")).select(
        "company_id", "list_name", "item", F.col("at.rank.doc_id").alias("first_doc_id"), F.col("at.pos").cast("bigint").alias("first_pos"))


def swot_input(blocks: DataFrame) -> DataFrame:
    """The row the SWOT rules read; growth in percent, an unknown pledge stays unknown."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return blocks.select(
        "company_id", "company_name", F.col("promoter_pledge_pct").alias("pledge"), F.coalesce("rating_action", F.lit("")).alias("rating_action"),
        F.coalesce("rating_grade", F.lit("")).alias("rating"), zero("ebitda_margin").alias("ebitda_margin"), zero("interest_coverage").alias("interest_coverage"),
        F.col("debt_equity_ratio").alias("de_ratio"), round_to(zero("revenue_cagr_3yr") * 100, 4).alias("cagr_pct"),
        F.coalesce("itc_gap_pct", F.lit(100.0)).alias("gst_mismatch"), zero("concentration_pct").alias("concentration"), zero("current_ratio").alias("current_ratio"),
        round_to(F.coalesce(F.try_divide("profit_after_tax", "revenue"), F.lit(0.0)) * 100, 4).alias("pat_margin"),
        F.lit(0.0).alias("loi_cr"), F.lit(0.0).alias("export_growth"), F.lit(0.0).alias("expansion_irr"), F.coalesce("partner", F.lit("")).alias("partner"),
        zero("contingent").alias("litigation_cr"), F.coalesce(F.nullif("net_worth", F.lit(0.0)), F.lit(1.0)).alias("net_worth"),
        F.coalesce("sector_headwinds", F.lit(False)).alias("commodity_risk"), F.lit(False).alias("parent_risk"))


def swot(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Four lists and a thesis per company. `decisions`: company_id, risk_grade, normalized_score."""
    c = F.col
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    score = round_to("normalized_score", 0).cast("bigint").cast("string")
    upgraded = (c("rating_action") == "UPGRADED") & (c("rating") != "")
    big_suit = c("litigation_cr") > c("net_worth") * 0.5
    strengths = present([
        (c("pledge") == 0, F.lit("Zero promoter pledge - shares fully unencumbered")),
        ((c("pledge") > 0) & (c("pledge") <= 20), say("Low promoter pledge at ", percent_text(c("pledge")))),
        (upgraded, say("Credit rating upgraded to ", c("rating"), " - improving profile")),
        (~upgraded & c("rating").isin(INVESTMENT_GRADES), say("Investment grade rating: ", c("rating"))),
        (c("ebitda_margin") > 20, say("Strong EBITDA margin of ", percent_text(c("ebitda_margin")), " (sector benchmark ~15%)")),
        (c("interest_coverage") > 5, say("Comfortable interest coverage of ", ratio_text(c("interest_coverage"), 1))),
        (c("de_ratio") < 0.5, say("Conservative leverage at D/E ", ratio_text(c("de_ratio")))),
        (c("cagr_pct") > 12, say("Revenue CAGR of ", percent_text(c("cagr_pct")), " over 3 years")),
        (c("gst_mismatch") == 0, F.lit("GST reconciliation clean - 0% mismatch, no circular trading")),
    ])
    weaknesses = present([
        (c("concentration") > 50, say("Customer concentration risk - top 5 = ", percent_text(c("concentration")), " of revenue")),
        (c("de_ratio") > 1.5, say("Elevated leverage at D/E ", ratio_text(c("de_ratio")))),
        ((c("current_ratio") > 1.0) & (c("current_ratio") < 1.3), say("Tight current ratio of ", ratio_text(c("current_ratio")))),
        ((c("pat_margin") > 0) & (c("pat_margin") < 7), say("Thin PAT margin of ", percent_text(c("pat_margin")))),
    ])
    opportunities = present([
        (c("loi_cr") > 0, say("EV component LoIs worth ", crore_text(c("loi_cr")), " secured from OEMs")),
        (c("export_growth") > 15, say("Export revenues growing ", percent_text(c("export_growth")), " - international expansion")),
        (c("expansion_irr") > 15, say("Approved capacity expansion with IRR of ", percent_text(c("expansion_irr")))),
        (c("partner") != "", say("Strategic partnership discussions with ", c("partner"))),
    ])
    threats = present([
        (big_suit, say("Litigation exposure ", crore_text(c("litigation_cr")), " = ", ratio_text(c("litigation_cr") / c("net_worth"), 1), " net worth")),
        (~big_suit & (c("litigation_cr") > 0), say("Contingent liabilities of ", crore_text(c("litigation_cr")), " under appeal")),
        (c("commodity_risk"), F.lit("Input cost volatility from commodity price movements")),
        (c("pledge") > 75, say("Promoter pledge ", percent_text(c("pledge")), " - forced selling risk if share price falls")),
        (c("parent_risk"), F.lit("Parent company debt obligations may require dividend upstreaming")),
    ])
    or_one = lambda items, text: F.when(F.size(items) == 0, F.array(text)).otherwise(items)
    thesis = say(
        c("company_name"), " is rated ", c("risk_grade"), " with a credit score of ", score, "/100. ",
        F.when(c("normalized_score") >= 75, "Strong fundamentals support full approval.").otherwise("Conditional approval recommended with covenants."))
    return rows.join(decisions.select("company_id", "risk_grade", "normalized_score"), "company_id").select(
        "company_id",
        or_one(strengths, say("Score of ", score, "/100 indicates acceptable credit quality")).alias("strengths"),
        or_one(weaknesses, F.lit("No material weaknesses identified from available documents")).alias("weaknesses"),
        or_one(opportunities, F.lit("Sector growth trajectory supports future revenue expansion")).alias("opportunities"),
        or_one(threats, F.lit("Standard macro and sector risks apply")).alias("threats"),
        F.array(thesis).alias("thesis"))


def swot_points(lists: DataFrame) -> DataFrame:
    quadrants = ["strengths", "weaknesses", "opportunities", "threats", "thesis"]
    long = lists.unpivot(["company_id"], quadrants, "quadrant", "points")
    return long.select("company_id", "quadrant", F.posexplode("points").alias("pos", "point")).select("company_id", "quadrant", F.col("pos").cast("bigint").alias("pos"), "point")


def risk_matrix(negative_factors: DataFrame, anomalies: DataFrame, indicators: DataFrame) -> DataFrame:
    """Negative factors, anomalies and indicators per company with impact and mitigation."""
    row = lambda df, section, rank, risk, impact, mitigation: df.select(
        "company_id", F.lit(section).alias("section"), F.col(rank).alias("rank_no"), risk.alias("risk"), impact.alias("impact"), F.lit(mitigation).alias("mitigation"))
    return (
        row(negative_factors, "factor", "rank_no", F.col("sentence"), F.lit("Medium/High"), "Quarterly covenant tracking and early warning triggers.")
        .unionByName(row(anomalies, "anomaly", "seq", F.concat("title", F.lit(": "), "details"), F.col("severity"), "Targeted forensic validation and covenant tightening."))
        .unionByName(row(indicators, "indicator", "seq", F.concat("indicator", F.lit(" (source: "), "source", F.lit(")")), F.col("severity"),
                         "Escalate to enhanced monitoring and transaction-level verification."))
    )


def covenants(vector: DataFrame, report: DataFrame) -> DataFrame:
    fixed = [(F.lit(True), F.lit(x)) for x in COVENANTS]
    items = present(fixed + [
        (F.col("gstr3b_vs_2a_itc_gap") > 5, F.lit("Monthly GST ITC reconciliation submission until mismatch normalizes below 5%.")),
        (F.col("debt_equity_ratio") > 1.5, F.lit("No incremental unsecured debt without lender approval.")),
        (F.size("indicators") > 0, F.lit("Enhanced transaction monitoring on related-party and round-amount transfers.")),
    ])
    return vector.join(report.select("company_id", "indicators"), "company_id", "left").select("company_id", F.posexplode(items).alias("pos", "covenant")).select(
        "company_id", (F.col("pos") + 1).cast("bigint").alias("seq"), "covenant")


def profile_rows(companies: DataFrame, latest_loan: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Entity, loan and score facts of the report and how long the decision holds."""
    loan = latest_loan.select("company_id", F.col("version_id").alias("loan_id"), F.col("status").alias("loan_status"), F.col("amount").alias("loan_amount"))
    return companies.join(loan, "company_id", "left").join(decisions, "company_id", "left").select(
        "company_id", "company_name", "cin", "sector", crore_text(F.col("requested_cr")).alias("requested"), "loan_id", "loan_status", "loan_amount",
        "credit_score", "normalized_score", "risk_grade", "recommendation", F.date_add(as_of, VALIDITY_DAYS).alias("valid_till"))


def metric_rows(vector: DataFrame, report: DataFrame) -> DataFrame:
    wide = vector.join(report.select("company_id", "consistency_score"), "company_id", "left").select(
        "company_id", ratio_text(F.col("dscr")).alias("DSCR"), ratio_text(F.col("debt_equity_ratio")).alias("Debt/Equity"), ratio_text(F.col("current_ratio")).alias("Current Ratio"),
        ratio_text(F.col("gst_banking_ratio")).alias("GST-Banking Ratio"), percent_text(F.col("consistency_score")).alias("Consistency Score"))
    return wide.unpivot(["company_id"], [c for c in wide.columns if c != "company_id"], "metric", "value")


def executive_lines(decisions: DataFrame) -> DataFrame:
    amount = crore_text(F.col("recommended_limit_cr"))
    rejected = F.concat(F.lit("Recommendation: REJECT | Limit: Not Sanctioned (Requested: "), amount, F.lit(") | Rate: N/A"))
    accepted = F.concat(F.lit("Recommendation: "), F.col("recommendation"), F.lit(" | Amount: "), amount, F.lit(" | Rate: "),
                        F.format_string("%.2f", round_to("interest_rate", 2)), F.lit("% p.a."))
    return decisions.select(
        "company_id", F.when(F.col("recommendation") == "REJECT", rejected).otherwise(accepted).alias("line"),
        F.when((F.col("recommendation") == "REJECT") & (F.col("rule_hits") != ""), F.concat(F.lit("Rejection reasons: "), F.regexp_replace("rule_hits", ",", ", "))).alias("reasons"))
