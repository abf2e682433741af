"""Text jobs on the stated cases."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators import diligence as D
from creditloom.operators import graph as G
from creditloom.operators import textjobs as X


def docs(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, company_id long, doc_text string")


@pytest.mark.parametrize("text,expected", [
    ("Revenue from operations was ₹5,135 crore in FY25", 5135.0), ("Revenue: 51,350 lakhs", 513.5), ("Gross Receipts: 32,450.0", 32450.0), ("nothing here", None),
])
def test_revenue(spark, text, expected):
    assert X.revenues(docs(spark, text)).first().revenue_cr == expected


@pytest.mark.parametrize("number,unit,expected", [
    ("250", "lakhs", 2.5), ("50", "million", 5.0), ("12", "cr", 12.0), ("12", "crore", 12.0), ("100001", "", 1000.01), ("100000", "", 10000.0), ("10001", "", 1000.1),
    ("10000", "", 10000.0), (",", "", 0.0), ("7", None, 7.0),
])
def test_units(spark, number, unit, expected):
    df = spark.createDataFrame([(number, unit)], "n string, u string")
    assert round(df.select(X.crore_value(F.col("n"), F.col("u"))).first()[0], 6) == expected


def test_holders_and_percentages(spark):
    text = "Zeta Limited\n1. Asha Family Trust - 12.25%\n2) Delta Holdings: 8.75%\nASHA FAMILY TRUST 3%\nCategory total 100%\nPledged 30.5% of promoter shares"
    got = [(r.rank_no, r.name, r.pct) for r in X.top_holders(docs(spark, text)).orderBy("rank_no").collect()]
    assert got[:2] == [(1, "Pledged", 30.5), (2, "Asha Family Trust", 12.25)]
    facts = X.holding_facts(docs(spark, text)).first()
    assert facts.promoter_holding_pct == 30.5 and facts.pledged_pct == 30.5
    assert facts.red_flags == "Promoter pledge is high at 30.50%"


def test_holding_fallback_sum(spark):
    facts = X.holding_facts(docs(spark, "Asha Family Trust 12.25%\nDelta Holdings 8.75%\nOther Person 4%")).first()
    assert facts.promoter_holding_pct == 21.0
    assert facts.red_flags == "Promoter holding is low at 21.00%"


def test_going_concern_guard(spark):
    df = docs(spark, "No going concern uncertainty", "going concern doubt")
    assert [r[0] for r in df.select(X.going_concern(F.col("doc_text"))).collect()] == [True, True]
    assert [r[0] for r in df.select(X.going_concern(F.col("doc_text"), True)).collect()] == [False, True]


def test_content_type_ties_go_to_first(spark):
    df = docs(spark, "security of advocate", "balance sheet and cash flow", "none")
    assert [r[0] for r in df.select(X.content_type(F.col("doc_text"))).collect()] == ["SANCTION_LETTER", "FINANCIAL_STATEMENT", "UNKNOWN"]


@pytest.mark.parametrize("html, text", [
    ("<p>&#8377; 5 &amp;lt; &#x20B9;&copy;&nbsp;</p><p>&nbsp;</p><p>&bogus; &amp</p>", "₹ 5 &lt; ₹©\n&bogus; &amp"),
    ("<nav>a<nav>b</nav>c</nav>d<NAV class=x>e<nav>f<nav>g</nav></nav>h</NAV >i", "d\ni"),
    ("<header>a<p>b</p></header>c<header>d</header>e<headers>f</headers>", "c\ne\nf"),
    ("a<script>if (x < 1) { '<nav>' }", "a"),
    ("<nav>never closed<p>a</p>", "never closed\na"),
    ("a</nav>b\rc\u2028d", "a\nb\nc\nd"),
    ("<aside>" * 40 + "x" + "</aside>" * 40 + "y", "y"),
    ("<nav>" + "<p>long</p>" * 20_000 + "</nav>z", "z"),
    ("", ""), (None, None),
])
def test_page_text_of_odd_pages(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.page_text(F.col("html"))).first()[0] == text


def test_page_text_drops_furniture(spark):
    html = "<head><title>T &amp; Co</title><script>var t=\"</p>\";</script></head><nav>x</nav><HEADER class='a'>y</HEADER><p>Hello</p><!-- z --><p> </p><footer>f</footer>"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(X.page_text(F.col("html"))).first()[0] == "T & Co\nHello"


def test_dates(spark):
    df = spark.createDataFrame([("2025-02-28",), ("28/02/2025",), ("28-02-2025",), ("31/02/2025",), ("null",), (None,)], "s string")
    assert [str(r[0]) for r in df.select(X.any_date(F.col("s"))).collect()] == ["2025-02-28"] * 3 + ["None"] * 3


def test_note_scores(spark):
    notes = spark.createDataFrame([
        (1, 0, "Idle machinery. capacity_utilization_percent: 40"), (1, 1, "new order, timely, expansion, automation, healthy demand, export growth"),
        (1, 2, ""), (1, 3, "management_interview_rating: 4 management_cooperation: cooperative"),
    ], "company_id long, seq long, note string")
    got = {r.seq: r for r in D.score_notes(notes).collect()}
    assert (got[0].score_adjustment, got[0].sentiment) == (-22.0, "NEGATIVE")
    assert "Low observed capacity utilization may pressure debt servicing." in got[0].concerns
    assert (got[1].score_adjustment, got[1].sentiment) == (20.0, "POSITIVE")
    assert (got[2].score_adjustment, got[2].sentiment) == (0.0, "NEUTRAL")
    assert got[3].score_adjustment == 11.0


@pytest.mark.parametrize("name,valid", [
    ("Beta Steel Limited", True), ("ab", False), ("ACME ltd", False), ("March 2025", False), ("paid 01/02/2024", False), ("Rs 500", False), ("₹500", False),
    ("5 crore", False), ("Fraud Corp", False), ("Suitcase Ltd", False), ("1234", False), (" - Gamma; ", True),
])
def test_valid_entity(spark, name, valid):
    df = spark.createDataFrame([(name, "Acme Ltd")], "n string, c string")
    assert df.select(G.valid_entity(F.col("n"), F.col("c"))).first()[0] is valid


def test_promoter_fallbacks(spark):
    companies = spark.createDataFrame([(1, "A", ["X One"]), (2, "B", ["Y One", " "]), (3, "C", ["Z One"])], "company_id long, company_name string, managers array<string>")
    holders = spark.createDataFrame([(1, 5, 0, "Asha Trust", 12.0), (1, 6, 0, "ASHA TRUST", 15.0)], "company_id long, doc_id long, pos long, name string, pct double")
    holding = spark.createDataFrame([(1, 50.0, 80.0), (2, 40.0, 10.0)], "company_id long, promoter_holding_pct double, promoter_pledge_pct double")
    got = sorted(map(tuple, G.promoters(companies, holders, holding).collect()))
    assert got == [(1, 1, "ASHA TRUST", 15.0, 80.0), (2, 1, "Promoter Group", 40.0, 10.0), (3, 1, "Z One", 0.0, 0.0)]


ODD_TEXTS = [
    None, "", "nothing here", "REVENUE from operations ₹ 12.5 crore. Net Profit 3 lakhs, PAT 4", "Revenue stood at 1,200 lakhs", "Gross  Receipts: 77.0", "annual turnover of 900 cr", "gross receipts 5 mn",
    "Name: Acme Pvt Ltd, CIN L12345MH2010PLC123456 PAN abcde1234f", "12345 6789 L12345", "Total Debt 55 outstanding. Customer concentration 40%. Rating UPGRADED by Care Ratings AA-", "borrowings: 7. downgraded. ICRA BBB+",
    "STATE BANK limit 100 and Union ban\u212a 200", "A petition is pending before the high court here. Legal Notice", "The Amount and mountain. Mou with Gamma Corp; strategic partner Delta Steel\nrated by Fitch",
    "Qualified Opinion on stock. EMPHASIS OF MATTER\nbalance sheet", "Collateral: first charge on plant and machinery\nsecurity: x", "no going concern doubt", "GO\u0130NG CONCERN", "minutes of meeting, quorum; balance sheet, cash flow",
]


def test_facts_try_patterns_only_where_their_words_stand(spark):
    """A text is lowered once, and every field is as the field's own job finds it."""
    texts = docs(spark, *ODD_TEXTS)
    facts = X.facts(texts)
    assert facts._jdf.queryExecution().optimizedPlan().toString().count("lower(doc_text") == 1
    text = F.col("doc_text")
    own = texts.select(
        "doc_id", X.rlike_first(text, X.CIN).alias("cin"), X.rlike_first(text, X.PAN).alias("pan"), X.revenue_crore(text).alias("revenue_cr"), X.money_series(text, X.REVENUE_SERIES).alias("revenue_series"),
        X.money_series(text, X.PROFIT_SERIES).alias("profit_series"), X.total_debt(text).alias("total_debt"), X.bank_limits(text).alias("bank_limits"), X.disputes(text).alias("disputes"),
        X.related_parties(text).alias("related_parties"), X.auditor_notes(text).alias("auditor_notes"), X.collateral_lines(text).alias("collateral"), X.going_concern(text).alias("going_concern"),
        X.content_type(text).alias("content_type"), *X.rating_columns(text))
    want = {r.doc_id: r.asDict(True) for r in own.collect()}
    got = {r.doc_id: r.asDict(True) for r in facts.select(own.columns).collect()}
    assert got == want
    assert all(any(r[c] not in (None, [], False, "UNKNOWN") for r in want.values()) for c in own.columns)
