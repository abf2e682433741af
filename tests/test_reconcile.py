"""Tax mismatch, reconciliation, returns and lake tables on hand values."""

import json

import pytest
from pyspark.sql import functions as F

from creditloom.operators import reconcile as R
from creditloom.session import scratch_path
from creditloom.sources import returns as S

SIDES = "company_id long, itc_claimed double, available_itc double, invoice_sales_total double, bank_credits double"


def mismatch(spark, claimed, available, sales=None, credits=None):
    return R.tax_mismatch(spark.createDataFrame([(1, claimed, available, sales, credits)], SIDES), ["company_id"]).first()


def test_mismatch_hand_case(spark):
    got = mismatch(spark, 2_400_000.0, 1_500_000.0)
    assert (got.itc_inflation_pct, got.risk_level, got.revenue_inflation_flag, got.suspected_circular) == (60.0, "CRITICAL", False, False)
    assert got.explanation == "ITC claimed ₹2,400,000.00 vs available ₹1,500,000.00."


@pytest.mark.parametrize("claimed,sales,credits,risk", [
    (115.0, None, None, "CRITICAL"), (114.0, None, None, "HIGH"), (105.0, None, None, "HIGH"), (104.0, None, None, "MEDIUM"), (102.0, None, None, "MEDIUM"),
    (101.0, None, None, "LOW"), (50.0, None, None, "LOW"), (100.0, 131.0, 100.0, "HIGH"), (100.0, 130.0, 100.0, "LOW"), (100.0, 500.0, 0.0, "LOW"),
])
def test_mismatch_bounds(spark, claimed, sales, credits, risk):
    assert mismatch(spark, claimed, 100.0, sales, credits).risk_level == risk


ASSEMBLED = (
    "company_id long, has_bank boolean, tax_turnover double, bank_turnover double, itr_revenue double, window_dressing boolean, pair_count long, pair_value double, "
    "tax_risk string, tax_circular boolean, itc_mismatch_pct double, itc_excess double, itc_available double, pledge_pct double, contingent double, net_worth double, "
    "obligation double, net_cash_flow double")
BASE = dict(company_id=1, has_bank=True, tax_turnover=15.0, bank_turnover=9.0, itr_revenue=8.0, window_dressing=True, pair_count=0, pair_value=0.0, tax_risk="CRITICAL",
            tax_circular=False, itc_mismatch_pct=0.0, itc_excess=0.0, itc_available=0.0, pledge_pct=0.0, contingent=0.0, net_worth=0.0, obligation=6.0, net_cash_flow=None)


def report(spark, **changes):
    values = {**BASE, **changes}
    names = [f.split()[0] for f in ASSEMBLED.split(", ")]
    return R.reconcile(spark.createDataFrame([tuple(values[n] for n in names)], ASSEMBLED)).first()


def test_consistency_hand_case(spark):
    got = report(spark)
    assert got.gst_vs_bank_gap == 40.0 and got.itr_vs_gst_gap == 46.67
    assert got.consistency_score == 8.0
    assert "Enhanced forensic review before sanction." in got.advice
    assert [i.indicator for i in got.indicators] == ["Year-end window dressing detected"]


def test_no_bank_hand_case(spark):
    got = report(spark, has_bank=False, tax_turnover=12.0, bank_turnover=12.0, itr_revenue=11.5, window_dressing=False, tax_risk=None, obligation=8.0)
    assert got.consistency_score == 89.08
    assert [(a.title, a.severity) for a in got.anomalies] == [("Bank statement unavailable", "MEDIUM")]
    assert got.dscr > 0


@pytest.mark.parametrize("field,value,title,severity", [
    ("itc_mismatch_pct", 5.0, None, None), ("itc_mismatch_pct", 5.1, "GST ITC Mismatch", "HIGH"), ("itc_mismatch_pct", 20.1, "GST ITC Mismatch", "CRITICAL"),
    ("pledge_pct", 75.0, None, None), ("pledge_pct", 75.1, "Promoter Pledge Critical", "HIGH"), ("pledge_pct", 90.1, "Promoter Pledge Critical", "CRITICAL"),
])
def test_anomaly_bounds(spark, field, value, title, severity):
    got = report(spark, tax_turnover=10.0, bank_turnover=10.0, itr_revenue=10.0, **{field: value})
    assert [(a.title, a.severity) for a in got.anomalies] == ([] if title is None else [(title, severity)])


def test_percent_gap(spark):
    from creditloom.functions.values import percent_gap
    rows = spark.createDataFrame([(0.0, 0.0), (-1.0, 0.0), (15.0, 9.0), (8.0, 15.0), (0.5, 0.0)], "a double, b double")
    got = [round(r[0], 3) for r in rows.select(percent_gap(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, 40.0, 46.667, 50.0]


def test_returns_json_array_of_months(spark, tmp_path):
    payload = [
        {"return_type": "GSTR-3B", "period": "2025-01", "outward_supplies": "1,000", "itc_claimed": 5},
        {"outward_supplies": 7, "itc_claimed": "x"},
        {"type": "gstr2b", "vendor_purchases": {"a": 1, "b": "2.5"}},
        {"available_itc": 3, "vendor_purchases": {"a": 1}},
        {"invoice_sales_total": 9, "hsn_summary": {"72": 1}},
        {"type": "other"},
    ]
    (tmp_path / "r.json").write_text(json.dumps(payload))
    df = S.read_returns_json(spark, str(tmp_path), multi_line=True)
    assert sorted(r.kind for r in S.return_kind(df).collect()) == ["1", "2A", "2A", "3B", "3B", "REJECT"]
    assert sorted((r.period, r.outward_supplies, r.itc_claimed) for r in S.summary_return(df).collect()) == [("2025-01", 1000.0, 5.0), ("unknown", 7.0, 0.0)]
    assert sorted(r.available_itc for r in S.purchase_register(df).collect()) == [3.0, 3.5]


def test_ledger_csv_header_any_case(spark, tmp_path):
    folder = tmp_path / "company=42"
    folder.mkdir()
    (folder / "l.csv").write_text(" DATE ,Credit,PARTY\n2025-01-01,5,acme\n")
    got = S.read_ledger_csv(spark, str(tmp_path / "company=42")).first()
    assert (got.company_id, got.date, got.credit, got.party, got.debit, got.balance) == ("42", "2025-01-01", "5", "acme", None, None)


XML = """<?xml version="1.0"?>
<!-- <return><x>no</x></return> -->
<returns>
<return id="1"><head><period>draft</period><return_type>GSTR2A</return_type></head><note a="b>" c='/'>undeclared &amp; &#8377; <![CDATA[<a>&amp;1</a>]]></note>
<vendor_purchases kind="x"><A>1,000</A><B x="1">2.5</B><A>7</A></vendor_purchases><period>2025-01</period><empty/><bare a="1" /><e2></e2></return>
<return><return_type>GSTR3B</return_type>
 <body><outward_supplies> 5 </outward_supplies><!-- c --><table_4a>2</table_4a></body></return>
<returned><return_type>no record</return_type></returned></returns>
"""


def test_xml_needs_no_schema(spark, tmp_path):
    (tmp_path / "r.xml").write_text(XML)
    a, b = sorted(S.read_returns_xml(spark, str(tmp_path)).collect(), key=lambda r: r.return_type)
    assert [(x.tag, x.value) for x in a.leaves] == [
        ("period", "draft"), ("return_type", "GSTR2A"), ("note", "undeclared & ₹ <a>&amp;1</a>"), ("A", "1,000"), ("B", "2.5"), ("A", "7"), ("period", "2025-01"), ("empty", ""), ("bare", ""), ("e2", "")]
    assert [x.position for x in a.leaves] == list(range(10))
    assert (a.period, a.vendor_purchases, a.hsn_summary) == ("2025-01", {"A": "7", "B": "2.5"}, None)
    assert (b.outward_supplies, b.table_4a, b.period, b.vendor_purchases) == (" 5 ", "2", None, None)


def test_long_xml_values(spark, tmp_path):
    vendors = "".join(f"<v{i}>{i}</v{i}>" for i in range(500))
    (tmp_path / "r.xml").write_text(f"<return><type>GSTR2A</type><note>{'x&amp;' * 20_000}</note><vendor_purchases>{vendors}</vendor_purchases></return>")
    got = S.read_returns_xml(spark, str(tmp_path)).first()
    assert got.vendor_purchases == {f"v{i}": str(i) for i in range(500)}
    assert [len(x.value) for x in got.leaves if x.tag == "note"] == [40_000]


def test_character_references(spark):
    import html

    from creditloom.functions.text import unescape
    texts = ["a &amp; b", "&#8377;5 &#x20B9; &#128512; &#0; &#xD800; &#1114112; &#99999999999; &bogus; &nbsp;x &lt;", "none", "& &; &#; &#x;", "&#150; &amp;amp;", "&NotNestedGreaterGreater;", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(unescape(F.col("t"))).collect()
    assert [r[0] for r in got] == [html.unescape(t) for t in texts]
