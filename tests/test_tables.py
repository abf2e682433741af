import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from creditloom.operators import findings as N
from creditloom.sources.stand_ins import RAW, STAND_INS
from creditloom.sources.tables import Tables

LINES = [
    (1, 1, 1, 5.0, 100.25, 0.05, 0.04, "R", "O", dt.datetime(1995, 3, 31, 23, 59)), (1, 5, 1, 7.4, 100.35, 0.1, 0.08, "A", "O", dt.datetime(1995, 3, 1)),
    (2, 1, 1, 1.0, 33.33, 0.07, 0.03, "N", "F", dt.datetime(1996, 1, 1)), (2, 2, 2, 9.0, 12345.67, 0.0, 0.0, "N", "F", dt.datetime(1995, 12, 31)),
    (2, 2, 2, 9.0, 12345.67, 0.0, 0.0, "N", "F", dt.datetime(1995, 12, 31)), (3, 1, 2, None, None, None, None, None, None, None), (3, 2, None, 3.0, 10.0, 0.02, 0.01, "R", "O", dt.datetime(1997, 7, 7)),
]


@pytest.fixture
def tables(spark, tmp_path):
    lines = spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in RAW:
        if name != "lineitem":
            spark.range(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return Tables(spark, str(tmp_path))


def rows(df):
    return sorted(map(str, df.collect()))


def test_tables_off_the_months_hold_the_rows_of_their_texts(tables):
    """Yearly returns and totals come off the written months, without another pass over the lines."""
    for name in ("itr", "totals"):
        got, want = getattr(tables, name), tables._read(name, STAND_INS)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert rows(got) == rows(want)
        assert not any("lineitem" in f for f in got.inputFiles())
    for name, got in tables.monthly.items():
        assert rows(got) == rows(tables._read(name, STAND_INS))
        assert not any("lineitem" in f for f in got.inputFiles())


def test_summary_of_findings_carries_few_columns(spark):
    """What the summary does not read stays out of the dedupe; the first finding of a url and summary counts, and keyword alerts are scanned whole."""
    found = [(1, i, None, kind, "HIGH", url, "src", text, "Raw " * 50, 0.7, -3.0) for i, (kind, url, text) in enumerate([
        ("LITIGATION", "u1", "Round-Tripping seen"), ("SECTOR", "U1", "round-tripping SEEN"), ("SECTOR", "u2", "quiet"), ("FRAUD_ALERT", "u3", "NCLT plea")])]
    web = spark.createDataFrame(found, "company_id long, seq long, finding_date date, finding_type string, severity string, source_url string, source_name string, summary string, raw_snippet string, confidence double, score_impact double")
    companies = spark.createDataFrame([(1, "A", "nbfc")], "company_id long, company_name string, sector string")
    registry = spark.createDataFrame([(1, None, 80.0)], "company_id long, struck_off string, compliance_score double")
    day = F.lit("2025-01-01").cast("date")
    whole, few = N.all_findings(companies, registry, web, day), N.all_findings(companies, registry, web, day, N.SUMMED)
    assert set(few.columns) == set(N.SUMMED) and whole.columns == ["company_id", *[c for c in N.FINDING if c != "company_id"], "source_order"]
    assert rows(N.research_summary(few)) == rows(N.research_summary(whole))
    got = N.research_summary(few).first()
    assert (got.fraud_hits, got.litigation_count, got.has_nclt, got.total_findings) == (2, 1, True, 6)
    assert [r.summary for r in N.keyword_alerts(web).orderBy("seq").collect()] == ["Potential red-flag term(s) detected: round-tripping."] * 2


def test_months_sum_large_odd_and_missing_amounts_like_their_text(spark, tmp_path):
    """Lines that are no small whole numbers go another way; both give the rows of the text."""
    price = [10.01, 104949.5, 671088.63, 671088.64, 9.9e13, -55.555, 0.005, 1.005, None, -0.0]
    rate = [(0.07, 0.03), (0.0, 1.0), (2.55, 0.1), (2.56, 0.1), (99.99, 0.5), (0.015, 0.025), (0.08, 0.07), (None, 0.05), (0.04, None), (0.125, 0.0)]
    lines, day = [], dt.datetime(2024, 1, 30)
    for i in range(600):
        tax, discount = rate[i % 10]
        lines.append((i % 9 if i % 50 else None, 1 + i % 3, float(i % 50) + (0.5 if i % 70 == 0 else 0.0) if i % 31 else None, price[(i // 7) % 10], discount, tax, "RANR"[i % 4] if i % 13 else None, day + dt.timedelta(days=i % 5) if i % 97 else None))
    kinds = "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    for name, part in (("all", lines), ("small", [r for r in lines if r[3] in price[:2] and r[5] in (0.07, 0.08) and r[2] is not None and r[2] % 1 == 0])):
        folder = tmp_path / name
        for raw in RAW:
            spark.createDataFrame(part if raw == "lineitem" else [], kinds if raw == "lineitem" else "x int").write.parquet(f"{folder}/{raw}.parquet")
        tables = Tables(spark, str(folder))
        expected = tables._read("month", STAND_INS)
        got = tables.month.select(expected.columns)
        assert got.dtypes == expected.dtypes
        sums = tables.staged("month_sums", None)
        assert {k for c, k in sums.dtypes if c != "period"} == {"bigint"} and (sums.where("n_rest > 0").count() > 0) == (name == "all")
        assert rows(got) == rows(expected)
        assert rows(tables.totals) == rows(tables._read("totals", STAND_INS))


def test_month_lines_are_dealt_by_their_number(spark, tmp_path):
    """With a limit of 20 lines a task, 300 lines go to 15 tasks, though the session has 8 shuffle partitions; months of more lines, that without company and date among them, are summed first."""
    lines = [(None if i % 5 == 0 else 1 if i % 5 == 1 else i % 11, 1 + i % 3, float(i % 50), 10.01 * (i % 7), 0.05, 0.02, "RAN"[i % 3], None if i % 5 == 0 else dt.datetime(2024, 1, 1) if i % 5 == 1 else dt.datetime(2024, 1 + i % 12, 3)) for i in range(300)]
    kinds = "l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    for raw in RAW:
        spark.createDataFrame(lines if raw == "lineitem" else [], kinds if raw == "lineitem" else "x int").write.parquet(f"{tmp_path}/{raw}.parquet")
    tables = Tables(spark, str(tmp_path))
    whole, dealt = tables._month_sums(), tables._month_sums(limit=20)
    assert rows(dealt) == rows(whole) and max(r.n_rows for r in whole.collect()) >= 60 and dealt.columns == whole.columns
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"RepartitionByExpression \[company_id#\d+L?, period#\d+\], (\d+)", plan) == ["15"]
