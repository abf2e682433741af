"""Scores, grades, prices, limits and labels at their bounds."""

import pytest
from pyspark.sql import functions as F

from creditloom.operators import features as E
from creditloom.operators import scoring as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("score,grade", [(90, "AAA"), (83, "AA"), (77, "AA-"), (72, "A+"), (67, "A"), (62, "A-"), (57, "BBB+"), (52, "BBB"), (48, "BB+"), (41, "BB"), (30, "B")])
def test_grades(spark, score, grade):
    assert value(spark, S.grade(F.lit(float(score)))) == grade


@pytest.mark.parametrize("grade,bps", [("AA", 100), ("BB+", 275), ("??", 300), ("D", 0)])
def test_premiums(spark, grade, bps):
    assert value(spark, S.premium(F.lit(grade))) == bps
    assert value(spark, S.interest_rate(F.lit(grade))) == round(8.5 + bps / 100, 2)


def test_limit(spark):
    assert value(spark, S.approved_limit(F.lit(50.0), F.lit(100.0), F.lit("AA"))) == 25.0
    assert value(spark, S.approved_limit(F.lit(10.0), F.lit(100.0), F.lit("A-"))) == 7.0
    assert value(spark, S.approved_limit(F.lit(-1.0), F.lit(100.0), F.lit("AA"))) == 0.0


@pytest.mark.parametrize("rule,prob,final,band", [(100.0, 0.0, 100.0, "LOW"), (0.0, 1.0, 0.0, "CRITICAL"), (75.0, 0.25, 75.0, "LOW"), (57.5, 0.5, 54.5, "HIGH"), (58.4, 0.5, 55.0, "MODERATE"), (25.0, 0.5, 35.0, "HIGH"), (24.0, 0.5, 34.4, "CRITICAL")])
def test_blend(spark, rule, prob, final, band):
    got = S.blend(spark.createDataFrame([(1, rule, prob, False)], "company_id long, rule_score double, stress_probability double, critical_hit boolean")).first()
    assert (got.final_score, got.risk_category) == (final, band)
    assert got.decision == {"LOW": "APPROVE", "CRITICAL": "REJECT"}.get(band, "CONDITIONAL_APPROVE")


def inputs(spark, **changes):
    base = {f: 1.0 for f in S.ALL_FEATURES}
    base.update(has_going_concern_doubt=0.0, gstr3b_vs_2a_itc_gap=0.0, due_diligence_risk_adjustment=0.0)
    base.update(company_id=1, model_score=800.0, stress_probability=0.0, completeness=1.0, requested_cr=10.0, revenue_used_cr=100.0, is_fallback=False)
    base.update(changes)
    return S.decide(spark.createDataFrame([base])).first()


def test_decision_rows(spark):
    ok = inputs(spark)
    assert (ok.credit_score, ok.normalized_score, ok.risk_grade, ok.recommendation, ok.score_band) == (800.0, 88.9, "AA", "APPROVE", "83-93")
    assert (ok.confidence_low, ok.confidence_high, ok.recommended_limit_cr) == (788.0, 812.0, 10.0)
    capped = inputs(spark, is_fallback=True)
    assert (capped.credit_score, capped.normalized_score, capped.warnings != "") == (630.0, 70.0, True)
    assert inputs(spark, model_score=600.0).recommendation == "CONDITIONAL_APPROVE"
    weak = inputs(spark, model_score=400.0)
    assert (weak.recommendation, weak.risk_grade, weak.recommended_limit_cr) == ("REJECT", "D", 0.0)
    hard = inputs(spark, gstr3b_vs_2a_itc_gap=25.1, has_going_concern_doubt=1.0)
    assert (hard.credit_score, hard.rule_hits, hard.confidence_low, hard.confidence_high) == (450.0, "going_concern_doubt,severe_gst_mismatch", 420.0, 480.0)
    assert inputs(spark, gstr3b_vs_2a_itc_gap=25.0).rule_hits == ""


def test_stress_grid(spark):
    got = {r.drop_pct: r for r in S.stress_grid(spark.createDataFrame([(1, 80.0)], "company_id long, final_score double")).collect()}
    assert (got[20].stressed_score, got[20].stressed_decision, got[20].score_reduction) == (64.0, "CONDITIONAL APPROVE", 16.0)
    assert got[0].stressed_decision == "APPROVE" and got[40].stressed_decision == "REJECT"


PROFILE = (
    "company_id long, dscr double, ebitda_margin double, is_declining boolean, net_worth double, total_debt double, current_ratio double, fraud_hits long, "
    "director_disqualified boolean, auditor_opinion string, circular_signals boolean, gst_vs_bank_gap double, litigation_count long, recovery_suit boolean, "
    "factory_capacity_utilization double, sector_headwinds boolean")
CLEAN = dict(company_id=1, dscr=None, ebitda_margin=None, is_declining=None, net_worth=None, total_debt=None, current_ratio=None, fraud_hits=None, director_disqualified=None,
             auditor_opinion=None, circular_signals=None, gst_vs_bank_gap=None, litigation_count=None, recovery_suit=None, factory_capacity_utilization=None, sector_headwinds=None)


@pytest.mark.parametrize("changes,rules", [
    ({}, []), ({"dscr": 0.0, "ebitda_margin": 0.0, "current_ratio": 0.0}, []), ({"dscr": 0.99}, ["CAP_001"]), ({"dscr": 1.0}, ["CAP_002"]), ({"dscr": 1.25}, []),
    ({"ebitda_margin": 4.9}, ["CAP_003"]), ({"is_declining": True}, ["CAP_004"]), ({"total_debt": 31.0, "net_worth": 10.0}, ["CAP_005"]), ({"total_debt": 30.0, "net_worth": 10.0}, []),
    ({"current_ratio": 0.9}, ["CAP_006"]), ({"net_worth": -1.0}, ["CAP_005", "CAP_007"]), ({"fraud_hits": 1}, ["CHAR_001"]), ({"director_disqualified": True}, ["CHAR_002"]),
    ({"auditor_opinion": "adverse"}, ["CHAR_003"]), ({"auditor_opinion": "unqualified"}, []), ({"circular_signals": True}, ["FRAUD_001"]), ({"gst_vs_bank_gap": 25.0}, []),
    ({"gst_vs_bank_gap": 25.1}, ["FRAUD_002"]), ({"litigation_count": 2}, []), ({"litigation_count": 3}, ["LIT_001"]), ({"recovery_suit": True}, ["LIT_002"]),
    ({"factory_capacity_utilization": 49.0}, ["COND_001"]), ({"factory_capacity_utilization": 50.0}, []), ({"factory_capacity_utilization": 0.0}, []), ({"sector_headwinds": True}, ["COND_002"]),
])
def test_policy_rules(spark, changes, rules):
    names = [f.split()[0] for f in PROFILE.split(", ")]
    row = {**CLEAN, **changes}
    df = spark.createDataFrame([tuple(row[n] for n in names)], PROFILE)
    assert [r.rule_id for r in S.violation_rows(df).collect()] == rules
    score = S.rule_scores(df).first()
    assert score.rule_score == max(0, 100 - sum(p for i, _, p, _, _ in S.policy_rules() if i in rules))


def test_growth_pads_with_oldest(spark):
    rows = spark.createDataFrame([(1, 2020, 100.0), (1, 2021, 121.0), (2, 2021, 50.0), (3, 2019, 9.0), (3, 2020, 8.0), (3, 2021, 7.0), (3, 2018, 99.0)], "company_id long, assessment_year int, gross_revenue double")
    got = {r.company_id: r for r in E.growth(rows).collect()}
    assert (got[1].r0, got[1].r1, got[1].r2) == (121.0, 100.0, 100.0) and round(got[1].revenue_cagr_3yr, 6) == 0.1
    assert (got[2].revenue_cagr_3yr, got[2].revenue_growth_yoy) == (0.0, 0.0)
    assert got[3].is_declining and not got[1].is_declining
