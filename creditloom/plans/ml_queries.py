"""Registered queries: split, training, scoring, metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import features as E
from creditloom.operators import ml as K
from creditloom.operators import scoring as S
from creditloom.plans import decision_chain as C
from creditloom.session import shared_dir
from creditloom.sources.tables import Tables


def _credit_rows(t: Tables) -> DataFrame:
    v = E.without_news(C.vector(t))
    return v.join(S.label_score(C.vector(t)).select("company_id", "stress_label", "target_score"), "company_id")


def _calibrator_rows(t: Tables) -> DataFrame:
    v = E.calibrator_vector(C.blocks(t))
    return v.join(S.stress_rule(v, C.blocks(t)), "company_id")


def _parts(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    return t.staged(name, lambda: K.stratified_split(rows, "stress_label", "company_id"))


def _model(t: Tables, name: str, train) -> PipelineModel:
    """One saved model per session, folder, state of its files, and name."""
    stem = "".join(ch if ch.isalnum() else "-" for ch in t.folder)
    return K.load_or_train(t.spark, f"{shared_dir(t.spark)}/models/{t.spark.sparkContext.applicationId}{stem}-{t.stamp}-{name}", train)


def classifier(t: Tables) -> PipelineModel:
    parts = _parts(t, _credit_rows(t), "credit_parts")
    return _model(t, "classifier", lambda: K.train_classifier(parts.filter("part = 'train'"), E.CREDIT_FEATURES, "stress_label"))


def regressor(t: Tables) -> PipelineModel:
    return _model(t, "regressor", lambda: K.train_regressor(_parts(t, _credit_rows(t), "credit_parts").filter("part = 'train'"), E.CREDIT_FEATURES, "target_score"))


def calibrator(t: Tables) -> PipelineModel:
    parts = _parts(t, _calibrator_rows(t), "calibrator_parts")
    return _model(t, "calibrator", lambda: K.train_classifier(parts.filter("part = 'train'"), E.CALIBRATOR_FEATURES, "stress_label", K.CALIBRATOR))


def _tested(model: PipelineModel, parts: DataFrame) -> DataFrame:
    scored = K.stress_probability(model, parts.filter("part = 'test'")).join(parts.select("company_id", F.col("stress_label").alias("label")), "company_id")
    return K.metrics(scored.withColumnRenamed("stress_probability", "score"))


def _fit(t: Tables) -> DataFrame:
    fitted = regressor(t).transform(_parts(t, _credit_rows(t), "credit_parts").filter("part = 'test'"))
    error = F.col("prediction") - F.col("target_score")
    return fitted.agg(F.count("*").alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mean_error"))


def _rule_scores(t: Tables) -> DataFrame:
    """The rule signal taken as a prediction of the second label rule."""
    labels = S.stress_rule(E.calibrator_vector(C.blocks(t)), C.blocks(t)).withColumnRenamed("stress_label", "label")
    return C.rule_model(t).select("company_id", F.col("stress_probability").alias("score")).join(labels, "company_id")


def _bounds(rows: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows, and how many of them lie outside what the column may hold."""
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(False))).alias("outside"))


def _test_part(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    return _parts(t, rows, name).filter("part = 'test'")


QUERIES = {
    "ml_1_checks": lambda t: _bounds(K.stress_probability(classifier(t), _test_part(t, _credit_rows(t), "credit_parts")), "stress_probability", 0, 1),
    "ml_2_checks": lambda t: _bounds(regressor(t).transform(_test_part(t, _credit_rows(t), "credit_parts")), "prediction", -1e6, 1e6),
    "ml_3_checks": lambda t: _bounds(K.stress_probability(calibrator(t), _test_part(t, _calibrator_rows(t), "calibrator_parts")), "stress_probability", 0, 1),
    "ml_6_checks": lambda t: _bounds(C.decisions(t, K.model_scores(classifier(t), regressor(t), E.without_news(C.vector(t)))), "credit_score", 0, 900),
    "ml_7_checks": lambda t: K.importances(t.spark, classifier(t), E.CREDIT_FEATURES).agg(F.count("*").alias("n"), F.round(F.sum("importance"), 6).alias("total")),
    "ml_1_stress_classifier": lambda t: _tested(classifier(t), _parts(t, _credit_rows(t), "credit_parts")),
    "ml_2_score_regressor": _fit,
    "ml_3_calibrator": lambda t: _tested(calibrator(t), _parts(t, _calibrator_rows(t), "calibrator_parts")),
    "ml_4_stratified_split": lambda t: _parts(t, _calibrator_rows(t), "calibrator_parts").select("company_id", "stress_label", "part"),
    "ml_6_model_decisions": lambda t: C.decisions(t, K.model_scores(classifier(t), regressor(t), E.without_news(C.vector(t)))),
    "ml_7_importances": lambda t: K.importances(t.spark, classifier(t), E.CREDIT_FEATURES),
    "agg_13_metrics": lambda t: K.metrics(_rule_scores(t)),
    "agg_13_class_report": lambda t: K.class_report(_rule_scores(t)),
}
