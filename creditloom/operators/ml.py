"""Tree models on the feature tables: split, training, scoring, metrics, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.functions.values import round_to
from creditloom.operators.scans import ROWS_TOGETHER, scan

# Training settings.
SEED, TEST_SHARE = 42, 0.2
CLASSIFIER = {"maxIter": 120, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
REGRESSOR = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"}
CALIBRATOR = {"maxIter": 200, "maxDepth": 5, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
BUCKETS_HEX = 4


def stratified_split(rows: DataFrame, label: str, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds `part` (test or train): exactly the rounded share of each label, drawn by hash.

    Rows are put into 65,536 hash buckets. A histogram per label (bounded by the buckets) says
    which buckets are wholly test and which single one is cut, and only that bucket is ranked.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    hashed = rows.withColumns({"digest": digest, "bucket": F.substring(digest, 1, BUCKETS_HEX)})
    histogram = hashed.groupBy(label, "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    limits = histogram.select(
        label, "bucket", "n", (F.sum("n").over(upto) - F.col("n")).alias("below"),
        F.round(F.sum("n").over(Window.partitionBy(label)) * share, 0).cast("bigint").alias("wanted"))
    placed = hashed.join(F.broadcast(limits), [label, "bucket"])  # at most 65,536 rows per label
    whole = F.col("below") + F.col("n") <= F.col("wanted")
    none = F.col("below") >= F.col("wanted")
    rest = [c for c in rows.columns]
    plain = placed.filter(whole | none).select(*rest, F.when(whole, "test").otherwise("train").alias("part"))
    rank = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("digest", key))
    cut = placed.filter(~whole & ~none).withColumn("rank_no", rank).select(
        *rest, F.when(F.col("rank_no") <= F.col("wanted") - F.col("below"), "test").otherwise("train").alias("part"))
    return plain.unionByName(cut)


def _train(rows: DataFrame, features: Sequence[str], learner) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), learner]).fit(rows)


def train_classifier(rows: DataFrame, features: Sequence[str], label: str, settings: dict = CLASSIFIER, seed: int = SEED) -> PipelineModel:
    return _train(rows, features, GBTClassifier(labelCol=label, seed=seed, **settings))


def train_regressor(rows: DataFrame, features: Sequence[str], target: str, settings: dict = REGRESSOR, seed: int = SEED) -> PipelineModel:
    return _train(rows, features, GBTRegressor(labelCol=target, seed=seed, **settings))


def load_or_train(spark: SparkSession, path: str, train) -> PipelineModel:
    """The saved model at the path, trained and saved first if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        train().write().overwrite().save(path)
    return PipelineModel.load(path)


def stress_probability(model: PipelineModel | None, vector: DataFrame) -> DataFrame:
    """P(stress) per company; 0.5 where there is no model."""
    if model is None:
        return vector.select("company_id", F.lit(0.5).alias("stress_probability"))
    return model.transform(vector).select("company_id", vector_to_array("probability")[1].alias("stress_probability"))


def model_scores(classifier: PipelineModel, regressor: PipelineModel, vector: DataFrame) -> DataFrame:
    """Model score and stress probability per company, as the decision rows want them."""
    p = classifier.transform(vector).select("company_id", vector_to_array("probability")[1].alias("stress_probability"))
    s = regressor.transform(vector).select("company_id", F.col("prediction").alias("model_score"))
    return p.join(s, "company_id")


def importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Ranked importances, one row per feature of the model."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, weights)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(rows)], "rank_no bigint, feature string, importance double")


def auc(scored: DataFrame, label: str = "label", score: str = "score", limit: int = ROWS_TOGETHER) -> DataFrame:
    """Area under the curve from rank sums, one row.

    Equal scores are folded first. The negatives below each score are a running sum over the distinct scores, cut into slices where there are more than
    `limit` of them, wherever the scores lie.
    """
    folded = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ranked = scan(folded.withColumn("all", F.lit(0)), ["all"], [F.col("s")], sums={"upto": F.col("neg")}, limit=limit).withColumn("lower", F.col("upto") - F.col("neg"))
    wins = F.sum(F.col("pos") * F.col("lower") * 2 + F.col("pos") * F.col("neg"))
    return ranked.agg(round_to(F.try_divide(wins / 2.0, F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def metrics(scored: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC, one row."""
    y, p = F.col(label) == 1, F.col(score) >= cut
    counts = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    c = F.col
    zero = F.lit(0.0)
    share = lambda a, b: round_to(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), zero), 6)
    wide = counts.select(
        "*", share(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"), share(c("tp"), c("tp") + c("fp")).alias("precision"),
        share(c("tp"), c("tp") + c("fn")).alias("recall"), share(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")).alias("f1"))
    one_row = F.lit(1).alias("k")
    return wide.select(one_row, "*").join(auc(scored, label, score).select(one_row, "auc"), "k").drop("k")


def class_report(scored: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Precision, recall and support per class."""
    both = scored.select(F.col(label).alias("y"), F.when(F.col(score) >= cut, 1.0).otherwise(0.0).alias("p")).groupBy("y", "p").agg(F.count("*").alias("n"))
    sums = F.explode(F.array(F.struct(F.col("y").alias("class"), F.lit("actual").alias("role")), F.struct(F.col("p").alias("class"), F.lit("predicted").alias("role"))))
    long = both.select("n", (F.col("y") == F.col("p")).alias("hit"), sums.alias("r")).select("n", "hit", "r.*")
    by = long.groupBy("class").agg(
        F.sum(F.when(F.col("role") == "actual", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("role") == "predicted", F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("role") == "actual") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: round_to(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), 6)
    return by.select("class", "support", ratio("hits", "predicted").alias("precision"), ratio("hits", "support").alias("recall"))
