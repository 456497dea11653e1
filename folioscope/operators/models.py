"""A linear model on frozen features, with Spark ML, and its cross-validation."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import kfold
from .evaluation import binary_metrics, cv_summary, roc_auc


def as_vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("__features", array_to_vector(F.col(features).cast("array<double>")))


def fit_logistic(df: DataFrame, features: str, label: str, iterations: int = 100, penalty: float = 0.01) -> tuple[object, LogisticRegressionModel]:
    """Scaler and model on standardised features."""
    rows = as_vectors(df, features)
    scaler = StandardScaler(inputCol="__features", outputCol="__scaled", withMean=True, withStd=True).fit(rows)
    model = LogisticRegression(featuresCol="__scaled", labelCol=label, maxIter=iterations, regParam=penalty).fit(scaler.transform(rows))
    return scaler, model


def predict(df: DataFrame, features: str, fitted: tuple[object, LogisticRegressionModel], name: str = "prob") -> DataFrame:
    scaler, model = fitted
    scored = model.transform(scaler.transform(as_vectors(df, features)))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("__features", "__scaled", "rawPrediction", "probability", "prediction")


def cross_validate(df: DataFrame, features: str, label: str, key: str, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Metrics of each fold (accuracy, precision, recall, F1, AUC) and their
    means and population stds. The scaler sees only the fold's training rows."""
    folds = kfold(df.select(key, label, features), label, key, k, seed)
    out: DataFrame | None = None
    for fold in range(k):
        fitted = fit_logistic(folds.filter(F.col("fold") != fold), features, label)
        held = predict(folds.filter(F.col("fold") == fold), features, fitted)
        auc = roc_auc(held.withColumn("__pos", F.col(label) == 1), "prob", "__pos")
        row = binary_metrics(held, "prob", label).join(auc).withColumn("fold", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    return out, cv_summary(out, ["accuracy", "auc"])
