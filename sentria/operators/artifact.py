"""A fitted linear model as a small JSON table: train, save, load, score, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.operators import evaluate, model

SCHEMA = "feature_names array<string>, coefficients array<double>, intercept double, scaler_mean array<double>, scaler_scale array<double>, flag_threshold double"


@dataclass(frozen=True)
class Linear:
    #: (name, coefficient, mean, scale) in the features' order
    terms: tuple[tuple[str, float, float, float], ...]
    intercept: float
    threshold: float = model.THRESHOLD

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with prob and predicted."""
        return model.score(rows, list(self.terms), self.intercept).withColumn("predicted", F.col("prob") >= self.threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        """Overwrites path, as one JSON line."""
        names, coefs, means, scales = map(list, zip(*self.terms))
        spark.createDataFrame([(names, coefs, self.intercept, means, scales, self.threshold)], SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> Linear:
    """A saved model; raises if its features aren't those of this version, in their order."""
    r = spark.read.schema(SCHEMA).json(path).first()
    if r is None or list(r["feature_names"] or ()) != model.FEATURES:
        raise ValueError(f"no model of these features at {path}")
    terms = tuple(zip(r["feature_names"], r["coefficients"], r["scaler_mean"], r["scaler_scale"]))
    return Linear(terms, r["intercept"], r["flag_threshold"])


def fixed() -> Linear:
    return Linear(tuple(model.fixed_model()), model.FIXED_INTERCEPT)


def train(rows: DataFrame, label: str = "label") -> Linear:
    """Balanced logistic regression on standardized features of rows."""
    by = {r["name"]: (r["mean"], r["scale"]) for r in model.scaler(rows).collect()}
    fitted = model.fit_logreg(rows, label, by)
    return Linear(tuple((n, float(c), *by[n]) for n, c in zip(model.FEATURES, fitted.coefficients)), float(fitted.intercept))


def metrics(scored: DataFrame) -> dict[str, float | int]:
    """Confusion, precision, recall, F1 and the area under the curve of scored rows."""
    row = evaluate.confusion(scored).first()
    return {**(row.asDict() if row else {}), **evaluate.roc_auc(scored).first().asDict()}


def report(rows: DataFrame, fitted: Linear, pure: tuple[str, ...], cohort) -> DataFrame:
    """(report): one JSON text of how a model does on the test rows of rows(split, label, bucket, doc_id, ord,
    sentence_text, features): metrics, the gap between cohorts, and the documents it gets most wrong."""
    scored = fitted.score(rows)
    test = scored.where("split = 'test'")
    counts = rows.groupBy().agg(*[f(F.when(F.col("split") == s, F.col("doc_id") if d else F.lit(1))).alias(f"n_{s}_{n}") for s in ("train", "test") for n, f, d in (("sentences", F.count, False), ("docs", F.countDistinct, True))])
    spark = rows.sparkSession
    m = metrics(test)
    auc = m.pop("auc")
    measured = spark.createDataFrame([(*map(int, (m["tn"], m["fp"], m["fn"], m["tp"])), float(m["precision"]), float(m["recall"]), float(m["f1"]), None if auc is None else float(auc))], "tn long, fp long, fn long, tp long, precision double, recall double, f1 double, roc_auc double")
    wrong = evaluate.wrong_documents(test, pure).agg(F.array_sort(F.collect_list(F.struct("doc_id", "bucket", "true_label", "pred_label", "mean_prob", "n_sentences", "preview"))).alias("confidently_wrong_examples"))
    gap = evaluate.bias_gap(evaluate.cohort_rates(scored, cohort))
    one = measured.select(F.struct("*").alias("logreg_metrics"))
    for row in (gap.select(F.struct("*").alias("bias_probe")), wrong, counts):  # aggregates of one row
        one = one.join(F.broadcast(row), F.lit(True), "inner")
    return one.select(F.to_json(F.struct("*")).alias("report"))
