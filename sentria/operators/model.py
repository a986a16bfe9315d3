"""Scaling, weights, an interpretable linear score, its contributions and reasons, and model fitting."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.operators.lm import SIGNALS
from sentria.operators.style import SENTENCE_FEATURES

#: Features of the document are computed but never scored: they are the same for all its sentences.
FEATURES = [c for c in SIGNALS if c != "sig_doc_perplexity"] + SENTENCE_FEATURES
THRESHOLD = 0.5

#: What a feature says where it is high and where it is low; the length in words says nothing.
REASONS = {
    "sig_mean_nll": ("Its words are harder to predict than usual.", "Its words are easier to predict than usual."),
    "sig_perplexity": ("It surprises a language model.", "It hardly surprises a language model."),
    "sig_mean_rank": ("Its words are seldom the expected ones.", "Its words are mostly the expected ones."),
    "sig_median_rank": ("Half of its words are far from the expected ones.", "Half of its words are close to the expected ones."),
    "sig_frac_top1": ("Many of its words are the most expected one.", "Few of its words are the most expected one."),
    "sig_frac_top10": ("Nearly all of its words are among ten expected ones.", "Many of its words are not among ten expected ones."),
    "sig_frac_top50": ("Nearly all of its words are among fifty expected ones.", "Several of its words are not among fifty expected ones."),
    "sig_surprisal_std": ("How expected its words are varies much.", "How expected its words are hardly varies."),
    "sig_max_surprisal": ("One of its words is strikingly unexpected.", "None of its words is unexpected."),
    "sent_avg_word_len": ("Its words are long.", "Its words are short."),
    "sent_comma_rate": ("It has many commas.", "It has few commas."),
    "sent_semicolon_dash_rate": ("It has many semicolons or dashes.", "It has no semicolons or dashes to speak of."),
    "sent_punct_density": ("It is dense with punctuation.", "It is light on punctuation."),
    "sent_contraction_rate": ("It uses contractions.", "It avoids contractions."),
    "sent_ai_tell_count": ("It holds phrases that generated text overuses.", "It avoids phrases that generated text overuses."),
    "sent_unique_word_ratio": ("It hardly repeats a word.", "It repeats words."),
    "sent_local_bigram_overlap": ("Its word pairs recur in the document.", "Its word pairs don't recur in the document."),
    "sent_len_zscore_in_doc": ("It is longer than the document's other sentences.", "It is shorter than the document's other sentences."),
    "sent_len_abs_dev_ratio": ("Its length breaks the document's rhythm.", "Its length keeps the document's rhythm."),
}
FALLBACK = ("On the whole it resembles generated writing.", "On the whole it resembles human writing.")


def finite(c: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def matrix(df: DataFrame, *keep: str) -> DataFrame:
    """The features in their fixed order; raises if one is missing."""
    missing = [c for c in FEATURES if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keep, *[finite(F.col(c).cast("double")).alias(c) for c in FEATURES])


def scaler(rows: DataFrame) -> DataFrame:
    """(ord, name, mean, scale): population deviation, 1 where it is 0; one aggregate."""
    one = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(FEATURES)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(FEATURES)])
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("name"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("scale")) for i, c in enumerate(FEATURES)])
    return one.select(F.explode(each).alias("x")).select("x.*")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, weight): n / (2 n_c)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True), "inner").select(label, (F.col("total") / (2.0 * F.col("n"))).alias("weight"))


def fixed_model() -> list[tuple[str, float, float, float]]:
    """(name, coefficient, mean, scale) by a rule, so that a score can be replayed anywhere: signs
    alternate, and one scale is 0."""
    return [(c, (-1.0) ** i * (0.1 + 0.05 * i), 0.5 * i, 0.0 if i == 7 else 1.0 + 0.25 * i) for i, c in enumerate(FEATURES)]


FIXED_INTERCEPT = -0.2


def z_score(c: Column, mean: float, scale: float) -> Column:
    return F.lit(0.0) if scale == 0 else (c - F.lit(mean)) / F.lit(scale)


def logit(model: list[tuple[str, float, float, float]], intercept: float) -> Column:
    out = F.lit(intercept)
    for name, coef, mean, scale in model:
        out = out + z_score(F.col(name), mean, scale) * F.lit(coef)
    return out


def score(rows: DataFrame, model=None, intercept: float = FIXED_INTERCEPT) -> DataFrame:
    """rows with prob and the verdict (threshold included); one expression, no join."""
    x = logit(model or fixed_model(), intercept)
    p = F.when(x >= 0, 1.0 / (1.0 + F.exp(-F.least(x, F.lit(700.0))))).otherwise(F.exp(F.greatest(x, F.lit(-700.0))) / (1.0 + F.exp(F.greatest(x, F.lit(-700.0)))))
    return rows.withColumn("prob", p).withColumn("predicted", F.col("prob") >= THRESHOLD)


def contributions(rows: DataFrame, key: str, model=None) -> DataFrame:
    """(key, predicted, ord, name, z, contribution) of each row and feature."""
    model = model or fixed_model()
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), z_score(F.col(n), m, s).alias("z"), (z_score(F.col(n), m, s) * F.lit(c)).alias("contribution")) for i, (n, c, m, s) in enumerate(model)])
    return rows.select(key, "predicted", F.explode(each).alias("x")).select(key, "predicted", "x.*")


def reasons(k: int = 3, model=None) -> Column:
    """Of the k largest contributions with the verdict's sign (ties in the features' order) those that have
    something to say, else what the verdict says on the whole; of rows with the features and predicted."""
    model = model or fixed_model()
    sign = F.when(F.col("predicted"), F.lit(1.0)).otherwise(F.lit(-1.0))
    none = F.lit(None).cast("string")
    each = [
        F.struct((-F.abs(z_score(F.col(n), m, s) * F.lit(c))).alias("size"), F.lit(i).alias("ord"), (z_score(F.col(n), m, s) * F.lit(c) * sign).alias("aligned"), F.when(z_score(F.col(n), m, s) > 0, F.lit(REASONS[n][0])).otherwise(F.lit(REASONS[n][1])).alias("text") if n in REASONS else none.alias("text"))
        for i, (n, c, m, s) in enumerate(model)
    ]
    top = F.slice(F.array_sort(F.filter(F.array(*each), lambda x: x["aligned"] > 0)), 1, k)
    return F.filter(F.transform(top, lambda x: x["text"]), lambda t: t.isNotNull())


def with_reasons(rows: DataFrame, k: int = 3, model=None) -> DataFrame:
    """Scored rows with their reasons, row by row."""
    rest = F.array(F.when(F.col("predicted"), F.lit(FALLBACK[0])).otherwise(F.lit(FALLBACK[1])))
    return rows.withColumn("reasons", reasons(k, model)).withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(rest))


def top_reasons(rows: DataFrame, key: str, k: int = 3, model=None) -> DataFrame:
    """(key, predicted, reasons) of scored rows."""
    return with_reasons(rows, k, model).select(key, "predicted", "reasons")


def scaled(rows: DataFrame, *keep: str, by: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """rows with a vector of standardized features; the scaler's one row goes to the driver."""
    by = by or {r["name"]: (r["mean"], r["scale"]) for r in scaler(rows).collect()}
    std = rows.select(*keep, *[((F.col(c) - by[c][0]) / by[c][1]).alias(c) for c in FEATURES])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(std).select(*keep, "features")


def fit_logreg(rows: DataFrame, label: str = "label", by: dict[str, tuple[float, float]] | None = None):
    """Balanced logistic regression with an L2 penalty of C = 1 on standardized features, to convergence. The
    features are held (in memory, else on disk) while it iterates."""
    weights = class_weights(rows, label)
    data = scaled(rows, label, by=by).join(F.broadcast(weights), label).persist()
    try:
        total = data.agg(F.sum("weight")).first()[0]
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(data)
    finally:
        data.unpersist()


def fit_gbt(rows: DataFrame, label: str = "label", rounds: int = 200):
    """Boosted trees for comparison."""
    data = scaled(rows, label).persist()
    try:
        return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, stepSize=0.1, maxDepth=5, cacheNodeIds=True, checkpointInterval=10, seed=42).fit(data)
    finally:
        data.unpersist()
