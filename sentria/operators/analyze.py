"""Documents to scored, explained sentences: the whole path as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.functions import text as T
from sentria.operators.lm import bigram_scores, sentence_signals
from sentria.operators.model import FIXED_INTERCEPT, matrix, score, with_reasons
from sentria.operators.sentences import sentences, word_rows
from sentria.operators.style import style_features


def features(docs: DataFrame, key: str = "doc_id", text: str = "doc_text", scorer=bigram_scores, keep_text: bool = False) -> DataFrame:
    """(key, sentence_order[, sentence_text], all thirty features) of each sentence."""
    sents = sentences(docs.select(key, text), key, text)
    signals = sentence_signals(sents, scorer(word_rows(sents, key)), key)
    return style_features(docs.select(key, text), key, text, keep_text).join(signals, [key, "sentence_order"])


def scored(docs: DataFrame, key: str = "doc_id", text: str = "doc_text", model=None, intercept: float = FIXED_INTERCEPT, scorer=bigram_scores) -> DataFrame:
    """(key, sentence_order, sentence_text, prob, predicted, reasons): one plan of features, nothing joined again."""
    rows = score(matrix(features(docs, key, text, scorer, True), key, "sentence_order", "sentence_text"), model, intercept)
    return with_reasons(rows, model=model).select(key, "sentence_order", "sentence_text", "prob", "predicted", "reasons")


def results(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, result): one JSON text of each document's sentences and summary. rows: as of scored."""
    one = F.struct("sentence_order", F.struct(F.col("sentence_text").alias("text"), F.round("prob", 6).alias("prob_ai"), F.col("predicted").alias("predicted_ai"), "reasons").alias("s"))
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("x"), F.count("*").alias("n"), F.avg("prob").alias("p"), F.count_if("predicted").alias("f"))
    summary = F.struct(F.col("n").alias("n_sentences"), F.round("p", 6).alias("mean_prob_ai"), F.col("f").alias("n_flagged"))
    return docs.select(key, F.to_json(F.struct(F.col("x.s").alias("sentences"), summary.alias("doc_summary"))).alias("result"))


def analyze(spark: SparkSession, text: str, model=None, intercept: float = FIXED_INTERCEPT) -> str:
    """One text's result; an empty one has no sentences."""
    docs = spark.createDataFrame([(0, text)], "doc_id long, doc_text string").where(F.length(T.strip(F.col("doc_text"))) > 0)
    row = results(scored(docs, model=model, intercept=intercept)).first()
    return row["result"] if row else '{"sentences":[],"doc_summary":{"n_sentences":0}}'
