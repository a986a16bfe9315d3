"""Metrics of scored rows: confusion, precision and recall, area under the curve, cohorts, wrong documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.sources import written


def confusion(rows: DataFrame, *group: str) -> DataFrame:
    """(group..., tn, fp, fn, tp, precision, recall, f1); a division by zero gives 0."""
    y, p = F.col("label") == 1, F.col("predicted")
    c = rows.groupBy(*group).agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(rows: DataFrame, prob: str = "prob") -> DataFrame:
    """One row (auc, n, n_positive), by rank sums with ties; null if there is but one class. Scores
    are counted first, then summed up range by range, never in one partition."""
    counts = rows.groupBy(F.col(prob).alias("p")).agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") != 1).alias("n0"))
    sorted_ = written(counts.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "scores")
    sums = sorted_.groupBy("part").agg(F.sum("n0").alias("s0"))
    before = sums.withColumn("b0", F.coalesce(F.sum("s0").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "b0")
    below = F.coalesce(F.sum("n0").over(W.partitionBy("part").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = sorted_.withColumn("below", below).join(F.broadcast(before), "part")
    won = F.sum(F.col("n1") * (F.col("below") + F.col("b0") + F.col("n0") / 2.0))
    pairs = F.sum("n1").cast("double") * F.sum("n0")
    return each.agg(F.try_divide(won, pairs).alias("auc"), (F.sum("n1") + F.sum("n0")).alias("n"), F.sum("n1").alias("n_positive"))


def cohort_rates(rows: DataFrame, cohort: Column) -> DataFrame:
    """(cohort, n, docs, flag_rate) of the rows of each cohort; null cohorts are left out."""
    return rows.withColumn("cohort", cohort).where("cohort is not null").groupBy("cohort").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.avg(F.col("predicted").cast("double")).alias("flag_rate"))


def bias_gap(rates: DataFrame, one: str = "nonnative", other: str = "native") -> DataFrame:
    """One row from cohort_rates: sentences and documents of one cohort, the rates of both, and the gap in
    percentage points."""
    of = lambda c, k: F.max(F.when(F.col("cohort") == k, F.col(c)))
    row = rates.agg(of("n", one).alias("n_sentences"), of("docs", one).alias("n_essays"), of("flag_rate", one).alias("false_positive_rate"), of("n", other).alias("native_n_sentences"), of("flag_rate", other).alias("native_false_positive_rate"))
    return row.withColumn("gap_percentage_points", (F.col("false_positive_rate") - F.col("native_false_positive_rate")) * 100)


def wrong_documents(rows: DataFrame, pure: tuple[str, ...], k: int = 3) -> DataFrame:
    """The k documents of pure buckets that are wrong with the greatest confidence. rows: doc_id, ord,
    label, bucket, sentence_text, prob. The preview gathers texts of those k documents only."""
    docs = rows.where(F.col("bucket").isin(*pure)).groupBy("doc_id").agg(F.avg("prob").alias("mean_prob"), F.min_by("label", "ord").alias("true_label"), F.min_by("bucket", "ord").alias("bucket"), F.count("*").alias("n_sentences"))
    docs = docs.withColumn("pred_label", (F.col("mean_prob") >= 0.5).cast("int")).where("pred_label <> true_label").withColumn("confidence", F.round(F.abs(F.col("mean_prob") - 0.5), 9))
    top = docs.orderBy(F.desc("confidence"), "doc_id").limit(k)
    texts = rows.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "sentence_text"))).alias("s"))
    return top.join(texts.select("doc_id", F.substring(F.array_join(F.col("s.sentence_text"), " "), 1, 400).alias("preview")), "doc_id")


def document_summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_sentences"), F.avg("prob").alias("mean_prob"), F.count_if("predicted").alias("n_flagged"))
