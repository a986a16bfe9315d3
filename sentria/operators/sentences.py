"""Documents to ordered sentences with exact offsets, and the tokens of sentences.

One window by document numbers the sentences; everything later that is partitioned by the same key
uses the same exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.functions import text as T


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """docs' other columns, and sentence_order, char_start, char_end, sentence_text; offsets count
    code points of the normalized text. Null and blank documents have no sentences."""
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, F.posexplode(T.split_pieces(T.normalize_whitespace(F.col(text)))).alias("k", "piece"))
    own = W.partitionBy(key).orderBy("k")
    s = F.when(F.col("k") == 0, F.col("piece")).otherwise(F.regexp_replace("piece", r"(?U)^\s+", ""))
    placed = cut.withColumn("end", F.sum(F.length("piece")).over(own)).withColumn("sentence_text", s).where(F.length(T.strip(F.col("sentence_text"))) > 0)
    return placed.select(
        *rest,
        (F.row_number().over(own) - 1).alias("sentence_order"),
        (F.col("end") - F.length("sentence_text")).cast("int").alias("char_start"),
        F.col("end").cast("int").alias("char_end"),
        "sentence_text",
    )


def word_rows(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_order, pos, word): the words of each sentence in order, pos by document."""
    rows = sents.select(key, "sentence_order", F.posexplode(T.words(F.col("sentence_text"))).alias("i", "word"))
    return rows.select(key, "sentence_order", (F.row_number().over(W.partitionBy(key).orderBy("sentence_order", "i")) - 1).alias("pos"), "word")


def length_stats(sents: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_words of each sentence in its document: mean and population deviation of the lengths (at
    least 1 each), z-score (0 if the deviation is at most 1e-6) and absolute deviation ratio."""
    doc = W.partitionBy(key)
    n = sents.withColumn("n_words", F.size(T.words(F.col("sentence_text"))))
    clamped = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    n = n.withColumn("mean_len", F.avg(clamped).over(doc)).withColumn("std_len", F.stddev_pop(clamped).over(doc))
    z = F.when(F.col("std_len") > 1e-6, (F.col("n_words") - F.col("mean_len")) / F.col("std_len")).otherwise(F.lit(0.0))
    return n.withColumn("len_z", z).withColumn("len_dev", F.abs(F.col("n_words") - F.col("mean_len")) / F.greatest(F.col("mean_len"), F.lit(1.0)))
