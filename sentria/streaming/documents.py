"""Documents as a stream: the same stateless plan, since a row is a whole document.

Sentences are numbered inside the row, by array functions, as a window by document would need state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentria.functions import text as T


def stream_sentences(docs: DataFrame, key: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """(key, sentence_order, sentence_text) of a batch or stream of documents."""
    return docs.select(key, F.posexplode(T.split_sentences(T.normalize_whitespace(F.col(text)))).alias("sentence_order", "sentence_text"))


def stream_counts(docs: DataFrame, at: str, window: str = "10 minutes", late: str = "30 minutes", text: str = "doc_text") -> DataFrame:
    """Documents and words by window of event time; rows later than ``late`` are left out by the watermark."""
    rows = docs.withWatermark(at, late).select(F.window(at, window).alias("w"), F.size(T.words(F.col(text))).alias("n"))
    return rows.groupBy("w").agg(F.count("*").alias("documents"), F.sum("n").alias("words")).select(F.col("w.start").alias("start"), "documents", "words")
