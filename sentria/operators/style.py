"""The style features: nine of the sentence, two of the sentence in its document, nine of the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.functions import text as T
from sentria.operators.sentences import length_stats, sentences

#: Order is part of the contract.
SENTENCE_FEATURES = ["sent_len_words", "sent_avg_word_len", "sent_comma_rate", "sent_semicolon_dash_rate", "sent_punct_density", "sent_contraction_rate", "sent_ai_tell_count", "sent_unique_word_ratio", "sent_local_bigram_overlap", "sent_len_zscore_in_doc", "sent_len_abs_dev_ratio"]
DOCUMENT_FEATURES = ["doc_sentence_count", "doc_mean_sentence_len", "doc_sentence_len_cv", "doc_mattr", "doc_bigram_repetition_rate", "doc_trigram_repetition_rate", "doc_contraction_rate", "doc_ai_tell_rate", "doc_comma_per_sentence"]


def per_hundred(count: Column, words: Column) -> Column:
    return count * 100.0 / F.greatest(words, F.lit(1))


def bigram_overlap(docs: DataFrame, sents: DataFrame, key: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """(key, sentence_order, overlap): the share of a sentence's distinct bigrams that occur in the
    document more often than in the sentence. The document's bigrams cross sentence ends."""
    grams = lambda df, cols, c: df.select(*cols, F.explode(T.ngrams(T.words(c), 2)).alias("bigram"))
    own = grams(sents, [key, "sentence_order"], F.col("sentence_text")).groupBy(key, "sentence_order", "bigram").agg(F.count("*").alias("n"))
    whole = grams(docs, [key], T.normalize_whitespace(F.col(text))).groupBy(key, "bigram").agg(F.count("*").alias("n_doc"))
    shared = own.join(whole, [key, "bigram"]).groupBy(key, "sentence_order").agg((F.count_if(F.col("n_doc") > F.col("n")).cast("double") / F.count("*")).alias("overlap"))
    return sents.select(key, "sentence_order").join(shared, [key, "sentence_order"], "left").select(key, "sentence_order", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def document_lexis(docs: DataFrame, key: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """(key, n_words, mattr, bigram and trigram repetition) of each document, row by row."""
    w = docs.select(key, T.lowered(T.words(T.normalize_whitespace(F.col(text)))).alias("w"))
    g = w.select(key, "w", T.ngrams(F.col("w"), 2).alias("g2"), T.ngrams(F.col("w"), 3).alias("g3"))
    return g.select(key, F.size("w").alias("n_doc_words"), T.mattr(F.col("w")).alias("doc_mattr"), T.repetition(F.col("g2")).alias("doc_bigram_repetition_rate"), T.repetition(F.col("g3")).alias("doc_trigram_repetition_rate"))


def style_features(docs: DataFrame, key: str = "doc_id", text: str = "doc_text", keep_text: bool = False) -> DataFrame:
    """(key, sentence_order[, sentence_text], the twenty features) of each sentence."""
    sents = sentences(docs.select(key, text), key, text)
    doc = W.partitionBy(key)
    s = F.col("sentence_text")
    base = length_stats(sents, key).withColumns({"w": T.words(s), "contractions": T.contraction_count(s), "tells": T.tell_count(s), "commas": T.count_of(s, ",")})
    base = base.withColumns({"doc_n": F.count("*").over(doc), "doc_contractions": F.sum("contractions").over(doc), "doc_tells": F.sum("tells").over(doc), "doc_commas": F.sum("commas").over(doc)})
    rows = base.join(bigram_overlap(docs, sents, key, text), [key, "sentence_order"]).join(document_lexis(docs, key, text), key)
    return rows.select(
        key,
        "sentence_order",
        *(["sentence_text"] if keep_text else []),
        F.col("n_words").cast("double").alias("sent_len_words"),
        T.mean_word_length(F.col("w")).alias("sent_avg_word_len"),
        T.comma_rate(s).alias("sent_comma_rate"),
        T.semicolon_dash_rate(s).alias("sent_semicolon_dash_rate"),
        T.punctuation_density(s).alias("sent_punct_density"),
        per_hundred(F.col("contractions"), F.col("n_words")).alias("sent_contraction_rate"),
        F.col("tells").cast("double").alias("sent_ai_tell_count"),
        T.unique_ratio(F.col("w")).alias("sent_unique_word_ratio"),
        F.col("overlap").alias("sent_local_bigram_overlap"),
        F.col("len_z").alias("sent_len_zscore_in_doc"),
        F.col("len_dev").alias("sent_len_abs_dev_ratio"),
        F.col("doc_n").cast("double").alias("doc_sentence_count"),
        F.col("mean_len").alias("doc_mean_sentence_len"),
        (F.col("std_len") / F.col("mean_len")).alias("doc_sentence_len_cv"),
        "doc_mattr",
        "doc_bigram_repetition_rate",
        "doc_trigram_repetition_rate",
        per_hundred(F.col("doc_contractions"), F.col("n_doc_words")).alias("doc_contraction_rate"),
        per_hundred(F.col("doc_tells"), F.col("n_doc_words")).alias("doc_ai_tell_rate"),
        (F.col("doc_commas").cast("double") / F.greatest(F.col("doc_n"), F.lit(1))).alias("doc_comma_per_sentence"),
    )
