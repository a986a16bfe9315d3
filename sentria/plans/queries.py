"""The core's queries over the stored tables. Each takes (spark, folder of tables) and is lazy, but for
operators that need a bounded aggregate first."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.functions import text as T
from sentria.config import CONFIG
from sentria.operators import analyze, artifact, corpus, evaluate, generate, history, lm, model, style
from sentria.operators.sentences import length_stats, sentences, word_rows
from sentria.sources import read_table, shared_dir, stages, with_columns_only
from sentria.streaming.documents import stream_counts, stream_sentences

MODELS, STYLES = ["model_a", "model_b"], ["direct", "coached"]
PURE = ("daigt_human", "daigt_ai", "self_ai_fresh", "ell_nonnative")
DIGITS = 6


def r(c: Column | str, name: str | None = None) -> Column:
    """Rounded, as engines add in different orders."""
    out = F.round(F.col(c) if isinstance(c, str) else c, DIGITS) + F.lit(0.0)  # no negative zero
    return out.alias(name or c) if name or isinstance(c, str) else out


def docs(spark: SparkSession, base: str, *more: str) -> DataFrame:
    """Documents with text, repeated rows once."""
    return with_columns_only(read_table(spark, base, "doc_manifest"), "doc_id", "doc_text", *more, distinct=True).where("doc_text is not null")


def texts(spark: SparkSession, base: str) -> DataFrame:
    return with_columns_only(read_table(spark, base, "documents"), "doc_id", "text", "lang", "source").where("text is not null")


def chunks(spark: SparkSession, base: str, name: str = "self_ai_polished_chunks") -> DataFrame:
    return with_columns_only(read_table(spark, base, name), "doc_id", "group_id", "chunk_idx", "chunk_text", "label", "bucket", "gen_model", distinct=True)


def feature_rows(spark: SparkSession, base: str) -> DataFrame:
    """Stored features, one row each, in the fixed order, with what evaluation needs."""
    return model.matrix(read_table(spark, base, "sentence_features"), "sentence_uid", "doc_id", "label", "bucket", "split", "sentence_text").distinct()


def scored_rows(spark: SparkSession, base: str) -> DataFrame:
    return model.score(feature_rows(spark, base))


def normalize_ws(spark, base):
    return texts(spark, base).select("doc_id", T.normalize_whitespace(F.col("text")).alias("normalized"))


def split_sentences(spark, base):
    return sentences(docs(spark, base)).select("doc_id", "sentence_order", "sentence_text")


def sentence_spans(spark, base):
    return sentences(docs(spark, base)).select("doc_id", "sentence_order", "char_start", "char_end")


def stream_split(spark, base):
    return stream_sentences(docs(spark, base))


def word_tokens(spark, base):
    return word_rows(sentences(docs(spark, base)))


def sentence_len_stats(spark, base):
    return length_stats(sentences(docs(spark, base))).select("doc_id", "sentence_order", "n_words", r("mean_len"), r("std_len"), r("len_z"), r("len_dev"))


def _by_sentence(spark, base, **cols: Column) -> DataFrame:
    return sentences(docs(spark, base)).select("doc_id", "sentence_order", *[c.alias(n) for n, c in cols.items()])


S = "sentence_text"


def lexical_density(spark, base):
    w = T.words(F.col(S))
    return _by_sentence(spark, base, avg_word_len=r(T.mean_word_length(w)), unique_ratio=r(T.unique_ratio(w)))


def punct_rates(spark, base):
    c = F.col(S)
    return _by_sentence(spark, base, comma_rate=r(T.comma_rate(c)), semicolon_dash_rate=r(T.semicolon_dash_rate(c)), punct_density=r(T.punctuation_density(c)))


def contractions(spark, base):
    return _by_sentence(spark, base, n=T.contraction_count(F.col(S)).cast("int"))


def tell_words(spark, base):
    return texts(spark, base).select("doc_id", T.tell_count(F.col("text")).cast("int").alias("n"))


def _lexis(spark, base, name):
    return style.document_lexis(docs(spark, base)).select("doc_id", r(name))


def mattr(spark, base):
    return _lexis(spark, base, "doc_mattr")


def bigram_repetition(spark, base):
    return _lexis(spark, base, "doc_bigram_repetition_rate")


def trigram_repetition(spark, base):
    return _lexis(spark, base, "doc_trigram_repetition_rate")


def local_bigram_overlap(spark, base):
    d = docs(spark, base)
    return style.bigram_overlap(d, sentences(d)).select("doc_id", "sentence_order", r("overlap"))


def style_features(spark, base):
    return style.style_features(docs(spark, base)).select("doc_id", "sentence_order", *[r(c) for c in style.SENTENCE_FEATURES + style.DOCUMENT_FEATURES])


def dedup_docs(spark, base):
    """The first document of each text, with a surrogate key by position."""
    kept = corpus.dedup(texts(spark, base), "text", "doc_id")
    return corpus.numbered(kept.select("doc_id", "source"), "daigt", "doc_id").select("doc_id", "source", "essay_uid")


def seeded_sample(spark, base):
    return corpus.seeded_sample(texts(spark, base).select("doc_id", "lang"), "doc_id", 220)


def exclude_polished_sources(spark, base):
    """Documents whose group isn't the source of a reworked one."""
    return corpus.exclude(docs(spark, base, "group_id").select("doc_id", "group_id").distinct(), chunks(spark, base), "group_id")


def union_corpora(spark, base):
    parts = {"fresh": chunks(spark, base, "self_ai_fresh_chunks"), "polished": chunks(spark, base)}
    return corpus.union_tagged(parts).select("doc_id", "chunk_idx", "label", "gen_model", "hf_split")


def reconstruct_docs(spark, base):
    return corpus.reconstruct(chunks(spark, base))


def chunk_ranges(spark, base):
    return corpus.chunk_ranges(chunks(spark, base)).select("doc_id", "chunk_idx", "c_start", "c_end")


def midpoint_labels(spark, base):
    return corpus.midpoint_labels(chunks(spark, base).select("doc_id", "group_id", "chunk_idx", "chunk_text", "label")).select("doc_id", "sentence_order", "chunk_idx", "label")


def sentence_dataset(spark, base):
    """Sentences of the chunked documents, as a table to train on."""
    rows = corpus.midpoint_labels(chunks(spark, base).drop("group_id"))
    return rows.select("doc_id", "sentence_order", "char_start", "char_end", "sentence_text", "label", "bucket", "gen_model", F.concat("doc_id", F.lit("_s"), F.col("sentence_order").cast("string")).alias("sentence_uid"))


def group_split(spark, base):
    return corpus.group_split(docs(spark, base, "group_id"), "group_id", 0.2)


def split_counts(spark, base):
    rows = with_columns_only(read_table(spark, base, "sentence_dataset"), "sentence_uid", "split", "label", distinct=True)
    return rows.groupBy("split", "label").agg(F.count("*").alias("n"))


def docs_per_bucket(spark, base):
    rows = with_columns_only(read_table(spark, base, "sentence_dataset"), "doc_id", "bucket", "sentence_uid")
    return rows.groupBy("bucket").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("sentence_uid").alias("sentences"))


def job_cross(spark, base):
    """Every model with every style for each question, in batches of eight by hashed order."""
    asked = with_columns_only(read_table(spark, base, "generation_jobs"), "user_message", distinct=True).where("user_message is not null")
    each = asked.select("user_message", F.explode(F.array(*map(F.lit, MODELS))).alias("model")).select("user_message", "model", F.explode(F.array(*map(F.lit, STYLES))).alias("style"))
    each = each.withColumn("h", F.md5(F.concat_ws("|", "user_message", "model", "style")))
    return each.join(corpus.global_rank(each, "h"), "h").select("user_message", "model", "style", F.floor(F.col("rank0") / 8).cast("long").alias("batch"))


def round_robin(spark, base):
    return corpus.round_robin(chunks(spark, base).select("doc_id").distinct(), "doc_id", MODELS)


def subset_per_group(spark, base):
    return corpus.subset_per_group(chunks(spark, base).select("doc_id", "chunk_idx").distinct(), "doc_id", "chunk_idx", 0.4, 0.7)


def polish_merge(spark, base):
    plan = chunks(spark, base).select("doc_id", "chunk_idx", "chunk_text", F.lit("model_a").alias("model"))
    done = chunks(spark, base).where("label = 1 and length(chunk_text) >= 40").select("doc_id", "chunk_idx", F.concat(F.lit("Again: "), "chunk_text").alias("polished"))
    return corpus.polish_merge(plan, done)


def clean_text(spark, base):
    return chunks(spark, base, "self_ai_fresh_chunks").where("chunk_text is not null").select("doc_id", "chunk_idx", T.clean_essay(F.col("chunk_text")).alias("cleaned"))


def paragraph_chunks(spark, base):
    return corpus.paragraph_chunks(texts(spark, base), "doc_id", "text")


def _scores(spark, base):
    return lm.bigram_scores(word_rows(sentences(docs(spark, base))))


def lm_token_stats(spark, base):
    return _scores(spark, base).select("doc_id", "sentence_order", "pos", r("nll"), F.col("rank").cast("int").alias("rank"))


def token_to_sentence(spark, base):
    """Tokens between spaces, by offset, to the sentences that hold them."""
    d = docs(spark, base)
    from pyspark.sql import Window as W

    cut = d.select("doc_id", F.posexplode(F.split(T.normalize_whitespace(F.col("doc_text")), " ")).alias("i", "t"))
    start = F.sum(F.length("t") + 1).over(W.partitionBy("doc_id").orderBy("i")) - F.length("t") - 1
    tokens = cut.select("doc_id", start.alias("char_start"))
    return lm.token_to_sentence(tokens, sentences(d)).groupBy("doc_id", "sentence_order").agg(F.count("*").alias("n_tokens"), F.min("char_start").alias("first_start"))


def sentence_signals(spark, base):
    s = sentences(docs(spark, base))
    return lm.sentence_signals(s, lm.bigram_scores(word_rows(s))).select("doc_id", "sentence_order", *[r(c) for c in lm.SIGNALS])


def doc_perplexity(spark, base):
    return lm.doc_perplexity(_scores(spark, base)).select("doc_id", r("doc_perplexity"), r("doc_mean_rank"))


def nll_ratio(spark, base):
    d = with_columns_only(read_table(spark, base, "doc_manifest"), "doc_id", "doc_text")
    return lm.document_ratio(d).select("doc_id", r("ratio"))


def feature_matrix(spark, base):
    return feature_rows(spark, base).select("sentence_uid", *[r(c) for c in model.FEATURES])


def scaler_fit(spark, base):
    return model.scaler(feature_rows(spark, base).where("split = 'train'")).select("name", r("mean"), r("scale"))


def class_weights(spark, base):
    return model.class_weights(feature_rows(spark, base).where("split = 'train'")).select("label", r("weight"))


def linear_score(spark, base):
    return scored_rows(spark, base).select("sentence_uid", "split", r("prob"), "predicted")


def contributions(spark, base):
    return model.contributions(scored_rows(spark, base), "sentence_uid").select("sentence_uid", "name", r("z"), r("contribution"))


def top_reasons(spark, base):
    return model.top_reasons(scored_rows(spark, base), "sentence_uid").select("sentence_uid", "predicted", F.array_join("reasons", " ").alias("reasons"))


def doc_summary(spark, base):
    return evaluate.document_summary(scored_rows(spark, base)).select("doc_id", "n_sentences", r("mean_prob"), "n_flagged")


def confusion(spark, base):
    c = evaluate.confusion(scored_rows(spark, base).where("split is not null"), "split")
    return c.select("split", "tn", "fp", "fn", "tp", r("precision"), r("recall"), r("f1"))


def roc_auc(spark, base):
    return evaluate.roc_auc(scored_rows(spark, base).where("split = 'test'").withColumn("prob", F.round("prob", 9))).select(r("auc"), "n", "n_positive")


def cohort_bias(spark, base):
    return evaluate.cohort_rates(scored_rows(spark, base), _cohort()).select("cohort", "n", "docs", r("flag_rate"))


def confident_wrong(spark, base):
    order = F.regexp_extract("sentence_uid", r"_s(\d+)$", 1).cast("int")
    rows = scored_rows(spark, base).where("split = 'test'").withColumn("ord", order)
    return evaluate.wrong_documents(rows, PURE).select("doc_id", "bucket", "true_label", "pred_label", r("mean_prob"), "n_sentences", "preview")


def history_topk(spark, base):
    rows = with_columns_only(read_table(spark, base, "events"), "event_id", "user_id", "ts", "value", distinct=True)
    return history.latest(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "rn")


def valid_texts(spark, base):
    ok, bad = history.valid_texts(with_columns_only(read_table(spark, base, "documents"), "doc_id", "text"), "text")
    return ok.select("doc_id", F.lit("ok").alias("status")).unionByName(bad.select("doc_id", F.col("error").alias("status")))


def text_preview(spark, base):
    return texts(spark, base).select("doc_id", T.preview(F.col("text")).alias("preview"))


def html_escape(spark, base):
    return chunks(spark, base, "self_ai_fresh_chunks").where("chunk_text is not null").select("doc_id", "chunk_idx", T.escape_html(F.col("chunk_text")).alias("escaped"))


def prob_color(spark, base):
    p = F.floor(F.col("prob") * 1000) / 1000.0 + 0.0002  # off the ties, which formats round differently
    return scored_rows(spark, base).select("sentence_uid", T.prob_color(p).alias("color"), T.prob_glow(p).alias("glow"), T.percent(p).alias("shown"))


def all_features(spark, base):
    """Signals and style of each sentence, computed from the texts."""
    return analyze.features(docs(spark, base)).select("doc_id", "sentence_order", *[r(c) for c in lm.SIGNALS + style.SENTENCE_FEATURES + style.DOCUMENT_FEATURES])


def result_json(spark, base):
    """Each document's result as one JSON text."""
    return analyze.results(analyze.scored(docs(spark, base)))


def logreg_fit(spark, base):
    fitted = model.fit_logreg(feature_rows(spark, base).where("split = 'train'"))
    rows = [(n, float(c)) for n, c in zip(model.FEATURES, fitted.coefficients)] + [("intercept", float(fitted.intercept))]
    return spark.createDataFrame(rows, "name string, coef double")


def gbt_fit(spark, base):
    """Twenty rounds; fit_gbt's default is 200."""
    fitted = model.fit_gbt(feature_rows(spark, base).where("split = 'train'"), rounds=20)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(model.FEATURES, fitted.featureImportances.toArray())], "name string, importance double")


def _saved(spark, fitted: artifact.Linear) -> artifact.Linear:
    at = f"{shared_dir(spark)}/sentria/model-{uuid.uuid4().hex}"
    fitted.save(spark, at)
    return artifact.load(spark, at)


def saved_model_score(spark, base):
    """Scores by a model that was saved and loaded again."""
    return _saved(spark, artifact.fixed()).score(feature_rows(spark, base)).select("sentence_uid", "split", r("prob"), "predicted")


def fitted_scores(spark, base):
    """Trained, saved, loaded: the test rows' scores and reasons."""
    rows = feature_rows(spark, base)
    fitted = _saved(spark, artifact.train(rows.where("split = 'train'")))
    scored = model.with_reasons(fitted.score(rows.where("split = 'test'")), model=list(fitted.terms))
    return scored.select("sentence_uid", "label", r("prob"), "predicted", F.array_join("reasons", " ").alias("reasons"))


def _cohort() -> Column:
    return F.when(F.col("bucket") == "ell_nonnative", "nonnative").when((F.col("split") == "test") & (F.col("bucket") == "daigt_human"), "native")


def bias_gap(spark, base):
    g = evaluate.bias_gap(evaluate.cohort_rates(scored_rows(spark, base), _cohort()))
    return g.select("n_sentences", "n_essays", r("false_positive_rate"), "native_n_sentences", r("native_false_positive_rate"), r("gap_percentage_points"))


def evaluation_report(spark, base):
    """Trained on the train rows; one JSON text of metrics, bias and examples on the test rows."""
    rows = feature_rows(spark, base).withColumn("ord", F.regexp_extract("sentence_uid", r"_s(\d+)$", 1).cast("int"))
    return artifact.report(rows, artifact.train(rows.where("split = 'train'")), PURE, _cohort())


def _stub_model():
    """A model that can be replayed: it knows the word before and how far it has read."""
    return lambda words: [((len(words[i]) + i % 7) / 10.0, i % 5) for i in range(len(words) - 1)]


def windowed_scores(spark, base):
    """The windowed scorer with a stub and short windows."""
    d = docs(spark, base).select("doc_id", T.tokens(F.col("doc_text")).alias("tokens"))
    return lm.windowed(d, _stub_model, window=16, stride=8).select("doc_id", "pos", r("nll"), "rank")


def word_bounds(spark, base):
    """Which bounds of words each chunk meets."""
    n = generate.word_count(F.col("chunk_text"))
    rows = chunks(spark, base, "self_ai_fresh_chunks").where("chunk_text is not null").select("doc_id", "chunk_idx", n.alias("n"))
    return rows.select("*", (F.col("n") >= CONFIG.essay_words).alias("essay"), (F.col("n") >= CONFIG.rework_words).alias("rework"), (F.col("n") >= CONFIG.reworked_words).alias("reworked"), (F.col("n") >= CONFIG.sentence_words).alias("sentence"))


def style_per_document(spark, base):
    return corpus.choice_per_group(chunks(spark, base).where("doc_id is not null").select("doc_id").distinct(), "doc_id", STYLES)


def filled_templates(spark, base):
    asked = with_columns_only(read_table(spark, base, "generation_jobs"), "job_id", "user_message", "prompt_style", distinct=True)
    return asked.select("job_id", generate.filled("Write in style {style}.\n\nPrompt: {prompt}", style=F.col("prompt_style"), prompt=F.col("user_message")).alias("message")).distinct()


def _stub_generator():
    def run(messages: list[str]) -> list[str]:
        return ["Title: an answer\n" + f"{m} " * 4 for m in messages]

    return run


def generated_essays(spark, base):
    """Batched generation with a stub: answers cleaned, of 80 words or more."""
    asked = with_columns_only(read_table(spark, base, "generation_jobs"), "job_id", "user_message", distinct=True).where("user_message is not null")
    return generate.kept(generate.generated(asked, _stub_generator, "user_message")).select("job_id", "chunk_text").distinct()


def _first_word(text: str | None) -> str:
    return text.split()[0]


def row_errors(spark, base):
    """A function that fails on some rows: what it gave, and the kind of error of the others."""
    rows = generate.with_errors(with_columns_only(read_table(spark, base, "documents"), "doc_id", "text"), "text", _first_word)
    return rows.select("doc_id", F.coalesce(F.length("result"), F.lit(-1)).alias("length"), F.substring_index("error", ":", 1).alias("error"))


def single_split(spark, base):
    """The documents of the preferred split of those there are."""
    rows = docs(spark, base, "split").where("split is not null").select("doc_id", F.lower(F.trim("split")).alias("split")).distinct()
    names = sorted(x["split"] for x in rows.select("split").distinct().collect())
    return rows.where(F.col("split") == stages.preferred(names)) if names else rows


def stream_window_counts(spark, base):
    """Documents as a stream, in windows of a day of event time, through readStream and writeStream."""
    schema = read_table(spark, base, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{base}/documents.parquet*")
    at = f"{shared_dir(spark)}/sentria/stream-{uuid.uuid4().hex}"
    counts = stream_counts(stream, "collected_at", "1 day", "30 minutes", text="text")
    query = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{at}-state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(at)).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(at).select(F.unix_timestamp("start").alias("start"), "documents", F.coalesce("words", F.lit(0)).alias("words"))
