"""Small tables with everything that can be wrong in them."""

from __future__ import annotations

CHUNK = "doc_id string, group_id string, chunk_idx int, chunk_text string, label int, bucket string, gen_model string, prompt_style string, prompt_domain string"
SCHEMAS = {
    "self_ai_fresh_chunks": CHUNK,
    "self_ai_polished_chunks": CHUNK,
    "generation_jobs": "job_id long, doc_id string, chunk_idx int, user_message string, gen_model string, prompt_style string, requested_at timestamp, loaded_at timestamp",
    "doc_manifest": "doc_id string, group_id string, bucket string, doc_text string, n_sentences int, split string",
    "sentence_dataset": "doc_id string, group_id string, sentence_order int, char_start int, char_end int, sentence_text string, label int, bucket string, gen_model string, prompt_style string, prompt_domain string, split string, sentence_uid string",
    "sentence_features": "sentence_uid string, doc_id string, label int, bucket string, split string, gen_model string, sentence_text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, author_id string, collected_at timestamp, loaded_at timestamp",
    "eval_items": "item_id long, bench string, lang string, text string",
    "size_limits": "tokenizer string, max_tokens int, overlap_tokens int",
    "split_targets": "split string, share double",
}
#: columns that operators use inside, as extra columns of every table
CLASHES = ("text", "k", "n", "words", "ids", "path", "kind", "bits", "component", "defect", "count", "piece", "uid", "train", "ord", "src", "state", "cut", "key", "value", "_p")


def write(spark, base: str, rows: dict[str, list[tuple]], clashes: bool = False) -> str:
    from pyspark.sql import functions as F

    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        if clashes:
            have = {c.lower() for c in df.columns}
            df = df.withColumns({c: F.lit("x") for c in CLASHES if c not in have})
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    return base


def chunk(doc, text, idx=0, label=1, bucket="self_ai_fresh", model="m"):
    return (doc, doc, idx, text, label, bucket, model, "plain", "personal")


def job(i, doc, message, idx=0):
    return (i, doc, idx, message, "m", "plain", None, None)


def unit(doc, order, text, group=None, split="train", bucket="b"):
    return (doc, group, order, 0, len(text or ""), text, 1, bucket, "m", "p", "d", split, None if doc is None else f"{doc}_s{order}")


def feature(doc, order, split):
    return (f"{doc}_s{order}", doc, 1, "b", split, "m", None)


def document(i, text, lang="en"):
    return (i, text, lang, "s", None, None, None, None)
