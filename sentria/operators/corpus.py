"""Building of a labelled corpus: union, dedup, sampling, chunks to documents, labels, splits, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.functions import text as T
from sentria.operators.sentences import sentences
from sentria.sources import written

SEED = "42"


def union_tagged(parts: dict[str, DataFrame], tag: str = "hf_split") -> DataFrame:
    """All parts, by column name, each tagged with its name; missing columns are null."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    if not frames:
        raise ValueError("no part to unite")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def text_column(columns: list[str]) -> str:
    """The first column named after text but no id."""
    return next(c for c in columns if "text" in c.lower() and "id" not in c.lower())


def dedup(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row, by order, of each text."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(text).orderBy(order))).where("_rn = 1").drop("_rn")


def numbered(df: DataFrame, prefix: str, order: str, name: str = "essay_uid") -> DataFrame:
    """A surrogate key, prefix and six digits, from the position in a given order. Ranks come from a
    range-partitioned sort and each partition's offset, not from one task with all rows."""
    return df.join(global_rank(df.select(order), order), order).withColumn(name, F.format_string(prefix + "_%06d", F.col("rank0"))).drop("rank0")


def global_rank(df: DataFrame, key: str, name: str = "rank0") -> DataFrame:
    """(key, rank from 0) of rows with a unique key, without gathering them in one partition."""
    # written, so that rows and sizes see the same ranges
    sorted_ = written(df.select(key).repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    sorted_ = sorted_.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1)
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return sorted_.join(F.broadcast(before), "_p").select(key, (F.col("_b") + F.col("_i")).alias(name))


def hashed(*cols: Column | str) -> Column:
    """A deterministic order: the same digest in any engine."""
    return F.md5(F.concat(F.lit(SEED), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def seeded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """min(n, rows) rows: the first in hashed order."""
    return df.orderBy(hashed(key), key).limit(n)


def subset_per_group(df: DataFrame, group: str, item: str, low: float, high: float) -> DataFrame:
    """Of each group's rows a part between low and high, at least one, chosen by hash."""
    u = F.conv(F.substring(hashed(group), 1, 6), 16, 10).cast("double") / float(16**6)
    n = F.count("*").over(W.partitionBy(group))
    most = F.greatest(F.lit(1), F.floor(n * (F.lit(low) + u * (high - low))).cast("int"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(hashed(group, item), item))
    return df.withColumn("_most", most).withColumn("_rank", rank).where("_rank <= _most").drop("_most", "_rank")


def choice_per_group(df: DataFrame, group: str, names: list[str], name: str = "style") -> DataFrame:
    """df with one of some names for each group, by hash."""
    u = F.conv(F.substring(hashed(group), 7, 6), 16, 10).cast("long")
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, names)), (u % len(names)).cast("int") + 1))


def exclude(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among others'."""
    return df.join(others.select(key).distinct(), key, "left_anti")


def paragraph_chunks(df: DataFrame, key: str, text: str, per_chunk: int = 3) -> DataFrame:
    """(key, chunk_idx, chunk_text): paragraphs, if there are at least two; else sentences in groups;
    else the text itself. Both arrays are made once, in columns of their own."""
    both = df.select(key, text, T.paragraphs(F.col(text)).alias("_p"))
    both = both.withColumn("_s", F.when(F.size("_p") < 2, T.split_sentences(T.normalize_whitespace(F.col(text)))))
    groups = F.transform(F.sequence(F.lit(1), F.size("_s"), F.lit(per_chunk)), lambda i: F.array_join(F.slice("_s", i, per_chunk), " "))
    cut = F.when(F.size("_p") >= 2, F.col("_p")).when(F.size("_s") > 0, groups).otherwise(F.array(text))
    return both.select(key, F.posexplode(cut).alias("chunk_idx", "chunk_text"))


def chunk_ranges(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with their normalized text and half-open range in the joined document; an empty chunk
    takes no place."""
    own = W.partitionBy(key).orderBy("chunk_idx")
    c = chunks.withColumn("norm", F.coalesce(T.normalize_whitespace(F.col("chunk_text")), F.lit("")))
    size = F.length("norm") + F.when(F.length("norm") > 0, 1).otherwise(0)
    c = c.withColumn("_e", F.sum(size).over(own))
    end = F.greatest(F.col("_e") - 1, F.lit(0))
    return c.withColumn("c_start", F.when(F.length("norm") > 0, end - F.length("norm")).otherwise(end).cast("int")).withColumn("c_end", end.cast("int")).drop("_e")


def reconstruct(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, doc_text) of documents joined from their normalized chunks; empty ones are left out."""
    c = chunks.withColumn("norm", F.coalesce(T.normalize_whitespace(F.col("chunk_text")), F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(F.length("norm") > 0, F.struct("chunk_idx", "norm"))))
    return c.groupBy(key).agg(parts.alias("p")).select(key, F.array_join(F.col("p.norm"), " ").alias("doc_text")).where("doc_text <> ''")


def midpoint_labels(chunks: DataFrame, key: str = "doc_id", least_words: int = 3) -> DataFrame:
    """Sentences of the joined documents, each with the columns of the chunk that holds its middle;
    where no chunk does (a joining space), of the last chunk. Short sentences are left out after
    they were numbered."""
    ranges = chunk_ranges(chunks, key)
    sents = sentences(reconstruct(chunks, key), key).where(F.size(T.tokens(F.col("sentence_text"))) >= least_words)
    mid = F.floor((F.col("char_start") + F.col("char_end")) / 2)
    cols = [c for c in chunks.columns if c not in (key, "chunk_text")]
    last = ranges.groupBy(key).agg(*[F.max_by(c, "chunk_idx").alias(f"last_{c}") for c in cols])
    r = ranges.select(F.col(key).alias("_k"), "c_start", "c_end", *cols)
    got = sents.join(r, (sents[key] == F.col("_k")) & (mid >= F.col("c_start")) & (mid < F.col("c_end")), "left").join(last, key)
    return got.select(key, "sentence_order", "char_start", "char_end", "sentence_text", *[F.coalesce(c, f"last_{c}").alias(c) for c in cols])


def group_split(groups: DataFrame, group: str, share: float) -> DataFrame:
    """(group, split): test for the first ceil(share * n) groups in hashed order, else train."""
    ranked = groups.where(F.col(group).isNotNull()).select(group).distinct().withColumn("h", F.concat(hashed(group), F.col(group)))
    n = ranked.count()
    ranks = global_rank(ranked, "h")
    most = -(-int(n * share * 1_000_000) // 1_000_000)
    return ranked.join(ranks, "h").select(group, F.when(F.col("rank0") < most, "test").otherwise("train").alias("split"))


def round_robin(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, position, name): names in turn, by the order of key."""
    return global_rank(df, key, "position").withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("position") % len(names)).cast("int") + 1))


def polish_merge(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks of a plan with the reworked text where there is one (label 1), else as they were
    (label 0); documents without any success are left out."""
    joined = plan.join(results, ["doc_id", "chunk_idx"], "left")
    ok = F.col("polished").isNotNull()
    out = joined.withColumns({"label": ok.cast("int"), "out_text": F.coalesce("polished", "chunk_text"), "out_model": F.when(ok, F.col("model")).otherwise(F.lit("human")), "any_ok": F.max(ok).over(W.partitionBy("doc_id"))})
    return out.where("any_ok").select("doc_id", "chunk_idx", F.col("out_text").alias("chunk_text"), "label", F.col("out_model").alias("gen_model"))
