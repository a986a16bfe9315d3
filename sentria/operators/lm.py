"""The default token scorer: a bigram model counted from the corpus itself.

A token is scored by what stands before it in its document; the first one isn't scored. Any other
scorer that gives (key, sentence_order, pos, nll, rank) can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.config import CONFIG
from sentria.functions import text as T

SIGNALS = ["sig_mean_nll", "sig_perplexity", "sig_mean_rank", "sig_median_rank", "sig_frac_top1", "sig_frac_top10", "sig_frac_top50", "sig_surprisal_std", "sig_max_surprisal", "sig_doc_perplexity"]
K = 0.5
#: Bytes of text that are counted together, on average; a fixed size, whatever the corpus.
BLOCK = 16_000_000
#: Each byte of a text as a word's letter in lower case, or as a space.
LETTERS = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalpha() or chr(b) == "'") else 32 for b in range(256))

TokenScorer = Callable[[DataFrame], DataFrame]


def bigram_scores(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_order, pos, word, nll, rank) of word_rows. rank counts the strictly more frequent
    successors of the word before."""
    w = words.withColumn("w", F.lower("word")).withColumn("c", F.lag(F.lower("word")).over(W.partitionBy(key).orderBy("pos"))).where("c is not null")
    counts = w.groupBy("c", "w").agg(F.count("*").alias("n"))
    context = W.partitionBy("c")
    table = counts.withColumn("rank", F.rank().over(context.orderBy(F.desc("n"))) - 1).withColumn("n_c", F.sum("n").over(context))
    vocabulary = F.broadcast(w.agg(F.countDistinct("w").alias("v")))  # one row
    table = table.join(vocabulary, F.lit(True), "inner").withColumn("nll", -F.log((F.col("n") + F.lit(K)) / (F.col("n_c") + F.lit(K) * F.col("v"))))
    return w.join(table.select("c", "w", "nll", "rank"), ["c", "w"]).select(key, "sentence_order", "pos", "word", "nll", "rank")


def unigram_scores(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_order, pos, nll) by word frequency: a second, weaker model."""
    w = words.withColumn("w", F.lower("word"))
    counts = w.groupBy("w").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("n_all"), F.count("*").alias("v")))  # one row
    table = counts.join(total, F.lit(True), "inner").withColumn("nll", -F.log((F.col("n") + F.lit(K)) / (F.col("n_all") + F.lit(K) * F.col("v"))))
    return w.where("pos > 0").join(table.select("w", "nll"), "w").select(key, "sentence_order", "pos", "nll")


def windowed(tokens: DataFrame, make: Callable[[], Callable[[list[str]], list[tuple[float, int]]]], key: str = "doc_id", window: int = CONFIG.lm_window, stride: int = CONFIG.lm_stride) -> DataFrame:
    """(key, pos, nll, rank) of tokens(key, tokens) by a model that reads at most ``window`` tokens: the window
    moves on by ``stride``, and where windows overlap the first one that scores a token wins. ``make``
    builds the model once in a task; it gives (nll, rank) of every token but the first of what it
    reads. Documents are read one after another in Arrow batches."""
    if not 0 < stride < window:
        raise ValueError("windows have to overlap and to move on")
    kind = dict(tokens.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for b in batches:
            at, pos, nll, rank = [], [], [], []
            for k, words in enumerate(b.column(1).to_pylist()):
                n, start, done = len(words or ()), 0, 0
                while start < n:
                    end = min(start + window, n)
                    for i, (x, r) in enumerate(score(words[start:end])):
                        if start + i + 1 > done:
                            at.append(k)
                            pos.append(start + i + 1)
                            nll.append(x)
                            rank.append(r)
                    done = end - 1
                    if end == n:
                        break
                    start += stride
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(nll, pa.float64()), pa.array(rank, pa.int32())], [key, "pos", "nll", "rank"])

    return tokens.select(key, "tokens").mapInArrow(run, f"`{key}` {kind}, pos int, nll double, rank int")


def token_to_sentence(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokens(key, char_start) with the sentence that holds each: the first whose end lies behind its
    start; tokens behind the last end belong to the last sentence."""
    own = W.partitionBy(key).orderBy("sentence_order")
    s = spans.select(key, "sentence_order", F.lag("char_end", 1, 0).over(own).alias("low"), F.when(F.lead("char_end").over(own).isNull(), F.lit(2**31 - 1)).otherwise(F.col("char_end")).alias("high"))
    s = s.withColumnRenamed(key, "_k")
    return tokens.join(s, (tokens[key] == F.col("_k")) & (F.col("char_start") >= F.col("low")) & (F.col("char_start") < F.col("high"))).drop("_k", "low", "high")


def sentence_signals(sents: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sentence_order, the ten signals); all are 0 for a sentence without scored tokens."""
    share = lambda n: F.avg((F.col("rank") < n).cast("double"))
    own = scores.groupBy(key, "sentence_order").agg(
        F.avg("nll").alias("sig_mean_nll"), F.exp(F.avg("nll")).alias("sig_perplexity"), F.avg("rank").alias("sig_mean_rank"),
        F.expr("percentile_disc(0.5) within group (order by rank)").cast("double").alias("sig_median_rank"),
        share(1).alias("sig_frac_top1"), share(10).alias("sig_frac_top10"), share(50).alias("sig_frac_top50"),
        F.coalesce(F.stddev_samp("nll"), F.lit(0.0)).alias("sig_surprisal_std"), F.max("nll").alias("sig_max_surprisal"),
    )
    doc = scores.groupBy(key).agg(F.exp(F.avg("nll")).alias("sig_doc_perplexity"))
    rows = sents.select(key, "sentence_order").join(own.join(doc, key), [key, "sentence_order"], "left")
    return rows.select(key, "sentence_order", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SIGNALS])


def doc_perplexity(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    return scores.groupBy(key).agg(F.exp(F.avg("nll")).alias("doc_perplexity"), F.avg("rank").alias("doc_mean_rank"))


def nll_ratio(observer: DataFrame, performer: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ratio): mean surprisal of one model over another's; null below two tokens or at 0."""
    o = observer.groupBy(key).agg(F.avg("nll").alias("a"), F.count("*").alias("n"))
    p = performer.groupBy(key).agg(F.avg("nll").alias("b"))
    return o.join(p, key).select(key, F.when(F.col("n") >= 2, F.expr("try_divide(a, b)")).alias("ratio"))


def _counted(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: their different words, sorted; each word's code, then of all words but a text's first: text,
    code of the word before and own code; the different pairs as code before * words + code, sorted,
    and each pair's place there. The same texts in any order have the same words and pairs."""
    a = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks] or [pa.array([], pa.large_string())])
    at = np.frombuffer(a.buffers()[1] or b"\0" * 8, np.int64)[a.offset : a.offset + len(a) + 1]
    coded, text = [], []
    for k in range(0, max(len(a), 1), 1000):  # a few texts at a time, as words take more memory than texts
        part = at[k : k + 1001]
        raw = bytes(memoryview(a.buffers()[2] or b"")[part[0] : part[-1]]).translate(LETTERS)
        lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(part) - 1, pa.py_buffer(part - part[0]), pa.py_buffer(raw)))
        real = pc.greater(pc.binary_length(lists.flatten()), 0)
        coded.append(lists.flatten().filter(real).dictionary_encode())
        text.append((pc.list_parent_indices(lists).filter(real).to_numpy() + k).astype(np.int32))
    text, coded = np.concatenate(text), pa.chunked_array(coded).unify_dictionaries().chunks
    different = coded[0].dictionary
    order = pc.sort_indices(different).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    words, code = different.take(pa.array(order)), place[np.concatenate([c.indices.to_numpy() for c in coded])]
    own = text[1:] == text[:-1]
    before, after = code[:-1][own], code[1:][own]
    pairs, pair = np.unique(before.astype(np.int64) * len(words) + after, return_inverse=True)
    return words, code, text[1:][own], before, after, pairs, pair


def document_ratio(docs: DataFrame, key: str = "doc_id", text: str = "doc_text") -> DataFrame:
    """nll_ratio of the bigram over the unigram model, straight from documents. No word is ever a row: documents
    are put into blocks of some BLOCK bytes, a block's different pairs and words are counted in one Arrow
    batch, and what the corpus says of them comes back to the block. Repeated rows count once; several
    texts of one key (or of no key) are gathered and read in turns, sentence by sentence, in the texts' order."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    kind = dict(docs.dtypes)[key]
    rows = docs.where(F.col(text).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(size // BLOCK + 1)).cast("int").alias("block"), F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    parts = F.transform(F.sort_array("t"), lambda t: T.split_pieces(T.normalize_whitespace(t)))
    turns = F.flatten(F.transform(F.sequence(F.lit(0), F.array_max(F.transform("parts", F.size)) - 1), lambda k: F.transform("parts", lambda p: F.get(p, k))))
    whole = rows.repartition("block").groupBy("block", "id").agg(F.collect_set("t").alias("t"))
    whole = whole.withColumn("parts", F.when(F.size("t") > 1, parts)).select("block", "id", F.when(F.size("t") > 1, F.array_join(turns, " ")).otherwise(F.get("t", F.lit(0))).alias("t"))

    def count(table: pa.Table) -> pa.Table:
        words, code, _, before, after, pairs, pair = _counted(table["t"])
        p, v = len(pairs), len(words)
        first = pa.concat_arrays([words.take(pa.array(pairs // max(v, 1))), pa.nulls(v, pa.large_string())])
        second = pa.concat_arrays([words.take(pa.array(pairs % max(v, 1))), words])
        number = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int64))
        of = lambda c: np.bincount(c, minlength=v)
        none = np.zeros(p)
        cols = [pa.array(np.full(p + v, table["block"][0].as_py(), np.int32)), number(np.arange(p), np.arange(v)), first.cast(pa.string()), second.cast(pa.string())]
        return pa.table([*cols, number(np.bincount(pair, minlength=p), of(code)), number(none, of(before)), number(none, of(after))], ["block", "i", "c", "w", "n", "n_c", "n_w"])

    # a row is a pair, or a word (c is null) with how often it stands, before a word and behind one
    counts = whole.groupBy("block").applyInArrow(count, "block int, i long, c string, w string, n long, n_c long, n_w long")
    same = W.partitionBy("c", "w")
    told = counts.select("block", "i", "c", F.min(F.struct("block", "i")).over(same).alias("least"), *[F.sum(x).over(same).alias(x) for x in ("n", "n_c", "n_w")])
    told = told.where("least is not null and n_c is not null and n_w is not null")  # true of all: both readers keep all columns, so they share one exchange
    once = F.col("c").isNull() & (F.col("least") == F.struct("block", "i"))
    total = told.agg(F.sum(F.when(once, F.col("n"))).alias("n_all"), F.count(F.when(once, 1)).alias("v_all"), F.count(F.when(once & (F.col("n_w") > 0), 1)).alias("v"))
    known = told.join(F.broadcast(total), F.lit(True), "inner")  # one row
    unigram = -F.log((F.col("n") + F.lit(K)) / (F.col("n_all") + F.lit(K) * F.col("v_all")))
    known = known.select("block", "i", F.col("c").isNotNull().alias("pair"), F.when(F.col("c").isNull(), unigram).otherwise(F.log(F.col("n") + F.lit(K))).alias("x"), F.log(F.col("n_c") + F.lit(K) * F.col("v")).alias("context"))

    def score(table: pa.Table, back: pa.Table) -> pa.Table:
        words, _, at, before, after, pairs, pair = _counted(table["t"])
        i, is_pair, x, context = (back[c].to_numpy() for c in ("i", "pair", "x", "context"))
        own, by_context, by_word = np.empty(len(pairs)), np.empty(len(words)), np.empty(len(words))
        own[i[is_pair]], by_word[i[~is_pair]], by_context[i[~is_pair]] = x[is_pair], x[~is_pair], context[~is_pair]
        n = np.bincount(at, minlength=len(table))
        some = np.flatnonzero(n)
        mean = lambda y: pa.array(np.bincount(at, y, len(table))[some] / n[some])
        return pa.table([table["id"].take(pa.array(some)), pa.array(n[some].astype(np.int64)), mean(by_context[before] - own[pair]), mean(by_word[after])], ["id", "n", "a", "b"])

    means = whole.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, f"id {kind}, n long, a double, b double")
    return means.where("id is not null").select(F.col("id").alias(key), F.when(F.col("n") >= 2, F.expr("try_divide(a, b)")).alias("ratio"))
