"""Problem 4: repetition inside a document, kept in a ledger of rule bits.

Every rule is evaluated once for each document and leaves its measurement and, if it fails, its
bit. Policies are versioned sets of rules (a mask); applying one, or leaving a rule out, needs only
the ledger: policies test ``bits & mask``, and the ablation groups the ledger by its bits, at most
``2 ** len(RULES)`` rows, before anything else.

Documents come as parts (rows) with an order. A part repeated with the same order and text counts
once; null parts and null keys are left out; a document without words has share 0 and no bits.
Words are runs of letters (in scripts without spaces, phrases: single letters would make ordinary
phrases count as repeated runs); case, digits and punctuation don't count.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.llm.common import MARKS, table
from sentria.sources import written

RUN = 6
#: documents of more parts, or of more characters, are measured without gathering them
MOST_PARTS, MOST_CHARS = 20_000, 50_000_000
#: numerals such as Roman ones and one half, which \w takes beside letters and digits (there are none beyond)
NUMERALS = "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))
#: a run of letters; in scripts without spaces, a phrase
LETTER_WORD = re.compile(f"(?:[^\\W\\d_{NUMERALS}]|[{MARKS}])+")
#: name, share from which it fails
RULES = (("repeated_run_share", 1 / 3), ("repeated_part_share", 0.3), ("top_trigram_share", 0.1), ("repeated_long_run_share", 0.2))
#: versioned policies: the rules that reject a document
POLICIES = {"run-v1": ("repeated_run_share",), "strict-v1": ("repeated_run_share", "repeated_part_share", "top_trigram_share", "repeated_long_run_share"), "parts-v1": ("repeated_part_share",)}
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


class _Chunks(dict):
    """Packed word numbers by what stands between white space. The same word has the same number
    in this process for as long as the numbers are kept, at least within a document."""

    def __init__(self):
        super().__init__()
        self.number: dict[str, bytes] = {}

    def fit(self) -> None:
        if len(self) > 300_000:
            self.clear()
        if len(self.number) > 600_000:
            self.clear()
            self.number.clear()

    def __missing__(self, chunk: str) -> bytes:
        number = self.number
        out = b"".join(number.setdefault(w, (len(number) + 1).to_bytes(4, "little")) for w in LETTER_WORD.findall(chunk.lower()))
        if len(chunk) <= 40:
            self[chunk] = out
        return out


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(len(ids) - n + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * _MULT + ids[k : k + len(h)]
            h ^= h >> np.uint64(29)
    return h


def _run_share(ids: np.ndarray, n: int) -> float:
    """Share of the words that stand in a run of n words which stood before."""
    h = _grams(ids, n)
    if len(h) < 2:
        return 0.0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0.0
    again = np.zeros(len(ids) + 1, dtype=np.int32)
    at = order[1:][same]
    again[at] += 1
    np.subtract.at(again, at + n, 1)
    return float((np.cumsum(again[:-1]) > 0).mean())


def measure(parts: list[str], chunks: _Chunks) -> tuple[int, list[float]]:
    """Words, and the measurement of each rule."""
    chunks.fit()
    packed = [b"".join(map(chunks.__getitem__, p.split())) for p in parts]
    ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.uint64)
    n = len(ids)
    if not n:
        return 0, [0.0] * len(RULES)
    seen: set[bytes] = set()
    again = 0
    pieces = packed if len(parts) > 1 else [b"".join(map(chunks.__getitem__, p.split())) for p in parts[0].splitlines()]
    for p in pieces:
        if p and p in seen:
            again += len(p) // 4
        seen.add(p)
    three = _grams(ids, 3)
    top = int(np.unique(three, return_counts=True)[1].max()) if len(three) else 0
    return n, [_run_share(ids, RUN), again / n, top * 3 / n if top > 1 else 0.0, _run_share(ids, 2 * RUN)]


def ledger(parts: DataFrame, *key: str, order: str = "ord", text: str = "text", most_parts: int = MOST_PARTS) -> DataFrame:
    """(key..., n_words, one column for each rule, bits) of each document.

    One shuffle brings a document's parts together, repeated rows already dropped map-side. Documents
    of more than ``most_parts`` parts are never gathered: windows that spill measure them."""
    types = dict(parts.dtypes)
    parts = parts.where(F.col(text).isNotNull())
    is_huge = (F.col("n") > most_parts) | ((F.col("n") > 1) & (F.col("chars") > MOST_CHARS))
    measures = (F.count("*").alias("n"), F.sum(F.length(text)).alias("chars"))
    sizes = parts.groupBy(*key).agg(*measures).where(is_huge)
    huge = [tuple(r) for r in sizes.select(*key).take(1)]
    names = [n for n, _ in RULES]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "n_words long", *(f"{n} double" for n in names), "bits long"])
    if huge:
        # repeated rows aside
        sizes = parts.join(sizes.select(*key), list(key), "left_semi").select(*key, order, text).distinct().groupBy(*key).agg(*measures).where(is_huge)
        sizes = written(sizes.select(*key), "huge")
        rest = parts.join(sizes, list(key), "left_anti")
        return _gathered(rest, key, order, text, schema).unionByName(_windowed(parts.join(sizes, list(key), "left_semi"), key, order, text))
    return _gathered(parts, key, order, text, schema)


def _bits(shares: list) -> int:
    return sum(1 << k for k, (v, (_, least)) in enumerate(zip(shares, RULES)) if v >= least - 1e-12)


def _gathered(parts: DataFrame, key: tuple[str, ...], order: str, text: str, schema: str) -> DataFrame:
    docs = parts.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct(order, text))).alias("parts"))
    docs = docs.select(*key, F.col(f"parts.{text}").alias("parts"))
    names = [n for n, _ in RULES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks()
        for b in batches:
            words, bits, shares = [], [], [[] for _ in RULES]
            for row in b.column(len(key)).to_pylist():
                n, found = measure(row, chunks)
                words.append(n)
                bits.append(_bits(found))
                for col, v in zip(shares, found):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array(words, pa.int64()), *(pa.array(s, pa.float64()) for s in shares), pa.array(bits, pa.int64())], [*key, "n_words", *names, "bits"])

    return docs.mapInArrow(run, schema)


def _windowed(parts: DataFrame, key: tuple[str, ...], order: str, text: str) -> DataFrame:
    """The same measurements for documents of any number of parts: words in rows, runs by lead, first
    places by an aggregate that combines map-side. Nothing of a document is held at once."""
    types = dict(parts.dtypes)
    one = parts.select(*key, order, text).distinct()
    one = one.select(*key, F.row_number().over(W.partitionBy(*key).orderBy(order, text)).alias("part"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, said = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), pa.array(place, pa.int32()), pa.array(said, pa.string())], [*key, "part", "i", "w"])

            for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for n, m in enumerate(LETTER_WORD.finditer(t.lower())):
                    at.append(k)
                    place.append(n)
                    said.append(m.group())
                    if len(at) >= 50_000:
                        yield out()
                        at, place, said = [], [], []
            yield out()

    rows = one.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in key), "part int, i int, w string"]))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy(*key).orderBy("part", "i")))
    own = W.partitionBy(*key).orderBy("pos")

    def run_share(n: int) -> DataFrame:
        gram = F.xxhash64(*[F.lead("w", j).over(own) if j else F.col("w") for j in range(n)])
        grams = rows.withColumn("gram", F.when(F.lead("w", n - 1).over(own).isNotNull(), gram)).where("gram is not null").select(*key, "pos", "gram")
        firsts = grams.groupBy(*key, "gram").agg(F.min("pos").alias("first"))
        again = grams.join(firsts, [*key, "gram"]).where("pos > first")
        step = F.least(F.coalesce(F.lead("pos").over(own) - F.col("pos"), F.lit(n)), F.lit(n))
        return again.withColumn("step", step).groupBy(*key).agg(F.sum("step").alias("covered"))

    words = rows.groupBy(*key).agg(F.count("*").alias("n_words"))
    words = parts.select(*key).distinct().join(words, list(key), "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    three = F.xxhash64("w", F.lead("w", 1).over(own), F.lead("w", 2).over(own))
    top = rows.withColumn("gram", F.when(F.lead("w", 2).over(own).isNotNull(), three)).where("gram is not null").groupBy(*key, "gram").count().groupBy(*key).agg(F.max("count").alias("top"))
    sized = rows.groupBy(*key, "part").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    sized = sized.join(rows.groupBy(*key, "part").agg(F.sum(F.xxhash64("w", "i").cast("decimal(38,0)")).alias("content")), [*key, "part"])
    repeated = sized.groupBy(*key, "content").agg(F.sum("n").alias("all_n"), F.max("n").alias("one_n")).groupBy(*key).agg(F.sum(F.col("all_n") - F.col("one_n")).alias("again"))
    on = list(key)
    joined = words.join(run_share(RUN).withColumnRenamed("covered", "c6"), on, "left").join(run_share(2 * RUN).withColumnRenamed("covered", "c12"), on, "left").join(top, on, "left").join(repeated, on, "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") / F.greatest("n_words", F.lit(1))
    shares = [share("c6"), share("again"), F.when(F.col("top") > 1, share("top") * 3).otherwise(F.lit(0.0)), share("c12")]
    out = joined.select(*key, "n_words", *[s.alias(n) for s, (n, _) in zip(shares, RULES)])
    bits = F.lit(0).cast("long")
    for k, (n, least) in enumerate(RULES):
        bits = bits + F.when(F.col(n) >= least - 1e-12, 1 << k).otherwise(0)
    return out.withColumn("bits", bits)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger's documents that a policy rejects."""
    return book.where(F.col("bits").bitwiseAND(F.lit(mask(policy))) != 0)


def ablation(book: DataFrame, policy: str = "strict-v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that are still
    rejected without it; by bitwise aggregation of the counted bits. book: a ledger, or its (bits, count)."""
    names = [n for n, _ in RULES]
    all_bits = mask(policy)
    counted = book if "count" in book.columns else book.groupBy("bits").count()
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[policy]])).alias("r")
    rows = counted.select("bits", "count", rules).select("count", "r.rule", F.col("bits").bitwiseAND(F.lit(all_bits)).alias("bits"), "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(all_bits).cast("long").bitwiseXOR(F.col("bit")))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    return rows.groupBy("rule").agg(count(has).alias("failed"), count(has & (rest == 0)).alias("failed_alone"), count(rest != 0).alias("rejected_without"), F.sum("count").alias("documents"))


def book(spark: SparkSession, base: str) -> DataFrame:
    """The ledger of both tables' documents."""
    fresh = table(spark, base, "self_ai_fresh_chunks", "doc_id", "chunk_idx", "chunk_text", distinct=False)
    units = table(spark, base, "sentence_dataset", "doc_id", "sentence_order", "sentence_text", distinct=False)
    parts = fresh.select(F.lit("fresh").alias("source"), "doc_id", F.col("chunk_idx").alias("ord"), F.col("chunk_text").alias("text")).union(
        units.select(F.lit("units"), "doc_id", F.col("sentence_order"), F.col("sentence_text"))
    )
    return ledger(parts.where("doc_id is not null"), "source", "doc_id")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return apply_policy(book(spark, base), "run-v1").select("doc_id").distinct()


def p4_shares(spark: SparkSession, base: str) -> DataFrame:
    """The ledger, measurements rounded, with the policies (by name and version) that reject each document."""
    rows = book(spark, base)
    names = F.filter(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(mask(p))) != 0, F.lit(p)) for p in sorted(POLICIES)]), lambda x: x.isNotNull())
    return rows.select("source", "doc_id", "n_words", *[F.round(n, 6).alias(n) for n, _ in RULES], "bits", F.array_join(names, " ").alias("rejected_by"))


def p4_ablation(spark: SparkSession, base: str) -> DataFrame:
    """The ablation of every policy; the ledger's bits are counted once."""
    counted = written(book(spark, base).groupBy("bits").count(), "bits")
    parts = [ablation(counted, p).select(F.lit(p).alias("policy"), "*") for p in sorted(POLICIES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
