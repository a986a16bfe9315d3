"""Problem 6: the same or nearly the same records across splits.

An exact prefix-filter bipartite join on rare shingles. Two units of at most L words overlap if
their words differ by at most L // 10 changes. A change touches at most ``Q`` shingles of Q words,
so of the ``n - Q + 1`` shingles of either unit at most ``Q * (L // 10)`` are lost: if each unit
keeps its ``Q * k + 1`` rarest shingles (k: the changes that any partner within its length bounds
allows), an overlapping pair shares one of them. What "rare" means comes from a sketch of fixed
size that counts the shingles of all units; any order gives the same result.

Copies are one class (a digest of the words), so a class is compared once, however many rows it
has. Evaluation classes are indexed; train classes probe, after a bitmap of fixed size has dropped
the shingles that no evaluation class keeps. Pairs pass the filters of length, position and word
signature (a change alters at most two bits) before the texts are looked up, and an exact
bit-parallel distance verifies them. Classes are expanded to pairs of units only at the end, since the result
asks for all of them. Texts are shuffled once.

Units are those of sentence_dataset. Null texts, units of fewer than ``LEAST`` words and units
without a split are left out. Repeated rows count once; a unit with two splits counts with both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import table, tidy, within
from sentria.sources import written

LEAST = 12
Q = 3
SKETCH = 1 << 18
BITMAP = 1 << 23
EVAL = ("validation", "test")


def _norm(text: str):
    """Words in lower case, without punctuation, one space apart."""
    plain = F.regexp_replace(F.lower(text), "['’‘`´]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", " "))


def _stored(spark: SparkSession, base: str) -> DataFrame:
    """Rows of sentence_dataset with enough words, with their words and the words' digest."""
    rows = table(spark, base, "sentence_dataset", "sentence_uid", "sentence_text", "bucket", "split", distinct=False).where("sentence_uid is not null")
    size = F.size(F.filter(F.split(F.col("sentence_text"), r"(?U)\s+"), lambda w: w != ""))
    words = rows.where(size >= LEAST).select(F.col("sentence_uid").alias("uid"), "bucket", "split", _norm("sentence_text").alias("words"))
    return words.withColumn("k", F.unhex(F.md5("words")))


def units(spark: SparkSession, base: str) -> DataFrame:
    """(uid, bucket, split, train, k) of every unit with a split and enough words."""
    stored = _stored(spark, base).select("uid", "bucket", tidy("split").alias("other"), "k")
    known = table(spark, base, "sentence_features", "sentence_uid", "split", distinct=False).select(F.col("sentence_uid").alias("uid"), tidy("split").alias("own")).where("uid is not null and own is not null")
    one = stored.join(known, "uid", "left").select("uid", "bucket", F.coalesce("own", "other").alias("split"), "k")
    return one.where(F.col("split").isin("train", *EVAL)).distinct().withColumn("train", F.col("split") == "train")


def class_table(spark: SparkSession, base: str, members: DataFrame) -> DataFrame:
    """(k, words, in_train, in_eval) of every class."""
    flags = members.groupBy("k").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))
    return _stored(spark, base).select("k", "words").distinct().join(flags, "k")


def _shingles(w: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(" ".join(w[i : i + Q])) for i in range(max(len(w) - Q + 1, 1))]


def _kept(w: list[str], counts: np.ndarray) -> list[tuple[float, int, int]]:
    """The rarest shingles of a class: (count, hash, position)."""
    n = len(w)
    most = max(n // 10, (n * 10 // 9) // 10)  # the longest partner has at most n / 0.9 words
    return sorted((counts[x % SKETCH], x, i) for i, x in enumerate(_shingles(w)))[: Q * most + 1]


def _signature(w: list[str]) -> tuple[int, int]:
    """Two words of bits: which words there are."""
    import xxhash

    bits = 0
    for x in set(w):
        bits |= 1 << (xxhash.xxh64_intdigest(x) % 128)
    return (bits & ((1 << 64) - 1)) - (1 << 63), (bits >> 64) - (1 << 63)


def _prefixes(held, present):
    """Map: classes to their rarest shingles with what the filters need. present: a broadcast bitmap
    of the shingles that can match at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, there = held.value, present.value if present else None
        for b in batches:
            out = ([], [], [], [], [], [])
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = text.split(" ")
                kept = [(x, i) for _, x, i in _kept(w, counts) if there is None or there[(x >> 20) % BITMAP]]
                if kept:
                    s0, s1 = _signature(w)
                for x, i in kept:
                    for col, v in zip(out, (x - (1 << 63), k, len(w), i, s0, s1)):
                        col.append(v)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["gram", "k", "n", "at", "s0", "s1"])

    return run


def _bitmap(cells: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP cells from cells(cell): gathered as at most BITMAP / 64 words of bits."""
    got = cells.selectExpr("cast(cell div 64 as int) as word", "shiftleft(1L, cast(cell % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP // 64, dtype=np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _cells(held):
    """Map: the bitmap cells of the shingles that classes keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {(x >> 20) % BITMAP for text in b.column(0).to_pylist() for _, x, _ in _kept(text.split(" "), held.value)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.int64())], ["cell"])

    return run


def _digest_cell(k: bytes) -> int:
    return int.from_bytes(k[:8], "little") % BITMAP


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map: the shingles of a partition counted in cells of a fixed number."""
    cells = np.zeros(SKETCH, dtype=np.int64)
    for b in batches:
        h = []
        for text in b.column(0).to_pylist():
            h += [x % SKETCH for x in _shingles(text.split(" "))]
        np.add.at(cells, h, 1)
    at = np.flatnonzero(cells)
    for s in range(0, len(at), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(at[s : s + 65536], pa.int32()), pa.array(cells[at[s : s + 65536]], pa.int64())], ["cell", "n"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = x.split(" "), y.split(" ")
            ok.append(within(x, y, max(len(x), len(y)) // 10))
        yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])


def overlaps(classes: DataFrame) -> DataFrame:
    """(ka, kb): evaluation and train classes of classes(k, words, in_train, in_eval) that overlap, the
    same class included."""
    sc = classes.sparkSession.sparkContext
    counts = np.zeros(SKETCH, dtype=np.float32)  # at most SKETCH rows come, whatever the corpus
    got = classes.select("words").mapInArrow(_sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    held = sc.broadcast(counts)
    eval_side, train_side = classes.where("in_eval").select("k", "words"), classes.where("in_train").select("k", "words")
    present = sc.broadcast(_bitmap(eval_side.select("words").mapInArrow(_cells(held), "cell long")))
    shape = "gram long, k binary, n int, at int, s0 long, s1 long"
    index = eval_side.mapInArrow(_prefixes(held, None), shape).toDF("gram", "ka", "na", "pa", "s0a", "s1a")
    probe = train_side.mapInArrow(_prefixes(held, present), shape).toDF("gram", "kb", "nb", "pb", "s0b", "s1b")
    most = F.floor(F.greatest("na", "nb") / 10)
    differ = F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))) + F.bit_count(F.col("s1a").bitwiseXOR(F.col("s1b")))
    near = index.join(probe, "gram").where((F.col("ka") != F.col("kb")) & (F.abs(F.col("na") - F.col("nb")) <= most) & (F.abs(F.col("pa") - F.col("pb")) <= most) & (differ <= 2 * most))
    near = written(near.select("ka", "kb").distinct(), "near")
    # only the texts of candidates are looked up: a bitmap of their digests drops the others unshuffled
    wanted = sc.broadcast(_bitmap(near.select(F.explode(F.array("ka", "kb")).alias("k")).mapInArrow(_digests, "cell long")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(wanted.value[_digest_cell(k)]) for k in b.column(0).to_pylist()], pa.bool_()))

    texts = classes.select("k", "words").mapInArrow(some, "k binary, words string")
    full = near.join(texts.toDF("ka", "wa"), "ka").join(texts.toDF("kb", "wb"), "kb")
    close_ones = full.select("ka", "kb", "wa", "wb").mapInArrow(_verified, "ka binary, kb binary")
    both = classes.where("in_train and in_eval").select(F.col("k").alias("ka"), F.col("k").alias("kb"))
    return both.unionByName(close_ones)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_digest_cell(k) for k in b.column(0).to_pylist()], pa.int64())], ["cell"])


def pairs(spark: SparkSession, base: str) -> DataFrame:
    """(a, b) rows of units: evaluation and train, with bucket and split of both."""
    members = written(units(spark, base), "units")
    found = overlaps(written(class_table(spark, base, members), "classes"))
    a = members.where("not train").select(F.col("k").alias("ka"), F.col("uid").alias("uid_a"), F.col("bucket").alias("bucket_a"), F.col("split").alias("split_a"))
    b = members.where("train").select(F.col("k").alias("kb"), F.col("uid").alias("uid_b"), F.col("bucket").alias("bucket_b"), F.col("split").alias("split_b"))
    return found.join(a, "ka").join(b, "kb").where("uid_a <> uid_b")


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    got = pairs(spark, base)
    return got.select(F.least("uid_a", "uid_b").alias("sentence_uid_a"), F.greatest("uid_a", "uid_b").alias("sentence_uid_b")).distinct()


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping pairs, and evaluation units with any, by split and bucket."""
    return pairs(spark, base).groupBy(F.col("split_a").alias("split"), F.col("bucket_a").alias("bucket")).agg(F.count("*").alias("pairs"), F.countDistinct("uid_a").alias("units"))
