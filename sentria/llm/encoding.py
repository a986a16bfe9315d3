"""Problem 8: the whole corpus as ids of a public tokenizer.

``encode`` adds nothing to a plan but one Arrow map: no shuffle, constant memory for any text. A
null and an empty text have no ids (an empty list); special-token strings are ordinary text; white
space is kept. Repeated rows come out once; other columns of the table are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.bpe import Decoder, encoder
from sentria.llm.common import table, unique_by


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row of df."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            packed = [enc.packed(t) if t else b"" for t in b.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text): the way back; null ids give an empty text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = encoder(tokenizer, folder).merges
        for b in batches:
            texts = []
            for row in b.column(1).to_pylist():
                d = Decoder(merges)
                texts.append("".join(map(d.feed, row or ())) + d.close())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    docs = unique_by(table(spark, base, "documents", "doc_id", "text", distinct=False), "doc_id")
    return encode(docs)


def p8_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """Per language: documents, tokens, bytes, and the documents whose decoded ids are not the text."""
    docs = unique_by(table(spark, base, "documents", "doc_id", "text", "lang", distinct=False), "doc_id", "text", "lang")
    kind = dict(docs.dtypes)["lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()
        for b in batches:
            n, wrong, size = [], [], []
            for t in b.column(1).to_pylist():
                packed = enc.packed(t) if t else b""
                d = Decoder(enc.merges)
                back = "".join(map(d.feed, memoryview(packed).cast("i"))) + d.close()
                n.append(len(packed) // 4)
                wrong.append(int(back != (t or "")))
                size.append(len((t or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(wrong, pa.int64())], ["lang", "n", "size", "wrong"])

    rows = docs.select("lang", "text").mapInArrow(run, f"lang {kind}, n long, size long, wrong long")
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("size").alias("bytes"), F.sum("wrong").alias("wrong"))
