"""Problem 9: passages of evaluation items within the corpus.

A passage is found if ``MIN_WORDS`` running words of an item stand in a text with at most one word
in ten changed, left out or put in; case, punctuation, mark-up and spacing don't count. Pigeonhole:
n words with n // 10 changes hold an unchanged run of at least ``SEED`` words (the least is at 30
words and 3 changes: four runs share 27 words), and any longer passage holds one of 25 words with
2 changes, 30 with 3 or 40 with 4. So every text is probed for exact hits of the items' runs of
``SEED`` words; what stands around a hit is first bounded (enough of the item's words nearly in
place) and then verified with Myers' bit-parallel distance over words.

The corpus is read once and never shuffled: the items, whose size is counted first, go to the
workers in blocks of at most ``BLOCK_WORDS`` words; each block is one more pass, whatever the
number of items. Null and empty texts hold nothing; items of fewer than 25 words are never found.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import WORD, table, unique_by

MIN_WORDS = 25
SEED = 7
BLOCK_WORDS = 2_000_000
#: (words, changes) of the shortest passages; every longer one holds one of these
WINDOWS = ((25, 2), (30, 3), (40, 4))
REACH = 40
SHIFT = 4
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22

_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-­‐]\s*\n\s*(?=[^\W\d_])|[­​⁠﻿]")


def plain(text: str) -> str:
    """A text without mark-up, character references and words broken at line ends."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "­" in text or "‐" in text or "​" in text or "⁠" in text or "﻿" in text:
        text = _BREAK.sub("", text)
    return text


class _Chunks(dict):
    """Packed word ids by what stands between white space; 0 is a word of no item."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, chunk: str) -> bytes:
        out = b"".join(self.ids.get(w, 0).to_bytes(4, "little") for w in words(chunk))
        if len(chunk) <= 40:
            if len(self) > 400_000:
                self.clear()
            self[chunk] = out
        return out


def words(text: str) -> list[str]:
    return WORD.findall(text.replace("'", "").replace("’", "").lower())


def roll(ids: np.ndarray) -> np.ndarray:
    """Hash of each run of SEED ids."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, u = np.zeros(n, dtype=np.uint64), ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SEED):
            h = h * _MULT + u[k : k + n]
            h ^= h >> np.uint64(29)
    return h


class Items:
    """A block of items: their words as ids, one after the other, and the places of each run."""

    def __init__(self, items: list[tuple[int, str]]):
        self.word_id: dict[str, int] = {}
        ids, owner, self.keys = [], [], []
        for key, text in items:
            w = words(plain(text or ""))
            if len(w) < MIN_WORDS:
                continue
            ids += [-1] * REACH * 2  # nothing is like it
            owner += [-1] * REACH * 2
            ids += [self.word_id.setdefault(x, len(self.word_id) + 1) for x in w]
            owner += [len(self.keys)] * len(w)
            self.keys.append(key)
        ids += [-1] * REACH * 2
        owner += [-1] * REACH * 2
        self.ids, self.owner = np.array(ids, dtype=np.int32), np.array(owner, dtype=np.int32)
        at = np.flatnonzero((self.owner[: len(self.owner) - SEED + 1] >= 0) & (self.owner[: len(self.owner) - SEED + 1] == self.owner[SEED - 1 :])) if len(self.ids) >= SEED else np.zeros(0, dtype=np.int64)
        h = roll(self.ids)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], at[order]
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True


def within(pattern: list[int], text: list[int], most: int) -> bool:
    """Myers' bit-parallel search: whether some part of text is at most ``most`` changes away from
    the whole pattern; both are lists of word ids."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, p in enumerate(pattern):
        peq[p] = peq.get(p, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, left = full, 0, m, len(text)
    for t in text:
        left -= 1
        eq = peq.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score <= most:
                return True
        if score - left > most:
            return False
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return score <= most


def search(items: Items, texts: list[str | None]) -> list[tuple[int, int]]:
    """(index of the text, index of the item) of the passages held by texts."""
    chunks = items.__dict__.setdefault("chunks", _Chunks(items.word_id))
    pad = b"\xfe\xff\xff\xff" * (2 * REACH)  # -2: nothing is like it
    parts, starts, at = [pad], [], 2 * REACH
    for t in texts:
        packed = b"".join(map(chunks.__getitem__, plain(t).split())) if t else b""
        parts += (packed, pad)
        starts.append(at)
        at += len(packed) // 4 + 2 * REACH
    doc = np.frombuffer(b"".join(parts), dtype="<i4")
    h = roll(doc)
    hit = np.flatnonzero(items.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    if not len(hit):
        return []
    lo, hi = np.searchsorted(items.hashes, h[hit], "left"), np.searchsorted(items.hashes, h[hit], "right")
    n = hi - lo
    i = np.repeat(hit, n)
    j = items.places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    keep = np.ones(len(i), dtype=bool)
    for k in range(SEED):
        keep &= doc[i + k] == items.ids[j + k]
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    # one seed for each unbroken run: the first
    first = doc[i - 1] != items.ids[j - 1]
    i, j = i[first], j[first]
    which = np.searchsorted(np.array(starts), i, "right") - 1
    # bound: of the item's words around the seed, those that stand nearly in place
    ok = np.zeros(len(i), dtype=bool)
    span = np.arange(-REACH, REACH + SEED)
    for s in range(0, len(i), 4096):
        a, b = i[s : s + 4096, None] + span, j[s : s + 4096, None] + span
        want, near = items.ids[b], np.zeros(a.shape, dtype=bool)
        for d in range(-SHIFT, SHIFT + 1):
            near |= doc[a + d] == want
        c = np.cumsum(near, axis=1)
        c = np.concatenate([np.zeros((len(c), 1), dtype=c.dtype), c], axis=1)
        for size, most in WINDOWS:
            # windows of the item that hold the seed
            at = np.arange(REACH + SEED - size, REACH + 1)
            at = at[(at >= 0) & (at + size < c.shape[1])]
            ok[s : s + 4096] |= (c[:, at + size] - c[:, at] >= size - most).any(axis=1)
    found: set[tuple[int, int]] = set()
    for d, p, q in zip(which[ok].tolist(), i[ok].tolist(), j[ok].tolist()):
        key = (d, int(items.owner[q]))
        if key not in found and _verify(items, doc, p, q):
            found.add(key)
    return sorted(found)


def _verify(items: Items, doc: np.ndarray, p: int, q: int) -> bool:
    """Whether a passage stands around the seed doc[p:p + SEED] = items.ids[q:q + SEED]."""
    reach = REACH + 2 * SHIFT
    text = doc[p - reach : p + SEED + reach]
    item = items.ids[q - reach : q + SEED + reach]
    same = np.concatenate([[0], np.cumsum(text == item)])
    near = np.zeros(len(item), dtype=bool)
    for d in range(-SHIFT, SHIFT + 1):
        near[SHIFT:-SHIFT] |= text[SHIFT + d : len(text) - SHIFT + d] == item[SHIFT:-SHIFT]
    some = np.concatenate([[0], np.cumsum(near)])
    for size, most in WINDOWS:
        at = np.arange(reach + SEED - size, reach + 1)
        if (same[at + size] - same[at] >= size - most).any():
            return True
    own, words_ = item.tolist(), text.tolist()
    for size, most in WINDOWS:
        for a in range(reach + SEED - size, reach + 1):
            if some[a + size] - some[a] >= size - most and -1 not in own[a : a + size]:
                if within(own[a : a + size], words_[max(0, a - 2 * SHIFT) : a + size + 2 * SHIFT], most):
                    return True
    return False


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The stated items in blocks of bounded size, read one partition at a time."""
    held, n = [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        n += len(row[1]) // 2 + 1
        if n >= most:
            yield Items(held)
            held, n = [], 0
    if held:
        yield Items(held)


def find_passages(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id) of every passage of an item in a text."""
    sc = docs.sparkSession.sparkContext
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)["item_id"]

    def probe(block: Items) -> DataFrame:
        held = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = held.value
            for b in batches:
                for s in range(0, b.num_rows, 512):
                    part = b.slice(s, 512)
                    hits = search(own, part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in hits], pa.int64())), pa.array([own.keys[k] for _, k in hits]).cast(out_type)], [key, "item_id"])

        from pyspark.sql.pandas.types import to_arrow_type

        out_type = to_arrow_type(items.schema["item_id"].dataType)
        return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, item_id {item_kind}")

    parts = [probe(b) for b in blocks(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"`{key}` {kind}, item_id {item_kind}")
    return reduce(DataFrame.union, parts).distinct()


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents", "doc_id", "text", distinct=False)
    return find_passages(docs, table(spark, base, "eval_items", "item_id", "text"))


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    """Of each bench: its items, those that leaked, and the documents that hold them."""
    items = table(spark, base, "eval_items", "item_id", "bench")
    found = p9_found(spark, base)
    return items.join(found, "item_id", "left").groupBy("bench").agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.countDistinct("doc_id").alias("documents"))
