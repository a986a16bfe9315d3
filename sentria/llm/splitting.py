"""Problem 10: oversized texts in pieces within a limit of tokens.

A recursive hierarchy of separators: a text that is too long is cut at sections, a part that is
still too long at paragraphs, then at sentences, words and, last, characters. The parts are packed
greedily, and each piece begins with the last ``overlap`` tokens of the one before: its start is the
character whose text up to the cut has exactly so many tokens by itself, inside a word if need be.
Where tokens end inside characters no such place may exist; then the next one before it is taken,
which shares the fewest tokens more. A piece is encoded by itself before it is given out and made
smaller if it should exceed the limit, so the limit always holds, but for a single character of
more tokens than the limit; where one leaves no room for the whole overlap the overlap is shorter.
An overlap that isn't less than the limit is an error.

Null and empty texts and those within the limit have one piece, or none if there is no text; a
text of n bytes has at most n tokens, so short ones are passed by without encoding. Time grows in
proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.bpe import Encoder, encoder
from sentria.llm.common import table, unique_by

SECTION, PARAGRAPH, SENTENCE, WORD, CHARACTER = range(5)

#: Ends of sentences, of several scripts, and what may follow them.
ENDS = ".!?…。！？।॥؟۔"
CLOSERS = "\"'”’»)]』」）】"

_SECTION = re.compile(r"\n[ \t]*\n[ \t]*\n|\n[ \t]*\n(?=[ \t]*(?:#{1,6} |={3,}|-{3,}|\*{3,}))|\n(?=#{1,6} )")


class Cuts:
    """Where a text may be cut, and how many tokens stand before each of these places."""

    def __init__(self, enc: Encoder, text: str, unit: int):
        self.text = text
        self.at, self.before, self.level = [0], [0], [SECTION]
        sections = {m.end() for m in _SECTION.finditer(text)}
        pos, count, prev = 0, 0, ""
        for piece in enc.pieces(text):
            if pos:
                self._add(pos, count, self._level(text, pos, prev, piece, sections))
            n = len(enc.memo[piece]) // 4
            for size, tokens in self._parts(enc, piece, n, unit):
                pos += size
                count += tokens
                if tokens and size < len(piece):
                    self._add(pos, count, CHARACTER)
            prev = piece
        if self.at[-1] != len(text):
            self._add(len(text), count, SECTION)
        self.level[-1] = SECTION

    def _add(self, at: int, before: int, level: int) -> None:
        if self.at[-1] != at:
            self.at.append(at)
            self.before.append(before)
            self.level.append(level)
        else:
            self.level[-1] = min(self.level[-1], level)

    @staticmethod
    def _parts(enc: Encoder, piece: str, n: int, unit: int) -> list[tuple[int, int]]:
        """A pretoken of many tokens in parts of a few characters."""
        if n <= unit or len(piece) == 1:
            return [(len(piece), n)]
        size = max(1, len(piece) * unit // (2 * n))
        return [(len(part), enc.count(part)) for part in (piece[i : i + size] for i in range(0, len(piece), size))]

    @staticmethod
    def _level(text: str, pos: int, prev: str, piece: str, sections: set[int]) -> int:
        if pos in sections:
            return SECTION
        if prev.isspace():
            if "\n" in prev:
                return PARAGRAPH
            k = pos - len(prev)
        else:
            k = pos
        last = text[max(0, k - 3) : k].rstrip(CLOSERS)[-1:]
        if last and last in ENDS and (piece[:1].isspace() or prev.isspace() or last not in ".!?…"):
            return SENTENCE
        return WORD


def _units(cuts: Cuts, lo: int, hi: int, level: int, room: int) -> Iterator[int]:
    """Ends (indexes of cuts) of the parts of cuts[lo:hi], each within room where it can be."""
    if cuts.before[hi] - cuts.before[lo] <= room or hi - lo == 1 or level > CHARACTER:
        yield hi
        return
    start = lo
    for k in range(lo + 1, hi + 1):
        if k == hi or cuts.level[k] <= level:
            yield from _units(cuts, start, k, level + 1, room)
            start = k


def _shared(enc: Encoder, cuts: Cuts, low: int, end: int, overlap: int) -> int:
    """Where the piece begins that follows one of text[low:], cut at cuts.at[end]."""
    text, stop = cuts.text, cuts.at[end]
    if not overlap:
        return stop
    k = max(bisect_right(cuts.before, cuts.before[end] - overlap, 0, end + 1) - 1, 0)
    while True:
        start = max(cuts.at[k], low)
        tokens = enc.ids(text[start:stop])
        if len(tokens) >= overlap or start == low:
            break
        k -= 1  # white space at the cut may need fewer tokens than before a word
    if len(tokens) <= overlap:
        return start
    size = enc.merges.bytes_of
    aside = b"".join(size[t] for t in tokens[: len(tokens) - overlap])
    near = start + len(aside.decode("utf-8", "ignore"))
    found = (len(tokens), -start)
    for c in (near, *(near + d for k in range(1, 9) for d in (-k, k))):
        if start < c < stop:
            n = enc.count(text[c:stop])
            if n == overlap:
                return c
            if n > overlap:
                found = min(found, (n, -c))
    return -found[1]


def pieces(enc: Encoder, text: str | None, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, in code points."""
    overlap = max(0, overlap)
    if limit < 1 or overlap >= limit:
        raise ValueError("the overlap has to be less than the limit")
    if not text:
        return []
    n = enc.count(text)
    if n <= limit:
        return [(0, len(text), n)]
    room = limit - overlap
    cuts = Cuts(enc, text, max(1, min(32, room // 4)))
    at, before = cuts.at, cuts.before
    ends = list(_units(cuts, 0, len(at) - 1, SECTION, room))
    out: list[tuple[int, int, int]] = []
    start, done, k = 0, 0, 0  # where the piece begins, the cut up to which the text is given out, the next unit
    held = 0  # tokens of text[start:at[done]]
    while done < len(at) - 1:
        last = k
        while last + 1 < len(ends) and before[ends[last + 1]] - before[done] + held <= limit:
            last += 1
        end = ends[last]
        while (size := enc.count(text[start : at[end]])) > limit:  # encoded by itself it is longer
            if last > k:
                last -= 1
                end = ends[last]
            elif end - done > 1:
                end = max(done + 1, min(end - 1, bisect_right(before, before[done] + limit - held, done, end) - 1))
            elif start < at[done]:
                start += 1
            else:
                break
        out.append((start, at[end], size))
        start, done = _shared(enc, cuts, start, end, overlap), end
        held = enc.count(text[start : at[end]])
        while k < len(ends) and ends[k] <= end:
            k += 1
    return out


def split_oversized(df: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, piece, char_start, char_end, n_tokens) of every text that exceeds the limit."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            rows = ([], [], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or len(t) * 4 <= limit or len(t.encode("utf-8", "surrogatepass")) <= limit:
                    continue
                parts = pieces(enc, t, limit, overlap)
                if len(parts) > 1:
                    for k, (s, e, n) in enumerate(parts):
                        for col, v in zip(rows, (i, k, s, e, n)):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), *(pa.array(r, pa.int32()) for r in rows[1:])], [key, "piece", "char_start", "char_end", "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, char_start int, char_end int, n_tokens int")


def limits(spark: SparkSession, base: str) -> tuple[str, int, int]:
    """The limits' one row; without one, the whole context of 1024 tokens and no overlap."""
    row = table(spark, base, "size_limits", "tokenizer", "max_tokens", "overlap_tokens").where("max_tokens is not null").orderBy("tokenizer", "max_tokens").first()
    return (row[0] or "byte_bpe_50k", int(row[1]), int(row[2] or 0)) if row else ("byte_bpe_50k", 1024, 0)


def p10_pieces(spark: SparkSession, base: str) -> DataFrame:
    tokenizer, limit, overlap = limits(spark, base)
    docs = unique_by(table(spark, base, "documents", "doc_id", "text", distinct=False), "doc_id")
    return split_oversized(docs, limit, overlap, tokenizer=tokenizer)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return p10_pieces(spark, base).where(F.col("piece") == 1).select("doc_id")
