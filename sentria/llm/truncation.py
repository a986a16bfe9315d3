"""Problem 5: texts cut off by field limits or in transfer.

Hidden limits: the lengths of texts without an end mark are recomputed as code points, UTF-8 bytes,
UTF-16 units, with entities, as JSON, with CR LF; grouped by each of these within every bucket and
model, a length that stands out from those around it is a storage limit.

Endings: one pass counts, over all distinct texts, how often each word and pair of words ends a
sentence and which closing lines recur. A text without an end mark was
cut if its last word is no word, if it stands at a hidden limit, or if sentences don't end like
that; one whose last line recurs as a closing line in several of them is finished. One that breaks
off inside a character (a replacement character at its end), after a mark or an abbreviation that
something must follow, was cut in any case. A stop after a number may be a decimal point: such a
text was cut if numbers after that word hardly ever end a sentence.

Null and blank texts aren't cut. Repeated rows count once.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.llm.common import WORD, once, table
from sentria.sources import written

#: End marks of several scripts, and what may close after them.
ENDS = ".!?…。！？।॥؟۔"
CLOSERS = "\"'”’»›)]』」）】*_`>"
LATIN_STOP = "."
#: Abbreviations that something must follow.
OPEN_ABBREVIATIONS = frozenset("dr mr mrs ms prof st vol no nr fig p pp e.g i.e vs approx ca sra sr avda núm art env frau z d j r gen col rev hon cf".split())
#: Lengths a store may count, by name.
LENGTHS = {
    "code_points": len,
    "utf8": lambda t: len(t.encode("utf-8", "surrogatepass")),
    "utf16": lambda t: len(t.encode("utf-16-le", "surrogatepass")) // 2,
    "entities": lambda t: len(html.escape(t, quote=True)),
    "entities_text": lambda t: len(html.escape(t, quote=False)),
    "json_ascii": lambda t: len(json.dumps(t)) - 2,
    "json": lambda t: len(json.dumps(t, ensure_ascii=False)) - 2,
    "crlf": lambda t: len(t) + t.count("\n"),
    "crlf_utf8": lambda t: len(t.encode("utf-8", "surrogatepass")) + t.count("\n"),
}
LEAST_AT_LIMIT = 3
ENDS_LIKE_THAT = 0.08
#: occurrences of a word before a number from which a stop after the number is judged
LEAST_SEEN = 5

_END = re.compile(f"[{re.escape(ENDS)}]+[{re.escape(CLOSERS)}]*(?=\\s|$)|(?<=[。！？।॥۔])[{re.escape(CLOSERS)}]*|\\n+")
_FACE = re.compile(r"(?:^|\s)[:;=8][-']?[)(DPp*|/\]]$|<3$")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_THAI = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")


def _mask(text: str) -> str:
    return _NUMBER.sub("0", text.lower()).replace("’", "'")


def state(text: str) -> str:
    """How a text ends: blank, ended (a mark or a sign), number (a stop that may be a decimal point), or open."""
    t = text.rstrip()
    while t and unicodedata.category(t[-1]) in ("Cf", "Cc", "Zs"):
        t = t[:-1]
    if not any(c.isalnum() for c in t):
        return "blank"
    if _FACE.search(t):
        return "ended"
    core = t.rstrip(CLOSERS)
    last = core[-1:] if core else ""
    if last and last in ENDS:
        words = core.rstrip(ENDS).split()
        word = words[-1].lower().lstrip("(\"“'«[") if words else ""
        if core.endswith(".") and not core.endswith("..") and word in OPEN_ABBREVIATIONS:
            return "open"
        return "number" if t[-1] == "." and t[-2:-1].isdigit() else "ended"
    if t[-1] == "\ufffd" or t[-1] in ",;:-–—([{“«‘¿¡&/=+、，；：「『（" or t[-1].isalnum() or unicodedata.category(t[-1])[0] == "M" or t[-1] in CLOSERS or t[-1] in "%$€£":
        return "open"
    return "ended"


def tail(text: str) -> tuple[str, list[str], bool]:
    """The last sentence so far, its words, and whether it breaks off after a mark that never ends one."""
    t = text.rstrip()
    start = 0
    for m in _END.finditer(t):
        if m.end() < len(t) and m.end() > start:
            word = t[max(start, m.start() - 80) : m.start()].split()[-1:] or [""]
            if m.group().strip(CLOSERS) == "." and word[0].lower().lstrip("(\"“'«[") in OPEN_ABBREVIATIONS:
                continue
            start = m.end()
    for m in _THAI.finditer(t, start):
        start = m.end()
    part = t[start:].strip()
    words = WORD.findall(_mask(part))
    core = t.rstrip(CLOSERS)[-1:] or t[-1]
    return part, words, t[-1] == "\ufffd" or core in LATIN_STOP and state(t) == "open" or core in ",;:-–—([{“«‘¿¡&/、，；：「『（"


class Endings:
    """Counts over texts: words (u), pairs of words (b), last lines without an end (f) and texts without an end
    (t); how often each was seen, and how often at an end."""

    KINDS = "ubft"

    def __init__(self) -> None:
        self.seen: dict[str, Counter] = {k: Counter() for k in self.KINDS}
        self.ends: dict[str, Counter] = {k: Counter() for k in self.KINDS}

    def __len__(self) -> int:
        return sum(map(len, self.seen.values()))

    def add(self, text: str) -> None:
        seen, ends = self.seen, self.ends
        t = text.rstrip()
        open_end = state(t) == "open"
        if open_end:
            seen["t"][""] += 1
        masked = _mask(t)
        parts, start = [], 0
        for m in _END.finditer(masked):
            if m.end() > start:
                if m.group().strip(CLOSERS) == ".":
                    word = masked[max(start, m.start() - 80) : m.start()].rsplit(None, 1)[-1:] or [""]
                    if word[0].lstrip("(\"“'«[") in OPEN_ABBREVIATIONS:
                        continue
                parts.append((masked[start : m.start()], True))
                start = m.end()
        if start < len(masked):
            parts.append((masked[start:], not open_end))
        for k, (part, ended) in enumerate(parts):
            for piece in _THAI.split(part) if part and max(part) >= "\u0e00" else (part,):
                words = WORD.findall(piece)
                if not words:
                    continue
                if open_end and k == len(parts) - 1:
                    frag = " ".join(words)
                    seen["f"][frag] += 1
                    ends["f"][frag] += 1
                    words.pop()
                    seen["u"].update(words)
                    seen["b"].update(zip(words, words[1:]))
                    continue
                seen["u"].update(words)
                seen["b"].update(zip(words, words[1:]))
                if ended:
                    ends["u"][words[-1]] += 1
                    if len(words) > 1:
                        ends["b"][words[-2], words[-1]] += 1

    def batch(self) -> pa.RecordBatch:
        kinds, keys, n, e = [], [], [], []
        for kind, seen in self.seen.items():
            kinds += [kind] * len(seen)
            keys += map(" ".join, seen) if kind == "b" else seen
            n += seen.values()
            e += map(self.ends[kind].__getitem__, seen)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.array(e, pa.int64())], ["kind", "key", "n", "e"])


def endings(texts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n, e) over all distinct texts: how often each was seen, and how often at an end. Copies
    count once: that a text occurs again doesn't say that texts end like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Endings()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.add(t)
            if len(held) > 400_000:
                yield held.batch()
                held = Endings()
        yield held.batch()

    return once(texts.select(text)).mapInArrow(run, "kind string, key string, n long, e long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def measured(rows: DataFrame, *key: str, text: str = "text") -> DataFrame:
    """Key, state, last words and lengths of each row; nothing of the text itself."""
    types = dict(rows.dtypes)
    names = list(LENGTHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(len(key)).to_pylist():
                s = state(t) if t else "blank"
                _, words, broken = tail(t) if s == "open" else tail(t.rstrip()[:-1]) if s == "number" else ("", [], False)
                for col, v in zip(cols, (s, " ".join(words), words[-1] if words else "", " ".join(words[-2:]) if len(words) > 1 else "", broken, [LENGTHS[n](t) for n in names] if s == "open" else None)):
                    col.append(v)
            arrays = [pa.array(c, pa.string()) for c in cols[:4]] + [pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], *arrays], [*key, "state", "frag", "last", "pair", "broken", "lengths"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "state string, frag string, last string, pair string, broken boolean, lengths array<int>"])
    return rows.select(*key, text).mapInArrow(run, schema)


def hidden_limits(seen: DataFrame, *group: str) -> DataFrame:
    """(group..., encoding, length, n): lengths at which open texts pile up, under each encoding."""
    each = seen.where("state = 'open' and not lengths is null").select(*group, "frag", F.posexplode("lengths").alias("enc", "length"))
    counted = each.groupBy(*group, "enc", "length").agg(F.count_distinct("frag").alias("n"))
    around = W.partitionBy(*group, "enc").orderBy("length").rangeBetween(-60, 60)
    dense = counted.withColumn("near", (F.sum("n").over(around) - F.col("n")) / 120.0)
    names = F.array(*[F.lit(n) for n in LENGTHS])
    # lengths under other encodings echo a limit a few units off: the strongest of them is it
    echo = W.partitionBy(*group).orderBy("length").rangeBetween(-16, 16)
    dense = dense.where((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") >= 6 * F.col("near"))).withColumn("top", F.max("n").over(echo))
    return dense.where(F.col("n") >= 0.7 * F.col("top")).select(*group, "enc", F.element_at(names, F.col("enc") + 1).alias("encoding"), "length", "n")


def cut(rows: DataFrame, key: tuple[str, ...], group: tuple[str, ...], text: str = "text") -> DataFrame:
    """(key..., group..., state, at_limit, cut) of every row."""
    seen = written(measured(rows, *key, *group, text=text), "measured")
    stats = written(endings(rows.select(text), text), "endings")
    n_words = stats.where("kind = 'u'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    n_open = stats.where("kind = 't'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limits = hidden_limits(seen, *group)
    ended = seen.where("state not in ('open', 'number')").select(*key, *group, "state", F.lit(False).alias("at_limit"), F.lit(False).alias("cut"))
    open_ = seen.where("state in ('open', 'number')")
    at = open_.select(*key, *group, F.posexplode("lengths").alias("enc", "length"))
    same = [at[c].eqNullSafe(limits[c]) for c in group]
    at = at.join(limits, [*same, at["enc"] == limits["enc"], at["length"] == limits["length"]], "left_semi").select(*key, *group).distinct().withColumn("at_limit", F.lit(True))
    asks = open_.select(*key, *group, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("u", "last"), ("b", "pair"), ("f", "frag"))])).alias("q")).select(*key, *group, "q.kind", "q.key").where("key <> ''")
    told = asks.join(stats, ["kind", "key"], "left").groupBy(*key, *group).agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col(v))), F.lit(0)).alias(f"{k}_{v}") for k in "ubf" for v in "ne"])
    keys = [*key, *group]
    o, s = open_.alias("o"), told.alias("s")
    full = o.join(s, [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys], "left").select("o.*", *[F.coalesce(f"s.{k}_{v}", F.lit(0)).alias(f"{k}_{v}") for k in "ubf" for v in "ne"]).alias("x")
    full = full.join(at.alias("l"), [F.col(f"x.{c}").eqNullSafe(F.col(f"l.{c}")) for c in keys], "left").select("x.*", F.coalesce("l.at_limit", F.lit(False)).alias("at_limit"))
    word = F.col("u_e") / F.greatest("u_n", F.lit(1))
    likely = (F.col("b_e") + 2 * word) / (F.col("b_n") + 2)
    # far more texts stop after these words than would if texts were cut anywhere
    by_chance = F.col("b_n") * F.lit(n_open / n_words)
    closing = (F.col("f_n") >= 3) & (F.size(F.split("frag", " ")) >= 2) & (F.col("f_n") >= 20 * by_chance)
    # at a limit, a last word that no text has complete is a cut one, however often its fragment recurs
    decimal = (likely < ENDS_LIKE_THAT) & (F.col("b_n") >= LEAST_SEEN)
    verdict = F.when(F.col("state") == "number", decimal).when(F.col("broken") | (F.col("at_limit") & (F.col("u_n") == 0)), True).when(closing, False).when(F.col("at_limit"), True).when(F.col("u_n") < 2, True).otherwise(likely < ENDS_LIKE_THAT)
    return full.select(*key, *group, "state", "at_limit", verdict.alias("cut")).unionByName(ended)


def all_chunks(spark: SparkSession, base: str) -> DataFrame:
    """(src, doc_id, chunk_idx, bucket, gen_model, label, text) of both chunk tables, each row once."""
    cols = ("doc_id", "chunk_idx", "bucket", "gen_model", "label", "chunk_text")
    parts = [once(table(spark, base, n, *cols, distinct=False)).select(F.lit(s).alias("src"), *cols[:-1], F.col("chunk_text").alias("text")) for s, n in (("fresh", "self_ai_fresh_chunks"), ("polished", "self_ai_polished_chunks"))]
    return parts[0].unionByName(parts[1])


KEY = ("src", "doc_id", "chunk_idx")
GROUP = ("bucket", "gen_model")
