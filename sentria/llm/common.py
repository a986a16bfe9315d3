"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentria.sources import read_table, with_columns_only, written

#: Ranges of scripts written without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = "฀-໿က-႟ក-៿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"

#: Combining marks belong to the word they stand in (Devanagari, Arabic, Thai and so on).
MARKS = "̀-ͯؐ-ًؚ-ٰٟऀ-ःऺ-ॏ॑-ॗॢॣัิ-ฺ็-๎‌‍"

#: A letter or digit of an unspaced script by itself, else a run of letters and digits.
WORD = re.compile(f"[{UNSPACED}][{MARKS}]*|(?:[^\\W_{UNSPACED}]|[{MARKS}])+")
LETTER_WORD = re.compile(f"[{UNSPACED}][{MARKS}]*|(?:[^\\W\\d_{UNSPACED}]|[{MARKS}])+")


def table(spark: SparkSession, base: str, name: str, *columns: str, distinct: bool = True) -> DataFrame:
    """Some columns of a table; rows repeated in them count once."""
    return with_columns_only(read_table(spark, base, name), *columns, distinct=distinct)


def labelled(spark: SparkSession, base: str, per_language: int) -> list[tuple[str, str]]:
    """(lang, text) of eval_items, rows labelled with their language and known to be ordinary text: of each
    language, wherever it begins, the texts up to the one that reaches per_language characters."""
    rows = table(spark, base, "eval_items", "item_id", "lang", "text").where("lang is not null and text is not null")
    before = W.partitionBy("lang").orderBy("item_id", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("held", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("held") < per_language)
    return [(r["lang"], r["text"]) for r in rows.orderBy("lang", "item_id", "text").select("lang", "text").toLocalIterator()]


def unique_by(df: DataFrame, *key: str) -> DataFrame:
    """Rows repeated in df, once. Long texts aren't shuffled for it unless a key does repeat: only
    the keys are counted first, in one narrow aggregate."""
    repeated = df.groupBy(*key).count().where("count > 1").limit(1)
    return df.distinct() if repeated.take(1) else df


def once(df: DataFrame) -> DataFrame:
    """df's distinct rows. Only rows whose digest recurs are shuffled with their texts: digests are counted
    first, and those that recur, written, are joined (broadcast if their files are small)."""
    z = F.xxhash64(*df.columns)
    again = written(df.select(z.alias("_z")).groupBy("_z").count().where("count > 1").select("_z"), "again")
    marked = df.withColumn("_z", z)
    alone = marked.join(again, "_z", "left_anti").select(*df.columns)
    return alone.unionByName(marked.join(again, "_z", "left_semi").select(*df.columns).distinct())


def tidy(c: Column | str) -> Column:
    """Trimmed and lower case; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(out != "", out)


def within(a: list, b: list, most: int) -> bool:
    """Whether two sequences are at most ``most`` changes (put in, left out, replaced) apart. What they
    share at both ends is left aside; the rest goes through Myers' bit-parallel columns, so long
    ones cost length times length / 64."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    s = 0
    while s < n and s < m and a[s] == b[s]:
        s += 1
    while n > s and m > s and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    n, m = n - s, m - s
    if not n or not m:
        return max(n, m) <= most
    a, b = a[s : s + n], b[s : s + m]
    if max(n, m) > 4 * most + 8 and sum((Counter(a) & Counter(b)).values()) < max(n, m) - most:
        return False  # too few words in common, in any order
    peq: dict = {}
    for i, x in enumerate(a):
        peq[x] = peq.get(x, 0) | (1 << i)
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, left = full, 0, n, m
    for x in b:
        left -= 1
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score - left > most:
            return False
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return score <= most
