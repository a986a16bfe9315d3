"""Text functions over columns, all JVM-side.

Java's ``\\w`` and ``\\s`` are ASCII by default; ``(?U)`` makes them Unicode where the semantics need it.
Null in, null out, unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that end in a full stop but end no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc e.g i.e no fig vol gen rep sen col gov lt capt u.s u.k u.n a.m p.m ph.d b.a m.a"
).split()

#: Words and phrases that language models overuse.
TELL_WORDS = (
    "delve, delves, delving, tapestry, boasts, showcase, showcases, showcasing, underscore, underscores, underscoring, "
    "furthermore, moreover, additionally, notably, importantly, ultimately, overarching, multifaceted, intricate, "
    "intricacies, paramount, pivotal, invaluable, indelible, testament, navigate, navigating, landscape, realm, foster, "
    "fosters, fostering, endeavor, endeavors, cultivate, cultivates, holistic, robust, leverage, leveraging, synergy, "
    "in conclusion, in summary, to summarize, it is important to, it is worth noting, it is essential to, "
    "plays a crucial role, plays a significant role, in today's society, in today's world"
).split(", ")

#: What may stand after an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "ll", "d", "m")

MARK = "\u0001"


def quoted(word: str) -> str:
    """A word as a regular expression, for Java and RE2 alike."""
    return "".join("\\" + c if c in ".()[]{}*+?|^$\\" else c for c in word)


def any_of(words: list[str]) -> str:
    """Alternatives, longest first, so that the first match is the longest."""
    return "|".join(quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)))


#: A sentence end: marks, what closes after them, white space, then what may begin a sentence. The word
#: before it must be no abbreviation and have more than one character.
BOUNDARY = r"(?U)(?=[.!?])(?<![.!?])(?<!(?:^| )(?:(?i:" + any_of(ABBREVIATIONS) + r")\.{0,8}|[^ .]\.{1,8}|[^\s.])\s{0,8})([.!?]+['\")\]]*)(\s+)(?=[A-Z0-9\"'(])"
CONTRACTION = r"(?iU)\b\w+'(?:" + "|".join(CONTRACTIONS) + r")\b"
TELL = r"(?iU)\b(?:" + any_of(TELL_WORDS) + r")\b"
WORD = r"[A-Za-z']+"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c: Column) -> Column:
    """Stripped, and each run of spaces, tabs and newlines as one space; other white space stays."""
    return F.regexp_replace(strip(c), r"[ \t\n]+", " ")


def split_pieces(normalized: Column) -> Column:
    """The parts of a normalized text between sentence ends; all but the first begin with the white
    space that parted them, so that lengths add up to offsets."""
    return F.split(F.regexp_replace(normalized, BOUNDARY, f"$1{MARK}$2"), MARK)


def split_sentences(normalized: Column) -> Column:
    """Sentences of a normalized text; an empty array for an empty one."""
    parts = F.transform(split_pieces(normalized), lambda p, i: F.when(i == 0, p).otherwise(F.regexp_replace(p, r"(?U)^\s+", "")))
    return F.filter(parts, lambda p: F.length(strip(p)) > 0)


def words(c: Column) -> Column:
    """ASCII letters and apostrophes, in runs."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def contraction_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CONTRACTION))


def tell_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TELL))


def count_of(c: Column, *parts: str) -> Column:
    """How often any of some one-character strings occurs."""
    return F.length(c) - F.length(F.translate(c, "".join(parts), ""))


def comma_rate(c: Column) -> Column:
    """Commas per 100 characters."""
    return count_of(c, ",") * 100.0 / F.greatest(F.length(c), F.lit(1))


def semicolon_dash_rate(c: Column) -> Column:
    """Semicolons, em dashes and hyphens between spaces, per 100 characters."""
    hyphens = (F.length(c) - F.length(F.replace(c, F.lit(" - "), F.lit("")))) / 3.0
    return (count_of(c, ";", "—") + hyphens) * 100.0 / F.greatest(F.length(c), F.lit(1))


def punctuation_density(c: Column) -> Column:
    """Share of . , ; : ! ? em dash and hyphen."""
    return count_of(c, ".", ",", ";", ":", "!", "?", "—", "-").cast("double") / F.greatest(F.length(c), F.lit(1))


def lowered(c: Column) -> Column:
    """An array of words in lower case."""
    return F.transform(c, F.lower)


def mean_word_length(w: Column) -> Column:
    n = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.size(w) > 0, n.cast("double") / F.size(w)).otherwise(F.lit(0.0))


def unique_ratio(w: Column) -> Column:
    return F.size(F.array_distinct(lowered(w))).cast("double") / F.greatest(F.size(w), F.lit(1))


def ngrams(w: Column, n: int) -> Column:
    """Adjacent words, in lower case, joined by a space; no elements if there are fewer than n. Zipped
    slices, as an array inside a lambda would be made again for each element."""
    low = lowered(w)
    size = F.greatest(F.size(w) - (n - 1), F.lit(0))
    out = F.slice(low, 1, size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(low, k, size), lambda a, b: F.concat_ws(" ", a, b))
    return out


def repetition(grams: Column) -> Column:
    """1 - distinct n-grams / n-grams; 0 with fewer than two of them. grams: a column, made before."""
    return F.when(F.size(grams) >= 2, 1.0 - F.size(F.array_distinct(grams)).cast("double") / F.size(grams)).otherwise(F.lit(0.0))


def mattr(low: Column, window: int = 40) -> Column:
    """Mean type-token ratio of windows that begin every half window; of the whole text if it has no
    more words than a window; 0 without words. low: a column of words in lower case, made before."""
    n = F.size(low)
    starts = F.sequence(F.lit(0), n - window, F.lit(window // 2))
    ratios = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(low, i + 1, window))) / F.lit(float(window)))
    mean = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x) / F.size(starts)
    return F.when(n == 0, F.lit(0.0)).when(n <= window, F.size(F.array_distinct(low)).cast("double") / n).otherwise(mean)


def clean_essay(c: Column) -> Column:
    """A generated essay without one quotation mark at either end, a label line and a heading line."""
    t = F.regexp_replace(strip(c), r'^"|"$', "")
    t = F.regexp_replace(t, r"(?i)^(?:Title|Essay|Prompt Response)\s*:[^\n]*\n", "")
    return strip(F.regexp_replace(t, r"^#+\s*[^\n]*\n", ""))


def paragraphs(c: Column) -> Column:
    """What stands between blank lines."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def preview(c: Column, most: int = 160) -> Column:
    """One line of at most ``most`` characters and three dots."""
    t = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def percent(c: Column) -> Column:
    """One decimal and a percent sign; n/a for null."""
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c * 100.0)).otherwise(F.lit("n/a"))


def prob_color(p: Column) -> Column:
    """Colour of a probability: from slate to red, opaque only towards 1."""
    t = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    channel = lambda a, b: F.floor(F.lit(float(a)) + F.lit(float(b - a)) * t + F.lit(0.5)).cast("int")
    return F.format_string("rgba(%d, %d, %d, %.2f)", channel(90, 239), channel(100, 68), channel(140, 68), F.pow(t, F.lit(1.6)) * 0.62)


def prob_glow(p: Column) -> Column:
    """Shadow of a probability: none below 0.75, then linearly wider and stronger."""
    t = (p - 0.75) / 0.25
    return F.when(p < 0.75, F.lit("none")).otherwise(F.format_string("0 0 %dpx rgba(239, 68, 68, %.2f)", F.floor(F.lit(6.5) + t * 10.0).cast("int"), F.lit(0.15) + t * 0.25))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
