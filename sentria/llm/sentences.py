"""Problem 3: sentence boundaries across languages and scripts.

Document-centred: whether a word with a full stop is an abbreviation, and whether a sentence may end
with it, is read off its occurrences elsewhere. One pass counts for every word how often it stands
without a stop and how often its stop comes before

* a small letter or a comma: unambiguous, an abbreviation;
* a capitalised word that the document also has in small letters: unambiguous, a sentence ended;
* another capitalised word, which may be a name; * a number.

The document's own counts decide; where they say nothing, those of the corpus, over its distinct
texts, do (``flags``): a word that has inner stops more often than none is an abbreviation, and so is
one that never goes without its stop and has it before names but not before words that begin
sentences (titles); one whose stop stands mostly before numbers ends nothing there. A sentence may
end with an abbreviation that was seen to end some, before a capital, if what follows isn't a proper
name by its unambiguous places, those inside a sentence: it mostly has an article there, or it never
begins a sentence elsewhere. Only about words of which neither the document nor the corpus says
anything are the lists asked, as in a corpus of a few lines. Counts are a table of any size; the few
words of which it says something are broadcast, or joined to what each document asks for if there
are more than ``MOST_KNOWN``.

Scripts have their own end marks: those of Chinese, Japanese, Hindi and Arabic end a sentence
whatever follows, and in Thai a space between Thai letters does.

Quoted speech and brackets never part inside; a quoted or bracketed sentence stands alone if it
isn't part of another. Null and blank texts have no sentences; a repeated row counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import MARKS, UNSPACED, once, table
from sentria.sources import written

#: Fixed values, the last resort: abbreviations before names, numbers or explanations; they end no sentence.
TITLES = frozenset("dr mr mrs ms prof st rev hon capt col gen lt sgt sra sr srta d dña dn fr hr mme mlle m mm avda av fig figs no nos nr núm num vol p pp ca approx env art cap ch sec e.g i.e cf vs z.b d.h bzw usw u.a p.ej ej s bd hg hrsg tel डॉ श्री د أ م".split())
#: Fixed values, the last resort: abbreviations that may end a sentence.
EITHER = frozenset("etc inc co ltd corp llc jr a.m p.m u.k u.s u.s.a u.n e.u b.c a.d ph.d m.a b.a a.m. p.m. usw u.s.w ago bros dept est".split())
#: German words before an ordinal number.
BEFORE_ORDINAL = frozenset("am der die das den dem des im vom zum zur beim jeder jede jedes seit bis ab unser unsere unserem mein meine sein ihr".split())
#: Pairs of quotation marks and brackets.
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "„": "“", "‹": "›", "《": "》", "【": "】"}
#: what each closing mark may close
OPENERS = {c: [o for o, x in PAIRS.items() if x == c] for c in PAIRS.values()}
CLOSE = "\"'”’»」』)]）】›》"
LATIN_ENDS = ".!?…"
OTHER_ENDS = "。！？｡।॥؟۔"
#: Words that go on with a sentence, where capitals hide it.
GOES_ON = frozenset("and or but then across inside outside opposite behind near next above below beside before because of in at on for from with to la en detrás junto frente sobre bajo dentro cerca al y à au sur sous dans devant derrière près et im am auf unter neben hinter vor und aus".split())
#: Articles and possessives, before a name that doesn't begin a sentence by itself.
ARTICLES = frozenset("the a an our his her their its my your el la los las un una der die das den dem des ein eine einen le les du".split())
#: what is known of a word with a stop, as bits: an abbreviation; sentences may end with it; it ends nothing before a number; a plain word
SHORT, MAY_END, COUNTS, PLAIN = 1, 2, 4, 8
#: occurrences from which the corpus says something, and from which it knows a title
LEAST_STOPS, LEAST_TITLES = 3, 6
#: entries of counts held by a task before they are given out
MOST_HELD = 400_000
#: words that the corpus knows, up to which they are broadcast
MOST_KNOWN = 200_000

_MARK = re.compile(f"[{LATIN_ENDS}]+|[{OTHER_ENDS}]+|[\"“«「『(（\\[„‹《【]|(?<=[ก-๛])[ \\u00a0\\u200b]+(?=[ก-๛])|\\n\\s*\\n")
_WORDS = re.compile(f"[\\w{MARKS}]+")
_WITHIN = "_" + "".join(c for c in map(chr, range(0x3000)) if re.match(f"[{MARKS}]", c))
_GAP = re.compile(r"\s*")
_FOUR = re.compile(r"\s*(?:\S+\s+){3}\S")
_LETTERS = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"([^\W\d_]+),?\s+(?=([^\W\d_]+))")
_START = re.compile(r"(?:^|[^\W\d_]{4}\.\s+|[!?]\s+|\n\s*)([^\W\d_]+)")
_PAIRED = re.compile("[\"" + re.escape("".join({*PAIRS, *PAIRS.values()})) + "]")
_OPENS = "\"“«([„'¿¡「『‘—–"
_TOGETHER = re.compile(r"[^\W_]{1,11}(?:['’][^\W_]+)?")
_FACE = re.compile(r"[:;=][-']?$")
_UNSPACED = re.compile(f"[{UNSPACED}]")
#: Verbs of speech.
_SPEECH = re.compile(r"\b(?:asked|shouted|said|cried|called|replied|whispered|wrote|preguntó|gritó|dijo|fragte|rief|sagte|cria|demanda|dit)\b")


def _stops(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, place of the stop, word) of words with a stop; initials in a row (e.g., U.K.) are one."""
    i = text.find(".")
    while i >= 0:
        j = i
        while j and (text[j - 1].isalnum() or text[j - 1] in _WITHIN):
            j -= 1
        if j < i and not (i - j == 1 and text[i + 1 : i + 2].isalnum()):
            while j >= 2 and text[j - 1] == "." and text[j - 2].isalnum() and not text[j - 3 : j - 2].isalnum():
                j -= 2
            yield j, i, text[j:i]
        i = text.find(".", i + 1)


def evidence(text: str) -> tuple[dict[str, list[int]], Counter]:
    """By word with a stop, how often that stood before a small letter or comma, a number, what may be a
    name, and a word that begins a sentence; and how often each word stands in the text at all.
    Letters with stops in a row count as one too: z. B., a. m."""
    words = Counter(_WORDS.findall(text))
    out: dict[str, list[int]] = {}
    row, row_end = "", -1
    for start, stop, w in _stops(text):
        k = _GAP.match(text, stop + 1).end()
        then = text[k : k + 1]
        if not then or w.isdigit():
            continue
        if then.islower() or then in ",;:":
            kind = 0
        elif k == stop + 1:
            continue
        elif then.isdigit():
            kind = 1
        elif then.isupper():
            follows = _LETTERS.match(text, k).group()
            if len(follows) > 1 and follows.isupper():
                continue  # in capitals throughout
            kind = 3 if follows.lower() in words else 2
        elif then.isalpha() and w[-1].upper() == w[-1].lower():
            kind = 2  # scripts without case have other end marks
        else:
            continue
        have = out.get(w)
        if have is None:
            have = out[w] = [0, 0, 0, 0]
        have[kind] += 1
        if len(w) == 1:
            row = f"{row}.{w}" if row and not text[row_end:start].strip() else w
            row_end = stop + 1
            if len(row) > 1:
                out.setdefault(row, [0, 0, 0, 0])[kind] += 1
        else:
            row = ""
    return out, words


def abbreviations(found: tuple[dict[str, list[int]], Counter]) -> dict[str, int]:
    """What a document's own unambiguous occurrences say."""
    stops, words = found
    out = {}
    for w, (inner, number, name, start) in stops.items():
        bare = words[w] - inner - number - name - start if "." not in w else 0
        if inner >= (1 if len(w) <= 3 else 2) and inner > 2 * bare and inner >= start:
            out[w] = SHORT | (MAY_END if start else 0)
        elif bare >= 2 and not inner and not number:
            out[w] = PLAIN
    return out


def flags(inner: int, number: int, name: int, start: int, bare: int) -> int:
    """What a word's occurrences in the corpus say; 0 for a word like any other."""
    out = 0
    title = name >= LEAST_STOPS and inner + number + name >= LEAST_TITLES and 20 * start <= name and 20 * bare <= inner + number + name
    if (inner >= LEAST_STOPS and inner > bare) or title:
        out = SHORT | (MAY_END if start >= 2 and 10 * start >= name + start else 0)
    if number >= LEAST_STOPS and number > start + name:
        out |= COUNTS
    return out


def names(text: str) -> set[str]:
    """Proper names that go on with a sentence after an abbreviation, by their unambiguous places."""
    inside: Counter = Counter()
    behind: Counter = Counter()
    small = set()
    for m in _INSIDE.finditer(text):
        before, w = m.groups()
        if w.islower():
            small.add(w)
        elif before.islower() and w[0].isupper() and not w.isupper():
            inside[w] += 1
            behind[w] += before in ARTICLES
    begins = set(_START.findall(text)) if inside else ()
    return {w for w, n in inside.items() if w.lower() not in small and (2 * behind[w] > n or (n >= 2 and w not in begins))}


def _regions(text: str) -> dict[int, int]:
    """Where quotations and brackets begin, and the place after each of them, over the whole text: one
    stack for each kind, so that one left open holds no other back."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    straight = -1
    for m in _PAIRED.finditer(text):
        i, c = m.start(), m.group()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == '"':
            begins = bool(after) and not after.isspace()
            apart = not before or before.isspace() or before in "([{“«—–-"
            if straight >= 0 and not (begins and apart):
                out[straight] = i + 1
                straight = -1
            elif begins and (apart or before in ".!?…"):
                straight = i
            continue
        if c in "()" and _FACE.search(text, max(0, i - 2), i):
            continue
        for opener in OPENERS.get(c, ()):
            if open_.get(opener):
                out[open_[opener].pop()] = i + 1
                break
        else:
            # »so« turns them round: what stands behind a word and before a gap closes
            if c in PAIRS and not (c in "«‹" and before and not before.isspace() and (not after or after.isspace())):
                open_.setdefault(c, []).append(i)
    return out


def _lower(c: str) -> bool:
    return c.islower()


def split(text: str, known: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text; known: what the corpus says of words."""
    n = len(text)
    own = abbreviations(evidence(text)) if "." in text else {}
    known = known or {}
    regions = _regions(text)
    found: list[set[str]] = []

    def named(k: int) -> bool:
        if not found:  # only a text that asks is read for names
            found.append(names(text))
        m = _LETTERS.match(text, k)
        return bool(m) and m.group() in found[0]

    cuts: list[int] = []
    start, at = 0, 0

    def begin() -> int:
        s = start
        while s < n and text[s].isspace():
            s += 1
        return s

    def closers(i: int) -> int:
        while i < n and text[i] in CLOSE and not (text[i] == '"' and i in regions) and not (text[i] == "“" and i in regions):
            i += 1
        return i

    while m := _MARK.search(text, at):
        i, e, mark = m.start(), m.end(), m.group()
        if mark[0].isspace():
            if begin() < i:
                cuts.append(i)
                start = e
            at = e
            continue
        if mark in PAIRS or mark == '"':
            end = regions.get(i)
            if end is None:
                at = e
                continue
            # what the quotation or bracket ends with, and what comes after it
            inner = text[i + 1 : end - 1].rstrip()
            e = closers(end)
            last = inner[-1:]
            if inner and inner[-1] in CLOSE:
                last = inner.rstrip(CLOSE)[-1:]
            at = end
            if last and last in LATIN_ENDS + OTHER_ENDS and _after_region(text, i, e, begin(), last, mark, inner):
                cuts.append(e)
                start = at = e
            continue
        e = closers(e)
        if mark[0] in OTHER_ENDS or _ends(text, i, m.end(), e, begin(), mark, own, known, named):
            cuts.append(e)
            start = e
        at = e
    spans, s = [], 0
    for c in [*cuts, n]:
        while s < c and text[s].isspace():
            s += 1
        e = c
        while e > s and text[e - 1].isspace():
            e -= 1
        if e > s:
            spans.append((s, e))
        s = max(s, c)
    return spans


def _after_region(text: str, i: int, e: int, begin: int, last: str, mark: str, inner: str) -> bool:
    """Whether a sentence ends with the quotation or bracket text[i:e]."""
    k = e
    while k < len(text) and text[k].isspace():
        k += 1
    if k == len(text):
        return True
    nxt = text[k]
    whole = begin == i
    if nxt in ",;:)]}»”’、，；：。！？.!?…)）」』-–—&":
        return False
    if mark in "([（【":
        return whole and not _lower(nxt) or (not whole and last in ".。" and nxt.isupper())
    if nxt in "とっ" and mark in "「『":
        return False
    if _lower(nxt):
        return last in "." and not inner.endswith("..")
    if whole and last not in ".。।۔｡" and not any(c.isupper() or c.islower() for c in inner):
        return False  # scripts without case: a question or call at the start is followed by who speaks
    if nxt.isupper() or nxt.isdigit() or not nxt.isalpha():
        return not (last in "!?" and whole and _capitals(text, k) and _SPEECH.search(text[k : k + 60].lower()))
    return last in ".。।۔｡" or not whole


def _ends(text: str, i: int, me: int, e: int, begin: int, mark: str, own: dict[str, bool], known: dict[str, bool], named: Callable[[int], bool]) -> bool:
    """Whether a sentence ends with the mark text[i:me] (up to e with what closes after it)."""
    n = len(text)
    if e >= n:
        return True
    k = e
    while k < n and text[k].isspace():
        k += 1
    if k == n:
        return True
    gap, nxt = k > e, text[k]
    if nxt in ",;:、，；：)]}":
        return False
    if mark != ".":
        if "…" in mark or mark.startswith(".."):
            if not ("!" in mark or "?" in mark):
                if not gap and i and _UNSPACED.match(text[i - 1]):
                    return True
                return not _lower(nxt) and (gap or nxt.isupper() or nxt in "\"“«(¿¡") and not _goes_on(text, k)
        if not gap:
            return not _lower(nxt) and not nxt.isdigit()
        if nxt in "-–—":
            then = text[k + 1 : k + 2]
            return bool(then) and not then.isspace() and not _lower(then)
        return nxt != "&"
    if not gap and (nxt.isdigit() or _lower(nxt) or (not nxt.isalpha() and nxt not in "\"“«(¿¡")):
        return False
    at = i
    while at > begin and not text[at - 1].isspace() and (gap or text[at - 1] != "."):
        at -= 1
    if not gap:
        word = text[at:i].lstrip(_OPENS)
        if not word or len(word) == 1 or (at > begin and text[at - 1] == "."):
            return False
        if nxt.isalpha():
            w = _TOGETHER.match(text, k).group()
            if word[-1:].isupper() and not word.isupper():
                return False
            return len(w) > 1 or w in "IAYOEÀÁÉ" or not w.isupper()
        return True
    word = text[at:i].lstrip(_OPENS)
    low = word.lower()
    if not word:
        return True
    if low.isdigit():
        if len(low) <= 2 and nxt.isalpha():
            stop = at
            while stop > begin and text[stop - 1].isspace():
                stop -= 1
            start = stop
            while start > begin and not text[start - 1].isspace():
                start -= 1
            return text[start:stop].lower() not in BEFORE_ORDINAL
        return True

    def may_end() -> bool:
        return not _lower(nxt) and bool(_FOUR.match(text, begin, i)) and not _goes_on(text, k) and not named(k)

    def by(said: int) -> bool:
        if nxt.isdigit() and said & COUNTS:
            return False
        if said & SHORT:
            return may_end() if said & MAY_END else False
        return True

    if len(word) == 1 and word.isalpha():
        # letters with stops in a row count as one: a. m., z. B.
        row, j = word, at
        while j - 2 >= begin and text[j - 1].isspace() and text[j - 2] == "." and j - 3 >= begin and text[j - 3].isalpha() and (j - 3 == begin or text[j - 4].isspace() or not text[j - 4].isalnum() and text[j - 4] != "."):
            row, j = f"{text[j - 3]}.{row}", j - 3
        if len(row) > 1:
            said = _said(row, own, known)
            if said:
                return by(said)
            joined = row.lower()
            if joined in ("a.m", "p.m") or joined in EITHER:
                return may_end()
            return not _lower(nxt) and bool(_FOUR.match(text, begin, i)) and joined not in TITLES and not named(k)
        said = _said(word, own, known)
        if said and said != PLAIN:
            return by(said)
        if word.isupper() or low in TITLES or _caseless(word) or re.match(r"[^\W\d_]\.", text[k : k + 2]):
            return False
        return not _lower(nxt)
    said = _said(word, own, known)
    if said:
        return by(said)
    if low in TITLES:
        return low == "no" and not nxt.isdigit()
    if low in EITHER:
        return may_end()
    return True


def _said(word: str, own: dict[str, int], known: dict[str, int]) -> int:
    """What the document, else the corpus, says of a word: as it is spelled, else in another case. Whether
    sentences may end with a document's abbreviation the corpus is asked too, then the list."""
    forms = dict.fromkeys((word, word.lower(), word.capitalize(), word.upper()))
    told = next((said for form in forms if (said := known.get(form, 0))), 0)
    for form in forms:
        said = own.get(form, 0)
        if said & SHORT:
            return said | told & MAY_END | (MAY_END if not told and word.lower() in EITHER else 0)
        if said and form == word:
            return said
    return told


def _capitals(text: str, k: int) -> bool:
    """Whether the word at k is in capitals, so that its first letter says nothing."""
    m = re.match(r"[^\W\d_]+", text[k : k + 30])
    return bool(m) and len(m.group()) > 1 and m.group().isupper()


def _goes_on(text: str, k: int) -> bool:
    """Whether a word in capitals at k goes on with a sentence rather than begins one."""
    return _capitals(text, k) and re.match(r"[^\W\d_]+", text[k : k + 30]).group().lower() in GOES_ON


def _caseless(w: str) -> bool:
    return w.upper() == w.lower()


def asked(found: tuple[dict[str, list[int]], Counter], text: str, own: dict[str, int]) -> set[str]:
    """The words with a stop about which a text's own occurrences say nothing, as they may be looked up."""
    out: set[str] = set()
    for w in {w for _, _, w in _stops(text)} | set(found[0]):
        if not w.isdigit() and own.get(w) != PLAIN:
            out |= {w, w.lower(), w.capitalize(), w.upper()}
    return out


COUNTED = ("inner", "number", "name", "start", "bare")
_NONE = [0, 0, 0, 0]


def learnt(texts: DataFrame, text: str) -> DataFrame:
    """(w, said): what all of some distinct texts say of words with a stop, by flags()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts() -> pa.RecordBatch:
            ws = list({**held, **words})
            got = [held.get(w, _NONE) for w in ws]
            sums = [*([g[k] for g in got] for k in range(4)), [words[w] - sum(g) if "." not in w else 0 for w, g in zip(ws, got)]]
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *(pa.array(c, pa.int64()) for c in sums)], ["w", *COUNTED])

        held: dict[str, list[int]] = {}
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                stops, all_words = evidence(t)
                for w, n in stops.items():
                    have = held.get(w)
                    held[w] = [x + y for x, y in zip(have, n)] if have else n
                words.update(all_words)
            if len(held) + len(words) > MOST_HELD:
                yield counts()
                held, words = {}, Counter()
        yield counts()

    rows = texts.mapInArrow(run, "w string, " + ", ".join(f"{c} long" for c in COUNTED))
    n = {c: F.col(c) for c in COUNTED}
    stops = n["inner"] + n["number"] + n["name"]
    title = (n["name"] >= LEAST_STOPS) & (stops >= LEAST_TITLES) & (20 * n["start"] <= n["name"]) & (20 * n["bare"] <= stops)
    short = ((n["inner"] >= LEAST_STOPS) & (n["inner"] > n["bare"])) | title
    ends = (n["start"] >= 2) & (10 * n["start"] >= n["name"] + n["start"])
    number = (n["number"] >= LEAST_STOPS) & (n["number"] > n["start"] + n["name"])
    said = F.when(short, F.when(ends, SHORT | MAY_END).otherwise(SHORT)).otherwise(0) + F.when(number, COUNTS).otherwise(0)
    return rows.groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTED]).select("w", said.alias("said")).where("said > 0")


def looked_up(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(h, words): by a text's digest, what known(w, said) says of the words that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ws = [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = evidence(t)
                asks = asked(found, t, abbreviations(found))
                hs += [h] * len(asks)
                ws += asks
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.string()), pa.array(ws, pa.string())], ["h", "w"])

    asks = texts.select(F.md5(text).alias("h"), text).mapInArrow(run, "h string, w string")
    return asks.join(known, "w").groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct("w", "said"))).alias("words"))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "doc_text", keep_text: bool = False, most_known: int = MOST_KNOWN) -> DataFrame:
    """(key, char_start, char_end[, sentence_text]) of every sentence, in code points. What the corpus says of
    up to most_known words is broadcast, so that texts aren't shuffled; beyond that it is joined."""
    docs = once(docs.select(key, text).where(F.col(text) != ""))
    texts = once(docs.select(text))
    known = written(learnt(texts, text), "stops")
    kind = dict(docs.dtypes)[key]
    held = None
    if known.count() <= most_known:
        held = docs.sparkSession.sparkContext.broadcast({r["w"]: r["said"] for r in known.toLocalIterator()})
        rows = docs
    else:
        rows = docs.withColumn("h", F.md5(text)).join(looked_up(texts, text, known), "h", "left").select(key, text, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, ends, said = [], [], [], []
            told = b.column(2).to_pylist() if held is None else None
            for k, t in enumerate(b.column(1).to_pylist()):
                for s, e in split(t, held.value if told is None else dict(told[k] or ())):
                    at.append(k)
                    starts.append(s)
                    ends.append(e)
                    if keep_text:
                        said.append(t[s:e])
            arrays = [b.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            names = [key, "char_start", "char_end"]
            if keep_text:
                arrays.append(pa.array(said, pa.string()))
                names.append("sentence_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = rows.mapInArrow(run, f"`{key}` {kind}, char_start int, char_end int" + (", sentence_text string" if keep_text else ""))
    # rows are distinct already, unless a key has several texts
    return out.distinct() if docs.groupBy(key).count().where("count > 1").take(1) else out


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences(table(spark, base, "doc_manifest", "doc_id", "doc_text", distinct=False))


def p3_sentences(spark: SparkSession, base: str) -> DataFrame:
    """The sentences with their texts."""
    return sentences(table(spark, base, "doc_manifest", "doc_id", "doc_text", distinct=False), keep_text=True)


def p3_stored(spark: SparkSession, base: str) -> DataFrame:
    """By document: true sentences, stored units, and units that are a true sentence."""
    got = p3_found(spark, base).withColumn("true", F.lit(1))
    units = table(spark, base, "sentence_dataset", "doc_id", "char_start", "char_end").where("doc_id is not null").withColumn("stored", F.lit(1))
    both = got.join(units, ["doc_id", "char_start", "char_end"], "full")
    return both.groupBy("doc_id").agg(F.count("true").alias("sentences"), F.count("stored").alias("units"), F.count(F.col("true") + F.col("stored")).alias("same"))
