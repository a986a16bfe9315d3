"""Problem 2: broken prompt and response pairs, and what follows for problem 5.

An answer is compared with the message that asked for it: with the whole message, and with its last
part (the question, or the paragraph to rework). Each defective pair has one defect, the first of:
``empty``, ``copy`` (at most one word in seven changed, by an exact bit-parallel distance),
``refusal`` (one of the answer's first sentences declines, by a model of wording that is trained on
examples made by rule; the answer's length doesn't matter), ``language`` and ``truncated`` (problem
5's endings, by the likelihood of how texts end). Cases of problem 1 are left out.

``language``: character n-gram naive Bayes gives posteriors of the languages for the question and
for each sentence of the answer. The answer's share of a language is the mean of its sentences'
posteriors, by letters; the two agree by the sum over languages of posterior times share, and an
answer that agrees by less than ``AGREE`` is in another language. A text mostly in letters of a
script is compared among the labelled languages of that script; where there are none, the script
stands for its languages.

The language model is fitted on labelled rows: the held-out items, and at most ``PER_LANGUAGE``
characters of each language, whatever the corpus' size. Jobs repeated count once; a chunk with
several messages is compared with each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm import examples, residue, truncation
from sentria.llm.common import WORD, labelled, table, within
from sentria.llm.wording import Wording, tokens
from sentria.sources import written

PER_LANGUAGE = 20_000
N = 3

AGREE = 0.5
#: log-odds from which a sentence declines, and the sentences at an answer's start that are asked
DECLINES = 0.5
OPENING = 3

_PART = re.compile(r"(?:^|[\s.])(?:question|task|text|topic|prompt|paragraph|tema|pregunta|texto|párrafo|frage|thema|text|absatz|sujet|question|texte|paragraphe|tâche|aufgabe|tarea)\s?:\s*", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?…。！？।؟]+[\"'”’»)\]」』]*\s*|\n+")

#: Scripts by their letters. Kana tell Japanese from Chinese.
SCRIPTS = (("Latin", "a-zÀ-ɏ"), ("Cyrillic", "Ѐ-ӿ"), ("Greek", "Ͱ-Ͽ"), ("Hebrew", "א-ת"), ("Arabic", "؀-ۿ"), ("Devanagari", "ऀ-ॿ"), ("Thai", "ก-๛"), ("Kana", "぀-ヿ"), ("Han", "一-鿿"), ("Hangul", "가-힣"))
_SCRIPT = [(name, re.compile(f"[{r}]")) for name, r in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")


def script(text: str) -> tuple[str, int]:
    """The script of most of a text's letters, and how many of them there are; text in lower case."""
    if not text or max(text) < "\u0250":
        return "Latin", len("".join(_LETTERS.findall(text)))
    n = {name: len(p.findall(text)) for name, p in _SCRIPT}
    if n["Kana"]:
        n["Kana"] += n.pop("Han")
    name = max(n, key=lambda x: n[x] * (3 if x in ("Han", "Kana") else 1))
    return name, n[name]


class Languages:
    """Naive Bayes over the character n-grams of words, with additive smoothing. A word's weights are
    made once and kept in a bounded memo, so a sentence is a sum of tuples."""

    def __init__(self, rows: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        written_in: dict[str, Counter] = {}
        for lang, text in rows:
            low = text.lower()
            own = counts.setdefault(lang, Counter())
            name, n = script(low)
            written_in.setdefault(lang, Counter())[name] += n
            for w in _LETTERS.findall(low):
                own.update(self.grams(w))
        space = len(set().union(*counts.values())) + 1 if counts else 1
        self.names = sorted(counts)
        #: by script, the places of its languages in names
        self.of_script: dict[str, list[int]] = {}
        self.weight = []
        for k, lang in enumerate(self.names):
            self.of_script.setdefault(written_in[lang].most_common(1)[0][0], []).append(k)
            total = sum(counts[lang].values()) + 0.2 * space
            self.weight.append(({g: math.log((n + 0.2) / total) for g, n in counts[lang].items()}, math.log(0.2 / total)))
        self.memo: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def grams(word: str) -> list[str]:
        t = f" {word} "
        return [t[i : i + N] for i in range(len(t) - N + 1)]

    def word(self, w: str) -> tuple[float, ...]:
        known = self.memo.get(w)
        if known is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            grams = self.grams(w)
            known = self.memo[w] = tuple(sum(p.get(g, rest) for g in grams) for p, rest in self.weight)
        return known

    def posteriors(self, text: str) -> tuple[dict[str, float], int]:
        """The languages' posteriors for a text, and its letters; none without letters."""
        low = text.lower()
        name, n = script(low)
        if not n:
            return {}, 0
        among = self.of_script.get(name)
        if not among:
            return {name: 1.0}, n
        if len(among) == 1:
            return {self.names[among[0]]: 1.0}, n
        sums = [sum(c) for c in zip(*map(self.word, _LETTERS.findall(low)))]
        top = max(sums[k] for k in among)
        odds = {self.names[k]: math.exp(max(sums[k] - top, -700.0)) for k in among}
        total = sum(odds.values())
        return {k: v / total for k, v in odds.items()}, n

    def of(self, text: str) -> str | None:
        """The language of a text with the greatest posterior; None without letters."""
        found, _ = self.posteriors(text)
        return max(found, key=found.__getitem__) if found else None

    def agreement(self, asked: str, answer: str, enough: float = 1.0) -> float:
        """How far two texts agree in language: 1 where either has no letters. Each sentence of the answer
        counts by its letters; those of a script without spaces count as three. Once ``enough`` is
        reached whatever the rest says, the rest isn't read."""
        wanted, _ = self.posteriors(asked)
        parts = []
        for part in _SENTENCE.split(answer):
            if len(part) >= 2:
                name, n = script(part.lower())
                if n:
                    parts.append((part, n * (3 if name in ("Han", "Kana") else 1)))
        same, total = 0.0, sum(n for _, n in parts)
        if not total or not wanted:
            return 1.0
        for part, n in parts:
            got, _ = self.posteriors(part)
            same += n * sum(p * wanted.get(k, 0.0) for k, p in got.items())
            if same >= enough * total:
                break
        return same / total


class Judge:
    """Everything that is fitted: languages and the wording of refusals."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = Languages(rows)
        self.declines = Wording(examples.refusals(), examples.accepted([s for _, t in rows for s in residue.segments(t)]))

    def refuses(self, answer: str) -> bool:
        """Whether one of an answer's first sentences declines the task."""
        parts = [p for p in _SENTENCE.split(answer) if any(map(str.isalpha, p))]
        return any(self.declines.score(tokens(p)) >= DECLINES for p in parts[:OPENING])


def fitted(spark: SparkSession, base: str) -> Judge:
    """The models, fitted on eval_items: at most PER_LANGUAGE characters of each language."""
    return Judge(labelled(spark, base, PER_LANGUAGE))


def question(message: str) -> str:
    """The last part of a message: what comes after its last label, else all of it."""
    at = 0
    for m in _PART.finditer(message):
        at = m.end()
        if message[m.start() : m.end()].strip(" .\n").lower().startswith(("text", "paragraph", "absatz", "párrafo", "texto")):
            break
    return message[at:].strip() or message.strip()


def norm(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "").replace("'", ""))


def is_copy(answer: str, message: str) -> bool:
    """Whether the answer is the message, or its last part, with at most one word in seven changed."""
    a = norm(answer)
    if a and a[0] in ("q", "question", "prompt") and len(a) > 4:
        options = [a, a[1:]]
    else:
        options = [a]
    for part in {message, question(message)}:
        b = norm(part)
        for x in options:
            if x and b and within(x, b, max(len(x), len(b)) // 7):
                return True
    return False


def defect(answer: str | None, message: str, judge: Judge) -> str | None:
    if answer is None or not any(c.isalnum() for c in answer):
        return "empty"
    if is_copy(answer, message):
        return "copy"
    if judge.refuses(answer):
        return "refusal"
    return "language" if judge.languages.agreement(question(message), answer, AGREE) < AGREE else None


def jobs(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "generation_jobs", "job_id", "doc_id", "chunk_idx", "user_message").where("user_message is not null").select("doc_id", "chunk_idx", "user_message").distinct()


def compared(spark: SparkSession, base: str, chunks: DataFrame) -> DataFrame:
    """(src, doc_id, chunk_idx, defect) of every pair of chunks whose defect shows beside its message."""
    model = spark.sparkContext.broadcast(fitted(spark, base))
    rows = chunks.where("label = 1").join(jobs(spark, base), ["doc_id", "chunk_idx"]).select("src", "doc_id", "chunk_idx", "text", "user_message")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [defect(t, m, model.value) for t, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.string())], ["src", "doc_id", "chunk_idx", "defect"])

    return rows.mapInArrow(run, "src string, doc_id string, chunk_idx int, defect string")


def _residue(spark: SparkSession, base: str) -> DataFrame:
    return residue.p1_found(spark, base).select(F.lit("fresh").alias("src"), "doc_id", "chunk_idx")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    rank = F.when(F.col("defect") == "empty", 0).when(F.col("defect") == "copy", 1).when(F.col("defect") == "refusal", 2).when(F.col("defect") == "language", 3).otherwise(4)
    chunks = written(truncation.all_chunks(spark, base), "chunks")
    pairs = compared(spark, base, chunks)
    cuts = truncation.cut(chunks, truncation.KEY, truncation.GROUP).where("cut").select("src", "doc_id", "chunk_idx").distinct().withColumn("is_cut", F.lit(True))
    all_pairs = pairs.join(cuts, list(truncation.KEY), "left").select("src", "doc_id", "chunk_idx", F.coalesce("defect", F.when(F.col("is_cut"), F.lit("truncated"))).alias("defect"))
    left = all_pairs.where("defect is not null").join(_residue(spark, base), list(truncation.KEY), "left_anti")
    return left.groupBy("doc_id", "chunk_idx").agg(F.min_by("defect", rank).alias("defect"))


def p2_rates(spark: SparkSession, base: str) -> DataFrame:
    """Pairs and defects by model and prompt style."""
    found = p2_found(spark, base)
    cols = ("doc_id", "chunk_idx", "gen_model", "prompt_style", "label")
    chunks = table(spark, base, "self_ai_fresh_chunks", *cols).unionByName(table(spark, base, "self_ai_polished_chunks", *cols)).where("label = 1").drop("label")
    asked = jobs(spark, base).select("doc_id", "chunk_idx").distinct()
    return chunks.join(asked, ["doc_id", "chunk_idx"]).join(found, ["doc_id", "chunk_idx"], "left").groupBy("gen_model", "prompt_style", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))


def _cuts(spark: SparkSession, base: str) -> DataFrame:
    """All chunks of both tables with the verdict, cases of the other problems and defects aside."""
    chunks = written(truncation.all_chunks(spark, base), "chunks")
    cuts = truncation.cut(chunks, truncation.KEY, truncation.GROUP)
    others = compared(spark, base, chunks).where("defect in ('refusal', 'copy', 'language')").select("src", "doc_id", "chunk_idx").union(_residue(spark, base)).distinct()
    return cuts.join(others, list(truncation.KEY), "left_anti")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _cuts(spark, base).where("cut").select("doc_id", "chunk_idx").distinct()


def p5_rates(spark: SparkSession, base: str) -> DataFrame:
    """Chunks, cut chunks and those at a hidden limit, by bucket and model."""
    rows = _cuts(spark, base).where("state <> 'blank'").groupBy("src", "doc_id", "chunk_idx", "bucket", "gen_model").agg(F.max("cut").alias("cut"), F.max("at_limit").alias("at_limit"))
    n = F.count("*")
    return rows.groupBy("bucket", "gen_model").agg(n.alias("chunks"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"), (F.count_if("cut") / n).alias("rate"))


def p5_limits(spark: SparkSession, base: str) -> DataFrame:
    """The hidden storage limits: lengths at which texts without an end pile up, by encoding."""
    rows = truncation.all_chunks(spark, base)
    return truncation.hidden_limits(truncation.measured(rows, *truncation.KEY, *truncation.GROUP), *truncation.GROUP).select("bucket", "gen_model", "encoding", "length", "n")
