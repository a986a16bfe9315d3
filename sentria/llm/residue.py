"""Problem 1: template residue, filler, error pages and script notices.

Texts are cut into segments (lines and sentences, mark-up and quotations aside). A linear model of
wording gives each segment log-odds of being residue; it is trained here on examples made by rule
and on the held-out items (``passages``), which are ordinary text. Segments that can't become residue
whatever their template says, nearly all, end there, so that no ordinary text is ever shuffled.

The others are mined for templates by a prefix tree of fixed depth: number of words, then the first
``DEPTH`` words, numbers and codes masked. Equal segments are counted first; in each leaf, the most
frequent first, a segment joins the most similar cluster if it has ``SIMILAR`` of its words in
common, place by place, else it begins one, and places in which members differ become variable. Each
cluster is a template and is classified once: by the mean log-odds of its members' wording and the
log-odds of its constant words, the bar being lower for a template of several documents (``SPREAD``
for each doubling, up to eight) that is mostly constant. The verdict is propagated to all members. A leaf's distinct segments go
through one task as a stream that holds its clusters only.

Unresolved slots are looked for in the whole text of every record, as they stand inside ordinary
sentences. A slot that a text tells of ("a mark such as ...") and other brackets are none.

Null and blank texts hold no residue. Repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm import examples
from sentria.llm.common import labelled, table
from sentria.llm.wording import Wording, tokens
from sentria.sources import written

DEPTH = 4
SIMILAR = 0.6
#: log-odds from which a template is residue
BAR = 0.33
SPREAD = 0.04
#: log-odds below which a segment is no candidate
CANDIDATE = -0.6
#: characters of each language of the held-out items that the model learns from
PER_LANGUAGE = 60_000

#: What templates ask for.
SLOT_NAMES = r"(?:first |last |full |school |family |favou?rite |job |your |my )?[ _]?(?:name|city|town|hometown|home town|street|address|state|country|school|college|university|teacher|mentor|coach|friend|sibling|member|parent|club|team|hobby|sport|book|award|event|date|day|month|year|time|place|subject|topic|title|company|job|number|phone|email|age)"
#: What goes before a slot that is only told of.
TOLD = r"(?:such as|for example|e\.g\.|marks?|symbols?|placeholders?|typed)[\s:,\"'“‘«]{1,3}(?:\{\{[^{}\n]*\}\}|\$?\{[^{}\n]*\}|\[[^\[\]\n]*\]|<[^<>\n]*>|%\(\w+\)s|%s|__\w+__|@@\w+@@|#\w+#)"
SLOTS = (
    r"\{\{[\s\w.]{1,60}\}\}", r"\$\{[\s\w.]{1,60}\}", r"(?<![\w$\{])\{[^\W\d_][\w ]{0,60}\}(?!\})", r"\{%[^%\n]{1,60}%\}", r"<%=?[^%\n]{1,60}%>", r"\[\[[\s\w]{1,60}\]\]", r"\[XX[^\]\n]{1,60}XX\]", r"@@\w{1,60}@@", r"(?<![\w#])#\w{1,60}#(?!\w)", r"(?<!\w)__[^\W\d_]\w{0,60}?__(?!\w)", r"%\(\w{1,60}\)[sd]", r"(?<![\w%])%s(?!\w)",
    r"_{3,}\s?\([^)\n]{1,40}\)", r"<(?:insert|your|enter|add)\b[^<>\n]{0,60}>", r"\((?:insert|enter|add) [^)\n]{1,40}\)", r"\[(?:insert|enter|add|your|aquí|hier|ici|nom|nombre|name)\b[^\]\n]{0,60}\]", r"\[" + SLOT_NAMES + r"\]", r"(?<!\w)TODO:\s?\w+", r"\b(?:is|was|at|in|about|told|joining|near|from|with|for|to) (?:undefined|null|nan|n/a|\[object object\])(?=[\s.,;!?])",
)
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,200}>")
_QUOTED = re.compile(r"(?<=[\w,:] )(?:\"[^\"\n]{1,300}\"|[“«„][^”»“\n]{1,300}[”»“])")
_CUT = re.compile(r"\n+|(?<=[.!?…。！？])\s+|(?<=[.!?])(?=[A-ZÀ-Þ<{\"“(])")
_MASK = re.compile(r"\S*\d\S*")
_SLOT = re.compile("|".join(SLOTS), re.IGNORECASE)
_TOLD = re.compile(TOLD, re.IGNORECASE)
_MAY_HOLD = re.compile(r"[{}\[<%@#]|__|\((?:insert|enter|add)|todo|undefined|null|nan|n/a", re.IGNORECASE)
#: The kinds of residue beside slots.
KINDS = ("error", "notice", "filler")


def has_slot(text: str) -> bool:
    """Whether a text holds an unresolved slot."""
    return bool(_MAY_HOLD.search(text)) and bool(_SLOT.search(_TOLD.sub(" ", text)))


def segments(text: str) -> list[str]:
    """Lines and sentences of a text, mark-up aside, and what a sentence quotes."""
    parts = _CUT.split(_QUOTED.sub(" ", _TAG.sub("\n", text)))
    return [s for p in parts if p and (s := p.strip())]


def masked(segment: str) -> str:
    """A segment's words, numbers and codes masked."""
    return " ".join(_MASK.sub("*", segment.lower()).split())


def path(words: list[str]) -> str:
    """A segment's leaf in the tree."""
    return " ".join([str(len(words)), *words[:DEPTH]])


class Classes:
    """Residue or not, and of what kind, by wording."""

    def __init__(self, passages: list[str]):
        self.residue = Wording(examples.residue(), examples.ordinary(passages))
        made = {"error": examples.made(examples.ERROR), "notice": examples.made(examples.NOTICE), "filler": examples.filler()}
        self.kinds = {k: Wording(made[k], [x for other in KINDS if other != k for x in made[other]]) for k in KINDS}

    def score(self, segment: str) -> float:
        words = tokens(segment)
        return self.residue.score(words) if any(map(str.isalpha, words)) else float("-inf")

    def kind(self, template: str) -> str:
        words = tokens(template)
        return max(KINDS, key=lambda k: self.kinds[k].score(words))


_CLASSES: dict[tuple, Classes] = {}


def classes(passages: list[str]) -> Classes:
    """The model for some passages; trained once in a process."""
    key = tuple(sorted(passages))
    if key not in _CLASSES:
        _CLASSES.clear()
        _CLASSES[key] = Classes(list(key))
    return _CLASSES[key]


def passages(spark: SparkSession, base: str) -> list[str]:
    """Sentences of the held-out items: at most PER_LANGUAGE characters of each language."""
    return [s for _, text in labelled(spark, base, PER_LANGUAGE) for s in segments(text)]


def candidates(rows: DataFrame, key: tuple[str, ...], model: Classes, text: str = "text") -> DataFrame:
    """(key..., slot, segment, score): segments that may be residue, masked, and whether the row holds a slot."""
    types = dict(rows.dtypes)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.score
        for b in batches:
            at, slot, segment, odds = [], [], [], []
            for k, t in enumerate(b.column(len(key)).to_pylist()):
                if not t:
                    continue
                found = {}
                for s in segments(t):
                    x = score(s)
                    if x >= CANDIDATE:
                        found[masked(s)] = x
                if has_slot(t):
                    found[None] = 0.0
                for s, x in found.items():
                    at.append(k)
                    slot.append(s is None)
                    segment.append(s)
                    odds.append(x)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[: len(key)]), pa.array(slot, pa.bool_()), pa.array(segment, pa.string()), pa.array(odds, pa.float64())], [*key, "slot", "segment", "score"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), "slot boolean, segment string, score double"])
    return rows.select(*key, text).mapInArrow(run, schema)


def similar(words: list[str], template: list[str | None]) -> float:
    """Share of the places in which a segment has a template's constant word."""
    return sum(a == b for a, b in zip(words, template)) / max(len(words), 1)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of sorted (path, segment, n, score): a row for each member, and one for each cluster at its
    leaf's end."""
    leaf, clusters = None, []

    def ended() -> list[tuple]:
        return [(None, f"{leaf}#{k}", " ".join(w or "<>" for w in c[0]), c[1], c[2] / c[1]) for k, c in enumerate(clusters)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("segment", pa.string()), ("cluster", pa.string()), ("template", pa.string()), ("n", pa.int64()), ("score", pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    for b in batches:
        rows = []
        for at, segment, n, score in zip(*(b.column(i).to_pylist() for i in range(4))):
            if at != leaf:
                rows += ended()
                leaf, clusters = at, []
            words = segment.split(" ")
            best, k = max(((similar(words, c[0]), -k) for k, c in enumerate(clusters)), default=(0.0, 0))
            if best >= SIMILAR:
                c = clusters[-k]
                c[0] = [a if a == w else None for a, w in zip(c[0], words)]
                c[1] += n
                c[2] += n * score
                rows.append((segment, f"{leaf}#{-k}", None, None, None))
            else:
                rows.append((segment, f"{leaf}#{len(clusters)}", None, None, None))
                clusters.append([words, n, n * score])
        yield out(rows)
    yield out(ended())


def mined(found: DataFrame, model: Classes) -> tuple[DataFrame, DataFrame]:
    """(segment, cluster), and (cluster, template, n, score, kind) with kind null for ordinary text, of
    candidates(..., segment, score), a row for each document."""
    held = found.sparkSession.sparkContext.broadcast(model)
    words = F.split("segment", " ")
    counted = found.groupBy("segment").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    leaves = counted.select(F.concat_ws(" ", F.size(words).cast("string"), F.slice(words, 1, DEPTH)).alias("path"), "segment", "n", "score")
    sorted_ = leaves.repartition("path").sortWithinPartitions("path", F.desc("n"), "segment")
    rows = written(sorted_.mapInArrow(_mine, "segment string, cluster string, template string, n long, score double"), "templates")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            kinds = []
            for template, n, score in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                places = template.split(" ")
                constant = [w for w in places if w != "<>"]
                odds = (score + m.score(" ".join(constant))) / 2 if len(constant) < len(places) else score
                spread = min(n.bit_length() - 1, 3) if len(constant) >= 4 and 2 * len(constant) > len(places) else 0
                kinds.append(m.kind(" ".join(constant)) if odds >= BAR - SPREAD * spread else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], ["cluster", "template", "n", "score", "kind"])

    templates = rows.where("segment is null").select("cluster", "template", "n", "score").mapInArrow(judge, "cluster string, template string, n long, score double, kind string")
    return rows.where("segment is not null").select("segment", "cluster"), templates


def residue(rows: DataFrame, *key: str, text: str = "text", passages: list[str] | tuple = ()) -> DataFrame:
    """(key..., kind) of the rows that hold residue, each kind once."""
    model = classes(list(passages))
    found = written(candidates(rows.where(F.col(text).isNotNull()), key, model, text).distinct(), "candidates")
    members, templates = mined(found.where("segment is not null"), model)
    judged = members.join(templates.where("kind is not null").select("cluster", "kind"), "cluster").select("segment", "kind")
    by_template = found.where("segment is not null").join(judged, "segment").select(*key, "kind")
    slots = found.where("slot").select(*key, F.lit("slot").alias("kind"))
    return by_template.union(slots).distinct()


def chunks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "self_ai_fresh_chunks", "doc_id", "chunk_idx", "chunk_text", distinct=False).withColumnRenamed("chunk_text", "text")


def p1_kinds(spark: SparkSession, base: str) -> DataFrame:
    return residue(chunks(spark, base), "doc_id", "chunk_idx", passages=passages(spark, base))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_kinds(spark, base).select("doc_id", "chunk_idx").distinct()


def p1_clean(spark: SparkSession, base: str) -> DataFrame:
    """The chunks that are left, whole rows, each once."""
    cols = ("doc_id", "group_id", "chunk_idx", "chunk_text", "label", "bucket", "gen_model", "prompt_style", "prompt_domain")
    rows, found = table(spark, base, "self_ai_fresh_chunks", *cols), p1_found(spark, base)
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & rows["chunk_idx"].eqNullSafe(found["chunk_idx"])
    return rows.join(found, same, "left_anti")


def p1_templates(spark: SparkSession, base: str) -> DataFrame:
    """The templates judged to be residue (variable places as <>), with the documents that hold them."""
    model = classes(passages(spark, base))
    found = written(candidates(chunks(spark, base).where("text is not null"), ("doc_id", "chunk_idx"), model).distinct(), "candidates")
    _, templates = mined(found.where("segment is not null"), model)
    return templates.where("kind is not null").select("cluster", "template", F.col("n").alias("documents"), "kind")
