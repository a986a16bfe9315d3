"""Sentence boundaries of several languages, scripts and spellings."""

import pytest

from sentria.llm import sentences as module
from sentria.llm.sentences import COUNTS, MAY_END, PLAIN, SHORT, abbreviations, asked, evidence, flags, sentences, split


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Draskin sanded the helmet at 4.20 a.m. across from the stadium.", "We won!"],
        ["The bakery opened at 6 p.m.", "Schools should protect it."],
        ["By 7.45 p.m. Krulasz listened, and No. 23 was still missing.", "I was nervous."],
        ["They moved here from the U.K.", "Damani shook the lamp."],
        ["J. R. Drurva carried the scooter in vol. 13 of the log.", "See Fig. 7 and No. 2 in the guide."],
        ["I waited...", "Last winter, it rained."],
        ["My uncle waited... and then Rolf came.", "what?!", "No!!!"],
        ['Nim wrote, "Wait here. Listen first. Then speak." ', "We copied it."],
        ['"Stop!" the coach shouted, but it fell.', '"Hope cannot replace memory."', "The drum was loud."],
        ["(We quietly left.)", "Mrs. Pell of St. Plomun Street sold approx. 93 whistles."],
        ["I opened version 2.89.1 of tool.draft.txt and slept.", "It cost $10.44, i.e. less than before."],
        ["Der 2. Versuch in Nr. 71 gelang, d. h. der Koch kam.", "Am 3. Mai kam Dr. Zorn, z. B. im Keller.", "„Halt! Bleib stehen!“, rief er."],
        ["La Sra. Pell pagó 3.34 euros a las 7.30 a. m. en casa.", "¡Por fin!", "—¿Vienes? —preguntó el sastre.", "¿Y ahora qué?"],
        ["« Attends ! » cria Paul, et il partit.", "Et alors ?", "M. Leskos partit."],
        ["क्या हुआ?", "“क्या तुम आओगे?” मेरे दोस्त ने पूछा।", "अब चलो।"],
        ["دفع د. Doaxo 61.30 درهم.", "وماذا بعد؟", "«هل ستأتي؟» سأل الممرض."],
    ],
)
def test_spaced(parts):
    parts = [p.strip() for p in parts]
    text = " ".join(parts)
    assert [text[s:e] for s, e in split(text)] == parts


@pytest.mark.parametrize(
    "parts, joint",
    [
        (["我等了很久……", "厨师说：“等一下。先听我说。”", "“你去吗？”爷爷问我。", "真的吗？！", "那只篮子重87.39公斤。"], ""),
        (["「待って。話を聞いて。」と祖父は言った。", "本当？！", "「行くの？」と先生が聞いた。"], ""),
        (["ตอนนั้นมีโคมไฟ 96 ใบอยู่บนดาดฟ้า", "ป้าเช็ดเก้าอี้แก้วที่ท่าเรือ"], " "),
        (["It was it.", "It wasn't fair.", "Why?", "I paced."], ""),
    ],
)
def test_unspaced(parts, joint):
    text = joint.join(parts)
    assert [text[s:e] for s, e in split(text)] == parts


def test_document_decides():
    text = "We saw the zog. near it, the zog. of old, and a zog. by the sea. Then the zog. Rolf came."
    assert abbreviations(evidence(text))["zog"] == SHORT
    assert len(split(text)) == 2
    assert len(split("The zog. Rolf came here.")) == 2
    assert len(split("The zog. Rolf came here.", {"zog": SHORT})) == 1


@pytest.mark.parametrize(
    "parts",
    [
        ["My uncle left the Navy early.", "They joined the U.S. Navy in May.", "It rained."],
        ["We saw that Marlo and Marlo waved.", "They moved here from the U.K. Marlo Park in May."],
        ["They moved here from the U.K.", "Damani shook the lamp.", "We saw that Damani smiled."],
        ["The art of it and the art here are old.", "We studied modern art.", "Then we left."],
        ["My prof said that my prof knew.", "Then Prof. Zorn came."],
        ["The co of it and the co here.", "Go co.", "Then we left."],
    ],
)
def test_names_and_listed_words(parts):
    text = " ".join(parts)
    assert [text[s:e] for s, e in split(text)] == parts


def test_corpus_before_lists():
    assert len(split("We studied modern art. Then we left.")) == 1
    assert len(split("We studied modern art. Then we left.", {"art": PLAIN})) == 2


@pytest.mark.parametrize("marks", ["“”", "«»", "()", '""', "„“", "「」"])
def test_long_quotation(marks):
    """A quotation of any length stays whole; one that is never closed holds nothing together."""
    said = "We went on! " * 200
    a, b = marks
    text = f"Nim said {a}{said.strip()}{b} and left. Then it rained."
    assert [text[s:e] for s, e in split(text)] == [text[:-16], "Then it rained."]
    text = f"Nim said {a}yes. {said}She said {a}Go on! Go!{b} and left."
    assert len(split(text)) == 202


def test_marks_that_open_nothing():
    text = "I was sad :( that day. " + "We went on. " * 100 + "I was glad :) then."
    assert len(split(text)) == 102
    text = "»Halt.« " + "Wir gingen fort. " * 100 + "»Nein.«"
    assert len(split(text)) >= 101


def test_rare_abbreviations(spark):
    """A rare abbreviation counts however many stops the rest has; copies of a text count once."""
    rows = [(f"c{i}", "qux. and " * 20_000) for i in range(6)] + [(f"z{i}", f"{i} saw the zog. near it, the zog. of old, the zog. by us") for i in range(2)]
    rows += [(f"v{i}", "We saw the vab. near it, the vab. of old") for i in range(4)]
    rows += [("a", "The zog. Rolf came here."), ("b", "The vab. Rolf came here.")]
    docs = spark.createDataFrame(rows, "doc_id string, doc_text string")
    got = {r["doc_id"]: r["count"] for r in sentences(docs).groupBy("doc_id").count().collect()}
    assert got["a"] == 1 and got["b"] == 2


def test_asked():
    """split looks up no word that asked doesn't name."""

    class Seen(dict):
        def get(self, w, default=None):
            looked.add(w)
            return default

    for text in ("It was a zog.Then two. Three, (four.) Five “six.” Seven-eight. Nine 10. u.s. And etc. Then it.is. So.", "“Zog.” Then a vab. Rolf."):
        looked = set()
        split(text, Seen(x=SHORT))
        found = evidence(text)
        assert {w for w in looked if w.isalpha()} <= asked(found, text, abbreviations(found))


def test_flags():
    """(before small letters, numbers, names, words that begin sentences; without a stop)"""
    assert flags(3, 0, 0, 0, 1) == SHORT and flags(2, 0, 0, 0, 0) == 0 and flags(5, 0, 0, 0, 9) == 0
    assert flags(0, 0, 40, 0, 0) == SHORT and flags(0, 0, 40, 9, 0) == 0 and flags(0, 0, 40, 0, 9) == 0 and flags(0, 0, 5, 0, 0) == 0
    assert flags(30, 0, 20, 10, 0) == SHORT | MAY_END and flags(0, 9, 1, 1, 200) == COUNTS


LEARNT = [f"{a} came. {b} said yes to me." for a, b in (("Dr. Zorn", "Prof. Pell"), ("Dr. Marlo", "Prof. Kree"), ("Dr. Vash", "Prof. Lund"), ("Dr. Quill", "Prof. Tarn"), ("Dr. Bost", "Prof. Wick"), ("Dr. Hald", "Prof. Senn"))]
LEARNT += [f"Die Gesellsch. für Musik und die Gesellsch. der Freunde {i} sangen." for i in range(3)] + [f"It is in vol. {i} and No. {i} of the log." for i in range(4)]
LEARNT += [f"At {i} p.m. we ate and at {i} p.m. they ate. We left by 7 p.m. We slept." for i in range(4)]


@pytest.mark.parametrize("most_known", [200_000, 0])
def test_corpus_decides(spark, monkeypatch, most_known):
    """Titles, long abbreviations, numbers and times are learnt without any list."""
    monkeypatch.setattr(module, "TITLES", frozenset())
    monkeypatch.setattr(module, "EITHER", frozenset())
    asks = {"a": ["I met Dr. Draskin there.", "Then Prof. Ilk spoke of hope."], "b": ["Wir lasen, was die Gesellsch. Berlin schrieb.", "Es war gut."], "c": ["See vol. 9 and No. 8 there.", "It was late at 9 p.m. Then we slept."]}
    asks["c"] = ["See vol. 9 and No. 8 there.", "We all came late at 9 p.m.", "Then then it was over."]
    rows = [(f"l{i}", x) for i, x in enumerate(LEARNT)] + [(k, " ".join(v)) for k, v in asks.items()]
    got = sentences(spark.createDataFrame(rows, "doc_id string, doc_text string"), most_known=most_known).where("doc_id in ('a', 'b', 'c')").collect()
    by = {k: sorted((r["char_start"], r["char_end"]) for r in got if r["doc_id"] == k) for k in asks}
    for k, v in asks.items():
        text = " ".join(v)
        assert [text[s:e] for s, e in by[k]] == v


def test_long_abbreviation_in_a_document():
    text = "Die Gesellsch. für Musik und die Gesellsch. der Freunde sangen. Die Gesellsch. Berlin kam."
    assert [text[s:e] for s, e in split(text)] == ["Die Gesellsch. für Musik und die Gesellsch. der Freunde sangen.", "Die Gesellsch. Berlin kam."]


def test_long_sentence():
    """What a stop means doesn't depend on how far back its sentence began."""
    long = "and then " * 200
    assert len(split(f"We went on {long} until 6 p.m. The bakery opened.")) == 2
    assert len(split(f"{'x' * 500} No. 7 came.")) == 1


def test_empty_and_long():
    assert split("") == [] and split("  \n ") == []
    assert split("x " * 50_000)[0] == (0, 99_999)
    assert len(split("Go on. " * 20_000)) == 20_000
    assert split("1." * 20_000) == [(0, 40_000)]
