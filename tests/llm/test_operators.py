"""The operators against brute force and hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentria.llm import leaks, overlap, pairs, repetition, residue, splits, truncation
from sentria.llm.common import within
from sentria.llm.queries import QUERIES
from tests.llm import tables as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = [x for x in a if rng.random() > 0.15] + [rng.choice("abc") for _ in range(rng.randint(0, 3))]
        most = rng.randint(0, 4)
        assert within(a, b, most) == (distance(a, b) <= most)


SLOTS = ["My name is {{name}} and I grew up.", "At ${city} I learned.", "I met {teacher} there.", "In {% book %} we read.", "At <%= student.name %> I stood.", "About [[college]] now.", "I saw [XX event XX] once.", "@@TEAM@@ won.", "#SCHOOL_NAME# is big.", "At __BOOK__ I read.", "%(hobby)s is fun.", "I want to study at %s because I can.", "In _____ (street) we walked.", "At <INSERT DATE HERE> we left.", "My name is (insert mentor) now.", "The person was [Your City], near us.", "Read [BOOK] first.", "Since joining TODO: city I run.", "At [aquí el nombre: teacher] I sat.", "The person who taught me pride was undefined, near the ferry."]
MESSAGES = ["Please enable JavaScript to view this page.", "404 Not Found. The page a/1 does not exist.", "<h1>Internal Server Error</h1><p>Trace 1a was saved.</p>", "Loading...", "Veuillez activer JavaScript pour afficher ce contenu.", "Seite nicht gefunden. Der Link ist veraltet.", "Lorem ipsum dolor sit amet.", "Your text goes here.", 'An essay. {"error": {"code": 3, "message": "model overloaded"}}', "We won!\n\nTexto de relleno. Sustituir."]
FINE = ['The page only said: "Oops! Something went wrong on our end. Please reload." We laughed.', "On the wall we read “Access denied. 404 Not Found. Loading...” and left.", "The sets {2, 3, 5} and [1, 68] were on the board.", 'He said "it were [sic] gentle" and <3 was all.', "I would give 100% for Rolf [my cousin].", "Rolf typed a mark such as {{ name }} into the letter.", "The screen said that the page was not found, so I left.", "My server once returned a 502 error in front of us.", "Room 404 was the wild stadium.", "Our draft still said lorem ipsum on page 65, and we laughed.", "I taught my aunt why the browser asks to enable JavaScript.", "(see Appendix B. for more)", ""]


def test_residue(spark):
    texts = SLOTS + MESSAGES + FINE
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(99, None)], "id int, text string")
    found = {r["id"] for r in residue.residue(rows, "id").collect()}
    assert found == set(range(len(SLOTS) + len(MESSAGES))), [texts[i] for i in found ^ set(range(len(SLOTS) + len(MESSAGES)))]


def test_templates_in_a_leaf(spark):
    """Messages that share a leaf but not their template don't share a verdict; members of one do."""
    texts = ["The server took too long to respond.", "The server took too few orders tonight."]
    for many in ([0], [0, 1], [0] + [1] * 9, [0] * 9 + [1]):
        rows = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(many)], "id int, text string")
        found = {r["id"] for r in residue.residue(rows, "id").collect()}
        assert {i for i, k in enumerate(many) if k == 0} <= found


def test_template_decides(spark):
    """A member that alone would pass as ordinary is residue by its template, once other documents show it."""
    model = residue.classes([])
    rng = random.Random(11)
    words = ["old", "friendship", "lamp", "kettle", "harbour", "painted", "laughed", "stadium", "waited", "aunt", "courage"]
    message = "The server could not find {} {} {} in time"
    odd = next(x for _ in range(2000) if residue.CANDIDATE <= model.score(x := message.format(*rng.choices(words, k=3))) < residue.BAR - 0.02)
    alike = [message.format(*(f"{c}{i}" for c in "abc")) for i in range(6)]
    alone = spark.createDataFrame([(99, odd)], "id int, text string")
    assert residue.residue(alone, "id").count() == 0
    rows = alone.union(spark.createDataFrame(list(enumerate(alike)), "id int, text string"))
    assert {r["id"] for r in residue.residue(rows, "id").collect()} == {*range(6), 99}
    _, templates = residue.mined(residue.candidates(rows, ("id",), model), model)
    got = templates.collect()
    assert [(r["template"], r["n"]) for r in got] == [("the server could not find <> <> <> in time", 7)]


MESSAGE = "Answer the question below.\n\nQuestion: Should every school own a paper mirror? Take a position and defend it."


@pytest.fixture(scope="module")
def judge():
    return pairs.Judge([("en", "The school should have a mirror and the people were there when we left the house in the morning. " * 5), ("es", "La escuela tiene un espejo y la gente estaba allí cuando salimos de la casa por la mañana. " * 5), ("de", "Die Schule hat einen Spiegel und die Leute waren da, als wir am Morgen aus dem Haus gingen. " * 5)])


@pytest.mark.parametrize(
    "answer, what",
    [
        (None, "empty"), ("", "empty"), ("...", "empty"), ("​", "empty"),
        ("I'm sorry, but I cannot write this essay for you.", "refusal"), ("Als Sprachmodell darf ich diesen Aufsatz nicht schreiben.", "refusal"), ("Lo siento, pero no puedo ayudar con esta redacción.", "refusal"),
        (MESSAGE, "copy"), ("SHOULD EVERY SCHOOL OWN A PAPER MIRROR ? TAKE A POSITION AND DEFEND IT", "copy"), ("Should every school own some paper mirror? Take a position and defend it.", "copy"),
        ("La escuela tiene un espejo y la gente estaba en la casa. Cuando salimos por la mañana, la gente estaba allí.", "language"), ("我觉得纪律开始于努力。队长在码头边拆开了地图。", "language"),
        ("Every school should have a mirror. The people were there when we left the house.", None),
        ("The people were there when we left the house in the morning. La casa.", None),
        ("I'm sorry, but I cannot write this essay. " + "The people were there when we left the house. " * 15, "refusal"),
        ("Die Leute waren da. La gente estaba en la casa. Wir gingen aus dem Haus.", "language"),
        ("Школа должна иметь зеркало, и люди были там.", "language"),
    ],
)
def test_defects(judge, answer, what):
    assert pairs.defect(answer, MESSAGE, judge) == what


def test_posteriors(judge):
    """Posteriors of both sides are compared: halves of two languages agree by a half with either."""
    of = judge.languages
    half = "The people were there when we left the house. Die Leute waren da, als wir gingen."
    assert 0.4 < of.agreement("The school should have a mirror", half) < 0.7
    assert of.agreement("", half) == of.agreement("the school", "12 ...") == 1.0
    assert sum(of.posteriors("casa house Haus")[0].values()) == pytest.approx(1.0)
    assert of.agreement("学校应该有镜子", "学校应该有镜子") == 1.0 and of.agreement("学校应该有镜子", "がっこうにはかがみがある") == 0.0


def test_late_language(spark, tmp_path):
    """A language that begins after thousands of items of another is known too."""
    items = [(i, "b", "en", f"the lamp near the harbour {i}") for i in range(6_000)] + [(7_000 + i, "b", "de", "die Lampe neben dem Hafen und der Garten") for i in range(3)]
    model = pairs.fitted(spark, t.write(spark, str(tmp_path), {"eval_items": items})).languages
    assert model.names == ["de", "en"] and model.of("neben dem Garten") == "de"


def test_endings():
    for x in ("Done.", "Done!”", "with love ♥", "I kept the key :)", "终于。", "and so I did…"):
        assert truncation.state(x) == "ended", x
    for x in ("We met Dr.", "and the", "so,", "I read it in vol.", "the harb"):
        assert truncation.state(x) == "open", x
    for x in ("We met Dr.", "I read it in vol.", "the caf\ufffd", "so,", "He left (and"):
        assert truncation.tail(x)[2] == (x != "He left (and"), x
    assert truncation.state("It weighed 3.") == "number" and truncation.state("on pp. 3-94") == "open"
    assert truncation.state(" \n") == "blank" and truncation.state("***") == "blank"


def test_cut(spark):
    rng = random.Random(4)
    nouns, verbs = ["lamp", "harbour", "kettle", "violin", "mirror"], ["carried", "cleaned", "painted"]
    sentence = lambda: f"The {rng.choice(nouns)} was old, so my aunt {rng.choice(verbs)} the {rng.choice(nouns)} near the {rng.choice(nouns)}."
    full = [" ".join(sentence() for _ in range(rng.randint(3, 9))) for _ in range(300)]
    cut_, whole = [], []
    for i, x in enumerate(full):
        if i % 10 == 0:
            cut_.append(x[: 150 if len(x) > 151 and not x[149] in ". " else 100])
        elif i % 10 == 1:
            whole.append(x + " Thank you for reading")
        else:
            whole.append(x)
    rows = spark.createDataFrame([(i, "b", "m", x) for i, x in enumerate(cut_ + whole)], "id int, bucket string, gen_model string, text string")
    got = {r["id"] for r in truncation.cut(rows, ("id",), ("bucket", "gen_model")).where("cut").collect()}
    want = {i for i, x in enumerate(cut_) if not x.endswith(".")}
    assert got == want
    limits = truncation.hidden_limits(truncation.measured(rows, "id", "bucket", "gen_model"), "bucket", "gen_model")
    assert 150 in {r["length"] for r in limits.collect()}


def test_cut_in_a_number(spark):
    """A stop after a number is a decimal point where numbers don't end sentences; broken characters are cut."""
    rng = random.Random(12)
    text = lambda: f"The {rng.choice(['lamp', 'kettle', 'box'])} weighed {rng.randint(1, 9)}.{rng.randint(10, 99)} kilos. We left by bus {rng.randint(1, 9)}."
    rows = [(i, text()) for i in range(60)] + [(100, "My box weighed 3."), (101, "We took bus 7."), (102, "They liked the caf\ufffd"), (103, "I read it in vol.")] + [(104 + i, "I read it in vol.") for i in range(3)]
    df = spark.createDataFrame([(i, "b", "m", x) for i, x in rows], "id int, bucket string, gen_model string, text string")
    got = {r["id"] for r in truncation.cut(df, ("id",), ("bucket", "gen_model")).where("cut").collect()}
    assert got == {100, 102, 103, 104, 105, 106}


def test_cut_copies(spark):
    """Copies under other ids: a cut text stays cut, within a word or at a limit; closing lines stay finished."""
    rng = random.Random(6)
    nouns = ["lamp", "harbour", "kettle", "violin", "mirror"]
    sentence = lambda: f"The {rng.choice(nouns)} was old, so my aunt carried the {rng.choice(nouns)} near the {rng.choice(nouns)}."
    full = [" ".join(sentence() for _ in range(6)) for _ in range(200)]
    cut_ = [full[0] + " My aunt carried the harb"] * 70
    for x in full[10:30]:  # all cut at 180, one of them with 40 copies within a word, one with 40 after a word
        at = x.rindex(" ", 0, 170)
        cut_.append((x[:at] + " because " + "x" * 40)[:180])
    cut_ += [cut_[-1]] * 40 + [(full[5] + " and then all of us saw that old lamp near the")[-180:]] * 40
    whole = full + [x + " Thank you for reading" for x in full[20:40]]
    rows = spark.createDataFrame([(i, "b", "m", x) for i, x in enumerate(cut_ + whole)], "id int, bucket string, gen_model string, text string")
    got = {r["id"] for r in truncation.cut(rows, ("id",), ("bucket", "gen_model")).where("cut").collect()}
    assert got == set(range(len(cut_)))


def test_limits_are_counted_exactly(spark):
    texts = [(n * 1_000 + i, f"{'x' * (n - 5)}{f'{i:05d}'.translate(str.maketrans('0123456789', 'abcdefghij'))}") for n, many in ((400, 997), (700, 2_003), (900, 1_501)) for i in range(many)]
    rows = spark.createDataFrame(texts, "id int, text string").selectExpr("id", "'b' as bucket", "text")
    found = truncation.hidden_limits(truncation.measured(rows, "id", "bucket"), "bucket").where("encoding = 'code_points'")
    assert {r["length"]: r["n"] for r in found.collect()} == {400: 997, 700: 2_003, 900: 1_501}


def share(words, n=6):
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    return sum(hit) / len(words) if words else 0.0


@pytest.mark.parametrize("most_parts", [20_000, 1])
def test_repetition(spark, most_parts):
    rng = random.Random(5)
    docs = {i: [" ".join(rng.choice("abcd") + rng.choice("xyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(2, 9))] for i in range(60)}
    docs |= {100 + i: ["The same words are said again and again, 12 times!"] * (i + 2) for i in range(3)}
    rows = spark.createDataFrame([(d, k, x.upper() if k % 2 else x) for d, v in docs.items() for k, x in enumerate(v)] * 2, "doc int, ord int, text string")
    got = {r["doc"]: r for r in repetition.ledger(rows, "doc", most_parts=most_parts).collect()}
    for d, v in docs.items():
        words = "".join(c if c.isalpha() else " " for c in " ".join(v).lower()).split()
        assert got[d]["n_words"] == len(words)
        assert got[d]["repeated_run_share"] == pytest.approx(share(words))
        assert bool(got[d]["bits"] & 1) == (share(words) >= 1 / 3)


@pytest.mark.parametrize("most_parts", [20_000, 1])
def test_repetition_ties(spark, most_parts):
    """Tied and null orders go by the text, numerals are no letters, and copies of one part are one part."""
    rng = random.Random(7)
    docs = {i: [(rng.choice([None, 0, 1]), " ".join(rng.choice(["ab", "cd", "Ⅷ", "½", "x²y", "3"]) for _ in range(rng.randint(1, 9)))) for _ in range(8)] for i in range(40)}
    docs[99] = [(0, "3 ½"), (0, "4!")]
    docs[100] = [(0, "one line here\none line here\nand another")] * 3
    rows = spark.createDataFrame([(d, k, x) for d, v in docs.items() for k, x in v], "doc int, ord int, text string")
    got = {r["doc"]: r for r in repetition.ledger(rows, "doc", most_parts=most_parts).collect()}
    for d, v in docs.items():
        parts = [x for _, x in sorted(set(v), key=lambda p: (p[0] is not None, p[0] or 0, p[1].encode()))]
        words = "".join(c if c in "abcdxyefghijklmnopqrstuvwz" else " " for c in " ".join(parts)).split()
        assert got[d]["n_words"] == len(words)
        assert got[d]["repeated_run_share"] == pytest.approx(share(words))
    assert got[100]["repeated_part_share"] == pytest.approx(3 / 8)


def test_ablation(spark):
    book = spark.createDataFrame([(1, 0b0001), (2, 0b0011), (3, 0b0000), (4, 0b1000)], "doc int, bits long")
    rows = {r["rule"]: r for r in repetition.ablation(book).collect()}
    run = rows["repeated_run_share"]
    assert (run["failed"], run["failed_alone"], run["rejected_without"], run["documents"]) == (2, 1, 2, 4)


def messed(rng, words, n):
    out = list(words)
    for _ in range(n):
        k, i = rng.randint(0, 2), rng.randrange(len(out))
        if k == 0:
            out.insert(i, rng.choice(words) + "q")
        elif k == 1:
            out.pop(i)
        else:
            out[i] = "changed"
    return out


def test_overlap(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randint(11, 45))] for _ in range(60)]
    units = []
    for i, w in enumerate(originals):
        units.append((f"t{i}", " ".join(w), "train"))
        units.append((f"e{i}", " ".join(messed(rng, w, rng.randint(0, 5))).upper() + "!", rng.choice(["test", "Validation "])))
        if i % 7 == 0:
            units.append((f"t{i}c", " ".join(w) + " .", " TRAIN"))
    rows = [("d", None, k, 0, 1, x, 1, "b", "m", "p", "d", s, u) for k, (u, x, s) in enumerate(units)]
    base = t.write(spark, str(tmp_path), {"sentence_dataset": rows * 2, "sentence_features": [("t1", "d", 1, "b", "test", "m", None)] * 2})
    split = {u: s.strip().lower() for u, _, s in units} | {"t1": "test"}
    words = {u: "".join(c if c.isalnum() else " " for c in x.lower()).split() for u, x, _ in units}
    long = [u for u, x, _ in units if len(x.split()) >= 12]
    want = {tuple(sorted((a, b))) for a in long for b in long if split[a] == "train" != split[b] and distance(words[a], words[b]) <= max(len(words[a]), len(words[b])) // 10}
    got = [tuple(r) for r in QUERIES["p6_found"](spark, base).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 15


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(300)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))] for i in range(20)}
    docs, want = {}, set()
    for d in range(150):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            i = rng.randrange(20)
            w = items[i]
            n = rng.choice([18, 24, 25, 30, 40, 60])
            a = rng.randint(0, max(0, len(w) - n))
            part = w[a : a + n]
            changes = rng.choice([0, len(part) // 10, len(part) // 10, 12])
            for k in rng.sample(range(len(part)), min(changes, len(part))):
                part = part[:k] + ["altered"] + part[k + 1 :]
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs[d] = body

    def holds(w, body):
        for n in (25, 30, 40):
            for a in range(len(w) - n + 1):
                p, most = w[a : a + n], n // 10
                row = [0] * (len(body) + 1)
                for i, x in enumerate(p, 1):
                    new = [i]
                    for j, y in enumerate(body, 1):
                        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                    row = new
                    if min(row) > most:
                        break
                else:
                    return True
        return False

    for d, body in docs.items():
        for i, w in items.items():
            if len(set(w) & set(body)) > 15 and len(w) >= 25 and holds(w, body):
                want.add((d, i))
    dress = lambda d, b: f"<p>{' '.join(b).upper()}</p>" if d % 2 else ",\n".join(b)
    left = spark.createDataFrame([(d, dress(d, b)) for d, b in docs.items()] + [(999, None)], "doc_id long, text string")
    right = spark.createDataFrame([(i, "Title. " + " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {tuple(r) for r in leaks.find_passages(left, right).collect()}
    assert got == want and len(want) > 10


def test_components(spark):
    rng = random.Random(8)
    rows = [(f"d{rng.randint(0, 60)}", f" G{rng.randint(0, 50)}" if rng.random() < 0.9 else None) for _ in range(90)] + [(f"c{i}", f"chain{i + j}") for i in range(40) for j in (0, 1)] + [("x", "HOT")] * 5 + [(f"h{i}", "hot") for i in range(200)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for d, g in rows:
        find(("d", d))
        if g is not None:
            parent[find(("d", d))] = find(("g", g.strip().lower()))
    docs, groups = splits.related(spark.createDataFrame(rows, "doc_id string, group_id string"))
    by = {("d", r[0]): r[1] for r in docs.collect()} | {("g", r[0]): r[1] for r in groups.collect()}
    assert set(by) == set(parent)
    assert len({(by[a], find(a)) for a in parent}) == len(set(by.values())) == len({find(a) for a in parent})


def test_components_of_long_chains(spark):
    for n in (3, 700):
        edges = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(n)], "a string, b string")
        got = splits.components(edges).collect()
        assert len(got) == n + 1 and {r["component"] for r in got} == {"00000"}


def test_assign(spark):
    rng = random.Random(9)
    rows = [(f"c{i}", n := rng.choice([1, 2, 3, 5, 8, 40]), rng.randint(0, n)) for i in range(3000)] + [("huge", 5000, 2000), ("big", 900, 900), ("other", 800, 0)]
    targets = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    parts = spark.createDataFrame(rows, "component string, n long, ones long")
    got = {r[0]: r[1] for r in splits.assign(parts, targets).collect()}
    assert set(got) == {r[0] for r in rows}
    total, ones = sum(n for _, n, _ in rows), sum(o for _, _, o in rows)
    for name, s in targets:
        assert abs(sum(n for c, n, _ in rows if got[c] == name) / total - s) < 0.01
        assert abs(sum(o for c, _, o in rows if got[c] == name) / ones - s) < 0.015


@pytest.mark.parametrize("n", [4, 30, 800])
def test_search_beats_hashed_places(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(1, 60, n).astype(float)
    ones = np.floor(sizes * rng.random(n))
    shares = np.array([0.8, 0.1, 0.1])
    start = splits.hashed(np.array([f"c{i}" for i in range(n)]), shares)
    count = lambda p, w: np.bincount(p, weights=w, minlength=3)
    want, want_ones = shares * sizes.sum(), shares * ones.sum()
    before = splits.deviation(count(start, sizes), count(start, ones), want, want_ones)
    place, after = splits.anneal(sizes, ones, want, want_ones, start, 0)
    assert after == pytest.approx(splits.deviation(count(place, sizes), count(place, ones), want, want_ones))
    assert after <= before and (n < 30 or after < 0.2 * before) and (n < 800 or after < 0.005)


def test_p7_found(spark, tmp_path):
    rows = [t.unit("a", 0, "x", "G1", "train"), t.unit("a", 1, "x", "g2", "train"), t.unit("b", 0, "x", " g2 ", "TEST "), t.unit("c", 0, "x", "g3", "train"), t.unit("c", 1, "x", None, None), t.unit("e", 0, "x", "g4", "test"), t.unit("e", 1, "x", None, "train")]
    base = t.write(spark, str(tmp_path), {"sentence_dataset": rows})
    assert sorted(r[0] for r in QUERIES["p7_found"](spark, base).collect()) == ["g1", "g2", "g4"]
