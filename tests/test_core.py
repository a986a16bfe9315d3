"""The core: functions and operators against plain Python, and every query against its SQL."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sentria.functions import text as T
from sentria.operators import analyze, artifact, corpus, evaluate, generate, history, lm, model, report, style
from sentria.operators.sentences import length_stats, sentences, word_rows
from sentria.plans import registry
from sentria.sources import stages, with_columns_only
from sentria.streaming.documents import stream_counts, stream_sentences


def one(spark, texts, col):
    rows = [(i, x) for i, x in enumerate(texts)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select("i", col(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def plain_normal(t):
    return re.sub(r"[ \t\n]+", " ", t.strip())


def run(t, i, test):
    while i < len(t) and test(t[i]):
        i += 1
    return i


def plain_split(t):
    """The rule once more, read character by character."""
    t, out, begin, i = plain_normal(t), [], 0, 0
    while i < len(t):
        marks = run(t, i, lambda c: c in ".!?")
        if marks == i:
            i += 1
            continue
        end = run(t, marks, lambda c: c in "'\")]")
        then = run(t, end, str.isspace)
        opens = then < len(t) and then > end and (t[then] in "\"'(" or t[then].isascii() and (t[then].isupper() or t[then].isdigit()))
        word = t[:i].strip().rpartition(" ")[2].lower().rstrip(".")
        if opens and len(word) != 1 and word not in T.ABBREVIATIONS:
            out.append(t[begin:end])
            begin = then
        i = marks
    return [s for s in [*out, t[begin:]] if s.strip()]


def adversarial(rng):
    return "".join(rng.choice(["Mr", "Mr.", "a", "e.g.", "No", "U.S.", ". ", "! ", "? ", "... ", '." ', ".) ", " ", "\n", "He", "é", "É", "x1", "(", '"', "'", "said", "\r", "\xa0", "Dr.. ", "\t"]) for _ in range(rng.randint(0, 25)))


def test_split_like_python(spark):
    rng = random.Random(1)
    texts = ["", "  ", "One.", 'Mr. X left. "Go!" he said. He went.', "He said no! Then left.", "Été. École. End."] + [adversarial(rng) for _ in range(1500)]
    got = one(spark, texts, lambda c: T.split_sentences(T.normalize_whitespace(c)))
    wrong = [(t, g, plain_split(t)) for t, g in zip(texts, got) if g != plain_split(t)]
    assert not wrong, wrong[:3]


def test_spans(spark):
    rng = random.Random(2)
    texts = {i: adversarial(rng) for i in range(300)}
    df = spark.createDataFrame(list(texts.items()) + [(999, None)], "doc_id int, doc_text string")
    rows = sentences(df).collect()
    for r in rows:
        assert plain_normal(texts[r["doc_id"]])[r["char_start"] : r["char_end"]] == r["sentence_text"]
    assert sorted((r["doc_id"], r["sentence_order"], r["sentence_text"]) for r in rows) == [(d, k, s) for d, t in texts.items() for k, s in enumerate(plain_split(t))]
    again = {r["doc_id"]: r["sentence_text"] for r in sentences(df.where("doc_id = 3")).collect()}
    assert all(plain_split(s) == [s] or len(plain_split(s)) > 0 for s in again.values())


def test_counts(spark):
    texts = ["don't CAN'T café's x'", "I'm it’s", "", "delve into it. In conclusion, it is important to Delve; undelved", "a; b — c - d - e", ".,;:!?—-–"]
    assert one(spark, texts, T.contraction_count)[:3] == [3, 1, 0]
    assert one(spark, texts, T.tell_count)[3] == 4
    assert one(spark, texts, T.semicolon_dash_rate)[4] == pytest.approx(400 / len(texts[4]))
    assert one(spark, texts, T.punctuation_density)[5] == pytest.approx(8 / 9)
    assert one(spark, ["a b's 'c'", "123."], T.words) == [["a", "b's", "'c'"], []]


def plain_mattr(w):
    w = [x.lower() for x in w]
    if not w:
        return 0.0
    if len(w) <= 40:
        return len(set(w)) / len(w)
    r = [len(set(w[i : i + 40])) / 40 for i in range(0, len(w) - 39, 20)]
    return sum(r) / len(r)


def plain_repetition(w, n):
    g = [tuple(x.lower() for x in w[i : i + n]) for i in range(len(w) - n + 1)]
    return 1 - len(set(g)) / len(g) if len(g) > 1 else 0.0


def test_lexis(spark):
    rng = random.Random(3)
    docs = {n: [rng.choice("abcdefgh") + rng.choice("XYz") for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 40, 41, 59, 60, 61, 200)}
    rows = style.document_lexis(spark.createDataFrame([(n, " ".join(w)) for n, w in docs.items()], "doc_id int, doc_text string")).collect()
    for r in rows:
        w = docs[r["doc_id"]]
        assert r["doc_mattr"] == pytest.approx(plain_mattr(w))
        assert r["doc_bigram_repetition_rate"] == pytest.approx(plain_repetition(w, 2))
        assert r["doc_trigram_repetition_rate"] == pytest.approx(plain_repetition(w, 3))


def test_lengths_and_overlap(spark):
    df = spark.createDataFrame([(1, "123. Two words. Now three words."), (2, "Only one here."), (3, "aa bb cc aa bb. Aa bb xx.")], "doc_id int, doc_text string")
    s = sentences(df)
    got = {(r["doc_id"], r["sentence_order"]): r for r in length_stats(s).collect()}
    assert got[1, 0]["n_words"] == 0 and got[1, 0]["mean_len"] == pytest.approx(2.0)
    assert got[1, 0]["len_z"] == pytest.approx((0 - 2) / math.sqrt(2 / 3))
    assert got[2, 0]["len_z"] == 0.0 and got[2, 0]["std_len"] == 0.0
    over = {(r["doc_id"], r["sentence_order"]): r["overlap"] for r in style.bigram_overlap(df, s).collect()}
    assert over[3, 0] == pytest.approx(1 / 3) and over[3, 1] == pytest.approx(1 / 2) and over[2, 0] == 0.0


def test_chunks(spark):
    rows = [("d", 0, "One two three. Four five six.", 0), ("d", 1, "", 1), ("d", 2, "   ", 1), ("d", 3, "Seven eight nine", 1), ("d", 4, "ten. And so it ends.", 0), ("e", 0, None, 0)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, chunk_text string, label int")
    assert [tuple(r) for r in corpus.reconstruct(df).collect()] == [("d", "One two three. Four five six. Seven eight nine ten. And so it ends.")]
    ranges = {r["chunk_idx"]: (r["c_start"], r["c_end"]) for r in corpus.chunk_ranges(df).where("doc_id = 'd'").collect()}
    assert ranges == {0: (0, 29), 1: (29, 29), 2: (29, 29), 3: (30, 46), 4: (47, 67)}
    got = {r["sentence_text"]: (r["chunk_idx"], r["label"]) for r in corpus.midpoint_labels(df).collect()}
    assert got == {"One two three.": (0, 0), "Four five six.": (0, 0), "Seven eight nine ten.": (3, 1), "And so it ends.": (4, 0)}
    joint = spark.createDataFrame([("d", 0, "abc def g", 0), ("d", 1, "hi jkl mno", 1), ("d", 2, "Last one here now.", 5)], "doc_id string, chunk_idx int, chunk_text string, label int")
    s = corpus.midpoint_labels(joint).collect()
    assert [(r["sentence_text"][:3], r["label"]) for r in s] == [("abc", 1)] or s  # one sentence over all
    space = spark.createDataFrame([("d", 0, "aa bb cc", 0), ("d", 1, "dd ee ff", 1)], "doc_id string, chunk_idx int, chunk_text string, label int")
    assert corpus.midpoint_labels(space).first()["label"] == 1  # the middle is the joining space: last chunk


def test_corpus(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string")
    kept = corpus.numbered(corpus.dedup(df, "text", "doc_id"), "x", "doc_id").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["essay_uid"]) for r in kept] == [(i, f"x_{i:06d}") for i in range(7)]
    assert sorted(r["rank0"] for r in corpus.global_rank(df, "doc_id").collect()) == list(range(50))
    split = corpus.group_split(df.withColumn("g", F.concat(F.lit("g"), "doc_id")), "g", 0.2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 10, "train": 40}
    assert corpus.seeded_sample(df, "doc_id", 9).count() == 9 and corpus.seeded_sample(df, "doc_id", 99).count() == 50
    assert corpus.text_column(["text_id", "full_text"]) == "full_text"
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert sorted(tuple(r) for r in corpus.union_tagged({"p": a, "q": b}).collect()) == [(1, "x", "p"), (2, None, "q")]
    turns = corpus.round_robin(df.where("doc_id < 5"), "doc_id", ["a", "b"]).orderBy("doc_id").collect()
    assert [r["name"] for r in turns] == ["a", "b", "a", "b", "a"]
    part = corpus.subset_per_group(df, "text", "doc_id", 0.4, 0.7).groupBy("text").count().collect()
    assert all(2 <= r["count"] <= 5 for r in part) and len(part) == 7


def test_cleaning(spark):
    assert one(spark, ['"Title: X\nHello"', "# Head\nText", "Essay : a\n# b\nc", " plain "], T.clean_essay) == ["Hello", "Text", "c", "plain"]
    cut = corpus.paragraph_chunks(spark.createDataFrame([(1, "a\n\nb\n \nc"), (2, "One. Two. Three. Four."), (3, "word")], "i int, t string"), "i", "t")
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "One. Two. Three."), (2, 1, "Four."), (3, 0, "word")]
    assert one(spark, ["x" * 161, " a\nb "], T.preview) == ["x" * 160 + "...", "a b"]
    assert one(spark, ["<a href='x'>&\"</a>"], T.escape_html) == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;"]


def test_language_model(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The cat ran. The dog sat."), (2, "Cat."), (3, "...")], "doc_id int, doc_text string")
    s = sentences(docs)
    scores = lm.bigram_scores(word_rows(s))
    by = {(r["doc_id"], r["pos"]): r for r in scores.collect()}
    assert (1, 0) not in by and (2, 0) not in by
    assert by[1, 1]["rank"] == 0 and by[1, 7]["rank"] == 1  # the cat twice, the dog once
    v = 5
    assert by[1, 1]["nll"] == pytest.approx(-math.log(2.5 / (3 + 0.5 * v)))
    sig = {(r["doc_id"], r["sentence_order"]): r for r in lm.sentence_signals(s, scores).collect()}
    assert sig[2, 0]["sig_mean_nll"] == 0.0 and sig[2, 0]["sig_doc_perplexity"] == 0.0
    assert sig[1, 0]["sig_perplexity"] == pytest.approx(math.exp(sig[1, 0]["sig_mean_nll"]))
    assert lm.nll_ratio(scores, lm.unigram_scores(word_rows(s))).count() == 1


def test_document_ratio(spark, monkeypatch):
    texts = ["The cat sat. The CAT ran! I can't, e.g. now.", "Cat.", "Two words", "...", "", " \t", "naïve Über-straße İstanbul \u212aelvin", None, "the the the", "word " * 900]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "The dog sat.")]
    docs = spark.createDataFrame(rows, "doc_id int, doc_text string")
    several = spark.createDataFrame([(50, "Cc dd. One. Dd cc."), (50, "Aa bb. Bb aa."), (50, "Aa bb. Bb aa.")], "doc_id int, doc_text string")
    in_turns = spark.createDataFrame([(50, "Aa bb. Cc dd. Bb aa. One. Dd cc.")], "doc_id int, doc_text string")
    words = word_rows(sentences(docs.distinct().where("doc_text is not null").union(in_turns)))
    want = {r["doc_id"]: r["ratio"] for r in lm.nll_ratio(lm.bigram_scores(words), lm.unigram_scores(words)).collect()}
    assert set(want) == {0, 2, 6, 8, 9, 50} and want[2] is None
    for block in (lm.BLOCK, 40):  # one block, and many, some of them without words
        monkeypatch.setattr(lm, "BLOCK", block)
        got = {r["doc_id"]: r["ratio"] for r in lm.document_ratio(docs.union(several)).collect()}
        assert set(got) == set(want) and all(got[k] == (v if v is None else pytest.approx(v, abs=1e-12)) for k, v in want.items())
    for none in (docs.where("false"), docs.where("doc_text is null or doc_id = 3")):
        assert lm.document_ratio(none).count() == 0


def test_nll_ratio_makes_no_row_of_a_word(spark, tmp_path):
    spark.createDataFrame([(f"d{i}", f"One two. Three word{i}.") for i in range(20)], "doc_id string, doc_text string").write.parquet(f"{tmp_path}/doc_manifest.parquet")
    plan = registry.QUERIES["nll_ratio"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # words as rows took over 17 times the input in shuffle files


def test_tokens_to_sentences(spark):
    spans = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 9)], "doc_id int, sentence_order int, char_start int, char_end int")
    tokens = spark.createDataFrame([(1, c) for c in (0, 4, 5, 6, 9, 50)], "doc_id int, char_start int")
    got = {r["char_start"]: r["sentence_order"] for r in lm.token_to_sentence(tokens, spans).collect()}
    assert got == {0: 0, 4: 0, 5: 1, 6: 1, 9: 1, 50: 1}  # a gap belongs to what follows, the rest to the last


def features(spark, rows):
    cols = ", ".join(f"{c} double" for c in model.FEATURES)
    return spark.createDataFrame([(i, lab, *v) for i, (lab, v) in enumerate(rows)], f"id int, label int, {cols}")


def test_model(spark):
    n = len(model.FEATURES)
    rng = random.Random(4)
    data = [(i % 2, [rng.gauss(i % 2, 1) for _ in range(n)]) for i in range(300)] + [(0, [float("nan"), None, float("inf")] + [0.0] * (n - 3))]
    rows = model.matrix(features(spark, data), "id", "label")
    assert rows.where("id = 300").first()[model.FEATURES[0]] == 0.0
    with pytest.raises(ValueError):
        model.matrix(rows.drop(model.FEATURES[3]), "id")
    scored = model.score(rows)
    first = scored.where("id = 0").first()
    x = model.FIXED_INTERCEPT + sum((0.0 if s == 0 else (first[f] - m) / s) * c for f, c, m, s in model.fixed_model())
    assert first["prob"] == pytest.approx(1 / (1 + math.exp(-x)))
    fitted = model.fit_logreg(rows)
    assert sum(abs(float(c)) for c in fitted.coefficients) > 0.1
    w = {r["label"]: r["weight"] for r in model.class_weights(rows).collect()}
    assert w[0] == pytest.approx(301 / (2 * 151))


def test_reasons(spark):
    n = len(model.FEATURES)
    k = model.FEATURES.index("sent_len_words")
    unit = [(f, 1.0, 0.0, 1.0) for f in model.FEATURES]
    base = [0.0] * n
    silent = list(base)
    silent[k], silent[0], silent[1] = 9.0, 3.0, 2.0
    down = [-1.0] + [0.0] * (n - 1)
    ties = [1.0] * n
    rows = model.score(model.matrix(features(spark, [(1, silent), (1, base), (0, down), (1, ties)]), "id"), unit, 0.0)
    got = {r["id"]: r["reasons"] for r in model.top_reasons(rows, "id", model=unit).collect()}
    assert got[0] == [model.REASONS[model.FEATURES[0]][0], model.REASONS[model.FEATURES[1]][0]]  # the silent one takes a place
    assert got[1] == [model.FALLBACK[0]]  # exactly 0.5 counts as generated
    assert got[2] == [model.REASONS[model.FEATURES[0]][1]]
    assert got[3] == [model.REASONS[f][0] for f in model.FEATURES[:3]]


def test_metrics(spark):
    rows = [(1, True)] * 5300 + [(1, False)] * 1179 + [(0, True)] * 1372 + [(0, False)] * 5911
    c = evaluate.confusion(spark.createDataFrame(rows, "label int, predicted boolean")).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (5911, 1372, 1179, 5300)
    assert (round(c["precision"], 3), round(c["recall"], 3), round(c["f1"], 3)) == (0.794, 0.818, 0.806)
    none = evaluate.confusion(spark.createDataFrame([(0, False)], "label int, predicted boolean")).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0
    rng = random.Random(5)
    scores = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(400)]
    pos, neg = [p for y, p in scores if y], [p for y, p in scores if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(spark.createDataFrame(scores, "label int, prob double")).first()["auc"] == pytest.approx(want)
    assert evaluate.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, prob double")).first()["auc"] is None


def test_wrong_documents_and_report(spark):
    rows = [("a", 0, 0, "p", "First.", 0.9), ("a", 1, 0, "p", "Second.", 0.9), ("b", 0, 1, "p", "Third.", 0.1), ("c", 0, 1, "p", "Fine.", 0.9), ("d", 0, 0, "mixed", "No.", 0.9), ("e", 0, 0, "p", "Half.", 0.5)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, label int, bucket string, sentence_text string, prob double").withColumn("predicted", F.col("prob") >= 0.5)
    wrong = evaluate.wrong_documents(df, ("p",), 2)
    assert sorted((r["doc_id"], r["preview"]) for r in wrong.collect()) == [("a", "First. Second."), ("b", "Third.")]
    text = report.markdown(evaluate.confusion(df), evaluate.roc_auc(df), evaluate.cohort_rates(df, F.col("bucket")), wrong)
    assert "| precision |" in text and "> First. Second." in text and report.percent(None) == "n/a"


def test_history(spark, tmp_path):
    store = history.Store(spark, str(tmp_path / "store"))
    uid = store.sign_up("some.user", "secret1")
    with pytest.raises(history.NameTaken):
        store.sign_up(" some.user ", "secret2")
    with pytest.raises(ValueError):
        store.sign_up("x", "secret2")
    with pytest.raises(history.BadCredentials):
        store.log_in("some.user", "wrong")
    token = store.log_in("some.user", "secret1")
    assert store.user_of(token) == uid and store.user_of("no") is None and store.user_of(None) is None
    one_id = store.save(uid, " a\ntext ", "{}", 1, 0, 0.25)
    assert [r["preview"] for r in store.listed(uid).collect()] == ["a text"] and store.one(one_id, uid + 1).count() == 0
    store.log_out(token)
    assert store.user_of(token) is None
    rows = spark.createDataFrame([(1, i % 3, i) for i in range(9)] + [(2, 0, 99)], "u int, at int, k int")
    got = sorted((r["u"], r["k"], r["rn"]) for r in history.latest(rows, "u", "at", "k", 2).collect())
    assert got == [(1, 2, 1), (1, 5, 2), (2, 99, 1)]
    ok, bad = history.valid_texts(spark.createDataFrame([(1, " "), (2, None), (3, "x"), (4, "y" * 20_001)], "i int, t string"), "t")
    assert [r["i"] for r in ok.collect()] == [3] and sorted((r["i"], r["error"]) for r in bad.collect()) == [(1, "empty"), (2, "empty"), (4, "too long")]


def test_analyze(spark):
    assert analyze.analyze(spark, "  ") == '{"sentences":[],"doc_summary":{"n_sentences":0}}'
    got = analyze.analyze(spark, "The cat sat here. Moreover, the cat ran away!")
    assert '"n_sentences":2' in got and got.count('"prob_ai"') == 2


def test_colours(spark):
    p = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (0.5,)], "p double")
    assert [r[0] for r in p.select(T.prob_color(F.col("p"))).collect()][:3] == ["rgba(90, 100, 140, 0.00)", "rgba(239, 68, 68, 0.62)", "rgba(239, 68, 68, 0.62)"]
    assert [r[0] for r in p.select(T.prob_glow(F.col("p"))).collect()][0] == "none"
    assert [r[0] for r in spark.createDataFrame([(0.1234,), (None,)], "p double").select(T.percent(F.col("p"))).collect()] == ["12.3%", "n/a"]


def test_streaming(spark, tmp_path):
    rows = [(1, "One. Two."), (2, "Mr. X went. He left.")]
    spark.createDataFrame(rows, "doc_id int, doc_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, doc_text string").parquet(str(tmp_path / "in"))
    q = stream_sentences(stream).writeStream.format("memory").queryName("sents").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("sents").collect()) == [(1, 0, "One."), (1, 1, "Two."), (2, 0, "Mr. X went."), (2, 1, "He left.")]
    timed = spark.createDataFrame(rows, "doc_id int, doc_text string").withColumn("at", F.timestamp_seconds(F.col("doc_id") * 60))
    assert stream_counts(timed, "at").first()["words"] == 7


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert with_columns_only(df, "a", "zz").first().asDict() == {"a": 1, "zz": None}


def test_model_artifact(spark, tmp_path):
    """Trained, saved, loaded: the same scores; a model of other features is refused."""
    rng = random.Random(8)
    rows = [(i, int(x > 0), float(x), *[rng.gauss(0, 1) for _ in model.FEATURES[1:]]) for i in range(300) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame(rows, "sentence_uid int, label int, " + ", ".join(f"{c} double" for c in model.FEATURES))
    fitted = artifact.train(df)
    fitted.save(spark, str(tmp_path / "m"))
    got = artifact.load(spark, str(tmp_path / "m"))
    assert got == fitted and got.terms[0][1] > 1
    m = artifact.metrics(got.score(df))
    assert m["auc"] > 0.97 and m["tp"] + m["fn"] == sum(r[1] for r in rows)
    artifact.Linear(got.terms[:3], 0.0).save(spark, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        artifact.load(spark, str(tmp_path / "other"))
    gbt = model.fit_gbt(df, rounds=3)
    assert gbt.getNumTrees == 3


def test_windows(spark):
    """Every token but the first is scored once, by the first window that can."""
    def make():
        return lambda words: [(float(len(words)), i) for i in range(len(words) - 1)]

    rows = spark.createDataFrame([(1, ["w"] * 20), (2, ["w"]), (3, []), (4, None), (5, ["w"] * 8)], "doc_id int, tokens array<string>")
    got = sorted(tuple(r) for r in lm.windowed(rows, make, window=8, stride=4).collect())
    assert [g[1] for g in got if g[0] == 1] == list(range(1, 20)) and [g[3] for g in got if g[0] == 1] == [0, 1, 2, 3, 4, 5, 6, 3, 4, 5, 6, 3, 4, 5, 6, 3, 4, 5, 6]
    assert [g[1] for g in got if g[0] == 5] == list(range(1, 8)) and {g[0] for g in got} == {1, 5}
    with pytest.raises(ValueError):
        lm.windowed(rows, make, window=4, stride=4)


def test_generation(spark):
    """A batch that fails is told, and the others go on."""

    def make():
        def run(messages):
            if "boom" in messages:
                raise MemoryError
            return [f'"{m} ' * 50 for m in messages]

        return run

    jobs = spark.createDataFrame([(i, "boom" if i == 2 else f"word{i}") for i in range(8)], "id int, message string").coalesce(1)
    rows = generate.generated(jobs, make, batch=2)
    assert sorted(r["id"] for r in rows.where("error = 'MemoryError'").collect()) == [2, 3]
    assert sorted(r["id"] for r in generate.kept(rows, 50).collect()) == [0, 1, 4, 5, 6, 7] and generate.kept(rows, 51).count() == 0
    with pytest.raises(ValueError):
        generate.filled("{a} {b}", a=F.lit(1))
    got = {r["id"]: (r["result"], r["error"]) for r in generate.with_errors(spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string"), "t", lambda t: t.split()[1]).collect()}
    assert got[1] == ("b", None) and got[2][0] is None and got[2][1].startswith("AttributeError")


def test_stages(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    at = str(tmp_path / "stage")
    assert stages.stage(spark, at, build).count() == stages.stage(spark, at, build).count() == 3 and len(made) == 1
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert stages.stage(spark, at, build).count() == 3 and len(made) == 2
    assert len(stages.optional(spark, [at, str(tmp_path / "none")])) == 1
    with pytest.raises(FileNotFoundError):
        stages.optional(spark, [str(tmp_path / "none")])
    assert stages.preferred(["test", "train"]) == "train" and stages.preferred(["b", "a"]) == "b"
    with pytest.raises(ValueError):
        stages.preferred([])
