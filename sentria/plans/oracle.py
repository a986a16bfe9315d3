"""SQL with the same rows as the core's queries, for an engine without lookaround in its patterns.

A sentence end is found by capturing what follows; ends after an abbreviation or a single character
are then taken back by gluing the fragments together.
"""

from __future__ import annotations

from sentria.functions import text as T
from sentria.operators import lm, model, style

#: White space outside ASCII included, as a class body.
_W = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def norm(c: str) -> str:
    return f"regexp_replace({strip(c)}, '[ \\t\\n]+', ' ', 'g')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {lit(pattern)}))"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '[A-Za-z'']+')"


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {name or c}"


_ABBREVIATIONS = ", ".join(lit(a) for a in T.ABBREVIATIONS)
_TELLS = r"(?i)\b(?:" + T.any_of(T.TELL_WORDS) + r")\b"
_CONTRACTION = r"(?i)[\p{L}\p{N}_]'(?:" + "|".join(T.CONTRACTIONS) + r")\b"

DOCS = "docs AS (SELECT DISTINCT doc_id, doc_text FROM doc_manifest WHERE doc_text IS NOT NULL)"


def sents(source: str = "docs", prefix: str = "") -> str:
    """CTEs: sents(doc_id, sentence_order, char_start, char_end, sentence_text)."""
    return f"""normed AS (SELECT doc_id, {norm('doc_text')} AS t FROM {source}),
    marked AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]+[''")\\]]*)[{_W}]+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS f FROM normed),
    frags AS (SELECT doc_id, unnest(f) AS frag, generate_subscripts(f, 1) AS k FROM marked),
    guarded AS (SELECT *, rtrim(lower(string_split(trim(regexp_replace(frag, '[.!?]+[''")\\]]*$', '')), ' ')[-1]), '.') AS w FROM frags),
    numbered AS (SELECT *, coalesce(sum(CASE WHEN w IN ({_ABBREVIATIONS}) OR length(w) = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM guarded),
    glued AS (SELECT doc_id, sid, string_agg(frag, ' ' ORDER BY k) AS sentence_text FROM numbered GROUP BY doc_id, sid),
    placed AS (SELECT *, coalesce(sum(length(sentence_text) + 1) OVER (PARTITION BY doc_id ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM glued),
    sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sid) - 1 AS INTEGER) AS sentence_order, CAST(s AS INTEGER) AS char_start, CAST(s + length(sentence_text) AS INTEGER) AS char_end, sentence_text FROM placed WHERE length({strip('sentence_text')}) > 0)"""


SENTS = f"WITH {DOCS}, {sents()}"


def of_sentences(cols: str, more: str = "", source: str = "sents") -> str:
    return f"{SENTS}{more} SELECT doc_id, sentence_order, {cols} FROM {source}"


LENGTHS = f""", sized AS (SELECT *, CAST(len({words('sentence_text')}) AS INTEGER) AS n_words FROM sents),
    lens AS (SELECT *, avg(CAST(greatest(n_words, 1) AS DOUBLE)) OVER (PARTITION BY doc_id) AS mean_len, stddev_pop(CAST(greatest(n_words, 1) AS DOUBLE)) OVER (PARTITION BY doc_id) AS std_len FROM sized),
    stats AS (SELECT *, CASE WHEN std_len > 1e-6 THEN (n_words - mean_len) / std_len ELSE 0.0 END AS len_z, abs(n_words - mean_len) / greatest(mean_len, 1.0) AS len_dev FROM lens)"""


def chars(c: str, which: str) -> str:
    return f"(length({c}) - length(translate({c}, {lit(which)}, '')))"


_S = "sentence_text"
_N = f"greatest(length({_S}), 1)"
COMMA = f"{chars(_S, ',')} * 100.0 / {_N}"
DASH = f"({chars(_S, ';—')} + (length({_S}) - length(replace({_S}, ' - ', ''))) / 3.0) * 100.0 / {_N}"
DENSITY = f"CAST({chars(_S, '.,;:!?—-')} AS DOUBLE) / {_N}"
AVG_LEN = f"CASE WHEN len({words(_S)}) > 0 THEN CAST(list_sum(list_transform({words(_S)}, lambda w: length(w))) AS DOUBLE) / len({words(_S)}) ELSE 0.0 END"
UNIQUE = f"CAST(len(list_distinct(list_transform({words(_S)}, lambda w: lower(w)))) AS DOUBLE) / greatest(len({words(_S)}), 1)"


def grams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')) ELSE [] END"


LEXIS = f""", lowered AS (SELECT doc_id, list_transform({words(norm('doc_text'))}, lambda w: lower(w)) AS w FROM docs),
    lexis AS (SELECT doc_id, len(w) AS n_doc_words,
      CASE WHEN len(w) = 0 THEN 0.0 WHEN len(w) <= 40 THEN CAST(len(list_distinct(w)) AS DOUBLE) / len(w)
        ELSE list_avg(list_transform(range(0, len(w) - 40 + 1, 20), lambda i: len(list_distinct(w[i + 1:i + 40])) / 40.0)) END AS doc_mattr,
      CASE WHEN len(w) >= 3 THEN 1.0 - CAST(len(list_distinct({grams('w', 2)})) AS DOUBLE) / (len(w) - 1) ELSE 0.0 END AS doc_bigram_repetition_rate,
      CASE WHEN len(w) >= 4 THEN 1.0 - CAST(len(list_distinct({grams('w', 3)})) AS DOUBLE) / (len(w) - 2) ELSE 0.0 END AS doc_trigram_repetition_rate
    FROM lowered)"""
OVERLAP = f""", sl AS (SELECT doc_id, sentence_order, list_transform({words(_S)}, lambda w: lower(w)) AS w FROM sents),
    own AS (SELECT doc_id, sentence_order, bigram, count(*) AS n FROM (SELECT doc_id, sentence_order, unnest({grams('w', 2)}) AS bigram FROM sl) GROUP BY ALL),
    whole AS (SELECT doc_id, bigram, count(*) AS n_doc FROM (SELECT doc_id, unnest({grams('w', 2)}) AS bigram FROM lowered) GROUP BY ALL),
    shared AS (SELECT doc_id, sentence_order, CAST(count_if(n_doc > n) AS DOUBLE) / count(*) AS overlap FROM own JOIN whole USING (doc_id, bigram) GROUP BY ALL),
    shares AS (SELECT doc_id, sentence_order, coalesce(overlap, 0.0) AS overlap FROM sents LEFT JOIN shared USING (doc_id, sentence_order))"""
COUNTS = f""", counted AS (SELECT *, {count(_S, _CONTRACTION)} AS contractions, {count(_S, _TELLS)} AS tells, {chars(_S, ',')} AS commas FROM stats),
    wide AS (SELECT *, count(*) OVER d AS doc_n, sum(contractions) OVER d AS doc_contractions, sum(tells) OVER d AS doc_tells, sum(commas) OVER d AS doc_commas FROM counted WINDOW d AS (PARTITION BY doc_id)),
    style AS (SELECT doc_id, sentence_order, CAST(n_words AS DOUBLE) AS sent_len_words, {AVG_LEN} AS sent_avg_word_len, {COMMA} AS sent_comma_rate, {DASH} AS sent_semicolon_dash_rate, {DENSITY} AS sent_punct_density,
      contractions * 100.0 / greatest(n_words, 1) AS sent_contraction_rate, CAST(tells AS DOUBLE) AS sent_ai_tell_count, {UNIQUE} AS sent_unique_word_ratio, overlap AS sent_local_bigram_overlap, len_z AS sent_len_zscore_in_doc, len_dev AS sent_len_abs_dev_ratio,
      CAST(doc_n AS DOUBLE) AS doc_sentence_count, mean_len AS doc_mean_sentence_len, std_len / mean_len AS doc_sentence_len_cv, doc_mattr, doc_bigram_repetition_rate, doc_trigram_repetition_rate,
      CAST(doc_contractions AS DOUBLE) * 100.0 / greatest(n_doc_words, 1) AS doc_contraction_rate, CAST(doc_tells AS DOUBLE) * 100.0 / greatest(n_doc_words, 1) AS doc_ai_tell_rate, CAST(doc_commas AS DOUBLE) / greatest(doc_n, 1) AS doc_comma_per_sentence
      FROM wide JOIN shares USING (doc_id, sentence_order) JOIN lexis USING (doc_id))"""
STYLE = f"{SENTS}{LENGTHS}{LEXIS}{OVERLAP}{COUNTS}"

WORDS = f""", exploded AS (SELECT doc_id, sentence_order, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, sentence_order, {words(_S)} AS w FROM sents)),
    word_rows AS (SELECT doc_id, sentence_order, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sentence_order, i) - 1 AS INTEGER) AS pos, word FROM exploded)"""
LM = f"""{WORDS}, pairs AS (SELECT *, lower(word) AS w, lag(lower(word)) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM word_rows),
    counts AS (SELECT c, w, count(*) AS n FROM pairs WHERE c IS NOT NULL GROUP BY c, w),
    lm AS (SELECT c, w, rank() OVER (PARTITION BY c ORDER BY n DESC) - 1 AS rank, -ln((n + {lm.K}) / (sum(n) OVER (PARTITION BY c) + {lm.K} * (SELECT count(DISTINCT w) FROM counts))) AS nll FROM counts),
    scores AS (SELECT doc_id, sentence_order, pos, CAST(nll AS DOUBLE) AS nll, rank FROM pairs JOIN lm USING (c, w))"""
SIGNALS = f""", sig AS (SELECT doc_id, sentence_order, avg(nll) AS sig_mean_nll, exp(avg(nll)) AS sig_perplexity, avg(rank) AS sig_mean_rank, CAST(quantile_disc(rank, 0.5) AS DOUBLE) AS sig_median_rank, avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0.0 END) AS sig_frac_top1, avg(CASE WHEN rank < 10 THEN 1.0 ELSE 0.0 END) AS sig_frac_top10, avg(CASE WHEN rank < 50 THEN 1.0 ELSE 0.0 END) AS sig_frac_top50, coalesce(stddev_samp(nll), 0.0) AS sig_surprisal_std, max(nll) AS sig_max_surprisal FROM scores GROUP BY ALL),
    sig_doc AS (SELECT doc_id, exp(avg(nll)) AS sig_doc_perplexity FROM scores GROUP BY doc_id),
    signals AS (SELECT s.doc_id, s.sentence_order, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in lm.SIGNALS)} FROM sents s LEFT JOIN (sig JOIN sig_doc USING (doc_id)) g ON s.doc_id = g.doc_id AND s.sentence_order = g.sentence_order)"""

CHUNKS = "chunks AS (SELECT DISTINCT doc_id, group_id, chunk_idx, chunk_text, label, bucket, gen_model FROM self_ai_polished_chunks)"
JOINED = f"""{CHUNKS}, cn AS (SELECT *, coalesce({norm('chunk_text')}, '') AS norm FROM chunks),
    ce AS (SELECT *, greatest(sum(length(norm) + CASE WHEN length(norm) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_idx) - 1, 0) AS e FROM cn),
    ranges AS (SELECT * EXCLUDE (e), CAST(CASE WHEN length(norm) > 0 THEN e - length(norm) ELSE e END AS INTEGER) AS c_start, CAST(e AS INTEGER) AS c_end FROM ce),
    joined AS (SELECT doc_id, string_agg(norm, ' ' ORDER BY chunk_idx) AS doc_text FROM cn WHERE norm <> '' GROUP BY doc_id)"""
LABELLED = f"""WITH {JOINED}, {sents('joined')},
    kept AS (SELECT * FROM sents WHERE len(list_filter(regexp_split_to_array({strip(_S)}, '[{_W}]+'), lambda w: w <> '')) >= 3),
    lasts AS (SELECT doc_id, max(chunk_idx) AS last_idx FROM chunks GROUP BY doc_id),
    hit AS (SELECT k.*, r.chunk_idx FROM kept k LEFT JOIN ranges r ON k.doc_id = r.doc_id AND (k.char_start + k.char_end) // 2 >= r.c_start AND (k.char_start + k.char_end) // 2 < r.c_end),
    labelled AS (SELECT h.doc_id, h.sentence_order, h.char_start, h.char_end, h.sentence_text, c.chunk_idx, c.label, c.bucket, c.gen_model FROM hit h JOIN lasts USING (doc_id) JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_idx = coalesce(h.chunk_idx, last_idx))"""


def finite(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR lower(CAST({c} AS VARCHAR)) IN ('nan', '-nan', 'inf', '-inf', 'infinity', '-infinity') THEN 0.0 ELSE {c} END"


FEATURES = f"feats AS (SELECT DISTINCT sentence_uid, doc_id, label, bucket, split, sentence_text, {', '.join(f'{finite(c)} AS {c}' for c in model.FEATURES)} FROM sentence_features)"


def _z(name: str, mean: float, scale: float) -> str:
    return "0.0::DOUBLE" if scale == 0 else f"(({name} - {mean!r}::DOUBLE) / {scale!r}::DOUBLE)"


_MODEL = model.fixed_model()
_LOGIT = f"{model.FIXED_INTERCEPT!r}::DOUBLE + " + " + ".join(f"{_z(n, m, s)} * ({c!r}::DOUBLE)" for n, c, m, s in _MODEL)
SCORED = f"""WITH {FEATURES}, logits AS (SELECT *, {_LOGIT} AS x FROM feats),
    scored0 AS (SELECT *, CASE WHEN x >= 0 THEN 1.0 / (1.0 + exp(-least(x, 700.0))) ELSE exp(greatest(x, -700.0)) / (1.0 + exp(greatest(x, -700.0))) END AS prob FROM logits),
    scored AS (SELECT *, prob >= {model.THRESHOLD} AS predicted FROM scored0)"""
CONTRIBUTIONS = f"""{SCORED}, contributions AS ({' UNION ALL '.join(f"SELECT sentence_uid, predicted, {i} AS ord, {lit(n)} AS name, {_z(n, m, s)} AS z, {_z(n, m, s)} * ({c!r}::DOUBLE) AS contribution FROM scored" for i, (n, c, m, s) in enumerate(_MODEL))})"""
_TEXT = "CASE " + " ".join(f"WHEN name = {lit(n)} THEN CASE WHEN z > 0 THEN {lit(a)} ELSE {lit(b)} END" for n, (a, b) in model.REASONS.items()) + " END"
_SEED_HASH = "md5('42' || CAST(doc_id AS VARCHAR))"
TEXTS = "texts AS (SELECT doc_id, text, lang, source FROM documents WHERE text IS NOT NULL)"
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {strip('p')}), lambda p: p <> '')"
_CLEAN0 = f"regexp_replace({strip('chunk_text')}, '^\"|\"$', '', 'g')"
_CLEAN1 = f"regexp_replace({_CLEAN0}, '(?i)^(?:Title|Essay|Prompt Response)\\s*:[^\\n]*\\n', '')"
_CLEAN = strip(f"regexp_replace({_CLEAN1}, '^#+\\s*[^\\n]*\\n', '')")
_T = "least(greatest(p, 0.0), 1.0)"


def _channel(a: int, b: int) -> str:
    return f"CAST(floor({float(a)} + {float(b - a)} * {_T} + 0.5) AS INTEGER)"


ORACLE_SQL: dict[str, str] = {
    "normalize_ws": f"SELECT doc_id, {norm('text')} AS normalized FROM documents WHERE text IS NOT NULL",
    "split_sentences": of_sentences("sentence_text"),
    "sentence_spans": of_sentences("char_start, char_end"),
    "stream_split": of_sentences("sentence_text"),
    "word_tokens": f"{SENTS}{WORDS} SELECT doc_id, sentence_order, pos, word FROM word_rows",
    "sentence_len_stats": of_sentences(f"n_words, {r('mean_len')}, {r('std_len')}, {r('len_z')}, {r('len_dev')}", LENGTHS, "stats"),
    "lexical_density": of_sentences(f"{r(AVG_LEN, 'avg_word_len')}, {r(UNIQUE, 'unique_ratio')}"),
    "punct_rates": of_sentences(f"{r(COMMA, 'comma_rate')}, {r(DASH, 'semicolon_dash_rate')}, {r(DENSITY, 'punct_density')}"),
    "contractions": of_sentences(f"CAST({count(_S, _CONTRACTION)} AS INTEGER) AS n"),
    "tell_words": f"SELECT doc_id, CAST({count('text', _TELLS)} AS INTEGER) AS n FROM documents WHERE text IS NOT NULL",
    "mattr": f"WITH {DOCS}{LEXIS} SELECT doc_id, {r('doc_mattr')} FROM lexis",
    "bigram_repetition": f"WITH {DOCS}{LEXIS} SELECT doc_id, {r('doc_bigram_repetition_rate')} FROM lexis",
    "trigram_repetition": f"WITH {DOCS}{LEXIS} SELECT doc_id, {r('doc_trigram_repetition_rate')} FROM lexis",
    "local_bigram_overlap": f"{SENTS}{LEXIS}{OVERLAP} SELECT doc_id, sentence_order, {r('overlap')} FROM shares",
    "style_features": f"{STYLE} SELECT doc_id, sentence_order, {', '.join(r(c) for c in style.SENTENCE_FEATURES + style.DOCUMENT_FEATURES)} FROM style",
    "dedup_docs": f"WITH {TEXTS}, kept AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) SELECT doc_id, source, 'daigt_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS essay_uid FROM kept",
    "seeded_sample": f"WITH {TEXTS} SELECT doc_id, lang FROM texts ORDER BY {_SEED_HASH}, doc_id LIMIT 220",
    "exclude_polished_sources": "SELECT DISTINCT doc_id, group_id FROM doc_manifest d WHERE doc_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM self_ai_polished_chunks c WHERE c.group_id = d.group_id)",
    "union_corpora": " UNION ALL ".join(f"SELECT doc_id, chunk_idx, label, gen_model, '{n}' AS hf_split FROM (SELECT DISTINCT doc_id, group_id, chunk_idx, chunk_text, label, bucket, gen_model FROM self_ai_{n}_chunks)" for n in ("fresh", "polished")),
    "reconstruct_docs": f"WITH {JOINED} SELECT doc_id, doc_text FROM joined",
    "chunk_ranges": f"WITH {JOINED} SELECT doc_id, chunk_idx, c_start, c_end FROM ranges",
    "midpoint_labels": f"{LABELLED} SELECT doc_id, sentence_order, chunk_idx, label FROM labelled",
    "sentence_dataset": f"{LABELLED} SELECT doc_id, sentence_order, char_start, char_end, sentence_text, label, bucket, gen_model, doc_id || '_s' || CAST(sentence_order AS VARCHAR) AS sentence_uid FROM labelled",
    "group_split": "WITH g AS (SELECT DISTINCT group_id FROM doc_manifest WHERE doc_text IS NOT NULL AND group_id IS NOT NULL) SELECT group_id, CASE WHEN row_number() OVER (ORDER BY md5('42' || group_id) || group_id) <= ceil(0.2 * (SELECT count(*) FROM g)) THEN 'test' ELSE 'train' END AS split FROM g",
    "split_counts": "SELECT split, label, count(*) AS n FROM (SELECT DISTINCT sentence_uid, split, label FROM sentence_dataset) GROUP BY split, label",
    "docs_per_bucket": "SELECT bucket, count(DISTINCT doc_id) AS docs, count(DISTINCT sentence_uid) AS sentences FROM sentence_dataset GROUP BY bucket",
    "job_cross": "WITH each AS (SELECT user_message, model, style, md5(user_message || '|' || model || '|' || style) AS h FROM (SELECT DISTINCT user_message FROM generation_jobs WHERE user_message IS NOT NULL) CROSS JOIN (VALUES ('model_a'), ('model_b')) m(model) CROSS JOIN (VALUES ('direct'), ('coached')) s(style)) SELECT user_message, model, style, CAST((row_number() OVER (ORDER BY h) - 1) // 8 AS BIGINT) AS batch FROM each",
    "round_robin": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS name FROM (SELECT DISTINCT doc_id FROM self_ai_polished_chunks)",
    "subset_per_group": "WITH c AS (SELECT DISTINCT doc_id, chunk_idx FROM self_ai_polished_chunks), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42' || doc_id || CAST(chunk_idx AS VARCHAR)), chunk_idx) AS rk, CAST(('0x' || substr(md5('42' || doc_id), 1, 6)) AS BIGINT) / 16777216.0 AS u FROM c) SELECT doc_id, chunk_idx FROM n WHERE rk <= greatest(1, CAST(floor(n * (0.4::DOUBLE + u * (0.7::DOUBLE - 0.4::DOUBLE))) AS INTEGER))",
    "polish_merge": f"WITH {CHUNKS}, done AS (SELECT doc_id, chunk_idx, 'Again: ' || chunk_text AS polished FROM chunks WHERE label = 1 AND length(chunk_text) >= 40), j AS (SELECT c.doc_id, c.chunk_idx, coalesce(polished, chunk_text) AS chunk_text, CAST(polished IS NOT NULL AS INTEGER) AS label, CASE WHEN polished IS NOT NULL THEN 'model_a' ELSE 'human' END AS gen_model, max(polished IS NOT NULL) OVER (PARTITION BY c.doc_id) AS any_ok FROM chunks c LEFT JOIN done d ON c.doc_id = d.doc_id AND c.chunk_idx = d.chunk_idx) SELECT doc_id, chunk_idx, chunk_text, label, gen_model FROM j WHERE any_ok",
    "clean_text": f"SELECT doc_id, chunk_idx, {_CLEAN} AS cleaned FROM (SELECT DISTINCT doc_id, group_id, chunk_idx, chunk_text, label, bucket, gen_model FROM self_ai_fresh_chunks) WHERE chunk_text IS NOT NULL",
    "paragraph_chunks": f"""WITH docs AS (SELECT doc_id, text AS doc_text FROM documents WHERE text IS NOT NULL), {sents()},
    lists AS (SELECT doc_id, list(sentence_text ORDER BY sentence_order) AS s FROM sents GROUP BY doc_id),
    parts AS (SELECT d.doc_id, CASE WHEN len({_PARAGRAPHS}) >= 2 THEN {_PARAGRAPHS} WHEN len(s) > 0 THEN list_transform(range(0, len(s), 3), lambda i: array_to_string(s[i + 1:i + 3], ' ')) ELSE [text] END AS p FROM documents d LEFT JOIN lists USING (doc_id) WHERE text IS NOT NULL)
    SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS chunk_idx, unnest(p) AS chunk_text FROM parts""",
    "lm_token_stats": f"{SENTS}{LM} SELECT doc_id, sentence_order, pos, {r('nll')}, CAST(rank AS INTEGER) AS rank FROM scores",
    "token_to_sentence": f"""{SENTS}, toks AS (SELECT doc_id, string_split(t, ' ') AS a FROM normed), ex AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM toks),
    tokens AS (SELECT doc_id, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS char_start FROM ex),
    spans AS (SELECT doc_id, sentence_order, lag(char_end, 1, 0) OVER w AS low, CASE WHEN lead(char_end) OVER w IS NULL THEN 2147483647 ELSE char_end END AS high FROM sents WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_order))
    SELECT t.doc_id, sentence_order, count(*) AS n_tokens, CAST(min(t.char_start) AS BIGINT) AS first_start FROM tokens t JOIN spans s ON t.doc_id = s.doc_id AND t.char_start >= low AND t.char_start < high GROUP BY ALL""",
    "sentence_signals": f"{SENTS}{LM}{SIGNALS} SELECT doc_id, sentence_order, {', '.join(r(c) for c in lm.SIGNALS)} FROM signals",
    "doc_perplexity": f"{SENTS}{LM} SELECT doc_id, {r('exp(avg(nll))', 'doc_perplexity')}, {r('avg(rank)', 'doc_mean_rank')} FROM scores GROUP BY doc_id",
    "nll_ratio": f"""{SENTS}{LM}, uni AS (SELECT lower(word) AS w, count(*) AS n FROM word_rows GROUP BY ALL), utab AS (SELECT w, -ln((n + {lm.K}) / ((SELECT sum(n) FROM uni) + {lm.K} * (SELECT count(*) FROM uni))) AS nll FROM uni),
    b AS (SELECT doc_id, avg(u.nll) AS b FROM word_rows p JOIN utab u ON lower(p.word) = u.w WHERE pos > 0 GROUP BY doc_id), a AS (SELECT doc_id, avg(nll) AS a, count(*) AS n FROM scores GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN n >= 2 THEN a / nullif(b, 0) END, 6) AS ratio FROM a JOIN b USING (doc_id)""",
    "feature_matrix": f"WITH {FEATURES} SELECT sentence_uid, {', '.join(r(c) for c in model.FEATURES)} FROM feats",
    "scaler_fit": f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT {lit(c)} AS name, {r(f'avg({c})', 'mean')}, round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS scale FROM feats WHERE split = 'train'" for c in model.FEATURES),
    "class_weights": f"WITH {FEATURES}, c AS (SELECT label, count(*) AS n FROM feats WHERE split = 'train' GROUP BY label) SELECT label, round((SELECT sum(n) FROM c) / (2.0 * n), 6) AS weight FROM c",
    "linear_score": f"{SCORED} SELECT sentence_uid, split, {r('prob')}, predicted FROM scored",
    "contributions": f"{CONTRIBUTIONS} SELECT sentence_uid, name, {r('z')}, {r('contribution')} FROM contributions",
    "top_reasons": f"""{CONTRIBUTIONS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sentence_uid ORDER BY abs(contribution) DESC, ord) AS rk, {_TEXT} AS text FROM contributions WHERE contribution * CASE WHEN predicted THEN 1 ELSE -1 END > 0),
    said AS (SELECT sentence_uid, string_agg(text, ' ' ORDER BY rk) AS reasons FROM ranked WHERE rk <= 3 AND text IS NOT NULL GROUP BY sentence_uid)
    SELECT s.sentence_uid, predicted, coalesce(reasons, CASE WHEN predicted THEN {lit(model.FALLBACK[0])} ELSE {lit(model.FALLBACK[1])} END) AS reasons FROM scored s LEFT JOIN said USING (sentence_uid)""",
    "doc_summary": f"{SCORED} SELECT doc_id, count(*) AS n_sentences, {r('avg(prob)', 'mean_prob')}, CAST(count_if(predicted) AS BIGINT) AS n_flagged FROM scored GROUP BY doc_id",
    "confusion": f"""{SCORED}, c AS (SELECT split, CAST(count_if(label <> 1 AND NOT predicted) AS BIGINT) AS tn, CAST(count_if(label <> 1 AND predicted) AS BIGINT) AS fp, CAST(count_if(label = 1 AND NOT predicted) AS BIGINT) AS fn, CAST(count_if(label = 1 AND predicted) AS BIGINT) AS tp FROM scored WHERE split IS NOT NULL GROUP BY split),
    m AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall FROM c)
    SELECT split, tn, fp, fn, tp, {r('precision')}, {r('recall')}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 6) AS f1 FROM m""",
    "roc_auc": f"""{SCORED}, t AS (SELECT round(prob, 9) AS p, label FROM scored WHERE split = 'test'), rk AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM t),
    s AS (SELECT sum(CASE WHEN label = 1 THEN rk END) AS sr, count_if(label = 1) AS n1, count_if(label <> 1) AS n0 FROM rk) SELECT round((sr - n1 * (n1 + 1) / 2.0) / nullif(CAST(n1 AS DOUBLE) * n0, 0), 6) AS auc, CAST(n1 + n0 AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n_positive FROM s""",
    "cohort_bias": f"{SCORED}, c AS (SELECT *, CASE WHEN bucket = 'ell_nonnative' THEN 'nonnative' WHEN split = 'test' AND bucket = 'daigt_human' THEN 'native' END AS cohort FROM scored) SELECT cohort, count(*) AS n, count(DISTINCT doc_id) AS docs, round(avg(CASE WHEN predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS flag_rate FROM c WHERE cohort IS NOT NULL GROUP BY cohort",
    "confident_wrong": f"""{SCORED}, t AS (SELECT *, CAST(regexp_extract(sentence_uid, '_s(\\d+)$', 1) AS INTEGER) AS ord FROM scored WHERE split = 'test' AND bucket IN ('daigt_human', 'daigt_ai', 'self_ai_fresh', 'ell_nonnative')),
    d AS (SELECT doc_id, avg(prob) AS mean_prob, arg_min(label, ord) AS true_label, arg_min(bucket, ord) AS bucket, count(*) AS n_sentences, substr(string_agg(sentence_text, ' ' ORDER BY ord, sentence_text), 1, 400) AS preview FROM t GROUP BY doc_id),
    w AS (SELECT *, CAST(mean_prob >= 0.5 AS INTEGER) AS pred_label FROM d) SELECT doc_id, bucket, true_label, pred_label, {r('mean_prob')}, n_sentences, preview FROM w WHERE pred_label <> true_label ORDER BY round(abs(mean_prob - 0.5), 9) DESC, doc_id LIMIT 3""",
    "history_topk": "SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM (SELECT DISTINCT event_id, user_id, ts, value FROM events)) WHERE rn <= 50",
    "valid_texts": f"SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n > 20000 THEN 'too long' ELSE 'ok' END AS status FROM (SELECT doc_id, coalesce(length({strip('text')}), 0) AS n FROM documents)",
    "text_preview": f"SELECT doc_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '...' ELSE t END AS preview FROM (SELECT doc_id, replace({strip('text')}, chr(10), ' ') AS t FROM documents WHERE text IS NOT NULL)",
    "html_escape": "SELECT doc_id, chunk_idx, replace(replace(replace(replace(replace(chunk_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM (SELECT DISTINCT doc_id, group_id, chunk_idx, chunk_text, label, bucket, gen_model FROM self_ai_fresh_chunks) WHERE chunk_text IS NOT NULL",
    "prob_color": f"""{SCORED}, q AS (SELECT sentence_uid, floor(prob * 1000) / 1000.0 + 0.0002 AS p FROM scored) SELECT sentence_uid, printf('rgba(%d, %d, %d, %.2f)', {_channel(90, 239)}, {_channel(100, 68)}, {_channel(140, 68)}, pow({_T}, 1.6) * 0.62) AS color,
    CASE WHEN p < 0.75 THEN 'none' ELSE printf('0 0 %dpx rgba(239, 68, 68, %.2f)', CAST(floor(6.5 + (p - 0.75) / 0.25 * 10.0) AS INTEGER), 0.15 + (p - 0.75) / 0.25 * 0.25) END AS glow, printf('%.1f%%', p * 100.0) AS shown FROM q""",
    "all_features": f"{STYLE}{LM}{SIGNALS} SELECT doc_id, sentence_order, {', '.join(r(c) for c in lm.SIGNALS + style.SENTENCE_FEATURES + style.DOCUMENT_FEATURES)} FROM style JOIN signals USING (doc_id, sentence_order)",
    "saved_model_score": f"{SCORED} SELECT sentence_uid, split, {r('prob')}, predicted FROM scored",
    "bias_gap": f"""{SCORED}, a AS (SELECT count(*) FILTER (bucket = 'ell_nonnative') AS n, count(DISTINCT doc_id) FILTER (bucket = 'ell_nonnative') AS d, avg(CASE WHEN predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (bucket = 'ell_nonnative') AS f,
    count(*) FILTER (bucket = 'daigt_human' AND split = 'test') AS nn, avg(CASE WHEN predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (bucket = 'daigt_human' AND split = 'test') AS nf FROM scored)
    SELECT nullif(n, 0) AS n_sentences, nullif(d, 0) AS n_essays, {r('f', 'false_positive_rate')}, nullif(nn, 0) AS native_n_sentences, {r('nf', 'native_false_positive_rate')}, {r('(f - nf) * 100', 'gap_percentage_points')} FROM a""",
    # the first window of 16 that covers a place begins at the least multiple of 8 that lets it
    "windowed_scores": f"""WITH d AS (SELECT DISTINCT doc_id, doc_text FROM doc_manifest WHERE doc_text IS NOT NULL), t AS (SELECT doc_id, list_filter(regexp_split_to_array({strip('doc_text')}, '[{_W}]+'), lambda x: x <> '') AS w FROM d),
    p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS pos FROM t), s AS (SELECT *, pos - 1 - 8 * greatest(0, CAST(ceil((pos - 15) / 8.0) AS BIGINT)) AS i FROM p)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, {r('(length(w[pos]) + i % 7) / 10.0::DOUBLE', 'nll')}, CAST(i % 5 AS INTEGER) AS rank FROM s""",
    "word_bounds": f"""WITH c AS (SELECT DISTINCT doc_id, group_id, chunk_idx, chunk_text, label, bucket, gen_model FROM self_ai_fresh_chunks WHERE chunk_text IS NOT NULL), n AS (SELECT doc_id, chunk_idx, CAST(len(list_filter(regexp_split_to_array({strip('chunk_text')}, '[{_W}]+'), lambda x: x <> '')) AS INTEGER) AS n FROM c)
    SELECT *, n >= 80 AS essay, n >= 15 AS rework, n >= 8 AS reworked, n >= 3 AS sentence FROM n""",
    "style_per_document": "SELECT DISTINCT doc_id, CASE CAST(('0x' || substr(md5('42' || doc_id), 7, 6)) AS BIGINT) % 2 WHEN 0 THEN 'direct' ELSE 'coached' END AS style FROM self_ai_polished_chunks WHERE doc_id IS NOT NULL",
    "filled_templates": "SELECT DISTINCT job_id, CASE WHEN prompt_style IS NOT NULL AND user_message IS NOT NULL THEN 'Write in style ' || prompt_style || '.' || chr(10) || chr(10) || 'Prompt: ' || user_message END AS message FROM generation_jobs",
    "generated_essays": f"""WITH j AS (SELECT DISTINCT job_id, user_message FROM generation_jobs WHERE user_message IS NOT NULL), a AS (SELECT job_id, {_CLEAN.replace('chunk_text', "('Title: an answer' || chr(10) || repeat(user_message || ' ', 4))")} AS chunk_text FROM j)
    SELECT DISTINCT job_id, chunk_text FROM a WHERE len(list_filter(regexp_split_to_array({strip('chunk_text')}, '[{_W}]+'), lambda x: x <> '')) >= 80""",
    "row_errors": f"""WITH t AS (SELECT doc_id, text, regexp_split_to_array({strip('text')}, '[{_W}]+')[1] AS w FROM documents) SELECT doc_id, CAST(CASE WHEN text IS NOT NULL AND w <> '' THEN length(w) ELSE -1 END AS INTEGER) AS length, CASE WHEN text IS NULL THEN 'AttributeError' WHEN w = '' THEN 'IndexError' END AS error FROM t""",
    "single_split": "SELECT DISTINCT doc_id, lower(trim(split)) AS split FROM doc_manifest WHERE doc_text IS NOT NULL AND lower(trim(split)) = 'train'",
    "stream_window_counts": f"SELECT CAST(floor(epoch(collected_at) / 86400) * 86400 AS BIGINT) AS start, count(*) AS documents, CAST(coalesce(sum(len({words('text')})), 0) AS BIGINT) AS words FROM documents WHERE collected_at IS NOT NULL GROUP BY 1",
}
