"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sentria.llm import encoding, leaks, overlap, pairs, repetition, residue, sentences, splits, splitting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": residue.p1_found,
    "p1_kinds": residue.p1_kinds,
    "p1_clean": residue.p1_clean,
    "p1_templates": residue.p1_templates,
    "p2_found": pairs.p2_found,
    "p2_rates": pairs.p2_rates,
    "p3_found": sentences.p3_found,
    "p3_sentences": sentences.p3_sentences,
    "p3_stored": sentences.p3_stored,
    "p4_found": repetition.p4_found,
    "p4_shares": repetition.p4_shares,
    "p4_ablation": repetition.p4_ablation,
    "p5_found": pairs.p5_found,
    "p5_rates": pairs.p5_rates,
    "p5_limits": pairs.p5_limits,
    "p6_found": overlap.p6_found,
    "p6_report": overlap.p6_report,
    "p7_found": splits.p7_found,
    "p7_splits": splits.p7_splits,
    "p7_report": splits.p7_report,
    "p7_checks": splits.p7_checks,
    "p8_ids": encoding.p8_ids,
    "p8_roundtrip": encoding.p8_roundtrip,
    "p9_found": leaks.p9_found,
    "p9_report": leaks.p9_report,
    "p10_found": splitting.p10_found,
    "p10_pieces": splitting.p10_pieces,
}

_PARTS = """SELECT DISTINCT 'fresh' AS src, doc_id, chunk_idx AS ord, chunk_text AS t FROM self_ai_fresh_chunks WHERE doc_id IS NOT NULL AND chunk_text IS NOT NULL
    UNION ALL SELECT DISTINCT 'units', doc_id, sentence_order, sentence_text FROM sentence_dataset WHERE doc_id IS NOT NULL AND sentence_text IS NOT NULL"""
_GRAM = " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(repetition.RUN))
_TIDY = "nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"

_LINES = "[\\n\\r\\x{0b}\\x{0c}\\x{1c}-\\x{1e}\\x{85}\\x{2028}\\x{2029}]"


def _covered(n: int) -> str:
    """Share of the words that stand in a run of n words that stood before, of p(src, doc_id, w, pos)."""
    gram = " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n))
    return f"""(WITH g AS (SELECT src, doc_id, pos, CASE WHEN lead(w, {n - 1}) OVER o IS NOT NULL THEN {gram} END AS gram FROM p WINDOW o AS (PARTITION BY src, doc_id ORDER BY pos)),
    f AS (SELECT *, min(pos) OVER (PARTITION BY src, doc_id, gram) AS first FROM g WHERE gram IS NOT NULL),
    r AS (SELECT src, doc_id, pos, lead(pos) OVER (PARTITION BY src, doc_id ORDER BY pos) AS nxt FROM f WHERE pos > first)
    SELECT src, doc_id, sum(least(coalesce(nxt - pos, {n}), {n})) AS c FROM r GROUP BY src, doc_id)"""


#: the ledger: shares(source, doc_id, n_words, the rules' measurements, bits)
_LEDGER = f"""parts AS ({_PARTS}),
    cut AS (SELECT *, [x for x in regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}]+')] AS x, count(*) OVER (PARTITION BY src, doc_id) AS k FROM parts),
    w AS (SELECT src, doc_id, ord, t, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM cut),
    p AS (SELECT src, doc_id, w, row_number() OVER (PARTITION BY src, doc_id ORDER BY ord, t, i) AS pos FROM w),
    n AS (SELECT src, doc_id, count(*) AS n FROM p GROUP BY src, doc_id),
    lines AS (SELECT src, doc_id, x FROM cut WHERE k > 1 UNION ALL SELECT src, doc_id, regexp_extract_all(lower(l), '[\\p{{L}}\\p{{M}}]+') FROM (SELECT src, doc_id, unnest(regexp_split_to_array(t, '{_LINES}')) AS l FROM cut WHERE k = 1)),
    again AS (SELECT src, doc_id, sum((c - 1) * len(x)) AS again FROM (SELECT src, doc_id, x, count(*) AS c FROM lines WHERE len(x) > 0 GROUP BY src, doc_id, x) GROUP BY src, doc_id),
    three AS (SELECT src, doc_id, max(c) AS top FROM (SELECT src, doc_id, gram, count(*) AS c FROM (SELECT src, doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM p WINDOW o AS (PARTITION BY src, doc_id ORDER BY pos)) WHERE gram IS NOT NULL GROUP BY src, doc_id, gram) GROUP BY src, doc_id),
    shares AS (SELECT d.src AS source, d.doc_id, coalesce(n, 0) AS n_words, coalesce(a.c / n, 0.0) AS a, coalesce(again / n, 0.0) AS b, CASE WHEN top > 1 THEN top * 3 / n ELSE 0.0 END AS c, coalesce(l.c / n, 0.0) AS d
    FROM (SELECT DISTINCT src, doc_id FROM parts) d LEFT JOIN n USING (src, doc_id) LEFT JOIN {_covered(repetition.RUN)} a USING (src, doc_id) LEFT JOIN again USING (src, doc_id) LEFT JOIN three USING (src, doc_id) LEFT JOIN {_covered(2 * repetition.RUN)} l USING (src, doc_id)),
    ledger AS (SELECT *, CAST((a >= 1 / 3 - 1e-12)::INT + 2 * (b >= 0.3 - 1e-12)::INT + 4 * (c >= 0.1 - 1e-12)::INT + 8 * (d >= 0.2 - 1e-12)::INT AS BIGINT) AS bits FROM shares)"""

ORACLE_SQL: dict[str, str] = {
    # words of a document in order; runs that stood before; the words that such runs cover
    "p4_found": f"""WITH parts AS ({_PARTS}),
    w AS (SELECT src, doc_id, ord, t, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{M}}]+') AS x FROM parts)),
    p AS (SELECT src, doc_id, w, row_number() OVER (PARTITION BY src, doc_id ORDER BY ord, t, i) AS pos FROM w),
    g AS (SELECT src, doc_id, pos, CASE WHEN lead(w, {repetition.RUN - 1}) OVER o IS NOT NULL THEN {_GRAM} END AS gram FROM p WINDOW o AS (PARTITION BY src, doc_id ORDER BY pos)),
    f AS (SELECT *, min(pos) OVER (PARTITION BY src, doc_id, gram) AS first FROM g WHERE gram IS NOT NULL),
    r AS (SELECT src, doc_id, pos, lead(pos) OVER (PARTITION BY src, doc_id ORDER BY pos) AS nxt FROM f WHERE pos > first),
    c AS (SELECT src, doc_id, sum(least(coalesce(nxt - pos, {repetition.RUN}), {repetition.RUN})) AS covered FROM r GROUP BY src, doc_id),
    n AS (SELECT src, doc_id, count(*) AS n FROM p GROUP BY src, doc_id)
    SELECT DISTINCT doc_id FROM c JOIN n USING (src, doc_id) WHERE covered * 3 >= n""",
    # groups reached through common documents, and the splits of all their documents' rows
    "p7_found": f"""WITH RECURSIVE r AS (SELECT DISTINCT doc_id AS d, {_TIDY.format(c='group_id')} AS g, {_TIDY.format(c='split')} AS s FROM sentence_dataset),
    links AS (SELECT DISTINCT a.g AS x, b.g AS y FROM r a JOIN r b ON a.d = b.d WHERE a.g IS NOT NULL AND b.g IS NOT NULL UNION SELECT g, g FROM r WHERE g IS NOT NULL),
    reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    splits AS (SELECT DISTINCT a.g, b.s FROM r a JOIN r b ON a.d = b.d WHERE a.g IS NOT NULL AND b.s IS NOT NULL UNION SELECT g, s FROM r WHERE d IS NULL AND g IS NOT NULL AND s IS NOT NULL)
    SELECT x AS group_id FROM reach JOIN splits ON reach.y = splits.g GROUP BY x HAVING count(DISTINCT s) > 1""",
    # what any assignment must hold to
    "p7_checks": """WITH r AS (SELECT DISTINCT doc_id, group_id, sentence_order, sentence_uid, label, split FROM sentence_dataset WHERE doc_id IS NOT NULL)
    SELECT count(DISTINCT doc_id) AS documents, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (label = 1) AS BIGINT) AS n_ones, CAST(0 AS BIGINT) AS torn, true AS on_target FROM r HAVING count(*) > 0""",
    "p4_shares": f"""WITH {_LEDGER} SELECT source, doc_id, n_words, round(a, 6) AS repeated_run_share, round(b, 6) AS repeated_part_share, round(c, 6) AS top_trigram_share, round(d, 6) AS repeated_long_run_share, bits,
    concat_ws(' ', CASE WHEN bits & 2 > 0 THEN 'parts-v1' END, CASE WHEN bits & 1 > 0 THEN 'run-v1' END, CASE WHEN bits > 0 THEN 'strict-v1' END) AS rejected_by FROM ledger""",
    "p4_ablation": f"""WITH {_LEDGER}, rules(policy, rule, bit, others) AS (VALUES ('parts-v1', 'repeated_part_share', 2, 0), ('run-v1', 'repeated_run_share', 1, 0), ('strict-v1', 'repeated_run_share', 1, 14), ('strict-v1', 'repeated_part_share', 2, 13), ('strict-v1', 'top_trigram_share', 4, 11), ('strict-v1', 'repeated_long_run_share', 8, 7))
    SELECT policy, rule, CAST(count_if(bits & bit > 0) AS BIGINT) AS failed, CAST(count_if(bits & bit > 0 AND bits & others = 0) AS BIGINT) AS failed_alone, CAST(count_if(bits & others > 0) AS BIGINT) AS rejected_without, count(*) AS documents FROM ledger, rules GROUP BY policy, rule""",
}
