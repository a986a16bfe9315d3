"""A Markdown report of an evaluation, from aggregates of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{x * 100:.1f}%"


def markdown(confusions: DataFrame, auc: DataFrame, cohorts: DataFrame, wrong: DataFrame, notes: dict[str, str] | None = None) -> str:
    """confusions, auc: one row each; cohorts, wrong: as many as there are cohorts and examples."""
    c, a = confusions.first(), auc.first()
    lines = ["# Evaluation", "", f"{a['n']} sentences, {a['n_positive']} of them generated.", "", "| Metric | Value |", "|---|---|"]
    for name in ("precision", "recall", "f1"):
        lines.append(f"| {name} | {c[name]:.3f} |")
    lines += [f"| roc_auc | {'n/a' if a['auc'] is None else format(a['auc'], '.3f')} |", "", f"Confusion: [[{c['tn']}, {c['fp']}], [{c['fn']}, {c['tp']}]]", "", "| Cohort | Sentences | Documents | Flagged |", "|---|---|---|---|"]
    for r in sorted(cohorts.collect(), key=lambda r: r["cohort"]):
        lines.append(f"| {r['cohort']} | {r['n']} | {r['docs']} | {percent(r['flag_rate'])} |")
    for r in wrong.collect():
        lines += ["", f"## {r['doc_id']} ({r['bucket']})", "", f"> {r['preview']}", "", (notes or {}).get(r["doc_id"], "No note yet.")]
    return "\n".join(lines) + "\n"
