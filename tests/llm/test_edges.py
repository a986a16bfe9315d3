"""Every query on empty tables, on tables of nulls, and on messy ones with clashing extra columns."""

import pytest

from sentria.llm.queries import QUERIES
from tests.llm import tables as t

LONG = "word " * 60_000 + "end."
RUN = "a" * 20_000


def messy():
    none = {name: tuple([None] * (schema.count(",") + 1)) for name, schema in t.SCHEMAS.items()}
    fresh = [t.chunk("a", ""), t.chunk("a", ""), t.chunk("b", None), t.chunk("c", "  \n"), t.chunk("d", LONG), t.chunk("e", "One. Two. Three."), t.chunk(None, "My name is {{name}} and I grew up."), t.chunk("f", RUN), none["self_ai_fresh_chunks"]]
    rows = {
        "self_ai_fresh_chunks": fresh + fresh,
        "self_ai_polished_chunks": [t.chunk("p", "A paragraph that", 1, bucket="self_ai_polished"), none["self_ai_polished_chunks"]],
        "generation_jobs": [t.job(1, "a", "Question: why?"), t.job(1, "a", "Question: why?"), t.job(2, "d", None), t.job(3, "p", LONG, 1), none["generation_jobs"]],
        "doc_manifest": [("a", "g", "b", LONG, 1, "train"), ("a", "g", "b", LONG, 1, "train"), ("b", None, None, None, None, None), ("c", "g", "b", "", 0, "test"), ("d", "g", "b", RUN, 1, None), none["doc_manifest"]],
        "sentence_dataset": [t.unit("a", 0, "x " * 30, "G "), t.unit("a", 0, "x " * 30, "G "), t.unit("b", 0, "x " * 30, "g", "TEST"), t.unit("c", 0, None, None, None), t.unit("d", 1, "", "h", "validation"), t.unit(None, 1, "x " * 30, "h", "train"), none["sentence_dataset"]],
        "sentence_features": [t.feature("a", 0, " Train"), t.feature("a", 0, " Train"), t.feature("b", 0, None), none["sentence_features"]],
        "documents": [t.document(1, ""), t.document(2, None), t.document(3, LONG), t.document(4, RUN), t.document(5, " \n\t "), t.document(6, "<|endoftext|>", None), t.document(6, "<|endoftext|>", None), none["documents"]],
        "eval_items": [(1, "b", "en", LONG[:300]), (2, "b", None, None), (3, None, "de", "kurz"), none["eval_items"]],
        "size_limits": [("byte_bpe_50k", 64, 8), none["size_limits"]],
        "split_targets": [("train", 0.8), ("test", 0.2), none["split_targets"]],
    }
    return rows


@pytest.fixture(scope="module")
def bases(spark, tmp_path_factory):
    made = {}
    for name, rows, clashes in (("empty", {}, False), ("nulls", {n: [tuple([None] * (s.count(",") + 1))] for n, s in t.SCHEMAS.items()}, False), ("messy", messy(), True)):
        made[name] = t.write(spark, str(tmp_path_factory.mktemp(name)), rows, clashes)
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["empty", "nulls", "messy"])
def test_runs(spark, bases, name, kind):
    df = QUERIES[name](spark, bases[kind])
    rows = df.collect()
    assert len({str(r) for r in rows}) == len(rows)  # distinct
    if kind == "empty" and name not in ("p7_report", "p4_ablation"):
        assert rows == []
    if name.endswith("_found") and kind == "nulls":
        assert rows == []
