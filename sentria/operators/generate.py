"""Texts by a generator that the caller hands over: templates, batches, and what is kept of the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.config import CONFIG
from sentria.functions import text as T

#: messages to texts, in the same order
Generator = Callable[[list[str]], list[str]]


def filled(template: str, **slots: Column) -> Column:
    """A template with {name} slots as a column; null where a slot is null. Raises if a slot has no column."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, closed, rest = rest.partition("}")
        if not closed or name not in slots:
            raise ValueError(f"no column for slot {name!r}")
        out += [F.lit(before), slots[name]]
    return F.concat(*out, F.lit(rest))


def word_count(c: Column) -> Column:
    """Words by white space."""
    return F.size(T.tokens(c))


def generated(jobs: DataFrame, make: Callable[[], Generator], message: str = "message", batch: int = CONFIG.batch) -> DataFrame:
    """jobs with the generator's answer and an error: a batch that fails (out of memory, say) has no answers
    but the error's name, and the others go on. ``make`` builds the generator once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = make()
        for b in batches:
            messages = b.column(b.schema.get_field_index(message)).to_pylist()
            answers: list[str | None] = []
            errors: list[str | None] = []
            for i in range(0, len(messages), batch):
                part = messages[i : i + batch]
                try:
                    got = generator(part)
                    if len(got) != len(part):
                        raise ValueError("as many answers as messages are wanted")
                    answers += got
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001  whatever the generator raises
                    answers += [None] * len(part)
                    errors += [type(e).__name__] * len(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "answer", "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in jobs.dtypes) + ", answer string, error string"
    return jobs.mapInArrow(run, schema)


def kept(answers: DataFrame, least: int = CONFIG.essay_words, name: str = "chunk_text") -> DataFrame:
    """Answers, cleaned, of at least ``least`` words."""
    return answers.where("error is null").withColumn(name, T.clean_essay(F.col("answer"))).where(word_count(F.col(name)) >= least).drop("answer", "error")


def with_errors(rows: DataFrame, column: str, function: Callable[[str | None], str | None], out: str = "result") -> DataFrame:
    """rows with function(column), or with the error it raised: a bad row is told and left, never the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[str | None] = []
            errors: list[str | None] = []
            for v in b.column(b.schema.get_field_index(column)).to_pylist():
                try:
                    got.append(function(v))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, out, "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` string, error string"
    return rows.mapInArrow(run, schema)
