"""Running user-supplied annotators over documents, one round after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CONTENT_BUDGET, fit_content, render_prompt, strip_reasoning

Annotator = Callable[[pd.Series], pd.Series]


@dataclass
class Round:
    """A named prompt with ``{field}`` places. Fields are the document's columns and the answers
    of earlier rounds, under their round's name."""

    name: str
    prompt: str


@dataclass
class Template:
    name: str
    rounds: list[Round]
    status: str = "TESTING"
    file: str = ""
    inputs: list[str] = field(default_factory=lambda: ["content", "title", "url", "source", "published"])


def _ask(prompts: DataFrame, annotator: Annotator) -> DataFrame:
    """Add ``response`` and ``error`` for the ``prompt`` column, batch by batch.

    A failing batch is tried row by row, so one bad document costs only its own answer.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers, errors = list(annotator(pdf["prompt"])), [None] * len(pdf)
            except Exception:  # noqa: BLE001
                answers, errors = [], []
                for prompt in pdf["prompt"]:
                    try:
                        answers.append(annotator(pd.Series([prompt])).iloc[0])
                        errors.append(None)
                    except Exception as exc:  # noqa: BLE001
                        answers.append(f"ERROR: {exc}")
                        errors.append(str(exc))
            yield pdf.assign(response=answers, error=errors)

    return prompts.mapInPandas(run, schema)


def annotate(documents: DataFrame, template: Template, annotator: Annotator, separator: str = "\n\n") -> DataFrame:
    """Documents with ``rounds`` (array of name, prompt, response, error) of one template.

    The prompt is rendered by Spark; only the prompt and the document's own columns pass through
    the Python worker.
    """
    out = documents.withColumn("article_content", fit_content(F.coalesce("content", F.lit("")), CONTENT_BUDGET, separator))
    answers: list[Column] = []
    for r in template.rounds:
        values = {c: F.col(c) for c in out.columns if c != "content"}
        values["content"] = F.col("article_content")
        asked = _ask(out.withColumn("prompt", render_prompt(r.prompt, values)), annotator)
        prompt_col, error_col = f"_prompt_{r.name}", f"_error_{r.name}"
        out = asked.withColumn("response", strip_reasoning(F.col("response"))).withColumnsRenamed(
            {"response": r.name, "prompt": prompt_col, "error": error_col}
        )
        answers.append(
            F.struct(
                F.lit(r.name).alias("name"), F.col(prompt_col).alias("prompt"), F.col(r.name).alias("response"),
                F.col(error_col).alias("error"),
            )
        )
    return out.select(
        *documents.columns, F.lit(template.name).alias("template_name"), F.lit(template.status).alias("template_status"),
        F.array(*answers).alias("rounds"),
    ).withColumn("analysis_id", F.concat_ws("_", F.col("doc_id").cast("string"), "template_name"))


def annotate_all(documents: DataFrame, templates: list[Template], annotator: Annotator, separator: str = "\n\n") -> DataFrame:
    """Every document with every template."""
    out = None
    for t in templates:
        one = annotate(documents, t, annotator, separator)
        out = one if out is None else out.unionByName(one)
    return out


def trial(documents: DataFrame, doc_id, template: Template, annotator: Annotator) -> DataFrame:
    """One document, one template."""
    return annotate(documents.where(F.col("doc_id") == doc_id), template, annotator)
