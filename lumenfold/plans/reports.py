"""Prompt rows and reports.

The prompts are our own wording. Their numbers, and the report's headings, are
fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.fixed import PESTLE_FACETS, PESTLE_TITLES
from lumenfold.functions.text import bulletise
from lumenfold.operators.models import complete

# --- fixed values: (facet, template) with the sampling numbers of each stage --
SWOT_SEED_NUMBERS = (300, 0.4, 0.0, 0.0)
PESTLE_SEED_NUMBERS = (300, 0.7, 0.0, 0.0)
SWOT_SUMMARY_NUMBERS = (800, 0.3, 0.3, 0.3)
PESTLE_SUMMARY_NUMBERS = (550, 0.3, 0.3, 0.3)
NUMBER_COLUMNS = [
    "max_tokens",
    "temperature",
    "frequency_penalty",
    "presence_penalty",
]

SWOT_SEEDS = {
    "positive": "Describe in one rich paragraph what speaks for {subject}.",
    "negative": "Describe in one rich paragraph what speaks against {subject}.",
}
PESTLE_SEED = (
    "Describe in one rich paragraph how {subject} helps and harms this area: {facet}."
)
SWOT_SUMMARY = (
    "Evidence in favour: {positive}\nEvidence against: {negative}\n"
    "From this evidence, draw up a thorough SWOT review of {subject}. "
    "Begin with the strengths, one dash per point."
)
PESTLE_SUMMARY = (
    "Evidence: {evidence}\nFrom this evidence, name the 3-4 weightiest "
    "consequences of {subject} in this area: {facet}. One dash per point."
)


def _fill(template: str, **values: Column) -> Column:
    """The template with its placeholders replaced once: what a value holds stays as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def _numbers(numbers: tuple) -> list[Column]:
    return [F.lit(v).alias(c) for v, c in zip(numbers, NUMBER_COLUMNS)]


def seed_prompts(subjects: DataFrame) -> DataFrame:
    """The eight seed prompts of every subject: one row per (subject, facet)."""
    templates = [
        ("swot_seed", f, t, *SWOT_SEED_NUMBERS) for f, t in SWOT_SEEDS.items()
    ] + [("pestle_seed", f, PESTLE_SEED, *PESTLE_SEED_NUMBERS) for f in PESTLE_FACETS]
    rows = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(facet).alias("facet"),
                _fill(t, subject=F.col("subject"), facet=F.lit(facet)).alias("prompt"),
                *_numbers(numbers),
            )
            for stage, facet, t, *numbers in templates
        ]
    )
    return subjects.select("subject", F.inline(rows))


def swot_prompt(evidence: DataFrame, subject: str) -> DataFrame:
    """Both evidence lists → one summary prompt. ``evidence``: (facet, evidence)."""

    def listed(facet: str) -> Column:
        return F.coalesce(
            F.max(F.when(F.col("facet") == facet, F.to_json("evidence"))), F.lit("[]")
        ).alias(facet)

    return evidence.agg(listed("positive"), listed("negative")).select(
        F.lit(subject).alias("subject"),
        F.lit("swot_summary").alias("stage"),
        F.lit("all").alias("facet"),
        _fill(
            SWOT_SUMMARY,
            subject=F.lit(subject),
            positive=F.col("positive"),
            negative=F.col("negative"),
        ).alias("prompt"),
        *_numbers(SWOT_SUMMARY_NUMBERS),
    )


def pestle_prompts(evidence: DataFrame, subject: str) -> DataFrame:
    """One summary prompt per facet."""
    return evidence.select(
        F.lit(subject).alias("subject"),
        F.lit("pestle_summary").alias("stage"),
        "facet",
        _fill(
            PESTLE_SUMMARY,
            subject=F.lit(subject),
            facet=F.col("facet"),
            evidence=F.to_json("evidence"),
        ).alias("prompt"),
        *_numbers(PESTLE_SUMMARY_NUMBERS),
    )


def build_prompts(swot: DataFrame, pestle: DataFrame, subject: str) -> DataFrame:
    return swot_prompt(swot, subject).unionByName(pestle_prompts(pestle, subject))


def assemble_report(completed: DataFrame) -> DataFrame:
    """Completed summary prompts → (subject, stage, report).

    Dashes start new lines; sections stand in the order of the facets.
    """
    order = F.array_position(F.array(*[F.lit(f) for f in PESTLE_FACETS]), F.col("facet"))
    title = F.element_at(
        F.create_map(*[F.lit(x) for pair in PESTLE_TITLES.items() for x in pair]),
        F.col("facet"),
    )
    points = bulletise("completion")
    section = F.when(
        F.col("stage") == "swot_summary", F.concat(F.lit("Strengths: "), points)
    ).otherwise(F.concat(title, F.lit(":\n"), points))
    sections = F.array_sort(
        F.collect_list(F.struct(order.alias("o"), section.alias("section")))
    )
    return completed.groupBy("subject", "stage").agg(
        F.array_join(F.transform(sections, lambda s: s["section"]), "\n\n").alias(
            "report"
        )
    )


def report(prompts: DataFrame, fn: Callable) -> DataFrame:
    return assemble_report(complete(prompts, fn))
