"""Grading and validation of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal, or_default


def mcq(selected: Column, correct: Column) -> Column:
    """STR-05."""
    return F.when(selected == correct, 1.0).otherwise(0.0)


def matches_key(answer: Column, correct: Column, alternatives: Column) -> Column:
    """STR-03: the answer equals the correct one or an alternative after normalising."""
    keys = F.transform(F.concat(F.array(F.coalesce(correct, F.lit(""))), F.coalesce(alternatives, F.array().cast("array<string>"))), normal)
    return F.array_contains(keys, normal(F.coalesce(answer, F.lit(""))))


def fill_blank(answer: Column, correct: Column, alternatives: Column, mode: Column, judged: Column) -> Column:
    """STR-04: 1 for a match; else 0 for code, the judge's 0, 0.5 or 1 for concepts (any other judgement: null)."""
    return F.when(matches_key(answer, correct, alternatives), 1.0).when(mode == "code", 0.0).when(judged.isin(0.0, 0.5, 1.0), judged)


def rubric(hits: Column, points: Column) -> Column:
    """AGG-08, AGG-19: hits over points; an error if there are not as many as points."""
    share = F.size(F.filter(hits, lambda h: h)) / F.size(points)
    return F.when(F.size(hits) == F.size(points), share).otherwise(F.raise_error(F.lit("hits and rubric differ in length")).cast("double"))


def graded(kind: Column, choice: Column, blank: Column, written: Column) -> Column:
    """CND-01: the score by the question's type."""
    return F.when(kind == "mcq", choice).when(kind == "fill_blank", blank).when(kind == "short_answer", written)


def valid_mcq(choices: Column, index: Column) -> Column:
    """FLT-07."""
    return F.coalesce((F.size(choices) >= 2) & (index >= 0) & (index < F.size(choices)), F.lit(False))


def valid_short(prompt: Column, answer: Column, points: Column) -> Column:
    """FLT-08: a prompt, an answer, and two to four rubric points, none of them blank."""
    full = lambda x: F.trim(x) != ""
    return F.coalesce(full(prompt) & full(answer) & F.size(points).between(2, 4) & F.forall(points, full), F.lit(False))


def valid_blank(mode: Column, prompt: Column, answer: Column) -> Column:
    """FLT-09."""
    return F.coalesce(mode.isin("code", "concept") & prompt.contains("___") & (F.trim(answer) != ""), F.lit(False))


def choice_text(kind: Column, choices: Column, index: Column, text: Column) -> Column:
    """PRJ-04: the chosen text of a choice question (null out of bounds), else the text."""
    return F.when(kind == "mcq", F.when((index >= 0) & (index < F.size(choices)), F.get(choices, index))).otherwise(text)


def visible(value: Column, completed: Column, immediate: Column | None = None) -> Column:
    """PRJ-03: a value that shows when the attempt is completed, or at once where feedback is immediate."""
    return F.when(completed if immediate is None else completed | immediate, value)


def staleness(source: Column, checked: Column, remote: Column, indexed: Column) -> Column:
    """PRJ-05: the first rule that holds."""
    return (
        F.when(source == "zip", "unknown:zip_upload").when(checked.isNull(), "unknown:never_checked").when(remote.isNull(), "unknown:unreachable")
        .when(indexed.isNull(), "unknown:not_indexed").when(remote == indexed, "up_to_date").otherwise("stale")
    )


def may_reindex(status: Column, force: Column, source: Column, remote: Column, indexed: Column) -> Column:
    """PRJ-06: 409 while running, 410 for an upload, 409 if nothing changed and not forced, else 202; an unknown remote is allowed."""
    return F.when(~status.isin("ready", "failed"), 409).when(source == "zip", 410).when(~force & F.coalesce(remote == indexed, F.lit(False)), 409).otherwise(202)


def capability(setting: Column, key: Column, runtime: Column) -> Column:
    """PRJ-08: on, or the first reason for off."""
    return F.when(or_default(setting, F.lit("")) == "", "off:not configured").when(or_default(key, F.lit("")) == "", "off:no key").when(~runtime, "off:no runtime").otherwise("on")


def judged_once(score: Column) -> Column:
    """MTH-02: passed from 0.7 on."""
    return F.when(score >= 0.7, "passed").otherwise("failed")
