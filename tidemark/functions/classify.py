"""Ordered keyword rules over posting text: labels, entry-level score, role classification."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.bind import with_computed
from tidemark.functions.text import fold_case
from tidemark.rules import Rule

_SCRATCH = ("_full", "_title", "_pos", "_neg", "_non", "_exp", "_role", "_labels")


def match_labels(rule_list: Sequence[Rule], folded: str) -> Column:
    """Labels of the rules found, in rule order, in the column `folded`: a text through `fold_case`.

    The words a rule needs are looked for first with a plain substring test, so the regular
    expression runs only on texts that can match. Folded texts need no case-insensitive matching,
    which is slow; only a rule that is itself written with capitals is matched that way. Written
    as SQL text: the hundred conditions would each cost many calls into the JVM otherwise.
    """

    def label_if_found(rule: Rule) -> str:
        capitals = re.search("[A-Z]", re.sub(r"\\.", "", rule.regex))
        tests = [f"contains({folded}, {_literal(w)})" for w in rule.required_words()]
        tests.append(f"{folded} RLIKE {_literal(('(?iU)' if capitals else '(?U)') + rule.regex)}")
        return f"CASE WHEN {' AND '.join(tests)} THEN {_literal(rule.label)} END"

    return F.expr(f"array_compact(array({', '.join(map(label_if_found, rule_list))}))")


def _literal(value: str) -> str:
    """A SQL string; raw, as patterns are full of backslashes, unless it holds both quotes."""
    for quote in ('"', "'"):
        if quote not in value:
            return f"r{quote}{value}{quote}"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def combined_text(title: Column, level: Column, description: Column) -> Column:
    """Title, then level and description where not blank, one per line."""
    optional = [F.when(c != "", c) for c in (level, description)]
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), *optional)


def _with_texts(df: DataFrame, title: str, description: str, level: str) -> DataFrame:
    return with_computed(
        df,
        _full=fold_case(combined_text(F.col(title), F.col(level), F.col(description))),
        _title=fold_case(F.coalesce(F.col(title), F.lit(""))),
    )


def _entry_labels(positive: Sequence[Rule], negative: Sequence[Rule]) -> dict[str, Column]:
    return {"_pos": match_labels(positive, "_full"), "_neg": match_labels(negative, "_full")}


def _with_role(
    df: DataFrame, software: Sequence[Rule], explicit: Sequence[Rule], non_software: Sequence[Rule], **also: Column
) -> DataFrame:
    """Adds `_non` and `_labels`: the title decides, the full text is read only where it is silent."""
    titled = with_computed(
        df,
        _non=match_labels(non_software, "_title"),
        _exp=match_labels(explicit, "_title"),
        _role=match_labels(software, "_title"),
        **also,
    )
    return with_computed(
        titled,
        _labels=F.when(_vetoed(), F.array().cast("array<string>"))
        .when(F.size("_role") > 0, F.col("_role"))
        .otherwise(match_labels(software, "_full")),
    )


def _vetoed() -> Column:
    return (F.size("_non") > 0) & (F.size("_exp") == 0)


def with_entry_score(
    df: DataFrame,
    into: str = "entry",
    title: str = "title",
    description: str = "description_text",
    level: str = "level",
    positive: Sequence[Rule] = rules.ENTRY_POSITIVE,
    negative: Sequence[Rule] = rules.ENTRY_NEGATIVE,
    positive_weight: float = rules.POSITIVE_WEIGHT,
    negative_weight: float = rules.NEGATIVE_WEIGHT,
    threshold: float = rules.ENTRY_THRESHOLD,
) -> DataFrame:
    """Adds a struct(score, is_entry_level, matched_positive, matched_negative)."""
    labelled = with_computed(_with_texts(df, title, description, level), **_entry_labels(positive, negative))
    score = F.size("_pos") * positive_weight - F.size("_neg") * negative_weight
    entry = F.struct(
        score.alias("score"),
        (score > threshold).alias("is_entry_level"),
        F.col("_pos").alias("matched_positive"),
        F.col("_neg").alias("matched_negative"),
    )
    return labelled.withColumn(into, entry).drop(*_SCRATCH)


def with_software_role(
    df: DataFrame,
    into: str = "role",
    title: str = "title",
    description: str = "description_text",
    level: str = "level",
    software: Sequence[Rule] = rules.SOFTWARE,
    explicit: Sequence[Rule] = rules.EXPLICIT_SOFTWARE_TITLE,
    non_software: Sequence[Rule] = rules.NON_SOFTWARE,
) -> DataFrame:
    """Adds a struct(is_software, software_matched, non_software_matched, reason)."""
    labelled = _with_role(_with_texts(df, title, description, level), software, explicit, non_software)
    role = F.struct(
        (F.size("_labels") > 0).alias("is_software"),
        F.col("_labels").alias("software_matched"),
        F.col("_non").alias("non_software_matched"),
        F.when(_vetoed(), F.lit(rules.NON_SOFTWARE_TITLE))
        .when(F.size("_labels") == 0, F.lit(rules.NO_SOFTWARE))
        .alias("reason"),
    )
    return labelled.withColumn(into, role).drop(*_SCRATCH)


def with_job_class(
    df: DataFrame,
    into: str = "verdict",
    title: str = "title",
    description: str = "description_text",
    level: str = "level",
    positive: Sequence[Rule] = rules.ENTRY_POSITIVE,
    negative: Sequence[Rule] = rules.ENTRY_NEGATIVE,
    software: Sequence[Rule] = rules.SOFTWARE,
    explicit: Sequence[Rule] = rules.EXPLICIT_SOFTWARE_TITLE,
    non_software: Sequence[Rule] = rules.NON_SOFTWARE,
) -> DataFrame:
    """Adds a struct of role and level flags, matched labels, score, reason and digest eligibility.

    A non-software title is vetoed unless it names a software role outright; otherwise the title
    decides, and the full text is searched only when the title says nothing.
    """
    labelled = _with_role(
        _with_texts(df, title, description, level),
        software,
        explicit,
        non_software,
        **_entry_labels(positive, negative),
    )
    is_software = F.size("_labels") > 0
    score = F.size("_pos") * rules.POSITIVE_WEIGHT - F.size("_neg") * rules.NEGATIVE_WEIGHT
    is_entry = score > rules.ENTRY_THRESHOLD
    verdict = F.struct(
        is_software.alias("is_software_engineering_related"),
        is_entry.alias("is_entry_level"),
        F.col("_labels").alias("software_matched"),
        F.col("_non").alias("non_software_matched"),
        F.col("_pos").alias("entry_level_matched"),
        F.col("_neg").alias("entry_level_negative_matched"),
        score.alias("entry_level_score"),
        F.when(_vetoed(), F.lit(rules.NON_SOFTWARE_TITLE))
        .when(~is_software, F.lit(rules.NO_SOFTWARE))
        .when(~is_entry, F.lit(rules.NOT_ENTRY_LEVEL))
        .alias("rejection_reason"),
        (is_software & is_entry).alias("is_digest_eligible"),
    )
    return labelled.withColumn(into, verdict).drop(*_SCRATCH)
