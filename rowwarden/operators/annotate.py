"""The tool's own columns on a delivery row: participant number, verdict, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowwarden import fixed
from rowwarden.functions import text as tx
from rowwarden.operators.spread import block_of, running_offset


def participant_numbers(rows: DataFrame, position: str = "merged_row") -> DataFrame:
    """Set ``participant_sequence``: participants numbered in order of first appearance; NULL without a name.

    The distinct participants are numbered, not the rows.
    """
    key = F.coalesce(tx.normalize_name(F.col("folder_name")), tx.normalize_name(F.col("participant_name")))
    keyed = rows.drop("participant_sequence").withColumns({"_key": key, "_salt": block_of(F.col(position))})
    parts = keyed.filter(F.col("_key").isNotNull()).groupBy("_key", "_salt").agg(F.min(position).alias("_first"))
    firsts = parts.groupBy("_key").agg(F.min("_first").alias("_first")).withColumn("_n", F.lit(1))
    numbers = running_offset(firsts, "_first", "_n", "_before").select(
        "_key", (F.col("_before") + 1).cast("int").alias("participant_sequence")
    )
    salted = parts.select("_key", "_salt").join(numbers, "_key")
    return keyed.join(salted, ["_key", "_salt"], "left").drop("_key", "_salt")


def _finding_text(issue: Column) -> Column:
    return F.when(issue.message != "", F.concat(issue.rule, F.lit(": "), issue.message)).otherwise(issue.rule)


def row_verdicts(plan: DataFrame) -> DataFrame:
    """Set qa_result and comments from the row's ``issues`` and ``problems``, both already on the row."""
    issues = F.col("issues")
    problems = F.col("problems") if "problems" in plan.columns else F.array().cast("array<string>")

    def has(severity: str) -> Column:
        return F.exists(issues, lambda i: i.severity == severity)

    verdict = (
        F.when(has("error"), fixed.VERDICT_ERROR)
        .when(has("review") | (F.size(problems) > 0), fixed.VERDICT_REVIEW)
        .when(F.size(issues) > 0, fixed.VERDICT_FIXED)
        .otherwise(fixed.VERDICT_OK)
    )
    comments = F.array_join(F.concat(F.transform(issues, _finding_text), problems), " | ")
    return plan.withColumns({"qa_result": verdict, "comments": tx.null_if_empty(comments)})


def attach_issue_rows(rows: DataFrame, issues: DataFrame, position: str = "merged_row") -> DataFrame:
    """Bring a separate issue table onto its rows as ``issues``; issues about files as a whole belong to no row."""
    kept = ["severity", "rule", "message"]
    order = [c for c in ("phase", "rule_seq") if c in issues.columns]
    bound = issues.filter(F.col(position).isNotNull()).groupBy(position).agg(
        F.array_sort(F.collect_list(F.struct(*order, *kept))).alias("issues")
    )
    empty = F.array().cast(bound.schema["issues"].dataType)
    return rows.drop("issues").join(bound, position, "left").withColumn("issues", F.coalesce("issues", empty))


def annotate(plan: DataFrame, position: str = "merged_row") -> DataFrame:
    return participant_numbers(row_verdicts(plan), position)
