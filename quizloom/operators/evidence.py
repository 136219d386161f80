"""Predicates and aggregates shared by the reports.

Optional filters are folded at build time: an absent value adds no predicate, so what
remains can be pushed to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(text: Column) -> Column:
    """Not null and not only blanks."""
    return F.coalesce(F.trim(text), F.lit("")) != ""


def has_correction() -> Column:
    """An option id, an explanation that is not blank, or a payload other than the empty object."""
    payload = F.coalesce(F.regexp_replace("answer_payload", r"\s", ""), F.lit("{}")) != "{}"
    return F.col("correct_option_id").isNotNull() | present(F.col("explanation_text")) | payload


def equal_where_given(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters on the columns whose value is not None."""
    wanted = [F.col(c) == v for c, v in values.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, wanted)) if wanted else df


def live(questions: DataFrame, discarded_too: bool = False) -> DataFrame:
    """Questions that are not discarded, unless all are asked for."""
    return questions if discarded_too else questions.filter("NOT is_discarded")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole rounded to six places, 0.0 for nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(0.0))


def count_of(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def deduplicated_attempts(attempts: DataFrame) -> DataFrame:
    """One row per attempt id: rows delivered twice are equal, so any is kept."""
    return attempts.dropDuplicates(["id"])
