"""Spaced repetition from the log of attempts.

The counters before the last attempt are the totals without it, so the state of a (user,
question) pair is one aggregate over its attempts; no row-at-a-time fold and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes until a question is due, by the counters before the attempt.
WRONG_STEPS = ((0, 10), (2, 60))
WRONG_LATER = 1440
RIGHT_STEPS = ((0, 1440), (1, 3 * 1440), (2, 7 * 1440))
RIGHT_MOST, RIGHT_BASE, RIGHT_EACH = 30, 7, 2


def minutes_until_due(correct: Column, lapses: Column, reps: Column) -> Column:
    """Minutes from an attempt to the next one; a null verdict counts as wrong."""
    wrong = F.lit(WRONG_LATER)
    for most, minutes in reversed(WRONG_STEPS):
        wrong = F.when(lapses <= most, minutes).otherwise(wrong)
    right = F.least(F.lit(RIGHT_MOST), RIGHT_BASE + RIGHT_EACH * reps) * 1440
    for exactly, minutes in reversed(RIGHT_STEPS):
        right = F.when(reps == exactly, minutes).otherwise(right)
    return F.when(F.coalesce(correct, F.lit(False)), right).otherwise(wrong)


def schedule_state(attempts: DataFrame) -> DataFrame:
    """(user_id, question_id, state, due_at, lapses, reps, last_reviewed_at); attempts at one time go by id."""
    correct = F.coalesce("is_correct", F.lit(False))
    total = attempts.groupBy("user_id", "question_id").agg(
        F.count_if(~correct).alias("lapses"), F.count_if(correct).alias("reps"), F.max(F.struct("answered_at", "id", correct.alias("ok"))).alias("last")
    )
    ok = F.col("last.ok")
    before_l, before_r = F.col("lapses") - F.when(ok, 0).otherwise(1), F.col("reps") - F.when(ok, 1).otherwise(0)
    due = F.col("last.answered_at") + F.make_dt_interval(mins=minutes_until_due(ok, before_l, before_r).cast("int"))
    return total.select("user_id", "question_id", F.when(ok, "review").otherwise("relearning").alias("state"), due.alias("due_at"), "lapses", "reps", F.col("last.answered_at").alias("last_reviewed_at"))


SQL_STATE = """
SELECT user_id, question_id, CASE WHEN ok THEN 'review' ELSE 'relearning' END AS state,
  answered_at + to_minutes((CASE WHEN ok THEN CASE reps - 1 WHEN 0 THEN 1440 WHEN 1 THEN 4320 WHEN 2 THEN 10080 ELSE least(30, 7 + 2 * (reps - 1)) * 1440 END
    ELSE CASE WHEN lapses - 1 = 0 THEN 10 WHEN lapses - 1 < 3 THEN 60 ELSE 1440 END END)::BIGINT) AS due_at, lapses, reps, answered_at AS last_reviewed_at
FROM (SELECT user_id, question_id, answered_at, coalesce(is_correct, false) AS ok,
    count(*) FILTER (WHERE NOT coalesce(is_correct, false)) OVER (PARTITION BY user_id, question_id) AS lapses, count(*) FILTER (WHERE coalesce(is_correct, false)) OVER (PARTITION BY user_id, question_id) AS reps,
    row_number() OVER (PARTITION BY user_id, question_id ORDER BY answered_at DESC, id DESC) AS k FROM (SELECT DISTINCT ON (id) * FROM attempts)) WHERE k = 1"""
