"""Schedules kept up to date from a stream of attempts (an extension; batch results are the same).

Each (user, question) keeps its counters as state; attempts of a trigger are taken in the
order of their time and id, later triggers in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quizloom.operators.schedule import RIGHT_BASE, RIGHT_EACH, RIGHT_MOST, RIGHT_STEPS, WRONG_LATER, WRONG_STEPS

OUTPUT = "user_id string, question_id string, state string, due_at timestamp, lapses long, reps long, last_reviewed_at timestamp"


def minutes(correct: bool, lapses: int, reps: int) -> int:
    """Minutes until due, as in the batch operator."""
    if correct:
        return dict(RIGHT_STEPS).get(reps, min(RIGHT_MOST, RIGHT_BASE + RIGHT_EACH * reps) * 1440)
    return next((m for most, m in WRONG_STEPS if lapses <= most), WRONG_LATER)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lapses, reps = state.get if state.exists else (0, 0)
    rows = pd.concat(list(frames)).sort_values(["answered_at", "id"])
    ok, wait, at = False, 0, None
    for at, verdict in zip(rows["answered_at"], rows["is_correct"]):
        ok = bool(verdict) if verdict is not None else False
        wait = minutes(ok, lapses, reps)
        lapses, reps = lapses + (not ok), reps + ok
    state.update((lapses, reps))
    yield pd.DataFrame([(*key, "review" if ok else "relearning", at + pd.Timedelta(minutes=wait), lapses, reps, at)], columns=[f.split()[0] for f in OUTPUT.split(", ")])


def schedule_stream(attempts: DataFrame, delivered_within: str = "2 days") -> DataFrame:
    """A stream of schedule rows, one per touched pair and trigger (output mode update).

    attempts delivered twice within the watermark are dropped by id.
    """
    own = attempts.withWatermark("answered_at", delivered_within).dropDuplicatesWithinWatermark(["id"])
    return own.select("user_id", "question_id", "id", "answered_at", "is_correct").groupBy("user_id", "question_id").applyInPandasWithState(
        _update, OUTPUT, "lapses long, reps long", "update", GroupStateTimeout.NoTimeout
    )


def attempts_by_hour(attempts: DataFrame, late: str = "6 hours") -> DataFrame:
    """Attempts and correct ones in tumbling hours; rows later than the watermark are dropped."""
    from pyspark.sql import functions as F

    own = attempts.withWatermark("answered_at", late).groupBy(F.window("answered_at", "1 hour"))
    return own.agg(F.count("*").alias("attempts"), F.count_if("is_correct").alias("correct")).select("window.start", "attempts", "correct")
