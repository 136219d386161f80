"""Merging duplicates: the survivor of each fingerprint and what its children become.

The survivor is found with a min over an ordering struct, and every resolution of children
is an associative aggregate, so partial results combine before the shuffle and a group that
holds a third of all rows is never brought into one task. "First non-empty in order" is a
min over (order, value) of the non-empty values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import text as X

#: The survivor's score: confidence plus a bonus for long stems.
BONUS, BONUS_LENGTH = 0.5, 2000.0


def order_of_survival() -> Column:
    """Not discarded first, then higher score, then smaller id (nulls: not discarded, confidence 0)."""
    score = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) + F.least(F.lit(BONUS), F.length(X.clean_text(F.col("stem"))) / BONUS_LENGTH)
    return F.struct(F.coalesce("is_discarded", F.lit(False)).alias("discarded"), (-F.round(score, 9)).alias("score"), F.col("id").alias("id"))


def keeper_map(questions: DataFrame) -> DataFrame:
    """(question_id, keeper_id, rank): each question's survivor; rank 0 is the survivor itself, else its order.

    Ids, fingerprints and ranks are kept, so that the texts are read and hashed once for both sides of the join.
    """
    ranked = questions.select("id", "fingerprint", order_of_survival().alias("rank")).persist()
    best = ranked.groupBy("fingerprint").agg(F.min("rank")["id"].alias("keeper_id"))
    return ranked.join(best, "fingerprint").select(F.col("id").alias("question_id"), "keeper_id", "rank")


def first_filled(value: Column, filled: Column) -> Column:
    """The value of the first row in rank order whose value is filled."""
    return F.min(F.when(filled, F.struct(F.col("rank").alias("r"), value.alias("v"))))["v"]


def repointed(children: DataFrame, keepers: DataFrame) -> DataFrame:
    """Children with their question replaced by its survivor; their rank stays for resolutions by order."""
    return children.join(keepers, "question_id").drop("question_id").withColumnRenamed("keeper_id", "question_id")


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], resolve: dict[str, Column]) -> DataFrame:
    """The next version of a table: full outer join on the keys, each column resolved from old.<c> and new.<c>.

    Both sides must be unique on the keys; columns without a rule keep old, else new.
    """
    columns = [c for c in existing.columns if c not in keys]
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    both = existing.alias("old").join(incoming.alias("new"), on, "full_outer")
    out = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys]
    return both.select(*out, *[resolve.get(c, F.coalesce(f"old.{c}", f"new.{c}")).alias(c) for c in columns])
