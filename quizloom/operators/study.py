"""The next question of every user: a cascade of tiers, without crossing users and questions.

The first unseen question of a user is the first gap in the positions the user has seen.
Positions are given by a range-partitioned sort: each partition numbers its own rows, and
only the partitions' sizes are summed up in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.operators import evidence as E

_INNER = 1 << 33  # monotonically_increasing_id: the partition above, the row below


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with pos, 1 for the first in order; ties have to be broken by the order itself."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_m", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    own = placed.withColumn("_part", F.shiftright("_m", 33)).join(F.broadcast(starts), "_part")
    return own.withColumn("pos", F.col("_start") + F.col("_m").bitwiseAND(_INNER - 1) + 1).drop("_m", "_part", "_start")


def first_unseen(seen: DataFrame, at: DataFrame) -> DataFrame:
    """(user_id, new_id): the first question of at (question_id, pos) that a user of seen (user_id, question_id) lacks, or null."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("pos"))
    own = seen.join(at, "question_id").select("user_id", "pos", k.alias("k"))
    gap = own.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("pos") != F.col("k"), F.col("k"))), F.max("k") + 1).cast("long").alias("pos"))
    users = seen.select("user_id").distinct().join(gap, "user_id", "left").withColumn("pos", F.coalesce("pos", F.lit(1).cast("long")))
    return users.join(at.select(F.col("question_id").alias("new_id"), "pos"), "pos", "left").select("user_id", "new_id")


def next_questions(state: DataFrame, questions: DataFrame, now: Column, prefer_new: bool = False, seed: str | None = None) -> DataFrame:
    """(user_id, question_id, reason) of every user of state (user_id, question_id, due_at).

    Tiers: new first if preferred, then the most overdue, the first unseen, the earliest scheduled; "none" if nothing is
    left. Due ones that need no review come first at one time. Unseen ones come by section and number, or, given a seed,
    in the order of a seeded hash. Discarded questions take no part.
    """
    live = E.live(questions).select("id", "section", "number_in_section", "needs_review")
    order = ["section", "number_in_section", "id"] if seed is None else [F.md5(F.concat("id", F.lit(seed))), F.col("id")]
    at = positions(live, *order).select(F.col("id").alias("question_id"), "pos", "needs_review")
    own = state.select("user_id", "question_id", "due_at").join(at.select("question_id", "needs_review"), "question_id")
    best = F.struct("due_at", F.coalesce("needs_review", F.lit(False)).alias("review"), "question_id")
    picked = own.groupBy("user_id").agg(F.min(F.when(F.col("due_at") <= now, best))["question_id"].alias("due_id"), F.min(best)["question_id"].alias("later_id"))
    out = first_unseen(state.select("user_id", "question_id"), at.select("question_id", "pos")).join(picked, "user_id", "left")
    tiers = [("new", "new_id"), ("due", "due_id")] if prefer_new else [("due", "due_id"), ("new", "new_id")]
    tiers.append(("scheduled", "later_id"))
    reason = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in tiers], F.lit("none"))
    return out.select("user_id", F.coalesce(*[F.col(c) for _, c in tiers]).alias("question_id"), reason.alias("reason"))


def shown(state: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """The state with a row 'new', due now, for each chosen (user_id, question_id) of reason new; rows already there stay as they are."""
    new = chosen.filter("reason = 'new'").select("user_id", "question_id").join(state.select("user_id", "question_id"), ["user_id", "question_id"], "left_anti")
    return state.select("user_id", "question_id", "due_at", "state").union(new.select("user_id", "question_id", now.alias("due_at"), F.lit("new").alias("state")))


def interleaved(buckets: DataFrame, seed: str) -> DataFrame:
    """(id, bucket, round) of all rows (id, bucket): round n holds the n-th of each bucket in the order of a seeded hash.

    A bucket of any size is numbered by positions, so that none is brought into one task.
    """
    at = positions(buckets, F.col("bucket"), F.md5(F.concat("id", F.lit(seed))), F.col("id"))
    starts = at.groupBy("bucket").agg(F.min("pos").alias("_first"))
    return at.join(starts, "bucket").select("id", "bucket", (F.col("pos") - F.col("_first") + 1).alias("round"))
