"""Problem 9: a mix in which every source has its target share of all tokens.

Poisson replication. A document's number of copies inverts the Poisson distribution at a
uniform number seeded by a hash of its id, cut at the source's most repeats; the mean is
the source's target repetition rate. Since the cut lowers the mean and a drawn sample
strays from it, the mean is calibrated: a table of tokens by source and slice of the
uniform numbers (of fixed size) gives the tokens drawn at any mean, and bisection finds the
mean whose draw meets the target. Copies are exploded and ordered by a hash: a global shuffle.

The size of the mix is the largest at which no source needs more than its most repeats, or
the one asked for. Null and unknown sources, and sources without target or without
tokens, give no documents; null and empty texts have no tokens and are left out. Repeated
doc_ids are drawn alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.encode import token_counts

SEED = 17
#: Slices of the uniform numbers in the table the calibration reads.
SLICES = 8192


@dataclass(frozen=True)
class Plan:
    """What the driver decides, one row per source: means of the draw and tokens wanted."""

    source: list[str]
    mean: list[float]
    cap: list[int]
    wanted: list[float]
    target: list[float]


def cut_points(mean: float, cap: int) -> list[float]:
    """Cumulative Poisson probabilities of 0 .. cap-1: u at or above the k-th gives more than k copies."""
    p = math.exp(-mean)
    total, out = p, []
    for k in range(cap):
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
        total += p
    return out


def drawn(mean: float, cap: int, slices: np.ndarray) -> float:
    """Tokens drawn at a mean, from tokens by slice (each slice counts as evenly filled)."""
    ends = np.concatenate([[0.0], np.cumsum(slices)])
    above = [ends[-1] - np.interp(c * len(slices), np.arange(len(slices) + 1), ends) for c in cut_points(mean, cap)]
    return float(sum(above))


def calibrated(wanted: float, cap: int, slices: np.ndarray) -> float:
    """The mean at which the draw gives the wanted tokens (a mean of 700 gives every cap in practice)."""
    low, high = 0.0, 700.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn(mid, cap, slices) < wanted else (low, mid)
    return high


def uniform(seed: int = SEED):  # noqa: ANN201
    """A number in [0, 1) seeded by the document's id."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, u) of the documents that have tokens; texts are encoded where they are read."""
    joined = documents.filter("source IS NOT NULL AND text <> ''").select(F.struct("doc_id", "source").alias("key"), "text")
    return token_counts(joined, "key", "text").select("key.doc_id", "key.source", "n_tokens").withColumn("u", uniform())


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> Plan:
    """Calibrated means. Reads one aggregated table of (sources x SLICES) rows at most."""
    goals = {r.source: (r.target_share, r.max_repeats) for r in targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats").toLocalIterator()}
    known = F.broadcast(targets.select("source").distinct())  # one row per source: the plan's own size
    table = sizes.join(known, "source", "left_semi").groupBy("source", F.floor(F.col("u") * SLICES).cast("int").alias("slice")).agg(F.sum("n_tokens").alias("tokens")).toArrow()
    slices: dict[str, np.ndarray] = {}
    for source, at, tokens in zip(table.column("source").to_pylist(), table.column("slice").to_pylist(), table.column("tokens").to_pylist()):
        slices.setdefault(source, np.zeros(SLICES))[at] += tokens
    usable = {s: g for s, g in goals.items() if s in slices}
    most = min((g[1] * slices[s].sum() / g[0] for s, g in usable.items()), default=0.0)
    total = most if total_tokens is None else min(total_tokens, most)
    source = sorted(usable)
    wanted = [usable[s][0] * total for s in source]
    return Plan(source, [calibrated(w, usable[s][1], slices[s]) for s, w in zip(source, wanted)], [usable[s][1] for s in source], wanted, [usable[s][0] for s in source])


def _copies(plan: Plan):  # noqa: ANN202
    """Column: copies of a row, by its source and u."""
    column = F.lit(0)
    for source, mean, cap in zip(plan.source, plan.mean, plan.cap):
        points = F.array(*[F.lit(c) for c in cut_points(mean, cap)])
        column = F.when(F.col("source") == source, F.size(F.filter(points, lambda c: c <= F.col("u")))).otherwise(column)
    return column


def drawn_sizes(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[DataFrame, Plan]:
    """(doc_id, source, n_tokens, copies) of the documents, and the plan."""
    sizes = sized(documents).persist()
    plan = plan_mix(sizes, targets, total_tokens)
    return sizes.withColumn("copies", _copies(plan)).drop("u"), plan


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens, mix_order): one row per copy, in a random global order.

    mix_order is a hash; the table is range-partitioned and sorted by it.
    """
    rows, _ = drawn_sizes(documents, targets, total_tokens)
    copies = rows.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), "copies")))
    order = F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))
    return copies.select("doc_id", "copy_no", "source", "n_tokens", order.alias("mix_order")).repartitionByRange("mix_order").sortWithinPartitions("mix_order")


def reached_shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, most_copies, tokens, reached_share): one row per target."""
    rows, _ = drawn_sizes(documents, targets, total_tokens)
    per = rows.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("tokens")
    )
    both = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").na.fill(0, ["documents", "copies", "most_copies", "tokens"])
    whole = both.agg(F.sum("tokens").alias("all_tokens"))
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens").cast("double")), F.lit(0.0))
    return both.join(F.broadcast(whole)).withColumn("reached_share", share).drop("all_tokens")
