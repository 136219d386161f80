"""Problem 4: one surviving record of each group of duplicates.

Skyline selection. The criteria are trust (not discarded, confidence), completeness
(occurrences counted) and recency (last update). Every batch is first reduced to its own
undominated records, which loses nothing: the skyline of a union is that of the parts'
skylines. So a group that holds a third of all rows reaches its task as a few records. The
lexicographic policy then picks the keeper among the undominated. A field the keeper lacks
comes from the first dominance layer in which a record has it, there from the first in policy
order. A layer is the skyline of what the layers above it leave; the layers are told apart on
the distinct criteria of a group, which one task gets in policy order.

Null fingerprints form no group. Null confidence, counts and dates rank last; a null
is_discarded counts as not discarded. Ties end at the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITERIA = ("kept", "confidence", "occurrences", "updated")


def criteria(questions: DataFrame) -> DataFrame:
    """(fp, id, kept, confidence, occurrences, updated, files): criteria as longs, more is better."""
    names = F.array_distinct(F.array_compact(F.from_json("source_files_json", "array<string>")))
    return questions.filter("dedupe_fingerprint IS NOT NULL").select(
        F.col("dedupe_fingerprint").alias("fp"),
        "id",
        F.when(F.coalesce("is_discarded", F.lit(False)), 0).otherwise(1).cast("long").alias("kept"),
        F.coalesce((F.col("confidence").cast("decimal(20,6)") * 1000000).cast("long"), F.lit(-1)).alias("confidence"),
        F.coalesce(F.col("occurrences_count").cast("long"), F.lit(-1)).alias("occurrences"),
        F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62))).alias("updated"),
        F.coalesce(F.size(names), F.lit(0)).alias("files"),
    )


def undominated(values: np.ndarray) -> np.ndarray:
    """Indices of the Pareto-undominated rows of an array sorted by policy (best first, distinct rows).

    A row can only be dominated by an earlier one, so each is held against the skyline so far.
    """
    kept: list[int] = []
    front = np.empty((0, values.shape[1]), values.dtype)
    for i, row in enumerate(values):
        if len(kept) and (front >= row).all(axis=1).any():
            continue
        kept.append(i)
        front = values[kept]
    return np.array(kept, dtype=np.int64)


def layers(values: np.ndarray) -> np.ndarray:
    """Dominance layer (0: undominated) of each row of an array sorted by policy (best first, distinct rows).

    What a layer dominates, the layers above it dominate too, so a row's layer is found by bisection.
    """
    out = np.zeros(len(values), dtype=np.int64)
    fronts: list[np.ndarray] = []
    sizes: list[int] = []
    for i, row in enumerate(values):
        low, high = 0, len(fronts)
        while low < high:
            mid = (low + high) // 2
            if (fronts[mid][: sizes[mid]] >= row).all(axis=1).any():
                low = mid + 1
            else:
                high = mid
        if low == len(fronts):
            fronts.append(np.empty((4, values.shape[1]), values.dtype))
            sizes.append(0)
        elif sizes[low] == len(fronts[low]):
            fronts[low] = np.concatenate([fronts[low], np.empty_like(fronts[low])])
        fronts[low][sizes[low]] = row
        sizes[low] += 1
        out[i] = low
    return out


def _layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, criteria) come sorted by group and policy; a group's are held until it ends."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        fp = table.column("fp").to_pylist()
        values = np.stack([table.column(c).to_numpy() for c in CRITERIA], axis=1)
        edges = [0, *(i for i in range(1, len(fp)) if fp[i] != fp[i - 1]), len(fp)]
        layer = np.concatenate([layers(values[i:j]) for i, j in zip(edges, edges[1:])])
        yield from table.append_column("layer", pa.array(layer)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        last, own = batch.column(0)[-1].as_py(), batch.column(0).to_pylist()
        cut = len(own)
        while cut and own[cut - 1] == last:
            cut -= 1
        # what is held is one group; it ends here unless the whole batch belongs to it
        if held and (cut or held[-1].column(0)[-1].as_py() != last):
            yield from done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        elif cut:
            yield from done(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield from done(pa.Table.from_batches(held))


def _reduce(table: pa.Table) -> pa.Table:
    """The undominated records of each group of a table, in policy order; of equal ones the smaller id."""
    table = table.sort_by([("fp", "ascending"), *[(c, "descending") for c in CRITERIA], ("id", "ascending")])
    fp = table.column("fp").combine_chunks()
    if isinstance(fp, pa.ChunkedArray):
        fp = pa.concat_arrays(fp.chunks)
    code = fp.dictionary_encode().indices.to_numpy()
    values = np.stack([table.column(c).to_numpy() for c in CRITERIA], axis=1)
    edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    same = np.r_[False, (code[1:] == code[:-1]) & (values[1:] == values[:-1]).all(axis=1)]
    keep = np.zeros(len(code), bool)
    single = np.diff(edges) == 1
    keep[edges[:-1][single]] = True
    for start, stop in zip(edges[:-1][~single], edges[1:][~single]):
        rows = np.flatnonzero(~same[start:stop]) + start
        keep[rows[undominated(values[rows])]] = True
    return table.filter(pa.array(keep))


COLUMNS = ["fp", "id", *CRITERIA]
SCHEMA = "fp string, id string, kept long, confidence long, occurrences long, updated long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _reduce(pa.Table.from_batches([batch])).to_batches()


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group's records are held until it ends."""
    held: pa.Table | None = None

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        out = _reduce(table)
        groups = out.group_by("fp", use_threads=False).aggregate([("id", "first"), ("id", "count")])
        yield pa.RecordBatch.from_arrays([groups.column(c).combine_chunks() for c in ("fp", "id_first", "id_count")], ["fp", "keeper_id", "undominated"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        fp = held.column("fp").to_pylist()
        cut = len(fp)
        while cut and fp[cut - 1] == fp[-1]:
            cut -= 1
        if cut:
            yield from done(held.slice(0, cut))
        # the part of a long group that came so far keeps only its skyline
        held = _reduce(held.slice(cut))
    if held is not None:
        yield from done(held)


def keepers(questions: DataFrame) -> DataFrame:
    """(dedupe_fingerprint, keeper_id, files_from_id, undominated, members) of each fingerprint of two or more."""
    rows = criteria(questions)
    local = rows.select(*COLUMNS).mapInArrow(_local, SCHEMA)
    chosen = local.repartition("fp").sortWithinPartitions("fp").mapInArrow(_final, "fp string, keeper_id string, undominated long")
    files = rows.groupBy("fp").agg(F.count("*").alias("members"), F.min(F.struct((-F.col("files")).alias("few"), "id")).alias("best"))
    both = chosen.join(files.filter("members > 1"), "fp")
    return both.select(F.col("fp").alias("dedupe_fingerprint"), "keeper_id", F.col("best.id").alias("files_from_id"), "undominated", "members")


def found_survivors(questions: DataFrame) -> DataFrame:
    """(dedupe_fingerprint, keeper_id, files_from_id)."""
    return keepers(questions).select("dedupe_fingerprint", "keeper_id", "files_from_id")


#: Fields a survivor takes from the first layer with a record that has them.
FILLED = ("document_id", "section", "question_type", "language", "difficulty", "confidence", "occurrences_count", "page_start", "page_end", "solution_json")


def _policy() -> Column:
    return F.struct((-F.col("kept")).alias("a"), (-F.col("confidence_rank")).alias("b"), (-F.col("occurrences")).alias("c"), (-F.col("updated")).alias("d"), F.col("id").alias("e"))


def survivors(questions: DataFrame) -> DataFrame:
    """One row per fingerprint of two or more: its keeper, and its fields filled downwards through the layers.

    Aggregates combine before the shuffle, so a hot group costs its task one partial row per
    map task; the layers cost it the group's distinct criteria. source_files_json is that of the member with the most distinct names.
    """
    every = criteria(questions)
    distinct = every.select("fp", *CRITERIA).distinct().repartition("fp").sortWithinPartitions("fp", *[F.col(c).desc() for c in CRITERIA])
    layered = distinct.mapInArrow(_layers, "fp string, kept long, confidence long, occurrences long, updated long, layer long")
    ranks = every.join(layered, ["fp", *CRITERIA]).withColumnRenamed("confidence", "confidence_rank").select("id", "kept", "confidence_rank", "occurrences", "updated", "files", "layer")
    rows = questions.filter("dedupe_fingerprint IS NOT NULL").select("id", "dedupe_fingerprint", "source_files_json", *FILLED).join(ranks, "id")
    usable = lambda c: F.when(F.col(c).cast("string").isNotNull() & ~F.trim(F.col(c).cast("string")).isin("", "{}"), F.col(c))
    fill = [F.min(F.when(usable(c).isNotNull(), F.struct("layer", _policy().alias("policy"), usable(c).alias("value"))))["value"].alias(c) for c in FILLED]
    out = rows.groupBy("dedupe_fingerprint").agg(
        F.count("*").alias("members"),
        F.min(_policy())["e"].alias("keeper_id"),
        F.min(F.struct((-F.col("files")).alias("few"), "id", "source_files_json"))["source_files_json"].alias("source_files_json"),
        *fill,
    )
    return out.filter("members > 1")
