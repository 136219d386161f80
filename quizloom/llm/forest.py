"""Problem 5: new batches held against all history by a prefix-tree hash forest.

The signature of a set of words has HASHES min-wise digests; each of TREES permutations of it
gives a label, its first DEPTH digests in order. The labels of accepted sets lie in a shared
folder as runs: Parquet files sorted by label (the tree comes first in it). A batch is located
by prefix: begin and end of the prefix are a range of a sorted run. For a batch of few labels
the ranges go to the scan, which skips the row groups without any; a larger one touches all
row groups anyway, and the runs are read through a bitmap of the prefixes asked for. The
search begins with whole labels; for records without an earlier verified partner yet shorter
prefixes follow, until the recall promised for a pair right at the threshold,
1 - (1 - t^d)^TREES, reaches the target. Candidates are verified exactly on their sorted
word arrays. A batch's own labels become another run; many runs are merged into one.

In a kept folder the word arrays, the places and the bank's residue are kept with the runs: a
later batch takes its partners from there, and an unchanged bank is asked for its ids only. If
the bank has changed, only its new rows are hashed; which of its rows are residue depends on
all of its stems, so that is then judged anew. A batch given twice changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.residue import template_residue
from quizloom.llm.tiles import THRESHOLD, bounded_pairs, verify_pairs
from quizloom.llm.words import unpack_all, word_sets
from quizloom.sources.tables import use_checkpoint_dir

TREES, DEPTH, DIGEST = 32, 8, 7
#: Digests of a signature; every one is in so many labels as HASHES goes into TREES * DEPTH.
HASHES = 128
#: Digests by which prefixes get shorter from one search to the next.
WIDER = 2
#: Bits of the bitmap of a batch's prefixes, which thins the runs before any shuffle: 8 MB.
BITS = 26
RECALL = 0.98
#: Labels of a batch up to which their ranges go to the scan, and runs from which on a kept forest is merged.
RANGES, MOST_RUNS = 256, 8
#: A label: the tree in the bits above, then DEPTH digests of DIGEST bits.
LABEL_BITS = DEPTH * DIGEST


def depths(threshold: float = THRESHOLD, target: float = RECALL) -> list[int]:
    """Prefix lengths to search, longest first, down to the first that reaches the recall target."""
    out = []
    for d in range(DEPTH, 0, -WIDER):
        out.append(d)
        if 1 - (1 - threshold**d) ** TREES >= target:
            break
    return out


def permutations() -> np.ndarray:
    """(TREES, DEPTH): the digests of each tree's label. Each digest comes as often as any other, in different company."""
    rng = np.random.default_rng(7)
    return np.concatenate([rng.permutation(HASHES) for _ in range(TREES * DEPTH // HASHES)]).reshape(TREES, DEPTH)


def labels(words: np.ndarray, starts: np.ndarray, at_once: int = 8) -> np.ndarray:
    """Labels (rows x TREES) of sets given as one array of words; no set may be empty."""
    n = len(starts) - 1
    with np.errstate(over="ignore"):
        seeds = (np.arange(1, HASHES // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        least = np.empty((n, HASHES), dtype=np.uint16)
        for i in range(0, n, at_once):
            j = min(i + at_once, n)
            x = words[starts[i] : starts[j], None] * seeds
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            least[i:j] = np.minimum.reduceat(x.view(np.uint16), starts[i:j] - starts[i], axis=0)  # four hashes of 16 bits from one of 64
        digest = (least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIGEST)
    out = np.empty((n, TREES), dtype=np.uint64)
    for t, own in enumerate(permutations()):
        label = np.full(n, t, dtype=np.uint64)
        for d in own:
            label = (label << np.uint64(DIGEST)) | digest[:, d]
        out[:, t] = label
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, (h, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if n and h not in seen:
                seen.add(h)
                fresh.append(i)
        if fresh:
            batch = batch.take(pa.array(fresh))
            words, starts = unpack_all(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(labels(words, starts).view(np.int64).ravel()), pa.array(np.repeat(ids, TREES))], ["label", "set_hash"])


def entries(sets: DataFrame) -> DataFrame:
    """(label, set_hash), TREES rows per different set of a task; empty sets have none."""
    return sets.select("set_hash", "n_words", "words").mapInArrow(_entries, "label long, set_hash long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each batch as one sorted block a tree: its least and greatest label, the labels and the hashes."""
    for batch in _entries(batches):
        label, owner = batch.column(0).to_numpy().reshape(-1, TREES), batch.column(1).to_numpy().reshape(-1, TREES)
        order = np.argsort(label, axis=0)
        label, owner = np.take_along_axis(label, order, axis=0).T, np.take_along_axis(owner, order, axis=0).T
        blocks = [pa.array([np.ascontiguousarray(x).tobytes() for x in own], pa.binary()) for own in (label, owner)]
        yield pa.RecordBatch.from_arrays([pa.array(label[:, 0]), pa.array(label[:, -1]), *blocks], ["low", "high", "labels", "hashes"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(labels, hashes) of each block."""
    for label, owner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
        yield np.frombuffer(label, dtype=np.uint64), np.frombuffer(owner, dtype=np.int64)


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, owner in _unpacked(batch):
            yield pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), pa.array(owner)], ["label", "set_hash"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries as blocks."""
    for batch in batches:
        if batch.num_rows:
            label, owner = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(label[:1]), pa.array(label[-1:]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (label, owner))], ["low", "high", "labels", "hashes"])


class HashForest:
    """Runs of sorted labels in a folder that all executors share: rows are sorted blocks with their least and greatest label."""

    schema = "low long, high long, labels binary, hashes binary"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def append(self, sets: DataFrame) -> None:
        """Adds the labels of sets as a run: each task sorts its own, nothing is shuffled."""
        self._write(sets.select("set_hash", "n_words", "words").mapInArrow(_blocks, self.schema).sortWithinPartitions("low"))

    def _write(self, run: DataFrame) -> None:
        run.write.option("compression", "zstd").parquet(f"{self.folder}/run-{uuid.uuid4()}")

    def _files(self) -> tuple[object, list]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files, [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []

    def merge(self, into: str, files: int | None = None) -> HashForest:
        """Merges all runs into one, range-partitioned and sorted, in another folder; an entry comes once."""
        every, merged = self.runs().dropDuplicates(["label", "set_hash"]), HashForest(self.spark, into)
        ranged = every.repartitionByRange(files, "label") if files else every.repartitionByRange("label")
        merged._write(ranged.sortWithinPartitions("label").mapInArrow(_packed, self.schema))
        return merged

    def compact(self) -> None:
        """Merges the runs in place if there are more than MOST_RUNS. The old ones go after the new one is whole: entries that are there twice meanwhile change nothing."""
        system, old = self._files()
        if len(old) > MOST_RUNS:
            self.merge(self.folder)
            for path in old:
                system.delete(path, True)

    def remove(self) -> None:
        """Deletes the folder with all runs."""
        system, _ = self._files()
        system.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder), True)

    def blocks(self) -> DataFrame:
        paths = [p.toString() for p in self._files()[1]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def runs(self) -> DataFrame:
        """(label, set_hash) of all runs."""
        return self.blocks().mapInArrow(_loose, "label long, set_hash long")

    def candidates(self, asked: DataFrame, depth: int) -> DataFrame:
        """(a, b): set hashes of asked (label, set_hash) with each set of the runs that shares a prefix."""
        shift = (DEPTH - depth) * DIGEST
        own = asked.select(F.shiftrightunsigned("label", shift).alias("prefix"), F.col("set_hash").alias("a"))
        few, blocks = own.select("prefix").limit(RANGES + 1).collect(), self.blocks()
        if len(few) <= RANGES:  # a block is read only if a range asked for meets its own
            near = [(F.col("high") >= x) & (F.col("low") < x + (1 << shift)) for x in sorted({r.prefix << shift for r in few})]
            blocks = blocks.filter(reduce(or_, near, F.lit(False)))
        wanted = self.spark.sparkContext.broadcast(_prefix_bits(own))

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(wanted.value, dtype=np.uint8)
            for label, owner in (x for batch in batches for x in _unpacked(batch)):
                prefix = label >> np.uint64(shift)
                slot = _slot(prefix)
                hit = np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(prefix[hit].view(np.int64)), pa.array(owner[hit])], ["prefix", "b"])

        there = blocks.mapInArrow(thinned, "prefix long, b long")
        return own.join(there, "prefix").filter("a <> b").select("a", "b").distinct()

    def search(self, asked: DataFrame, arrays: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
        """(a, b): all verified partners in the runs of the sets asked for, at the recall target; arrays holds the words of both sides."""
        pairs = bounded_pairs(self.candidates(entries(asked).persist(), depths(threshold, target)[-1]), arrays, threshold).select("a", "b").persist()
        return verify_pairs(pairs, arrays, threshold).checkpoint()

    def earliest(self, asked: DataFrame, arrays: DataFrame, first: DataFrame, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
        """(a, linked): of each set asked for that has a verified partner before it, that one's place; first (set_hash, first) gives the places.

        The partner of the least place with the fewest differing bits is verified first; it
        settles most sets. Of the others all further candidates are verified.
        """
        places = first.withColumnRenamed("set_hash", "b")
        before = first.select(F.col("set_hash").alias("a"), F.col("first").alias("own"))
        waiting, found = entries(asked).persist(), None
        for d in depths(threshold, target):
            # only partners that come before a set tell that it repeats something
            pairs = bounded_pairs(self.candidates(waiting, d), arrays, threshold).join(places, "b").join(before, "a").filter("first < own").persist()
            best = pairs.groupBy("a").agg(F.min(F.struct("first", "differ", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.first").alias("linked")).persist()
            settled = best.join(verify_pairs(best.select("a", "b"), arrays, threshold), ["a", "b"], "left_semi").select("a", "linked").checkpoint()
            others = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").join(settled.select("a"), "a", "left_anti").persist()
            later = others.join(verify_pairs(others.select("a", "b"), arrays, threshold), ["a", "b"], "left_semi").groupBy("a").agg(F.min("first").alias("linked"))
            links = settled.union(later).checkpoint()
            found = links if found is None else found.union(links)
            waiting = waiting.join(links.select(F.col("a").alias("set_hash")), "set_hash", "left_anti").checkpoint()
            for used in (pairs, best, others):
                used.unpersist()
        return found


def _slot(prefix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (prefix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _prefix_bits(own: DataFrame) -> bytes:
    """Bitmap of the prefixes asked for: every task gives the bytes it sets, they are united by byte."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        for batch in batches:
            slot = _slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
        at = np.flatnonzero(bits)
        for part in np.array_split(at, max(1, len(at) // 200_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(bits[part].astype(np.int32))], ["byte", "bits"])

    table = own.select("prefix").mapInArrow(each, "byte int, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    bitmap[table.column("byte").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return bitmap.tobytes()


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of a kept folder; without rows before it is first written."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _add_bank(spark: SparkSession, folder: str, forest: HashForest, bank: DataFrame, columns: list[str]) -> None:
    """Brings the kept folder up to the bank: hashes rows not seen yet (or with another updated_at), forgets rows that are gone.

    Rows are noted as seen after all else is written: a run that broke off is repeated.
    """
    seen = "id string, version string, set_hash long"
    version = F.coalesce(F.col("updated_at").cast("string"), F.lit("")) if "updated_at" in bank.columns else F.lit("")
    state = bank.select(F.col("id").cast("string").alias("id"), version.alias("version")).persist()
    kept = _kept(spark, f"{folder}/bank", seen)
    fresh = state.join(kept, ["id", "version"], "left_anti").persist()
    valid = kept.join(state, ["id", "version"], "left_semi").checkpoint()
    is_fresh, is_gone = not fresh.isEmpty(), valid.count() < kept.count()
    if is_fresh:
        sets = word_sets(bank.join(fresh.select("id"), "id", "left_semi").select("id", *columns), "id").persist()
        forest.append(sets)
        sets.select("set_hash", "words").write.mode("append").parquet(f"{folder}/sets")
    if is_fresh or is_gone:
        template_residue(bank).write.mode("overwrite").parquet(f"{folder}/residue")
    if is_gone:
        valid.write.mode("overwrite").parquet(f"{folder}/bank")
    if is_fresh:
        sets.join(fresh, "id").select("id", "version", "set_hash").write.mode("append").parquet(f"{folder}/bank")


def _add_batch(spark: SparkSession, folder: str, bank: DataFrame, new: DataFrame, columns: list[str]) -> tuple[HashForest, DataFrame, DataFrame]:
    """The kept forest with the bank and a batch in it, the arrays of all its sets, and the earliest place of each."""
    forest = HashForest(spark, f"{folder}/labels")
    _add_bank(spark, folder, forest, bank, columns)
    forest.append(new)
    forest.compact()
    new.select("set_hash", "words").write.mode("append").parquet(f"{folder}/sets")
    new.groupBy("set_hash").agg(F.min("raw_id").alias("first")).write.mode("append").parquet(f"{folder}/incoming")
    residue = _kept(spark, f"{folder}/residue", "question_id string")
    accepted = _kept(spark, f"{folder}/bank", "id string, version string, set_hash long").join(residue, F.col("id") == F.col("question_id"), "left_anti")
    earlier = _kept(spark, f"{folder}/incoming", "set_hash long, first long")
    first = _places(earlier, accepted).checkpoint()
    return forest, _kept(spark, f"{folder}/sets", "set_hash long, words binary"), first


def _places(incoming: DataFrame, accepted: DataFrame) -> DataFrame:
    """(set_hash, first): the earliest place of each set, before all records if the bank has it."""
    every = incoming.select("set_hash", "first").union(accepted.select("set_hash", F.lit(-(1 << 62)).alias("first")).distinct())
    return every.groupBy("set_hash").agg(F.min("first").alias("first"))


def repeated_records(incoming: DataFrame, bank: DataFrame, folder: str | None = None, threshold: float = THRESHOLD, target: float = RECALL) -> DataFrame:
    """(raw_id) of incoming records that repeat a bank question or an incoming record of a smaller raw_id.

    Template residue of the bank takes no part; an incoming record without any word repeats
    only another such. folder: where the forest is kept from batch to batch; incoming is then
    the next batch alone, and is held against all earlier ones too. Without a folder a forest
    is built in the shared checkpoint folder for this call.
    """
    spark = incoming.sparkSession
    home = use_checkpoint_dir(spark)
    columns = ["stem", "options_json", "subparts_json"]
    new = word_sets(incoming.select("raw_id", *columns), "raw_id").persist()
    if folder is not None:
        forest, arrays, first = _add_batch(spark, folder, bank, new, columns)
    else:
        known = word_sets(bank.select("id", *columns), "id").persist()
        residue = template_residue(bank)
        accepted = known.select("id", "set_hash").join(residue, F.col("id") == F.col("question_id"), "left_anti")
        forest = HashForest(spark, f"{home}/forest-{uuid.uuid4()}")
        forest.append(known)
        forest.append(new)
        arrays = known.select("set_hash", "words").union(new.select("set_hash", "words"))
        first = _places(new.groupBy("set_hash").agg(F.min("raw_id").alias("first")), accepted).checkpoint()
    # records that repeat a bank row word by word need no search
    asked = new.select("set_hash", "n_words", "words").join(first.filter(F.col("first") > -(1 << 62)), "set_hash", "left_semi")
    earliest = forest.earliest(asked, arrays, first, threshold, target)
    if folder is None:  # what was found is checkpointed: the runs are of no more use
        forest.remove()
    rows = new.select("raw_id", "set_hash").join(first, "set_hash").join(earliest.withColumnRenamed("a", "set_hash"), "set_hash", "left")
    return rows.filter((F.col("first") < F.col("raw_id")) | (F.col("linked") < F.col("raw_id"))).select("raw_id")
