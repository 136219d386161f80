"""Problem 3: near-duplicate questions, grouped, for a bank of any size.

Exact copies (equal word sets) are folded first. The rest meet in size-banded tiles: the
rows that share one of their rarest units, ordered by size, so that a row is compared only
with rows of the sizes it can be similar to. A unit is a rare word, or the words that a set
has of one cluster of common words: words of one phrase come together, and counted one by
one they would give as many tiles of the same rows. A hashed bitmap of 256 bits bounds the
overlap from above (no more words can be shared than the differing bits leave); only pairs
that pass are intersected exactly on their sorted arrays.

Every step is exact, whatever the clusters: of two similar sets' units in one order, the
words before the first of which they share a word are in one of them only, so at most
n - ceil(t n) of a set of n words. A tile of more than SPLIT_TILE rows is split by the next
shared unit, before which again at most so many words in all may be missed, and so on until
the tiles are small. The task that holds a tile does so for all of its rows alike; a row
brings the units that follow. Only tiles expected to hold more than HOT_TILE rows are split
before they are shuffled; which are depends on the units alone, so both sets of a pair do
the same.

The rows of a task's tiles travel as one packed block a bucket of tiles, so that the shuffle
handles few long rows; a bucket holds some megabytes, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.components import component_labels
from quizloom.llm.residue import template_residue
from quizloom.llm.words import LOW48, unpack_all, word_sets

THRESHOLD = 0.7
#: A word is common if so many of the sets hold it; the table of common words that every
#: task gets then has at most (words per set) / COMMON_SHARE rows, whatever the data's size.
COMMON_SHARE = 0.001
#: Words of so many sets are common in any case.
COMMON_SETS = 20_000
#: Entries of the table of common words at most (36 MB); up to some 280 million questions it holds every word of COMMON_SETS sets.
TABLE = 1_000_000
#: Sets by which common words are clustered (twice as many at most), the most frequent words that are (16 MB of pair counts),
#: the share of the sets with either word that must hold both, and the words of a cluster at most.
CLUSTER_SETS, CLUSTER_WORDS, TOGETHER, WIDEST = 4096, 2048, 0.7, 255
#: Tiles expected to hold more rows than this (some 100 bytes each) are split before the shuffle, up to DEEPEST units.
HOT_TILE, DEEPEST = 1_000_000, 4
#: Tiles of more rows than this are split where they are compared, by up to FURTHER units, so many rows at once.
SPLIT_TILE, FURTHER, AT_ONCE = 1000, 4, 1 << 18
#: Bytes of tile rows a bucket is to hold.
BUCKET = 8 << 20
#: Rows compared at once with the rows of a large tile, and the length of such a row.
BLOCK, WIDE = 64, 512
#: Bits of the bitmap that says which sets have candidates: 2 MB whatever the data's size.
BITS = 24


def needed_overlap(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Words that sets of n and m words must share for a Jaccard similarity of the threshold."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words seen at least twice in a partition; those of once can't be common."""
    parts = [unpack_all(b.column(0))[0] for b in batches if b.num_rows]
    words, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
    seen = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(words[seen].astype(np.int64)), pa.array(counts[seen].astype(np.int64))], ["word", "n"])


class Common:
    """The common words: sorted, each with the rank of its cluster and the share of all sets that holds a word of that."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, sample: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """sample: words and starts of the sets by which words are clustered; without it each is a cluster of its own."""
        order = np.argsort(words)
        self.words, self.total = words[order], total
        alone = counts[order] / max(total, 1)
        cluster = np.arange(len(words)) if sample is None else _clusters(self.words, alone, *sample)
        # a cluster is in no fewer sets than its most frequent word, and by the sample in somewhat more
        share, held = np.zeros(cluster.max(initial=-1) + 1), np.bincount(cluster, alone)
        np.maximum.at(share, cluster, alone)
        # many words and few sets first: those use up soonest what may be missed
        ranks = np.empty(len(share), np.int64)
        ranks[np.lexsort((np.arange(len(share)), share * share / np.maximum(held, 1e-12)))] = np.arange(len(share))
        self.ranks, self.share = ranks[cluster], share[cluster]


def _clusters(words: np.ndarray, share: np.ndarray, sample: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A cluster number for each word: words that come together with a more frequent one in the sampled sets join it."""
    top = np.sort(np.argsort(-share, kind="stable")[:CLUSTER_WORDS])
    at = np.minimum(np.searchsorted(words[top], sample), max(len(top) - 1, 0))
    known = words[top][at] == sample if len(top) else np.zeros(len(sample), bool)
    held = np.zeros((len(starts) - 1, len(top)), np.float32)
    held[np.repeat(np.arange(len(starts) - 1), np.diff(starts))[known], at[known]] = 1
    both = held.T @ held
    alone = np.diag(both).copy()
    cluster = np.arange(len(words))
    free = alone > 1
    for i in np.argsort(-alone, kind="stable"):
        if free[i]:
            own = np.flatnonzero(free & (both[i] >= TOGETHER * (alone[i] + alone - both[i])))[:WIDEST]
            cluster[top[own]] = top[i]
            free[own] = False
            free[i] = False
    return np.unique(cluster, return_inverse=True)[1]


def common_words(sets: DataFrame, total: int) -> Common:
    """Words of at least COMMON_SHARE of the sets or of COMMON_SETS sets, at most TABLE, in clusters."""
    counts = sets.select("words").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    least = max(8, min(int(total * COMMON_SHARE), COMMON_SETS))
    table = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(TABLE).toArrow()
    # the clusters only say which tiles there are: any give the same pairs, so they are judged by some sets
    some = sets.filter(F.pmod("set_hash", F.lit(max(total // CLUSTER_SETS, 1))) == 0).select("set_hash", "words").dropDuplicates(["set_hash"]).orderBy("set_hash")
    sample = unpack_all(pa.chunked_array([*some.limit(2 * CLUSTER_SETS).toArrow().column("words").chunks, pa.array([b""])]))
    return Common(table.column("word").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.int64), total, sample)


SIGNATURE = ("s0", "s1", "s2", "s3")


def _signatures(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit bitmaps of each row's words: word w turns bit w mod 256 of the 256.

    Two sets' bitmaps differ in no more bits than the sets differ in words; turning bits
    rather than setting them keeps large sets apart.
    """
    bits = np.uint64(1) << (words & np.uint64(63))
    quarter = (words >> np.uint64(6)) & np.uint64(3)
    zero = np.uint64(0)
    out = []
    for q in range(4):
        own = np.append(np.where(quarter == q, bits, zero), zero)
        sig = np.bitwise_xor.reduceat(own, starts[:-1]) if len(starts) > 1 else np.zeros(0, np.uint64)
        sig[starts[:-1] == starts[1:]] = 0
        out.append(sig.astype(np.uint64))
    return out


#: A row of a tile: the set, its size, the words missed before the tile's last unit, the words in its units, how many units follow, its bitmap.
ROW = np.dtype([("tile", "<u8"), ("id", "<i8"), ("n", "<i4"), ("place", "<i4"), ("got", "<i4"), ("follow", "<i4"), ("signature", "<u8", (4,))])
#: A unit that follows: bits of its name, and its words.
UNIT = np.dtype([("name", "<u2"), ("words", "u1")])
MIX = np.uint64(0x9E3779B97F4A7C15)


class Held(NamedTuple):
    """Of each tile row: words missed, words in its units, first and last (exclusive) unit that follow; and of each unit its name and words."""

    place: np.ndarray
    got: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    units: np.ndarray


def _step(key: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The key of a tile split by a further unit; those of common units have their upper bits set, which hashes of words do not use."""
    with np.errstate(over="ignore"):
        return (key * MIX ^ name) * MIX | ~LOW48


def _further(begin: np.ndarray, end: np.ndarray, spare: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, unit) of all next shared units: those before which no more than the spare words are missed. before: words before each unit."""
    reach = np.minimum(np.searchsorted(before, before[begin] + spare, side="right"), end)
    many = np.maximum(reach - begin, 0)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row = np.repeat(np.arange(len(begin)), many)
    return row, begin[row] + step


def tile_keys(words: np.ndarray, starts: np.ndarray, common: Common, threshold: float, hot: int) -> tuple[np.ndarray, np.ndarray, Held]:
    """(key, row, what it holds) of each tile of each set; words come in any order within their set."""
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    known = common.words
    at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    is_common = known[at] == words if len(known) else np.zeros(len(words), bool)
    # rare words first, by hash as they come, then the clusters of common ones by rank: one key of row and place
    within = words >> np.uint64(1)
    share = np.zeros(len(words))
    if len(known):
        within = np.where(is_common, np.uint64(1 << 47) | common.ranks[at].astype(np.uint64), within)
        share = np.where(is_common, common.share[at], 0.0)
    order = np.argsort((row.astype(np.uint64) << np.uint64(48)) | within, kind="stable")
    name = np.where(is_common, within, words)[order]
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (row[1:] != row[:-1])][: len(name)])
    name, share, own = name[first], share[order][first], row[first]  # by unit from here
    weight = np.diff(np.r_[first, len(words)])
    before = np.r_[first, len(words)]
    is_common = share > 0
    units = np.empty(len(name), UNIT)
    with np.errstate(over="ignore"):
        units["name"], units["words"] = (name * MIX) >> np.uint64(48), weight
    most = np.zeros(len(sizes), np.int64)
    np.maximum.at(most, own, weight)
    spare = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64)  # words that may be missed
    last_unit = np.searchsorted(own, np.arange(len(sizes)), side="right")
    place = first - starts[own]
    last = np.flatnonzero(place <= spare[own])
    place, got, expected = place[last], weight[last], share[last] * common.total
    key = np.where(is_common[last], _step(np.zeros(len(last), np.uint64), name[last]), name[last])
    keys, lasts, places, gots = [], [], [], []
    for depth in range(1, DEEPEST + 1):
        # a set with so many words in its units may share no further one: its tile stays, and is split besides
        done = (expected <= hot) | (depth == DEEPEST) | (got >= sizes[own[last]] - spare[own[last]])
        split = (expected > hot) & (depth < DEEPEST)
        for all_of, x in ((keys, key), (lasts, last), (places, place), (gots, got)):
            all_of.append(x[done])
        if not split.any():
            break
        key, last, place, got, expected = key[split], last[split], place[split], got[split], expected[split]
        was, unit = _further(last + 1, last_unit[own[last]], spare[own[last]] - place, before)
        place, got = place[was] + before[unit] - before[last[was] + 1], got[was] + weight[unit]
        key, expected, last = _step(key[was], name[unit]), expected[was] * share[unit], unit
    keys, last, place, got = (np.concatenate(x) for x in (keys, lasts, places, gots))
    own = own[last]
    # all units that may be reached in FURTHER steps, of which all but the last may skip the heaviest
    end = np.searchsorted(before, before[last + 1] + spare[own] - place + (FURTHER - 1) * most[own], side="right")
    end = np.where(keys > LOW48, np.minimum(end, last_unit[own]), last + 1)
    return keys, own, Held(place, got, last + 1, end, units)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return ((x * MIX) >> np.uint64(33)).astype(np.int64) % buckets


def tile_blocks(common: Common, threshold: float, hot: int, buckets: int):  # noqa: ANN201
    """Arrow function: the rows of each set in each of its tiles, packed by bucket; copies met in one task give rows once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (b.slice(i, 1 << 15) for b in batches for i in range(0, b.num_rows, 1 << 15)):
            fresh = []
            for i, x in enumerate(batch.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            words, starts = unpack_all(batch.column(1))
            keys, own, held = tile_keys(words, starts, common, threshold, hot)
            bucket = _bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            own, bucket = own[order], bucket[order]
            rows = np.empty(len(keys), ROW)
            rows["tile"], rows["place"], rows["got"] = keys[order], held.place[order], held.got[order]
            rows["follow"] = many = (held.end - held.begin)[order]
            ends = np.r_[0, np.cumsum(many)]
            units = held.units[np.repeat(held.begin[order] - ends[:-1], many) + np.arange(ends[-1])]
            rows["id"], rows["n"] = batch.column(0).to_numpy(zero_copy_only=False)[own], np.diff(starts)[own]
            rows["signature"] = np.stack(_signatures(words, starts), axis=1)[own]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
            blocks = [rows[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])]
            follow = [units[i:j].tobytes() for i, j in zip(ends[edges[:-1]], ends[edges[1:]])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(blocks, pa.binary()), pa.array(follow, pa.binary())], ["bucket", "block", "units"])

    return each


def _passing(x: np.ndarray, y: np.ndarray, n: np.ndarray, place: np.ndarray, signature: list[np.ndarray], threshold: float) -> np.ndarray:
    """Pairs of rows whose sizes, places and bitmaps allow the needed overlap (row y is not smaller)."""
    need = needed_overlap(n[x], n[y], threshold)
    differ = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in signature)
    return (n[x] >= threshold * n[y] - 1e-9) & (differ <= n[x] + n[y] - 2 * need) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need)


def _compare(key: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, signature: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole tiles; the rows are sorted by tile and size."""
    left, right = [], []
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    length = np.diff(edges)
    small = np.repeat(length <= BLOCK, length)
    rows = np.flatnonzero(small)
    end = np.repeat(edges[1:], length)
    for shift in range(1, int(length[length <= BLOCK].max(initial=1))):
        rows = rows[rows + shift < end[rows]]
        if not len(rows):
            break
        j = rows + shift
        ok = _passing(rows, j, n, place, signature, threshold)
        left.append(ids[rows[ok]])
        right.append(ids[j[ok]])
    # in a large tile the smaller set has the word within n - overlap(n, n) + 1 places
    lead = place < n - needed_overlap(n, n, threshold) + 1
    share = (1 - threshold) / (1 + threshold)
    # and both have it at places that leave room for sets of up to this size
    room = np.floor((1 + threshold) / threshold * (n - place) + 1e-9) - n
    for start, stop in zip(edges[:-1][length > BLOCK], edges[1:][length > BLOCK]):
        leads = np.flatnonzero(lead[start:stop]) + start
        for o in range(0, len(leads), BLOCK):
            own = leads[o : o + BLOCK]
            least, most = n[own[0]], n[own[-1]]
            top = start + int(np.searchsorted(n[start:stop], min(most / threshold + 1e-9, room[own].max()), side="right"))
            rest = np.flatnonzero(room[own[0] : top] >= least) + own[0]
            mine, theirs = [s[own][:, None] for s in signature], [s[rest] for s in signature]
            for j in range(0, len(rest), WIDE):
                wide = rest[j : j + WIDE]
                limit = np.uint8(min(255, int(share * (most + n[wide[-1]]) + 1e-9)))
                differ = np.bitwise_count(mine[0] ^ theirs[0][j : j + WIDE])
                differ += np.bitwise_count(mine[1] ^ theirs[1][j : j + WIDE])
                hit = np.flatnonzero(differ <= limit)
                if len(hit) > differ.size // 32:  # large sets fill half a bitmap: look at all of it at once
                    for a, b in zip(mine[2:], theirs[2:]):
                        differ += np.bitwise_count(a ^ b[j : j + WIDE])
                    hit = np.flatnonzero(differ <= limit)
                if not len(hit):
                    continue
                x, y = own[hit // len(wide)], wide[hit % len(wide)]
                x, y = x[x < y], y[x < y]
                ok = _passing(x, y, n, place, signature, threshold)
                left.append(ids[x[ok]])
                right.append(ids[y[ok]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = a[a != b], b[a != b]  # copies of a set that came from different tasks
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _sorted_by(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The order by lower 48 bits of the key, then size."""
    if n.max(initial=0) >> 16:
        return np.lexsort((n, key & LOW48))
    return np.argsort((key << np.uint64(16)) | n.astype(np.uint64))


class Bucket:
    """The rows of whole tiles and the units that follow each."""

    def __init__(self, rows: np.ndarray, units: np.ndarray, threshold: float, split: int) -> None:
        self.rows, self.threshold, self.split = rows, threshold, split
        self.name, self.before = units["name"], np.r_[0, np.cumsum(units["words"], dtype=np.int64)]
        self.end = np.cumsum(rows["follow"], dtype=np.int64)
        self.n = rows["n"].astype(np.int64)
        self.least = np.ceil(threshold * self.n - 1e-9).astype(np.int64)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs, some more than once."""
        rare = self.rows["tile"] <= LOW48
        for own, split in ((np.flatnonzero(rare), False), (np.flatnonzero(~rare), True)):
            key, begin = self.rows["tile"][own], (self.end - self.rows["follow"])[own]
            yield from self._met(own, key, begin, self.rows["place"][own].astype(np.int64), self.rows["got"][own].astype(np.int64), FURTHER if split else 0)

    def _compared(self, own: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        signature = self.rows["signature"][own]
        return _compare(key, self.rows["id"][own], self.n[own], place, [np.ascontiguousarray(signature[:, i]) for i in range(4)], self.threshold)

    def _met(self, own: np.ndarray, key: np.ndarray, begin: np.ndarray, place: np.ndarray, got: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of whole tiles: small ones are compared, the others split by the next unit, some tiles at a time."""
        order = _sorted_by(key, self.n[own])
        own, key, begin, place, got = own[order], key[order], begin[order], place[order], got[order]
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        length = np.diff(edges)
        large = np.repeat((length > self.split) & (steps > 0), length)
        here = np.flatnonzero((~large | (got >= self.least[own])) & np.repeat(length > 1, length))
        # a tile of which some rows share no further unit is compared by those, and split besides
        for i, j in self._parts(key[here]):
            yield self._compared(own[here[i:j]], key[here[i:j]], place[here[i:j]])
        deep = np.flatnonzero(large)
        for i, j in self._parts(key[deep]):
            part = deep[i:j]
            x = own[part]
            row, unit = _further(begin[part], self.end[x], self.n[x] - self.least[x] - place[part], self.before)
            row, skipped = part[row], self.before[unit] - self.before[begin[part[row]]]
            words = self.before[unit + 1] - self.before[unit]
            yield from self._met(own[row], _step(key[row], self.name[unit].astype(np.uint64)), unit + 1, place[row] + skipped, got[row] + words, steps - 1)

    @staticmethod
    def _parts(key: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bounds of runs of whole tiles, of some AT_ONCE rows."""
        edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
        begin = 0
        while begin < len(key):
            end = int(edges[np.searchsorted(edges, min(begin + AT_ONCE, len(key)))])
            yield begin, end
            begin = end


def _tile_pairs(threshold: float, split: int):  # noqa: ANN202
    """Arrow function over blocks sorted by bucket: candidate pairs. A bucket is held whole."""

    def pairs(blocks: list[bytes], units: list[bytes]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(np.frombuffer(b"".join(blocks), ROW), np.frombuffer(b"".join(units), UNIT), threshold, split)
        blocks.clear()
        units.clear()
        for a, b in bucket.pairs():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        units: list[bytes] = []
        now = None
        for batch in batches:
            for bucket, block, follow in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:
                    yield from pairs(held, units)
                now = bucket
                held.append(block)
                units.append(follow)
        if held:
            yield from pairs(held, units)

    return each


def _verified(threshold: float):  # noqa: ANN202
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (wa, sa), (wb, sb) = unpack_all(batch.column(2)), unpack_all(batch.column(3))
            na, nb = np.diff(sa), np.diff(sb)
            # words tagged with their pair: the ones that then occur twice are shared
            pair = np.arange(batch.num_rows, dtype=np.int64)
            owner = np.concatenate([np.repeat(pair, na), np.repeat(pair, nb)])
            words = np.concatenate([wa, wb])
            order = np.lexsort((words, owner))
            words, owner = words[order], owner[order]
            twice = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
            shared = np.bincount(owner[1:][twice], minlength=batch.num_rows)
            keep = pa.array((shared >= needed_overlap(na, nb, threshold)) & (na + nb > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return each


def _bitmap(pairs: DataFrame) -> bytes:
    """The set hashes of the pairs, as a bitmap of fixed size."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).select(F.expr(f"cast(x & {(1 << BITS) - 1} as int)").alias("slot"))
    table = ends.groupBy(F.expr("slot >> 3").alias("byte")).agg(F.bit_or(F.expr("cast(shiftleft(1, slot & 7) as int)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    bitmap[table.column("byte").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return bitmap.tobytes()


def _asked(wanted: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose set hash has its bit set, once per task."""
    bits, seen = np.frombuffer(wanted, dtype=np.uint8), set()
    for batch in batches:
        x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << BITS) - 1)
        hit = np.flatnonzero((bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1)
        fresh = []
        for i, value in zip(hit.tolist(), batch.column(0).take(pa.array(hit)).to_pylist()):
            if value not in seen:
                seen.add(value)
                fresh.append(i)
        if fresh:
            yield batch.take(pa.array(fresh))


def _signed(wanted: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _asked(wanted, batches):
        words, starts = unpack_all(batch.column(1))
        columns = [pa.array(s.view(np.int64)) for s in _signatures(words, starts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts).astype(np.int32)), *columns], ["set_hash", "n", *SIGNATURE])


def bounded_pairs(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, differ) of the pairs whose bitmaps leave room for the threshold, with their differing bits; a tenth of what the arrays would shuffle."""
    pairs = pairs.persist()
    wanted = sets.sparkSession.sparkContext.broadcast(_bitmap(pairs))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signed(wanted.value, batches)

    rows = sets.select("set_hash", "words").mapInArrow(signed, "set_hash long, n int, s0 long, s1 long, s2 long, s3 long").dropDuplicates(["set_hash"])
    side = lambda k: rows.select(F.col("set_hash").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("n", *SIGNATURE)])
    differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SIGNATURE), F.lit(0))
    total = F.col("a_n") + F.col("b_n")
    room = total - 2 * F.ceil(total * (threshold / (1 + threshold)) - 1e-9)
    sized = F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9
    return pairs.join(side("a"), "a").join(side("b"), "b").filter((differ <= room) & sized).select("a", "b", differ.alias("differ"))


def verify_pairs(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of set hashes whose sorted arrays really reach the threshold.

    Only the arrays of sets that occur in a pair are shuffled.
    """
    wanted = sets.sparkSession.sparkContext.broadcast(_bitmap(pairs))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _asked(wanted.value, batches)

    arrays = sets.select("set_hash", "words").mapInArrow(asked, "set_hash long, words binary").dropDuplicates(["set_hash"])
    left = arrays.select(F.col("set_hash").alias("a"), F.col("words").alias("wa"))
    right = arrays.select(F.col("set_hash").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(_verified(threshold), "a long, b long")


def candidate_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b, distinct: pairs of set hashes whose bitmaps leave room for the threshold.

    sets (set_hash, n_words, words) may repeat a set; it is read several times: persist it.
    """
    spark, filled = sets.sparkSession, sets.filter("n_words > 0")
    total, words = filled.agg(F.count("*"), F.sum("n_words")).first()
    shared = spark.sparkContext.broadcast(common_words(filled, total))
    # the rows of a set are at most the share of its words beyond the threshold; with clusters fewer, each with some units
    buckets = max(4 * spark.sparkContext.defaultParallelism, int((1 - threshold) * (words or 0)) * ROW.itemsize // BUCKET)

    hot, split = HOT_TILE, SPLIT_TILE

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tile_blocks(shared.value, threshold, hot, buckets)(batches)

    tiles = filled.select("set_hash", "words").mapInArrow(blocks, "bucket long, block binary, units binary")
    return tiles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tile_pairs(threshold, split), "a long, b long").distinct()


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b), a < b, of all pairs of different sets (set_hash, n_words, words) at or above the threshold.

    Exact. Empty sets are similar to nothing; a set may be repeated.
    """
    return verify_pairs(candidate_pairs(sets, threshold).persist(), sets, threshold)


def duplicate_groups(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id, label, set_hash) of all questions but template residue; equal labels are one group.

    A question similar to none has a label of its own. Exact copies share a set_hash. Questions
    without any word are copies of each other. Null ids are kept as they are.
    """
    return _grouped(questions, threshold)[0]


def _grouped(questions: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    residue = template_residue(questions)
    every = word_sets(questions.select("id", "stem", "options_json", "subparts_json"), "id").persist()
    members = every.select(F.col("id").alias("question_id"), "set_hash").join(residue, "question_id", "left_anti").persist()
    allowed = members.select("set_hash").distinct()
    pairs = candidate_pairs(every, threshold).join(allowed.withColumnRenamed("set_hash", "a"), "a", "left_semi").join(allowed.withColumnRenamed("set_hash", "b"), "b", "left_semi")
    links = verify_pairs(pairs.persist(), every, threshold).persist()
    labels = component_labels(links)
    grouped = members.join(labels.withColumnRenamed("node", "set_hash"), "set_hash", "left")
    return grouped.select("question_id", F.coalesce("label", "set_hash").alias("label"), "set_hash"), links


def duplicate_pairs(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id_a, question_id_b), a < b: all pairs of questions of one group."""
    groups = duplicate_groups(questions, threshold)
    a = groups.select("label", F.col("question_id").alias("question_id_a"))
    b = groups.select("label", F.col("question_id").alias("question_id_b"))
    return a.join(b, "label").filter("question_id_a < question_id_b").select("question_id_a", "question_id_b")


def linked_questions(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id, group_id, group_size, n_links): one row per question; n_links counts other word sets it is linked to."""
    groups, links = _grouped(questions, threshold)
    ends = links.select(F.col("a").alias("set_hash")).union(links.select(F.col("b").alias("set_hash")))
    degree = ends.groupBy("set_hash").agg(F.count("*").alias("n_links"))
    size = groups.groupBy("label").agg(F.count("*").alias("group_size"), F.min("question_id").alias("group_id"))
    out = groups.join(size, "label").join(degree, "set_hash", "left")
    return out.select("question_id", "group_id", "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
