"""Words of questions as sorted arrays of numbers: what problems 3 and 5 compare.

The words of a question are the distinct runs of a-z and 0-9, runs of digits only left
out, of stem, option texts and subpart prompts in the consistent form of problem 7,
lower-cased and without accents. A word is kept as the low 48 bits of its 64-bit xxHash,
so that a set is a short binary string and no dictionary of the corpus is needed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.glyphs import Unifier, option_texts, subpart_texts, unified_sql

LOW48 = np.uint64((1 << 48) - 1)
WORD = re.compile(r"[a-z0-9]+")
#: Characters beyond plain Latin text.
UNUSUAL = re.compile(r"[^\x00-\x7f\u00c0-\u00ff\u2010-\u2027]")
#: Characters that the consistent form changes in a way that changes words; a Greek letter next to a space is a symbol.
CHANGING = re.compile(
    r"[\u0100-\u036f\u0400-\u052f\u1e00-\u1eff\u200b-\u200f\u2060\ufb00-\ufb06\ufeff-\uff5e\u03bf\u039f]"
    r"|[A-Za-z0-9\u0370-\u03ff][\u0370-\u03ff]|[\u0370-\u03ff][A-Za-z\u0370-\u03ff]"
)


class Hashes(dict):
    """Word -> 64-bit hash, remembered; forgets all once it holds too many words."""

    def __init__(self, most: int = 400_000) -> None:
        import xxhash

        super().__init__()
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.hash(word.encode())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def _latin_table() -> bytes:
    """Byte table of Latin-1: letters to a-z without case and accents, digits kept, all else to blanks."""
    out = bytearray(b" " * 256)
    for code in range(256):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code).lower()) if not unicodedata.combining(c))
        if WORD.fullmatch(bare) and len(bare) == 1:
            out[code] = ord(bare)
    return bytes(out)


LATIN = _latin_table()


def latin_bytes(text: str) -> bytes | None:
    """The text in Latin-1, other characters as signs that part words; None if some of them may change words."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None if CHANGING.search(text) else text.encode("latin-1", "replace")


class WordBytes(dict):
    """Word as bytes -> its hash, 0 for a run of digits; forgets all once it holds too many words."""

    def __init__(self, most: int = 400_000) -> None:
        import xxhash

        super().__init__()
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = 0 if word.isdigit() else self.hash(word)
        return h


def pack(words: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as 6 bytes each."""
    return np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def unpack_all(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in one array, and where each row's begin (and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel(), (starts - starts[0]) // 6


def word_sets(df: DataFrame, key: str) -> DataFrame:
    """(key, set_hash, n_words, words) of rows with stem, options_json and subparts_json.

    A null or malformed JSON adds no words; a row without any word has an empty set (its
    set_hash is that of the empty set). The key keeps its type; other columns are ignored.
    """
    text = F.concat_ws("\n", "stem", option_texts(F.col("options_json")), subpart_texts(F.col("subparts_json")))
    short = df.select(F.col(key).alias("k"), text.alias("t"))
    kind = df.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        unifier, memory = Unifier(), WordBytes()
        for batch in (b.slice(i, 1 << 16) for b in batches for i in range(0, b.num_rows, 1 << 16)):
            texts = batch.column(1).to_pylist()
            raw = [latin_bytes(t) for t in texts]
            odd = [i for i, b in enumerate(raw) if b is None]
            if odd:  # only texts with characters that may change go through the mapping
                mapped = unifier.run(f"lower(strip_accents({unified_sql('t')})) AS t", batch.select(["t"]).take(pa.array(odd))).column("t").to_pylist()
                for i, t in zip(odd, mapped):
                    raw[i] = t.encode("latin-1", "replace")
            found = [b.translate(LATIN).split() for b in raw]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            words = np.fromiter(map(memory.__getitem__, chain.from_iterable(found)), dtype=np.uint64, count=int(sizes.sum()))
            row = np.repeat(np.arange(len(found), dtype=np.uint64), sizes)[words != 0]
            words = words[words != 0] & LOW48
            both = np.sort((row << np.uint64(48)) | words)  # by row, then word
            both = both[np.r_[True, both[1:] != both[:-1]][: len(both)]]
            words, counts = both & LOW48, np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=len(found))
            data, ends = pack(words), np.concatenate([[0], np.cumsum(counts)]) * 6
            packed = [data[i:j] for i, j in zip(ends[:-1], ends[1:])]
            sets = [xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.int64()), pa.array(counts.astype(np.int32)), pa.array(packed, pa.binary())], ["k", "set_hash", "n_words", "words"])

    return short.mapInArrow(each, f"k {kind}, set_hash long, n_words int, words binary").withColumnRenamed("k", key)
