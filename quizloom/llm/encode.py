"""Problem 8: token ids of every text by a public byte-level BPE tokenizer.

Forced-boundary splitting. Two bytes that stand side by side inside no token of the
vocabulary can never be merged across, so a cut between them is certain. The fragments are
encoded on their own, each different one once per worker as long as it is remembered, and
their ids are put together again. A cut also has to leave the tokenizer's own splitting
pattern unchanged; of the certain pairs, those before a run of ASCII white space do so,
since no look-around of the pattern reaches across them. The pairs are checked against
the vocabulary when it is loaded; without them a text is encoded whole.

An empty or null text gives an empty list; strings that look like special tokens are
ordinary text; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie; a parameter, since they are not part of this repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the public splitting pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A run of ASCII white space and what follows up to the next; other white space stays inside.
FRAGMENT = re.compile(r"[\t-\r\x1c-\x20]*[^\t-\r\x1c-\x20]+|[\t-\r\x1c-\x20]+")
#: Fragments remembered by a worker, and the longest that is remembered.
REMEMBERED, LONGEST = 300_000, 64


class Encoder:
    """Encodes texts by cutting them at forced boundaries."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.never = np.ones((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            self.never[b[:-1], b[1:]] = False
        self.memory: dict[str, list[int]] = {}
        # a cut before white space is certain after every byte that no token holds in front of it
        space = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
        joins = {b for b in range(256) if b not in space and not self.never[b, space].all()}
        self.certain = not any(b < 128 for b in joins)
        self.joins = frozenset(b & 63 for b in joins if 128 <= b < 192)

    def fragments(self, text: str) -> Iterator[str]:
        """The text cut at the certain places before runs of ASCII white space."""
        if not self.certain:
            yield text
            return
        held, joins = "", self.joins
        for piece in FRAGMENT.findall(text):
            last = piece[-1]
            if last > "\x7f" and ord(last) & 63 in joins:  # the last byte of a character is 10xxxxxx
                held += piece
            elif held:
                yield held + piece
                held = ""
            else:
                yield piece
        if held:
            yield held

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memory, out = self.memory, []
        for fragment in self.fragments(text):
            ids = memory.get(fragment)
            if ids is None:
                ids = self.whole.encode_ordinary(fragment)
                if len(fragment) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[fragment] = ids
            out += ids
        return out


def _path(name: str, folder: str | None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens. One narrow stage, no shuffle."""
    path = _path(tokenizer, folder)
    kind = df.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(each, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(key, n_tokens): sizes only, so that no ids leave the worker."""
    path = _path(tokenizer, folder)
    kind = df.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            sizes = [len(encoder.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(each, f"k {kind}, n_tokens long").withColumnRenamed("k", key)
