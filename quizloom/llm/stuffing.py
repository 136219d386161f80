"""Problem 10: pages made of repeated keywords, lists of links or product tags.

A page is read as a sequence of function words and word classes. Besides shape and last
letter a class says how often a content word has come after the same word (or after a break)
in its page: prose comes back to a pair of words now and then, between function words, while
keywords come back in rows. A trigram model of the classes is trained on the prose lines of
the corpus, and a page's perplexity under it alone decides: it is spam if that lies abnormally
far above, or below, that of the corpus's prose pages. Only words, links, tags and prices are
scored. Numbers, codes, marks and the labels between numbers are context, so that route
tables, traces and material lists are no more surprising than their words.

Null, empty and blank texts are no spam, nor are pages with fewer than LEAST words; a corpus
without prose gives nothing to compare with and no spam. Texts of any length are read whole;
repeated doc_ids give one row each time they are found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.pairs import FUNCTION_WORDS

# Function words that are classes of their own, marks, and the letters by which words are told apart.
FUNCTION = sorted(FUNCTION_WORDS["it"] | FUNCTION_WORDS["en"] | set("a e o i la le in un da dei ai al agli su tra fra nei negli è ma anche come the or but".split()))
MARKS, ENDINGS = ".,;:?(", "aeio"
AGAIN = (2, 3, 5, 9, 17)  # a pair that its page has so many times
CLASSES = {
    c: i
    for i, c in enumerate(
        ["begin", "line", *(f"!{m}" for m in MARKS), "!other", "number", "label", "url", "tag", "price", *(f"~{x}" for x in ENDINGS), "~else", "~Cap", "~CAPS", *(f"again{n}" for n in AGAIN), *FUNCTION]
    )
}
SPACE = 256  # classes per position of a trigram code
URL_CLASS, PLAIN, FIRST_AGAIN, OFTEN, FIRST_FUNCTION = CLASSES["url"], CLASSES["~a"], CLASSES["again2"], CLASSES["again5"], CLASSES[FUNCTION[0]]
OWN = frozenset(FUNCTION)
URL = re.compile(r"(?:https?://|www\.)[^\s)\]>]+", re.I)
PART = re.compile(
    r"(?P<url>(?:https?://|www\.)[^\s)\]>]+)|(?P<tag>#\w+)|(?P<price>[€$£]|\b(?:EUR|euro)\b)|(?P<number>[^\W\d_]*[\d=@_\\][^\s,;|»«()\"“”€$£]*)|(?P<word>[^\W\d_]+)|(?P<mark>[^\s\w])",
    re.I,
)
#: A page is spam if its perplexity is so many times that of prose pages, or so small a part of it.
HIGH, LOW = 4.0, 0.25
#: Nats by which the words of a page scatter: a mean over few words has to lie so much further, divided by the root of their number.
SCATTER = 2.0
#: Words that a page is judged by at least; a link counts as three.
LEAST, LINK = 5.0, 3.0
#: No single word says more than this many nats.
MOST = 6.0
#: A model of too little prose is too sure of it: the mean surprisal of prose counts as this at least.
LEAST_MEAN = 1.6
#: Occurrences that the shorter context counts for: the prior shares of classes, single classes, pairs.
BELIEF = (2000.0, 30.0, 30.0)
# Prior shares of function words, other words, marks and numbers; the rest, links and returning words, is rare.
SHARES = {"function": 0.3, "plain": 0.5, "mark": 0.19, "rare": 0.01}


def _prior() -> np.ndarray:
    kind = ["function" if c in OWN else "plain" if c[0] == "~" else "rare" if c.startswith("again") or c in ("url", "tag", "price") else "mark" for c in CLASSES]
    return np.array([SHARES[k] / kind.count(k) for k in kind])


PRIOR = _prior()
#: Characters read at once.
AT_ONCE = 1 << 21


class Chunks(dict):
    """Text between blanks -> its tokens as numbers: the hash of the word above 8 bits of class. Forgets all once it holds too many."""

    def __init__(self, most: int = 300_000) -> None:
        import xxhash

        super().__init__({"": (), "\n": (CLASSES["line"],)})
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def token(self, word: str, kind: int) -> int:
        return self.hash(word.lower().encode("utf-8", "replace")) & ~0xFF | kind

    def word(self, word: str) -> int:
        low = word.lower()
        if low in OWN:
            kind = CLASSES[low]
        elif len(word) > 1 and word.isupper():
            kind = CLASSES["~CAPS"]
        elif word[0].isupper():
            kind = CLASSES["~Cap"]
        else:
            kind = CLASSES.get(f"~{low[-1]}", CLASSES["~else"])
        return self.token(low, kind)

    def parts(self, chunk: str) -> Iterator[int]:
        if "://" in chunk or "www." in chunk:
            chunk = URL.sub(lambda m: f" {m.group()} ", chunk)
        for m in PART.finditer(chunk):
            kind, s = m.lastgroup, m.group()
            if kind == "word":
                yield self.word(s)
            elif kind == "mark":
                yield self.token(s, CLASSES["!."] if s in "!…" else CLASSES.get(f"!{s}", CLASSES["!other"]))
            else:
                yield self.token(s, CLASSES[kind])

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
            self.update({"": (), "\n": (CLASSES["line"],)})
        plain = chunk.isalpha() and chunk.lower() not in ("eur", "euro")
        found = self[chunk] = (self.word(chunk),) if plain else tuple(self.parts(chunk))
        return found


def _before(x: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The value one place before within the same page, 0 at its begin."""
    out = np.zeros_like(x)
    out[1:] = np.where(page[1:] == page[:-1], x[:-1], 0)
    return out


def read_pages(texts: list[str], memory: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """(class codes of all tokens, the page of each)."""
    found = [list(chain.from_iterable(map(memory.__getitem__, t.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").replace("\n", " \n ").split(" ")))) for t in texts]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    token = np.fromiter(chain.from_iterable(found), dtype=np.uint64, count=int(sizes.sum()))
    page = np.repeat(np.arange(len(texts)), sizes)
    code, word = (token & np.uint64(255)).astype(np.int64), token >> np.uint64(8)
    content, function = (code >= PLAIN) & (code < FIRST_AGAIN), code >= FIRST_FUNCTION
    before, number = _before(content, page), _before(code == CLASSES["number"], page)
    between = _before(function, page) & _before(before, page)  # "scheda di rete": a function word may stand between
    # what a content word follows: a content word, or else a break
    context = np.where(before, _before(word, page), np.where(between, _before(_before(word, page), page), np.uint64(7)))
    with np.errstate(over="ignore"):
        key = (word * np.uint64(0x9E3779B97F4A7C15) ^ context * np.uint64(0xD6E8FEB86659FD93)) + page.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(content & ~number & (between | ~_before(function, page)))
    _, own, counts = np.unique(key[at], return_inverse=True, return_counts=True)
    times = counts[own]
    labels = content & number & np.isin(np.r_[code[1:], 0], (CLASSES["number"], CLASSES["line"]))
    for n in AGAIN:
        code[at[times >= n]] = CLASSES[f"again{n}"]
    code[labels] = CLASSES["label"]
    return code, page


def prose_lines(code: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Whether each token belongs to a line that ends like a sentence and has function words, no links, tags or prices, and hardly any pair that comes often."""
    if not len(code):
        return np.zeros(0, bool)
    start = np.flatnonzero(np.r_[True, (code[:-1] == CLASSES["line"]) | (page[1:] != page[:-1])])
    length = np.diff(np.r_[start, len(code)])
    count = lambda which: np.add.reduceat(which.astype(np.int64), start)
    functions = count(code >= FIRST_FUNCTION)
    words = functions + count((code >= PLAIN) & (code < FIRST_FUNCTION))
    links = count((code >= URL_CLASS) & (code < PLAIN))
    often = count((code >= OFTEN) & (code < FIRST_FUNCTION))
    end = start + length - 1
    end = np.maximum(np.where(code[end] == CLASSES["line"], end - 1, end), start)
    stops = [CLASSES[f"!{m}"] for m in ".?:;"]
    closed = (code[end] == CLASSES["!other"]) & np.isin(code[np.maximum(end - 1, start)], stops)  # a quote or bracket may follow
    is_prose = (words >= 8) & (functions >= 0.2 * words) & (links == 0) & (np.isin(code[end], stops) | closed) & (often <= np.maximum(2, 0.1 * words))
    return np.repeat(is_prose, length)


def trigrams(code: np.ndarray, page: np.ndarray) -> np.ndarray:
    one = _before(code, page)
    return (_before(one, page) * SPACE + one) * SPACE + code


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, texts) of the texts of a batch, some megabytes at once."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        if text:
            rows.append(i)
            texts.append(text)
            size += len(text)
            if size > AT_ONCE:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of the prose lines of a partition."""
    memory, known, total = Chunks(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, texts in _slices(batch, 0):
            code, page = read_pages(texts, memory)
            new, n = np.unique(trigrams(code, page)[prose_lines(code, page)], return_counts=True)
            known, at = np.unique(np.concatenate([known, new]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([total, n]), minlength=len(known)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["trigram", "n"])


class ClassModel:
    """Interpolated trigram model over the word classes."""

    def __init__(self, trigram: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(trigram)
        self.trigram, self.n = trigram[order].astype(np.int64), n[order].astype(np.float64)
        context, c = self.trigram // SPACE, self.trigram % SPACE
        self.context = np.bincount(context, weights=self.n, minlength=SPACE * SPACE)
        self.pair = np.bincount(context % SPACE * SPACE + c, weights=self.n, minlength=SPACE * SPACE)
        self.left, self.single = np.bincount(context % SPACE, weights=self.n, minlength=SPACE), np.bincount(c, weights=self.n, minlength=SPACE)

    def surprisal(self, trigram: np.ndarray) -> np.ndarray:
        """Nats that each class comes as a surprise after the two before it."""
        own, back = np.unique(trigram, return_inverse=True)
        context, c = own // SPACE, own % SPACE
        b = context % SPACE
        seen = np.zeros(len(own))
        if len(self.trigram):
            at = np.minimum(np.searchsorted(self.trigram, own), len(self.trigram) - 1)
            seen = np.where(self.trigram[at] == own, self.n[at], 0.0)
        p1 = (self.single[c] + BELIEF[0] * PRIOR[c]) / (self.single.sum() + BELIEF[0])
        p2 = (self.pair[b * SPACE + c] + BELIEF[1] * p1) / (self.left[b] + BELIEF[1])
        p3 = (seen + BELIEF[2] * p2) / (self.context[context] + BELIEF[2])
        return np.minimum(-np.log(p3), MOST)[back]


def scores(texts: list[str], model: ClassModel, memory: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, mean surprisal, share of prose) of each text."""
    code, page = read_pages(texts, memory)
    weight = np.where(code == URL_CLASS, LINK, np.where(code > URL_CLASS, 1.0, 0.0))
    of = lambda x: np.bincount(page, weights=x, minlength=len(texts))
    words = of(weight)
    prose = of(prose_lines(code, page).astype(float)) / np.maximum(of(np.ones(len(code))), 1)
    return words, of(weight * model.surprisal(trigrams(code, page))) / np.maximum(words, 1), prose


def page_scores(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, surprisal, prose_share) of each page with at least LEAST words; surprisal is the log of its perplexity."""
    texts = documents.filter(F.col(text).isNotNull())
    counts = texts.select(text).mapInArrow(_train, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as there are triples of classes
    shared = documents.sparkSession.sparkContext.broadcast((counts.column("trigram").to_numpy(), counts.column("n").to_numpy()))
    kind = documents.schema[doc_id].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = ClassModel(*shared.value), Chunks()
        for batch in batches:
            for rows, own in _slices(batch, 1):
                words, surprisal, prose = scores(own, model, memory)
                keep = np.flatnonzero(words >= LEAST)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(rows)[keep])), pa.array(words[keep]), pa.array(surprisal[keep]), pa.array(prose[keep])], ["doc_id", "words", "surprisal", "prose_share"])

    return texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {kind}, words double, surprisal double, prose_share double")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages whose perplexity under the model of prose is abnormal."""
    every = page_scores(documents).persist()
    prose = every.filter("prose_share >= 0.9").agg(F.avg("surprisal").alias("mean"))
    far = F.col("surprisal") - F.when(F.col("mean").isNotNull(), F.greatest("mean", F.lit(LEAST_MEAN)))
    margin = SCATTER / F.sqrt("words")
    return every.join(F.broadcast(prose)).filter((far > float(np.log(HIGH)) + margin) | (far < float(np.log(LOW)) - margin)).select("doc_id")
