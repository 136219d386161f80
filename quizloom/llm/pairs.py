"""Problem 2: broken prompt and response pairs among question corrections.

A response is compressed with its prompt as zstandard dictionary: a copy, but for a lead-in,
then costs next to nothing. Languages and refusals come from dictionaries with weights. Breaking off is judged by brackets
and list marks and, for a response that ends without a mark, by a terminal-context model
counted over all stems and responses: how often a sentence ends after the response's last
two words, and whether the last word is ever seen inside a text.

At most one defect a pair, in the order empty, refusal, copy, language, truncated. A null
explanation is empty only if there is no option id and no payload either; a correction
whose question is unknown is judged without prompt. Repeated pairs each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.glyphs import option_texts, subpart_texts
from quizloom.llm.residue import TAG, _mix
from quizloom.llm.words import Hashes

# Texts that say nothing.
NOTHING = frozenset("n a|na|n d|nd|null|none|nan|nil|undefined|nessuna|nessuno|vuoto|empty|non disponibile|not available".split("|"))

# Function words found in one of the languages only.
LANGUAGES = {
    "it": "il gli che di del della dei delle nel nella è perché così anche dove mentre quando sono alla allo dal dalla ogni più non con per si una uno lo ed questo questa quindi infatti quella quello cui sul sulla".split(),
    "en": "the of and to is in that for when with which because by this its are only how from each what one it be as not has does why while then holds".split(),
    "de": "der die das und ist nicht weil den dem des ein eine wird werden wenn damit nach jedem sein durch auf mit zu diese dieser sich auch man falsch für von zum zur oder".split(),
    "es": "el los las que y está esta para porque por como con una es del se su más cuando cada sin entre sobre también lo hacia recordar respuesta".split(),
    "fr": "le les des et est que qui dans pour parce car une un sur avec pas ne du au aux ce cette chaque lorsque sont par plus il elle vers réponse".split(),
    "pt": "o os as do da dos das não uma um em que é para porque quando cada com se mais ao pela pelo resposta são".split(),
    "nl": "de het een van en niet dat wordt omdat wanneer naar voor met zijn op deze die elke door ook worden antwoord".split(),
}
_COUNT: dict[str, int] = {}
for _words in LANGUAGES.values():
    for _w in set(_words):
        _COUNT[_w] = _COUNT.get(_w, 0) + 1
FUNCTION_WORDS = {lang: frozenset(words) for lang, words in LANGUAGES.items()}

# The refusal dictionary, word beginnings with their weights; a sentence whose entries sum up to REFUSED declines to answer.
REFUSED = 1.0
DECLINING = {
    0.3: "purtroppo|unfortunately",
    0.5: "mi dispiace|spiacente|mi scuso|in grado di|devo |debbo |preferisco |lascio |non dispongo|not enough|sufficient|non è disponibile|isn't available",
    0.6: "non posso |non possiamo |non intendo |non voglio |non so |non sono in grado|i do not have|i don't have|questa richiesta|cannot be|the request|the question",
    1.0: "declinare|rifiutare|non mi è consentito|non mi è permesso|non mi è possibile|mi è impossibile|mi è vietato|ciò che mi è permesso|lascio la soluzione|in quanto assistente|in quanto modello|come assistente|come modello linguistico"
    "|i'm sorry|i am sorry|i apologi|i can't|i cannot|i can not|i won't|i will not|i must decline|i have to decline|i would rather not|i'd rather not|i prefer not|i'm unable|i am unable|i'm not able|i am not able|i'm not allowed|i am not allowed"
    "|not something i do|not something i can|as an ai|as an assistant|as a language model|as a virtual assistant|i leave the solution|i leave the answer|i leave this|beyond what i|answer is not available|impossible for me to",
}
# What is declined.
DECLINED = {0.5: "risponder|aiutar|fornir|dare |darti|dar |indicar|risolver|svolger|esprimer|soddisfar|informazioni|elementi|dati|la risposta|la soluzione|fulfilled|answered|access|information"}
REFUSALS = {phrase: weight for part in (DECLINING, DECLINED) for weight, phrases in part.items() for phrase in phrases.split("|")}
REFUSAL = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, REFUSALS), key=len, reverse=True)) + ")")
DECLINES = frozenset(p for phrases in DECLINING.values() for p in phrases.split("|"))


def refuses(text: str) -> bool:
    """Whether a sentence of the text declines to answer: entries of the refusal dictionary, at least one of them declining, sum up to REFUSED."""
    for sentence in re.split(r"[.!?\n]+", text.lower().replace("\u2019", "'")):
        found = set(REFUSAL.findall(sentence))
        if found and not found.isdisjoint(DECLINES) and sum(REFUSALS[x] for x in found) >= REFUSED:
            return True
    return False


WORD = re.compile(r"\w+")
BRACKET = re.compile(r"[()\[\]{}«»“”]")
LETTER = re.compile(r"(?<![\w(])(?:[a-hA-H]|\d)[.):](?=\s)")
MARKS = ".!?…"
#: Ends per occurrence of a context from which an unmarked end counts as complete.
LEAST_END_SHARE = 0.4
#: A copy costs at most this share of its own compressed size once the prompt is known, both without what an empty frame costs.
COPY_SHARE, FRAME = 0.11, 9
#: Words of a lead-in that may come before a copy, at most half of it, and bytes that such words may cost.
LEAD, LEAD_BYTES = 8, 72
BITS = 24


def plain(text: str) -> str:
    """Lower case, words only, one space between."""
    return " ".join(WORD.findall(text.lower()))


def language_of(text: str) -> str | None:
    """The language most of whose function words the text holds; None if they don't tell."""
    scores = dict.fromkeys(LANGUAGES, 0.0)
    for w in WORD.findall(text.lower()):
        share = _COUNT.get(w)
        if share:
            for lang, words in FUNCTION_WORDS.items():
                if w in words:
                    scores[lang] += 1 / share
    (best, most), (_, second) = sorted(scores.items(), key=lambda x: -x[1])[:2]
    return best if most >= 1.5 and most >= 1.5 * second else None


def is_empty(explanation: str | None, option: str | None, payload: str | None) -> bool:
    """No content in the explanation, no option id, and no payload or an empty object."""
    if option and option.strip():
        return False
    if payload is not None and re.sub(r"\s", "", payload) not in ("", "{}"):
        return False
    words = plain(TAG.sub(" ", explanation or ""))
    return not words or words in NOTHING


class CopyModel:
    """Sizes of a response compressed alone and with its prompt as dictionary."""

    def __init__(self) -> None:
        import zstandard

        self.zstd = zstandard
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)

    def knowing(self, prompt: bytes):  # noqa: ANN201
        """A compressor that has the prompt as its dictionary."""
        dictionary = self.zstd.ZstdCompressionDict(prompt, dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        return self.zstd.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def is_copy(self, explanation: str, prompt: str) -> bool:
        """Given the prompt it costs next to nothing, but for a lead-in."""
        response, source = plain(LETTER.sub(" ", explanation)), plain(LETTER.sub(" ", prompt))
        if not response or not source:
            return False
        given = self.knowing(source.encode())
        costs = lambda text: (len(self.alone.compress(text)) - FRAME, len(given.compress(text)) - FRAME)
        words = response.split()
        alone, rest = costs(response.encode())
        if rest <= COPY_SHARE * alone:
            return True
        if rest > COPY_SHARE * alone + LEAD_BYTES:  # more than a lead-in can cost
            return False
        for lead in range(1, min(LEAD, len(words) // 2) + 1):
            alone, rest = costs(" ".join(words[lead:]).encode())
            if rest <= COPY_SHARE * alone:
                return True
        return False


CLOSES = dict(zip(")]}»”", "([{«“"))


def brackets_open(text: str) -> bool:
    """A bracket is still open at the end, or the end is a list mark such as 2) without anything after it.

    A closing mark that no bracket waits for is a list mark and closes nothing.
    """
    waiting, mark = [], False
    for c in BRACKET.findall(text):
        mark = False
        if c in CLOSES.values():
            waiting.append(c)
        elif CLOSES[c] in waiting:
            waiting.reverse()
            waiting.remove(CLOSES[c])
            waiting.reverse()
        else:
            mark = True
    return bool(waiting) or mark and bool(re.search(r"(?:^|[\s;,])(?:\d{1,2}|[a-zA-Z])\)$", text))


def open_end(text: str) -> bool | None:
    """True: breaks off by its marks. False: ends with a mark. None: ends in a word without mark."""
    text = re.sub(r"(?:\.\.\.|…)$", "", re.sub(r"\s+", " ", TAG.sub(" ", text)).strip()).rstrip()
    if brackets_open(text) or re.search(r"[,;:\-–—(\[{«“/=]$", text):
        return True
    if re.search(r"[.!?…][\"'”»)\]]*$", text) or text[-1:] in ")]}»”\"'":
        return False
    return None


def _mask(word: str, first: bool) -> str:
    if word[0].isdigit():
        return "#"
    return "*" if word[0].isupper() and word[1:].islower() and not first and len(word) > 3 else word.lower()


def _tokens(text: str) -> tuple[list[str], list[bool], list[bool]]:
    """Masked words, whether a sentence ends after each, and whether each surely is a whole word (not cut by a hyphen or the end)."""
    words, ends, whole, last = [], [], [], 0
    for m in WORD.finditer(text):
        if words:
            between = text[last : m.start()]
            ends.append(any(c in MARKS for c in between))
            whole.append(not any(c in "-‐¬\xad" for c in between))
        words.append(_mask(m.group(), not words or ends[-1]))
        last = m.end()
    if words:
        ends.append(True)
        whole.append(False)
    return words, ends, whole


def _context(text: str, hashes: Hashes) -> list[int]:
    """Keys of the last two words together, of the last alone, and of the last three."""
    words = _tokens(text)[0]
    h = hashes.of(["\x02", "\x02", *words][-3:])
    pair = _mix(h[1:2], h[2:3], 6)
    return np.array([pair[0], _mix(h[2:3], h[2:3], 5)[0], _mix(h[0:1], pair, 7)[0]], dtype=np.uint64).view(np.int64).tolist()


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    copies, hashes = CopyModel(), Hashes()
    for batch in batches:
        defects, contexts = [], []
        columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
        for text, option, payload, language, stem, options, subparts in zip(*columns):
            defect, context = None, None
            if is_empty(text, option, payload):
                defect = "empty"
            elif text and WORD.search(text) and plain(TAG.sub(" ", text)) not in NOTHING:
                prompt = "\n".join(x for x in (stem, options, subparts) if x)
                if refuses(text):
                    defect = "refusal"
                elif prompt and copies.is_copy(text, prompt):
                    defect = "copy"
                else:
                    own = language_of(text)
                    asked = (language_of(stem) if stem else None) or language
                    if own and asked and own != asked[:2].lower():
                        defect = "language"
                    else:
                        end = open_end(text)
                        if end:
                            defect = "truncated"
                        elif end is None:
                            context = _context(text, hashes)
            defects.append(defect)
            contexts.append(context)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(defects, pa.string()), pa.array(contexts, pa.list_(pa.int64()))],
            ["user_id", "question_id", "defect", "context"],
        )


def _context_counts(wanted: bytes):  # noqa: ANN202
    """(key, n, ends) over all texts: contexts and their sentence ends; words and their places inside a text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), np.frombuffer(wanted, dtype=np.uint8)

        def asked(keys: np.ndarray) -> np.ndarray:
            slot = keys & np.uint64((1 << BITS) - 1)
            return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            words, ends, whole = [], [], []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                w, e, o = _tokens(text)
                words += ["\x02", "\x02", *w]
                ends += [False, False, *e]
                whole += [False, False, *o]
            h = hashes.of(words)
            if len(h) < 3:
                continue
            end, inner = np.array(ends), np.array(whole)
            pairs, singles = _mix(h[:-1], h[1:], 6), _mix(h, h, 5)
            threes = _mix(h[:-2], pairs[1:], 7)
            keep, alone, third = asked(pairs), asked(singles) & inner, asked(threes)
            keys = np.concatenate([pairs[keep], singles[alone], threes[third]])
            ended = np.concatenate([end[1:][keep], np.zeros(int(alone.sum()), bool), end[2:][third]])
            key, at = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)), pa.array(np.bincount(at, weights=ended, minlength=len(key)).astype(np.int64))],
                ["key", "n", "ends"],
            )

    return each


def _wanted(pending: DataFrame) -> bytes:
    """The contexts asked for, as a bitmap of fixed size."""
    slots = pending.select(F.explode("context").alias("f")).select(F.expr(f"cast(f & {(1 << BITS) - 1} as int)").alias("slot"))
    table = slots.groupBy(F.expr("slot >> 3").alias("byte")).agg(F.bit_or(F.expr("cast(shiftleft(1, slot & 7) as int)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    bitmap[table.column("byte").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return bitmap.tobytes()


def broken_pairs(corrections: DataFrame, questions: DataFrame) -> DataFrame:
    """(user_id, question_id, defect) of the corrections that are unusable."""
    prompts = questions.select(
        F.col("id").alias("question_id"), "language", "stem", option_texts(F.col("options_json")).alias("options"), subpart_texts(F.col("subparts_json")).alias("subparts")
    )
    pairs = corrections.select("user_id", "question_id", "explanation_text", "correct_option_id", "answer_payload").join(prompts, "question_id", "left")
    pairs = pairs.select("user_id", "question_id", "explanation_text", "correct_option_id", "answer_payload", "language", "stem", "options", "subparts")
    judged = pairs.mapInArrow(_judge, "user_id string, question_id string, defect string, context array<long>").filter("defect IS NOT NULL OR context IS NOT NULL").persist()
    pending = judged.filter("context IS NOT NULL")
    wanted = questions.sparkSession.sparkContext.broadcast(_wanted(pending))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _context_counts(wanted.value)(batches)

    texts = questions.select(F.col("stem").alias("text")).union(corrections.select("explanation_text"))
    counts = texts.mapInArrow(counted, "key long, n long, ends long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # for each pair of last words the longer context decides where it is known from elsewhere
    asked = pending.select("user_id", "question_id", F.posexplode("context").alias("at", "key")).join(counts, "key", "left")
    of = lambda at, c: F.max(F.when(F.col("at") == at, F.col(c)))
    both = asked.groupBy("user_id", "question_id").agg(
        of(0, "n").alias("n2"), of(0, "ends").alias("e2"), of(1, "n").alias("inner"), of(2, "n").alias("n3"), of(2, "ends").alias("e3")
    ).na.fill(0)
    long = F.col("n3") >= 4
    n, ends = F.when(long, F.col("n3")).otherwise(F.col("n2")), F.when(long, F.col("e3")).otherwise(F.col("e2"))
    # the pair itself is one of the n, and ends without mark
    whole = (F.col("inner") >= 2) & (n >= 2) & (ends - 1 >= LEAST_END_SHARE * (n - 1))
    broken = both.filter(~whole).select("user_id", "question_id", F.lit("truncated").alias("defect"))
    return judged.filter("defect IS NOT NULL").select("user_id", "question_id", "defect").union(broken)
