"""Problem 6: template residue, filler, error pages and script notices among stems.

Records of one template are aligned on frames: the pair of words around a position, the
two before it or the two after it. Where the records of a frame carry ordinary words in
between, the position is a slot; a record whose slot still holds a variable name, a
default or a blank is residue, while a blank or argument that all records of the frame
keep belongs to the question. Short pages are also masked into whole-page templates: a page
whose word pairs do not occur in ordinary stems, and which repeats or speaks of errors,
access, scripts or provisional text, is no question. In a stem of any length, each sentence
and each line that speaks of such things is masked and judged by itself: it is a message if
its word pairs occur neither in sentences that speak of no such thing nor in several others.

Nulls and empty stems are no residue; repeated ids give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.llm.glyphs import Unifier
from quizloom.llm.words import latin_bytes


# Shapes of variable names, defaults and blanks.
VARIABLE = r"\{\{[^{}]*\}\}|[$#]\{[^{}]*\}|\{%[^%]*%\}|<%[^%]*%>|%%\w+%%|(?<!\w)%[A-Z_]{3,}%|\[\[[^\[\]]*\]\]|(?<!\w)__[A-Za-z]\w*?__|\{[A-Za-z_][\w.]*\}|\[[A-Z]{3,}(?: [A-Z]+)+\]"
DEFAULT = r"\[object Object\]|(?<!\w)(?:undefined|NaN|TODO|FIXME|TBD|XXX)(?!\w)"
ARGUMENT = r"<[^<>\n]{2,60}>|_{3,}"
MARKER = re.compile(f"(?P<v>{VARIABLE})|(?P<d>{DEFAULT})|(?P<a>{ARGUMENT})")
SUSPECT = ("{", "}", "<", ">", "[", "]", "%", "__", "undefined", "NaN", "TODO", "FIXME", "TBD", "XXX")
TAG = re.compile(r"</?(?:h[1-6]|p|hr|br|div|span|b|i|em|strong|body|html|title|center)\b[^<>]*>", re.I)
WORD = re.compile(r"\w+")

# Words of filler text.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
    enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa
    qui officia deserunt mollit anim id est laborum vitae mauris porta urna ligula cursus nunc eget ac arcu vel massa at""".split()
)
FILLER_BYTES = frozenset(w.encode() for w in FILLER_WORDS)
RUN = b"\x01" * 6
# Messages of sites and programs, notices, and provisional text.
SPEAKS = re.compile(
    r"\b(?:[45]\d\d|errore|\w*error|\w*exception|traceback|forbidden|not found|non trovat[ao]|bad gateway|timeout|unavailable|accesso|access|login|autenticazione|"
    r"sessione|session|permess[io]|denied|negato|robot|captcha|javascript|scripts?|browser|cookie|ricarica|aggiorna|riprova\w*|richiest[ae]|"
    r"caricamento|loading|oops|non esiste|non disponibile|manutenzione|maintenance|"
    r"prova|esempio|provvisori[oa]|sostituire|completare|inserire|segnaposto|placeholder|asdf|qwer|bla|todo|xxx|testo)\b",
    re.I,
)
CODE = re.compile(r"\b[0-9a-f]{6,}\b|\d+", re.I)
#: The phrases of SPEAKS by a word of each; the rest of it is single words.
PHRASES = {b"found": b"not found", b"trovato": b"non trovato", b"trovata": b"non trovata", b"gateway": b"bad gateway", b"esiste": b"non esiste", b"disponibile": b"non disponibile"}
#: What one word says enough of; of the other words, which questions use as well, a message has two, one in WORDY words.
WORDY = 8
STRONG = re.compile(
    r"\b(?:traceback|\w+exception|\w+error|forbidden|not found|non trovat[ao]|bad gateway|unavailable|negato|denied|captcha|javascript|oops|"
    r"non disponibile|manutenzione|maintenance|ricarica|riprova|riprovare|segnaposto|placeholder|asdf|qwer)\b",
    re.I,
)
#: Ends of sentences, empty lines, and signs that part a message from the text next to it.
PIECES = re.compile(r"(?<=[.!?\u2026])[\"'\u00bb\u201d)]*\s+|\n\s*\n|\s[*|#=\u2013\u2014-]+\s")
#: Line ends but those inside a wrapped sentence.
LINES = re.compile(r"\n(?!\s*(?:[a-z\u00df-\u00ff]|\d+\s*[?.,;)]))")
#: Pieces of so many templates hold a word pair that belongs to questions about such things.
TEMPLATES = 4
STATUS = re.compile(r"(?:\W|<\w+>|\d\.\s)*(?:[45]\d\d\b|errore\b|error\b)", re.I)
#: Characters up to which a stem is a short page.
SHORT_PAGE = 200
BITS = 24
#: Tells a pair counted in calm pieces from the same pair counted in all long stems.
CALM = np.uint64(0x5851F42D4C957F2D)
BOS, EOS, MARK, NUMBER = b"\x02", b"\x03", b"\x00", b"#"
#: Byte table of Latin-1: letters, digits, underscores and the mark stay, all else parts words.
PARTS = bytes(c if chr(c).isalnum() or c in (0, 95) else 32 for c in range(256))


class TokenHashes(dict):
    """Token -> 64-bit hash; whatever begins with a digit counts as a number. Forgets all once it holds too many."""

    def __init__(self, most: int = 400_000) -> None:
        import xxhash

        super().__init__()
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[token] = self.hash(NUMBER if token[:1].isdigit() else token)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


# The single words of SPEAKS and of its phrases, those STRONG alone, and the endings and beginning that make further ones.
SAID = frozenset(
    b"""errore error exception traceback forbidden timeout unavailable accesso access login autenticazione sessione session permesso permessi denied
    negato robot captcha javascript script scripts browser cookie ricarica aggiorna riprova richiesta richieste caricamento loading oops manutenzione
    maintenance prova esempio provvisorio provvisoria sostituire completare inserire segnaposto placeholder asdf qwer bla todo xxx testo""".split()
) | frozenset(PHRASES)
LOUD = frozenset(
    b"traceback forbidden unavailable negato denied captcha javascript oops manutenzione maintenance ricarica riprova riprovare segnaposto placeholder asdf qwer".split()
) | (frozenset(PHRASES) - {b"esiste"})
ENDINGS, BEGINNING = (b"error", b"exception"), b"riprova"
#: What a text with one such word has to hold so that a piece of it may be a message.
MORE = re.compile(rb"error|(?:^| )[45]\d\d(?: |$)")


def _low(text: str) -> bytes:
    """The text in lower case, all but words as blanks; characters beyond Latin-1 part words."""
    return text.lower().encode("latin-1", "replace").translate(PARTS)


def _tokens(text: str) -> list[bytes]:
    """Words in lower case."""
    return _low(text).split()


def said(low: bytes, tokens: list[bytes]) -> set[bytes]:
    """The words of SPEAKS, and of its phrases, that are in a text (as _low gives it, and its tokens)."""
    found = set(SAID.intersection(tokens))
    if b"error" in low or b"exception" in low or BEGINNING in low:
        found.update(t for t in tokens if t.endswith(ENDINGS) or t.startswith(BEGINNING))
    if not found.isdisjoint(PHRASES):
        text = b" %s " % b" ".join(tokens)
        found = {t for t in found if t not in PHRASES or b" %s " % PHRASES[t] in text}
    return found


def strong(token: bytes) -> bool:
    """One such word says enough."""
    return token in LOUD or token.endswith(ENDINGS) and token not in ENDINGS


def may_be_message(low: bytes, found: set[bytes]) -> bool:
    """Whether some piece of a text with these words of SPEAKS can have the evidence a message needs."""
    return len(found) > 1 or any(map(strong, found)) or bool(found and MORE.search(low))


def _mix(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> np.uint64(29))) + b) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _clean(stem: str) -> str:
    return TAG.sub(" ", stem) if "<" in stem else stem


def _words(stem: str) -> tuple[list[bytes], list[bool] | None]:
    """Tokens of a stem between two begin and two end marks, markers become marks; and, unless all are, which are calm.

    A token is calm if its sentence speaks of no errors, access, scripts or provisional text.
    """
    if any(c in stem for c in "{}<>[]%_") or "undefined" in stem or "NaN" in stem:
        stem = MARKER.sub(" \x00 ", _clean(stem))
    low = _low(stem)
    words = low.split()
    if not said(low, words):
        return [BOS, BOS, *words, EOS, EOS], None
    words, calm = [BOS, BOS], [False, False]
    for piece in PIECES.split(stem):
        low = _low(piece)
        own = low.split()
        words += own
        calm += [not said(low, own)] * len(own)
    return [*words, EOS, EOS], [*calm, False, False]


def _messages(stem: str) -> Iterator[tuple[str, str, list[bytes], list[bool]]]:
    """Of each sentence and line that speaks of such things: its kind, its template, its tokens, and which pairs tell something.

    A "part" may be a message, an "ask" is none; of a sentence of several lines, a "whole", the lines are counted instead.
    Names (capitals inside a piece) meet ever new words: pairs with them tell nothing.
    """
    pieces = {}
    for piece in PIECES.split(stem):
        lines = LINES.split(piece) if "\n" in piece else [piece]
        pieces.update(dict.fromkeys(lines, "part"))
        if len(lines) > 1:
            pieces.setdefault(piece, "whole")
    for piece, kind in pieces.items():
        low = _low(piece)
        tokens = low.split()
        found = said(low, tokens)
        if not found or len(tokens) < 2:
            continue
        evidence = len(found) + bool(STATUS.match(piece))
        loud = any(map(strong, found))
        if not loud and evidence < 2:
            continue
        if "?" in piece or not loud and len(tokens) > WORDY * evidence:
            if kind == "whole":
                continue
            kind = "ask"
        upper = [t.decode("latin-1")[:1].isupper() for t in piece.encode("latin-1", "replace").translate(PARTS).split()]
        title = 2 * sum(upper) > sum(not t[:1].isdigit() for t in tokens)
        plain = [i == 0 or not u or title or t in found for i, (u, t) in enumerate(zip(upper, tokens))]
        yield kind, _mask(piece), tokens, [a and b for a, b in zip(plain, plain[1:])]


def _mask(text: str) -> str:
    return re.sub(r"[^\w#]+", " ", CODE.sub("#", text.lower())).strip(" #")


def filler_run(words: list[str]) -> bool:
    """At least six words of filler text in a row, or a short page that only repeats a word or two."""
    run = 0
    for w in words:
        run = run + 1 if w in FILLER_WORDS else 0
        if run >= 6:
            return True
    if not 3 <= len(words) <= 8:
        return False
    head = max(map(words.count, words))
    return head >= 3 and head * 2 > len(words)


def _markers(stem: str) -> tuple[list[tuple[str, str, list[bytes]]], bool]:
    """Markers of a stem as (kind, text, [two words before, two after]); and whether hardly any text is around them."""
    stem = _clean(stem)
    pieces, found, last = [BOS, BOS], [], 0
    for m in MARKER.finditer(stem):
        pieces += _tokens(stem[last : m.start()])
        found.append((m.lastgroup, re.sub(r"\s+", " ", m.group()), len(pieces)))
        pieces.append(MARK)
        last = m.end()
    pieces += _tokens(stem[last:]) + [EOS, EOS]
    bare = sum(p not in (MARK, BOS, EOS) and not p[:1].isdigit() for p in pieces) <= 1
    return [(k, t, [pieces[i - 2], pieces[i - 1], pieces[i + 1], pieces[i + 2]]) for k, t, i in found], bare


def _suspect(stem: str) -> bool:
    if len(stem) <= SHORT_PAGE or any(map(stem.__contains__, SUSPECT)):
        return True
    low = _low(stem)
    tokens = low.split()
    return len(tokens) <= 8 or RUN in bytes(map(FILLER_BYTES.__contains__, tokens)) or may_be_message(low, said(low, tokens))


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each suspect stem: its markers with their frames, the templates of the page and of possible messages with word pairs, or filler."""
    hashes, unifier = TokenHashes(), None
    names = ["question_id", "kind", "sign", "frames"]
    for batch in batches:
        out: list[list] = [[], [], [], []]

        def add(qid: str, kind: str, sign: str, frames: list[int]) -> None:
            for column, value in zip(out, (qid, kind, sign, frames)):
                column.append(value)

        # only stems with a marker, filler or a word of messages, and short pages, can be residue; or with letters that hide one
        suspects = [(q, s) for q, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if s and (_suspect(s) or latin_bytes(s) is None)]
        odd = [i for i, (_, s) in enumerate(suspects) if latin_bytes(s) is None]
        if odd:  # in the consistent form, their words meet those of other records
            unifier = unifier or Unifier()
            for i, form in zip(odd, unifier.unify(pa.array([suspects[i][1] for i in odd], pa.string())).to_pylist()):
                suspects[i] = (suspects[i][0], form)
        for qid, stem in suspects:
            if not stem.strip():
                continue
            low = _low(_clean(stem))
            tokens = low.split()
            words = WORD.findall(_clean(stem).lower()) if len(stem) <= SHORT_PAGE or len(tokens) <= 8 else []
            spoken = said(low, tokens)
            found, bare = _markers(stem) if any(map(stem.__contains__, SUSPECT)) else ([], False)
            if RUN in bytes(map(FILLER_BYTES.__contains__, tokens)) or filler_run(words) or (bare and found):
                add(qid, "certain", "", [])
                continue
            for kind, text, (b2, b1, a1, a2) in found:
                hb = hashes.of([b2, b1, a1, a2])
                add(qid, kind, text, _signed([_mix(hb[1:2], hb[2:3], 1)[0], _mix(hb[0:1], hb[1:2], 2)[0], _mix(hb[2:3], hb[3:4], 3)[0]]))
            if len(stem) <= SHORT_PAGE:
                h = hashes.of(tokens)
                pairs = np.unique(_mix(h[:-1], h[1:], 4)) if len(h) > 1 else h
                mask = _mask(_clean(stem))
                speaks = spoken or (b"4" in low or b"5" in low) and SPEAKS.search(stem)
                terse = len(words) <= 10 and "?" not in stem and speaks
                add(qid, "page!" if terse and STATUS.match(stem) else "page-" if terse else "page+" if speaks else "page", mask, _signed(pairs))
            if not may_be_message(low, spoken):
                continue
            for kind, mask, tokens, telling in _messages(_clean(stem)):
                if kind != "ask" and filler_run(WORD.findall(mask)):
                    add(qid, "certain", "", [])
                elif any(telling):
                    h = hashes.of(tokens)
                    add(qid, kind, mask, _signed(np.unique(_mix(h[:-1], h[1:], 4)[telling] ^ CALM)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())))], names)


def _signed(values: list | np.ndarray) -> list[int]:
    return np.asarray(values, dtype=np.uint64).view(np.int64).tolist()


def _frames(wanted: bytes):  # noqa: ANN202
    """Counts, over all stems, of the frames and word pairs whose bit is set in wanted."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = TokenHashes(), np.frombuffer(wanted, dtype=np.uint8)
        mark = np.uint64(hashes[MARK])
        for batch in batches:
            texts = [s for s in batch.column(0).to_pylist() if s]
            if not texts:
                continue
            stems, calm = zip(*map(_words, texts))
            sizes = np.array([len(s) for s in stems])
            h = hashes.of([w for s in stems for w in s])
            row = np.repeat(np.arange(len(stems)), sizes)
            long = np.repeat([len(s) > SHORT_PAGE for s in texts], sizes)
            at = np.arange(2, len(h) - 2)
            ends = np.cumsum(sizes)
            inside = (at >= (ends - sizes)[row[at]] + 2) & (at < ends[row[at]] - 2) & (h[at] != mark)
            at = at[inside]
            pair = np.arange(len(h) - 1)
            pair = pair[(row[:-1] == row[1:]) & long[:-1]]
            pairs = _mix(h[pair], h[pair + 1], 4)
            quiet = np.ones(len(h), bool)
            for i in (i for i, c in enumerate(calm) if c is not None):
                quiet[ends[i] - sizes[i] : ends[i]] = calm[i]
            keys = np.concatenate([_mix(h[at - 1], h[at + 1], 1), _mix(h[at - 2], h[at - 1], 2), _mix(h[at + 1], h[at + 2], 3), pairs, pairs[quiet[pair] & quiet[pair + 1]] ^ CALM])
            slot = keys & np.uint64((1 << BITS) - 1)
            keys = keys[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            frames, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(frames.view(np.int64)), pa.array(counts.astype(np.int64))], ["frame", "n"])

    return each


def _wanted_bits(signs: DataFrame) -> bytes:
    """The frames asked for, as a bitmap of 2^BITS bits: 2 MB whatever the size of the data."""
    slots = signs.select(F.explode("frames").alias("f")).select(F.expr(f"cast(f & {(1 << BITS) - 1} as int)").alias("slot"))
    words = slots.groupBy(F.expr("slot >> 3").alias("byte")).agg(F.bit_or(F.expr("cast(shiftleft(1, slot & 7) as int)")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    table = words.toArrow()
    bitmap[table.column("byte").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return bitmap.tobytes()


def template_residue(questions: DataFrame, id_col: str = "id", text_col: str = "stem") -> DataFrame:
    """(question_id) of the rows whose text is, or contains, template residue, filler or a site's message."""
    stems = questions.select(F.col(id_col).alias("question_id"), F.col(text_col).alias("stem"))
    signs = stems.mapInArrow(_signs, "question_id string, kind string, sign string, frames array<long>").withColumn("sid", F.xxhash64("question_id", "kind", "sign")).persist()
    wanted = questions.sparkSession.sparkContext.broadcast(_wanted_bits(signs))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frames(wanted.value)(batches)

    ordinary = stems.select("stem").mapInArrow(counted, "frame long, n long").groupBy("frame").agg(F.sum("n").alias("ordinary"))
    # only numbers are shuffled with the frames
    asked = signs.select("sid", "kind", F.xxhash64("sign").alias("own"), F.posexplode_outer("frames").alias("at", "frame"))
    # a frame of markers only: how many records keep it, and whether they keep the same one
    kept = asked.filter(F.col("kind").isin("v", "d", "a")).groupBy("frame").agg(F.count("*").alias("kept"), F.min("own").alias("s0"), F.max("own").alias("s1"))
    # a pair of possible messages: in how many templates, as bits: two may fall on one
    spoken = asked.filter("kind IN ('part', 'ask')").groupBy("frame").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(own & 63 as int))"))).alias("templates"))
    judged = asked.select("sid", "at", "frame").join(ordinary, "frame", "left").join(kept, "frame", "left").join(spoken, "frame", "left")
    slot = F.col("ordinary") >= F.col("kept")
    varied = F.col("s0") != F.col("s1")
    constant = (F.col("kept") >= 3) & ~varied & (F.coalesce("ordinary", F.lit(0)) * 2 < F.col("kept"))
    per = judged.groupBy("sid").agg(
        F.max(F.coalesce(slot, F.lit(False))).alias("slot"),
        F.max(F.coalesce(slot & (F.col("at") == 0), F.lit(False))).alias("between"),
        F.max(F.coalesce(varied, F.lit(False))).alias("varied"),
        F.max(F.coalesce(constant, F.lit(False))).alias("constant"),
        F.avg(((F.coalesce("ordinary", F.lit(0)) > 0) | (F.coalesce("templates", F.lit(0)) >= TEMPLATES)).cast("double")).alias("known"),
    )
    pages = signs.filter(F.col("kind").startswith("page")).groupBy("sign").agg(F.count("*").alias("pages"))
    per = signs.select("sid", "question_id", "kind", "sign").join(per, "sid").join(pages, "sign", "left")
    residue = (
        (F.col("kind") == "certain")
        | (F.col("kind").isin("v", "d") & (F.col("slot") | F.col("varied") | ~F.col("constant")))
        | ((F.col("kind") == "a") & F.col("between") & ~F.col("constant"))
        | (F.col("kind") == "page!")
        | (F.col("kind").isin("page+", "page-") & (F.col("known") < 0.5))
        | ((F.col("kind") == "page-") & (F.col("pages") >= 2))
        | (F.col("kind").isin("part", "whole") & (F.col("known") < 0.2))
        | ((F.col("kind") == "page") & (F.col("known") < 0.2) & (F.col("pages") >= 2))
    )
    return per.filter(residue).select("question_id").distinct()
