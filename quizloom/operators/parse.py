"""Typed questions from the lines of an exam sheet.

Lines are cleaned and split by column functions; what is left is a grammar over the line
kinds, run in Arrow batches over whole documents. A document is one row, so documents are
parsed in parallel and no group is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions import pages

# What each kind of line looks like.
KINDS = (
    ("theory", re.compile(r"\s*DOMANDA\s+TEORIA", re.I)),
    ("exercise", re.compile(r"\s*ESERCIZIO\s+(\d+)", re.I)),
    ("question", re.compile(r"\s*DOMANDA\s+(\d+)\s*$", re.I)),
    ("item", re.compile(r"\s*(\d+)[.)]\s+(.*)$")),
    ("option", re.compile(r"\s*([a-d])\.\s+(.*)$", re.I)),
)
SUBPART = re.compile(r"\s*(\d+)\)\s+(.*)$")
# Confidence by how a question was found.
CONFIDENCE = {"theory": 0.9, "exercise": 0.85, "choice": 0.95, "thin": 0.6, "open": 0.75}


@dataclass
class Found:
    section: str
    number: int
    kind: str
    stem: str
    confidence: float
    needs_review: bool = False
    options: list[tuple[str, str]] = field(default_factory=list)
    subparts: list[tuple[str, str]] = field(default_factory=list)


def kind_of(line: str) -> tuple[str, re.Match | None]:
    for name, pattern in KINDS:
        if m := pattern.match(line):
            return name, m
    return "text", None


def blocks(lines: list[str]) -> Iterator[tuple[str, re.Match | None, list[str]]]:
    """The sheet cut into blocks: (kind, match of the first line, all its lines).

    Theory and exercises run to the next exercise; a question or item to the next line that
    begins anything; items count as questions only in the quiz, before either of them.
    """
    start, quiz = 0, True
    while start < len(lines):
        kind, match = kind_of(lines[start])
        end = start + 1
        if kind in ("theory", "exercise"):
            quiz = False
            while end < len(lines) and kind_of(lines[end])[0] != "exercise":
                end += 1
        elif kind == "question" or kind == "item" and quiz:
            quiz = True
            while end < len(lines) and kind_of(lines[end])[0] in ("text", "option"):
                end += 1
        else:
            kind = "skip"
        yield kind, match, lines[start:end]
        start = end


def parse(lines: list[str]) -> list[Found]:
    """The questions of a sheet, ordered by section and number; numbers taken already move up."""
    out: list[Found] = []
    taken: dict[str, set[int]] = {"quiz": set(), "teoria": set()}
    count = {"teoria": 0, "esercizio": 0}

    def free(section: str, number: int) -> int:
        while number in taken[section]:
            number += 1
        taken[section].add(number)
        return number

    for kind, match, own in blocks(lines):
        if kind == "theory":
            stem = " ".join(own[1:]).strip()
            if stem:
                count["teoria"] += 1
                out.append(Found("teoria", count["teoria"], "open_text", stem, CONFIDENCE["theory"]))
        elif kind == "exercise":
            parts = [(m.group(1), m.group(2).strip()) for x in own[1:] if (m := re.match(r"\s*(\d+)\)\s+(.*)$", x))]
            stem = " ".join([own[0], *(x for x in own[1:] if not re.match(r"\s*\d+\)\s+", x))]).strip()
            count["esercizio"] += 1
            out.append(Found("esercizio", count["esercizio"], "multi_part_open" if parts else "open_text", stem, CONFIDENCE["exercise"], subparts=parts))
        elif kind in ("question", "item"):
            options = [(m.group(1).lower(), m.group(2).strip()) for x in own[1:] if (m := KINDS[4][1].match(x))]
            head = []
            for x in own[1:]:
                if KINDS[4][1].match(x):
                    break
                head.append(x.strip())
            stem = " ".join([match.group(2).strip(), *head] if kind == "item" else head).strip()
            number = int(match.group(1))
            if kind == "item" and len(options) < 2:
                count["teoria"] += 1
                out.append(Found("teoria", free("teoria", count["teoria"]), "open_text", stem, CONFIDENCE["open"], True))
            else:
                thin = len(options) < 2
                out.append(Found("quiz", free("quiz", number), "multiple_choice", stem, CONFIDENCE["thin" if thin else "choice"], thin, options))
    return sorted(out, key=lambda q: (q.section, q.number))


#: What begins a question in the light form of the parser.
LIGHT_ITEM = re.compile(r"\s*(\d+)\.\s+(.*)$")


def parse_light(lines: list[str]) -> list[Found]:
    """The questions of a sheet in its order, by the light form: only numbers with a dot begin a question, all of them before
    theory and exercises, each a multiple choice whatever its options; numbers stay as they are."""
    out: list[Found] = []
    count = {"teoria": 0, "esercizio": 0}
    at = [i for i, x in enumerate(lines) if KINDS[0][1].match(x) or KINDS[1][1].match(x)]
    first = at[0] if at else len(lines)
    starts = [i for i in range(first) if LIGHT_ITEM.match(lines[i])]
    for start, end in zip(starts, [*starts[1:], first]):
        m, own = LIGHT_ITEM.match(lines[start]), lines[start + 1 : end]
        options = [(o.group(1).lower(), o.group(2)) for x in own if (o := KINDS[4][1].match(x))]
        until = next((i for i, x in enumerate(own) if KINDS[4][1].match(x)), len(own))
        out.append(Found("quiz", int(m.group(1)), "multiple_choice", " ".join([m.group(2), *own[:until]]).strip(), CONFIDENCE["choice"], options=options))
    # theory runs to the next exercise, whatever stands between; so does an exercise
    while first < len(lines):
        theory = bool(KINDS[0][1].match(lines[first]))
        end = next((i for i in range(first + 1, len(lines)) if KINDS[1][1].match(lines[i])), len(lines))
        section = "teoria" if theory else "esercizio"
        count[section] += 1
        parts = [] if theory else [(m.group(1), m.group(2).strip()) for x in lines[first + 1 : end] if (m := SUBPART.match(x))]
        body = lines[first + 1 : end] if theory else [lines[first], *(x for x in lines[first + 1 : end] if not SUBPART.match(x))]
        out.append(Found(section, count[section], "multi_part_open" if parts else "open_text", " ".join(body).strip(), CONFIDENCE["theory" if theory else "exercise"], subparts=parts))
        first = end
    return out


SCHEMA = "id string, section string, number_in_section int, question_type string, stem string, options_json string, subparts_json string, confidence double, needs_review boolean"


def parse_documents(texts: DataFrame, light: bool = False) -> DataFrame:
    """Questions of (id, text) rows, by the light form if asked for; null and empty texts give none."""
    import json

    lines = pages.split_markers(F.array_join(pages.clean_lines(F.col("text")), "\n"), pages.LIGHT_SPLITS if light else pages.SPLITS)
    parser = parse_light if light else parse

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for q in parser(text.split("\n")) if text else ():
                    options = json.dumps([{"id": a, "text": b} for a, b in q.options], ensure_ascii=False)
                    subparts = json.dumps([{"id": a, "prompt": b} for a, b in q.subparts], ensure_ascii=False)
                    rows.append((doc, q.section, q.number, q.kind, q.stem, options, subparts, q.confidence, q.needs_review))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return texts.select(F.col("id").cast("string").alias("id"), lines.alias("lines")).mapInArrow(each, SCHEMA)
