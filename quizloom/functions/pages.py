"""Functions on extracted page text: quality, line cleaning, marker splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and sizes of the quality score, and the marks it counts.
TEXT_WEIGHT, TEXT_FULL, MARK_WEIGHT, MARK_FULL = 0.65, 7000.0, 0.35, 10.0
MARKERS = r"(?im)^\s*\d+\.\s|^\s*\d+\)\s|^\s*DOMANDA\s+\d+|DOMANDA\s+TEORIA|ESERCIZIO\s+\d+"
# Lines that belong to the form of an exam sheet.
FORM_STARTS = ("studente", "risposte")
FORM_WORDS = ("corrette", "teoria", "tot")
# Where a question or option begins inside a line, and what the break is put before.
SPLITS = (
    (r"(?i)(?<!\n)\bDOMANDA\s+(\d+)\b", "\nDOMANDA $1"),
    (r"(?<!\n)(\d{1,3}\)\s)", "\n$1"),
    (r"(?<!^)\s(\d{1,2}\.\s)", "\n$1"),
    (r"(?i)(?<!^)\s([a-d]\.\s)", "\n$1"),
)
#: The light form splits neither at headings nor before numbers with a bracket.
LIGHT_SPLITS = SPLITS[2:]
#: Least quality at which an extraction is good enough, by which the ladder of extractors stops.
GOOD = 0.45


def quality(text: Column) -> Column:
    """0 to 1 from the text's length without white space and its number of question marks; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(F.regexp_replace(text, r"[\s\x0b\u00a0\u2000-\u200a\u202f\u205f\u3000]+", ""))
    marks = F.regexp_count(text, F.lit(MARKERS))
    score = TEXT_WEIGHT * F.least(F.lit(1.0), size / TEXT_FULL) + MARK_WEIGHT * F.least(F.lit(1.0), marks / MARK_FULL)
    return F.round(score + 1e-9, 3)  # halves that binary fractions put just below go up


def clean_lines(text: Column) -> Column:
    """The trimmed lines that are neither blank, page footers nor part of the exam form."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^[\s\x0b\u00a0]+|[\s\x0b\u00a0]+$", ""))

    def kept(x: Column) -> Column:
        low = F.lower(x)
        form = F.startswith(low, F.lit(FORM_STARTS[0])) | F.startswith(low, F.lit(FORM_STARTS[1])) | low.isin(*FORM_WORDS) | (F.contains(low, F.lit("cognome")) & F.contains(low, F.lit("matricola")))
        return (x != "") & ~(F.startswith(x, F.lit("-- ")) & F.contains(x, F.lit(" of "))) & ~form

    return F.filter(lines, kept)


def split_markers(text: Column, splits: tuple[tuple[str, str], ...] = SPLITS) -> Column:
    """A line break before every mark that begins a question or an option inside a line."""
    out = F.translate(text, "\t", " ")
    for pattern, put in splits:
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, " {2,}", " ")


def extraction_ladder(extractions: dict[str, Column]) -> Column:
    """(method, quality, text, is_weak) of the first extraction, in the given order, that is good enough with the ones before
    it; else the best of all, the earlier on ties. A null text is an extraction that gave nothing.

    Each step is a conditional, so that a later extraction is only made where all earlier ones are weak.
    """
    best = None
    for method, text in extractions.items():
        own = F.struct(F.lit(method).alias("method"), quality(text).alias("quality"), text.alias("text"))
        best = own if best is None else F.when(best["quality"] >= GOOD, best).otherwise(F.when(own["quality"] > best["quality"], own).otherwise(best))
    return F.struct(best["method"].alias("method"), best["quality"].alias("quality"), best["text"].alias("text"), (best["quality"] < GOOD).alias("is_weak"))
