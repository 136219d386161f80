"""Options and subparts decoded from JSON, cleaned, re-lettered and fingerprinted.

Null, empty and malformed JSON decode to an empty list; entries without id or text are
dropped. Everything stays in the JVM (higher-order functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizloom.functions import text as X

OPTIONS = "array<struct<id:string,text:string>>"
SUBPARTS = "array<struct<id:string,prompt:string>>"


def decoded(json: Column, kind: str) -> Column:
    return F.coalesce(F.from_json(json, kind), F.array().cast(kind))


def clean_options(json: Column) -> Column:
    """(id in lower case, clean text) of each complete option, sorted by id."""
    own = F.transform(decoded(json, OPTIONS), lambda o: F.struct(F.lower(F.trim(o["id"])).alias("id"), X.clean_text(o["text"]).alias("text")))
    return F.array_sort(F.filter(own, lambda o: (F.coalesce(o["id"], F.lit("")) != "") & (o["text"] != "")))


def clean_subparts(json: Column) -> Column:
    """(id, clean prompt) of each complete subpart, sorted by id."""
    own = F.transform(decoded(json, SUBPARTS), lambda s: F.struct(F.trim(s["id"]).alias("id"), X.clean_text(s["prompt"]).alias("prompt")))
    return F.array_sort(F.filter(own, lambda s: (F.coalesce(s["id"], F.lit("")) != "") & (s["prompt"] != "")))


def first_by_id(options: Column) -> Column:
    """Options with an id seen before dropped: the first of each id stays."""
    ids = F.transform(options, lambda o: o["id"])
    return F.filter(options, lambda o, i: F.array_position(ids, o["id"]) == i + 1)


def relettered(options: Column) -> Column:
    """The options in order of their canonical text as a, b, c ... and, past z, numbers."""
    order = F.array_sort(F.transform(options, lambda o: F.struct(X.canonical_clean(o["text"]).alias("key"), o["id"].alias("old"), o["text"].alias("text"))))
    letter = lambda i: F.when(i < 26, F.chr(i + 97)).otherwise((i + 1).cast("string"))
    return F.transform(order, lambda o, i: F.struct(letter(i).alias("id"), o["text"].alias("text")))


def fingerprint(kind: Column, stem: Column, options: Column, subparts: Column) -> Column:
    """sha1 of type, stem without numbers, options (by text for multiple choice, else by id) and subparts."""
    by_text = F.array_join(F.array_sort(F.transform(options, lambda o: X.canonical_clean(o["text"]))), "||")
    by_id = F.array_join(F.transform(options, lambda o: F.concat(o["id"], F.lit(":"), X.canonical_clean(o["text"]))), "|")
    parts = F.array_sort(F.transform(subparts, lambda s: F.struct(s["id"].alias("id"), X.canonical_text(s["prompt"]).alias("p"))))
    by_part = F.array_join(F.transform(parts, lambda s: F.concat(s["id"], F.lit(":"), s["p"])), "|")
    return F.sha1(F.concat_ws("##", kind, X.without_numbers(X.canonical_text(stem)), F.when(kind == "multiple_choice", by_text).otherwise(by_id), by_part))


def plain_fingerprint(kind: Column, stem: Column, options: Column) -> Column:
    """sha1 of type, canonical stem with its numbers, and canonical options in given order."""
    own = F.array_join(F.transform(options, lambda o: X.canonical_clean(o["text"])), "|")
    return F.sha1(F.concat_ws("##", kind, X.canonical_text(stem), own))


def uuid5(namespace: bytes, name: Column) -> Column:
    """Version-5 UUID of a name, from its SHA-1 alone."""
    h = F.sha1(F.concat(F.lit(namespace), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sql_options(json: str = "options_json") -> str:
    own = f"CASE WHEN json_valid({json}) AND json_type({json}) = 'ARRAY' THEN from_json({json}, '[{{\"id\":\"VARCHAR\",\"text\":\"VARCHAR\"}}]') ELSE [] END"
    clean = f"list_transform({own}, lambda o: {{'id': lower(trim(o.id)), 'text': {X.sql_clean('o.text')}}})"
    return f"list_sort(list_filter({clean}, lambda o: coalesce(o.id, '') <> '' AND o.text <> ''))"


def sql_subparts(json: str = "subparts_json") -> str:
    own = f"CASE WHEN json_valid({json}) AND json_type({json}) = 'ARRAY' THEN from_json({json}, '[{{\"id\":\"VARCHAR\",\"prompt\":\"VARCHAR\"}}]') ELSE [] END"
    clean = f"list_transform({own}, lambda o: {{'id': trim(o.id), 'prompt': {X.sql_clean('o.prompt')}}})"
    return f"list_sort(list_filter({clean}, lambda o: coalesce(o.id, '') <> '' AND o.prompt <> ''))"


def sql_fingerprint() -> str:
    by_text = f"array_to_string(list_sort(list_transform(o, lambda x: {X.sql_option('x.text')})), '||')"
    by_id = f"array_to_string(list_transform(o, lambda x: x.id || ':' || {X.sql_option('x.text')}), '|')"
    parts = f"array_to_string(list_transform(list_sort(list_transform(s, lambda x: {{'id': x.id, 'p': {X.sql_canonical('x.prompt')}}})), lambda x: x.id || ':' || x.p), '|')"
    stem = X.sql_without_numbers(X.sql_canonical("stem"))
    return f"sha1(question_type || '##' || {stem} || '##' || CASE WHEN question_type = 'multiple_choice' THEN {by_text} ELSE {by_id} END || '##' || {parts})"
