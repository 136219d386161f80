"""Problem 7: text that looks the same, brought to one form.

DuckDB runs inside the Arrow partitions of Spark: each batch is registered as a table
and one embedded SQL statement maps full-width forms and ligatures, composes accents,
drops invisible characters, turns every space into U+0020 and replaces Cyrillic and
Greek letters that stand for Latin ones. A null stays null, an empty text stays empty;
line breaks are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters and the Latin letters they stand for.
CYRILLIC = "аеорсухіѕјһԛԝкАВЕЅКМНОРСТУХІЈԚԜҺ"
CYRILLIC_AS = "aeopcyxisjhqwkABESKMHOPCTYXIJQWH"
GREEK = "ονραικτυχγηωϲΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_AS = "ovpaiktuxynwcABEZHIKMNOPTYXC"

FULL_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULL_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

FULL_WIDTH = r"[\x{FF01}-\x{FF5E}\x{3000}]"
COMBINING = r"[\x{0300}-\x{036F}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
NO_BREAK = r"[\x{00A0}\x{2007}\x{202F}]"
ANY_SPACE = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
OTHER_CYRILLIC = r"[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ]".replace("к", "")
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬅ", "st"), ("ﬆ", "st"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _stands_in() -> str:
    """SQL over a space-free token x: do its Cyrillic or Greek letters stand for Latin ones?

    Cyrillic: look-alikes only, none of the letters that have no Latin twin. Greek: next to
    a Latin (or Cyrillic look-alike) letter, a capital right after a digit, a lone omicron, or
    three look-alikes and no other letter; a letter alone (ρ, Μ) and a unit (ΜS, μs) are symbols.
    """
    bare = "regexp_replace(x, '[^\\p{L}]', '', 'g')"
    cyr, gre = f"[{CYRILLIC}]", f"[{GREEK}]"
    return (
        f"((regexp_matches(x, '{cyr}') AND NOT regexp_matches(x, '{OTHER_CYRILLIC}'))"
        f" OR (regexp_matches(x, '[a-zA-Z]{gre}|{gre}[a-zA-Z]') AND NOT regexp_matches({bare}, '^[μΜµΩ][a-zA-Z]$'))"
        f" OR regexp_matches(x, '[0-9][ΑΒΕΖΗΙΚΝΟΤΥΧ]') OR {bare} IN ('ο', 'Ο') OR regexp_matches({bare}, '^{gre}{{3,}}$'))"
    )


def _ordinary(text: str) -> str:
    """SQL: nothing in the text needs mapping, so that most rows skip the chain."""
    return f"NOT regexp_matches({text}, '[^\\x00-\\x7F\\x{{C0}}-\\x{{FF}}\\x{{2010}}-\\x{{2027}}]|[\\x0B\\x0C]')"


def unified_sql(text: str) -> str:
    """SQL expression giving the consistent form of a text column."""
    base = f"translate({text}, {_quoted(FULL_FROM)}, {_quoted(FULL_TO)})"
    for ligature, letters in LIGATURES:
        base = f"replace({base}, '{ligature}', '{letters}')"
    base = f"regexp_replace(regexp_replace({base}, '{ZERO_WIDTH}', '', 'g'), '{ANY_SPACE}', ' ', 'g')"
    swapped = f"translate(x, {_quoted(CYRILLIC + GREEK)}, {_quoted(CYRILLIC_AS + GREEK_AS)})"
    # accents are composed last: a combining mark may follow a letter that is swapped first
    tokens = f"array_to_string(list_transform(string_split({base}, ' '), lambda x: CASE WHEN {_stands_in()} THEN {swapped} ELSE x END), ' ')"
    return f"CASE WHEN {_ordinary(text)} THEN {text} WHEN regexp_matches({text}, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN nfc_normalize({tokens}) ELSE nfc_normalize({base}) END"


def found_sql(text: str) -> str:
    """SQL expression: does the text hold any of the forms that get mapped?"""
    plain = f"regexp_replace(translate({text}, {_quoted(FULL_FROM)}, {_quoted(FULL_TO)}), '{ZERO_WIDTH}', '', 'g')"
    tokens = f"len(list_filter(string_split_regex({plain}, '[\\s\\x{{00A0}}\\x{{2007}}\\x{{202F}}\\x{{3000}}]+'), lambda x: {_stands_in()})) > 0"
    marks = "|".join((FULL_WIDTH, COMBINING, ZERO_WIDTH, NO_BREAK))
    return (
        f"CASE WHEN {text} IS NULL THEN false WHEN regexp_matches({text}, '{marks}') THEN true"
        f" WHEN regexp_matches({text}, '[\\p{{Greek}}\\p{{Cyrillic}}]') THEN {tokens} ELSE false END"
    )


class Unifier:
    """A DuckDB connection of one Python worker that brings Arrow arrays to the consistent form."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(config={"threads": 1})

    def run(self, select: str, batch: pa.RecordBatch) -> pa.Table:
        self.con.register("batch", pa.Table.from_batches([batch]))
        try:
            return self.con.sql(f"SELECT {select} FROM batch").to_arrow_table()
        finally:
            self.con.unregister("batch")

    def unify(self, texts: pa.Array) -> pa.Array:
        table = self.run(unified_sql("t") + " AS t", pa.RecordBatch.from_arrays([texts], ["t"]))
        return table.column("t").combine_chunks()


def _cast(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.cast(schema).to_batches()


def unify_columns(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """The key columns, each named text column in its consistent form, and for each a flag
    <name>_changed_form telling whether the stored text holds any mapped form.

    Other columns are dropped: join them back on the key. Null texts stay null with a false
    flag; repeated rows each give one row; an empty table gives an empty table.
    """
    fields = [T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(key)]
    fields += [T.StructField(f"t{i}", T.StringType()) for i in range(len(columns))]
    fields += [T.StructField(f"f{i}", T.BooleanType()) for i in range(len(columns))]
    select = ", ".join(
        [f"k{i}" for i in range(len(key))]
        + [f"{unified_sql(f't{i}')} AS t{i}" for i in range(len(columns))]
        + [f"{found_sql(f't{i}')} AS f{i}" for i in range(len(columns))]
    )
    types = [_arrow_type(f.dataType) for f in fields]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unifier = Unifier()
        schema = pa.schema([pa.field(f.name, t) for f, t in zip(fields, types)])
        for batch in batches:
            if batch.num_rows:
                yield from _cast(unifier.run(select, batch), schema)

    short = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(columns)])
    out = short.mapInArrow(each, T.StructType(fields))
    return out.select(
        *[F.col(f"k{i}").alias(k) for i, k in enumerate(key)],
        *[F.col(f"t{i}").alias(c) for i, c in enumerate(columns)],
        *[F.col(f"f{i}").alias(f"{c}_changed_form") for i, c in enumerate(columns)],
    )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


OPTION = "array<struct<id:string,text:string>>"
SUBPART = "array<struct<id:string,prompt:string>>"


def option_texts(json: Column) -> Column:
    """Decoded option texts, one to a line; null if the JSON is null or malformed."""
    return F.array_join(F.from_json(json, OPTION)["text"], "\n")


def subpart_texts(json: Column) -> Column:
    """Decoded subpart prompts, one to a line; null if the JSON is null or malformed."""
    return F.array_join(F.from_json(json, SUBPART)["prompt"], "\n")


def found_forms(questions: DataFrame) -> DataFrame:
    """(question_id, field) of the stems and decoded option texts that hold mapped forms."""
    texts = questions.select(F.col("id").alias("question_id"), "stem", option_texts(F.col("options_json")).alias("options_json"))
    flags = unify_columns(texts, ["stem", "options_json"], ["question_id"])
    fields = F.array(*[F.when(F.col(f"{c}_changed_form"), F.lit(c)) for c in ("stem", "options_json")])
    return flags.select("question_id", F.explode(F.array_compact(fields)).alias("field"))


def unified_questions(questions: DataFrame) -> DataFrame:
    """(question_id, stem, options): every stem and its decoded option texts, one to a line, in the consistent form."""
    texts = questions.select(F.col("id").alias("question_id"), "stem", option_texts(F.col("options_json")).alias("options"))
    return unify_columns(texts, ["stem", "options"], ["question_id"]).select("question_id", "stem", "options")
