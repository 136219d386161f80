"""The pN_ queries: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quizloom.llm import encode, forest, glyphs, mixture, pairs, residue, scans, stuffing, survivors, tiles
from quizloom.sources import tables
from quizloom.sources.tables import spread


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows take far longer to judge than to move: over all cores, if it has fewer splits than there are."""
    return spread(tables.read_table(spark, folder, name))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found_noise(read_table(spark, folder, "questions"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scans.scan_noise(read_table(spark, folder, "questions")).select("question_id", "field", "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(read_table(spark, folder, "question_corrections"), read_table(spark, folder, "questions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return tiles.duplicate_pairs(read_table(spark, folder, "questions"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return tiles.linked_questions(read_table(spark, folder, "questions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.found_survivors(read_table(spark, folder, "questions"))


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.survivors(read_table(spark, folder, "questions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return forest.repeated_records(read_table(spark, folder, "incoming_questions"), read_table(spark, folder, "questions"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.template_residue(read_table(spark, folder, "questions"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.found_forms(read_table(spark, folder, "questions"))


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.unified_questions(read_table(spark, folder, "questions"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_texts(read_table(spark, folder, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixed(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.reached_shares(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_pages(read_table(spark, folder, "documents"))


_ALL = (
    p1_found, p1_repaired, p2_found, p3_found, p3_groups, p4_found, p4_survivors, p5_found, p6_found,
    p7_found, p7_unified, p8_ids, p9_mix, p9_shares, p10_found,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: SQL for DuckDB where it can express an operator; the others are tested against brute force.
_OPTION_LINES = """CASE WHEN json_valid(options_json) AND json_type(options_json) = 'ARRAY'
  THEN array_to_string(list_filter(list_transform(from_json(options_json, '[{"id":"VARCHAR","text":"VARCHAR"}]'), lambda o: o.text), lambda x: x IS NOT NULL), chr(10)) END"""
_LINES = f"(SELECT id, stem, {_OPTION_LINES} AS options FROM questions)"
ORACLES: dict[str, str] = {
    "p4_found": """
        WITH q AS (
          SELECT id, dedupe_fingerprint AS fp, is_discarded, confidence, occurrences_count, updated_at,
            CASE WHEN json_valid(source_files_json) AND json_type(source_files_json) = 'ARRAY'
                 THEN len(list_distinct(from_json(source_files_json, '["VARCHAR"]'))) ELSE 0 END AS files
          FROM questions WHERE dedupe_fingerprint IS NOT NULL),
        r AS (
          SELECT fp, id, count(*) OVER (PARTITION BY fp) AS members,
            row_number() OVER (PARTITION BY fp ORDER BY is_discarded, confidence DESC NULLS LAST, occurrences_count DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS k,
            row_number() OVER (PARTITION BY fp ORDER BY files DESC, id) AS f
          FROM q)
        SELECT fp AS dedupe_fingerprint, max(CASE WHEN k = 1 THEN id END) AS keeper_id, max(CASE WHEN f = 1 THEN id END) AS files_from_id
        FROM r WHERE members > 1 GROUP BY fp""",
    "p7_found": f"""
        SELECT id AS question_id, 'stem' AS field FROM {_LINES} WHERE {glyphs.found_sql("stem")}
        UNION ALL SELECT id, 'options_json' FROM {_LINES} WHERE {glyphs.found_sql("options")}""",
    "p7_unified": f'SELECT id AS question_id, {glyphs.unified_sql("stem")} AS stem, {glyphs.unified_sql("options")} AS options FROM {_LINES}',
}
