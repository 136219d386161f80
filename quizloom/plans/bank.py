"""Duplicates, occurrences and the normalised bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions import items as I
from quizloom.functions import text as X
from quizloom.operators import evidence as E
from quizloom.operators import merge as M
from quizloom.operators import schedule as S
from quizloom.operators import tags as G
from quizloom.plans.queryset import Tables, query
from quizloom.plans.text import FINGERPRINTS, with_fingerprint

SCORE = f"round(coalesce(confidence::DOUBLE, 0.0) + least(0.5, length({X.sql_clean('stem')}) / 2000.0), 9)"
RANKED = f"(SELECT id, fingerprint, stem, row_number() OVER (PARTITION BY fingerprint ORDER BY is_discarded, {SCORE} DESC, id) AS rank, first_value(id) OVER (PARTITION BY fingerprint ORDER BY is_discarded, {SCORE} DESC, id) AS keeper_id FROM {FINGERPRINTS})"


@query(f"""
SELECT fingerprint, count(*) AS occurrences, max(keeper_id) AS keeper_id, max(CASE WHEN rank = 1 THEN left({X.sql_clean('stem')}, 180) END) AS sample_stem
FROM {RANKED} GROUP BY fingerprint HAVING count(*) > 1 ORDER BY count(*) DESC, fingerprint LIMIT 50""")
def dedupe_groups(t: Tables) -> DataFrame:
    """The fifty largest duplicate groups."""
    own = with_fingerprint(t.questions).select("fingerprint", M.order_of_survival().alias("rank"), F.substring(X.clean_text(F.col("stem")), 1, 180).alias("stem"))
    groups = own.groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.min(F.struct("rank", "stem")).alias("best")).filter("occurrences > 1")
    return groups.select("fingerprint", "occurrences", F.col("best.rank.id").alias("keeper_id"), F.col("best.stem").alias("sample_stem")).orderBy(F.desc("occurrences"), "fingerprint").limit(50)


@query(f"SELECT id AS question_id, keeper_id FROM {RANKED} WHERE id <> keeper_id")
def dedupe_keeper(t: Tables) -> DataFrame:
    """Each duplicate with the record that survives it."""
    return M.keeper_map(with_fingerprint(t.questions)).filter("question_id <> keeper_id").select("question_id", "keeper_id")


@query("""
SELECT q.id AS question_id, q.document_id, d.title AS source_file_name, q.section AS source_section, q.number_in_section AS source_number
FROM questions q JOIN exam_documents d ON d.id = q.document_id
WHERE NOT EXISTS (SELECT 1 FROM question_occurrences o WHERE o.question_id = q.id AND o.document_id = q.document_id AND o.source_section = q.section AND o.source_number = q.number_in_section)""")
def occurrence_backfill(t: Tables) -> DataFrame:
    """The occurrence each question has by itself, unless it is known; keys with nulls never meet."""
    docs = t.exam_documents.select(F.col("id").alias("document_id"), F.col("title").alias("source_file_name"))
    own = t.questions.select(F.col("id").alias("question_id"), "document_id", F.col("section").alias("source_section"), F.col("number_in_section").alias("source_number")).join(docs, "document_id")
    keys = ["question_id", "document_id", "source_section", "source_number"]
    return own.join(t.question_occurrences.select(*keys), keys, "left_anti").select("question_id", "document_id", "source_file_name", "source_section", "source_number")


@query("""
WITH u AS (SELECT DISTINCT question_id, document_id, source_section, source_number, source_file_name FROM question_occurrences),
a AS (SELECT question_id, count(*) AS n, string_agg(DISTINCT source_file_name, '; ' ORDER BY source_file_name) AS files FROM u GROUP BY question_id)
SELECT q.id, coalesce(a.n, q.occurrences_count)::BIGINT AS occurrences_count, coalesce(a.files, '') AS source_files, coalesce(a.n <> q.occurrences_count, false) AS was_stale FROM questions q LEFT JOIN a ON a.question_id = q.id""")
def occurrence_aggregates(t: Tables) -> DataFrame:
    """Counts and files refreshed from the occurrences; questions without any keep what they have."""
    unique = t.question_occurrences.select("question_id", "document_id", "source_section", "source_number", "source_file_name").distinct()
    agg = unique.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_file_name")), "; ").alias("files"))
    out = t.questions.select("id", "occurrences_count").join(agg, "id", "left")
    return out.select("id", F.coalesce("n", F.col("occurrences_count").cast("long")).alias("occurrences_count"), F.coalesce("files", F.lit("")).alias("source_files"), F.coalesce(F.col("n") != F.col("occurrences_count"), F.lit(False)).alias("was_stale"))


@query(f"""
WITH k AS {RANKED}, s AS ({S.SQL_STATE})
SELECT s.user_id, k.keeper_id AS question_id, min(due_at) AS due_at, max(lapses) AS lapses, max(reps) AS reps, max(last_reviewed_at) AS last_reviewed_at
FROM s JOIN k ON k.id = s.question_id GROUP BY ALL""")
def merge_schedule(t: Tables) -> DataFrame:
    """Schedules of duplicates united at the survivor: earliest due, most lapses and repetitions, latest review."""
    own = M.repointed(S.schedule_state(E.deduplicated_attempts(t.attempts)), M.keeper_map(with_fingerprint(t.questions)))
    return own.groupBy("user_id", "question_id").agg(F.min("due_at").alias("due_at"), F.max("lapses").alias("lapses"), F.max("reps").alias("reps"), F.max("last_reviewed_at").alias("last_reviewed_at"))


@query(f"""
WITH k AS {RANKED}, r AS (SELECT user_id, question_id, arg_max(is_correct, (answered_at, id)) AS correct, min(answered_at) AS first_seen_at, max(answered_at) AS reviewed_at FROM (SELECT DISTINCT ON (id) * FROM attempts) GROUP BY ALL)
SELECT r.user_id, k.keeper_id AS question_id, CASE WHEN bool_or(correct) THEN 'correct' ELSE 'wrong' END AS status, min(first_seen_at) AS first_seen_at, max(reviewed_at) AS reviewed_at
FROM r JOIN k ON k.id = r.question_id GROUP BY r.user_id, k.keeper_id""")
def merge_reviews(t: Tables) -> DataFrame:
    """Reviews (each user's last answer) united at the survivor: correct wins."""
    last = E.deduplicated_attempts(t.attempts).groupBy("user_id", "question_id").agg(
        F.max(F.struct("answered_at", "id", "is_correct"))["is_correct"].alias("correct"), F.min("answered_at").alias("first_seen_at"), F.max("answered_at").alias("reviewed_at")
    )
    own = M.repointed(last, M.keeper_map(with_fingerprint(t.questions))).groupBy("user_id", "question_id")
    return own.agg(F.when(F.bool_or("correct"), "correct").otherwise("wrong").alias("status"), F.min("first_seen_at").alias("first_seen_at"), F.max("reviewed_at").alias("reviewed_at"))


@query(f"""
WITH k AS {RANKED}, c AS (SELECT c.user_id, k.keeper_id AS question_id, k.rank, c.* EXCLUDE (user_id, question_id) FROM question_corrections c JOIN k ON k.id = c.question_id)
SELECT user_id, question_id, arg_min(correct_option_id, rank) FILTER (WHERE correct_option_id IS NOT NULL) AS correct_option_id,
  arg_min(explanation_text, rank) FILTER (WHERE coalesce(trim(explanation_text, ' '), '') <> '') AS explanation_text,
  arg_min(answer_payload, rank) FILTER (WHERE coalesce(regexp_replace(answer_payload, '\\s', '', 'g'), '{{}}') <> '{{}}') AS answer_payload,
  min(first_seen_at) AS first_seen_at, max(reviewed_at) AS reviewed_at FROM c GROUP BY ALL""")
def merge_corrections(t: Tables) -> DataFrame:
    """Corrections united at the survivor: field by field the first that is not empty, the survivor's own before others'."""
    own = M.repointed(t.question_corrections, M.keeper_map(with_fingerprint(t.questions))).groupBy("user_id", "question_id")
    option, text, payload = F.col("correct_option_id"), F.col("explanation_text"), F.col("answer_payload")
    return own.agg(
        M.first_filled(option, option.isNotNull()).alias("correct_option_id"), M.first_filled(text, E.present(text)).alias("explanation_text"),
        M.first_filled(payload, F.coalesce(F.regexp_replace(payload, r"\s", ""), F.lit("{}")) != "{}").alias("answer_payload"), F.min("first_seen_at").alias("first_seen_at"), F.max("reviewed_at").alias("reviewed_at"),
    )


@query(f"WITH k AS {RANKED}, g AS ({G.sql_rule_tags()}) SELECT k.keeper_id AS question_id, g.slug, max(g.score) AS score FROM g JOIN k ON k.id = g.id GROUP BY ALL")
def merge_tags(t: Tables) -> DataFrame:
    """Tags united at the survivor with the best score."""
    own = M.repointed(G.rule_tags(t.questions).withColumnRenamed("id", "question_id"), M.keeper_map(with_fingerprint(t.questions)))
    return own.groupBy("question_id", "slug").agg(F.max("score").alias("score"))


@query("""
WITH d AS (SELECT id, sha256, title, first_value(id) OVER (PARTITION BY sha256 ORDER BY created_at NULLS LAST, id) AS first_id FROM exam_documents)
SELECT id, first_id, id = first_id AS is_first FROM d""")
def content_hash_dedupe(t: Tables) -> DataFrame:
    """Files by content hash: the first upload of each stays."""
    order = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "id")
    first = t.exam_documents.groupBy(F.col("sha256").alias("hash")).agg(F.min(order)["id"].alias("first_id"))
    out = t.exam_documents.join(first, F.col("sha256").eqNullSafe(F.col("hash")))
    return out.select("id", "first_id", (F.col("id") == F.col("first_id")).alias("is_first"))


KIND = "CASE WHEN question_type IN ('multiple_choice', 'open_text', 'multi_part_open') THEN question_type ELSE 'open_text' END"
SECTION = f"CASE WHEN section IN ('quiz', 'teoria', 'esercizio') THEN section WHEN {KIND} = 'multi_part_open' THEN 'esercizio' ELSE 'quiz' END"


@query(f"""
SELECT raw_id, {KIND} AS question_type, {SECTION} AS section, row_number() OVER (PARTITION BY document_id, {SECTION} ORDER BY raw_id)::INTEGER AS number_in_section,
  greatest(0.0, least(1.0, coalesce(round(confidence, 2), 0.75)))::DECIMAL(3,2) AS confidence, greatest(1, coalesce(page_number, 1)) AS page, len(list_distinct(coalesce(tags, [])))::INTEGER AS n_tags FROM incoming_questions""")
def bank_normalize(t: Tables) -> DataFrame:
    """Raw records with types and sections coerced, numbers clamped, and a running number in each document's section."""
    from pyspark.sql import Window

    raw = t.incoming_questions
    kind = F.when(F.col("question_type").isin("multiple_choice", "open_text", "multi_part_open"), F.col("question_type")).otherwise("open_text")
    section = F.when(F.col("section").isin("quiz", "teoria", "esercizio"), F.col("section")).when(kind == "multi_part_open", "esercizio").otherwise("quiz")
    own = raw.withColumn("question_type", kind).withColumn("section", section)
    number = F.row_number().over(Window.partitionBy("document_id", "section").orderBy("raw_id"))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.round("confidence", 2), F.lit(0.75)))).cast("decimal(3,2)")
    return own.select("raw_id", "question_type", "section", number.alias("number_in_section"), confidence.alias("confidence"), F.greatest(F.lit(1), F.coalesce("page_number", F.lit(1))).alias("page"), F.coalesce(F.size(F.array_distinct("tags")), F.lit(0)).alias("n_tags"))


RAW_PRINT = f"(SELECT *, {I.sql_fingerprint()} AS fingerprint FROM (SELECT *, {I.sql_options()} AS o, {I.sql_subparts()} AS s FROM incoming_questions))"


@query(f"""
SELECT fingerprint, count(*) AS occurrences_count, round(max(coalesce(confidence, 0.0)), 6) AS confidence_max, arg_min(stem, (-length(stem), raw_id)) AS stem, arg_min(raw_id, (-len(o), raw_id)) AS options_from,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS tags, string_agg(DISTINCT source_file, '; ' ORDER BY source_file) AS files FROM {RAW_PRINT} GROUP BY fingerprint""")
def bank_merge(t: Tables) -> DataFrame:
    """Raw records of one fingerprint as one: tags united, best confidence, longest stem and option list, files."""
    raw = with_fingerprint(t.incoming_questions)
    n = F.size(I.clean_options(F.col("options_json")))
    tags = raw.select("fingerprint", F.explode("tags").alias("tag")).distinct().groupBy("fingerprint").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    out = raw.groupBy("fingerprint").agg(
        F.count("*").alias("occurrences_count"), F.round(F.max(F.coalesce("confidence", F.lit(0.0))), 6).alias("confidence_max"),
        F.min(F.struct((-F.length("stem")).alias("n"), "raw_id", "stem"))["stem"].alias("stem"), F.min(F.struct((-n).alias("n"), "raw_id"))["raw_id"].alias("options_from"),
        F.array_join(F.array_sort(F.collect_set("source_file")), "; ").alias("files"),
    )
    return out.join(tags, "fingerprint", "left").select("fingerprint", "occurrences_count", "confidence_max", "stem", "options_from", F.coalesce("tags", F.lit("")).alias("tags"), F.when(F.col("files") != "", F.col("files")).alias("files"))


@query(f"""
WITH f AS (SELECT raw_id, document_id, confidence, sha1(question_type || '##' || {X.sql_canonical('stem')} || '##' || array_to_string(list_transform(o, lambda x: {X.sql_option('x.text')}), '|')) AS fingerprint FROM (SELECT *, {I.sql_options()} AS o FROM incoming_questions))
SELECT fingerprint, count(*) AS occurrences_count, count(DISTINCT document_id) AS documents, min(raw_id) AS first_raw_id, round(max(confidence), 6) AS confidence_max FROM f GROUP BY fingerprint HAVING count(*) > 1""")
def dup_occurrence_report(t: Tables) -> DataFrame:
    """Raw records that repeat by the second fingerprint."""
    own = I.plain_fingerprint(F.col("question_type"), F.col("stem"), I.clean_options(F.col("options_json")))
    out = t.incoming_questions.withColumn("fingerprint", own).groupBy("fingerprint")
    return out.agg(F.count("*").alias("occurrences_count"), F.countDistinct("document_id").alias("documents"), F.min("raw_id").alias("first_raw_id"), F.round(F.max("confidence"), 6).alias("confidence_max")).filter("occurrences_count > 1")
