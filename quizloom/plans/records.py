"""Tags, presets, generated corrections, deletions and jobs as new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.operators import evidence as E
from quizloom.operators import records as R
from quizloom.operators import tags as G
from quizloom.plans.practice import SQL_OPTION
from quizloom.plans.queryset import Tables, query
from quizloom.plans.reports import HAS

NOW = "2025-01-01 00:00:00+00"
SINCE = "2024-06-01 00:00:00+00"
NEW_PRESETS = {"web": ("Pages and their transfer", ["http", "smtp", "unknown"]), "access": ("Access networks", ["dsl", "adsl", "fttx"])}


def moment(text: str) -> F.Column:
    return F.lit(text + ":00").cast("timestamp")


def base_tags(t: Tables) -> DataFrame:
    """(slug, name) of the fixed tags, as a reset database has them."""
    return t.spark.createDataFrame([(slug, slug) for slug in [G.ALWAYS, *G.KEYWORDS]], "slug string, name string")


SQL_BASE = "(VALUES " + ", ".join(f"('{slug}', '{slug}')" for slug in [G.ALWAYS, *G.KEYWORDS]) + ") AS b(slug, name)"
SQL_SLUG = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


@query(f"""
WITH n AS (SELECT trim(course) AS name, created_at AS seen, {SQL_SLUG.format(c='course')} AS slug FROM exam_documents WHERE course IS NOT NULL), l AS (SELECT slug, arg_max(name, (seen, name)) AS name FROM n WHERE slug <> '' GROUP BY slug)
SELECT coalesce(l.slug, b.slug) AS slug, coalesce(l.name, b.name) AS name FROM (SELECT * FROM {SQL_BASE}) b FULL JOIN l ON l.slug = b.slug""")
def tags_by_slug(t: Tables) -> DataFrame:
    """The fixed tags with the courses put in as tags by slug, the latest spelling as name."""
    return R.tags_upserted(base_tags(t), t.exam_documents.filter("course IS NOT NULL").select(F.col("course").alias("name"), F.col("created_at").alias("at")))


@query(f"""
WITH g AS ({G.sql_rule_tags()}), m AS (SELECT id FROM questions WHERE section = 'teoria')
SELECT id, slug, score, 'rule' AS source FROM g WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT id, slug, 1::DECIMAL(3,2), 'manual' FROM m, (VALUES ('reti-wan'), ('dns')) AS s(slug)""")
def tags_set_by_hand(t: Tables) -> DataFrame:
    """Tags of theory questions set by hand: all they had are replaced."""
    return R.manual_tags(G.rule_tags(t.questions).withColumn("source", F.lit("rule")), t.questions.filter("section = 'teoria'"), [" Reti WAN ", "DNS", "", "dns"])


@query(f"""
WITH p AS (SELECT DISTINCT preset, '' AS description FROM {G.sql_presets()}), n AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{d}')" for p, (d, _) in NEW_PRESETS.items())}) AS n(preset, description)),
m AS (SELECT preset, slug FROM {G.sql_presets()} UNION SELECT preset, slug FROM (VALUES {', '.join(f"('{p}', '{s}')" for p, (_, own) in NEW_PRESETS.items() for s in own)}) AS x(preset, slug) WHERE slug IN (SELECT slug FROM {SQL_BASE}))
SELECT coalesce(n.preset, p.preset) AS preset, coalesce(n.description, p.description) AS description, (SELECT string_agg(slug, ',' ORDER BY slug) FROM m WHERE m.preset = coalesce(n.preset, p.preset)) AS slugs
FROM p FULL JOIN n ON n.preset = p.preset""")
def preset_upsert(t: Tables) -> DataFrame:
    """Presets put in by name: descriptions overwritten, members added once, unknown tags left out."""
    members = G.presets(t.spark)
    heads = members.select("preset", F.lit("").alias("description")).distinct()
    presets, members = R.presets_upserted(heads, members, NEW_PRESETS, base_tags(t))
    slugs = members.groupBy("preset").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))
    return presets.join(slugs, "preset", "left").select("preset", "description", "slugs")


GENERATED = f"""
WITH o AS (SELECT * FROM question_corrections WHERE first_seen_at < TIMESTAMPTZ '{SINCE}'), n AS (SELECT user_id, question_id, correct_option_id, 'Spiegazione: ' || explanation_text AS explanation_text, answer_payload FROM question_corrections WHERE coalesce(correct_option_id, '') <> '' OR coalesce(trim(explanation_text, ' '), '') <> '')
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.question_id, n.question_id) AS question_id, {{option}} AS correct_option_id, {{text}} AS explanation_text,
  CASE WHEN o.user_id IS NULL THEN n.answer_payload ELSE o.answer_payload END AS answer_payload, CASE WHEN n.user_id IS NULL THEN o.reviewed_at ELSE TIMESTAMPTZ '{NOW}' END AS reviewed_at
FROM o FULL JOIN n ON n.user_id = o.user_id AND n.question_id = o.question_id"""


def _generated(t: Tables, overwrite: bool) -> DataFrame:
    old = t.question_corrections.filter(F.col("first_seen_at") < moment(SINCE))
    new = t.question_corrections.filter((F.coalesce("correct_option_id", F.lit("")) != "") | E.present(F.col("explanation_text"))).withColumn("explanation_text", F.concat(F.lit("Spiegazione: "), "explanation_text"))
    return R.corrections_generated(old, new, moment(NOW), overwrite)


@query(GENERATED.format(option="coalesce(o.correct_option_id, n.correct_option_id)", text="CASE WHEN n.user_id IS NULL THEN o.explanation_text ELSE coalesce(nullif(trim(o.explanation_text, ' '), ''), n.explanation_text) END"))
def correction_generated(t: Tables) -> DataFrame:
    """Generated corrections saved so that what is there and not empty stays."""
    return _generated(t, False)


@query(GENERATED.format(option="CASE WHEN n.user_id IS NOT NULL THEN n.correct_option_id ELSE o.correct_option_id END", text="CASE WHEN n.user_id IS NOT NULL THEN n.explanation_text ELSE o.explanation_text END"))
def correction_overwritten(t: Tables) -> DataFrame:
    """Generated corrections saved over what is there."""
    return _generated(t, True)


def _at(json: str, path: str) -> str:
    return SQL_OPTION.format(c=f"CASE WHEN json_valid({json}) THEN {json} ->> '{path}' END")


@query(f"""
SELECT c.user_id, c.question_id, coalesce({SQL_OPTION.format(c='c.correct_option_id')}, {_at('c.answer_payload', '$.selected_option_normalized')}, {_at('c.answer_payload', '$.selected_option_raw')},
  {', '.join(_at('s', f'$.{k}') for k in ('correct_option', 'correctOption', 'correct_answer', 'correctAnswer', 'answer', 'option', 'choice', 'label'))}, {_at('s', '$.correct_options[0]')}) AS correct_option
FROM question_corrections c JOIN (SELECT id, replace(solution_json, 'correct_option_id', CASE WHEN section = 'quiz' THEN 'answer' ELSE 'correctOption' END) AS s FROM questions) q ON q.id = c.question_id""")
def correct_option_chain(t: Tables) -> DataFrame:
    """The option held correct, by the whole chain of places it may be kept in; solutions are read as if kept under other keys."""
    key = F.when(F.col("section") == "quiz", "answer").otherwise("correctOption")
    q = t.questions.select(F.col("id").alias("question_id"), F.replace("solution_json", F.lit("correct_option_id"), key).alias("s"))
    own = t.question_corrections.select("user_id", "question_id", "correct_option_id", "answer_payload").join(q, "question_id")
    return own.select("user_id", "question_id", R.correct_option(F.col("correct_option_id"), F.col("answer_payload"), F.col("s")).alias("correct_option"))


def _failed(t: Tables) -> DataFrame:
    return t.exam_documents.filter("ingestion_status = 'failed'").select("id").union(t.spark.range(1).select(F.lit("00000000-0000-0000-0000-000000000000").alias("id")))


@query("""
WITH asked AS (SELECT id FROM exam_documents WHERE ingestion_status = 'failed' UNION SELECT '00000000-0000-0000-0000-000000000000')
SELECT asked.id, d.title, CASE WHEN d.id IS NOT NULL THEN (SELECT count(*) FROM questions q WHERE q.document_id = d.id) END AS questions, CASE WHEN d.id IS NULL THEN 'missing' ELSE 'deleted' END AS status
FROM asked LEFT JOIN exam_documents d ON d.id = asked.id""")
def delete_documents(t: Tables) -> DataFrame:
    """What the deletion of the failed documents, and of one that is not there, takes with it."""
    return R.documents_deleted(_failed(t), t.exam_documents, t.questions)


@query("""
WITH gone AS (SELECT id FROM exam_documents WHERE ingestion_status = 'failed'), lost AS (SELECT id FROM questions WHERE document_id IN (SELECT id FROM gone))
SELECT 'exam_documents' AS part, id AS key FROM exam_documents WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'questions', id FROM questions WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'question_occurrences', id FROM question_occurrences WHERE question_id NOT IN (SELECT id FROM lost) AND document_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'question_corrections', user_id || ':' || question_id FROM question_corrections WHERE question_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'attempts', id FROM attempts WHERE question_id NOT IN (SELECT id FROM lost)""")
def delete_survivors(t: Tables) -> DataFrame:
    """The keys of all rows that are left after the failed documents are deleted."""
    left = R.survivors_of_deletion(_failed(t), t.exam_documents, t.questions, t.question_occurrences, t.question_corrections, t.attempts)
    out = None
    for part, df in left.items():
        key = F.concat_ws(":", "user_id", "question_id") if part == "question_corrections" else F.col("id")
        own = df.select(F.lit(part).alias("part"), key.alias("key"))
        out = own if out is None else out.union(own)
    return out


@query(f"""
WITH gone AS (SELECT simulation_id FROM attempts WHERE simulation_id IS NOT NULL GROUP BY simulation_id HAVING max(answered_at) < TIMESTAMPTZ '{SINCE}')
SELECT id, CASE WHEN simulation_id IN (SELECT simulation_id FROM gone) THEN NULL ELSE simulation_id END AS simulation_id, answered_at FROM attempts""")
def delete_simulations(t: Tables) -> DataFrame:
    """Attempts after the simulations that ended before a date are deleted: they stay, without simulation."""
    old = t.attempts.filter("simulation_id IS NOT NULL").groupBy("simulation_id").agg(F.max("answered_at").alias("at")).filter(F.col("at") < moment(SINCE))
    return R.simulations_deleted(old, t.attempts.select("id", "simulation_id", "answered_at"))


@query(f"""
WITH d AS (SELECT question_id, bool_or({HAS}) AS done FROM question_corrections GROUP BY question_id),
r AS (SELECT q.document_id AS job, q.id AS item, CASE WHEN q.is_discarded THEN 'skipped' WHEN d.done THEN 'succeeded' ELSE 'failed' END AS outcome FROM questions q JOIN d ON d.question_id = q.id),
a AS (SELECT job, count(*) AS processed, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
  string_agg(item, ',' ORDER BY item) FILTER (WHERE outcome = 'failed') AS new FROM r GROUP BY job),
j AS (SELECT e.id AS job, count(q.id) AS total, any_value(e.ingestion_error) AS old FROM exam_documents e LEFT JOIN questions q ON q.document_id = e.id GROUP BY e.id)
SELECT j.job, total, coalesce(processed, 0) AS processed, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, concat_ws(',', old, new) AS failures,
  least(100, round(100.0 * coalesce(processed, 0) / greatest(total, 1)))::INTEGER AS percent FROM j LEFT JOIN a ON a.job = j.job""")
def job_progress(t: Tables) -> DataFrame:
    """Counters, failures and progress of correction jobs: a document is a job, its corrected questions are the results so far."""
    size = t.questions.groupBy(F.col("document_id").alias("job")).agg(F.count("*").alias("n"))
    failures = F.when(F.col("ingestion_error").isNotNull(), F.array("ingestion_error"))
    jobs = t.exam_documents.select(F.col("id").alias("job"), failures.alias("failures")).join(size, "job", "left").select("job", F.coalesce("n", F.lit(0)).alias("total"), "failures")
    done = t.question_corrections.groupBy(F.col("question_id").alias("id")).agg(F.bool_or(E.has_correction()).alias("done"))
    outcome = F.when(F.col("is_discarded"), "skipped").when(F.col("done"), "succeeded").otherwise("failed")
    results = t.questions.select("id", "document_id", "is_discarded").join(done, "id").select(F.col("document_id").alias("job"), F.col("id").alias("item"), outcome.alias("outcome"))
    return R.job_progress(jobs, results).withColumn("failures", F.array_join("failures", ","))


@query(f"""
SELECT id, CASE WHEN ingestion_status IN ('uploaded', 'processing') THEN 'interrupted' ELSE ingestion_status END AS status, CASE WHEN ingestion_status IN ('uploaded', 'processing') THEN TIMESTAMPTZ '{NOW}' ELSE processed_at END AS finished_at,
  CASE WHEN ingestion_status IN ('uploaded', 'processing') THEN coalesce(ingestion_error, 'Process restarted') ELSE ingestion_error END AS error FROM exam_documents""")
def job_orphans(t: Tables) -> DataFrame:
    """Ingestions that an ended process left unfinished become interrupted."""
    jobs = t.exam_documents.select("id", F.col("ingestion_status").alias("status"), F.col("processed_at").alias("finished_at"), F.col("ingestion_error").alias("error"))
    return R.jobs_interrupted(jobs, moment(NOW), ("uploaded", "processing"))


@query("""
WITH q AS (SELECT document_id AS id, round(avg(confidence)::DOUBLE, 6) AS quality FROM questions GROUP BY document_id), c AS (SELECT document_id AS id, count(*) AS n FROM incoming_questions WHERE coalesce(trim(stem, ' '), '') <> '' GROUP BY document_id)
SELECT d.id, coalesce(q.quality, 0.0) AS quality, coalesce(c.n, 0) AS candidates, CASE WHEN coalesce(q.quality, 0.0) >= 0.72 THEN 'sufficient' WHEN coalesce(c.n, 0) = 0 THEN 'no candidates' ELSE 'merge' END AS outcome
FROM exam_documents d LEFT JOIN q ON q.id = d.id LEFT JOIN c ON c.id = d.id""")
def second_extraction(t: Tables) -> DataFrame:
    """Which documents a second extraction is made and merged for, by the quality of the first and the candidates it gives."""
    quality = t.questions.groupBy(F.col("document_id").alias("id")).agg(F.round(F.avg("confidence").cast("double"), 6).alias("q"))
    found = t.incoming_questions.filter(E.present(F.col("stem"))).groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    own = t.exam_documents.select("id").join(quality, "id", "left").join(found, "id", "left")
    return R.second_extraction(own.select("id", F.coalesce("q", F.lit(0.0)).alias("quality"), F.coalesce("n", F.lit(0)).alias("candidates")))


@query(f"SELECT slug, name FROM {SQL_BASE}")
def reset_tags(t: Tables) -> DataFrame:
    """The tags of a database that was emptied and seeded again."""
    return base_tags(t)
