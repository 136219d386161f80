"""Upserts, deletions and pending work on corrections, as new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.operators import evidence as E
from quizloom.operators import merge as M
from quizloom.operators import tags as G
from quizloom.plans.practice import option_id
from quizloom.plans.queryset import Tables, query
from quizloom.plans.reports import HAS

SINCE = "2024-06-01 00:00:00+00"
LAST = f"(SELECT user_id, question_id, arg_max(coalesce(is_correct, false), (answered_at, id)) AS ok, min(answered_at) AS seen, max(answered_at) AS at FROM (SELECT DISTINCT ON (id) * FROM attempts) WHERE answered_at {{}} TIMESTAMPTZ '{SINCE}' GROUP BY ALL)"


def _reviews(attempts: DataFrame) -> DataFrame:
    ok = F.coalesce("is_correct", F.lit(False))
    return attempts.groupBy("user_id", "question_id").agg(
        F.when(F.max(F.struct("answered_at", "id", ok.alias("ok")))["ok"], "correct").otherwise("wrong").alias("status"), F.min("answered_at").alias("first_seen_at"), F.max("answered_at").alias("reviewed_at")
    )


@query(f"""
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.question_id, n.question_id) AS question_id, CASE WHEN coalesce(n.ok, o.ok) THEN 'correct' ELSE 'wrong' END AS status, coalesce(o.seen, n.seen) AS first_seen_at, coalesce(n.at, o.at) AS reviewed_at
FROM {LAST.format('<')} o FULL JOIN {LAST.format('>=')} n ON n.user_id = o.user_id AND n.question_id = o.question_id""")
def review_upsert(t: Tables) -> DataFrame:
    """Reviews before a date upserted with those after it: status and time are new, the first sight stays."""
    own = E.deduplicated_attempts(t.attempts)
    since = F.lit("2024-06-01 00:00:00+00:00").cast("timestamp")
    rules = {"status": F.coalesce("new.status", "old.status"), "reviewed_at": F.coalesce("new.reviewed_at", "old.reviewed_at")}
    return M.upserted(_reviews(own.filter(F.col("answered_at") < since)), _reviews(own.filter(F.col("answered_at") >= since)), ["user_id", "question_id"], rules)


@query(f"""
WITH o AS (SELECT * FROM question_corrections WHERE first_seen_at < TIMESTAMPTZ '{SINCE}'), n AS (SELECT user_id, question_id, correct_option_id, explanation_text, answer_payload FROM question_corrections WHERE answer_payload IS NOT NULL)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.question_id, n.question_id) AS question_id, coalesce(n.correct_option_id, o.correct_option_id) AS correct_option_id, coalesce(n.explanation_text, o.explanation_text) AS explanation_text,
  CASE WHEN coalesce(n.answer_payload, '{{}}') <> '{{}}' THEN n.answer_payload ELSE coalesce(o.answer_payload, n.answer_payload) END AS answer_payload
FROM o FULL JOIN n ON n.user_id = o.user_id AND n.question_id = o.question_id""")
def correction_upsert(t: Tables) -> DataFrame:
    """Corrections upserted: new values win where they are given, a payload unless it is the empty object."""
    columns = ["user_id", "question_id", "correct_option_id", "explanation_text", "answer_payload"]
    old = t.question_corrections.filter(F.col("first_seen_at") < F.lit("2024-06-01 00:00:00+00:00").cast("timestamp")).select(*columns)
    new = t.question_corrections.filter("answer_payload IS NOT NULL").select(*columns)
    rules = {c: F.coalesce(f"new.{c}", f"old.{c}") for c in columns[2:4]}
    rules["answer_payload"] = F.when(F.coalesce("new.answer_payload", F.lit("{}")) != "{}", F.col("new.answer_payload")).otherwise(F.coalesce("old.answer_payload", "new.answer_payload"))
    return M.upserted(old, new, ["user_id", "question_id"], rules)


@query(f"""
WITH o AS ({G.sql_rule_tags()}), n AS (SELECT q.id, trim(x) AS slug, 0.82::DECIMAL(3,2) AS score FROM questions q, unnest(string_split('dns,nat', ',')) AS u(x) WHERE q.section = 'quiz')
SELECT coalesce(o.id, n.id) AS id, coalesce(o.slug, n.slug) AS slug, greatest(o.score, n.score) AS score, CASE WHEN n.id IS NOT NULL THEN 'manual' ELSE 'rule' END AS source FROM o FULL JOIN n ON n.id = o.id AND n.slug = o.slug""")
def tag_upsert(t: Tables) -> DataFrame:
    """Scored tags upserted: the better score, the newer source."""
    old = G.rule_tags(t.questions).withColumn("source", F.lit("rule"))
    new = t.questions.filter("section = 'quiz'").select("id", F.explode(F.array(F.lit("dns"), F.lit("nat"))).alias("slug"), F.lit(0.82).cast("decimal(3,2)").alias("score"), F.lit("manual").alias("source"))
    return M.upserted(old, new, ["id", "slug"], {"score": F.greatest("old.score", "new.score"), "source": F.coalesce("new.source", "old.source")})


@query("""SELECT id, is_discarded OR coalesce(confidence < 0.3, false) AS is_discarded, CASE WHEN NOT is_discarded AND confidence < 0.3 THEN TIMESTAMPTZ '2025-01-01 00:00:00+00' END AS discarded_at FROM questions""")
def discard_toggle(t: Tables) -> DataFrame:
    """Questions of low confidence discarded at a given time; a null confidence is not low."""
    low = F.coalesce(F.col("confidence") < 0.3, F.lit(False))
    return t.questions.select("id", (F.col("is_discarded") | low).alias("is_discarded"), F.when(~F.col("is_discarded") & low, F.lit("2025-01-01 00:00:00+00:00").cast("timestamp")).alias("discarded_at"))


@query("""
WITH gone AS (SELECT id FROM exam_documents WHERE ingestion_status = 'failed'), q AS (SELECT id FROM questions WHERE document_id IN (SELECT id FROM gone))
SELECT 'questions' AS part, count(*) AS total, count(*) FILTER (WHERE id IN (SELECT id FROM q)) AS deleted FROM questions
UNION ALL SELECT 'occurrences', count(*), count(*) FILTER (WHERE question_id IN (SELECT id FROM q) OR document_id IN (SELECT id FROM gone)) FROM question_occurrences
UNION ALL SELECT 'corrections', count(*), count(*) FILTER (WHERE question_id IN (SELECT id FROM q)) FROM question_corrections
UNION ALL SELECT 'attempts', count(*), count(*) FILTER (WHERE question_id IN (SELECT id FROM q)) FROM attempts""")
def delete_cascade(t: Tables) -> DataFrame:
    """What goes with the documents that failed: semi joins down the tables, occurrences also by their own document."""
    gone = t.exam_documents.filter("ingestion_status = 'failed'").select(F.col("id").alias("document_id"), F.lit(1).alias("g")).distinct()
    questions = t.questions.select("id", "document_id").join(gone, "document_id", "left")
    lost = questions.filter("g = 1").select(F.col("id").alias("question_id"), F.lit(1).alias("q"))
    count = lambda df, part, hit: df.agg(F.count("*").alias("total"), E.count_of(hit).alias("deleted")).select(F.lit(part).alias("part"), "total", "deleted")
    out = count(questions, "questions", F.col("g").isNotNull())
    occ = t.question_occurrences.select("question_id", "document_id").join(lost, "question_id", "left").join(gone, "document_id", "left")
    out = out.union(count(occ, "occurrences", F.col("g").isNotNull() | F.col("q").isNotNull()))
    for name, part in (("question_corrections", "corrections"), ("attempts", "attempts")):
        out = out.union(count(getattr(t, name).select("question_id").join(lost, "question_id", "left"), part, F.col("q").isNotNull()))
    return out


@query(f"""
SELECT q.section, least(count(*), 5000)::BIGINT AS pending FROM questions q WHERE NOT is_discarded AND NOT EXISTS (SELECT 1 FROM question_corrections c WHERE c.question_id = q.id AND {HAS}) GROUP BY q.section""")
def correction_pending_count(t: Tables) -> DataFrame:
    """Live questions without any correction, at most 5000 a section as a job takes them."""
    done = t.question_corrections.filter(E.has_correction()).select(F.col("question_id").alias("id"))
    return E.live(t.questions).join(done, "id", "left_anti").groupBy("section").agg(F.least(F.count("*"), F.lit(5000).cast("long")).alias("pending"))


@query(f"""
SELECT q.id, q.section, q.number_in_section FROM questions q WHERE NOT is_discarded AND NOT EXISTS (SELECT 1 FROM question_corrections c WHERE c.question_id = q.id AND {HAS})
ORDER BY q.document_id, q.section, q.number_in_section, q.id LIMIT 25 OFFSET 50""")
def job_batch_page(t: Tables) -> DataFrame:
    """The third page of pending questions on a stable order."""
    done = t.question_corrections.filter(E.has_correction()).select(F.col("question_id").alias("id"))
    own = E.live(t.questions).join(done, "id", "left_anti").orderBy("document_id", "section", "number_in_section", "id")
    return own.offset(50).limit(25).select("id", "section", "number_in_section")


@query(f"""SELECT id FROM questions q WHERE NOT is_discarded AND NOT EXISTS (SELECT 1 FROM question_corrections c WHERE c.question_id = q.id AND {HAS})""")
def review_filter_unreviewed(t: Tables) -> DataFrame:
    """Live questions nobody corrected: a left anti join."""
    done = t.question_corrections.filter(E.has_correction()).select(F.col("question_id").alias("id"))
    return E.live(t.questions).select("id").join(done, "id", "left_anti")


@query(f"""
SELECT id FROM questions q WHERE NOT is_discarded AND (document_id IN (SELECT id FROM exam_documents WHERE language = 'en') OR EXISTS (SELECT 1 FROM question_corrections c WHERE c.question_id = q.id AND {HAS}))""")
def simulation_pool_union(t: Tables) -> DataFrame:
    """A union of sources as one disjunction: existence joins, no union of copies."""
    docs = t.exam_documents.filter("language = 'en'").select(F.col("id").alias("document_id"), F.lit(True).alias("d")).distinct()
    done = t.question_corrections.filter(E.has_correction()).select(F.col("question_id").alias("id"), F.lit(True).alias("c")).distinct()
    own = E.live(t.questions).select("id", "document_id").join(docs, "document_id", "left").join(done, "id", "left")
    return own.filter("d OR c").select("id")


@query("""
WITH o AS (SELECT id, question_type, list_transform(CASE WHEN json_valid(options_json) AND json_type(options_json) = 'ARRAY' THEN from_json(options_json, '[{"id":"VARCHAR"}]') ELSE [] END, lambda x: lower(trim(x.id))) AS ids FROM questions),
c AS (SELECT user_id, question_id, nullif(lower(trim(regexp_replace(trim(correct_option_id), '[).:\\s]+$', ''))), '') AS option FROM question_corrections)
SELECT c.user_id, c.question_id, CASE WHEN o.question_type = 'multiple_choice' AND list_contains(o.ids, c.option) THEN c.option END AS option,
  CASE WHEN c.option IS NULL THEN 'none' WHEN o.question_type <> 'multiple_choice' THEN 'not a choice' WHEN list_contains(o.ids, c.option) THEN 'known' ELSE 'unknown option' END AS verdict
FROM c JOIN o ON o.id = c.question_id""".replace("\\\\s", "\\s"))
def correction_guard(t: Tables) -> DataFrame:
    """Corrections' options held against the question's: only one that is there is kept, with the reason."""
    ids = F.transform(F.coalesce(F.from_json("options_json", "array<struct<id:string>>"), F.array().cast("array<struct<id:string>>")), lambda o: F.lower(F.trim(o["id"])))
    q = t.questions.select(F.col("id").alias("question_id"), "question_type", ids.alias("ids"))
    own = t.question_corrections.select("user_id", "question_id", option_id("correct_option_id").alias("own")).join(q, "question_id")
    known = F.coalesce(F.array_contains("ids", F.col("own")), F.lit(False))
    choice = F.col("question_type") == "multiple_choice"
    verdict = F.when(F.col("own").isNull(), "none").when(~choice, "not a choice").when(known, "known").otherwise("unknown option")
    return own.select("user_id", "question_id", F.when(choice & known, F.col("own")).alias("option"), verdict.alias("verdict"))
