"""Reports: key figures, coverage, statistics of attempts, occurrences, histories, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.operators import evidence as E
from quizloom.plans.queryset import Tables, query

HAS = "(correct_option_id IS NOT NULL OR coalesce(trim(explanation_text, ' '), '') <> '' OR coalesce(regexp_replace(answer_payload, '\\s', '', 'g'), '{}') <> '{}')"
ATTEMPTS = "(SELECT DISTINCT ON (id) * FROM attempts)"


@query("""
SELECT (SELECT count(*) FROM exam_documents) AS documents,
  (SELECT count(*) FROM exam_documents WHERE ingestion_status = 'processed') AS processed_documents,
  (SELECT count(*) FROM questions) AS questions,
  (SELECT count(*) FROM questions WHERE needs_review) AS needs_review,
  (SELECT round(avg(confidence::DOUBLE), 6) FROM questions) AS avg_confidence,
  (SELECT count(*) FROM (SELECT DISTINCT id FROM attempts)) AS attempts""")
def kpi(t: Tables) -> DataFrame:
    """Global counts, filtered counts and the average confidence (null of an empty bank)."""
    docs = t.exam_documents.agg(F.count("*").alias("documents"), E.count_of(F.col("ingestion_status") == "processed").alias("processed_documents"))
    questions = t.questions.agg(F.count("*").alias("questions"), E.count_of(F.col("needs_review")).alias("needs_review"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("avg_confidence"))
    attempts = t.attempts.select("id").distinct().agg(F.count("*").alias("attempts"))
    return docs.join(F.broadcast(questions)).join(F.broadcast(attempts))  # three single rows


@query(f"SELECT question_id, count(*) AS attempts, count(*) FILTER (WHERE is_correct) AS correct FROM {ATTEMPTS} GROUP BY question_id")
def attempt_stats(t: Tables) -> DataFrame:
    """Attempts and correct ones of each question."""
    return E.deduplicated_attempts(t.attempts).groupBy("question_id").agg(F.count("*").alias("attempts"), E.count_of(F.col("is_correct")).alias("correct"))


@query(f"""
SELECT q.section, count(*) AS total, count(c.question_id) AS with_correction, count(*) - count(c.question_id) AS without_correction,
  coalesce(round(count(c.question_id)::DOUBLE / nullif(count(*), 0), 6), 0.0) AS ratio
FROM questions q LEFT JOIN (SELECT DISTINCT question_id FROM question_corrections WHERE {HAS}) c ON c.question_id = q.id
WHERE NOT q.is_discarded GROUP BY q.section""")
def review_stats(t: Tables) -> DataFrame:
    """Questions with and without any correction, by section."""
    corrected = t.question_corrections.filter(E.has_correction()).select(F.col("question_id").alias("id"), F.lit(True).alias("has")).distinct()
    out = E.live(t.questions).select("id", "section").join(corrected, "id", "left").groupBy("section")
    out = out.agg(F.count("*").alias("total"), F.count("has").alias("with_correction"))
    return out.withColumn("without_correction", F.col("total") - F.col("with_correction")).withColumn("ratio", E.ratio(F.col("with_correction"), F.col("total")))


@query(f"""
WITH u AS (SELECT user_id FROM question_corrections GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)
SELECT q.document_id, count(*) AS total, count(*) FILTER (WHERE {HAS}) AS with_correction,
  count(*) FILTER (WHERE correct_option_id IS NOT NULL) AS with_correct_option,
  count(*) FILTER (WHERE coalesce(trim(explanation_text, ' '), '') <> '') AS with_explanation,
  coalesce(round((count(*) FILTER (WHERE {HAS}))::DOUBLE / count(*), 6), 0.0) AS ratio
FROM questions q LEFT JOIN (SELECT * FROM question_corrections WHERE user_id IN (SELECT user_id FROM u)) c ON c.question_id = q.id
WHERE NOT q.is_discarded GROUP BY q.document_id""")
def correction_coverage(t: Tables) -> DataFrame:
    """Coverage by document of the corrections of one user, the one with the most; that side is filtered before the join."""
    busiest = t.question_corrections.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")
    own = t.question_corrections.join(F.broadcast(busiest), "user_id", "left_semi")
    own = own.select(F.col("question_id").alias("id"), E.has_correction().alias("has"), "correct_option_id", "explanation_text")
    out = E.live(t.questions).select("id", "document_id").join(own, "id", "left").groupBy("document_id").agg(
        F.count("*").alias("total"), E.count_of(F.col("has")).alias("with_correction"), F.count("correct_option_id").alias("with_correct_option"), E.count_of(E.present(F.col("explanation_text"))).alias("with_explanation"),
    )
    return out.withColumn("ratio", E.ratio(F.col("with_correction"), F.col("total")))


@query("""
SELECT q.id AS question_id, q.section, q.number_in_section, left(q.stem, 220) AS stem_preview, coalesce(q.occurrences_count, 1) AS occurrences_count,
  count(o.question_id) AS occurrences, count(DISTINCT o.source_file_name) AS files, coalesce(string_agg(DISTINCT o.source_file_name, '; ' ORDER BY o.source_file_name), '') AS source_files
FROM questions q LEFT JOIN (SELECT DISTINCT question_id, document_id, source_file_name, source_section, source_number FROM question_occurrences) o ON o.question_id = q.id
GROUP BY ALL""")
def occurrence_report(t: Tables) -> DataFrame:
    """Each question with its occurrences gathered: one join in place of a lookup per row."""
    occ = t.question_occurrences.select("question_id", "document_id", "source_file_name", "source_section", "source_number").distinct()
    per = occ.groupBy("question_id").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_set("source_file_name")).alias("names"))
    out = t.questions.withColumnRenamed("id", "question_id").join(per, "question_id", "left")
    return out.select(
        "question_id", "section", "number_in_section", F.substring("stem", 1, 220).alias("stem_preview"), F.coalesce("occurrences_count", F.lit(1)).alias("occurrences_count"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("files"), F.coalesce(F.array_join("names", "; "), F.lit("")).alias("source_files"),
    )


@query(f"""
SELECT simulation_id, user_id, count(*) AS answered_count, count(*) FILTER (WHERE is_correct) AS correct_count, count(DISTINCT question_id) AS questions,
  min(answered_at) AS started_at, max(answered_at) AS ended_at
FROM {ATTEMPTS} WHERE simulation_id IS NOT NULL GROUP BY ALL""")
def simulation_history(t: Tables) -> DataFrame:
    """Attempts of each simulation: answered counts attempts, questions counts distinct ones."""
    own = E.deduplicated_attempts(t.attempts.filter("simulation_id IS NOT NULL"))
    return own.groupBy("simulation_id", "user_id").agg(
        F.count("*").alias("answered_count"), E.count_of(F.col("is_correct")).alias("correct_count"), F.countDistinct("question_id").alias("questions"), F.min("answered_at").alias("started_at"), F.max("answered_at").alias("ended_at"),
    )


@query("""
WITH o AS (SELECT document_id, question_type, stem, confidence, CASE WHEN json_valid(options_json) AND json_type(options_json) = 'ARRAY' THEN json_array_length(options_json) ELSE 0 END AS n FROM questions)
SELECT document_id, count(*) AS questions, count(*) FILTER (WHERE question_type = 'multiple_choice') AS multiple_choice, count(*) FILTER (WHERE question_type = 'open_text') AS open_text,
  count(*) FILTER (WHERE question_type = 'multi_part_open') AS multi_part_open, count(*) FILTER (WHERE question_type = 'multiple_choice' AND n <> 4) AS odd_options,
  count(*) FILTER (WHERE confidence < 0.8) AS low_confidence, count(*) FILTER (WHERE trim(stem) = '') AS empty_stems FROM o GROUP BY document_id""")
def quality_audit(t: Tables) -> DataFrame:
    """Counts by type and of suspicious questions for each document, in one pass."""
    n = F.coalesce(F.json_array_length("options_json"), F.lit(0))
    kind = F.col("question_type")
    return t.questions.groupBy("document_id").agg(
        F.count("*").alias("questions"), *[E.count_of(kind == k).alias(k) for k in ("multiple_choice", "open_text", "multi_part_open")],
        E.count_of((kind == "multiple_choice") & (n != 4)).alias("odd_options"), E.count_of(F.col("confidence") < 0.8).alias("low_confidence"), E.count_of(F.trim("stem") == "").alias("empty_stems"),
    )


@query("""
SELECT coalesce(d.ingestion_status, 'none') AS status, count(*) AS documents, count(*) FILTER (WHERE d.ingestion_error IS NOT NULL) AS with_error,
  coalesce(round(avg(q.c), 4), 0.0) AS avg_confidence
FROM exam_documents d LEFT JOIN (SELECT document_id, avg(confidence::DOUBLE) AS c FROM questions GROUP BY document_id) q ON q.document_id = d.id GROUP BY 1""")
def batch_summary(t: Tables) -> DataFrame:
    """Documents by status with the mean of their questions' mean confidence (0.0 of none)."""
    per = t.questions.groupBy("document_id").agg(F.avg(F.col("confidence").cast("double")).alias("c")).withColumnRenamed("document_id", "id")
    out = t.exam_documents.join(per, "id", "left").groupBy(F.coalesce("ingestion_status", F.lit("none")).alias("status"))
    return out.agg(F.count("*").alias("documents"), F.count("ingestion_error").alias("with_error"), F.coalesce(F.round(F.avg("c"), 4), F.lit(0.0)).alias("avg_confidence"))


@query("""
SELECT ingestion_status AS status, title, id, created_at FROM exam_documents ORDER BY created_at DESC NULLS LAST, id LIMIT 500""")
def list_documents(t: Tables) -> DataFrame:
    """The newest documents, at most 500: planned as a top-k, not a full sort."""
    top = t.exam_documents.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(500)
    return top.select(F.col("ingestion_status").alias("status"), "title", "id", "created_at")


@query("""
WITH d AS (SELECT document_id FROM questions GROUP BY document_id ORDER BY count(*) DESC, document_id LIMIT 1)
SELECT id, section, number_in_section, left(stem, 180) AS stem_preview FROM questions WHERE document_id IN (SELECT document_id FROM d) AND NOT is_discarded AND question_type = 'multiple_choice'""")
def list_document_questions(t: Tables) -> DataFrame:
    """Live multiple-choice questions of the document that has the most."""
    largest = t.questions.groupBy("document_id").count().orderBy(F.desc("count"), "document_id").limit(1)
    own = E.equal_where_given(E.live(t.questions), question_type="multiple_choice", section=None)
    return own.join(F.broadcast(largest), "document_id", "left_semi").select("id", "section", "number_in_section", F.substring("stem", 1, 180).alias("stem_preview"))


@query("""
SELECT q.id, q.question_type, q.stem, d.title FROM questions q JOIN exam_documents d ON d.id = q.document_id
WHERE q.section = 'esercizio' AND q.number_in_section = 1 AND d.ingestion_status = 'processed'""")
def point_lookup(t: Tables) -> DataFrame:
    """Selective filters on both sides, which reach both scans."""
    docs = t.exam_documents.filter("ingestion_status = 'processed'").select(F.col("id").alias("document_id"), "title")
    return t.questions.filter("section = 'esercizio' AND number_in_section = 1").select("id", "document_id", "question_type", "stem").join(docs, "document_id").select("id", "question_type", "stem", "title")


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS total
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def chained_outer_joins(t: Tables) -> DataFrame:
    """Chained left joins under a group; orders are summed per customer before they are joined."""
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,4)")).alias("s"))
    out = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(per, "c_custkey", "left")
    return out.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.coalesce(F.round(F.sum("s").cast("double"), 2), F.lit(0.0)).alias("total"))
