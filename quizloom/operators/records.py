"""Changes to records as functions from tables to their next versions: tags, presets, corrections, deletions, jobs.

What a request names (ids, tags) is a small frame or list; the tables are only semi- and
anti-joined with it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions import text as X
from quizloom.operators import evidence as E
from quizloom.operators import merge as M


def tags_upserted(tags: DataFrame, names: DataFrame) -> DataFrame:
    """tags (slug, name) with names (name, at) put in by slug: the last name of a slug in order of at (and name) wins; blank names are left out."""
    own = names.select(F.trim("name").alias("name"), "at").withColumn("slug", X.slugify(F.col("name"))).filter("slug <> ''")
    last = own.groupBy("slug").agg(F.max(F.struct("at", "name"))["name"].alias("name"))
    return M.upserted(tags, last, ["slug"], {"name": F.coalesce("new.name", "old.name")})


def manual_tags(question_tags: DataFrame, questions: DataFrame, names: list[str]) -> DataFrame:
    """question_tags (id, slug, score, source) with all tags of the questions (id) replaced by the named ones, as manual with score 1."""
    ids = questions.select("id").distinct()
    slugs = F.array_distinct(F.array(*[X.slugify(F.lit(n)) for n in names]).cast("array<string>"))
    new = ids.select("id", F.explode(slugs).alias("slug")).filter("slug <> ''").select("id", "slug", F.lit(1).cast("decimal(3,2)").alias("score"), F.lit("manual").alias("source"))
    return question_tags.join(ids, "id", "left_anti").select("id", "slug", "score", "source").union(new)


def presets_upserted(presets: DataFrame, members: DataFrame, new: Mapping[str, tuple[str, list[str]]], tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """presets (preset, description) and members (preset, slug) with new ones put in: descriptions are overwritten, members added where missing and known as tags."""
    spark = presets.sparkSession
    heads = spark.createDataFrame([(p, d) for p, (d, _) in new.items()], "preset string, description string")
    slugs = spark.createDataFrame([(p, s) for p, (_, own) in new.items() for s in own], "preset string, slug string").join(tags.select("slug"), "slug", "left_semi")
    return M.upserted(presets, heads, ["preset"], {"description": F.coalesce("new.description", "old.description")}), members.union(slugs.select("preset", "slug")).distinct()


def corrections_generated(existing: DataFrame, generated: DataFrame, now: Column, overwrite: bool = False) -> DataFrame:
    """The corrections after generated ones are saved.

    Generated ones without option and text are not saved. Of others an old value that is not empty wins, so that manual
    edits are safe; with overwrite the new option and text replace the old ones. Payloads stay.
    """
    keys, columns = ["user_id", "question_id"], ["correct_option_id", "explanation_text", "answer_payload"]
    saved = F.col("new._saved").isNotNull()
    fresh = generated.filter((F.coalesce("correct_option_id", F.lit("")) != "") | E.present(F.col("explanation_text"))).select(*keys, *columns).withColumn("_saved", F.lit(True))
    old = existing.select(*keys, *columns, "reviewed_at").withColumn("_saved", F.lit(None).cast("boolean"))
    fresh = fresh.withColumn("reviewed_at", now)
    there = F.col("old.reviewed_at").isNotNull() | F.col("old.correct_option_id").isNotNull() | F.col("old.explanation_text").isNotNull() | F.col("old.answer_payload").isNotNull()
    if overwrite:
        result = {c: F.col(f"new.{c}") for c in columns[:2]}
    else:
        result = {"correct_option_id": F.coalesce("old.correct_option_id", "new.correct_option_id"), "explanation_text": F.coalesce(F.nullif(F.trim("old.explanation_text"), F.lit("")), "new.explanation_text")}
    rules = {c: F.when(saved, x).otherwise(F.col(f"old.{c}")) for c, x in result.items()}
    rules["answer_payload"] = F.when(there, F.col("old.answer_payload")).otherwise(F.col("new.answer_payload"))
    rules["reviewed_at"] = F.when(saved, F.col("new.reviewed_at")).otherwise(F.col("old.reviewed_at"))
    return M.upserted(old, fresh, keys, rules).drop("_saved")


def documents_deleted(ids: DataFrame, documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, title, questions, status) for each id asked for: what its deletion takes with it, or that it is missing."""
    own = questions.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    there = documents.select("id", "title", F.lit("deleted").alias("status"))
    out = ids.select("id").distinct().join(there, "id", "left").join(own, "id", "left")
    known = F.col("status").isNotNull()
    return out.select("id", "title", F.when(known, F.coalesce("n", F.lit(0))).alias("questions"), F.coalesce("status", F.lit("missing")).alias("status"))


def survivors_of_deletion(ids: DataFrame, documents: DataFrame, questions: DataFrame, occurrences: DataFrame, corrections: DataFrame, attempts: DataFrame) -> dict[str, DataFrame]:
    """The tables after the documents (id) are deleted with all that hangs on them."""
    gone = ids.select("id").distinct()
    by_document = gone.withColumnRenamed("id", "document_id")
    lost = questions.join(by_document, "document_id", "left_semi").select(F.col("id").alias("question_id"))
    return {
        "exam_documents": documents.join(gone, "id", "left_anti"),
        "questions": questions.join(by_document, "document_id", "left_anti"),
        "question_occurrences": occurrences.join(lost, "question_id", "left_anti").join(by_document, "document_id", "left_anti"),
        "question_corrections": corrections.join(lost, "question_id", "left_anti"),
        "attempts": attempts.join(lost, "question_id", "left_anti"),
    }


def simulations_deleted(ids: DataFrame, attempts: DataFrame) -> DataFrame:
    """The attempts after simulations (simulation_id) are deleted: they stay, without simulation."""
    gone = ids.filter("simulation_id IS NOT NULL").select("simulation_id").distinct().withColumn("_gone", F.lit(True))
    out = attempts.join(gone, "simulation_id", "left")
    return out.withColumn("simulation_id", F.when(F.col("_gone").isNull(), F.col("simulation_id"))).drop("_gone").select(*attempts.columns)


def job_progress(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs (job, total, failures) after results (job, item, outcome) of their batches.

    Counters of the outcomes succeeded, failed and skipped, failed items appended to the list in order, and the share done in per cent.
    """
    hit = lambda name: E.count_of(F.col("outcome") == name).alias(name)
    added = results.groupBy("job").agg(F.count("*").alias("processed"), hit("succeeded"), hit("failed"), hit("skipped"), F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.col("item")))).alias("new"))
    out = jobs.join(added, "job", "left").na.fill(0, ["processed", "succeeded", "failed", "skipped"])
    none = F.array().cast("array<string>")
    percent = F.least(F.lit(100), F.round(100 * F.col("processed") / F.greatest("total", F.lit(1))).cast("int"))
    return out.select("job", "total", "processed", "succeeded", "failed", "skipped", F.concat(F.coalesce("failures", none), F.coalesce("new", none)).alias("failures"), percent.alias("percent"))


def jobs_interrupted(jobs: DataFrame, now: Column, running: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Jobs (status, finished_at, error, ...) that an ended process left running become interrupted."""
    left = F.col("status").isin(*running)
    return jobs.withColumns({
        "finished_at": F.when(left, now).otherwise(F.col("finished_at")), "error": F.when(left, F.coalesce("error", F.lit("Process restarted"))).otherwise(F.col("error")),
        "status": F.when(left, "interrupted").otherwise(F.col("status")),
    })


def second_extraction(documents: DataFrame, enabled: bool = True, least_quality: float = 0.72) -> DataFrame:
    """documents (quality, candidates, ...) with what a second extraction does for each: 'disabled', 'sufficient', 'no candidates' or 'merge'."""
    if not enabled:
        return documents.withColumn("outcome", F.lit("disabled"))
    return documents.withColumn("outcome", F.when(F.col("quality") >= least_quality, "sufficient").when(F.col("candidates") == 0, "no candidates").otherwise("merge"))


def correct_option(option: Column, payload: Column, solution: Column) -> Column:
    """The option held correct: the correction's own, else the one selected in its payload, else the solution's first key that has one, else its first of several."""
    # Where options are kept, in order of trust.
    chosen = ("selected_option_normalized", "selected_option_raw")
    keys = ("correct_option", "correctOption", "correct_answer", "correctAnswer", "answer", "option", "choice", "label")
    bare = lambda c: F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(c), r"[).:\s]+$", ""))), F.lit(""))
    at = lambda json, path: bare(F.try_variant_get(F.try_parse_json(json), path, "string"))
    return F.coalesce(bare(option), *[at(payload, f"$.{k}") for k in chosen], *[at(solution, f"$.{k}") for k in keys], at(solution, "$.correct_options[0]"))
