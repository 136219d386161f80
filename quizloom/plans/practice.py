"""Scheduling, the next question, and simulations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.operators import evidence as E
from quizloom.operators import schedule as S
from quizloom.operators import study as N
from quizloom.operators import tags as G
from quizloom.operators.asked import parse_ids, pool_bound
from quizloom.plans.queryset import Tables, query

ATTEMPTS = "(SELECT DISTINCT ON (id) * FROM attempts)"
BUSIEST = "(SELECT user_id FROM attempts GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"
SEED = "17"


def busiest_user(t: Tables) -> DataFrame:
    return t.attempts.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1).select("user_id")


@query(S.SQL_STATE)
def schedule_state(t: Tables) -> DataFrame:
    return S.schedule_state(E.deduplicated_attempts(t.attempts))


@query(f"""
WITH s AS ({S.SQL_STATE}), d AS (SELECT s.user_id, s.due_at, q.id AS question_id, q.needs_review, row_number() OVER (PARTITION BY s.user_id ORDER BY s.due_at, coalesce(q.needs_review, false), q.id) AS k
  FROM s JOIN questions q ON q.id = s.question_id WHERE NOT q.is_discarded AND s.due_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00')
SELECT user_id, question_id, due_at FROM d WHERE k = 1""")
def study_next_due(t: Tables) -> DataFrame:
    """The most overdue question of each user at a given time."""
    due = S.schedule_state(E.deduplicated_attempts(t.attempts)).filter(F.col("due_at") <= F.lit("2025-01-01 00:00:00+00:00").cast("timestamp"))
    own = due.join(E.live(t.questions).select(F.col("id").alias("question_id"), "needs_review"), "question_id")
    best = own.groupBy("user_id").agg(F.min(F.struct("due_at", F.coalesce("needs_review", F.lit(False)).alias("review"), "question_id")).alias("b"))
    return best.select("user_id", F.col("b.question_id").alias("question_id"), F.col("b.due_at").alias("due_at"))


@query(f"""
SELECT id, section, number_in_section FROM questions q WHERE NOT is_discarded AND NOT EXISTS (SELECT 1 FROM attempts a WHERE a.question_id = q.id AND a.user_id IN {BUSIEST})
ORDER BY section, number_in_section, id LIMIT 20""")
def study_next_new(t: Tables) -> DataFrame:
    """The first questions the busiest user has not seen: an anti join, then a top-k."""
    seen = t.attempts.join(F.broadcast(busiest_user(t)), "user_id", "left_semi").select(F.col("question_id").alias("id"))
    return E.live(t.questions).join(seen, "id", "left_anti").select("id", "section", "number_in_section").orderBy("section", "number_in_section", "id").limit(20)


EXCLUDED = "15e009a1-013d-4e6e-acf3-2c7e16921df0, no id,,1F0184A5-e605-4049-a50c-581b45fac6ae, 0"  # as a caller sends them


@query("""SELECT id FROM questions WHERE NOT is_discarded AND section = 'quiz' AND number_in_section NOT IN (1, 2, 3) AND document_id <> 'none'
AND id NOT IN ('15e009a1-013d-4e6e-acf3-2c7e16921df0', '1f0184a5-e605-4049-a50c-581b45fac6ae') ORDER BY number_in_section, id LIMIT 50""")
def study_next_excluding(t: Tables) -> DataFrame:
    """Exclusion lists, as sent, parsed into literal predicates, which reach the scan."""
    own = E.live(t.questions).filter((F.col("section") == "quiz") & ~F.col("number_in_section").isin(1, 2, 3) & (F.col("document_id") != "none") & ~F.col("id").isin(*parse_ids(EXCLUDED)))
    return own.orderBy("number_in_section", "id").limit(50).select("id")


# the cascade of next_questions over all users; order: of the unseen; first, second: which of due and new comes first
CASCADE = f"""
WITH s AS ({S.SQL_STATE}), q AS (SELECT id, coalesce(needs_review, false) AS review, row_number() OVER (ORDER BY {{order}}) AS pos FROM questions WHERE NOT is_discarded),
own AS (SELECT s.user_id, s.question_id, s.due_at, q.review, q.pos, row_number() OVER (PARTITION BY s.user_id ORDER BY q.pos) AS k FROM s JOIN q ON q.id = s.question_id),
gap AS (SELECT user_id, coalesce(min(CASE WHEN pos <> k THEN k END), max(k) + 1) AS pos FROM own GROUP BY user_id),
picked AS (SELECT user_id, arg_min(question_id, (due_at, review, question_id)) FILTER (WHERE due_at <= TIMESTAMPTZ '2024-01-01 00:00:00+00') AS due, arg_min(question_id, (due_at, review, question_id)) AS later FROM own GROUP BY user_id),
c AS (SELECT u.user_id, p.due, q.id AS new, p.later FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN gap g ON g.user_id = u.user_id LEFT JOIN q ON q.pos = coalesce(g.pos, 1) LEFT JOIN picked p ON p.user_id = u.user_id)
SELECT user_id, coalesce({{first}}, {{second}}, later) AS question_id, CASE WHEN {{first}} IS NOT NULL THEN '{{first}}' WHEN {{second}} IS NOT NULL THEN '{{second}}' WHEN later IS NOT NULL THEN 'scheduled' ELSE 'none' END AS reason FROM c"""


@query(CASCADE.format(order="section, number_in_section, id", first="due", second="new"))
def study_next_all_users(t: Tables) -> DataFrame:
    """The next question of every user: the most overdue, else the first unseen, else the earliest scheduled."""
    state = S.schedule_state(E.deduplicated_attempts(t.attempts)).persist()
    return N.next_questions(state, t.questions, F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))


@query(CASCADE.format(order=f"md5(id || '{SEED}'), id", first="new", second="due"))
def study_next_prefer_new(t: Tables) -> DataFrame:
    """The next question of every user with new ones preferred, in a seeded order."""
    state = S.schedule_state(E.deduplicated_attempts(t.attempts)).persist()
    return N.next_questions(state, t.questions, F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"), prefer_new=True, seed=SEED)


@query(f"""
WITH s AS ({S.SQL_STATE}), n AS ({CASCADE.format(order="section, number_in_section, id", first="due", second="new")})
SELECT user_id, question_id, due_at, state FROM s
UNION ALL SELECT user_id, question_id, TIMESTAMPTZ '2024-01-01 00:00:00+00', 'new' FROM n WHERE reason = 'new' AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = n.user_id AND s.question_id = n.question_id)""")
def schedule_after_showing(t: Tables) -> DataFrame:
    """Schedules after every user was shown the next question: a new one gets a row unless it has one."""
    state, now = S.schedule_state(E.deduplicated_attempts(t.attempts)).persist(), F.lit("2024-01-01 00:00:00+00:00").cast("timestamp")
    return N.shown(state, N.next_questions(state, t.questions, now), now)


def _hash(*parts: str) -> F.Column:
    return F.md5(F.concat(*[F.col(p) for p in parts], F.lit(SEED)))


@query(f"""
WITH a AS (SELECT question_id, count(*) AS total, count(*) FILTER (WHERE NOT is_correct) AS wrong FROM {ATTEMPTS} WHERE user_id IN {BUSIEST} GROUP BY question_id)
SELECT q.id, coalesce(a.wrong, 0) AS wrong, coalesce(a.total, 0) AS total FROM questions q LEFT JOIN a ON a.question_id = q.id WHERE NOT q.is_discarded
ORDER BY coalesce(a.wrong, 0)::DOUBLE / greatest(coalesce(a.total, 0), 1) DESC, coalesce(a.wrong, 0) DESC, md5(q.id || '{SEED}') LIMIT 50""")
def priority_frequently_mistaken(t: Tables) -> DataFrame:
    """Questions by the share of the busiest user's wrong answers; ties by a seeded hash."""
    own = E.deduplicated_attempts(t.attempts.join(F.broadcast(busiest_user(t)), "user_id", "left_semi"))
    agg = own.groupBy(F.col("question_id").alias("id")).agg(F.count("*").alias("total"), E.count_of(~F.col("is_correct")).alias("wrong"))
    out = E.live(t.questions).select("id").join(agg, "id", "left").na.fill(0, ["total", "wrong"])
    return out.orderBy((F.col("wrong").cast("double") / F.greatest("total", F.lit(1))).desc(), F.desc("wrong"), _hash("id")).limit(50).select("id", "wrong", "total")


@query(f"""
SELECT q.id, a.question_id IS NULL AS never_viewed FROM questions q LEFT JOIN (SELECT DISTINCT question_id FROM attempts WHERE user_id IN {BUSIEST}) a ON a.question_id = q.id
WHERE NOT q.is_discarded ORDER BY (a.question_id IS NULL) DESC, md5(q.id || '{SEED}') LIMIT 50""")
def priority_never_viewed(t: Tables) -> DataFrame:
    """Questions the busiest user never saw first; ties by a seeded hash."""
    seen = t.attempts.join(F.broadcast(busiest_user(t)), "user_id", "left_semi").select(F.col("question_id").alias("id"), F.lit(True).alias("seen")).distinct()
    out = E.live(t.questions).select("id").join(seen, "id", "left").select("id", F.col("seen").isNull().alias("never_viewed"))
    return out.orderBy(F.desc("never_viewed"), _hash("id")).limit(50)


@query(f"""
WITH g AS ({G.sql_rule_tags()}), p AS (SELECT q.id, coalesce(min(g.slug), '__untagged__') AS bucket FROM questions q LEFT JOIN g ON g.id = q.id AND g.slug <> 'reti' WHERE NOT q.is_discarded GROUP BY q.id),
r AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(id || '{SEED}'), id) AS round FROM p)
SELECT id, bucket, round::INTEGER AS round FROM r ORDER BY round, md5(bucket || '{SEED}'), id LIMIT 60""")
def simulation_round_robin(t: Tables) -> DataFrame:
    """A sample that takes one question of each bucket a round; a bucket is the first specific tag.

    At most 60 rows of a bucket can be taken, so ranks beyond are pruned before the shuffle.
    """
    first = G.rule_tags(E.live(t.questions)).groupBy("id").agg(F.coalesce(F.min(F.when(F.col("slug") != "reti", F.col("slug"))), F.lit("__untagged__")).alias("bucket"))
    ranked = first.withColumn("round", F.row_number().over(Window.partitionBy("bucket").orderBy(_hash("id"), "id"))).filter("round <= 60")
    return ranked.orderBy("round", _hash("bucket"), "id").limit(60).select("id", "bucket", "round")


@query(f"""
WITH g AS ({G.sql_rule_tags()}), p AS (SELECT q.id, coalesce(min(g.slug), '__untagged__') AS bucket FROM questions q LEFT JOIN g ON g.id = q.id AND g.slug <> 'reti' WHERE NOT q.is_discarded GROUP BY q.id)
SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5(id || '{SEED}'), id) AS round FROM p""")
def simulation_interleaved(t: Tables) -> DataFrame:
    """All live questions with the round each comes in when buckets take turns: sorted by round and bucket, they are the whole interleaved list."""
    first = G.rule_tags(E.live(t.questions)).groupBy("id").agg(F.coalesce(F.min(F.when(F.col("slug") != "reti", F.col("slug"))), F.lit("__untagged__")).alias("bucket"))
    return N.interleaved(first, SEED)


@query(f"""SELECT id, document_id, section, number_in_section FROM (SELECT * FROM questions WHERE NOT is_discarded ORDER BY md5(id || '{SEED}'), id LIMIT {pool_bound(20)})""")
def simulation_pool(t: Tables) -> DataFrame:
    """The random pool for a sample of 20: six times as many rows, 600 at least, in a seeded order."""
    return E.live(t.questions).select("id", "document_id", "section", "number_in_section").orderBy(_hash("id"), "id").limit(pool_bound(20))


@query(f"""
WITH a AS (SELECT simulation_id, question_id, arg_max(is_correct, (answered_at, id)) AS is_correct, max(answered_at) AS answered_at, count(*) AS answers FROM {ATTEMPTS} WHERE simulation_id IS NOT NULL GROUP BY ALL)
SELECT a.simulation_id, a.question_id, a.is_correct, a.answered_at, a.answers, q.section, coalesce(q.is_discarded, true) AS is_gone FROM a LEFT JOIN questions q ON q.id = a.question_id""")
def simulation_detail(t: Tables) -> DataFrame:
    """The last answer to each question of each simulation, with the question as it is now."""
    own = E.deduplicated_attempts(t.attempts.filter("simulation_id IS NOT NULL")).groupBy("simulation_id", "question_id")
    last = own.agg(F.max(F.struct("answered_at", "id", "is_correct"))["is_correct"].alias("is_correct"), F.max("answered_at").alias("answered_at"), F.count("*").alias("answers"))
    out = last.join(t.questions.select(F.col("id").alias("question_id"), "section", "is_discarded"), "question_id", "left")
    return out.select("simulation_id", "question_id", "is_correct", "answered_at", "answers", "section", F.coalesce("is_discarded", F.lit(True)).alias("is_gone"))


@query(f"""
WITH f AS (SELECT simulation_id, question_id, min(answered_at) AS first_at FROM {ATTEMPTS} WHERE simulation_id IS NOT NULL GROUP BY ALL)
SELECT simulation_id, count(*) AS n, string_agg(question_id, ',' ORDER BY first_at, question_id) AS question_ids FROM f GROUP BY simulation_id""")
def simulation_from_questions(t: Tables) -> DataFrame:
    """The questions of each simulation in the order first answered, each once; a simulation is a sitting of one user."""
    first = t.attempts.filter("simulation_id IS NOT NULL").groupBy("simulation_id", "question_id").agg(F.min("answered_at").alias("at"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "question_id"))), lambda x: x["question_id"])
    return first.groupBy("simulation_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("question_ids"))


def option_id(c: str) -> F.Column:
    """An option id as written in any way: trimmed, without closing marks, in lower case; empty is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(F.col(c)), r"[).:\s]+$", ""))), F.lit(""))


SQL_OPTION = "nullif(lower(trim(regexp_replace(trim({c}), '[).:\\s]+$', ''))), '')"


@query(f"""
WITH s AS (SELECT id, CASE WHEN json_valid(solution_json) THEN solution_json ->> '$.correct_option_id' END AS solution FROM questions WHERE question_type = 'multiple_choice')
SELECT c.user_id, c.question_id, coalesce({SQL_OPTION.format(c='c.correct_option_id')}, {SQL_OPTION.format(c='s.solution')}) AS correct_option,
  CASE WHEN {SQL_OPTION.format(c='c.correct_option_id')} IS NULL AND {SQL_OPTION.format(c='s.solution')} IS NULL THEN 0 WHEN {SQL_OPTION.format(c='c.correct_option_id')} = {SQL_OPTION.format(c='s.solution')} THEN 4 ELSE 1 END::INTEGER AS grade
FROM question_corrections c JOIN s ON s.id = c.question_id""")
def grade_answer(t: Tables) -> DataFrame:
    """The option held correct by a correction, else by the solution; grade 4 where both agree, 1 where not, 0 where neither is given."""
    solution = F.try_variant_get(F.try_parse_json("solution_json"), "$.correct_option_id", "string")
    q = t.questions.filter("question_type = 'multiple_choice'").select(F.col("id").alias("question_id"), solution.alias("solution"))
    own = t.question_corrections.select("user_id", "question_id", "correct_option_id").join(q, "question_id")
    a, b = option_id("correct_option_id"), option_id("solution")
    grade = F.when(a.isNull() & b.isNull(), 0).when(a == b, 4).otherwise(1)
    return own.select("user_id", "question_id", F.coalesce(a, b).alias("correct_option"), grade.cast("int").alias("grade"))
