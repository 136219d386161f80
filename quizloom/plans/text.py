"""Text, option, tag and fingerprint queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.functions import items as I
from quizloom.functions import text as X
from quizloom.operators import tags as G
from quizloom.operators.asked import parse_tags
from quizloom.plans.queryset import Tables, query
from quizloom.sources.tables import spread

OPTS, SUBS = I.sql_options(), I.sql_subparts()


@query(f"SELECT id, {X.sql_clean('stem')} AS clean FROM questions")
def clean_text(t: Tables) -> DataFrame:
    return t.questions.select("id", X.clean_text(F.col("stem")).alias("clean"))


@query(f"SELECT id, {X.sql_canonical('stem')} AS canonical FROM questions")
def canonical_text(t: Tables) -> DataFrame:
    return t.questions.select("id", X.canonical_text(F.col("stem")).alias("canonical"))


@query(f"SELECT id, to_json({OPTS})::VARCHAR AS options, to_json({SUBS})::VARCHAR AS subparts FROM questions")
def clean_options(t: Tables) -> DataFrame:
    """Options and subparts decoded, cleaned and sorted by id, written as JSON."""
    return t.questions.select("id", F.to_json(I.clean_options(F.col("options_json"))).alias("options"), F.to_json(I.clean_subparts(F.col("subparts_json"))).alias("subparts"))


@query(f"""
WITH o AS (SELECT id, unnest({OPTS}, recursive := false) AS o FROM questions WHERE question_type = 'multiple_choice'),
r AS (SELECT id, o.text AS text, row_number() OVER (PARTITION BY id ORDER BY {X.sql_option('o.text')}, o.id, o.text) AS n FROM o)
SELECT id, n::INTEGER AS position, CASE WHEN n <= 26 THEN chr((96 + n)::INTEGER) ELSE n::VARCHAR END AS letter, text FROM r""")
def canonical_options(t: Tables) -> DataFrame:
    """Options of multiple-choice questions re-lettered in the order of their canonical texts."""
    own = t.questions.filter("question_type = 'multiple_choice'").select("id", F.posexplode(I.relettered(I.clean_options(F.col("options_json")))).alias("at", "o"))
    return own.select("id", (F.col("at") + 1).alias("position"), F.col("o.id").alias("letter"), F.col("o.text").alias("text"))


def with_fingerprint(questions: DataFrame) -> DataFrame:
    """The questions with their computed fingerprint."""
    own = I.fingerprint(F.col("question_type"), F.col("stem"), I.clean_options(F.col("options_json")), I.clean_subparts(F.col("subparts_json")))
    return spread(questions).withColumn("fingerprint", own)


FINGERPRINTS = f"(SELECT *, {I.sql_fingerprint()} AS fingerprint FROM (SELECT *, {OPTS} AS o, {SUBS} AS s FROM questions))"


@query(f"SELECT id, fingerprint, coalesce(fingerprint = dedupe_fingerprint, false) AS as_stored FROM {FINGERPRINTS}")
def fingerprint(t: Tables) -> DataFrame:
    """The fingerprint of each question, computed from the stored text, and whether the stored one agrees."""
    return with_fingerprint(t.questions).select("id", "fingerprint", F.coalesce(F.col("fingerprint") == F.col("dedupe_fingerprint"), F.lit(False)).alias("as_stored"))


@query(f"""
SELECT id, sha1(question_type || '##' || {X.sql_canonical('stem')} || '##' || array_to_string(list_transform(o, lambda x: {X.sql_option('x.text')}), '|')) AS fingerprint
FROM (SELECT *, {OPTS} AS o FROM questions WHERE question_type = 'multiple_choice')""")
def fingerprint_mcq(t: Tables) -> DataFrame:
    """The second fingerprint: numbers kept, options in order of their ids."""
    own = t.questions.filter("question_type = 'multiple_choice'")
    return own.select("id", I.plain_fingerprint(F.col("question_type"), F.col("stem"), I.clean_options(F.col("options_json"))).alias("fingerprint"))


@query(f"""
SELECT id, trim(regexp_replace(lower(coalesce(course, '')), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-') AS slug,
  coalesce(nullif(trim(regexp_replace({X.sql_bare("coalesce(course, '')")}, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'tag') AS ascii_slug FROM exam_documents""")
def slugify(t: Tables) -> DataFrame:
    return t.exam_documents.select("id", X.slugify(F.col("course")).alias("slug"), X.ascii_slug(F.col("course")).alias("ascii_slug"))


def _oracle_uuid() -> str:
    h = f"sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode(section || ':' || number_in_section || ':' || left(stem, 50)))"
    return f"""SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::INTEGER % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stable_id
FROM (SELECT id, {h} AS h FROM questions)"""


@query(_oracle_uuid())
def stable_ids(t: Tables) -> DataFrame:
    """A name-based UUID of section, number and the head of the stem."""
    name = F.concat_ws(":", "section", F.col("number_in_section").cast("string"), F.substring("stem", 1, 50))
    return t.questions.select("id", I.uuid5(uuid.NAMESPACE_URL.bytes, name).alias("stable_id"))


@query("""
SELECT id FROM (SELECT id, lower(concat_ws(' ', stem, options_json, subparts_json)) AS b, question_type FROM questions) WHERE b LIKE '%router%' AND question_type = 'multiple_choice'""")
def full_text_filter(t: Tables) -> DataFrame:
    """Questions of a type whose texts contain a needle."""
    blob = F.lower(F.concat_ws(" ", "stem", "options_json", "subparts_json"))
    return t.questions.filter((F.col("question_type") == "multiple_choice") & F.contains(blob, F.lit("router"))).select("id")


@query(f"""
WITH c AS (SELECT id, question_type, {X.sql_canonical('stem')} AS c, len({OPTS}) AS n FROM questions)
SELECT id, (length(c) < 12 OR regexp_matches(c, '^(altre prove|intercorso e simili|test di capitolo|pagina \\d+)$')) AS is_noise,
  ((question_type = 'multiple_choice' AND n < 2) OR (question_type = 'open_text' AND length(c) < 20)) AS is_thin FROM c""")
def noise_filter(t: Tables) -> DataFrame:
    """Stems too short or made of a heading, and questions too thin for their type."""
    c, kind = X.canonical_text(F.col("stem")), F.col("question_type")
    n = F.size(I.clean_options(F.col("options_json")))
    noise = (F.length(c) < 12) | c.rlike(r"^(altre prove|intercorso e simili|test di capitolo|pagina \d+)$")
    return t.questions.select("id", noise.alias("is_noise"), (((kind == "multiple_choice") & (n < 2)) | ((kind == "open_text") & (F.length(c) < 20))).alias("is_thin"))


@query(G.sql_rule_tags())
def rule_tags(t: Tables) -> DataFrame:
    """(id, slug, score) of the tags whose keywords occur in a question's texts."""
    return G.rule_tags(t.questions)


@query(G.sql_parser_tags())
def parser_tags(t: Tables) -> DataFrame:
    """(id, tags) by the short keyword map, sorted."""
    return t.questions.select("id", F.array_join(G.parser_tags(F.col("stem")), ",").alias("tags"))


@query("""
SELECT raw_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(tags, lambda x: x IN ('tcp', 'udp', 'dns', 'http', 'nat')))), ','), '') AS allowed FROM incoming_questions""")
def tag_allowed_filter(t: Tables) -> DataFrame:
    """Suggested tags that are allowed, each once."""
    allowed = F.array(*[F.lit(x) for x in ("tcp", "udp", "dns", "http", "nat")])
    return t.incoming_questions.select("raw_id", F.coalesce(F.array_join(F.array_sort(F.array_intersect("tags", allowed)), ","), F.lit("")).alias("allowed"))


@query(f"""WITH g AS ({G.sql_rule_tags()}) SELECT slug, count(*) AS questions, max(score) AS best FROM g WHERE slug ILIKE '%t%p%' GROUP BY slug""")
def tag_search(t: Tables) -> DataFrame:
    """Tags whose slug matches a pattern; a % of the caller stays a wildcard."""
    return G.rule_tags(t.questions).filter(F.ilike(F.col("slug"), F.lit("%t%p%"))).groupBy("slug").agg(F.count("*").alias("questions"), F.max("score").alias("best"))


@query(f"""WITH g AS ({G.sql_rule_tags()}) SELECT id, string_agg(slug, ',' ORDER BY slug) AS slugs, count(*) AS n FROM g GROUP BY id""")
def question_tags_list(t: Tables) -> DataFrame:
    """Slugs of each question in order."""
    return G.rule_tags(t.questions).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"), F.count("*").alias("n"))


WANTED = "dns, 'nat'\n\"firewall\",, dns"  # as a caller types them


@query(f"""WITH g AS ({G.sql_rule_tags()}) SELECT id FROM questions q WHERE EXISTS (SELECT 1 FROM g WHERE g.id = q.id AND g.slug IN ('dns', 'nat', 'firewall')) AND NOT is_discarded""")
def questions_with_any_tag(t: Tables) -> DataFrame:
    """Live questions that have any of the tags: a left semi join."""
    hits = G.rule_tags(t.questions).filter(F.col("slug").isin(*parse_tags(WANTED))).select("id")
    return t.questions.filter("NOT is_discarded").select("id").join(hits, "id", "left_semi")


@query(f"""
WITH g AS ({G.sql_rule_tags()}), p AS (SELECT * FROM {G.sql_presets()})
SELECT id FROM questions q WHERE EXISTS (SELECT 1 FROM g JOIN p ON p.slug = g.slug WHERE g.id = q.id AND p.preset = 'transport')""")
def questions_in_preset(t: Tables) -> DataFrame:
    """Questions with a tag of a preset; presets are a small fixed table."""
    members = G.presets(t.spark).filter("preset = 'transport'").select("slug")
    return t.questions.select("id").join(G.rule_tags(t.questions).join(F.broadcast(members), "slug", "left_semi").select("id"), "id", "left_semi")


@query(f"""
WITH g AS ({G.sql_rule_tags()}), n AS (SELECT slug, count(*) AS n FROM g GROUP BY slug), names AS (SELECT DISTINCT preset FROM {G.sql_presets()} UNION SELECT 'empty')
SELECT names.preset, coalesce(string_agg(presets.slug, ',' ORDER BY presets.slug), '') AS slugs, coalesce(sum(n.n), 0)::BIGINT AS questions
FROM names LEFT JOIN {G.sql_presets()} ON presets.preset = names.preset LEFT JOIN n ON n.slug = presets.slug GROUP BY names.preset""")
def tag_presets(t: Tables) -> DataFrame:
    """Presets with their tags in order; a preset without tags gives an empty list."""
    names = G.presets(t.spark).select("preset").distinct().union(t.spark.range(1).select(F.lit("empty").alias("preset")))
    n = G.rule_tags(t.questions).groupBy("slug").agg(F.count("*").alias("n"))
    out = names.join(G.presets(t.spark), "preset", "left").join(n, "slug", "left")
    return out.groupBy("preset").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"), F.coalesce(F.sum("n"), F.lit(0)).alias("questions"))


@query(f"""
WITH g AS ({G.sql_rule_tags()}), d AS (SELECT id FROM exam_documents WHERE regexp_matches(title, '(?i)^(esame|traccia)_.*\\.pdf$'))
SELECT DISTINCT g.slug FROM questions q JOIN d ON d.id = q.document_id JOIN g ON g.id = q.id""")
def preset_from_titles(t: Tables) -> DataFrame:
    """Tags of the questions of documents whose title has a given shape."""
    docs = t.exam_documents.filter(F.col("title").rlike(r"(?i)^(esame|traccia)_.*\.pdf$")).select(F.col("id").alias("document_id"))
    return G.rule_tags(t.questions.join(docs, "document_id", "left_semi")).select("slug").distinct()


@query(f"""
WITH g AS ({G.sql_rule_tags()}), a AS (SELECT id, string_agg(slug, ',' ORDER BY slug) AS tags FROM g GROUP BY id)
SELECT q.id, q.document_id, q.section, q.number_in_section, coalesce(a.tags, '') AS tags FROM questions q LEFT JOIN a ON a.id = q.id WHERE NOT q.is_discarded""")
def question_pool(t: Tables) -> DataFrame:
    """Live questions with their tags gathered first and joined once."""
    tags = G.rule_tags(t.questions).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("tags"))
    return t.questions.filter("NOT is_discarded").join(tags, "id", "left").select("id", "document_id", "section", "number_in_section", F.coalesce("tags", F.lit("")).alias("tags"))


@query(f"""
WITH g AS ({G.sql_rule_tags()}), a AS (SELECT id, list(slug ORDER BY slug) AS tags FROM g GROUP BY id)
SELECT q.id, to_json({{'id': q.id, 'stem': q.stem, 'tags': coalesce(a.tags, [])}})::VARCHAR AS line FROM questions q LEFT JOIN a ON a.id = q.id WHERE NOT q.is_discarded""")
def export_questions_tags(t: Tables) -> DataFrame:
    """One JSON line per live question."""
    tags = G.rule_tags(t.questions).groupBy("id").agg(F.array_sort(F.collect_list("slug")).alias("tags"))
    own = t.questions.filter("NOT is_discarded").join(tags, "id", "left")
    return own.select("id", F.to_json(F.struct("id", "stem", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("line"))
