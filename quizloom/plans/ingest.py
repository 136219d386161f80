"""Queries on extracted pages and on candidates from a second extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions import items as I
from quizloom.functions import pages as P
from quizloom.operators import parse as R
from quizloom.plans.queryset import Tables, query

MARKS = P.MARKERS
WHITE = r"[\s\x0B\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


def sql_quality(text: str) -> str:
    return (
        f"round(0.65 * least(1.0, length(regexp_replace(coalesce({text}, ''), '{WHITE}', '', 'g')) / 7000.0)"
        f" + 0.35 * least(1.0, len(regexp_extract_all(coalesce({text}, ''), '{MARKS}')) / 10.0) + 1e-9, 3)"
    )


@query(f"SELECT doc_id, {sql_quality('text')} AS quality FROM documents")
def extraction_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.quality(F.col("text")).alias("quality"))


@query(f"""
WITH v AS (SELECT doc_id, 'plain' AS method, 1 AS preference, text FROM documents UNION ALL SELECT doc_id, 'title', 2, concat_ws(chr(10), title, text) FROM documents WHERE {sql_quality('text')} < 0.45),
q AS (SELECT doc_id, method, {sql_quality('text')} AS quality, row_number() OVER (PARTITION BY doc_id ORDER BY {sql_quality('text')} DESC, preference) AS k FROM v)
SELECT doc_id, method, quality, quality < 0.45 AS is_weak FROM q WHERE k = 1""")
def extraction_best_of(t: Tables) -> DataFrame:
    """The best of two extractions of each document; the second is only made where the first is weak."""
    plain = P.quality(F.col("text"))
    other = P.quality(F.concat_ws("\n", "title", "text"))
    own = t.documents.select("doc_id", plain.alias("a"), F.when(plain < 0.45, other).alias("b")).distinct()
    second = F.coalesce(F.col("b") > F.col("a"), F.lit(False))
    quality = F.when(second, F.col("b")).otherwise(F.col("a"))
    return own.select("doc_id", F.when(second, "title").otherwise("plain").alias("method"), quality.alias("quality"), (quality < 0.45).alias("is_weak"))


@query(f"""
WITH v AS (SELECT doc_id, 'text' AS method, 1 AS step, {sql_quality("split_part(text, chr(10) || chr(10), 1)")} AS quality FROM documents
UNION ALL SELECT doc_id, 'pages', 2, {sql_quality('text')} FROM documents UNION ALL SELECT doc_id, 'title', 3, {sql_quality('concat_ws(chr(10), title, text)')} FROM documents),
k AS (SELECT doc_id, min(step) FILTER (WHERE quality >= 0.45) AS good FROM v GROUP BY doc_id),
r AS (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id ORDER BY quality DESC, step) AS n FROM v JOIN k ON k.doc_id = v.doc_id WHERE good IS NULL OR step <= good)
SELECT doc_id, method, quality, quality < 0.45 AS is_weak FROM r WHERE n = 1""")
def extraction_ladder(t: Tables) -> DataFrame:
    """Three extractions of each document, from the cheapest on, as far as needed: its first page, all pages, pages with the title."""
    steps = {"text": F.element_at(F.split("text", "\n\n"), 1), "pages": F.col("text"), "title": F.concat_ws("\n", "title", "text")}
    out = t.documents.select("doc_id", P.extraction_ladder(steps).alias("x"))
    return out.select("doc_id", "x.method", "x.quality", "x.is_weak")


@query(r"""
WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(x, '^[\s\x0B\x{00a0}]+', ''), '[\s\x0B\x{00a0}]+$', '')) AS lines FROM documents)
SELECT doc_id, array_to_string(list_filter(lines, lambda x: x <> '' AND NOT (starts_with(x, '-- ') AND contains(x, ' of ')) AND NOT starts_with(lower(x), 'studente') AND NOT starts_with(lower(x), 'risposte')
  AND lower(x) NOT IN ('corrette', 'teoria', 'tot') AND NOT (contains(lower(x), 'cognome') AND contains(lower(x), 'matricola'))), chr(10)) AS lines FROM l""")
def clean_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(P.clean_lines(F.col("text")), "\n").alias("lines"))


@query()
def split_markers(t: Tables) -> DataFrame:
    """Marker splitting needs look-behind, which DuckDB's patterns lack."""
    return t.documents.filter("text IS NOT NULL").select("doc_id", P.split_markers(F.col("text")).alias("text"))


@query()
def parse_questions(t: Tables) -> DataFrame:
    """Typed questions from sheets rebuilt out of the corpus texts."""
    return R.parse_documents(t.documents.select(F.col("doc_id").alias("id"), "text"))


def sheets(t: Tables) -> DataFrame:
    """(id, text): an exam sheet a document, written from its plain quiz questions in order of their numbers."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    odd = r"(?i)\b[a-d]\.\s|\d\s*[.)]\s|domanda|esercizio|^-- "
    options = F.array_sort(I.clean_options(F.col("options_json")))
    own = t.questions.filter("section = 'quiz' AND question_type = 'multiple_choice'").select("document_id", "number_in_section", plain(F.col("stem")).alias("stem"), options.alias("o"))
    letters = F.transform("o", lambda x: x["id"])
    kept = own.filter((F.size("o") >= 2) & (letters == F.slice(F.array(*map(F.lit, "abcd")), 1, F.size("o"))) & (F.col("stem") != "") & ~F.col("stem").rlike(odd) & ~F.array_join(F.transform("o", lambda x: x["text"]), "\n").rlike(odd))
    lines = F.concat_ws("\n", F.concat(F.lit("DOMANDA "), F.col("number_in_section").cast("string")), "stem", F.array_join(F.transform("o", lambda x: F.concat(x["id"], F.lit(". "), x["text"])), "\n"))
    return kept.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number_in_section", lines.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


@query(rf"""
WITH q AS (SELECT document_id, number_in_section, trim(regexp_replace(stem, '\s+', ' ', 'g')) AS stem, {I.sql_options()} AS o FROM questions WHERE section = 'quiz' AND question_type = 'multiple_choice')
SELECT document_id AS id, number_in_section, stem, len(o)::INTEGER AS options FROM q WHERE len(o) BETWEEN 2 AND 4 AND list_transform(o, lambda x: x.id) = list_slice(['a', 'b', 'c', 'd'], 1, len(o)) AND stem <> ''
  AND NOT regexp_matches(stem, '(?i)\b[a-d]\.\s|\d\s*[.)]\s|domanda|esercizio|^-- ') AND NOT regexp_matches(array_to_string(list_transform(o, lambda x: x.text), chr(10)), '(?i)\b[a-d]\.\s|\d\s*[.)]\s|domanda|esercizio|^-- ')""")
def parse_sheets(t: Tables) -> DataFrame:
    """The questions parsed back from sheets that were written from the bank: as many, with the same numbers, stems and options."""
    own = R.parse_documents(sheets(t))
    return own.select("id", "number_in_section", "stem", F.json_array_length("options_json").alias("options"))


@query()
def parse_questions_light(t: Tables) -> DataFrame:
    """Questions by the light form of the parser."""
    return R.parse_documents(t.documents.select(F.col("doc_id").alias("id"), "text"), light=True)


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS page, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS no FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, no, CASE WHEN length(trim(page)) >= 80 THEN 'text' WHEN trim(page) <> '' THEN 'image' ELSE 'empty' END AS kind FROM p),
g AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id, kind ORDER BY no) AS island FROM k)
SELECT doc_id, kind, min(no) AS start_page, max(no) AS end_page FROM g GROUP BY doc_id, kind, island""")
def page_segments(t: Tables) -> DataFrame:
    """Runs of pages of one kind; a page is a paragraph here, and one document's pages make a window."""
    page = t.documents.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("at", "page"))
    bare = F.trim("page")
    kind = F.when(F.length(bare) >= 80, "text").when(bare != "", "image").otherwise("empty")
    own = page.select("doc_id", (F.col("at") + 1).cast("long").alias("no"), kind.alias("kind"))
    island = F.col("no") - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("no"))
    return own.withColumn("island", island).groupBy("doc_id", "kind", "island").agg(F.min("no").alias("start_page"), F.max("no").alias("end_page")).drop("island")


@query("""
SELECT id, question_type, needs_review, n AS options FROM (SELECT *, CASE WHEN json_valid(options_json) AND json_type(options_json) = 'ARRAY' THEN json_array_length(options_json) ELSE 0 END::INTEGER AS n FROM questions)
WHERE (question_type = 'multiple_choice' AND n < 4) OR needs_review""")
def weak_items(t: Tables) -> DataFrame:
    """Questions that a second extraction should look at."""
    n = F.coalesce(F.json_array_length("options_json"), F.lit(0))
    own = t.questions.select("id", "question_type", "needs_review", n.alias("options"))
    return own.filter(((F.col("question_type") == "multiple_choice") & (F.col("options") < 4)) | F.col("needs_review"))


OPTS, SUBS = I.sql_options(), I.sql_subparts()


@query(f"""
WITH c AS (SELECT document_id, section, number_in_section, stem, len({OPTS}) AS o, len({SUBS}) AS s, raw_id, row_number() OVER (PARTITION BY document_id, section, number_in_section ORDER BY raw_id) AS k
  FROM incoming_questions WHERE section IS NOT NULL AND number_in_section IS NOT NULL),
q AS (SELECT document_id, section, number_in_section, id, stem, question_type, len({OPTS}) AS o, len({SUBS}) AS s, confidence FROM questions)
SELECT coalesce(q.document_id, c.document_id) AS document_id, coalesce(q.section, c.section) AS section, coalesce(q.number_in_section, c.number_in_section) AS number_in_section, q.id IS NULL AS is_new,
  CASE WHEN q.id IS NULL OR length(c.stem) > 1.15 * length(q.stem) THEN c.stem ELSE q.stem END AS stem, coalesce(greatest(q.o, CASE WHEN q.question_type = 'multiple_choice' THEN c.o END), c.o)::INTEGER AS options,
  coalesce(greatest(q.s, c.s), c.s)::INTEGER AS subparts,
  CASE WHEN q.id IS NULL THEN 0.75 WHEN c.raw_id IS NOT NULL AND (length(c.stem) > 1.15 * length(q.stem) OR (q.question_type = 'multiple_choice' AND c.o > q.o) OR c.s > q.s) THEN greatest(least(0.95, coalesce(q.confidence, 0) + 0.1), 0)
       ELSE coalesce(q.confidence, 0) END::DECIMAL(4,2) AS confidence
FROM q FULL JOIN (SELECT * FROM c WHERE k = 1) c ON c.document_id = q.document_id AND c.section = q.section AND c.number_in_section = q.number_in_section""")
def candidate_merge(t: Tables) -> DataFrame:
    """Candidates merged into the bank by document, section and number: longer stems and lists replace, any change raises confidence."""
    keys = ["document_id", "section", "number_in_section"]
    raw = t.incoming_questions.filter("section IS NOT NULL AND number_in_section IS NOT NULL")
    n = lambda f, c: F.size(f(F.col(c)))
    cand = raw.select(*keys, F.struct("raw_id", "stem", n(I.clean_options, "options_json").alias("o"), n(I.clean_subparts, "subparts_json").alias("s")).alias("c"))
    cand = cand.groupBy(*keys).agg(F.min("c").alias("c")).select(*keys, F.col("c.stem").alias("c_stem"), F.col("c.o").alias("c_o"), F.col("c.s").alias("c_s"))
    bank = t.questions.select(*keys, "id", "stem", "question_type", "confidence", n(I.clean_options, "options_json").alias("o"), n(I.clean_subparts, "subparts_json").alias("s"))
    both = bank.join(cand, keys, "full_outer")
    new, choice = F.col("id").isNull(), F.col("question_type") == "multiple_choice"
    longer = F.length("c_stem") > 1.15 * F.length("stem")
    changed = F.coalesce(longer | (choice & (F.col("c_o") > F.col("o"))) | (F.col("c_s") > F.col("s")), F.lit(False))
    base = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    return both.select(
        *keys, new.alias("is_new"), F.when(new | F.coalesce(longer, F.lit(False)), F.col("c_stem")).otherwise(F.col("stem")).alias("stem"),
        F.coalesce(F.greatest("o", F.when(choice, F.col("c_o"))), F.col("c_o")).alias("options"), F.coalesce(F.greatest("s", "c_s"), F.col("c_s")).alias("subparts"),
        F.when(new, F.lit(0.75)).when(changed, F.least(F.lit(0.95), base + 0.1)).otherwise(base).cast("decimal(4,2)").alias("confidence"),
    )
