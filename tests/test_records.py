import random

import pytest
from pyspark.sql import functions as F

from quizloom.functions import pages
from quizloom.operators import asked, parse, records, study, tags
from quizloom.sources import files, tables

def now():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


STATE = "user_id string, question_id string, due_at timestamp, state string"
QUESTIONS = "id string, section string, number_in_section int, needs_review boolean, is_discarded boolean"


def test_what_callers_type():
    good = "15e009a1-013d-4e6e-acf3-2c7e16921df0"
    assert asked.parse_ids(f" {good.upper()} ,x,,{good}") == [good, good] and asked.parse_ids(None) == [] and len(asked.parse_ids(",".join([good] * 500))) == 400
    assert asked.parse_tags("dns, \"tcp ip\"\n'nat',,dns,\"\"") == ["dns", "tcp ip", "nat"] and asked.parse_tags("") == [] and len(asked.parse_tags(",".join(map(str, range(99))))) == 30
    assert (asked.clamp(None, 50), asked.clamp(0, 50), asked.clamp(9999, 50)) == (50, 1, 500) and (asked.pool_bound(1), asked.pool_bound(200)) == (600, 1200)


def test_positions_number_all_rows_in_order(spark):
    values = list(range(1000))
    random.Random(4).shuffle(values)
    out = study.positions(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), "v").collect()
    assert sorted((r.v, r.pos) for r in out) == [(v, v + 1) for v in range(1000)]
    assert study.positions(spark.createDataFrame([], "v int"), "v").collect() == []


def test_tiers(spark):
    questions = spark.createDataFrame([("a", "quiz", 1, False, False), ("b", "quiz", 2, True, False), ("c", "quiz", 3, None, False), ("d", "quiz", 4, False, True)], QUESTIONS)
    past, later = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
    rows = [("due", "b", past), ("due", "c", past), ("due", "a", later), ("new", "a", later), ("late", "a", later), ("late", "b", "2024-01-20 00:00:00"), ("late", "c", later), ("odd", "d", past)]
    state = spark.createDataFrame([(u, q, d, "review") for u, q, d in rows], "user_id string, question_id string, due_at string, state string").withColumn("due_at", F.col("due_at").cast("timestamp"))
    own = {r.user_id: (r.question_id, r.reason) for r in study.next_questions(state, questions, now()).collect()}
    assert own == {"due": ("c", "due"), "new": ("b", "new"), "late": ("b", "scheduled"), "odd": ("a", "new")}  # of those due at one time the one without review comes first
    two = state.filter("user_id <> 'due'").union(spark.createDataFrame([("x", "b", "r")], "user_id string, question_id string, state string").select("user_id", "question_id", now(), "state"))
    prefer = {r.user_id: r.reason for r in study.next_questions(two, questions, now(), prefer_new=True, seed="s").collect()}
    assert prefer == {"new": "new", "late": "scheduled", "odd": "new", "x": "new"}
    after = study.shown(state, study.next_questions(state, questions, now()), now()).filter("state = 'new'").collect()
    assert {(r.user_id, r.question_id) for r in after} == {("new", "b"), ("odd", "a")}
    none = study.next_questions(spark.createDataFrame([], STATE), spark.createDataFrame([], QUESTIONS), now())
    assert none.collect() == []
    assert [r.reason for r in study.next_questions(state.filter("user_id = 'odd'"), questions.filter("id = 'd'"), now()).collect()] == ["none"]


def test_interleaving_takes_turns(spark):
    rows = [(f"{i:03}", "ab"[i % 3 == 0]) for i in range(90)]
    out = study.interleaved(spark.createDataFrame(rows, "id string, bucket string"), "7").collect()
    for bucket in "ab":
        assert sorted(r["round"] for r in out if r.bucket == bucket) == list(range(1, 1 + sum(b == bucket for _, b in rows)))


def test_generated_corrections_respect_or_replace(spark):
    schema = "user_id string, question_id string, correct_option_id string, explanation_text string, answer_payload string, reviewed_at timestamp"
    old = spark.createDataFrame([("u", "1", None, "mine", "{}", None), ("u", "2", "a", "  ", None, None), ("u", "3", "b", "kept", None, None)], schema)
    new = spark.createDataFrame([("u", "1", "c", "theirs", "p"), ("u", "2", "d", "text", "p"), ("u", "3", "", " ", "p"), ("v", "1", None, "first", "p")], schema.rsplit(",", 1)[0])
    pick = lambda df: {(r.user_id, r.question_id): (r.correct_option_id, r.explanation_text, r.answer_payload, r.reviewed_at is not None) for r in df.collect()}
    assert pick(records.corrections_generated(old, new, now())) == {("u", "1"): ("c", "mine", "{}", True), ("u", "2"): ("a", "text", None, True), ("u", "3"): ("b", "kept", None, False), ("v", "1"): (None, "first", "p", True)}
    assert pick(records.corrections_generated(old, new, now(), overwrite=True))["u", "1"] == ("c", "theirs", "{}", True)


def test_progress_and_chain(spark):
    jobs = spark.createDataFrame([("j", 3, ["x"]), ("k", 0, None)], "job string, total long, failures array<string>")
    results = spark.createDataFrame([("j", "b", "failed"), ("j", "a", "failed"), ("j", "c", "succeeded"), ("j", "d", "skipped")], "job string, item string, outcome string")
    out = {r.job: (r.processed, r.succeeded, r.failed, r.skipped, r.failures, r.percent) for r in records.job_progress(jobs, results).collect()}
    assert out == {"j": (4, 1, 2, 1, ["x", "a", "b"], 100), "k": (0, 0, 0, 0, [], 0)}
    rows = [(" B) ", '{"selected_option_raw":"c"}', None, "b"), (None, '{"selected_option_raw":"c."}', None, "c"), ("", "[", '{"choice":"D"}', "d"), (None, None, '{"correct_options":["a","b"]}', "a"), (None, None, "{", None)]
    df = spark.createDataFrame(rows, "o string, p string, s string, want string")
    assert [r.got == r.want for r in df.select(records.correct_option(F.col("o"), F.col("p"), F.col("s")).alias("got"), "want").collect()] == [True] * 5


def test_tags_of_overlapping_keywords_and_odd_texts(spark):
    rows = [("1", "ADSL https tcp", '[{"id":"a","text":"stack"}]', None), ("2", None, "[", ""), ("3", "x" * 20000, None, None)]
    out = {(r.id, r.slug): float(r.score) for r in tags.rule_tags(spark.createDataFrame(rows, "id string, stem string, options_json string, subparts_json string")).collect()}
    assert out["1", "adsl"] == 0.7 and out["1", "dsl"] == 0.7 and out["1", "http"] == 0.85 and out["1", "tcp"] == 0.85 and out["2", "reti"] == out["3", "reti"] == 0.5
    assert [k for k in out if k[0] in "23"] == [("2", "reti"), ("3", "reti")]


def test_light_parser():
    lines = ["1. Uno?", "ancora", "a. x", "2) no", "1. Due", "DOMANDA TEORIA", "Spiegare.", "2. dentro", "ESERCIZIO 1", "dati", "1) primo", "ESERCIZIO 2"]
    own = [(q.section, q.number, q.kind, q.stem, len(q.options), len(q.subparts)) for q in parse.parse_light(lines)]
    assert own == [
        ("quiz", 1, "multiple_choice", "Uno? ancora", 1, 0), ("quiz", 1, "multiple_choice", "Due", 0, 0), ("teoria", 1, "open_text", "Spiegare. 2. dentro", 0, 0),
        ("esercizio", 1, "multi_part_open", "ESERCIZIO 1 dati", 0, 1), ("esercizio", 2, "open_text", "ESERCIZIO 2", 0, 0),
    ]
    assert parse.parse_light([]) == []


def test_ladder_stops_at_the_first_good_one(spark):
    good, bad = "1. x\n" * 12 + "a" * 3000, "short"
    rows = [(good, bad, None), (bad, good, good * 2), (bad, None, bad + "er"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(pages.extraction_ladder({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}).alias("x"))
    assert [(r.x.method, r.x.is_weak) for r in df.collect()] == [("a", False), ("b", False), ("c", True), ("a", True)]


def test_reports_and_the_shared_folder(spark, tmp_path, monkeypatch):
    (tmp_path / "r.json").write_text('{"a": 1,\n "b": [2]}')
    assert files.read_report(spark, str(tmp_path / "r.json"), "a int, b array<int>").first().asDict() == {"a": 1, "b": [2]}

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    class NoDir:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    Context._jsc = NoDir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.use_checkpoint_dir(Session())
