import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quizloom.functions import pages
from quizloom.operators import merge, parse, schedule
from quizloom.sources import files
from quizloom.streaming import schedule as stream

UTC = dt.timezone.utc
START = dt.datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "id string, user_id string, question_id string, answered_at timestamp, is_correct boolean"


def fold(rows):
    state = {}
    for i, user, question, at, ok in sorted(rows, key=lambda r: (r[3], r[0])):
        lapses, reps = state.get((user, question), (None, 0, 0))[1:3]
        ok = bool(ok)
        due = at + dt.timedelta(minutes=stream.minutes(ok, lapses, reps))
        state[user, question] = (due, lapses + (not ok), reps + ok)
    return state


def some_attempts(n=300, seed=3):
    rng = random.Random(seed)
    return [(f"{i:04}", rng.choice("uv"), rng.choice("abc"), START + dt.timedelta(minutes=rng.randrange(5000)), rng.choice([True, True, True, False, None])) for i in range(n)]


def test_aggregate_form_equals_the_fold(spark):
    rows = some_attempts() + [(f"w{i}", "w", "q", START + dt.timedelta(days=i), False) for i in range(6)] + [(f"r{i}", "r", "q", START + dt.timedelta(days=i), True) for i in range(15)]
    own = {(r.user_id, r.question_id): (r.due_at.replace(tzinfo=UTC), r.lapses, r.reps) for r in schedule.schedule_state(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert own == fold(rows)
    assert own["r", "q"][0] - (START + dt.timedelta(days=14)) == dt.timedelta(days=30)
    assert own["w", "q"][0] - (START + dt.timedelta(days=5)) == dt.timedelta(days=1)


def test_stream_ends_where_the_batch_ends(spark, tmp_path):
    rows = sorted(some_attempts(60), key=lambda r: r[3])
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    query = stream.schedule_stream(source).writeStream.format("memory").queryName("schedules").outputMode("update").start()
    try:
        query.processAllAvailable()
        out = spark.sql("SELECT user_id, question_id, max_by(due_at, lapses + reps) due, max(lapses) l, max(reps) r FROM schedules GROUP BY 1, 2").collect()
        assert {(r.user_id, r.question_id): (r.due.replace(tzinfo=UTC), r.l, r.r) for r in out} == fold(rows)
    finally:
        query.stop()


def test_hours(spark, tmp_path):
    spark.createDataFrame(some_attempts(40), SCHEMA).write.parquet(str(tmp_path / "in"))
    query = stream.attempts_by_hour(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert spark.sql("SELECT sum(attempts) FROM hours").first()[0] == 40
    finally:
        query.stop()


def test_survivor_is_live_before_better(spark):
    rows = [("a", "f", "x", 0.9, True), ("b", "f", "x", 0.4, False), ("c", "f", "x", 0.4, False), ("d", "g", "", None, None)]
    own = merge.keeper_map(spark.createDataFrame(rows, "id string, fingerprint string, stem string, confidence double, is_discarded boolean")).collect()
    assert {r.question_id: r.keeper_id for r in own} == {"a": "b", "b": "b", "c": "b", "d": "d"}


def test_upsert_keeps_takes_and_resolves(spark):
    old = spark.createDataFrame([(1, "x", 5), (2, None, 7), (None, "n", 1)], "k int, a string, b int")
    new = spark.createDataFrame([(2, "y", 3), (3, "z", 9), (None, "m", 4)], "k int, a string, b int")
    out = merge.upserted(old, new, ["k"], {"b": F.greatest("old.b", "new.b")}).collect()
    assert sorted((r.k or 0, r.a, r.b) for r in out) == [(0, "n", 4), (1, "x", 5), (2, "y", 7), (3, "z", 9)]


SHEET = """Studente: Rossi
-- 1 of 3
DOMANDA 2
Quale livello?
a. rete
b. trasporto
-- 2 of 3
1. Che cosa fa ARP? a. traduce b. filtra
2) Spiegare il NAT
in breve
DOMANDA TEORIA
Descrivere TCP.
ESERCIZIO 1
Una rete ha due nodi.
1) Disegnare
2) Calcolare
ESERCIZIO 2
Solo testo"""


def test_parser(spark):
    out = parse.parse_documents(spark.createDataFrame([("d", SHEET), ("n", None), ("e", "")], "id string, text string")).collect()
    own = [(r.section, r.number_in_section, r.question_type, r.stem, r.needs_review) for r in out]
    assert own == [
        ("esercizio", 1, "multi_part_open", "ESERCIZIO 1 Una rete ha due nodi.", False), ("esercizio", 2, "open_text", "ESERCIZIO 2 Solo testo", False),
        ("quiz", 1, "multiple_choice", "Che cosa fa ARP?", False), ("quiz", 2, "multiple_choice", "Quale livello?", False),
        ("teoria", 1, "open_text", "Spiegare il NAT in breve", True), ("teoria", 2, "open_text", "Descrivere TCP.", False),
    ]
    assert all(r.id == "d" for r in out)


def test_colliding_numbers_move_up():
    own = parse.parse(["DOMANDA 1", "x", "a. 1", "b. 2", "DOMANDA 1", "y", "a. 1", "b. 2"])
    assert [q.number for q in own] == [1, 2]


def test_quality_bounds(spark):
    full = "1. x\n" * 12 + "a" * 7000
    df = spark.createDataFrame([(full,), ("",), (None,)], "t string").select(pages.quality(F.col("t")))
    assert [r[0] for r in df.collect()] == [1.0, 0.0, 0.0]


def test_bank_and_page_files(spark, tmp_path):
    (tmp_path / "bank").mkdir()
    (tmp_path / "bank/a.json").write_text('[{"stem": "x", "options": [{"id": "a", "text": "y"}]}, {"stem": "z"}]')
    (tmp_path / "bank/b.json").write_text('{"questions": [{"stem": "w"}]}')
    assert sorted(r.stem for r in files.read_bank(spark, str(tmp_path / "bank")).collect()) == ["w", "x", "z"]
    (tmp_path / "pages/in").mkdir(parents=True)
    (tmp_path / "pages/in/p.txt").write_text("one\ftwo")
    assert [(r.page_no, r.text) for r in files.read_pages(spark, str(tmp_path / "pages")).orderBy("page_no").collect()] == [(1, "one"), (2, "two")]


def test_snapshot_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    for _ in range(2):
        files.write_snapshot(spark.createDataFrame([(3, "b")], "v int, p string"), path, "p")
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


@pytest.mark.parametrize("name", ["documents", "questions"])
def test_empty_tables(spark, name):
    empty = spark.createDataFrame(pd.DataFrame({"id": [], "text": []}).astype(str), "id string, text string")
    assert parse.parse_documents(empty).collect() == []
