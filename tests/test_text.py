import re
import unicodedata
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizloom.functions import items as I
from quizloom.functions import text as X


def clean(raw):
    s = unicodedata.normalize("NFKC", raw or "").replace("�", "")
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", s)).strip()


TEXTS = ["", None, "  a  b ", "Perché\r\nno ,sì ; ok", "Ｆｕｌｌ　ｗｉｄｔｈ！", "più e perché", "x� y", "ﬁne 2¹⁶", "straße", "a b c d", "…", "A" * 20000]


@pytest.mark.parametrize("text", TEXTS)
def test_clean_text_is_nfkc_with_tight_spaces(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.clean_text(F.col("t"))).first()[0] == clean(text)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aàÈ9 .,;\n\t-#Zñ“", max_size=30), min_size=1, max_size=20))
def test_canonical_text_keeps_letters_and_digits(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.canonical_text(F.col("t")).alias("c")).collect()
    for r in rows:
        low = "".join(ch for ch in unicodedata.normalize("NFD", clean(texts[r.i]).lower()) if unicodedata.category(ch) != "Mn")
        assert r.c == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]+", " ", low)).strip()


def fingerprints(spark, rows):
    df = spark.createDataFrame(rows, "kind string, stem string, o string, s string")
    return [r[0] for r in df.select(I.fingerprint(F.col("kind"), F.col("stem"), I.clean_options(F.col("o")), I.clean_subparts(F.col("s")))).collect()]


def test_fingerprint_ignores_option_order_numbers_accents_and_case(spark):
    a = ("multiple_choice", "Perché 12 bit?", '[{"id":"a","text":"Sì"},{"id":"b","text":"No"}]', None)
    b = ("multiple_choice", "PERCHE  7  BIT ?", '[{"id":"b","text":"sì"},{"id":"a","text":"no"}]', "[]")
    c = ("open_text", "Perché 12 bit?", a[2], None)
    x, y, z = fingerprints(spark, [a, b, c])
    assert x == y != z


def test_urls_that_differ_in_punctuation_stay_apart(spark):
    base = "multiple_choice", "Quale?"
    x, y = fingerprints(spark, [(*base, '[{"id":"a","text":"http://a.b/c"}]', None), (*base, '[{"id":"a","text":"http://a.b.c"}]', None)])
    assert x != y


@pytest.mark.parametrize("json", [None, "", "nope", "{}", '[{"id":"a","te', '[{"id":"","text":"x"}]', '[{"id":"a","text":" "}]', "null"])
def test_bad_or_empty_options_decode_to_nothing(spark, json):
    assert spark.createDataFrame([(json,)], "j string").select(I.clean_options(F.col("j"))).first()[0] == []


def test_first_option_of_an_id_stays(spark):
    df = spark.createDataFrame([('[{"id":"a","text":"x"},{"id":"A ","text":"y"},{"id":"b","text":"z"}]',)], "j string")
    own = df.select(I.first_by_id(I.decoded(F.col("j"), I.OPTIONS)), I.relettered(I.clean_options(F.col("j")))).first()
    assert [o.text for o in own[0]] == ["x", "y", "z"]
    assert [o.id for o in own[1]] == ["a", "b", "c"]


def test_uuid5(spark):
    df = spark.createDataFrame([("quiz:1:Perché",), ("",)], "n string").select("n", I.uuid5(uuid.NAMESPACE_URL.bytes, F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in df.collect())


def test_slugs(spark):
    df = spark.createDataFrame([("Reti – di Calcolatori è 2",), ("***",), (None,)], "c string").select(X.slugify(F.col("c")), X.ascii_slug(F.col("c")))
    assert [tuple(r) for r in df.collect()] == [("reti-di-calcolatori-è-2", "reti-di-calcolatori-e-2"), ("", "tag"), ("", "tag")]
