import os

import pytest
from pyspark.sql import functions as F

from driftloom.llm.languages import code_of, fit_languages, language_of
from driftloom.llm.responses import _words, find_defects

FOLDER = "/root/testdata/sf0.01"


def test_codes(spark):
    labels = ["EN", " de-AT", "fr_CA", "spa", "Deutsch", "español", "und", "", "x", None]
    rows = spark.createDataFrame(list(enumerate(labels)), "k int, label string").select("k", code_of(F.col("label")).alias("code"))
    assert [r.code for r in rows.orderBy("k").collect()] == ["en", "de", "fr", "es", "de", "es", None, None, None, None]


def test_nothing(spark):
    schema = "doc_id bigint, text string, lang string, word string"
    assert fit_languages(spark.createDataFrame([], schema)) == {}
    assert fit_languages(spark.createDataFrame([(1, None, "en", "x"), (2, "a text", None, "x"), (None, "a", "und", "x")], schema)) == {}
    assert language_of([], {}, 1.0) is None and language_of(["a"], {"a": {"en": 0.0}}, 1.0) is None


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the test tables")
def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    weights = fit_languages(documents.where("doc_id % 2 = 0"))
    held = documents.where("doc_id % 2 = 1 and length(text) > 200").select("text", code_of(F.col("lang")).alias("code")).where("code is not null").collect()
    right = sum(language_of(_words(r.text), weights, 2.0) == r.code for r in held)
    assert len(held) > 200 and right >= 0.95 * len(held)  # the labels themselves are wrong in part


def test_words_that_only_queries_use(spark):
    """No labelled text asks "warum"; that queries with this word are answered in German tells."""
    english, german = "the term was read by the critics and is known", "der Begriff wurde von den Kritikern gelesen und ist bekannt"
    labelled = spark.createDataFrame([(k, english if k % 2 else german, "en" if k % 2 else "DE") for k in range(60)], "doc_id bigint, text string, lang string")
    rows = [(k, f"Warum verlor x{k}?" if k % 2 else f"Which authors name x{k}?", "m", (german if k % 2 else english) + ".", None) for k in range(60)]
    rows += [(100, "Warum verlor y?", "m", english + ".", None), (101, "Which authors name y?", "m", german + ".", None), (102, "Which authors name y? Please answer in German.", "m", german + ".", None)]
    logs = spark.createDataFrame(rows, "log_id bigint, query_refined string, model string, model_output string, answer string")
    assert sorted(tuple(r) for r in find_defects(logs, labelled).collect()) == [(100, "language"), (101, "language")]
