"""Core operators on small frames against plain Python."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import metadata as md, text as tx
from driftloom.operators import chunking as ch, search as op
from driftloom.operators.evaluation import ndcg
from driftloom.sources import readers, writers
from driftloom.streaming import pipeline


def test_cleaners_on_fixed_sentences(spark):
    cases = {
        "citations": [("This was shown (Smith, 2020) before [1, 2-4] .", "This was shown before."), ("As in (Doe et al., 2021a), yes [Roe 2001].", "As in, yes."), ("doi:10.1/x and arXiv: 1234.5 end", "and end")],
        "html": [("<b>x</b> &amp; y", "x  y")],
        "unicode_spaces": [("a  b", "a b")],
        "soft_hyphens": [("co­op prob-\nable", "coop probable")],
        "layout_lines": [("Contents\nPage 3\nreal\n12\n", "real")],
        "line_join": [("one\ntwo\n\n\n\nthree", "one two\n\nthree")],
        "references": [("body text that is long enough\nReferences\n[1] x", "body text that is long enough"), ("References\nbody", "References\nbody")],
    }
    for name, pairs in cases.items():
        frame = spark.createDataFrame(pairs, "text string, expected string")
        for r in frame.select(tx.CLEANERS[name](F.col("text")).alias("got"), "expected").collect():
            assert r.got == r.expected, name
    assert spark.range(1).select(tx.clean_text(F.lit(None).cast("string")).alias("t")).first().t == ""


def test_chunks_keep_every_sentence(spark):
    texts = [None, "", "One. Two! Three? " * 40, "x" * 2000, "Short.", "A sentence of some length. " * 100 + "End."]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for r in frame.select("id", "text", ch.static_chunks(F.col("text"), 100, 20).alias("c")).collect():
        assert all(0 < len(c) <= 100 for c in r.c)
        squeeze = lambda t: re.sub(r"\s", "", t or "")
        assert squeeze("".join(r.c)) == squeeze(r.text)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, vector array<double>")
    asked = frame.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in op.knn_search(asked, frame, 7).orderBy("query_id", "raw_rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    for q, got in found.items():
        s = np.round(unit @ unit[q], 6)
        assert got == sorted((k for k in range(300) if k != q), key=lambda k: (-s[k], k))[:7]
    assert op.knn_search(asked.limit(0), frame, 3).count() == 0 and op.knn_search(asked, frame.limit(0), 3).count() == 0


@pytest.mark.parametrize("gains,k,low,high", [([3, 2, 1, 0, 0], 5, 1, 1), ([1, 3, 2, 0, 0], 5, 0.7, 0.999), ([0, 0, 0], 3, 0, 0)])
def test_ndcg(spark, gains, k, low, high):
    frame = spark.createDataFrame([("q", n + 1, g) for n, g in enumerate(gains)], "q string, rank int, relevance int")
    assert low <= ndcg(frame, k, group=["q"]).first().ndcg <= high


def test_years_and_titles(spark):
    row = spark.range(1).select(
        md.date_year(F.lit("D:20190304")).alias("a"), md.date_year(F.lit("2001-05")).alias("b"), md.date_year(F.lit("spring 1987")).alias("c"), md.arxiv_year(F.lit("arXiv: 9907.01234")).alias("d"),
        md.context_year(F.lit("received 3 May 2010, accepted 2011")).alias("e"), md.title_valid(F.lit("A proper title here")).alias("f"), md.title_valid(F.lit("short")).alias("g"),
        tx.query_decades(F.lit("from 1987 and the 1990s to the 21st century")).alias("h"), md.best_year((2, 10, F.lit(1990)), (1, 5, F.lit(1700)), (2, 20, F.lit(1985))).alias("i"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.i) == (2019, 2001, 1987, 1999, 2011, True, False, 1985)
    assert row.h == [1980, 1990, *range(2000, 2100, 10)]


def test_exact_k_and_padding(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id bigint, vec_id bigint, rank int")
    rows = sorted(map(tuple, op.exact_k(hits, 3).select("query_id", "rank", "vec_id", "is_pad").collect()))
    assert rows == [(1, 1, 10, False), (1, 2, 11, False), (1, 3, 11, True), (2, 1, 12, False), (2, 2, 12, True), (2, 3, 12, True)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "llm_a.json").write_text(json.dumps({"query": "", "query_refined": "why", "answer": "because", "chunks_final_to_llm": [{"id": "1", "year": 1999}]}))
    (tmp_path / "llm_b.json").write_text("{broken")
    (tmp_path / "llm_input_c.json").write_text("{}")
    logs = {r.log_name: r for r in readers.read_run_logs(spark, str(tmp_path)).collect()}
    assert set(logs) == {"llm_a", "llm_b"} and logs["llm_a"].query == "why" and logs["llm_a"].response == "because" and logs["llm_b"].error
    chunks = tmp_path / "chunks"
    chunks.mkdir()
    (chunks / "d.json").write_text(json.dumps({"chunks": [{"text": "a"}, {"text": " "}]}))
    (chunks / "e.json").write_text(json.dumps({"text": "alone"}))
    assert sorted((r.source, r.text) for r in readers.read_chunk_files(spark, str(chunks)).collect()) == [("d", "a"), ("e", "alone")]
    (tmp_path / "p.txt").write_text("one\n\n  two \n")
    assert [r.prompt for r in readers.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    (tmp_path / "x.tei.xml").write_text('<TEI xmlns="http://x"><titleStmt><title type="main">T</title></titleStmt><author><persName><forename>A</forename><surname>B</surname></persName></author><date when="1998-01"/></TEI>')
    tei = readers.read_tei(spark, str(tmp_path)).first()
    assert (tei.stem, tei.title, tei.authors, tei.year) == ("x", "T", ["A B"], 1998)
    frame = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert sorted(map(tuple, writers.latest_by_key(frame, "k", "at").select("k", "v").collect())) == [(1, "b"), (2, "c")]
    for _ in range(2):
        writers.append_new(frame, str(tmp_path / "store"), "k")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert writers.render_markdown(frame.where("k = 2").select("k", "v")).split("\n")[-1] == "| 2 | c |"
    with pytest.raises(ValueError):
        writers.write_table(frame, str(tmp_path / "y"), "xls")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"Document {k} has a sentence. And another one, rather longer than the first! " * 8) for k in range(20)] + [(99, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    source = str(tmp_path / "in")
    documents.repartition(3).write.parquet(source)
    stream = pipeline.chunk_documents(pipeline.read_stream(spark, source, documents.schema))
    pipeline.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    written = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert written == sorted(map(tuple, pipeline.chunk_documents(documents).collect())) and len(written) > 20
