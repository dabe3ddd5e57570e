"""Metadata builders, cleaners with rare patterns, and record scans on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import metadata as md, text as tx
from driftloom.operators import evaluation as ev, search as op
from driftloom.plans.sides import counted
from driftloom.sources import readers, writers

RARE = {
    "unicode_spaces": ("wide ​ gap ", "wide  gap "),
    "soft_hyphens": ("co­operate prob-\nabilistic слово-\nсочетание", "cooperate probabilistic словосочетание"),
    "layout_lines": ("Table of Contents\nPage 12  \n17\nfunded by the board\ndoi: 10.1234/abc.5\nlast line ", "last line"),
    "line_join": ("x\ny\n\n\n\nnext part ", "x y\n\nnext part"),
    "trailing_space": ("a \t\nrest  \n\n\n\nend \t ", "a\nrest\n\nend"),
    "html": ("<b>bold</b> a &nbsp; b &lt;c&gt; <i\nx>", "bold a  b c <i\nx>"),
    "science": ("see Eq 12 and Theorem 3, Lemma\n4 but not Equation 5, Eq12 or Eq 12a", "see  and ,  but not Equation 5, Eq12 or Eq 12a"),
    "references": ("a body of text that is long enough\n References \n[1] A. Author, a paper.", "a body of text that is long enough"),
    "deep": ("write to a.b@c.org or https://x.org/y\n12 34 56 78 90\n[3] Smith and others\nTable 4 shows\nkeep this line", "write to <EMAIL> or <URL>\nkeep this line"),
}


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column.alias("r")).first().r


@pytest.mark.parametrize("name", sorted(RARE))
def test_rare_patterns(spark, name):
    given, expected = RARE[name]
    assert one(spark, tx.CLEANERS[name](F.col("t")), t=given) == expected


def test_years(spark):
    refined = lambda stored, text: one(spark, md.year_refined(F.lit(stored).cast("int"), F.lit(text)))
    assert refined(1990, "received May 2001, with work of 2020") == 2001
    assert refined(1990, "work of 1995") == 1990 and refined(1990, "work of 2005") == 2005 and refined(None, "work of 2005") == 2005 and refined(1990, "") == 1990
    pages = F.array(F.lit("nothing"), F.lit("in 1980 and 1985"), F.lit("accepted 1999"))
    assert tuple(one(spark, md.page_year(pages))) == (1999, 93)
    assert tuple(one(spark, md.page_year(F.slice(pages, 1, 2)))) == (1985, 47) and tuple(one(spark, md.page_year(F.array(F.lit("x"))))) == (None, None)
    assert one(spark, md.best_date((50, F.lit("1990")), (80, F.lit("D:20190304")), (60, F.lit(None).cast("string")))) == 2019


def test_titles(spark):
    rows = [([(18.0, 10.0, "A history of"), (18.0, 30.0, "moral record"), (12.0, 50.0, "in three towns"), (9.0, 60.0, "x")], "A history of moral record in three towns"), ([(9.0, 1.0, "University of Somewhere"), (8.0, 2.0, "and"), (8.0, 3.0, "Department")], None), ([], None)]
    frame = spark.createDataFrame(rows, "spans array<struct<size:double,y0:double,text:string>>, expected string")
    for r in frame.select(md.layout_title(F.col("spans")).alias("got"), "expected").collect():
        assert r.got == r.expected
    assert one(spark, md.best_title(F.lit("short"), F.lit("A proper title of a paper"), F.lit(None).cast("string"))) == "A proper title of a paper"
    assert one(spark, md.first_line_title(F.lit("17\nSome University\nA study of moral record\nbody"))) == "A study of moral record"


def test_authors(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, md.best_authors(none, F.array(F.lit("Anna Maria Roe†"), F.lit("anna"), F.lit("Anna  Maria Roe"), F.lit("Bo Doe Institute")))) == ["Anna Maria Roe", "Bo Doe"]
    assert one(spark, md.best_authors(none, md.names_in_text(F.lit("on things\nAnna B. Roe and Carl Doe\nAbstract by Emil Poe")))) == ["Anna B. Roe", "Carl Doe"]


def test_contents_and_identifiers(spark):
    text = "Contents\n1 Introduction   3\n2.1 The moral record    12\nno entry here\nAppendix of tables \t 40"
    assert [tuple(e) for e in one(spark, md.textual_contents(F.lit(text)))] == [(1, "Introduction", 3), (2, "The moral record", 12), (1, "Appendix of tables", 40)]
    assert one(spark, md.textual_contents(F.lit(text.replace("Contents", "Else")))) == []
    assert one(spark, md.doi_of(F.lit("see 10.1234/ab.c-5). More"))) == "10.1234/ab.c-5" and one(spark, md.arxiv_of(F.lit("arXiv:0704.12345v2"))) == "0704.12345" and one(spark, md.doi_of(F.lit(None).cast("string"))) is None


def test_judgements(spark):
    for given, expected in (('```json\n{"relevance": 2}\n```', 2), ("score: 3.", 3), ("I give 12", 0), (None, 0), ('{"relevance": 9}', 0)):
        assert one(spark, tx.relevance_of(F.lit(given).cast("string"))) == expected
    assert one(spark, tx.clean_query(F.lit("  \t "))) is None
    assert one(spark, tx.remove_residual_metadata(F.lit("Title: X\nbody stays\ndoi: 10.1/x\nUniversity of Y, a@b.c\nmore"))) == "body stays\n\nmore"


def test_p_values(spark):
    """Against the t distribution integrated by the trapezoid rule."""
    for r, n in ((0.5, 10), (-0.2, 30), (0.9, 5), (0.0, 8)):
        t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
        x = np.linspace(0, t, 200_001)
        density = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt((n - 2) * math.pi) * (1 + x * x / (n - 2)) ** (-(n - 1) / 2)
        expected = 1 - 2 * float(((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())
        assert abs(one(spark, ev.correlation_p_value(F.lit(r), F.lit(n))) - expected) < 1e-6
    assert one(spark, ev.correlation_p_value(F.lit(0.5), F.lit(2))) is None


def test_bootstrap_paths_agree(spark):
    frame = spark.createDataFrame([(k, float(k % 7) if k % 5 else None) for k in range(500)], "k int, x double")
    means = lambda **kw: {r.turn: round(r["mean"], 9) for r in ev.bootstrap_means(frame, value="x", order="k", iterations=20, seed=1, **kw).collect()}
    assert means() == means(most=10, block=64) == means(block=100) and len(means()) == 20
    assert ev.bootstrap_means(frame.limit(0), value="x", order="k", iterations=5, seed=1).count() == 0


def test_search_keeps_ties(spark):
    """Many equal scores over several batches: the smallest ids win."""
    frame = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(5000)], "vec_id bigint, vector array<double>")
    asked = frame.where("vec_id < 2").withColumnRenamed("vec_id", "query_id")
    found = {}
    for r in op.knn_search(asked, frame.repartition(5), 4).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(v) for q, v in found.items()} == {0: [2, 4, 6, 8], 1: [3, 5, 7, 9]}


def test_record_scans(spark, tmp_path):
    (tmp_path / "eval_logs_m1").mkdir()
    (tmp_path / "eval_logs_m1" / "q1.json").write_text('{"query_id": "q1", "ndcg@k": 0.5, "faithfulness": NaN}')
    (tmp_path / "eval_logs_m1" / "q2.json").write_text(json.dumps({"model_name": "m2", "ndcg@5": 0.25}))
    (tmp_path / "eval_logs_m1" / "q3.json").write_text("{}")
    found = sorted(tuple(r) for r in readers.read_evaluation_records(spark, str(tmp_path)).collect())
    assert found == [("q1", "m1", 0.5, None), ("q2", "m2", 0.25, None)]
    for n in (30, 10):
        (tmp_path / f"summary_n{n}.json").write_text(json.dumps({"files": n}))
    assert [r.n for r in readers.read_stage_summaries(spark, str(tmp_path)).collect()] == [10, 30]
    meta = tmp_path / "meta"
    meta.mkdir()
    (meta / "a.json").write_text(json.dumps({"title": "T", "year": "1999", "authors": ["A"]}))
    assert [(r.source_file, r.year) for r in readers.read_metadata_files(spark, str(meta)).collect()] == [("a", 1999)]
    first, second = tmp_path / "x", tmp_path / "y"
    for folder, title in ((first, "first"), (second, "second")):
        folder.mkdir()
        (folder / "d.tei.xml").write_text(f'<TEI><analytic><title>{title}</title></analytic><publicationStmt><date from="1997">then</date></publicationStmt></TEI>')
    assert [(r.stem, r.title, r.year) for r in readers.read_tei(spark, str(first), str(second)).collect()] == [("d", "first", 1997)]
    assert "A\\_b & 1" in writers.render_latex(spark.createDataFrame([("A_b", 1)], "m string, n int"))


def test_sides_by_size(spark):
    small, big = spark.range(10).toDF("k"), spark.range(100).toDF("k")
    plan = lambda side: small.join(side, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(counted(big)) and "merge" in plan(counted(big, rows=50))
