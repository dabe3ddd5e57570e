"""Queries that read whole texts where their namesakes with SQL cut them."""

from pathlib import Path

import pytest

from driftloom.plans import queries, search_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_prompts_hold_whole_chunks(spark):
    prompts = {r.query_id: r.prompt for r in queries.queries()["prompt_compose_whole"](spark, FOLDER).collect()}
    found = [(r.query_id, (r.text or "").strip()) for r in search_queries.full_hits(spark, FOLDER, 5).collect()]
    assert set(prompts) == {q for q, _ in found} and max(len(t) for _, t in found) > 200
    assert all(f"): {t or '[Empty chunk]'}" in prompts[q] for q, t in found)


def test_years_of_whole_texts(spark, tmp_path):
    rows = [(1, "x " * 1500 + "in 1987 and 2099"), (2, "In 2003 " + "x " * 1500 + "Accepted: 1999, seen 19981"), (3, "published 19991"), (4, None), (5, "in 1950"), (6, "see arXiv:0704.12345 " + "x " * 1500)]
    df = spark.createDataFrame([(i, t, None, None, 1960 if i == 5 else None) for i, t in rows], "doc_id bigint, text string, published_at timestamp, source_file string, year int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.by_context, r.by_text, r.best) for r in queries.queries()["year_candidates_whole"](spark, str(tmp_path)).collect()}
    assert found == {1: (None, 1987, 1987), 2: (1999, 2003, 1999), 3: (None, None, None), 4: (None, None, None), 5: (None, 1950, 1960), 6: (None, None, 2007)}
