"""Search, reranking and relevance over the chunk vectors: queries and their SQL.

Queries are the vectors whose id is divisible by 50, against all usable vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftloom.functions import text as tx
from driftloom.functions.vectors import band, temporal_modulation, valid_year
from driftloom.operators import search as op
from driftloom.operators.evaluation import ndcg, overlap_support, words_of
from driftloom.sources.tables import table

DIM = 64
BANDS = ((0.80, 3), (0.55, 2), (0.30, 1))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return op.usable(table(spark, folder, "chunk_vectors"), "vector", DIM).select("vec_id", "chunk_id", F.col("source_file").alias("vector_file"), "vector")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk id: repeated rows of a chunk agree but for what is missing."""
    columns = ("text", "year", "title", "source_file")
    return table(spark, folder, "chunk").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in columns))


def hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = corpus(spark, folder)
    asked = vectors.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id")
    return op.knn_search(asked, vectors, k)


def full_hits(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """Hits with their chunk's columns, and the query's text."""
    ids = corpus(spark, folder).select("vec_id", "chunk_id")
    known = chunks(spark, folder)
    found = hits(spark, folder, k).join(ids, "vec_id").join(known, "chunk_id", "left")
    asked = ids.where(F.col("vec_id") % 50 == 0).join(known.select("chunk_id", F.col("text").alias("query_text")), "chunk_id", "left")
    return found.join(asked.select(F.col("vec_id").alias("query_id"), "query_text"), "query_id")


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return hits(spark, folder, 10)


def knn_source_diverse(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 25).withColumn("source_file", F.coalesce("source_file", F.lit("unknown")))
    return op.diversify_sources(found, 5).select("query_id", "vec_id", "source_file", "score", "rank")


def temporal_modulated_search(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 20)
    score = F.round(temporal_modulation(F.col("score"), valid_year(F.col("year")), tx.query_decades(F.col("query_text"))), 6)
    w = op.W.partitionBy("query_id").orderBy(F.desc("final_score"), "vec_id")
    return found.withColumn("final_score", score).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "vec_id", "final_score", "rank")


def temporal_rerank_decades(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 30)
    return op.temporal_rerank(found, 10).select("query_id", "vec_id", "key", "decade", "rank")


def must_include_blacklist(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 30)
    return op.temporal_rerank(found, 10, must_include=("history",), blacklist=("Omnibus", "_a_")).select("query_id", "vec_id", "key", "forced", "rank")


def semantic_blend_rerank(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 20)
    second = overlap_support(words_of(F.col("query_text")), words_of(F.col("text")))
    blended = F.round(0.75 * second + 0.25 * F.col("score"), 6)
    w = op.W.partitionBy("query_id").orderBy(F.desc("final_score"), "vec_id")
    return found.withColumn("final_score", blended).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "vec_id", "final_score", "rank")


def dedupe_text_topk(spark: SparkSession, folder: str) -> DataFrame:
    return op.keep_first_text(full_hits(spark, folder, 30), 10).select("query_id", "vec_id", "raw_rank", "rank")


def greedy_diversity(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder, 20).join(corpus(spark, folder).select("vec_id", "vector"), "vec_id")
    return op.greedy_diversity(found, 8, 0.85).select("query_id", "vec_id", "raw_rank", "rank")


def relevance_quartiles(spark: SparkSession, folder: str) -> DataFrame:
    return op.quartile_labels(hits(spark, folder, 20)).select("query_id", "vec_id", "score", "relevance")


def exact_k_pad(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder, 15).where("score >= 0.85")
    return op.exact_k(found.withColumnRenamed("raw_rank", "rank"), 12).select("query_id", "vec_id", "rank", "is_pad")


def intent_argmax(spark: SparkSession, folder: str) -> DataFrame:
    labels = ("chronological", "conceptual", "analytical", "comparative")
    vectors = corpus(spark, folder)
    first = vectors.select("vec_id", F.col("vector").cast("array<double>").alias("v")).orderBy("vec_id").limit(len(labels)).collect()
    asked = vectors.select("vec_id", "vector")
    return op.classify(asked, [(label, r.v) for label, r in zip(labels, first)]).select("vec_id", "intent", "score")


def calibrate_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = hits(spark, folder, 50)
    cut = lambda p, d: F.coalesce(F.round(F.percentile("score", F.lit(p)), 3), F.lit(d))
    return found.agg(cut(0.9, 0.9).alias("high"), cut(0.7, 0.8).alias("mid"), cut(0.5, 0.7).alias("low"), F.count("*").alias("n"))


def _graded(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return hits(spark, folder, k).withColumn("relevance", band(F.col("score"), *BANDS).cast("int"))


def graded_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder, 20).select("query_id", "vec_id", "raw_rank", "relevance")


def _shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """Graded hits in another order than that of their scores: by id."""
    return _graded(spark, folder, 20).withColumn("rank", F.row_number().over(op.W.partitionBy("query_id").orderBy("vec_id")))


def ndcg_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return ndcg(_shuffled(spark, folder), 10, group=["query_id"]).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def ndcg_k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _shuffled(spark, folder).withColumn("k", F.explode(F.array(*map(F.lit, (3, 5, 7, 10, 20)))))
    scores = ndcg(ranked, F.col("k"), group=["query_id", "k"])
    return scores.groupBy("k").agg(F.round(F.avg("ndcg"), 6).alias("mean_ndcg"), F.count("*").alias("queries"))


def intrinsic_topk_agg(spark: SparkSession, folder: str) -> DataFrame:
    clipped = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    return hits(spark, folder, 5).groupBy("query_id").agg(F.round(F.avg(clipped), 6).alias("mean"), F.max(clipped).alias("max"), F.round(F.median(clipped), 6).alias("median"))


def decade_timeline(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 20)
    year = F.col("year").cast("string")
    decade = F.when(year.rlike("^[0-9]{4}$"), F.concat(F.substring(year, 1, 3), F.lit("0s"))).otherwise("n/a")
    return found.groupBy(decade.alias("decade")).agg(F.count("*").alias("n"))


def citation_numbering(spark: SparkSession, folder: str) -> DataFrame:
    found = full_hits(spark, folder, 8).withColumn("source_file", F.coalesce("source_file", F.lit("unknown"))).withColumnRenamed("raw_rank", "rank")
    return op.citation_numbers(found, by_year=F.col("query_id") % 100 == 0).select("query_id", "vec_id", "position", "citation")


def _prompts(spark: SparkSession, folder: str, text: Column) -> DataFrame:
    found = full_hits(spark, folder, 5).withColumn("source_file", F.coalesce("source_file", F.lit("unknown"))).withColumnRenamed("raw_rank", "rank")
    numbered = op.citation_numbers(found)
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("): "), text)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return numbered.groupBy("query_id").agg(F.concat(F.lit("Context:\n"), F.array_join(lines, "\n")).alias("prompt"))


def prompt_compose(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with the whole text of each chunk."""
    return _prompts(spark, folder, F.coalesce("text", F.lit("")))


def prompt_compose_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with the whole stripped text of each chunk, as the reference composes them."""
    text = tx.strip(F.coalesce("text", F.lit("")))
    return _prompts(spark, folder, F.when(text == "", "[Empty chunk]").otherwise(text))


def retrieve_raw(spark: SparkSession, folder: str) -> DataFrame:
    """What the whole pipeline finds, before it is cut: the raw list of every query."""
    return op.retrieve(full_hits(spark, folder, op.initial_k(5, 9)), 5)[0].select("query_id", "vec_id", "score", "raw_rank")


def retrieve_final(spark: SparkSession, folder: str) -> DataFrame:
    """The same pipeline's final list: reranked, diverse, labelled, exactly k."""
    return op.retrieve(full_hits(spark, folder, op.initial_k(5, 9)), 5)[1].select("query_id", "rank", "vec_id", "final_score", "relevance", "is_pad", "text")


def reformulated_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of the log, worded for their intent; an unknown intent counts as conceptual."""
    rows = table(spark, folder, "llm_log").select("log_id", tx.clean_query(F.col("query_refined")).alias("q"), F.lower(F.coalesce("intent", F.lit(""))).alias("intent"))
    return rows.select("log_id", tx.reformulate(F.col("q"), F.col("intent")).alias("query"))


def full_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole prompts: instructions, numbered context - by year for chronological queries -, question."""
    found = full_hits(spark, folder, 5).withColumn("source_file", F.coalesce("source_file", F.lit("unknown"))).withColumnRenamed("raw_rank", "rank")
    numbered = op.citation_numbers(found, by_year=F.col("query_id") % 100 == 0)
    text = tx.strip(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("] "), F.when(text == "", "[Empty chunk]").otherwise(text))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"])
    return numbered.groupBy("query_id").agg(F.concat(F.lit("Answer from the numbered context and cite it as [n].\n\nContext:\n"), F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), F.coalesce(F.first("query_text"), F.lit(""))).alias("prompt"))


_V = f"""v AS (SELECT vec_id, chunk_id, vector::DOUBLE[] AS vec FROM chunk_vectors
  WHERE vector IS NOT NULL AND len(vector) = {DIM} AND list_inner_product(vector::DOUBLE[], vector::DOUBLE[]) > 0)"""
_CH = "ch AS (SELECT chunk_id, min(text) AS text, min(year) AS year, min(title) AS title, min(source_file) AS source_file FROM chunk GROUP BY chunk_id)"


def _hits_sql(k: int) -> str:
    return f"""{_V}, scored AS (SELECT q.vec_id AS query_id, c.vec_id,
    round(list_inner_product(q.vec, c.vec) / sqrt(list_inner_product(q.vec, q.vec)) / sqrt(list_inner_product(c.vec, c.vec)), 6) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
  hits AS (SELECT query_id, vec_id, score, raw_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS raw_rank FROM scored)
    WHERE raw_rank <= {k})"""


def _full_sql(k: int) -> str:
    return f"""{_hits_sql(k)}, {_CH},
  full_hits AS (SELECT h.*, ch.text, ch.year, ch.title, ch.source_file, qc.text AS query_text FROM hits h JOIN v ON v.vec_id = h.vec_id LEFT JOIN ch ON ch.chunk_id = v.chunk_id
    JOIN v qv ON qv.vec_id = h.query_id LEFT JOIN ch qc ON qc.chunk_id = qv.chunk_id)"""


_DECADES = """list_sort(list_distinct(list_transform(list_concat(list_concat(
    list_transform(list_filter(regexp_extract_all(lower({t}), '[0-9a-z_]+'), lambda x: regexp_matches(x, '^(19|20)[0-9][0-9]$|^(19|20)[0-9]0s$')), lambda x: CAST(substr(x, 1, 4) AS INT)),
    CASE WHEN contains(lower({t}), '20th century') THEN range(1900, 2000, 10) ELSE [] END), CASE WHEN contains(lower({t}), '21st century') THEN range(2000, 2100, 10) ELSE [] END), lambda y: CAST(y // 10 * 10 AS INT))))"""
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+'))"


def _rerank_sql(must: str, black: str) -> str:
    return f"""keyed AS (SELECT *, lower(coalesce(nullif(source_file, ''), nullif(title, ''), 'unknown')) AS key,
      CAST(CASE WHEN year BETWEEN 1900 AND 2100 THEN year ELSE 1900 END // 10 * 10 AS INT) AS decade FROM full_hits),
    kept AS (SELECT *, {must} AS forced, row_number() OVER (PARTITION BY query_id, decade ORDER BY score DESC, vec_id) = 1 AND score >= 0.4 AS strong FROM keyed WHERE {black}),
    ordered AS (SELECT *, CASE WHEN strong AND NOT forced THEN decade ELSE 0 END AS d FROM kept),
    once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY forced DESC, strong DESC, d, score DESC, vec_id) AS turn FROM ordered) WHERE turn = 1),
    final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY forced DESC, strong DESC, d, score DESC, vec_id) AS INT) AS rank FROM once)"""


_GRADE = "CAST(CASE WHEN score >= 0.8 THEN 3 WHEN score >= 0.55 THEN 2 WHEN score >= 0.3 THEN 1 ELSE 0 END AS INT)"
_NDCG = f"""g AS (SELECT query_id, vec_id, {_GRADE} AS rel, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS pos,
    row_number() OVER (PARTITION BY query_id ORDER BY {_GRADE} DESC, vec_id) AS best FROM hits)"""
_GAINS = "CASE WHEN sum(CASE WHEN best <= {k} THEN rel / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN pos <= {k} THEN rel / log2(pos + 1) ELSE 0 END) / sum(CASE WHEN best <= {k} THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END"
_CITED = """placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, raw_rank) AS position FROM (SELECT * REPLACE (coalesce(source_file, 'unknown') AS source_file) FROM full_hits)),
    firsts AS (SELECT *, min(position) OVER (PARTITION BY query_id, source_file) AS first FROM placed),
    cited AS (SELECT *, CAST(position AS INT) AS pos, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first) AS INT) AS citation FROM firsts)"""

_RETRIEVE = f"""{_full_sql(45)}, y AS (SELECT *, substr(coalesce(text, ''), 1, 500) AS cut_text, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS doc_year, {_DECADES.format(t="query_text")} AS decades FROM full_hits),
    m AS (SELECT *, round(CASE WHEN doc_year IS NULL OR decades IS NULL OR len(decades) = 0 THEN score ELSE score * (1 + 0.3 * exp(-list_min(list_transform(decades, lambda d: abs(d - doc_year))) / 8.0)) END, 6) AS final_score FROM y),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(coalesce(nullif(source_file, ''), nullif(title, ''), 'unknown')) ORDER BY final_score DESC, vec_id) AS own FROM m) WHERE own = 1),
    x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(cut_text, '[ \\t\\r\\n]+', ' ', 'g')) ORDER BY final_score DESC, vec_id) AS again FROM u) WHERE again = 1),
    l AS (SELECT *, quantile_cont(final_score, 0.25) OVER w AS a, quantile_cont(final_score, 0.5) OVER w AS b, quantile_cont(final_score, 0.75) OVER w AS c, min(final_score) OVER w AS lo, max(final_score) OVER w AS hi,
      row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) AS place, count(*) OVER w AS size FROM x WINDOW w AS (PARTITION BY query_id))"""

SQL = {
    "retrieve_raw": f"WITH {_hits_sql(45)} SELECT query_id, vec_id, score, raw_rank FROM hits",
    "retrieve_final": f"""WITH {_RETRIEVE}, f AS (SELECT *, unnest(range(place, CASE WHEN place = least(size, 5) THEN 6 ELSE place + 1 END)) AS p FROM l WHERE place <= 5)
      SELECT query_id, CAST(p AS INT) AS rank, vec_id, final_score, CAST(CASE WHEN lo = hi THEN 1 WHEN final_score <= a THEN 0 WHEN final_score <= b THEN 1 WHEN final_score <= c THEN 2 ELSE 3 END AS INT) AS relevance, p > place AS is_pad, cut_text AS text FROM f""",
    "reformulated_queries": r"""WITH q AS (SELECT log_id, nullif(regexp_replace(regexp_replace(lower(query_refined), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '') AS q, lower(coalesce(intent, '')) AS i FROM llm_log),
      w AS (SELECT log_id, CASE i WHEN 'chronological' THEN 'How did this develop over time, in order of years: ' || q WHEN 'analytical' THEN 'What explains this, and what speaks for it over time: ' || q WHEN 'comparative' THEN 'How do the views of this differ over time: ' || q
        ELSE 'What is meant by this over time: ' || q END AS t FROM q) SELECT log_id, regexp_replace(t, '(?i)(\bover time\b)\s*[,.]?\s*\bover time\b', '\1', 'g') AS query FROM w""",
    "full_prompts": f"""WITH {_full_sql(5)}, {_CITED.format(order="CASE WHEN query_id % 100 = 0 THEN coalesce(year, 9999) ELSE 0 END")}, s AS (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS plain FROM cited)
      SELECT query_id, 'Answer from the numbered context and cite it as [n].' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg('[' || citation || '] ' || CASE WHEN plain = '' THEN '[Empty chunk]' ELSE plain END, chr(10) ORDER BY pos)
        || chr(10) || chr(10) || 'Question: ' || coalesce(first(query_text), '') AS prompt FROM s GROUP BY query_id""",
    "prompt_compose_whole": f"""WITH {_full_sql(5)}, {_CITED.format(order="0")}, s AS (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS plain FROM cited)
      SELECT query_id, 'Context:' || chr(10) || string_agg('[' || citation || '] ' || coalesce(title, 'untitled') || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '): ' || CASE WHEN plain = '' THEN '[Empty chunk]' ELSE plain END, chr(10) ORDER BY pos) AS prompt FROM s GROUP BY query_id""",
    "knn_topk": f"WITH {_hits_sql(10)} SELECT * FROM hits",
    "knn_source_diverse": f"""WITH {_full_sql(25)}, f AS (SELECT query_id, vec_id, coalesce(source_file, 'unknown') AS source_file, score, raw_rank FROM full_hits),
      a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, source_file ORDER BY raw_rank) > 1 THEN 1 ELSE 0 END AS again FROM f),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY again, raw_rank) AS INT) AS rank FROM a)
      SELECT query_id, vec_id, source_file, score, rank FROM r WHERE rank <= 5""",
    "temporal_modulated_search": f"""WITH {_full_sql(20)}, y AS (SELECT *, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS doc_year, {_DECADES.format(t="query_text")} AS decades FROM full_hits),
      s AS (SELECT query_id, vec_id, round(CASE WHEN doc_year IS NULL OR decades IS NULL OR len(decades) = 0 THEN score
        ELSE score * (1 + 0.3 * exp(-list_min(list_transform(decades, lambda d: abs(d - doc_year))) / 8.0)) END, 6) AS final_score FROM y),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "temporal_rerank_decades": f"WITH {_full_sql(30)}, {_rerank_sql('false', 'true')} SELECT query_id, vec_id, key, decade, rank FROM final WHERE rank <= 10",
    "must_include_blacklist": f"""WITH {_full_sql(30)}, {_rerank_sql("contains(key, 'history')", "NOT contains(key, 'omnibus') AND NOT contains(key, '_a_')")}
      SELECT query_id, vec_id, key, forced, rank FROM final WHERE rank <= 10""",
    "semantic_blend_rerank": f"""WITH {_full_sql(20)}, w AS (SELECT *, {_WORDS.format(t="query_text")} AS qw, {_WORDS.format(t="text")} AS tw FROM full_hits),
      s AS (SELECT query_id, vec_id, round(0.75 * CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, tw)) / len(qw) ELSE 0 END + 0.25 * score, 6) AS final_score FROM w),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) AS INT) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
    "dedupe_text_topk": f"""WITH {_full_sql(30)}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) ORDER BY raw_rank) AS turn FROM full_hits) WHERE turn = 1),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw_rank) AS INT) AS rank FROM o) SELECT query_id, vec_id, raw_rank, rank FROM r WHERE rank <= 10""",
    "greedy_diversity": f"""WITH RECURSIVE {_hits_sql(20)}, x AS (SELECT h.query_id, h.vec_id, h.raw_rank, v.vec FROM hits h JOIN v USING (vec_id)),
      walk AS (SELECT DISTINCT query_id, 0 AS stp, CAST([] AS BIGINT[]) AS ids, CAST([] AS DOUBLE[][]) AS kept FROM x
        UNION ALL SELECT w.query_id, x.raw_rank, CASE WHEN len(w.ids) < 8 AND len(list_filter(w.kept, lambda y: list_cosine_similarity(y, x.vec) > 0.85)) = 0 THEN list_append(w.ids, x.vec_id) ELSE w.ids END,
          CASE WHEN len(w.ids) < 8 AND len(list_filter(w.kept, lambda y: list_cosine_similarity(y, x.vec) > 0.85)) = 0 THEN list_append(w.kept, x.vec) ELSE w.kept END
          FROM walk w JOIN x ON x.query_id = w.query_id AND x.raw_rank = w.stp + 1),
      last AS (SELECT query_id, arg_max(ids, stp) AS ids FROM walk GROUP BY query_id),
      flat AS (SELECT query_id, unnest(ids) AS vec_id, CAST(unnest(range(1, len(ids) + 1)) AS INT) AS rank FROM last)
      SELECT f.query_id, f.vec_id, h.raw_rank, f.rank FROM flat f JOIN hits h USING (query_id, vec_id)""",
    "relevance_quartiles": f"""WITH {_hits_sql(20)}, q AS (SELECT *, quantile_cont(score, 0.25) OVER w AS a, quantile_cont(score, 0.5) OVER w AS b, quantile_cont(score, 0.75) OVER w AS c, min(score) OVER w AS lo, max(score) OVER w AS hi
      FROM hits WINDOW w AS (PARTITION BY query_id)) SELECT query_id, vec_id, score, CAST(CASE WHEN lo = hi THEN 1 WHEN score <= a THEN 0 WHEN score <= b THEN 1 WHEN score <= c THEN 2 ELSE 3 END AS INT) AS relevance FROM q""",
    "exact_k_pad": f"""WITH {_hits_sql(15)}, f AS (SELECT query_id, vec_id, raw_rank, max(raw_rank) OVER (PARTITION BY query_id) AS last FROM hits WHERE score >= 0.85 AND raw_rank <= 12)
      SELECT query_id, vec_id, CAST(p AS INT) AS rank, p > raw_rank AS is_pad FROM (SELECT *, unnest(range(raw_rank, CASE WHEN raw_rank = last THEN 13 ELSE raw_rank + 1 END)) AS p FROM f)""",
    "intent_argmax": f"""WITH {_V}, p AS (SELECT vec AS pv, row_number() OVER (ORDER BY vec_id) AS n FROM (SELECT * FROM v ORDER BY vec_id LIMIT 4)),
      s AS (SELECT v.vec_id, n, round(list_inner_product(vec, pv), 6) AS score, row_number() OVER (PARTITION BY v.vec_id ORDER BY round(list_inner_product(vec, pv), 6) DESC, n) AS r FROM v CROSS JOIN p)
      SELECT vec_id, CASE n WHEN 1 THEN 'chronological' WHEN 2 THEN 'conceptual' WHEN 3 THEN 'analytical' ELSE 'comparative' END AS intent, score FROM s WHERE r = 1""",
    "calibrate_bands": f"""WITH {_hits_sql(50)} SELECT coalesce(round(quantile_cont(score, 0.9), 3), 0.9) AS high, coalesce(round(quantile_cont(score, 0.7), 3), 0.8) AS mid,
      coalesce(round(quantile_cont(score, 0.5), 3), 0.7) AS low, count(*) AS n FROM hits""",
    "graded_relevance": f"WITH {_hits_sql(20)} SELECT query_id, vec_id, raw_rank, {_GRADE} AS relevance FROM hits",
    "ndcg_at_k": f"WITH {_hits_sql(20)}, {_NDCG} SELECT query_id, round({_GAINS.format(k=10)}, 6) AS ndcg FROM g GROUP BY query_id",
    "ndcg_k_sweep": f"""WITH {_hits_sql(20)}, {_NDCG}, s AS (SELECT query_id, k, {_GAINS.format(k="k")} AS ndcg FROM g CROSS JOIN (SELECT unnest([3, 5, 7, 10, 20]) AS k) GROUP BY query_id, k)
      SELECT CAST(k AS INT) AS k, round(avg(ndcg), 6) AS mean_ndcg, count(*) AS queries FROM s GROUP BY k""",
    "intrinsic_topk_agg": f"""WITH {_hits_sql(5)}, c AS (SELECT query_id, least(greatest(score, 0.0), 1.0) AS s FROM hits)
      SELECT query_id, round(avg(s), 6) AS mean, max(s) AS max, round(median(s), 6) AS median FROM c GROUP BY query_id""",
    "decade_timeline": f"""WITH {_full_sql(20)} SELECT CASE WHEN regexp_matches(CAST(year AS VARCHAR), '^[0-9]{{4}}$') THEN substr(CAST(year AS VARCHAR), 1, 3) || '0s' ELSE 'n/a' END AS decade, count(*) AS n FROM full_hits GROUP BY 1""",
    "citation_numbering": f"""WITH {_full_sql(8)}, {_CITED.format(order="CASE WHEN query_id % 100 = 0 THEN coalesce(year, 9999) ELSE 0 END")} SELECT query_id, vec_id, pos AS position, citation FROM cited""",
    "prompt_compose": f"""WITH {_full_sql(5)}, {_CITED.format(order="0")} SELECT query_id, 'Context:' || chr(10) || string_agg('[' || citation || '] ' || coalesce(title, 'untitled') || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '): ' || coalesce(text, ''), chr(10) ORDER BY pos) AS prompt
      FROM cited GROUP BY query_id""",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_topk, knn_source_diverse, temporal_modulated_search, temporal_rerank_decades, must_include_blacklist, semantic_blend_rerank, dedupe_text_topk, greedy_diversity,
        relevance_quartiles, exact_k_pad, intent_argmax, calibrate_bands, graded_relevance, ndcg_at_k, ndcg_k_sweep, intrinsic_topk_agg, decade_timeline, citation_numbering, prompt_compose, prompt_compose_whole, retrieve_raw, retrieve_final, reformulated_queries, full_prompts,
    )
}
