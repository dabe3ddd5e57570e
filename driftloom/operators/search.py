"""Exact search of many queries at once, and what follows it: ranks, diversity, labels, padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftloom.functions.text import query_decades
from driftloom.functions.vectors import cosine, dot, temporal_modulation, valid_year

#: Bytes of the query vectors that one scan of the corpus carries.
BLOCK_BYTES = 64_000_000


def usable(vectors: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Rows whose vector is not null, not zero, and of the given size."""
    rows = vectors.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    return rows if size is None else rows.where(F.size(vector) == size)


def knn_search(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """``(query_id, vec_id, score, raw_rank)``: the k best rows of the corpus by cosine, exactly.

    A query does not find the row with its own id; ties go to the smaller id.  Scores are rounded
    to six digits before they are compared, so that both sides of a tie are seen as such.

    Scale: queries are broadcast in blocks of bounded bytes; a block takes one pass over the corpus, in
    which every partition keeps a running best list.  So k rows for each query and partition are
    shuffled, however many rows a partition has, and the corpus itself never is.
    """
    spark = corpus.sparkSession
    asked = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-size.n * (size.d or 1) * 8 // BLOCK_BYTES))
    rows = corpus.select(F.col(vec_id).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    for block in range(blocks if size.n else 0):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        taken = part.collect()
        if not taken:
            continue
        ids = np.array([r.q for r in taken], np.int64)
        matrix = np.array([r.v for r in taken])
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def multiply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
            best = np.full((len(ids), k), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    piece = batch.slice(start, 2048)
                    own = piece.column(0).to_numpy()
                    x = np.asarray(piece.column(1).flatten()).reshape(-1, matrix.shape[1])
                    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    for first in range(0, len(ids), 4096):
                        q = slice(first, first + 4096)
                        score = np.round(matrix[q] @ x, 6)
                        score[ids[q, None] == own[None, :]] = -np.inf
                        _keep_best(best[q], best_ids[q], score, own, k)
            q, place = np.nonzero(best > -np.inf)
            for first in range(0, len(q), 100_000):
                at = slice(first, first + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[at]]), pa.array(best_ids[q[at], place[at]]), pa.array(best[q[at], place[at]])], ["query_id", "vec_id", "score"])

        hits = rows.mapInArrow(multiply, "query_id bigint, vec_id bigint, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("raw_rank", F.row_number().over(best)).where(F.col("raw_rank") <= k)


def _keep_best(best: np.ndarray, best_ids: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> None:
    """Merge new scores into the running best lists, in place; ties go to the smaller id."""
    # only rows with something at least as good as their last place change
    rows = np.flatnonzero(score.max(axis=1, initial=-np.inf) >= best[:, -1])
    if not len(rows):
        return
    score = score[rows]
    if score.shape[1] > 4 * k:  # all that reach the k-th best value, ties included
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        width = int((score >= least[:, None]).sum(axis=1).max())
        top = np.argpartition(-score, width - 1, axis=1)[:, :width]
    else:
        top = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    all_scores = np.concatenate((best[rows], np.take_along_axis(score, top, 1)), axis=1)
    all_ids = np.concatenate((best_ids[rows], own[top]), axis=1)
    order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    best[rows], best_ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def diversify_sources(hits: DataFrame, k: int, *, query: str = "query_id", source: str = "source_file", rank: str = "raw_rank") -> DataFrame:
    """First the best hit of each source, then the rest, in rank order; k of them with ``rank``."""
    turn = F.row_number().over(W.partitionBy(query, source).orderBy(rank))
    first = hits.withColumn("again", F.when(turn > 1, 1).otherwise(0))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy("again", rank))).where(F.col("rank") <= k).drop("again")


def temporal_rerank(
    hits: DataFrame,
    k: int,
    *,
    threshold: float = 0.4,
    low: int = 1900,
    high: int = 2100,
    must_include: tuple[str, ...] = (),
    blacklist: tuple[str, ...] = (),
    tie: str = "vec_id",
) -> DataFrame:
    """Best strong hit of each decade, decades ascending, then by score; one hit per source.

    Years missing or out of range count as ``low``.  Sources whose name holds a blacklisted part
    are left out; those holding a part of ``must_include`` come first.
    """
    key = F.lower(F.coalesce(F.expr("nullif(source_file, '')"), F.expr("nullif(title, '')"), F.lit("unknown")))
    year = F.when(F.col("year").try_cast("int").between(low, high), F.col("year").try_cast("int")).otherwise(low)
    rows = hits.withColumn("key", key).withColumn("decade", (F.floor(year / 10) * 10).cast("int"))
    for part in blacklist:
        rows = rows.where(~F.col("key").contains(part.lower()))
    best = F.row_number().over(W.partitionBy("query_id", "decade").orderBy(F.desc("score"), tie))
    forced = F.lit(False)
    for part in must_include:
        forced = forced | F.col("key").contains(part)
    rows = rows.withColumn("strong", (best == 1) & (F.col("score") >= threshold)).withColumn("forced", forced)
    order = [F.desc("forced"), F.desc("strong"), F.when(F.col("strong") & ~F.col("forced"), F.col("decade")).otherwise(0), F.desc("score"), F.col(tie)]
    once = rows.withColumn("turn", F.row_number().over(W.partitionBy("query_id", "key").orderBy(*order))).where("turn = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("turn")


def keep_first_text(hits: DataFrame, k: int, *, rank: str = "raw_rank", text: str = "text") -> DataFrame:
    """Of equal texts (white space aside) the first; then the first k."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+", " "))
    turn = F.row_number().over(W.partitionBy("query_id", plain).orderBy(rank))
    once = hits.withColumn("turn", turn).where("turn = 1").drop("turn")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(rank))).where(F.col("rank") <= k)


def greedy_diversity(hits: DataFrame, k: int, threshold: float, *, rank: str = "raw_rank", vector: str = "vector", vec_id: str = "vec_id") -> DataFrame:
    """Hits in rank order, each kept unless too similar to one kept before, k at most.

    The hits of one query are few (the search's k), so the fold runs over one array per query.
    """
    item = F.struct(F.col(rank).alias("r"), F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.array().cast("array<struct<r:int,id:bigint,v:array<double>>>")

    def step(kept: Column, x: Column) -> Column:
        fits = (F.size(kept) < k) & ~F.exists(kept, lambda y: cosine(y["v"], x["v"]) > threshold)
        return F.when(fits, F.array_append(kept, x)).otherwise(kept)

    kept = ranked.select("query_id", F.posexplode(F.aggregate("all", start, step)).alias("place", "x"))
    return kept.select("query_id", F.col("x.id").alias(vec_id), F.col("x.r").alias(rank), (F.col("place") + 1).cast("int").alias("rank"))


def quartile_labels(hits: DataFrame, *, score: str = "score") -> DataFrame:
    """Relevance 0..3 by the quartile of the score among the query's hits; 1 where all are equal."""
    w = W.partitionBy("query_id")
    q = [F.percentile(score, F.lit(p)).over(w) for p in (0.25, 0.5, 0.75)]
    s = F.col(score)
    label = F.when(F.min(score).over(w) == F.max(score).over(w), 1).when(s <= q[0], 0).when(s <= q[1], 1).when(s <= q[2], 2).otherwise(3)
    return hits.withColumn("relevance", label.cast("int"))


def exact_k(hits: DataFrame, k: int, *, rank: str = "rank") -> DataFrame:
    """Exactly k rows for each query that has hits: the last one is repeated, marked ``is_pad``."""
    last = F.max(rank).over(W.partitionBy("query_id"))
    rows = hits.where(F.col(rank) <= k).withColumn("last", last)
    copies = F.sequence(F.col(rank), F.when(F.col(rank) == F.col("last"), F.lit(k)).otherwise(F.col(rank)))
    return rows.withColumn("place", F.explode(copies)).withColumn("is_pad", F.col("place") > F.col(rank)).withColumn(rank, F.col("place").cast("int")).drop("last", "place")


def classify(queries: DataFrame, prototypes: list[tuple[str, list[float]]], *, vector: str = "vector") -> DataFrame:
    """The label of the nearest prototype; ties go to the first label."""
    scores = [F.struct(F.round(dot(F.col(vector), F.array(*map(F.lit, v))), 6).alias("s"), F.lit(-n).alias("n"), F.lit(label).alias("label")) for n, (label, v) in enumerate(prototypes)]
    return queries.withColumn("best", F.array_max(F.array(*scores))).withColumn("intent", F.col("best.label")).withColumn("score", F.col("best.s")).drop("best")


def citation_numbers(hits: DataFrame, *, by_year: Column | None = None, rank: str = "rank") -> DataFrame:
    """Numbers of sources by first appearance; chunks by year first where ``by_year`` holds."""
    year = F.coalesce(F.col("year").try_cast("int"), F.lit(9999))
    order = [F.when(by_year, year).otherwise(0) if by_year is not None else F.lit(0), F.col(rank)]
    placed = hits.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    first = placed.withColumn("first", F.min("position").over(W.partitionBy("query_id", "source_file")))
    return first.withColumn("citation", F.dense_rank().over(W.partitionBy("query_id").orderBy("first"))).drop("first")


def initial_k(final_k: int, oversample: int = 15) -> int:
    """How many hits a search asks for before reranking: at least eight for each one kept."""
    return max(final_k * oversample, final_k * 8)


def retrieve(hits: DataFrame, k: int, *, most_characters: int = 500) -> tuple[DataFrame, DataFrame]:
    """``(raw, final)`` of a search's hits with their chunks' columns and the query's text.

    The pipeline: texts cut to ``most_characters``, scores modulated by the years that the query names,
    one hit for each source in order of the final score, equal texts once, quartile labels, and
    exactly k rows, the last one repeated if there are fewer.  A query without hits gives no rows.
    """
    raw = hits.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, most_characters))
    years = query_decades(F.coalesce("query_text", F.lit("")))
    scored = raw.withColumn("final_score", F.round(temporal_modulation(F.col("score"), valid_year(F.col("year")), years), 6))
    order = [F.desc("final_score"), F.col("vec_id")]
    key = F.lower(F.coalesce(F.expr("nullif(source_file, '')"), F.expr("nullif(title, '')"), F.lit("unknown")))
    one = scored.withColumn("key", key).withColumn("own", F.row_number().over(W.partitionBy("query_id", "key").orderBy(*order))).where("own = 1")
    ranked = one.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    distinct = keep_first_text(ranked, 1 << 30, rank="place")
    return raw, exact_k(quartile_labels(distinct, score="final_score"), k)
