"""Evaluation of logged answers, and statistics of the records: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftloom.functions import text as tx
from driftloom.functions.vectors import band
from driftloom.operators import evaluation as ev
from driftloom.operators.ordering import numbered_within
from driftloom.sources.readers import raw_pairs
from driftloom.sources.tables import table

STRICT_YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"


def answers(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.when(tx.strip(F.coalesce("model_output", F.lit(""))) != "", F.col("model_output")), F.col("answer"), F.lit(""))
    return table(spark, folder, "llm_log").select("log_id", F.coalesce("model", F.lit("unknown")).alias("model"), text.alias("answer"), "retrieved_chunks_raw", "retrieved_chunks_final")


def final_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = answers(spark, folder).select("log_id", "model", "answer", F.posexplode("retrieved_chunks_final").alias("place", "c")).where("c is not null")
    return rows.select("log_id", "model", "answer", (F.col("place") + 1).alias("rank"), F.col("c.id").alias("chunk_id"), F.col("c.text").alias("text"), F.coalesce("c.relevance", F.lit(0)).alias("relevance"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return answers(spark, folder).select("log_id", "model", F.posexplode(tx.claims_of(F.col("answer"))).alias("claim_no", "claim"))


def claims_split(spark: SparkSession, folder: str) -> DataFrame:
    year = F.regexp_extract("claim", STRICT_YEAR, 1)
    return _claims(spark, folder).select("log_id", "claim_no", "claim", F.when(year != "", year.cast("int")).alias("claim_year"), F.round(tx.specificity(F.col("claim")), 6).alias("specificity"))


def _support(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim with the mean of its three best supports among the final chunks; 0 without chunks."""
    chunks = final_chunks(spark, folder).select("log_id", ev.words_of(F.col("text")).alias("chunk_words"))
    claims = _claims(spark, folder).withColumn("claim_words", ev.words_of(F.col("claim")))
    joint = F.size(F.array_intersect("claim_words", "chunk_words"))
    alike = F.when(joint > 0, joint / F.sqrt(F.size("claim_words") * F.size("chunk_words"))).otherwise(0.0)
    each = claims.join(chunks, "log_id", "left").withColumn("s", F.coalesce(ev.overlap_support(F.col("claim_words"), F.col("chunk_words")), F.lit(0.0))).withColumn("l", F.coalesce(alike, F.lit(0.0)))
    top = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 3)
    best = each.groupBy("log_id", "model", "claim_no", "claim").agg(top("s").alias("top"), top("l").alias("near"))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c), 9)
    return best.select("log_id", "model", "claim_no", "claim", mean("top").alias("support"), F.get("top", F.lit(0)).alias("best"), mean("near").alias("likeness"))


def fact_filter(spark: SparkSession, folder: str) -> DataFrame:
    label = band(F.col("best"), (0.22, "keep"), (0.15, "revise"), default="drop")
    return _support(spark, folder).select("log_id", "claim_no", F.round("best", 6).alias("best"), label.alias("label"))


def filtered_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers rebuilt from the claims that are kept or to be revised; the answer itself where none is."""
    claims = _support(spark, folder).where("best >= 0.15").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "claim"))).alias("c"))
    rebuilt = F.array_join(F.transform("c", lambda x: x["claim"]), " ")
    return answers(spark, folder).select("log_id", "answer").join(claims, "log_id", "left").select("log_id", F.coalesce(rebuilt, "answer").alias("answer"), F.coalesce(F.size("c"), F.lit(0)).alias("claims"))


def faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over claims of their support less a penalty for facts.

    Support under 0.10 is replaced by the banded likeness of claim and evidence, in which words of the
    evidence count as well, so that a long one does not hold a claim by chance.
    """
    penalty = F.least(F.lit(1.0), tx.specificity(F.col("claim"))) * 0.08
    fallback = band(F.col("likeness"), (0.80, 1.0), (0.55, 0.5), (0.30, 0.25), default=0.0)
    support = F.when(F.col("support") < 0.10, fallback).otherwise(F.col("support"))
    return _support(spark, folder).groupBy("log_id").agg(F.round(F.avg(F.greatest(F.lit(0.0), support - penalty)), 6).alias("faithfulness"), F.count("*").alias("claims"))


def citation_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance 0..3 of final chunks by likeness to the answer and by being cited as [rank]."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[([0-9]{1,4})\]"), F.lit(1)), lambda n: n.cast("int"))
    alike = ev.overlap_support(ev.words_of(F.col("answer")), ev.words_of(F.col("text")))
    rows = final_chunks(spark, folder).withColumn("cited", F.array_contains(cited, F.col("rank"))).withColumn("s", alike)
    relevance = F.when(F.col("cited") & (F.col("s") >= 0.70), 3).when(F.col("s") >= 0.70, 2).when(F.col("s") >= 0.45, 1).otherwise(0)
    return rows.select("log_id", "rank", "cited", F.round("s", 6).alias("likeness"), relevance.alias("relevance"))


def log_validation(spark: SparkSession, folder: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    missing = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast(answers_type)), lambda x: x.isNotNull() & x["id"].isNull()))
    rows = answers(spark, folder)
    answers_type = rows.schema["retrieved_chunks_final"].dataType
    labels = F.array_distinct(F.transform(F.filter("retrieved_chunks_final", lambda x: x.isNotNull()), lambda x: F.coalesce(x["relevance"], F.lit(0))))
    full = F.greatest(size("retrieved_chunks_raw"), F.lit(0))
    final = F.greatest(size("retrieved_chunks_final"), F.lit(0))
    return rows.select(
        "log_id", (full > 0).alias("has_raw"), (final > 0).alias("has_final"), (tx.strip(F.col("answer")) != "").alias("has_answer"),
        missing("retrieved_chunks_raw").alias("raw_without_id"), missing("retrieved_chunks_final").alias("final_without_id"),
        ((final > 1) & (F.coalesce(F.size(labels), F.lit(0)) == 1)).alias("same_relevance"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """One evaluation record for each log: NDCG@5 of its final chunks and faithfulness, null without either."""
    gains = ev.ndcg(final_chunks(spark, folder), 5, group=["log_id"]).select("log_id", F.round("ndcg", 6).alias("ndcg"))
    return answers(spark, folder).select("log_id", "model").join(gains, "log_id", "left").join(faithfulness(spark, folder).drop("claims"), "log_id", "left")


def evaluation_records(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder)


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    done = F.col("ndcg").isNotNull()
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return records(spark, folder).groupBy("model").agg(F.count("*").alias("files"), F.count_if(done).alias("evaluated"), mean("ndcg").alias("mean_ndcg"), mean("faithfulness").alias("mean_faithfulness"))


def metric_stats(spark: SparkSession, folder: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6)
    return records(spark, folder).groupBy("model").agg(r6(F.avg("ndcg")).alias("mean"), r6(F.median("ndcg")).alias("median"), r6(F.stddev_pop("ndcg")).alias("sd_all"), r6(F.stddev_samp("ndcg")).alias("sd_sample"))


def pearson(spark: SparkSession, folder: str) -> DataFrame:
    pairs = records(spark, folder).where("ndcg is not null and faithfulness is not null")
    return pairs.agg(F.when(F.count("*") >= 3, F.round(F.corr("ndcg", "faithfulness"), 6)).alias("r"), F.count("*").alias("pairs"))


def spearman(spark: SparkSession, folder: str) -> DataFrame:
    pairs = records(spark, folder).where("ndcg is not null and faithfulness is not null")
    ranked = ev.average_ranks(ev.average_ranks(pairs, "ndcg", "a"), "faithfulness", "b")
    return ranked.agg(F.when(F.count("*") >= 3, F.round(F.corr("a", "b"), 6)).alias("rho"), F.count("*").alias("pairs"))


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    means = ev.bootstrap_means(records(spark, folder), value="ndcg", order="log_id", iterations=2000, seed=42)
    at = lambda p: F.round(F.percentile("mean", F.lit(p)), 6)
    return means.agg(F.round(F.avg("mean"), 6).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))


def outliers_iqr_z(spark: SparkSession, folder: str) -> DataFrame:
    return ev.iqr_and_z_outliers(records(spark, folder), ["ndcg", "faithfulness"]).select("log_id", "model", "ndcg", "faithfulness")


def zscore_outliers(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    stats = rows.groupBy("model").agg(F.avg("ndcg").alias("m"), F.stddev_samp("ndcg").alias("s"))
    z = (F.col("ndcg") - F.col("m")) / (F.coalesce("s", F.lit(0.0)) + 1e-6)
    return rows.join(stats, "model").withColumn("z", F.round(z, 4)).where("abs(z) > 1.5").select("log_id", "model", "z")


def control_chart(spark: SparkSession, folder: str) -> DataFrame:
    """Records in order within their model, with mean and limits."""
    rows = records(spark, folder).where("ndcg is not null")
    stats = rows.groupBy("model").agg(F.avg("ndcg").alias("m"), F.stddev_pop("ndcg").alias("s"))
    r6 = lambda c: F.round(c, 6)
    m, s = F.col("m"), F.col("s")
    return numbered_within(rows, "model", "log_id", "run").join(stats, "model").select("log_id", "model", "run", "ndcg", r6(m).alias("mean"), r6(m - s).alias("low1"), r6(m + s).alias("high1"), r6(m - 3 * s).alias("low3"), r6(m + 3 * s).alias("high3"))


def _band(value: Column) -> Column:
    return F.when(value.isNull(), "missing").when(value >= 0.5, "high").when(value >= 0.25, "mid").otherwise("low")


def bands_by_model(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder).withColumn("band", _band(F.col("faithfulness")))
    wide = rows.groupBy("model").pivot("band", ["high", "mid", "low", "missing"]).count()
    return wide.fillna(0)


def band_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All bands in their order, also those without records."""
    counts = records(spark, folder).groupBy(_band(F.col("faithfulness")).alias("band")).agg(F.count("*").alias("n"))
    order = spark.createDataFrame([(0, "high"), (1, "mid"), (2, "low"), (3, "missing")], "place int, band string")
    return order.join(counts, "band", "left").select("place", "band", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen bins over [0, 1], the last one closed; empty bins too."""
    bins = records(spark, folder).where("ndcg is not null").groupBy(F.least(F.floor(F.col("ndcg") * 15), F.lit(14)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(15).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def density_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Gaussian density on 200 points of [0, 1], scaled to a peak of 0.25; of distinct values with weights."""
    values = records(spark, folder).where("ndcg is not null").groupBy("ndcg").agg(F.count("*").alias("n"))
    stats = records(spark, folder).where("ndcg is not null").agg(F.count("*").alias("all"), F.stddev_samp("ndcg").alias("s"))
    points = values.crossJoin(stats).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(199))))
    h = F.col("s") * F.pow(F.col("all"), F.lit(-0.2))
    u = (F.col("point") / 199.0 - F.col("ndcg")) / h
    density = points.where("s > 0").groupBy("point").agg((F.sum(F.col("n") * F.exp(-u * u / 2)) / F.first(F.col("all") * h)).alias("d"))
    peak = density.agg(F.max("d").alias("peak"))
    return density.crossJoin(peak).select("point", F.round(F.col("d") / F.col("peak") * 0.25, 6).alias("density"))


def correlation_p_values(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson's and Spearman's correlation of both metrics with their two-sided p."""
    pairs = records(spark, folder).where("ndcg is not null and faithfulness is not null")
    ranked = ev.average_ranks(ev.average_ranks(pairs, "ndcg", "a"), "faithfulness", "b")
    found = ranked.agg(F.corr("ndcg", "faithfulness").alias("r"), F.corr("a", "b").alias("rho"), F.count("*").alias("n"))
    return found.select(F.round("r", 6).alias("r"), F.round(ev.correlation_p_value(F.col("r"), F.col("n")), 6).alias("r_p"), F.round("rho", 6).alias("rho"), F.round(ev.correlation_p_value(F.col("rho"), F.col("n")), 6).alias("rho_p"), F.col("n").alias("pairs"))


def histogram_by_span(spark: SparkSession, folder: str) -> DataFrame:
    """Bins whose edges follow the span of the values: 11 from 0.8 or higher to 1, 14 around a narrow span, else 15 of [0, 1]."""
    rows = records(spark, folder).where("ndcg is not null").groupBy("ndcg").agg(F.count("*").alias("n"))
    low, high = F.min("ndcg"), F.max("ndcg")
    top = (high - low < 0.05) & (high > 0.8)
    narrow = high - low < 0.2
    edges = rows.agg(
        F.when(top, F.greatest(F.lit(0.8), low - 0.01)).when(narrow, F.greatest(F.lit(0.0), low - 0.05)).otherwise(0.0).alias("a"),
        F.when(top, 1.0).when(narrow, F.least(F.lit(1.0), high + 0.05)).otherwise(1.0).alias("z"),
        F.when(top, 11).when(narrow, 14).otherwise(15).alias("bins"),
    )
    bin_of = F.least(F.floor((F.col("ndcg") - F.col("a")) / (F.col("z") - F.col("a")) * F.col("bins")), F.col("bins") - 1).cast("int")
    counts = rows.crossJoin(F.broadcast(edges)).groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("n"))  # one row of edges
    places = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edge = lambda k: F.round(F.col("a") + (F.col("z") - F.col("a")) * k / F.col("bins"), 6)
    return places.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def faithfulness_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The four ways to band faithfulness: missing kept apart or counted as low, strict cuts, six levels."""
    v = F.col("faithfulness")
    known = F.coalesce(v, F.lit(0.0))
    six = F.when(v.isNull(), "missing").when(v >= 0.95, "excellent").when(v >= 0.85, "very high").when(v >= 0.75, "high").when(v >= 0.6, "moderate").when(v >= 0.4, "low").otherwise("very low")
    ways = {"apart": _band(v), "together": _band(known), "strict": F.when(v.isNull(), "missing").when(v >= 0.8, "high").when(v >= 0.5, "mid").otherwise("low"), "six": six}
    melted = records(spark, folder).select(F.explode(F.array(*(F.struct(F.lit(name).alias("way"), b.alias("band")) for name, b in ways.items()))).alias("x"))
    return melted.groupBy("x.way", "x.band").agg(F.count("*").alias("n"))


def complete_records(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have any metric, and how many have both."""
    rows = records(spark, folder)
    metrics = ["ndcg", "faithfulness"]
    return rows.agg(F.count("*").alias("all")).crossJoin(rows.dropna("all", subset=metrics).agg(F.count("*").alias("any"))).crossJoin(rows.dropna("any", subset=metrics).agg(F.count("*").alias("both")))  # one row each


def model_union(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the models, one frame for each put together, with their place in their own order."""
    rows = records(spark, folder)
    cut = [rows.where(F.col("ndcg") >= 0.5).withColumn("part", F.lit("good")), rows.where(F.col("ndcg").isNull()).withColumn("part", F.lit("none")).drop("ndcg"), rows.where(F.col("ndcg") < 0.5).withColumn("part", F.lit("poor"))]
    whole = cut[0].unionByName(cut[1], allowMissingColumns=True).unionByName(cut[2])
    return whole.groupBy("model", "part").agg(F.count("*").alias("records"), F.round(F.avg("ndcg"), 6).alias("mean"))


def raw_query_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How many (query, text) pairs each log gives to calibrate thresholds by."""
    pairs = raw_pairs(table(spark, folder, "llm_log").select("log_id", "query_refined", "retrieved_chunks_raw").withColumn("query", F.concat(F.coalesce("query_refined", F.lit("")), F.lit("#"), F.col("log_id"))))
    return pairs.groupBy("query").agg(F.count("*").alias("pairs"), F.sum(F.length("text")).alias("characters"))


def summary_table(spark: SparkSession, folder: str) -> DataFrame:
    stats = records(spark, folder).groupBy("model").agg(F.avg("ndcg").alias("m"), F.stddev_samp("ndcg").alias("s"), F.count("ndcg").alias("n"))
    half = F.when(F.col("n") > 1, 1.96 * F.col("s") / F.sqrt("n")).otherwise(0.0)
    return stats.select("model", F.format_string("%.3f ± %.3f", F.round(F.coalesce("m", F.lit(0.0)), 6), F.round(half, 6)).alias("ndcg"))


def convergence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of the first n records of each model, for growing n."""
    rows = numbered_within(records(spark, folder).where("ndcg is not null"), "model", "log_id", "run")
    sizes = rows.withColumn("n", F.explode(F.array(*map(F.lit, (10, 30, 50, 100))))).where("run <= n")
    return sizes.groupBy("model", "n").agg(F.round(F.avg("ndcg"), 6).alias("mean"), F.round(F.stddev_pop("ndcg"), 6).alias("sd"), F.count("*").alias("records"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and sums of the event stream by hour and type, as the streaming version gives them."""
    events = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type")
    return events.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- SQL -------------------------------------------------------------------------------------

_SP = tx.SPACE
_STRIP = f"regexp_replace({{0}}, '^{_SP}+|{_SP}+$', '', 'g')"
_ANSWERS = f"""a AS (SELECT log_id, coalesce(model, 'unknown') AS model, coalesce(CASE WHEN {_STRIP.format("coalesce(model_output, '')")} <> '' THEN model_output END, answer, '') AS answer,
    retrieved_chunks_raw, retrieved_chunks_final FROM llm_log)"""
_FINAL = """f AS (SELECT log_id, model, answer, CAST(place AS INT) AS rank, c.id AS chunk_id, c.text AS text, coalesce(c.relevance, 0) AS relevance
    FROM (SELECT log_id, model, answer, unnest(retrieved_chunks_final) AS c, unnest(range(1, len(retrieved_chunks_final) + 1)) AS place FROM a) WHERE c IS NOT NULL)"""
_COUNT = f"len(list_filter(string_split_regex({{0}}, '{_SP}+'), lambda w: w <> ''))"
_SPECIFIC = f"(len(regexp_extract_all(claim, '[0-9]+')) + len(regexp_extract_all(claim, '[A-Z][a-z]+'))) / greatest({_COUNT.format('claim')}, 5)"
_CLAIMS = f"""l AS (SELECT log_id, model, list_filter(list_transform(string_split_regex(answer, '[.!?]{_SP}+'), lambda s: {_STRIP.format("s")}), lambda s: {_COUNT.format("s")} >= 3) AS claims FROM a),
    cl AS (SELECT log_id, model, unnest(claims) AS claim, CAST(unnest(range(len(claims))) AS INT) AS claim_no FROM l)"""
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_OVERLAP = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, {1})) / len({0}) ELSE 0 END"
_ALIKE = "CASE WHEN len(list_intersect({0}, {1})) > 0 THEN len(list_intersect({0}, {1})) / sqrt(len({0}) * len({1})) ELSE 0 END"
_SUPPORT = f"""e AS (SELECT cl.log_id, cl.model, claim_no, claim, coalesce({_OVERLAP.format(_WORDS.format("claim"), _WORDS.format("f.text"))}, 0) AS s,
      coalesce({_ALIKE.format(_WORDS.format("claim"), _WORDS.format("f.text"))}, 0) AS l FROM cl LEFT JOIN (SELECT log_id, text, true AS there FROM f) f ON f.log_id = cl.log_id),
    top AS (SELECT log_id, model, claim_no, claim, list_slice(list_sort(list(s), 'DESC'), 1, 3) AS t, list_slice(list_sort(list(l), 'DESC'), 1, 3) AS tl FROM e GROUP BY 1, 2, 3, 4),
    su AS (SELECT log_id, model, claim_no, claim, round(list_sum(t) / len(t), 9) AS support, t[1] AS best, round(list_sum(tl) / len(tl), 9) AS likeness FROM top)"""
_FAITH = f"fa AS (SELECT log_id, round(avg(greatest(0.0, CASE WHEN support >= 0.1 THEN support WHEN likeness >= 0.8 THEN 1.0 WHEN likeness >= 0.55 THEN 0.5 WHEN likeness >= 0.3 THEN 0.25 ELSE 0.0 END - least(1.0, {_SPECIFIC}) * 0.08)), 6) AS faithfulness, count(*) AS claims FROM su GROUP BY 1)"
_GAIN = """ng AS (SELECT log_id, relevance AS rel, row_number() OVER (PARTITION BY log_id ORDER BY rank) AS pos, row_number() OVER (PARTITION BY log_id ORDER BY relevance DESC, rank) AS best FROM f),
    nd AS (SELECT log_id, round(CASE WHEN sum(CASE WHEN best <= 5 THEN rel / log2(best + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) / sum(CASE WHEN best <= 5 THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END, 6) AS ndcg FROM ng GROUP BY 1)"""
_BASE = f"WITH {_ANSWERS}, {_FINAL}, {_CLAIMS}"
_RECORDS = f"{_BASE}, {_SUPPORT}, {_FAITH}, {_GAIN}, r AS (SELECT a.log_id, a.model, nd.ndcg, fa.faithfulness FROM a LEFT JOIN nd USING (log_id) LEFT JOIN fa USING (log_id))"
_PAIRS = "p AS (SELECT * FROM r WHERE ndcg IS NOT NULL AND faithfulness IS NOT NULL)"
_BAND = "CASE WHEN faithfulness IS NULL THEN 'missing' WHEN faithfulness >= 0.5 THEN 'high' WHEN faithfulness >= 0.25 THEN 'mid' ELSE 'low' END"
_ODD = """({m} < {m}_q1 - 1.5 * ({m}_q3 - {m}_q1) OR {m} > {m}_q3 + 1.5 * ({m}_q3 - {m}_q1)) AND {m}_q3 > {m}_q1"""

SQL = {
    "claims_split": f"{_BASE} SELECT log_id, claim_no, claim, CAST(nullif(regexp_extract(claim, '{STRICT_YEAR}', 1), '') AS INT) AS claim_year, round({_SPECIFIC}, 6) AS specificity FROM cl",
    "fact_filter": f"{_BASE}, {_SUPPORT} SELECT log_id, claim_no, round(best, 6) AS best, CASE WHEN best >= 0.22 THEN 'keep' WHEN best >= 0.15 THEN 'revise' ELSE 'drop' END AS label FROM su",
    "filtered_answers": f"""{_BASE}, {_SUPPORT}, k AS (SELECT log_id, string_agg(claim, ' ' ORDER BY claim_no) AS t, CAST(count(*) AS INT) AS n FROM su WHERE best >= 0.15 GROUP BY 1)
      SELECT a.log_id, coalesce(t, answer) AS answer, coalesce(n, 0) AS claims FROM a LEFT JOIN k USING (log_id)""",
    "histogram_by_span": f"""{_RECORDS}, v AS (SELECT ndcg FROM r WHERE ndcg IS NOT NULL), m AS (SELECT min(ndcg) AS lo, max(ndcg) AS hi FROM v),
      g AS (SELECT CASE WHEN hi - lo < 0.05 AND hi > 0.8 THEN greatest(0.8, lo - 0.01) WHEN hi - lo < 0.2 THEN greatest(0.0, lo - 0.05) ELSE 0.0 END AS a, CASE WHEN hi - lo < 0.05 AND hi > 0.8 THEN 1.0 WHEN hi - lo < 0.2 THEN least(1.0, hi + 0.05) ELSE 1.0 END AS z,
        CASE WHEN hi - lo < 0.05 AND hi > 0.8 THEN 11 WHEN hi - lo < 0.2 THEN 14 ELSE 15 END AS bins FROM m),
      c AS (SELECT least(CAST(floor((ndcg - a) / (z - a) * bins) AS INT), bins - 1) AS bin, count(*) AS n FROM v CROSS JOIN g GROUP BY 1), p AS (SELECT a, z, bins, unnest(range(bins)) AS bin FROM g)
      SELECT CAST(p.bin AS INT) AS bin, round(a + (z - a) * p.bin / bins, 6) AS low, round(a + (z - a) * (p.bin + 1) / bins, 6) AS high, coalesce(n, 0) AS n FROM p LEFT JOIN c USING (bin)""",
    "faithfulness_bands": f"""{_RECORDS}, x AS (SELECT unnest([('apart', {_BAND}), ('together', CASE WHEN faithfulness >= 0.5 THEN 'high' WHEN faithfulness >= 0.25 THEN 'mid' ELSE 'low' END),
        ('strict', CASE WHEN faithfulness IS NULL THEN 'missing' WHEN faithfulness >= 0.8 THEN 'high' WHEN faithfulness >= 0.5 THEN 'mid' ELSE 'low' END),
        ('six', CASE WHEN faithfulness IS NULL THEN 'missing' WHEN faithfulness >= 0.95 THEN 'excellent' WHEN faithfulness >= 0.85 THEN 'very high' WHEN faithfulness >= 0.75 THEN 'high' WHEN faithfulness >= 0.6 THEN 'moderate' WHEN faithfulness >= 0.4 THEN 'low' ELSE 'very low' END)]) AS p FROM r)
      SELECT p[1] AS way, p[2] AS band, count(*) AS n FROM x GROUP BY 1, 2""",
    "complete_records": f"""{_RECORDS} SELECT count(*) AS "all", count(coalesce(ndcg, faithfulness)) AS "any", count(ndcg + faithfulness) AS both FROM r""",
    "model_union": f"""{_RECORDS} SELECT model, CASE WHEN ndcg IS NULL THEN 'none' WHEN ndcg >= 0.5 THEN 'good' ELSE 'poor' END AS part, count(*) AS records, round(avg(ndcg), 6) AS mean FROM r GROUP BY 1, 2""",
    "raw_query_pairs": """WITH p AS (SELECT coalesce(query_refined, '') || '#' || log_id AS query, unnest(retrieved_chunks_raw) AS c FROM llm_log)
      SELECT query, count(*) AS pairs, CAST(sum(length(c.text)) AS BIGINT) AS characters FROM p WHERE trim(c.text) <> '' GROUP BY 1""",
    "faithfulness": f"{_BASE}, {_SUPPORT}, {_FAITH} SELECT * FROM fa",
    "citation_relevance": f"""{_BASE}, s AS (SELECT log_id, rank, list_contains(list_transform(regexp_extract_all(answer, '\\[([0-9]{{1,4}})\\]', 1), lambda n: CAST(n AS INT)), rank) AS cited, {_OVERLAP.format(_WORDS.format("answer"), _WORDS.format("text"))} AS s FROM f)
      SELECT log_id, rank, cited, round(s, 6) AS likeness, CAST(CASE WHEN cited AND s >= 0.7 THEN 3 WHEN s >= 0.7 THEN 2 WHEN s >= 0.45 THEN 1 ELSE 0 END AS INT) AS relevance FROM s""",
    "log_validation": f"""WITH {_ANSWERS} SELECT log_id, coalesce(len(retrieved_chunks_raw), 0) > 0 AS has_raw, coalesce(len(retrieved_chunks_final), 0) > 0 AS has_final, {_STRIP.format("answer")} <> '' AS has_answer,
      CAST(coalesce(len(list_filter(retrieved_chunks_raw, lambda x: x IS NOT NULL AND x.id IS NULL)), 0) AS INT) AS raw_without_id, CAST(coalesce(len(list_filter(retrieved_chunks_final, lambda x: x IS NOT NULL AND x.id IS NULL)), 0) AS INT) AS final_without_id,
      coalesce(len(retrieved_chunks_final), 0) > 1 AND coalesce(len(list_distinct(list_transform(list_filter(retrieved_chunks_final, lambda x: x IS NOT NULL), lambda x: coalesce(x.relevance, 0)))), 0) = 1 AS same_relevance FROM a""",
    "evaluation_records": f"{_RECORDS} SELECT * FROM r",
    "batch_summary": f"{_RECORDS} SELECT model, count(*) AS files, count(ndcg) AS evaluated, round(coalesce(avg(ndcg), 0.0), 4) AS mean_ndcg, round(coalesce(avg(faithfulness), 0.0), 4) AS mean_faithfulness FROM r GROUP BY model",
    "metric_stats": f"{_RECORDS} SELECT model, round(avg(ndcg), 6) AS mean, round(median(ndcg), 6) AS median, round(stddev_pop(ndcg), 6) AS sd_all, round(stddev_samp(ndcg), 6) AS sd_sample FROM r GROUP BY model",
    "pearson": f"{_RECORDS}, {_PAIRS} SELECT CASE WHEN count(*) >= 3 THEN round(corr(ndcg, faithfulness), 6) END AS r, count(*) AS pairs FROM p",
    "spearman": f"""{_RECORDS}, {_PAIRS}, k AS (SELECT rank() OVER (ORDER BY ndcg) + (count(*) OVER (PARTITION BY ndcg) - 1) / 2.0 AS a, rank() OVER (ORDER BY faithfulness) + (count(*) OVER (PARTITION BY faithfulness) - 1) / 2.0 AS b FROM p)
      SELECT CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS rho, count(*) AS pairs FROM k""",
    "bootstrap_ci": f"""{_RECORDS}, n AS (SELECT ndcg AS x, row_number() OVER (ORDER BY log_id) - 1 AS pos, count(*) OVER () AS size FROM r WHERE ndcg IS NOT NULL),
      d AS (SELECT turn, CAST('0x' || substr(md5('42-' || turn || '-' || pos), 1, 8) AS BIGINT) % size AS pick FROM (SELECT unnest(range(2000)) AS turn) CROSS JOIN n),
      m AS (SELECT turn, avg(n.x) AS mean FROM d JOIN n ON n.pos = d.pick GROUP BY turn)
      SELECT round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""",
    "outliers_iqr_z": f"""{_RECORDS}, q AS (SELECT quantile_cont(ndcg, 0.25) AS ndcg_q1, quantile_cont(ndcg, 0.75) AS ndcg_q3, avg(ndcg) AS ndcg_m, stddev_pop(ndcg) AS ndcg_s, quantile_cont(faithfulness, 0.25) AS faithfulness_q1,
        quantile_cont(faithfulness, 0.75) AS faithfulness_q3, avg(faithfulness) AS faithfulness_m, stddev_pop(faithfulness) AS faithfulness_s FROM r)
      SELECT log_id, model, ndcg, faithfulness FROM r CROSS JOIN q WHERE {" OR ".join(f"coalesce({_ODD.format(m=m)}, false) OR coalesce({m}_s > 0 AND abs({m} - {m}_m) > 3 * {m}_s, false)" for m in ("ndcg", "faithfulness"))}""",
    "zscore_outliers": f"""{_RECORDS}, s AS (SELECT model, avg(ndcg) AS m, stddev_samp(ndcg) AS s FROM r GROUP BY model), z AS (SELECT log_id, r.model, round((ndcg - m) / (coalesce(s, 0) + 1e-6), 4) AS z FROM r JOIN s USING (model))
      SELECT * FROM z WHERE abs(z) > 1.5""",
    "control_chart": f"""{_RECORDS}, s AS (SELECT model, avg(ndcg) AS m, stddev_pop(ndcg) AS s FROM r WHERE ndcg IS NOT NULL GROUP BY model)
      SELECT log_id, model, CAST(row_number() OVER (PARTITION BY model ORDER BY log_id) AS INT) AS run, ndcg, round(m, 6) AS mean, round(m - s, 6) AS low1, round(m + s, 6) AS high1, round(m - 3 * s, 6) AS low3, round(m + 3 * s, 6) AS high3
      FROM r JOIN s USING (model) WHERE ndcg IS NOT NULL""",
    "bands_by_model": f"""{_RECORDS}, b AS (SELECT model, {_BAND} AS band FROM r) SELECT model, count(*) FILTER (WHERE band = 'high') AS high, count(*) FILTER (WHERE band = 'mid') AS mid, count(*) FILTER (WHERE band = 'low') AS low,
      count(*) FILTER (WHERE band = 'missing') AS missing FROM b GROUP BY model""",
    "band_counts": f"""{_RECORDS}, b AS (SELECT {_BAND} AS band, count(*) AS n FROM r GROUP BY 1), o AS (SELECT * FROM (VALUES (0, 'high'), (1, 'mid'), (2, 'low'), (3, 'missing')) AS t(place, band))
      SELECT place, o.band, coalesce(n, 0) AS n FROM o LEFT JOIN b USING (band)""",
    "histogram": f"""{_RECORDS}, b AS (SELECT CAST(least(floor(ndcg * 15), 14) AS INT) AS bin, count(*) AS n FROM r WHERE ndcg IS NOT NULL GROUP BY 1) SELECT CAST(g.bin AS INT) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(15)) AS bin) g LEFT JOIN b ON b.bin = g.bin""",
    "density_grid": f"""{_RECORDS}, v AS (SELECT ndcg FROM r WHERE ndcg IS NOT NULL), s AS (SELECT count(*) AS c, stddev_samp(ndcg) * pow(count(*), -0.2) AS h FROM v),
      d AS (SELECT point, sum(exp(-pow((point / 199.0 - ndcg) / h, 2) / 2)) / first(c * h) AS d FROM v CROSS JOIN s CROSS JOIN (SELECT unnest(range(200)) AS point) WHERE h > 0 GROUP BY point)
      SELECT CAST(point AS INT) AS point, round(d / max(d) OVER () * 0.25, 6) AS density FROM d""",
    "summary_table": f"""{_RECORDS}, s AS (SELECT model, avg(ndcg) AS m, stddev_samp(ndcg) AS s, count(ndcg) AS n FROM r GROUP BY model)
      SELECT model, format('{{:.3f}} ± {{:.3f}}', round(coalesce(m, 0.0), 6), round(CASE WHEN n > 1 THEN 1.96 * s / sqrt(n) ELSE 0.0 END, 6)) AS ndcg FROM s""",
    "convergence": f"""{_RECORDS}, o AS (SELECT model, ndcg, row_number() OVER (PARTITION BY model ORDER BY log_id) AS run FROM r WHERE ndcg IS NOT NULL), x AS (SELECT * FROM o CROSS JOIN (SELECT unnest([10, 30, 50, 100]) AS n) WHERE run <= n)
      SELECT model, CAST(n AS INT) AS n, round(avg(ndcg), 6) AS mean, round(stddev_pop(ndcg), 6) AS sd, count(*) AS records FROM x GROUP BY model, n""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        claims_split, fact_filter, filtered_answers, faithfulness, correlation_p_values, histogram_by_span, faithfulness_bands, complete_records, model_union, raw_query_pairs, citation_relevance, log_validation, evaluation_records, batch_summary, metric_stats, pearson, spearman, bootstrap_ci,
        outliers_iqr_z, zscore_outliers, control_chart, bands_by_model, band_counts, histogram, density_grid, summary_table, convergence, event_windows,
    )
}
