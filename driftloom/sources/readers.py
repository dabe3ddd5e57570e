"""Scans of run logs, chunk files, prompts and sidecars, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = "struct<id:string,text:string,score:double,final_score:double,raw_rank:int,rank:int,relevance:int,year:string,metadata:struct<source_file:string,title:string,year:string>>"
RUN_LOG = (
    f"query string, query_refined string, processed_query string, intent string, model string, prompt_final_to_llm string, model_output string, answer string, "
    f"retrieved_chunks_raw array<{CHUNK}>, retrieved_chunks_final array<{CHUNK}>, chunks_final_to_llm array<{CHUNK}>, _corrupt string"
)


def first_filled(*columns: str):
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in columns))


def read_run_logs(spark: SparkSession, path: str, pattern: str = "llm_*.json") -> DataFrame:
    """One row per log file; unreadable files keep a row with ``error``.

    Input logs (``llm_input_*``) match the usual pattern too and are left out here.
    """
    logs = spark.read.schema(RUN_LOG).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", pattern).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    final = F.when(F.size("retrieved_chunks_final") > 0, F.col("retrieved_chunks_final")).otherwise(F.col("chunks_final_to_llm"))
    return logs.select(
        name.alias("log_name"), first_filled("query", "query_refined", "processed_query").alias("query"), "intent", "model", first_filled("model_output", "answer").alias("response"),
        "retrieved_chunks_raw", final.alias("retrieved_chunks_final"), F.col("_corrupt").alias("error"),
    ).where(~F.col("log_name").startswith("llm_input_"))


def read_chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of ``{"chunks": [...]}`` files, or one chunk of a file that only has ``text``."""
    schema = "text string, chunks array<struct<text:string,chunk_size:int,configured_chunk_size:int,overlap:int>>"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    alone = F.array(F.struct(F.col("text"), F.lit(None).cast("int").alias("chunk_size"), F.lit(None).cast("int").alias("configured_chunk_size"), F.lit(None).cast("int").alias("overlap")))
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    rows = files.select(stem.alias("source"), F.posexplode(F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(alone)).alias("chunk_no", "c"))
    return rows.select("source", "chunk_no", "c.*").where("trim(text) <> ''")


def read_prompts(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Prompts of a text file, one a line, blank lines left out; the first so many if asked for."""
    lines = spark.read.text(path).select(F.trim("value").alias("prompt"), F.monotonically_increasing_id().alias("n")).where("prompt <> ''")
    return (lines if first is None else lines.orderBy("n").limit(first)).select("prompt")


def read_metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """Metadata records, one JSON object a file; the file's stem stands in for a missing source."""
    schema = "source_file string, title string, authors array<string>, year string, detected_language string, page_count int, has_toc boolean, toc array<struct<level:int,title:string,page:int>>, file_size bigint"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return files.select(stem.alias("stem"), F.coalesce("source_file", stem).alias("source_file"), "title", "authors", F.col("year").try_cast("int").alias("year"), "detected_language", "page_count", "has_toc", "toc", "file_size")


def read_evaluation_records(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """Evaluation records ``<model folder>/<query>.json``; the model is the folder's name if not stated.

    NaN counts as null, and records without any metric are left out.
    """
    schema = f"query_id string, model_name string, `ndcg@k` double, `ndcg@{k}` double, ndcg double, faithfulness double"
    files = spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    folder = F.regexp_replace(F.element_at(parts, -2), "^eval_logs_", "")
    number = lambda *names: F.coalesce(*(F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")) for n in names))
    rows = files.select(F.coalesce("query_id", F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")).alias("query_id"), F.coalesce("model_name", folder).alias("model"), number("ndcg@k", f"ndcg@{k}", "ndcg").alias("ndcg"), number("faithfulness").alias("faithfulness"))
    return rows.dropna("all", subset=["ndcg", "faithfulness"])


def read_stage_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries ``summary_n<number>.json`` with their ``n``, in its order."""
    schema = "files int, ndcg_mean double, ndcg_ci95_lo double, ndcg_ci95_hi double, faith_mean double, faith_ci95_lo double, faith_ci95_hi double"
    files = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "summary_n*.json").json(path)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"summary_n([0-9]+)[^/]*$", 1).cast("int").alias("n"), *files.columns).where("n is not null").orderBy("n")


def raw_pairs(logs: DataFrame, query: str = "query", chunks: str = "retrieved_chunks_raw") -> DataFrame:
    """``(query, text)`` of every retrieved chunk with text, to calibrate thresholds by."""
    return logs.select(F.col(query).alias("query"), F.explode(chunks).alias("c")).select("query", F.col("c.text").alias("text")).where("trim(query) <> '' and trim(text) <> ''")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their size; the content stays binary for a parser plug-in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), F.col("length").alias("file_size"), "content")


def read_tei(spark: SparkSession, *paths: str) -> DataFrame:
    """Title, authors and year of TEI sidecars ``<stem>.tei.xml``; of several folders the first counts."""
    found = None
    for place, path in enumerate(paths):
        files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.tei.xml").text(path)
        rows = _tei_fields(files).withColumn("place", F.lit(place))
        found = rows if found is None else found.unionByName(rows)
    if len(paths) == 1:
        return found.drop("place")
    rest = [c for c in found.columns if c not in ("stem", "place")]
    return found.groupBy("stem").agg(F.min_by(F.struct(*rest), "place").alias("r")).select("stem", "r.*")


def _tei_fields(files: DataFrame) -> DataFrame:
    xml = F.regexp_replace("value", r"\sxmlns(?::\w+)?=\"[^\"]*\"", "")
    text = lambda p: F.nullif(F.trim(F.expr(f"xpath_string(xml, '{p}')")), F.lit(""))
    names = F.expr("xpath(xml, '//author/persName/forename/text()')"), F.expr("xpath(xml, '//author/persName/surname/text()')")
    # where a date stands, and in which form
    places = ("//publicationStmt/date", "//imprint/date", "//date")
    years = [F.nullif(F.regexp_extract(text(f"{p}{at}"), r"((?:18|19|20)[0-9]{2})", 1), F.lit("")).try_cast("int") for p in places for at in ("/@when", "/@from", "/@notBefore", "/@to", "")]
    titles = [text(p) for p in ("//titleStmt/title[@type=\"main\"]", "//titleStmt/title", "//analytic/title", "//monogr/title")]
    rows = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.tei\.xml$", 1).alias("stem"), xml.alias("xml"))
    return rows.select("stem", F.coalesce(*titles).alias("title"), F.zip_with(*names, lambda a, b: F.concat_ws(" ", a, b)).alias("authors"), F.coalesce(*years).alias("year"))
