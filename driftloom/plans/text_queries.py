"""Cleaning, chunking and metadata: queries and their SQL.

The SQL is written by itself, with its own patterns, so that a wrong constant shows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftloom.functions import metadata as md, text as tx
from driftloom.operators import chunking as ch
from driftloom.operators.metadata import attach_metadata, latest_extractions
from driftloom.sources.tables import table

def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source_file", F.coalesce("text", F.lit("")).alias("text"))


def _cleaner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _texts(spark, folder).select("doc_id", tx.CLEANERS[name](F.col("text")).alias("text"))

    query.__name__ = f"clean_{name}"
    return query


def clean_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain over parsed scans."""
    return table(spark, folder, "parsed").select("parse_id", tx.clean_text(F.col("text")).alias("cleaned_text"))


def toc_page_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look like a contents page: a heading, or over five contents titles of their own file."""
    own = table(spark, folder, "metadata").where("source_file is not null").select("source_file", F.explode("toc.title").alias("t")).where("length(t) > 0")
    titles = own.groupBy("source_file").agg(F.collect_set("t").alias("titles"))  # those of one file
    texts = _texts(spark, folder).join(titles, "source_file", "left")
    known = F.coalesce(F.size(F.filter("titles", lambda t: F.col("text").contains(t))), F.lit(0))
    heading = F.col("text").rlike(r"(?i)\btable[ \t\r\n]+of[ \t\r\n]+contents\b|\binhaltsverzeichnis\b")
    return texts.select("doc_id", ((F.length("text") >= 100) & (heading | (known > 5))).alias("is_contents"))


def block_body(spark: SparkSession, folder: str) -> DataFrame:
    """Body of a document from its blocks (paragraphs): the abstract first, no metadata, no short blocks."""
    blocks = F.filter(F.transform(F.split("text", r"\n\n+"), tx.strip), lambda b: F.length(b) >= 30)
    words = lambda b: F.size(F.filter(F.split(b, rf"{tx.SPACE}+"), lambda w: w != ""))
    first = F.get(F.filter("blocks", lambda b: b.rlike(r"(?i)\babstract\b")), F.lit(0))
    kept = F.filter("blocks", lambda b: ~b.rlike(f"(?i){tx.BLOCK_WORDS}") & (words(b) >= 20))
    rest = F.filter(kept, lambda b: F.coalesce(b != F.col("abstract"), F.lit(True)))
    found = _texts(spark, folder).select("doc_id", blocks.alias("blocks")).withColumn("abstract", first)
    return found.select("doc_id", F.array_join(F.when(F.col("abstract").isNull(), rest).otherwise(F.concat(F.array("abstract"), rest)), "\n").alias("body"))


def adaptive_params(spark: SparkSession, folder: str) -> DataFrame:
    by_pages, by_length = ch.adaptive_size(F.col("page_count")), ch.adaptive_size_by_length(F.col("file_size"))
    rows = table(spark, folder, "metadata").select("source_file", "page_count", "file_size", by_pages.alias("p"), by_length.alias("l"))
    return rows.select("source_file", "page_count", "file_size", F.col("p.size").alias("size"), F.col("p.overlap").alias("overlap"), F.col("l.size").alias("size_l"), F.col("l.overlap").alias("overlap_l"))


def static_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at most 384 characters from the cleaned scans."""
    rows = table(spark, folder, "cleaned").select("clean_id", F.posexplode(ch.static_chunks(F.col("cleaned_text"))).alias("chunk_no", "text"))
    return rows.select("clean_id", "chunk_no", "text", F.length("text").alias("chunk_size"), F.lit(384).alias("configured_chunk_size"))


def adaptive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose size follows the number of pages of the scan."""
    pages = table(spark, folder, "parsed").groupBy("parse_id").agg(F.max("parse_info.page_count").alias("pages"))
    rows = table(spark, folder, "cleaned").join(pages, "parse_id", "left").withColumn("p", ch.adaptive_size(F.col("pages")))
    chunks = ch.fold_chunks(ch.sentences_of(F.col("cleaned_text")), F.col("p.size"), 400, bounded=False)
    return rows.select("clean_id", "p.size", F.posexplode(chunks).alias("chunk_no", "text"))


def title_checks(spark: SparkSession, folder: str) -> DataFrame:
    title = md.normal_title(F.col("title"))
    return table(spark, folder, "documents").select("doc_id", title.alias("title"), md.title_valid(title).alias("is_valid"))


def year_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The best year of a document of those in its date, whole text, name and identifiers."""
    found = table(spark, folder, "documents").select(
        "doc_id",
        md.date_year(F.col("published_at").cast("string")).alias("by_date"),
        F.array_max(md.strict_years(F.col("text"))).alias("by_text"),
        md.filename_year(F.col("source_file")).alias("by_name"),
        md.arxiv_year(F.coalesce("text", F.lit(""))).alias("by_identifier"),
        F.col("year").alias("stored"),
    )
    return found.withColumn("best", md.best_year((1, 100, F.col("stored")), (2, 60, F.col("by_date")), (3, 45, F.col("by_text")), (4, 30, F.col("by_name")), (5, 60, F.col("by_identifier"))))


def year_candidates_whole(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`year_candidates`; a year of publication in the text comes before plain years, and years count only if valid."""
    found = table(spark, folder, "documents").select(
        "doc_id",
        md.date_year(F.col("published_at").cast("string")).alias("by_date"),
        md.context_year(F.coalesce("text", F.lit(""))).alias("by_context"),
        F.array_max(F.filter(md.strict_years(F.col("text")), lambda y: md.valid_year(y).isNotNull())).alias("by_text"),
        md.filename_year(F.col("source_file")).alias("by_name"),
        md.arxiv_year(F.coalesce("text", F.lit(""))).alias("by_identifier"),
        F.col("year").alias("stored"),
    )
    best = md.best_year((1, 100, F.col("stored")), (2, 60, F.col("by_date")), (3, 95, F.col("by_context")), (3, 45, F.col("by_text")), (4, 30, F.col("by_name")), (5, 60, F.col("by_identifier")))
    return found.withColumn("best", best)


def year_refined(spark: SparkSession, folder: str) -> DataFrame:
    """The stored year, checked against the text."""
    return table(spark, folder, "documents").select("doc_id", md.year_refined(F.col("year"), F.col("text")).alias("year"))


def page_years(spark: SparkSession, folder: str) -> DataFrame:
    """Year and score of the first pages; a page is a paragraph here."""
    rows = table(spark, folder, "documents").select("doc_id", md.page_year(F.split(F.coalesce("text", F.lit("")), r"\n\n+")).alias("p"))
    return rows.select("doc_id", "p.year", "p.score")


def title_of(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid title of a document's own field and of its first lines."""
    return table(spark, folder, "documents").select("doc_id", md.best_title(F.col("title"), F.lit(None).cast("string"), md.first_line_title(F.col("text"))).alias("title"))


def authors_of(spark: SparkSession, folder: str) -> DataFrame:
    """Authors of a scan: those of the file's latest extraction, else names before the abstract."""
    files = latest_extractions(table(spark, folder, "metadata")).select("file_key", F.col("authors").alias("known"))
    scans = table(spark, folder, "parsed").select("parse_id", "text", F.lower("parse_info.source_file").alias("file_key"))
    authors = md.best_authors(F.col("known"), md.names_in_text(F.col("text")))
    return scans.join(files, "file_key", "left").select("parse_id", F.array_join(authors, "; ").alias("authors"))


def names_in_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Names before the abstract of every scan, normalised and verified."""
    return table(spark, folder, "parsed").select("parse_id", F.array_join(md.best_authors(md.names_in_text(F.col("text"))), "; ").alias("names"))


def name_predicates(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "metadata").select(F.explode("authors").alias("name")).where("name is not null").distinct()
    return names.select("name", md.normal_author(F.col("name")).alias("plain"), md.name_like(F.col("name")).alias("name_like"), md.author_block(F.col("name")).alias("author_block"))


def contents_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Contents entries that stand in the text of a document with a heading of contents."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(md.textual_contents(F.coalesce("text", F.lit("")))).alias("place", "e"))
    return rows.select("doc_id", "place", "e.level", "e.title", "e.page")


def identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", md.doi_of(F.col("text")).alias("doi"), md.arxiv_of(F.col("text")).alias("arxiv"))


def residual_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parsed").select("parse_id", tx.remove_residual_metadata(F.col("text")).alias("text"))


def language_by_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", md.detect_language(F.col("text")).alias("language"))


def contents_text(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "metadata").select("source_file", "extracted_at", F.posexplode("toc").alias("place", "e")).where("e is not null")
    return entries.select("source_file", F.col("place").alias("place"), "e.level", "e.title", "e.page")


def metadata_left_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = attach_metadata(table(spark, folder, "chunk"), table(spark, folder, "metadata"))
    return joined.select("chunk_id", "chunk_no", "source_file", "file_title", "file_year", "file_page_count")


def latest_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return latest_extractions(table(spark, folder, "metadata")).select("file_key", "title", "year", "page_count", "extractions")


def person_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "metadata").select(F.explode("authors").alias("name")).where("name is not null").distinct()
    return names.select("name", md.person_like(F.col("name")).alias("is_person"))


def stable_chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk").select("chunk_id", "chunk_no", tx.stable_chunk_id(F.col("source_file"), F.col("year"), F.col("text")).alias("stable_id"))


def query_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned, sanitised and dated queries of the log."""
    q = F.col("query_refined")
    cleaned = tx.substitute(tx.clean_query(F.concat(F.coalesce(q, F.lit("")), F.lit("  over time over time"))), tx.OVER_TIME)
    return table(spark, folder, "llm_log").select("log_id", cleaned.alias("query"), tx.sanitise_id(q).alias("query_key"), F.array_join(tx.query_decades(F.coalesce(q, F.lit(""))), ",").alias("decades"))


# --- SQL -------------------------------------------------------------------------------------


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORD_COUNT = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"
_TEXTS = "t AS (SELECT doc_id, source_file, coalesce(text, '') AS text FROM documents)"
_STRICT = "list_distinct(list_transform(list_filter(regexp_extract_all(coalesce({0}, ''), '[0-9]+'), lambda r: regexp_matches(r, '^(19|20)[0-9]{{2}}$')), lambda r: CAST(r AS INT)))"
_VALID_YEARS = "list_filter(" + _STRICT + ", lambda y: y BETWEEN 1800 AND 2026)"
_PUBLISHED = r"list_max(list_filter(list_transform(regexp_extract_all(regexp_replace({0}, '([0-9]{{4}})[0-9]+', 'n', 'g'), '(?i)(published online|published|accepted|received|copyright|©)[^0-9\n]{{0,20}}([0-9]{{4}})', 2), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1800 AND 2026))"


def _each(text: str, *steps: tuple[str, str]) -> str:
    """Substitutions one after the other."""
    for pattern, new in steps:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


#: The cleaners in SQL, each over a column ``text``.
_CLEANING = {
    "unicode_spaces": _each("text", (r"[\x{00A0}\x{2000}-\x{200B}]+", " ")),
    "soft_hyphens": _each("replace(text, chr(173), '')", (r"([\pL\pN_]+)-\n([\pL\pN_]+)", r"\1\2")),
    "layout_lines": _TRIM.format(
        r"""array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\s+$', '')),
          lambda l: NOT regexp_matches(l, '(?i)^\s*(table\s+of\s+contents|inhaltsverzeichnis|contents)\s*$') AND NOT (length(trim(l, E' \t\r\f')) <= 80 AND (
            regexp_matches(l, '(?i)^\s*(page\s+\d+|p\.?\s*\d+|\d+)\s*$') OR regexp_matches(l, '(?i)^\s*(funded\s+by|supported\s+by|this\s+preprint\s+|arxiv:\s*\d{{4}}\.\d{{4,5}})')
            OR regexp_matches(l, '(?i)^\s*doi:\s*10\.\d{{4,9}}/[-._;()/:A-Z0-9]+$')))), chr(10))""".replace("{{", "{").replace("}}", "}")
    ),
    "line_join": _TRIM.format(_each("text", (r"(\S)\n(\S)", r"\1 \2"), (r"\n{3,}", r"' || chr(10) || chr(10) || '"))),
    "trailing_space": _TRIM.format(_each("array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\\s+$', '')), chr(10))", (r"\n{3,}", r"' || chr(10) || chr(10) || '"))),
    "html": _each("text", (r"<[^>\n]*>", ""), ("&[a-zA-Z]+;", "")),
    "science": _each("text", (r"\b(Eq|Theorem|Lemma)\s+\d+\b", "")),
    "citations": _TRIM.format(_each(
        "text", (r"\([A-Z][A-Za-z\-]+(,?\s([A-Z]\.)+)*(\s&\s[A-Z][A-Za-z\-]+)*,\s?\d{4}[a-z]?\)", ""), (r"\([A-Z][A-Za-z\-]+\s+et\s+al\.,\s*\d{4}[a-z]?\)", ""),
        (r"\[\s?\d+([\-,–]\s?\d+)*(\s*,\s*\d+)*\s?\]", ""), (r"\(\s?\d{4}[a-z]?\s?\)", ""), (r"(?i)\bdoi:\s*\S+", ""), (r"(?i)\barxiv:\s*\S+", ""),
        (r"(?i)\b(Proc\.|Proceedings|Conf\.|Conference|JMLR|ICML|NeurIPS|NIPS|AAAI|IJCAI|ACL|EMNLP|COLING|IEEE|ACM)\b.*?\d{4}", ""),
        (r"\[[A-Z][A-Za-z\-]+(\s+et\s+al\.)?,?\s*\d{4}[a-z]?\]", ""), (r"(?i)\bin\s+proceedings\s+of\b[^.\n]*([.\n])", r"\1"), (r"\s{2,}", " "), (r"\s+([.,;:])", r"\1"),
    )),
    "references": _TRIM.format(r"""CASE WHEN len(string_split_regex(text, '(?i)(^|\n)[ \t]*(references|bibliography|literaturverzeichnis)[ \t]*(\n|$)')) > 1
        AND length(string_split_regex(text, '(?i)(^|\n)[ \t]*(references|bibliography|literaturverzeichnis)[ \t]*(\n|$)')[1]) + 1 > 0.2 * length(text)
      THEN string_split_regex(text, '(?i)(^|\n)[ \t]*(references|bibliography|literaturverzeichnis)[ \t]*(\n|$)')[1] ELSE text END"""),
    "deep": _TRIM.format(_each(
        "array_to_string(list_filter(list_transform(string_split(" + _each(
            "text", (r"(?i)\b(https?://|www\.)[^\s<>]+", "<URL>"), (r"[\w.%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<EMAIL>"), (r"\+?\d{1,3}[ \-]\d{3,4}[ \-]\d{4,}", "<PHONE>"), ("[$€£¥]", "<CUR>"),
            (r"(?is)(references|bibliography|literaturverzeichnis|acknowledge?ments|appendix).*", ""), (r"(?im)^[ \t]*(doi|arxiv|http|https)[: \t][^\n]*$", ""),
        ) + r""", chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '' AND length(regexp_replace(l, '\D', '', 'g')) / length(l) <= 0.30
          AND length(regexp_replace(l, '[\pL\pN]|\s', '', 'g')) / length(l) <= 0.40 AND NOT regexp_matches(l, '^\[\d+\]\s*[A-Z][a-z]+') AND NOT regexp_matches(l, '(?i)^table\s+\d+')), chr(10))""",
        (r"\n{3,}", r"' || chr(10) || chr(10) || '"),
    )),
}
_CHAIN = "c0 AS (SELECT parse_id, coalesce(text, '') AS text FROM parsed)" + "".join(f", c{n + 1} AS (SELECT parse_id, {sql} AS text FROM c{n})" for n, sql in enumerate(_CLEANING.values()))
_TITLE = _TRIM.format(_each("{0}", (r"-\s+", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("_", " "), (r"(?i)arxiv:\d{{4}}\.\d{{4,5}}", ""), (r"\bv\d+\b", ""), (r"\s+", " ")).replace("{0}", "@"))
_TITLE = _TITLE.replace("{{", "{").replace("}}", "}")
_TITLE_OK = (r"(length(@) >= 10 AND " + _WORD_COUNT.format("@") + r" BETWEEN 3 AND 30 AND NOT regexp_matches(@, '^[0-9 .]+$') AND NOT regexp_matches(lower(@), 'arxiv|doi:|10\.\d{4}') AND NOT regexp_matches(@, '(?i)(^|[^a-z0-9])v\d+([^a-z0-9]|$)'))")
_BLOCK = r"(regexp_matches(@, '(?i)\b(university|dept|department|institute|school|college|laboratory|lab|affiliat|authors?)\b') OR regexp_matches(@, '^[A-Z][a-z]+( [A-Z][a-z]+)+,? (and|&) [A-Z][a-z]+'))"
_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: " + _TRIM.format("l") + "), lambda l: l <> '')"
_AUTHOR = _TRIM.format(_each("@", ("[•†]", ""), (r"(?i)\b(google|inc\.?|university|institute|labs?|dept\.?|center|centre|zentrum|sciences?)\b", ""), (r"\s+", " ")))
_PERSON = (_WORD_COUNT.format("@") + " BETWEEN 2 AND 5 AND length(@) <= 80 AND NOT regexp_matches(@, '[0-9\\x40]') AND len(list_filter(string_split_regex(@, '\\s+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-ZÀ-Þ]'))) = 0 "
    "AND NOT list_has_any(list_transform(string_split_regex(@, '\\s+'), lambda x: lower(x)), ['university', 'institute', 'department', 'laboratory', 'faculty', 'school', 'academy', 'observatory', 'collaboration', 'of', 'for', 'the'])")  # fmt: skip
_NAME_LIKE = (_WORD_COUNT.format("@") + " BETWEEN 1 AND 5 AND regexp_matches(@, '^[A-ZÀ-Þ]') AND NOT regexp_matches(@, '[0-9]') AND NOT list_has_any(list_transform(string_split_regex(@, '\\s+'), lambda x: lower(x)), "
    "['abstract', 'introduction', 'university', 'department', 'institute', 'arxiv', 'model', 'learning', 'probability', 'appendix', 'keywords', 'ai', 'neural', 'transformer', 'algorithm', 'vol', 'intelligence', 'computing', 'zentrum', 'sciences', 'centre', 'center'])")  # fmt: skip
_RUNS = r"list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?s)Abstract.*', ''), '(^|[^A-Za-zÀ-ÿ.])([A-ZÀ-Þ][a-zà-ÿ]+( [A-ZÀ-Þ]\.)?( [A-ZÀ-Þ][a-zà-ÿ]+){1,2})', 2), lambda n: " + _NAME_LIKE.replace("@", "n") + ")"
_ONCE = "array_to_string(list_filter(u, lambda n, i: list_position(u, n) = i), '; ')"
_VERIFIED_LIST = "list_filter(list_transform(list_filter({0}, lambda n: n IS NOT NULL), lambda n: " + _AUTHOR.replace("@", "n") + "), lambda n: n <> '' AND " + _PERSON.replace("@", "n") + ")"


def _fold(size: str, least: int, bound: str, texts: str) -> str:
    """Chunks of ``s`` by a reduction over a list, whose last entry is the chunk being filled."""
    join = "CASE WHEN a[-1] = '' THEN x ELSE a[-1] || ' ' || x END"
    return f"""{texts}, f AS (SELECT *, list_reduce(s, lambda a, x: CASE WHEN a[-1] = '' OR length({join}) <= {size} THEN list_append(a[:-2], {join}) ELSE list_append(a, x) END, ['']) AS a FROM w),
      d AS (SELECT *, CASE WHEN a[-1] = '' THEN CAST([] AS VARCHAR[]) WHEN length(a[-1]) < {least} AND len(a) > 1 {bound} THEN list_append(a[:-3], a[-2] || ' ' || a[-1]) ELSE a END AS c FROM f),
      e AS (SELECT *, unnest(c) AS text, CAST(unnest(range(len(c))) AS INT) AS chunk_no FROM d)"""


_SENTENCES = r"list_filter(string_split(regexp_replace(coalesce({0}, ''), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"

SQL = {f"clean_{name}": f"WITH {_TEXTS} SELECT doc_id, {sql} AS text FROM t" for name, sql in _CLEANING.items()} | {
    "clean_chain": f"WITH {_CHAIN} SELECT parse_id, text AS cleaned_text FROM c{len(_CLEANING)}",
    "static_chunks": "WITH " + _fold("384", 100, "AND length(a[-2] || ' ' || a[-1]) <= 384", "w AS (SELECT clean_id, flatten(list_transform(" + _SENTENCES.format("cleaned_text") + ", lambda x: list_transform(range((length(x) - 1) // 384 + 1), lambda k: substr(x, k * 384 + 1, 384)))) AS s FROM cleaned)")
    + " SELECT clean_id, chunk_no, text, CAST(length(text) AS INT) AS chunk_size, 384 AS configured_chunk_size FROM e",
    "adaptive_chunks": "WITH " + _fold("size", 400, "", """p AS (SELECT parse_id, max(parse_info.page_count) AS pages FROM parsed GROUP BY 1),
      w AS (SELECT clean_id, CASE WHEN pages > 50 THEN 1000 WHEN pages > 30 THEN 1500 WHEN pages > 10 THEN 2000 WHEN pages IS NOT NULL THEN 2500 ELSE 1000 END AS size, """ + _SENTENCES.format("cleaned_text") + " AS s FROM cleaned LEFT JOIN p USING (parse_id))")
    + " SELECT clean_id, size, chunk_no, text FROM e",
    "language_by_words": """WITH t AS (SELECT doc_id, text, string_split_regex(lower(text), '[^a-zà-ÿ]+') AS w FROM documents),
      n AS (SELECT doc_id, text, len(list_filter(w, lambda x: x IN ('der', 'die', 'das', 'und', 'ist', 'nicht', 'mit', 'den', 'von', 'ein', 'eine', 'für', 'auf', 'sich', 'als', 'wird', 'werden', 'noch', 'seit'))) AS de,
        len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'is', 'to', 'in', 'that', 'with', 'for', 'as', 'was', 'are', 'on', 'by', 'its', 'than', 'this', 'these'))) AS en FROM t)
      SELECT doc_id, CASE WHEN length(text) < 30 THEN NULL WHEN de > en THEN 'de' WHEN en > de THEN 'en' END AS language FROM n""",
    "query_texts": r"""WITH q AS (SELECT log_id, query_refined AS q, coalesce(query_refined, '') AS t FROM llm_log)
      SELECT log_id, regexp_replace(regexp_replace(regexp_replace(lower(t || '  over time over time'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '(\bover time\b)\s*[,.]?\s*\bover time\b', '\1', 'g') AS query,
        CASE WHEN t = '' THEN 'query' ELSE substr(regexp_replace(t, '[^A-Za-z0-9_\-]', '_', 'g'), 1, 80) END AS query_key,
        array_to_string(list_sort(list_distinct(list_transform(list_concat(list_concat(list_transform(list_filter(regexp_extract_all(lower(t), '[0-9a-z_]+'), lambda x: regexp_matches(x, '^(19|20)[0-9]([0-9]|0s)$')), lambda x: CAST(substr(x, 1, 4) AS INT)),
          CASE WHEN contains(lower(t), '20th century') THEN range(1900, 2000, 10) ELSE [] END), CASE WHEN contains(lower(t), '21st century') THEN range(2000, 2100, 10) ELSE [] END), lambda y: CAST(y // 10 * 10 AS INT)))), ',') AS decades FROM q""",
    "year_refined": f"""WITH y AS (SELECT doc_id, CASE WHEN year BETWEEN 1800 AND 2026 THEN year END AS stored, {_PUBLISHED.format("coalesce(text, '')")} AS stated, list_max({_VALID_YEARS.format('text')}) AS plain FROM documents)
      SELECT doc_id, CAST(coalesce(stated, CASE WHEN stored IS NULL OR abs(plain - stored) >= 10 THEN plain END, stored) AS INT) AS year FROM y""",
    "page_years": f"""WITH p AS (SELECT doc_id, unnest(pages[:3]) AS page, unnest(range(len(pages[:3]))) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n\\n+') AS pages FROM documents)),
      y AS (SELECT doc_id, i, {_PUBLISHED.format('page')} AS stated, list_max({_VALID_YEARS.format('page')}) AS plain FROM p),
      b AS (SELECT doc_id, min(CASE WHEN stated IS NOT NULL THEN i END) AS s, min(CASE WHEN plain IS NOT NULL THEN i END) AS f FROM y GROUP BY 1)
      SELECT b.doc_id, CAST(CASE WHEN s IS NOT NULL THEN ys.stated ELSE yp.plain END AS INT) AS year, CAST(CASE WHEN s IS NOT NULL THEN 95 - s ELSE 48 - f END AS INT) AS score
      FROM b LEFT JOIN y ys ON ys.doc_id = b.doc_id AND ys.i = s LEFT JOIN y yp ON yp.doc_id = b.doc_id AND yp.i = f""",
    "title_of": f"""WITH l AS (SELECT doc_id, {_TITLE.replace('@', "coalesce(title, '')")} AS stored,
        {_TITLE.replace('@', "coalesce(list_filter(" + _LINES + ", lambda l: " + _TITLE_OK.replace('@', _TITLE.replace('@', 'l')) + " AND NOT " + _BLOCK.replace('@', 'l') + " AND NOT regexp_matches(l, '(?i)abstract|introduction|contents'))[1], '')")} AS first FROM documents)
      SELECT doc_id, CASE WHEN {_TITLE_OK.replace('@', 'stored')} THEN stored WHEN {_TITLE_OK.replace('@', 'first')} THEN first END AS title FROM l""",
    "names_in_scans": f"WITH u AS (SELECT parse_id, {_VERIFIED_LIST.format(_RUNS)} AS u FROM parsed) SELECT parse_id, {_ONCE} AS names FROM u",
    "authors_of": f"""WITH m AS (SELECT lower(source_file) AS k, arg_max_null(authors, (extracted_at, coalesce(title, ''), coalesce(file_size, -1))) AS known FROM metadata WHERE source_file IS NOT NULL GROUP BY 1),
      j AS (SELECT parse_id, known, {_RUNS} AS runs FROM parsed LEFT JOIN m ON k = lower(parse_info.source_file)),
      c AS (SELECT parse_id, CASE WHEN len(list_filter(known, lambda x: {_TRIM.format("coalesce(x, '')")} <> '')) > 0 THEN known WHEN len(runs) > 0 THEN runs ELSE CAST([] AS VARCHAR[]) END AS a FROM j),
      u AS (SELECT parse_id, {_VERIFIED_LIST.format('a')} AS u FROM c) SELECT parse_id, {_ONCE} AS authors FROM u""",
    "name_predicates": f"""WITH n AS (SELECT DISTINCT a AS name FROM (SELECT unnest(authors) AS a FROM metadata) WHERE a IS NOT NULL)
      SELECT name, {_AUTHOR.replace('@', 'name')} AS plain, {_NAME_LIKE.replace('@', 'name')} AS name_like, {_BLOCK.replace('@', 'name')} AS author_block FROM n""",
    "contents_parsed": r"""WITH l AS (SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
        lambda x: regexp_matches(x, '^([0-9]{0,2}\.?)*[ \t]*[A-ZÄÖÜa-zäöü].{3,}[ \t]+[0-9]{1,3}$') AND regexp_matches(x, '[ \t]{2,}[^ \t]+$')) AS e FROM documents WHERE regexp_matches(text, '(?i)(inhalt|contents)')),
      r AS (SELECT doc_id, unnest(e) AS x, CAST(unnest(range(len(e))) AS INT) AS place FROM l)
      SELECT doc_id, place, CAST(length(regexp_replace(regexp_extract(x, '^([0-9]+([.][0-9]+)*)', 1), '[^.]', '', 'g')) + 1 AS INT) AS level,
        regexp_replace(regexp_replace(regexp_replace(x, '[ \t]{2,}[^ \t]*$', ''), '^[0-9]+(\.[0-9]+)*\.?[ \t]*', ''), '^\s+|\s+$', '', 'g') AS title, CAST(regexp_extract(x, '([0-9]+)$', 1) AS INT) AS page FROM r""",
    "identifiers": r"""SELECT doc_id, nullif(regexp_replace(regexp_extract(coalesce(text, ''), '(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '[.,)]+$', ''), '') AS doi,
      nullif(regexp_extract(coalesce(text, ''), '(?i)\barxiv[:/ ][ ]?([0-9]{4}\.[0-9]{4,5}|[a-z\-]+/[0-9]{7})', 1), '') AS arxiv FROM documents""",
    "residual_metadata": "SELECT parse_id, " + _TRIM.format(_each("coalesce(text, '')", (r"(?im)^[ \t]*(table[ \t]+of[ \t]+contents|inhaltsverzeichnis)\b[^\n]*$", ""), (r"(?im)^[ \t]*(title|authors?|keywords)[ \t]*:[^\n]*$", ""),
      (r"(?im)^[^\n]*\b(university|faculty|institute)\b[^\n]*@[^\n]*$", ""), (r"(?im)^[ \t]*(doi[ \t]*:|https?://doi\.org/)[^\n]*$", ""), (r"(?im)^[ \t]*arxiv[ \t]*:[^\n]*$", ""), (r"\n{3,}", "' || chr(10) || chr(10) || '"))) + " AS text FROM parsed",
    "toc_page_filter": f"""WITH {_TEXTS}, k AS (SELECT source_file, list(DISTINCT e.title) AS titles FROM (SELECT source_file, unnest(toc) AS e FROM metadata WHERE source_file IS NOT NULL) WHERE length(e.title) > 0 GROUP BY 1)
      SELECT doc_id, length(text) >= 100 AND (regexp_matches(text, '(?i)\\btable\\s+of\\s+contents\\b|\\binhaltsverzeichnis\\b') OR coalesce(len(list_filter(titles, lambda x: contains(text, x))), 0) > 5) AS is_contents FROM t LEFT JOIN k USING (source_file)""",
    "block_body": f"""WITH {_TEXTS}, b AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda b: {_TRIM.format('b')}), lambda b: length(b) >= 30) AS blocks FROM t),
      a AS (SELECT *, list_filter(blocks, lambda b: regexp_matches(b, '(?i)\\babstract\\b'))[1] AS abstract FROM b),
      k AS (SELECT *, list_filter(blocks, lambda b: NOT regexp_matches(b, '(?i)title|author|doi|keywords|arxiv|university|faculty|institute|version') AND {_WORD_COUNT.format('b')} >= 20 AND coalesce(b <> abstract, true)) AS kept FROM a)
      SELECT doc_id, array_to_string(CASE WHEN abstract IS NULL THEN kept ELSE list_concat([abstract], kept) END, chr(10)) AS body FROM k""",
    "adaptive_params": """SELECT source_file, page_count, file_size, CASE WHEN page_count > 50 THEN 1000 WHEN page_count > 30 THEN 1500 WHEN page_count > 10 THEN 2000 WHEN page_count IS NOT NULL THEN 2500 ELSE 1000 END AS size,
      CASE WHEN page_count > 50 THEN 700 WHEN page_count > 30 THEN 500 WHEN page_count > 10 THEN 300 ELSE 200 END AS overlap, CASE WHEN file_size > 5000 THEN 1000 WHEN file_size > 2000 THEN 1500 ELSE 2000 END AS size_l,
      CASE WHEN file_size > 5000 THEN 600 WHEN file_size > 2000 THEN 400 ELSE 200 END AS overlap_l FROM metadata""",
    "title_checks": f"WITH n AS (SELECT doc_id, {_TITLE.replace('@', 'coalesce(title, chr(32))')} AS title FROM documents) SELECT doc_id, title, {_TITLE_OK.replace('@', 'title')} AS is_valid FROM n",
    "year_candidates": f"""WITH c AS (SELECT doc_id, CAST(year(published_at) AS INT) AS by_date, list_max({_STRICT.format('text')}) AS by_text,
        list_max({_STRICT.format("regexp_replace(source_file, '(?i)v[0-9]+([.][a-z]+)?$', '')")}) AS by_name, regexp_extract(lower(coalesce(text, '')), 'arxiv:[ \\t]*([0-9]{{2}})[0-9]{{2}}\\.[0-9]{{4,5}}', 1) AS fresh,
        regexp_extract(lower(coalesce(text, '')), '[a-z\\-]+/([0-9]{{2}})[0-9]{{5}}', 1) AS old, year AS stored FROM documents),
      d AS (SELECT * EXCLUDE (fresh, old), CAST(CASE WHEN coalesce(nullif(fresh, ''), nullif(old, '')) < '25' THEN 2000 ELSE 1900 END + CAST(coalesce(nullif(fresh, ''), nullif(old, '')) AS INT) AS INT) AS by_identifier FROM c)
      SELECT *, coalesce(CASE WHEN stored BETWEEN 1800 AND 2026 THEN stored END, CASE WHEN by_date BETWEEN 1800 AND 2026 THEN by_date END, CASE WHEN by_text BETWEEN 1800 AND 2026 THEN by_text END,
        CASE WHEN by_name BETWEEN 1800 AND 2026 THEN by_name END, CASE WHEN by_identifier BETWEEN 1800 AND 2026 THEN by_identifier END) AS best FROM d""",
    "contents_text": """SELECT source_file, CAST(place AS INT) AS place, e.level AS level, e.title AS title, e.page AS page FROM (SELECT source_file, unnest(toc) AS e, unnest(range(len(toc))) AS place FROM metadata) WHERE e IS NOT NULL""",
    "metadata_left_join": """WITH m AS (SELECT lower(source_file) AS k, arg_max(title, (extracted_at, coalesce(title, ''), coalesce(file_size, -1))) AS t, arg_max(page_count, (extracted_at, coalesce(title, ''), coalesce(file_size, -1))) AS p,
        arg_max(year, (extracted_at, year)) FILTER (WHERE year IS NOT NULL) AS y FROM metadata WHERE source_file IS NOT NULL GROUP BY 1)
      SELECT chunk_id, chunk_no, source_file, t AS file_title, y AS file_year, p AS file_page_count FROM chunk LEFT JOIN m ON m.k = lower(source_file)""",
    "latest_metadata": """SELECT lower(source_file) AS file_key, arg_max(title, (extracted_at, coalesce(title, ''), coalesce(file_size, -1))) AS title, arg_max(year, (extracted_at, year)) FILTER (WHERE year IS NOT NULL) AS year,
      arg_max(page_count, (extracted_at, coalesce(title, ''), coalesce(file_size, -1))) AS page_count, count(*) AS extractions FROM metadata WHERE source_file IS NOT NULL GROUP BY 1""",
    "person_names": f"WITH n AS (SELECT DISTINCT a AS name FROM (SELECT unnest(authors) AS a FROM metadata) WHERE a IS NOT NULL) SELECT name, {_PERSON.replace('@', 'name')} AS is_person FROM n",
    "stable_chunk_ids": """SELECT chunk_id, chunk_no, coalesce(source_file, 'unknown') || '::' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '::' || substr(sha1(substr(coalesce(text, ''), 1, 200)), 1, 12) AS stable_id FROM chunk""",
}

QUERIES = {f"clean_{name}": _cleaner(name) for name in tx.CLEANERS} | {
    f.__name__: f
    for f in (
        clean_chain, toc_page_filter, block_body, adaptive_params, static_chunks, adaptive_chunks, title_checks, year_candidates, year_candidates_whole, year_refined, page_years, title_of, authors_of, names_in_scans, name_predicates, contents_parsed, identifiers, residual_metadata, language_by_words, contents_text,
        metadata_left_join, latest_metadata, person_names, stable_chunk_ids, query_texts,
    )
}
