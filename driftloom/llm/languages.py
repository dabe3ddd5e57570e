"""Languages told by words, with weights trained on labelled texts.

Naive Bayes on whether a word occurs in a text: of each word that stands in at least one in a hundred
texts of some language, the logarithm of its share among the texts of each language, relative to the
language that uses it most.  Labels may be wrong in part, and may be written as codes of two or three
letters, with a region, or as names.

Scale: words are counted with partial aggregation over a bounded sample of the labelled rows; what
reaches the driver is at most (distinct words of a mean text) x 100 words a language.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: A word's weight in each language; 0 where it is used most, less elsewhere.
Weights = dict[str, dict[str, float]]

# Names and codes of three letters of languages.
CODES = {
    "eng": "en", "english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "ingles": "en",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "aleman": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "französisch": "fr", "français": "fr", "francés": "fr", "frances": "fr",
    "spa": "es", "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es", "espanol": "es",
}
#: Texts of a language without the word that are added to those seen, so that a rare label tells little.
_PRIOR = 20


def code_of(label: Column) -> Column:
    """A language label as a code of two letters; null for none and for ``und``."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)", 1)
    named = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(named[bare], F.when(bare.rlike("^[a-z]{2}$"), bare))


def fit_languages(rows: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 20_000, least_share: float = 0.01) -> Weights:
    """Weights of the words of labelled texts.

    ``sample_rows`` bounds the rows that are expected to be read into the counts; they are chosen by
    a hash of ``key``.  Null texts and labels that name no language are left out; without any
    labelled text the result is empty.
    """
    share = min(1.0, sample_rows / max(rows.count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000)).select(code_of(F.col(lang)).alias("code"), F.lower(F.col(text)).alias("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\p{L}+(?:'\p{L}+)?"), 0))
    chosen = chosen.where("code is not null and text is not null")
    sizes = {r.code: r.n for r in chosen.groupBy("code").agg(F.count("*").alias("n")).collect()}  # at most 26 x 26 codes
    if not sizes:
        return {}
    texts = F.create_map(*(F.lit(x) for code, n in sizes.items() for x in (code, float(n + _PRIOR))))
    seen = chosen.select("code", F.explode(words).alias("word")).groupBy("word", "code").agg(F.count("*").alias("n")).select("word", "code", (F.col("n") / texts[F.col("code")]).alias("share"))
    told = seen.groupBy("word").agg(F.collect_list(F.struct("code", "share")).alias("shares"), F.max("share").alias("most")).where(F.col("most") >= least_share)
    weights = {}
    for r in told.collect():
        shares = {x.code: x.share for x in r.shares}
        logs = {code: math.log(shares.get(code, 0.0) + 0.02 * r.most + 1e-4) for code in sizes}
        top = max(logs.values())
        weights[r.word] = {code: x - top for code, x in logs.items()}
    return weights


def scores_of(words: Iterable[str], weights: Weights) -> Counter:
    """The summed weights of the known words for each language; empty if no word is known."""
    scores: Counter = Counter()
    for word, n in Counter(words).items():
        for code, weight in weights.get(word, {}).items():
            scores[code] += n * weight
    return scores


def language_of(words: Iterable[str], weights: Weights, margin: float) -> str | None:
    """The language that leads all others by ``margin``, if one does."""
    ranked = scores_of(words, weights).most_common(2)
    return ranked[0][0] if len(ranked) > 1 and ranked[0][1] - ranked[1][1] >= margin else None
