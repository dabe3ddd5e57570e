"""Broken prompt and response pairs (problem 2).

The response of a log entry is ``model_output``, or ``answer`` where that is null or only white
space.  Five defects are told apart:

* ``empty``     - nothing is left once labels, tags, quotes and words for nothing are removed.
* ``copy``      - only the question again: same words but for few, also labelled, quoted or twice.
* ``refusal``   - a sentence that declines, and no other sentence that says something.
* ``truncated`` - the text stops inside a sentence or list.  Evidence, by itself: the distinct responses
  are sorted, and a response that is a proper prefix of its neighbour is a shortened version of it
  where the longer one goes on inside the same sentence, line or list; unfinished-looking responses
  whose length is one at which the model's responses pile up (a length limit); and where neither can
  tell, as a text may be cut anywhere and its whole be written nowhere, an open ending.
* ``language``  - words of another language than the query asks for, or is written in, by weights that
  are trained on labelled texts, and for words of questions on queries with the language of their responses.

:func:`truncation_evidence` tells which evidence each truncated response has.

Scale: rules run in one narrow pass.  The neighbour comparison range-partitions the distinct
responses once, into as many partitions as their bytes ask for; only the first and last text of each
partition are compared apart.  Lengths are pre-aggregated to one row per model and length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from driftloom.llm.languages import CODES, Weights, fit_languages, language_of, scores_of
from driftloom.plans.lineage import cut
from driftloom.plans.spread import spread

# Function words of four languages, used where no labelled texts are given.
STOP_WORDS = {
    "en": "the of and to in is was were are that it its with for as by on from this than when which but not has have had they their been more an at or into between what did why how does still first about before after over only our we each both".split(),
    "de": "der die das und ist war von den dem des ein eine einen einer zu mit für auf nicht sich auch als wie bei aus dass noch seit nach zwischen haben hat wird wurde werden sind im in an über vor um gegen schon oder wenn warum wann welche ich diese kann".split(),
    "fr": "le la les des du de et est une un dans pour par sur au aux que qui avec ce ces sont était a ont été entre depuis selon pas ne plus il se comment pourquoi quel sans nous vers cette en ni où je vous à".split(),
    "es": "el la los las de del y es una un en para por con que se su sus entre desde según no más al lo como fueron era han hacia cómo qué cuándo unas unos sobre todo sin ni también donde esta".split(),
}
#: A word counts for the languages that list it, and against the others.
STOP_WEIGHTS: Weights = {w: {code: 0.0 if w in stops else -2.0 for code, stops in STOP_WORDS.items()} for words in STOP_WORDS.values() for w in words}
#: By so much in logarithms a query must lead with its language, and a response with another one.
_LEAD_OF_QUERY, _LEAD_OF_RESPONSE = 1.0, 2.0
_NAMED = {name: code for name, code in CODES.items() if len(name) > 3}
_REQUEST = re.compile(
    r"[\s,.;?!¿¡()-]{0,20}\b(?:please\s+|bitte\s+|por favor\s+|s'il vous plaît\s+)?"
    r"(?:(?:reply|answer|respond|write)\s+in|(?:antworte\w*|schreib\w*)?\s*(?:bitte\s+)?auf|(?:réponds|répondez|répondre)\s+en|(?:responde|responda|contesta|conteste)\s+en)\s+"
    rf"({'|'.join(_NAMED)})\b[\s.!]*",
    re.IGNORECASE,
)
_LABEL = re.compile(
    r"^\W*(?:answer|a|response|output|question|q|query|prompt|antwort|frage|réponse|question|respuesta|pregunta|final answer)\s*:\W*", re.IGNORECASE
)
_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_NOTHING = {"", "null", "none", "nan", "na", "nil", "undefined", "empty", "noanswer", "noresponse", "ninguno", "keine", "aucun"}
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\n+")

# A sentence that declines to answer, in the four languages: who declines, and what.
_DECLINES = re.compile(
    r"""
    \bI(?:'m|\ am)\ (?:sorry|afraid|not\ able|unable)(?!\ for\ the)(?=.*\b(?:not|n't|cannot|unable|decline|elsewhere|others|take\ on)\b|.*\bable\ to\b)
  | \bI\ (?:cannot|can't|can\ not|could\ not|couldn't|won't|will\ not|would\ not|wouldn't|do\ not|don't|must|have\ to|am\ not\ able|am\ unable|would\ rather|prefer)\b.*\b(?:answer|help|assist|respond|reply|comment|provide|decline|request|discuss|engage|share|refuse)
  | \bI'd\ rather\ not\b | \bI(?:\ must|\ have\ to)?\ decline\b
  | \bnot\ possible\ for\ me\b | \bno\ (?:answer|reply|response)\ can\ be\ given\b
  | \bsuch\ requests\ are\ not\b | \bnot\ something\ I\ (?:take|can|will)\b
  | \ba\ matter\ I\ leave\ to\ others\b | \blook\ elsewhere\ for\ (?:that|this)\b
  | \boutside\ my\ (?:remit|scope|competence)\b
  | \bkann\ ich\b.*\bnicht\b.*\b(?:beantworten|helfen|antworten|sagen) | \bich\ kann\b.*\bnicht\b.*\b(?:beantworten|helfen|antworten|sagen)
  | \b(?:darf|möchte|will|werde)\ ich\b.*\b(?:nichts|nicht)\b.*\b(?:sagen|äußern|beantworten|antworten) | \bich\ (?:darf|möchte|will|werde)\b.*\b(?:nichts|nicht)\b.*\b(?:sagen|äußern|beantworten|antworten)
  | \bAntwort\ verweigern\b | \bich\ lehne\b | \b(?:bin\ ich|ich\ bin)\ nicht\ in\ der\ Lage\b
  | \bje\ ne\ (?:peux|puis|saurais|souhaite|veux)\ pas\b | \bje\ ne\ suis\ pas\ en\ mesure\b | \bje\ préfère\ ne\ pas\b | \bje\ (?:dois\ )?(?:refuse|décline)r?\b | \bil\ (?:ne\ )?m'est\ (?:pas\ possible|impossible)\b
  | \bno\ puedo\b.*\b(?:responder|ayudar|contestar) | \bno\ me\ es\ posible\b | \bprefiero\ no\b | \b(?:debo|tengo\ que)\ (?:rechazar|declinar|negarme)\b | \bno\ estoy\ en\ condiciones\b
    """,
    re.IGNORECASE | re.VERBOSE,
)
#: Sentences that may follow a refusal without answering anything.
_POLITE = re.compile(
    r"consult|expert|specialist|spécialiste|especialista|fachperson|something else|anything else|would you like|sorry|apolog|désolé|lo siento|tut mir leid|"
    r"autre chose|algo más|otra cosa|sonst noch|etwas anderes|weiterhelfen|puis-je|puedo ayudar|souhaitez|let me know|thank",
    re.IGNORECASE,
)
_REFERENCE = r"(?:\[\d+\](?:\s*,?\s*\[\d+\])*|\((?:\d+(?:\s*,\s*\d+)*|ibid\.|ebd\.|[^\W\d_]{1,4}\.\s*\d+(?:[-–]\d+)?)\)|\[\d+(?:\s*,\s*\d+)*\])"
_CLOSED = re.compile(rf"[.!?…][\"'”’»)\]*_]*(?:\s*{_REFERENCE})*\s*$|[.!?…]\s*{_REFERENCE}\s*[\"'”’»]?\s*$")
_ABBREVIATED = re.compile(r"(?:\be\.\s?g|\bi\.\s?e|\bz\.\s?B|\bd\.\s?h|\bp\.\s?ex|\bp\.\s?ej|\bcf|\bvgl|\bsuch as|\bviz)\.$|(?:^|\n)\s*\d+[.)]$", re.IGNORECASE)
_TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
_PAIR = re.compile(r"^\s*\S[^.:\n]{0,60}:\s*\S{1,24}\s*$")
_BULLET = re.compile(r"^\s*(?:[*•·-]|\d+[.)])\s+(\S.*)$")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _TOKEN.findall(text)]


def _expected_language(query: str, weights: Weights) -> str | None:
    asked = list(_REQUEST.finditer(query))
    return _NAMED[asked[-1][1].lower()] if asked else language_of(_words(query), weights, _LEAD_OF_QUERY)


def _is_copy(query: str, response: str) -> bool:
    question = [w.lower() for w in _WORD.findall(_REQUEST.sub("", query))]
    whole = [w.lower() for w in _WORD.findall(query)]
    text = [w.lower() for w in _WORD.findall(_LABEL.sub("", response))]
    for asked in (question, whole):
        if len(asked) < 3 or not text:
            continue
        for times in (1, 2, 3):
            common = sum((Counter(asked * times) & Counter(text)).values())
            if common >= 0.8 * max(len(asked) * times, len(text)):
                return True
    return False


def _is_refusal(response: str) -> bool:
    sentences = [s for s in _SENTENCE.split(response) if s.strip()]
    declines = [bool(_DECLINES.search(s)) for s in sentences]
    if not any(declines[:3]):
        return False
    rest = [s for s, d in zip(sentences, declines) if not d and not _POLITE.search(s)]
    return sum(len(s.split()) for s in rest) < 4


def _ending(response: str) -> str:
    """``closed``, ``open`` or ``doubtful``: complete only as far as the text itself shows."""
    text = response.rstrip()
    if _ABBREVIATED.search(text):
        return "open"
    if _CLOSED.search(text):
        return "closed"
    lines = text.split("\n")
    last = lines[-1]
    if len(lines) > 1:
        if _TABLE_ROW.match(last) or _PAIR.match(last):
            return "closed"
        bullet = _BULLET.match(last)
        if bullet:
            items = [m[1] for m in map(_BULLET.match, lines) if m]
            usual = sorted(len(i.split()) for i in items)[len(items) // 2]
            closed_before = any(_CLOSED.search(i) for i in items[:-1])
            # one of several short items: whole if it has as many words as the others
            return "open" if closed_before or len(bullet[1].split()) < usual or bullet[1].endswith((",", "-")) else "doubtful"
    if len(text.split()) <= 3 and len(text) <= 40 and not text.endswith((",", "-", ":", ";")):
        return "doubtful"  # "Yes", "1962", "Vers 1908"
    return "open"


def judge(query: str | None, response: str | None, weights: Weights = STOP_WEIGHTS) -> tuple[str, str]:
    """The defects that the pair itself shows, joined by commas, and how the response ends."""
    query, text = query or "", (response or "").replace("\u200b", "").replace("\ufeff", "").strip()
    bare = _LABEL.sub("", _TAG.sub("", text))
    if "".join(_WORD.findall(bare)).lower() in _NOTHING or "".join(_WORD.findall(text)).lower() in _NOTHING | {"a", "answer", "antwort", "réponse", "respuesta"}:
        return "empty", "closed"
    defects, ending = [], "closed"
    if _is_copy(query, text):
        return "copy", "closed"
    if _is_refusal(text):
        defects.append("refusal")
    ending = _ending(text)
    expected = _expected_language(query, weights)
    if expected:
        scores = scores_of(_words(bare), weights)
        if scores and max(scores.values()) - scores[expected] >= _LEAD_OF_RESPONSE:
            defects.append("language")
    return ",".join(defects), ending


def goes_on(short: str, longer: str) -> bool:
    """Whether the longer text goes on inside what the short one, a prefix of it, left unfinished.

    A sentence that ended and is followed by another one was whole; so was a refusal whose longer
    version adds a polite tail, and so is an answer of up to three words ("Yes", "1962").  A list that
    goes on with a further entry was not, nor was a line.
    """
    rest = longer[len(short) :]
    if "\n" not in short and len(short.split()) <= 3 and not short.endswith((",", "-", ":", ";")):
        return False
    if _is_refusal(short) and _is_refusal(longer):
        return False
    if _CLOSED.search(short):
        # one entry of a list, or one row of a table, may end with a full stop and more follow
        line, after = short.rsplit("\n", 1)[-1], rest.lstrip("\n").split("\n", 1)[0]
        return rest.startswith("\n") and bool(_BULLET.match(line) and _BULLET.match(after))
    return True


def _shortened(distinct: DataFrame, partitions: int) -> DataFrame:
    """Hashes of responses that another response goes on from."""
    sorted_texts = distinct.select("response", "h").repartitionByRange(partitions, "response").sortWithinPartitions("response")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, first, previous = TaskContext.get().partitionId(), None, None
        for frame in frames:
            hashes = []
            for text, h in zip(frame["response"], frame["h"]):
                if previous is None:
                    first = (text, h)
                elif text != previous[0] and text.startswith(previous[0]) and goes_on(previous[0], text):
                    hashes.append(previous[1])
                previous = (text, h)
            yield pd.DataFrame([(part, "prefix", None, h) for h in hashes], columns=["part", "kind", "response", "h"])
        if previous is not None:
            yield pd.DataFrame([(part, "first", *first), (part, "last", *previous)], columns=["part", "kind", "response", "h"])

    found = cut(sorted_texts.mapInPandas(compare, "part int, kind string, response string, h bigint"))
    # the borders: two rows for each partition
    edge = found.where("kind <> 'prefix'").withColumn("next", F.lead("response").over(W.orderBy("part", "kind")))
    continued = F.udf(lambda short, longer: goes_on(short, longer), "boolean", useArrow=False)  # one row for each partition
    across = edge.where((F.col("kind") == "last") & (F.col("next") != F.col("response")) & F.col("next").startswith(F.col("response"))).where(continued("response", "next")).select("h")
    return found.where("kind = 'prefix'").select("h").unionByName(across).distinct()


def _trained(rows: DataFrame, labelled: DataFrame | None) -> Weights:
    """Weights of words of labelled texts, and of words that only queries use."""
    weights = fit_languages(labelled) if labelled is not None else {}
    if not weights:
        return STOP_WEIGHTS

    @F.pandas_udf("string")
    def answered_in(query: pd.Series, response: pd.Series) -> pd.Series:
        return pd.Series([None if not q or not r or _REQUEST.search(q) else language_of(_words(r), weights, _LEAD_OF_RESPONSE) for q, r in zip(query, response)], dtype=object)

    queries = rows.select("log_id", F.col("query").alias("text"), answered_in("query", "response").alias("lang"))
    return {**fit_languages(queries, key="log_id"), **weights}


def _judged(
    logs: DataFrame, labelled: DataFrame | None, *, log_id: str, query: str, model: str, output: str, answer: str, partitions: int | None, spike: float, least_spike: int
) -> DataFrame:
    """Each log entry with its defects and the evidence for its truncation."""
    blank = F.coalesce(F.regexp_replace(F.col(output), r"(?U)\s", ""), F.lit("")) == ""
    rows = logs.select(
        F.col(log_id).cast("bigint").alias("log_id"),
        F.col(query).cast("string").alias("query"),
        F.coalesce(F.col(model).cast("string"), F.lit("")).alias("model"),
        F.when(blank, F.col(answer)).otherwise(F.col(output)).cast("string").alias("response"),
    )

    weights = _trained(rows, labelled)

    @F.pandas_udf("defects string, ending string")
    def judged(query: pd.Series, response: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(q, r, weights) for q, r in zip(query, response)], columns=["defects", "ending"])

    rows = spread(rows).withColumn("response", F.rtrim("response")).withColumn("h", F.xxhash64("response")).withColumn("j", judged("query", "response"))
    rows = cut(rows.select("log_id", "model", "h", F.length("response").alias("size"), "response", "j.*"))
    whole = rows.where("response <> '' and defects not like '%empty%' and defects not like '%copy%'")
    if partitions is None:  # some 64 MB of text a partition
        size = rows.agg(F.sum(F.octet_length("response").cast("bigint"))).first()[0] or 0
        partitions = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // 64_000_000))
    short = _shortened(whole.select("response", "h").distinct(), partitions).withColumn("shortened", F.lit(True))
    # lengths at which unfinished responses of a model pile up, against the lengths around
    sizes = whole.where("ending <> 'closed'").groupBy("model", "size").agg(F.count("*").alias("n"))
    around = W.partitionBy("model").orderBy("size").rangeBetween(-5, 5)
    limits = sizes.withColumn("mean", (F.sum("n").over(around) - F.col("n")) / 10).where((F.col("size") > 60) & (F.col("n") >= least_spike) & (F.col("n") >= spike * F.col("mean")))
    limits = limits.select("model", "size", F.lit(True).alias("at_limit"))
    seen = rows.join(short, "h", "left").join(limits, ["model", "size"], "left")
    judgeable = ~F.col("defects").rlike("empty|copy")
    longer, limit = F.coalesce("shortened", F.lit(False)) & judgeable, F.coalesce("at_limit", F.lit(False)) & (F.col("ending") != "closed") & judgeable
    return seen.select("log_id", "defects", longer.alias("longer_neighbour"), limit.alias("length_limit"), (F.col("ending") == "open").alias("open_ending"))


def find_defects(
    logs: DataFrame,
    labelled: DataFrame | None = None,
    *,
    log_id: str = "log_id",
    query: str = "query_refined",
    model: str = "model",
    output: str = "model_output",
    answer: str = "answer",
    partitions: int | None = None,
    spike: float = 6.0,
    least_spike: int = 12,
) -> DataFrame:
    """``(log_id, defect)``: one row for each defect of each log entry.

    ``labelled``: texts with their languages (``doc_id, text, lang``), of which some 20,000 train the
    weights of words; without them lists of function words are used.
    ``spike``: a length is a limit of a model if at least ``least_spike`` unfinished responses have
    it and ``spike`` times as many as the mean of the ten lengths around.  ``partitions``: of the
    sorted responses, by default from their bytes.  Defined cases: null or blank in both response
    columns is ``empty``; a null query rules out ``copy`` and ``language``; entries logged twice are
    judged twice; repeated rows give repeated results only under different ids; further columns are
    ignored; an empty table gives an empty result.
    """
    rows = _judged(logs, labelled, log_id=log_id, query=query, model=model, output=output, answer=answer, partitions=partitions, spike=spike, least_spike=least_spike)
    cut_off = F.col("longer_neighbour") | F.col("length_limit") | F.col("open_ending")
    defects = F.array_union(
        F.filter(F.split("defects", ","), lambda d: d != ""), F.when(cut_off, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    )
    return rows.select("log_id", F.explode(defects).alias("defect")).distinct()


def truncation_evidence(
    logs: DataFrame,
    labelled: DataFrame | None = None,
    *,
    log_id: str = "log_id",
    query: str = "query_refined",
    model: str = "model",
    output: str = "model_output",
    answer: str = "answer",
    partitions: int | None = None,
    spike: float = 6.0,
    least_spike: int = 12,
) -> DataFrame:
    """``(log_id, longer_neighbour, length_limit, open_ending)`` of every truncated response of :func:`find_defects`."""
    rows = _judged(logs, labelled, log_id=log_id, query=query, model=model, output=output, answer=answer, partitions=partitions, spike=spike, least_spike=least_spike)
    return rows.where("longer_neighbour or length_limit or open_ending").select("log_id", "longer_neighbour", "length_limit", "open_ending").distinct()
