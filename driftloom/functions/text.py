"""Text cleaning as column expressions.

A cleaner is a list of substitutions ``(pattern, replacement)`` applied in order, or a function from
column to column where lines are judged one by one.  All run inside the JVM.  Patterns use explicit
character classes, so that they mean the same in every regex dialect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

Step = tuple[str, str]

BLANK = r"[ \t\r\x0B\f]"
SPACE = r"[ \t\r\n\x0B\f]"

# What the cleaning chain removes, in its order.
UNICODE_SPACES: list[Step] = [("[\u00a0\u2000-\u200b]+", " ")]
SOFT_HYPHENS: list[Step] = [("\u00ad", ""), (r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")]
LINE_JOIN: list[Step] = [(rf"([^ \t\r\n\x0B\f])\n([^ \t\r\n\x0B\f])", "$1 $2"), (r"\n{3,}", "\n\n")]
TRAILING_SPACE: list[Step] = [(rf"{BLANK}+\n", "\n"), (rf"{BLANK}+$", ""), (r"\n{3,}", "\n\n")]
HTML: list[Step] = [(r"<[^\n>]*>", ""), (r"&[A-Za-z]+;", "")]
SCIENCE: list[Step] = [(rf"\b(?:Eq|Theorem|Lemma){SPACE}+[0-9]+\b", "")]
CITATIONS: list[Step] = [
    (rf"\([A-Z][A-Za-z\-]+(?:,?{SPACE}(?:[A-Z]\.)+)*(?:{SPACE}&{SPACE}[A-Z][A-Za-z\-]+)*,{SPACE}?[0-9]{{4}}[a-z]?\)", ""),
    (rf"\([A-Z][A-Za-z\-]+{SPACE}+et{SPACE}+al\.,{SPACE}*[0-9]{{4}}[a-z]?\)", ""),
    (rf"\[{SPACE}?[0-9]+(?:[\-,–]{SPACE}?[0-9]+)*(?:{SPACE}*,{SPACE}*[0-9]+)*{SPACE}?\]", ""),
    (rf"\({SPACE}?[0-9]{{4}}[a-z]?{SPACE}?\)", ""),
    (rf"(?i)\bdoi:{SPACE}*[^ \t\r\n\x0B\f]+", ""),
    (rf"(?i)\barxiv:{SPACE}*[^ \t\r\n\x0B\f]+", ""),
    (r"(?i)\b(?:Proc\.|Proceedings|Conf\.|Conference|JMLR|ICML|NeurIPS|NIPS|AAAI|IJCAI|ACL|EMNLP|COLING|IEEE|ACM)\b[^\n]*?[0-9]{4}", ""),
    (rf"\[[A-Z][A-Za-z\-]+(?:{SPACE}+et{SPACE}+al\.)?,?{SPACE}*[0-9]{{4}}[a-z]?\]", ""),
    (rf"(?i)\bin{SPACE}+proceedings{SPACE}+of\b[^.\n]*([.\n])", "$1"),
    (rf"{SPACE}{{2,}}", " "),
    (rf"{SPACE}+([.,;:])", "$1"),
]
OVER_TIME: list[Step] = [(rf"(?i)(\bover time\b){SPACE}*[,.]?{SPACE}*\bover time\b", "$1")]
TITLE: list[Step] = [(rf"-{SPACE}+", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("_", " "), (r"(?i)arxiv:[0-9]{4}\.[0-9]{4,5}", ""), (r"\bv[0-9]+\b", ""), (rf"{SPACE}+", " ")]
SCRUB: list[Step] = [
    (r"(?i)\b(?:https?://|www\.)[^ \t\r\n\x0B\f<>]+", "<URL>"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"\+?[0-9]{1,3}[ \-][0-9]{3,4}[ \-][0-9]{4,}", "<PHONE>"),
    ("[$€£¥]", "<CUR>"),
]
#: From here on a text is back matter, wherever the word stands.
BACK_MATTER: list[Step] = [(r"(?is)(?:references|bibliography|literaturverzeichnis|acknowledge?ments|appendix).*", "")]
LINK_LINES: list[Step] = [(r"(?im)^[ \t]*(?:doi|arxiv|http|https)[: \t][^\n]*$", "")]
#: Lines that a page layout leaves: dropped alone, or only where short.
CONTENTS_LINE = rf"(?i)^{SPACE}*(?:table{SPACE}+of{SPACE}+contents|inhaltsverzeichnis|contents){SPACE}*$"
LAYOUT_LINE = (
    rf"(?i)^{SPACE}*(?:page{SPACE}+[0-9]+|p\.?{SPACE}*[0-9]+|[0-9]+){SPACE}*$"
    rf"|(?i)^{SPACE}*(?:funded{SPACE}+by|supported{SPACE}+by|this{SPACE}+preprint{SPACE}+|arxiv:{SPACE}*[0-9]{{4}}\.[0-9]{{4,5}})[^\n]*$"
    rf"|(?i)^{SPACE}*doi:{SPACE}*10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+$"
)
SHORT_LINE = 80
#: Blocks of a page that name these are no body text.
BLOCK_WORDS = "title|author|doi|keywords|arxiv|university|faculty|institute|version"
REFERENCES_LINE = r"(?i)(?:^|\n)[ \t]*(?:references|bibliography|literaturverzeichnis)[ \t]*(?:\n|$)"


def substitute(text: Column, steps: Sequence[Step]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def drop_layout_lines(text: Column) -> Column:
    """Without lone contents headings, and short page numbers, funding and preprint notices."""

    def keep(line: Column) -> Column:
        return ~line.rlike(CONTENTS_LINE) & ~((F.length(strip(line)) <= SHORT_LINE) & line.rlike(LAYOUT_LINE))

    trimmed = F.transform(lines_of(text), lambda line: F.regexp_replace(line, rf"{SPACE}+$", ""))
    return strip(F.array_join(F.filter(trimmed, keep), "\n"))


def drop_noise_lines(text: Column, digits: float = 0.3, signs: float = 0.4) -> Column:
    """Without blank lines and lines of numbers, signs, citations or tables."""

    def keep(line: Column) -> Column:
        size = F.greatest(F.length(line), F.lit(1))
        figure = F.length(F.regexp_replace(line, r"[^0-9]", "")) / size
        sign = F.length(F.regexp_replace(line, rf"(?U)[\p{{L}}\p{{N}}]|{SPACE}", "")) / size
        return (line != "") & (figure <= digits) & (sign <= signs) & ~line.rlike(rf"^\[[0-9]+\]{SPACE}*[A-Z][a-z]+") & ~line.rlike(rf"(?i)^table{SPACE}+[0-9]+")

    return F.array_join(F.filter(F.transform(lines_of(text), strip), keep), "\n")


def cut_references(text: Column, least_share: float = 0.2) -> Column:
    """Cut at the first line that only names the references, unless it stands too near the start."""
    found = F.regexp_instr(text, F.lit(REFERENCES_LINE))
    at = F.when(F.substring(text, found, F.lit(1)) == "\n", found).otherwise(found - 1)
    return strip(F.when((found > 0) & (at > F.length(text) * least_share), F.substring(text, F.lit(1), at)).otherwise(text))


def by(*steps: Step, trim: bool = False) -> Callable[[Column], Column]:
    return (lambda text: strip(substitute(text, steps))) if trim else (lambda text: substitute(text, steps))


#: The cleaners by name, in the order of the chain.
CLEANERS: dict[str, Callable[[Column], Column]] = {
    "unicode_spaces": by(*UNICODE_SPACES),
    "soft_hyphens": by(*SOFT_HYPHENS),
    "layout_lines": drop_layout_lines,
    "line_join": by(*LINE_JOIN, trim=True),
    "trailing_space": by(*TRAILING_SPACE, trim=True),
    "html": by(*HTML),
    "science": by(*SCIENCE),
    "citations": by(*CITATIONS, trim=True),
    "references": cut_references,
    "deep": lambda text: strip(substitute(drop_noise_lines(substitute(text, [*SCRUB, *BACK_MATTER, *LINK_LINES])), [(r"\n{3,}", "\n\n")])),
}


def clean_text(text: Column, steps: Sequence[str] = tuple(CLEANERS)) -> Column:
    """The cleaning chain; null becomes empty.  Steps can be chosen by name.

    Each step works on a bound variable: a step that names its text several times would otherwise
    have all steps before it computed as often.
    """
    text = F.coalesce(text, F.lit(""))
    for name in steps:
        text = F.get(F.transform(F.array(text), CLEANERS[name]), F.lit(0))
    return text


def sanitise_id(text: Column, size: int = 80) -> Column:
    """Letters, digits, ``-`` and ``_`` kept, all else ``_``; cut; ``query`` for nothing."""
    clean = F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\-]", "_"), 1, size)
    return F.when(clean == "", F.lit("query")).otherwise(clean)


#: What a parser leaves of metadata at the top of a text; each within its line.
RESIDUAL: list[Step] = [
    (r"(?im)^[ \t]*(?:table[ \t]+of[ \t]+contents|inhaltsverzeichnis)\b[^\n]*$", ""),
    (r"(?im)^[ \t]*(?:title|author|authors|keywords)[ \t]*:[^\n]*$", ""),
    (r"(?im)^[^\n]*\b(?:university|faculty|institute)\b[^\n]*@[^\n]*$", ""),
    (r"(?im)^[ \t]*(?:doi[ \t]*:|https?://doi\.org/)[^\n]*$", ""),
    (r"(?im)^[ \t]*arxiv[ \t]*:[^\n]*$", ""),
    (r"\n{3,}", "\n\n"),
]


def remove_residual_metadata(text: Column) -> Column:
    """Without lines of contents headings, labelled titles and authors, addresses and identifiers."""
    return strip(substitute(F.coalesce(text, F.lit("")), RESIDUAL))


def relevance_of(judgement: Column) -> Column:
    """Relevance 0..3 that a judge wrote: in (fenced) JSON, else its first digit 0-3 that stands alone; 0 for none."""
    plain = strip(F.regexp_replace(F.coalesce(judgement, F.lit("")), "(?i)```(?:json)?", ""))
    stated = F.get_json_object(plain, "$.relevance").try_cast("int")
    alone = F.regexp_extract(plain, "(?:^|[^0-9])([0-3])(?:[^0-9]|$)", 1).try_cast("int")
    return F.coalesce(F.when(stated.between(0, 3), stated), alone, F.lit(0))


def clean_query(text: Column) -> Column:
    """Lower case, single blanks; null where nothing is left."""
    plain = strip(F.regexp_replace(F.lower(text), rf"{SPACE}+", " "))
    return F.when(plain != "", plain)


def query_decades(text: Column, low: int = 1900, high: int = 2100) -> Column:
    """Starts of the decades that a query names by year, decade or century, ascending."""
    lowered = F.lower(text)
    tokens = F.regexp_extract_all(lowered, F.lit(r"[0-9a-z_]+"), F.lit(0))
    years = F.transform(F.filter(tokens, lambda t: t.rlike(r"^(?:19|20)[0-9][0-9]$") | t.rlike(r"^(?:19|20)[0-9]0s$")), lambda t: F.substring(t, 1, 4).cast("int"))
    none = F.array().cast("array<int>")
    old = F.when(lowered.contains("20th century"), F.sequence(F.lit(1900), F.lit(1990), F.lit(10))).otherwise(none)
    new = F.when(lowered.contains("21st century"), F.sequence(F.lit(2000), F.lit(2090), F.lit(10))).otherwise(none)
    named = F.filter(years, lambda y: (y >= low) & (y <= high))
    decades = F.transform(F.concat(named, old, new), lambda y: (F.floor(y / 10) * 10).cast("int"))
    return F.array_sort(F.array_distinct(F.coalesce(decades, none)))


def stable_chunk_id(source: Column, year: Column, text: Column) -> Column:
    """``source::year::`` and twelve digits of the SHA-1 of the first 200 characters."""
    part = F.substring(F.sha1(F.substring(F.coalesce(text, F.lit("")), 1, 200).cast("binary")), 1, 12)
    return F.concat_ws("::", F.coalesce(source, F.lit("unknown")), F.coalesce(year.cast("string"), F.lit("n.d.")), part)


def claims_of(answer: Column, least_words: int = 3) -> Column:
    """Sentences with at least three words."""
    words = lambda s: F.size(F.filter(F.split(s, rf"{SPACE}+"), lambda w: w != ""))
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), rf"[.!?]{SPACE}+"), strip), lambda s: words(s) >= least_words)


def specificity(claim: Column) -> Column:
    """Numbers and capitalised words for each word (five words at least)."""
    hits = F.regexp_count(claim, F.lit("[0-9]+")) + F.regexp_count(claim, F.lit("[A-Z][a-z]+"))
    words = F.size(F.filter(F.split(claim, rf"{SPACE}+"), lambda w: w != ""))
    return hits / F.greatest(words, F.lit(5))


#: What is asked of a query by its intent; an unknown one counts as conceptual.
WORDING = {"chronological": "How did this develop over time, in order of years: ", "analytical": "What explains this, and what speaks for it over time: ", "comparative": "How do the views of this differ over time: "}


def reformulate(query: Column, intent: Column) -> Column:
    """The query worded for its intent, without saying "over time" twice."""
    lead = F.lit("What is meant by this over time: ")
    for name, words in WORDING.items():
        lead = F.when(intent == name, F.lit(words)).otherwise(lead)
    return substitute(F.concat(lead, query), OVER_TIME)
