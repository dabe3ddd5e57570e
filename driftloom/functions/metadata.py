"""Metadata fields read from titles, file names, dates and page texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftloom.functions.text import SPACE, TITLE, strip, substitute

#: The current year is fixed, so that results do not change with the calendar.
CURRENT_YEAR = 2025
# Frequent words that tell German from English.
GERMAN = "der|die|das|und|ist|nicht|mit|den|von|ein|eine|für|auf|sich|als|wird|werden|noch|seit"
ENGLISH = "the|and|of|is|to|in|that|with|for|as|was|are|on|by|its|than|this|these"


def strict_years(text: Column) -> Column:
    """Distinct four-digit numbers 19xx and 20xx that stand alone, in order."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(runs, lambda r: r.rlike("^(?:19|20)[0-9]{2}$")), lambda r: r.cast("int")))


def valid_year(year: Column) -> Column:
    return F.when(year.between(1800, CURRENT_YEAR + 1), year)


def date_year(date: Column) -> Column:
    """Year of ``D:YYYY...``, of an ISO date, or the first strict year."""
    compact = F.regexp_extract(date, r"^D:([0-9]{4})", 1)
    iso = F.regexp_extract(date, r"^([0-9]{4})(?:-[0-9]{2})?(?:-[0-9]{2})?", 1)
    year = lambda c: F.when(c != "", c.cast("int"))
    return F.coalesce(year(compact), year(iso), F.get(strict_years(date), F.lit(0)))


def arxiv_year(text: Column, pivot: int = 25) -> Column:
    """Year of an identifier like 0704.1234 or hep-th/9901001; two digits from ``pivot`` on are 19xx."""
    new = F.regexp_extract(F.lower(text), r"arxiv:[ \t]*([0-9]{2})[0-9]{2}\.[0-9]{4,5}", 1)
    old = F.regexp_extract(F.lower(text), r"[a-z\-]+/([0-9]{2})[0-9]{5}", 1)
    two = F.when(new != "", new).when(old != "", old).cast("int")
    return F.when(two < pivot, 2000 + two).otherwise(1900 + two)


def filename_year(name: Column) -> Column:
    """Latest strict year of a file name without its version mark."""
    return F.array_max(strict_years(F.regexp_replace(name, r"(?i)v[0-9]+(?:\.[a-z]+)?$", "")))


def context_year(text: Column) -> Column:
    """Latest year that follows a word for publication."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?:published online|published|accepted|received|copyright|©)[^0-9\n]{{0,20}}([0-9]{{4}})(?![0-9])"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1800, CURRENT_YEAR + 1)))


def best_year(*candidates: tuple[int, int, Column]) -> Column:
    """Of (priority, score, year) the first by least priority, greatest score, latest year."""
    structs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(-s).alias("s"), (-valid_year(y)).alias("y")) for p, s, y in candidates))
    return -F.array_min(F.filter(structs, lambda x: x["y"].isNotNull()))["y"]


def normal_title(title: Column) -> Column:
    return strip(substitute(F.coalesce(title, F.lit("")), TITLE))


def title_valid(title: Column) -> Column:
    """At least ten characters, 3 to 30 words, not only a number, no identifier or version."""
    t = F.coalesce(title, F.lit(""))
    words = F.size(F.filter(F.split(strip(t), rf"{SPACE}+"), lambda w: w != ""))
    return (F.length(strip(t)) >= 10) & words.between(3, 30) & ~t.rlike(r"^[0-9 .]+$") & ~F.lower(t).rlike(r"arxiv|doi:|10\.[0-9]{4}") & ~t.rlike(r"(?i)(?:^|[^a-z0-9])v[0-9]+(?:[^a-z0-9]|$)")


def detect_language(text: Column, least: int = 30) -> Column:
    """``de`` or ``en`` by the number of frequent words; null for short texts and ties."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit(rf"(?:^|[^a-zà-ÿ])(?:{words})(?=[^a-zà-ÿ]|$)"))
    de, en = count(GERMAN), count(ENGLISH)
    return F.when(F.length(text) < least, None).when(de > en, "de").when(en > de, "en")


def person_like(name: Column, longest: int = 80) -> Column:
    """Two to five words, each with a capital first, without digits or words of institutions."""
    words = F.filter(F.split(strip(F.coalesce(name, F.lit(""))), rf"{SPACE}+"), lambda w: w != "")
    stops = F.array(*map(F.lit, ("university", "institute", "department", "laboratory", "faculty", "school", "academy", "observatory", "collaboration", "of", "for", "the")))
    return (
        F.size(words).between(2, 5)
        & (F.length(name) <= longest)
        & ~name.rlike("[0-9@]")
        & F.forall(words, lambda w: w.rlike("^[A-ZÀ-Þ]"))
        & ~F.arrays_overlap(F.transform(words, lambda w: F.lower(w)), stops)
    )


def year_refined(stored: Column, text: Column, far: int = 10) -> Column:
    """A stored year checked against the text: a year of publication there comes first, else the latest
    year of the text if it is ``far`` or more away, else the stored one."""
    plain = F.array_max(F.filter(strict_years(text), lambda y: valid_year(y).isNotNull()))
    known = valid_year(stored)
    return F.coalesce(context_year(F.coalesce(text, F.lit(""))), F.when(known.isNull() | (F.abs(plain - known) >= far), plain), known)


def page_year(pages: Column, first: int = 3) -> Column:
    """``(year, score)`` of the first pages: the first page with a year of publication, at 95 less the
    page's number; else the best of the latest plain years, at 45 and more the earlier the page."""
    cut = F.slice(pages, 1, first)
    none = F.lit(None).cast("int")
    stated = F.transform(cut, lambda p, i: F.struct((F.lit(95) - i).alias("score"), context_year(p).alias("year")))
    plain = F.transform(cut, lambda p, i: F.struct((F.lit(45 + first) - i).alias("score"), F.array_max(F.filter(strict_years(p), lambda y: valid_year(y).isNotNull())).alias("year")))
    best = F.coalesce(F.get(F.filter(stated, lambda x: x["year"].isNotNull()), F.lit(0)), F.array_max(F.filter(plain, lambda x: x["year"].isNotNull())))
    return F.struct(F.coalesce(best["year"], none).alias("year"), best["score"].alias("score"))


def best_date(*dates: tuple[int, Column]) -> Column:
    """Year of the best of (score, date) that has a valid one."""
    years = F.array(*(F.struct(F.lit(score).alias("s"), valid_year(date_year(date)).alias("y")) for score, date in dates))
    return F.array_max(F.filter(years, lambda x: x["y"].isNotNull()))["y"]


def doi_of(text: Column) -> Column:
    """The first DOI, without the marks of the sentence around it."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,)]+$", ""), F.lit(""))


def arxiv_of(text: Column) -> Column:
    """The first arXiv identifier, new or old, that is named as one."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\barxiv[:/ ][ ]?([0-9]{4}\.[0-9]{4,5}|[a-z\-]+/[0-9]{7})", 1), F.lit(""))


def lines_with_text(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


def author_block(text: Column) -> Column:
    """Whether a line names authors or where they work rather than a title."""
    return text.rlike(r"(?i)\b(?:university|dept|department|institute|school|college|laboratory|lab|affiliat|authors?)\b") | text.rlike(r"^[A-Z][a-z]+(?: [A-Z][a-z]+)+,? (?:and|&) [A-Z][a-z]+")


def first_line_title(text: Column) -> Column:
    """The first line of a text that can be a title."""
    return F.get(F.filter(lines_with_text(text), lambda x: title_valid(normal_title(x)) & ~author_block(x) & ~x.rlike("(?i)abstract|introduction|contents")), F.lit(0))


def layout_title(spans: Column, top: int = 3) -> Column:
    """Title from a first page's ``array<struct<size, y0, text>>``: the largest and highest spans joined;
    the next ones where these name authors."""
    filled = F.filter(spans, lambda x: strip(x["text"]) != "")
    placed = F.transform(F.array_sort(F.transform(filled, lambda x, i: F.struct((-x["size"]).alias("a"), x["y0"].alias("b"), i.alias("i"), strip(x["text"]).alias("t")))), lambda x: x["t"])
    joined = lambda at: normal_title(F.array_join(F.slice(placed, at, top), " "))
    first, second = joined(1), joined(1 + top)
    usable = lambda c: F.when(title_valid(c) & ~author_block(c), c)
    return F.when(author_block(first), usable(second)).otherwise(usable(first))


def best_title(stored: Column, tei: Column, layout: Column) -> Column:
    """The first valid title of the file's own metadata, its sidecar and its first page."""
    valid = lambda c: F.when(title_valid(normal_title(c)), normal_title(c))
    return F.coalesce(valid(stored), valid(tei), valid(layout))


# Words that no name of a person holds, and those taken out of names.
NOT_NAMES = "abstract introduction university department institute arxiv model learning probability appendix keywords ai neural transformer algorithm vol intelligence computing zentrum sciences centre center".split()
AFFILIATION = r"(?i)\b(?:google|inc\.?|university|institute|labs?|dept\.?|center|centre|zentrum|sciences?)\b"


def name_like(name: Column) -> Column:
    """One to five words, the first with a capital, no digits, none of :data:`NOT_NAMES`."""
    words = F.filter(F.split(strip(F.coalesce(name, F.lit(""))), rf"{SPACE}+"), lambda w: w != "")
    return F.size(words).between(1, 5) & name.rlike("^[A-ZÀ-Þ]") & ~name.rlike("[0-9]") & ~F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, NOT_NAMES)))


def normal_author(name: Column) -> Column:
    """Without footnote signs and words of institutions, single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[•†]", ""), AFFILIATION, ""), rf"{SPACE}+", " "))


def names_in_text(text: Column) -> Column:
    """Runs of two to four capitalised words before the abstract: a rule in place of a name recogniser."""
    head = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)Abstract.*", "")
    runs = F.regexp_extract_all(head, F.lit(r"(?:^|[^A-Za-zÀ-ÿ.])([A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ]\.)?(?: [A-ZÀ-Þ][a-zà-ÿ]+){1,2})"), F.lit(1))
    return F.filter(runs, name_like)


def best_authors(*sources: Column) -> Column:
    """Of the first source that names anybody: normalised, verified, each once, in order."""
    chosen = F.coalesce(*(F.when(F.size(F.filter(a, lambda x: strip(F.coalesce(x, F.lit(""))) != "")) > 0, a) for a in sources), F.array().cast("array<string>"))
    clean = F.filter(F.transform(F.filter(chosen, lambda x: x.isNotNull()), normal_author), lambda x: (x != "") & person_like(x))
    return F.array_distinct(clean)


CONTENTS_HEADING = r"(?i)(?:inhalt|contents)"
CONTENTS_ENTRY = r"^(?:[0-9]{0,2}\.?)*[ \t]*[A-ZÄÖÜa-zäöü].{3,}[ \t]+[0-9]{1,3}$"


def textual_contents(text: Column) -> Column:
    """Contents entries ``(level, title, page)`` that stand in a text with a heading of contents."""
    listed = F.filter(lines_with_text(text), lambda x: x.rlike(CONTENTS_ENTRY) & x.rlike(r"[ \t]{2,}[^ \t]+$"))
    number = lambda x: F.regexp_extract(x, "^([0-9]+(?:[.][0-9]+)*)", 1)
    title = lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}[^ \t]*$", ""), r"^[0-9]+(?:\.[0-9]+)*\.?[ \t]*", ""))
    entry = lambda x: F.struct((F.length(F.regexp_replace(number(x), "[^.]", "")) + 1).alias("level"), title(x).alias("title"), F.regexp_extract(x, "([0-9]+)$", 1).try_cast("int").alias("page"))
    return F.when(text.rlike(CONTENTS_HEADING), F.transform(listed, entry)).otherwise(F.array().cast("array<struct<level:int,title:string,page:int>>"))
