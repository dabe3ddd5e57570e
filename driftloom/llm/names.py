"""Variant spellings of names of people and organisations (problem 5).

Merge-and-rematch resolution.  Every distinct spelling starts as a profile: family names (or the
place of an organisation), given names, initials.  Profiles that share a blocking key are compared;
a profile is merged with the others only if all profiles that it fits fit one another - an
initial that could stand for two people links neither.  Merged profiles unite their spellings and
initials, and the richer profiles enter blocking again, until no further merge occurs.

Blocking keys are symmetric deletes of the family name: the name and the name less one letter, so that
any two names one edit apart share a key; a swap in a short name is met by its sorted letters, an
edit in a very long one by its whole first or last part.  Two full given names must also share their
first letter and the second or third, so that a frequent family name is spread over its given names;
only profiles without a full given name meet a whole initial.

Scale: only distinct spellings are compared, however often each occurs.  Only profiles that changed in
the last round, or are admitted in this one, enter blocking, against all.  A key that many profiles
hold is salted.  Whether a profile is torn between two entities is seen by comparing what it fits
with the richest of these alone, so no join lists pairs of what one profile fits.  Profiles are cut
to the checkpoint folder in every round.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from driftloom.plans.lineage import cut
from driftloom.plans.sides import counted, of_rows, shuffled

# Usual short forms of given names and what they stand for.
NICKNAMES = {
    "alex": ["alexander", "alexandra"], "sasha": ["alexander", "alexandra"], "sandy": ["alexander", "alexandra"], "heidi": ["adelheid"], "bob": ["robert"], "rob": ["robert"], "bobby": ["robert"],
    "peggy": ["margaret"], "maggie": ["margaret"], "meg": ["margaret"], "greta": ["margaret"], "kit": ["christopher"], "chris": ["christopher", "christine"], "leo": ["leonard"], "len": ["leonard"], "lenny": ["leonard"],
    "ulli": ["ulrike", "ulrich"], "uli": ["ulrike", "ulrich"], "quin": ["quentin"], "gabi": ["gabriele"], "gaby": ["gabriele"], "will": ["william"], "bill": ["william"], "billy": ["william"], "liam": ["william"],
    "hannes": ["johannes"], "jo": ["johannes", "joanna"], "hans": ["johannes"], "johann": ["johannes"], "isa": ["isabella"], "bella": ["isabella"], "theo": ["theodore"], "ted": ["theodore"], "seb": ["sebastian"], "bastian": ["sebastian"],
    "nick": ["nicholas"], "nico": ["nicholas"], "klaus": ["nicholas"], "kate": ["katherine"], "kathy": ["katherine"], "katie": ["katherine"], "kat": ["katherine"], "zach": ["zacharias"], "zack": ["zacharias"],
    "fran": ["francesca"], "chicca": ["francesca"], "dora": ["dorothea"], "thea": ["dorothea"], "dorothy": ["dorothea"], "hetty": ["henrietta"], "etta": ["henrietta"], "harriet": ["henrietta"], "pippa": ["philippa"], "tavi": ["octavia"],
    "zhenya": ["yevgenia"], "eugenia": ["yevgenia"], "tina": ["valentina", "christina"], "vale": ["valentina"], "liz": ["elizabeth"], "beth": ["elizabeth"], "lisa": ["elizabeth"], "betty": ["elizabeth"], "eliza": ["elizabeth"],
    "jim": ["james"], "jack": ["john"], "dick": ["richard"], "rick": ["richard"], "tom": ["thomas"], "mike": ["michael"], "dave": ["david"], "dan": ["daniel"], "sam": ["samuel"], "tony": ["anthony"], "joe": ["joseph"], "ed": ["edward"], "ben": ["benjamin"],
}
_TYPES = {
    "academy": ("acad",), "institute": ("inst",), "university": ("univ", "uni"), "observatory": ("obs",), "laboratory": ("lab", "labs"), "department": ("dept", "dep"),
    "collaboration": ("collab", "coll"), "center": ("centre", "cent", "ctr"), "society": ("soc",), "museum": ("mus",), "college": (), "school": ("sch",), "library": ("lib",),
}
_TYPE_OF = {form: name for name, forms in _TYPES.items() for form in (name, *forms)}
_TITLES = {"dr", "prof", "professor", "phd", "msc", "bsc", "ma", "ba", "md", "jr", "sr", "ii", "iii", "mr", "mrs", "ms", "hon", "sir"}
_NOBODY = {"", "na", "nn", "unknown", "anonymous", "anon", "etal", "none", "null", "nil", "various", "author", "authors", "unbekannt", "inconnu", "anonyme", "anonym", "anonimo", "desconocido", "staff", "editor", "editors", "tba", "nan", "noauthor", "namelos", "verschiedene", "diverse"}
_SMALL = {"for", "of", "f", "the", "study", "and", "fur", "de", "des", "der"}
_DEGREE = re.compile(r"^(?:m|b)\.\s?(?:a|d)\.?$|^d\.\s?phil\.?$")
_ACRONYM = re.compile(r"^([A-Za-z]{3,6})\s*\(([^()]+)\)$")
#: Deletes are taken of names of 5 to so many letters; half as many letters at either end are the keys of longer ones.
_LONGEST = 60
_DIGITS = str.maketrans("0135", "oles")
# Letters that do not come apart into a base letter and a mark.
_FOLDED = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n"})
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
#: A record with more rounds than this would be a fault; each round merges at least one profile.
_MOST_ROUNDS = 200
#: Profiles of one blocking key that are compared in one task at most, on one side.
_BLOCK_ROWS = 2000


def _fold(name: str) -> str:
    text = unicodedata.normalize("NFKD", name)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold().translate(_FOLDED)


def _letters(word: str) -> str:
    """Letters of any script only; digits read as the letters that they resemble."""
    return _NOT_LETTER.sub("", word.translate(_DIGITS) if _LETTER.search(word) else word)


class GivenNames:
    """What is known of given names: a table of short forms and the names that they stand for."""

    def __init__(self, table: Mapping[str, Sequence[str]]):
        self.table = {_letters(_fold(short)): tuple(_letters(_fold(full)) for full in names) for short, names in table.items()}
        self.full = sorted({full for names in self.table.values() for full in names})

    def forms(self, given: str) -> set[str]:
        """A given name and all that it may stand for."""
        return {given, *self.table.get(given, ())}

    def known(self, name: str) -> bool:
        """A usual short form, or (nearly) a name that has one."""
        return name in self.table or any(near(name, full) for full in self.full)


USUAL = GivenNames(NICKNAMES)


def parse_name(name: str | None, names: GivenNames = USUAL) -> dict | None:
    """Kind, family names, given names, further initials and topic of a spelling; None for nobody."""
    if name is None:
        return None
    name = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z]\.)", " ", name) if not name.isupper() else name  # an initial glued to the given name
    text = " ".join(_fold(name).split())
    if _NOT_LETTER.sub("", text) in _NOBODY:
        return None
    acronym = _ACRONYM.match(" ".join(name.split()))
    if acronym:
        return {"kind": "org", "last": [_letters(_fold(acronym[2]))], "first": [], "more": [], "topic": _fold(acronym[1])}
    words = re.findall(r"[^\s,.:;()]+|[,.:]", text)
    plain = [w for w in words if w not in ",.:"]
    types = [k for k, w in enumerate(plain) if w in _TYPE_OF]
    if types and ({"for", "of", "f"} & set(plain) or ":" in words):
        return _organisation(text)
    return _person(text, names)


def _organisation(text: str) -> dict | None:
    head, _, tail = text.partition(":")
    if tail:  # topic: place type
        place_words, topic = tail.split(), head
    elif "," in text:  # type for topic, place
        front, _, place = text.rpartition(",")
        match = re.search(r"\b(?:for|of|f\.?)\s+(.*)$", front)
        place_words, topic = [*place.split(), *front.split()[:1]], match[1] if match else front
    else:  # place type for topic
        front, topic = re.split(r"\s(?:for|of|f\.?)\s", text, maxsplit=1) if re.search(r"\s(?:for|of|f\.?)\s", text) else (text, "")
        place_words = front.split()
    kinds = [_TYPE_OF[_letters(w)] for w in place_words if _letters(w) in _TYPE_OF]
    place = "".join(_letters(w) for w in place_words if _letters(w) not in _TYPE_OF and _letters(w) not in _SMALL)
    words = [_letters(w) for w in re.split(r"[\s]+", topic.replace(".", " ")) if _letters(w) and _letters(w) not in _SMALL]
    if not place or not kinds:
        return None
    return {"kind": "org", "last": [place], "first": [kinds[-1]], "more": [], "topic": " ".join(words)}


def _person(text: str, names: GivenNames) -> dict | None:
    text = re.sub(r"\b(ph\.\s?d|[mb]\.\s?sc)\b\.?", lambda m: _letters(m[1]), text)
    parts = [p for p in (q.strip() for q in text.split(",")) if p]
    # "M.A." behind a full name is a degree, behind a family name two initials
    whole = len(parts) > 1 and len([w for w in re.findall(r"[^\s.]+", parts[0]) if _letters(w)]) > 1
    last = len(parts) - 1
    parts = [_letters(p) if k == last and (whole or k > 1) and _DEGREE.match(p) else p for k, p in enumerate(parts)]
    parts = [p for k, p in enumerate(parts) if not k or not all(_letters(w) in _TITLES for w in p.split())]
    split = [[w for w in re.findall(r"[^\s.]+\.?", p) if _letters(w)] for p in parts]
    split = [[w for w in p if _letters(w) not in _TITLES or len(p) == 1] for p in split]
    if not split or not any(split):
        return None
    short = lambda w: len(_letters(w)) == 1
    flip = 0
    if len(split) > 1:
        last, given = split[0], [w for p in split[1:] for w in p]
    else:
        tokens = split[0]
        k = len(tokens)
        while k and short(tokens[k - 1]):
            k -= 1
        if k < len(tokens) and not short(tokens[0]):  # initials behind: family name first
            if k > 1 and len(_letters(tokens[k - 1])) > 1 and k == 2:
                last, given = tokens[:1], tokens[1:]
            else:
                last, given = tokens[:k], tokens[k:]
        else:
            given = tokens[:1]
            rest = tokens[1:]
            while rest and short(rest[0]) and len(rest) > 1:
                given.append(rest.pop(0))
            last, flip = rest, int(len(tokens) > 1 and len(given) == 1)
            if flip and names.known("".join(map(_letters, last))) and not names.known(_letters(given[0])):
                last, given, flip = given, last, 0
    family = "".join(map(_letters, last))
    if not family:
        family, given = "".join(map(_letters, given)), []
    given_letters = [_letters(w) for w in given if _letters(w)]
    return {"kind": "person", "last": [family], "first": given_letters[:1], "more": [w[0] for w in given_letters[1:]], "topic": "flip" if flip else ""}


def near(a: str, b: str, least: int = 5) -> bool:
    """Equal, or one inserted, dropped, changed or swapped letter apart; of short names only swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < least:
        return len(a) == len(b) > 2 and sum(x != y for x, y in zip(a, b)) == 2 and any(a[k] == b[k + 1] and a[k + 1] == b[k] != a[k] for k in range(len(a) - 1))
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or (len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and a[2:] == b[2:])


def _given_fit(a: str, b: str, names: GivenNames) -> bool:
    if not a or not b or len(a) == 1 or len(b) == 1:
        return not a or not b or any(x[0] == y[0] for x in names.forms(a) for y in names.forms(b))
    for x in names.forms(a):
        for y in names.forms(b):
            if near(x, y) or (min(len(x), len(y)) >= 2 and (x.startswith(y) or y.startswith(x))):
                return True
    return False


def _topics_fit(a: str, b: str, place_a: str, kind_a: str | None, kind_b: str | None) -> bool:
    x, y = a.split(), b.split()
    if kind_a and kind_b:
        return kind_a == kind_b and len(x) == len(y) and all(near(p, q) or p.startswith(q) or q.startswith(p) for p, q in zip(x, y))
    if not kind_a and not kind_b:
        return a == b
    acronym, words, kind = (a, y, kind_b) if not kind_a else (b, x, kind_a)
    return acronym == place_a[:1] + kind[:1] + "".join(w[0] for w in words)


def profiles_fit(kind: str, a_last, a_first, a_more, a_topics, b_last, b_first, b_more, b_topics, names: GivenNames = USUAL) -> bool:
    """Whether two profiles may be the same entity: every part that both have must fit."""
    if not any(near(x, y) for x in a_last for y in b_last):
        return False
    if kind == "org":
        return any(
            _topics_fit(s.partition("|")[2], t.partition("|")[2], a_last[0], s.partition("|")[0] or None, t.partition("|")[0] or None)
            for s in a_topics
            for t in b_topics
        )
    if not all(any(_given_fit(x, y, names) for y in b_first) for x in a_first if len(x) > 2) and b_first:
        return False
    if not all(any(_given_fit(x, y, names) for x in a_first) for y in b_first if len(y) > 2) and a_first:
        return False
    if a_first and b_first and not any(_given_fit(x, y, names) for x in a_first for y in b_first):
        return False
    # further initials: those of one are among those of the other
    return set(a_more) <= set(b_more) or set(b_more) <= set(a_more)


def _deletes(word: str) -> set[str]:
    """Keys of a family name: any two that are :func:`near` share one."""
    if len(word) < 5:
        return {word, "~" + "".join(sorted(word))}
    if len(word) > _LONGEST:  # one edit leaves the first or the last part whole
        half = _LONGEST // 2
        return {"<" + word[:half], ">" + word[-half:]}
    keys = {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}
    if len(word) == 5:  # near a short one only by a letter less
        keys.add("~" + "".join(sorted(word)))
    return keys if len(word) < _LONGEST else keys | {"<" + word[: _LONGEST // 2], ">" + word[-(_LONGEST // 2) :]}


def _full(first: list[str]) -> bool:
    return any(len(x) > 2 for x in first)


def _keys(kind: str, last: list[str], first: list[str], names: GivenNames = USUAL) -> list[str]:
    """Keys of a profile; those in which only poor profiles ask begin with ``i``."""
    deletes = {d for x in last for d in _deletes(x)}
    if kind == "org":
        return sorted(f"o|{d}" for d in deletes)
    forms = {y for x in first for y in names.forms(x) if y}
    keys = {f"i|{c}|{d}" for c in ({y[0] for y in forms} or {"?"}) for d in deletes}
    if _full(first):
        starts = {y[:2] for y in forms} | {y[0] + y[2] for y in forms if len(y) > 2}
        keys |= {f"f|{c}|{d}" for c in starts for d in deletes}
    return sorted(keys)


def _spellings(spellings: DataFrame, names: GivenNames) -> DataFrame:
    """One profile for each spelling that names somebody."""

    @F.pandas_udf("kind string, last string, first string, more array<string>, topic string")
    def parsed(name: pd.Series) -> pd.DataFrame:
        rows = []
        for p in (parse_name(x, names) for x in name):
            rows.append((None, None, None, [], None) if p is None else (p["kind"], p["last"][0], (p["first"] or [None])[0], p["more"], p["topic"]))
        return pd.DataFrame(rows, columns=["kind", "last", "first", "more", "topic"])

    rows = cut(spellings.withColumn("p", parsed("name")).select("name", "p.*").where("kind is not null"))
    # "Surname Given" without a comma: given names stand in front of many different family names
    flips = rows.where("kind = 'person' and topic = 'flip' and first is not null")
    leads = flips.groupBy("first").agg(F.count_distinct("last").alias("n"))
    turned = (
        flips.select("name", "first", "last")
        .join(leads.select("first", F.col("n").alias("as_first")), "first")
        .join(leads.select(F.col("first").alias("last"), F.col("n").alias("as_last")), "last", "left")
        .where(F.coalesce("as_last", F.lit(0)) > 3 * F.col("as_first") + 3)
        .select("name", F.lit(True).alias("turned"))
    )
    rows = rows.join(turned, "name", "left")
    is_turned = F.coalesce("turned", F.lit(False))
    last, first = F.when(is_turned, F.col("first")).otherwise(F.col("last")), F.when(is_turned, F.col("last")).otherwise(F.col("first"))
    as_set = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))
    person = F.col("kind") == "person"
    return rows.select(
        F.xxhash64("name").alias("id"),
        "name",
        "kind",
        as_set(last).alias("last"),
        F.when(person, as_set(first)).otherwise(F.array().cast("array<string>")).alias("first"),
        F.coalesce("more", F.array().cast("array<string>")).alias("more"),
        F.when(person, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("|", F.coalesce("first", F.lit("")), "topic"))).alias("topics"),
    )


def _block_keys(names: GivenNames):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def keys(kind: pd.Series, last: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([_keys(k, list(a), list(b), names) for k, a, b in zip(kind, last, first)])

    return keys


def _fit(names: GivenNames):
    @F.pandas_udf(T.BooleanType())
    def fit(kind: pd.Series, al: pd.Series, af: pd.Series, am: pd.Series, at: pd.Series, bl: pd.Series, bf: pd.Series, bm: pd.Series, bt: pd.Series) -> pd.Series:
        return pd.Series([profiles_fit(k, *map(list, parts), names) for k, *parts in zip(kind, al, af, am, at, bl, bf, bm, bt)], dtype=bool)

    return fit


def _richness(first, more):
    """How much a profile tells: 3 a full given name and an initial ... 0 a family name alone."""
    longest = F.coalesce(F.array_max(F.transform(first, F.length)), F.lit(0))
    return F.when(longest > 2, 2).when(longest > 0, F.lit(0)).otherwise(-1) + F.when(F.size(more) > 0, 1).otherwise(0)


def _with_richness(profiles: DataFrame) -> DataFrame:
    acronym = F.forall("topics", lambda t: t.startswith("|"))
    rich = F.when(F.col("kind") == "org", F.when(acronym, 1).otherwise(3)).otherwise(_richness(F.col("first"), F.col("more")))
    return profiles.withColumn("rich", rich)


_PARTS = ("last", "first", "more", "topics")


def _ready(profiles: DataFrame, names: GivenNames) -> DataFrame:
    """Profiles with how rich they are, whether they lack a full given name, and their keys; written."""
    poor = (F.col("kind") != "org") & ~F.exists("first", lambda x: F.length(x) > 2)
    return cut(_with_richness(profiles).withColumn("poor", poor).withColumn("keys", _block_keys(names)("kind", "last", "first")))


def _fitting(asking: DataFrame, profile: DataFrame, poor: bool, names: GivenNames) -> DataFrame:
    """``(a, b, ra, rb)``, a < b: pairs of profiles that fit, one of them among the asking ones.

    ``poor``: whether profiles without a full given name are among them.  Rows of a key that many
    ask by are spread: the asking side over parts, the other copied to each.
    """
    keys = F.col("keys") if poor else F.filter("keys", lambda x: ~x.startswith("i|"))
    keyed = lambda df: df.select(F.explode(keys).alias("key"), "id", "poor", F.struct("kind", *_PARTS, "rich").alias("p"))
    # by a whole initial only those ask that have nothing better
    left = keyed(asking).where(F.col("poor") | ~F.col("key").startswith("i|")).drop("poor")
    right = keyed(profile).select("key", F.col("id").alias("other"), F.col("p").alias("q"))
    hot = cut(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > _BLOCK_ROWS).select("key", F.ceil(F.col("n") / _BLOCK_ROWS).cast("int").alias("parts")))
    on = ["key"]
    if not hot.isEmpty():
        hot, on = counted(hot), ["key", "part"]
        left = left.join(hot, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), "parts"), F.lit(0)).cast("int")).drop("parts")
        right = right.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = left.join(shuffled(right), on).where("id <> other")
    swap = F.col("id") < F.col("other")
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.when(swap, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(swap, F.col("q")).otherwise(F.col("p")).alias("q"))
    pairs = pairs.groupBy("a", "b").agg(F.any_value("p").alias("p"), F.any_value("q").alias("q"))
    parts = [F.col(f"{side}.{c}") for side in "pq" for c in _PARTS]
    return pairs.where(_fit(names)("p.kind", *parts)).select("a", "b", F.col("p.rich").alias("ra"), F.col("q.rich").alias("rb"))


def _parents(fitting: DataFrame) -> DataFrame:
    """``(a, b)``: the profile that each free one joins, written.

    A poorer profile is free if everything that it fits fits the richest of these; of both ends the
    poorer, or later, one takes the other as parent: an order without cycles.
    """
    mirrored = fitting.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("rb").alias("ra"), F.col("ra").alias("rb"))
    directed = fitting.unionByName(mirrored).where("ra <= rb")
    n = fitting.count()
    best = directed.groupBy("a").agg(F.min_by(F.struct("b", "ra", "rb"), F.struct(-F.col("rb"), "b")).alias("best"))
    others = directed.select("a", "b").join(of_rows(best, 2 * n), "a").where("b <> best.b").select("a", F.least("b", "best.b").alias("x"), F.greatest("b", "best.b").alias("y"))
    torn = others.join(of_rows(fitting.select(F.col("a").alias("x"), F.col("b").alias("y")), n), ["x", "y"], "left_anti").select("a").distinct()
    free = best.join(of_rows(torn, n), "a", "left_anti").select("a", "best.*")
    upward = (F.col("rb") > F.col("ra")) | (F.col("b") < F.col("a"))
    oriented = free.select(F.when(upward, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(upward, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(upward, F.col("rb")).otherwise(F.col("ra")).alias("rb"))
    return cut(oriented.groupBy("a").agg(F.min_by("b", F.struct(-F.col("rb"), "b")).alias("b")))


def resolve_names(records: DataFrame, *, authors: str = "authors", nicknames: Mapping[str, Sequence[str]] = NICKNAMES) -> DataFrame:
    """``(name, entity)``: every spelling that names somebody, with the entity that it belongs to.

    Full names merge first, then names without initials, then what only initials tell, at last family
    names alone (which meet one another only); rounds go on until no further merge occurs.
    ``nicknames``: short forms of given names and the names that they stand for.

    Defined cases: null and empty arrays, null elements and placeholders (dashes, "unknown", "et
    al.", ...) name nobody and are left out; letters of any script name somebody; repeated names count
    once; a very long name is one spelling like any other; further columns are ignored; an empty
    table gives an empty result.
    """
    names = GivenNames(nicknames)
    spellings = records.select(F.explode(authors).alias("name")).where("name is not null").distinct()
    # spellings with a full given name that read the same are one profile from the start
    alone = F.when(F.col("rich") < 2, F.col("name"))
    read = _with_richness(_spellings(spellings, names)).groupBy("kind", *_PARTS, alone.alias("alone"))
    profile = _ready(read.agg(F.min("id").alias("id"), F.collect_list("name").alias("members")).drop("alone").withColumn("fresh", F.lit(True)), names)
    fitting, labels = None, None
    for turn in range(_MOST_ROUNDS + 1):
        least, before = max(-1, 3 - turn), max(-1, 4 - turn)
        # who was changed by the last round, or is admitted by this one, is compared with all
        present = profile.where(F.col("rich") >= least)
        found = _fitting(present.where(F.col("fresh") | (F.col("rich") < before)), present, least < 2, names)
        if fitting is not None:  # what was found before and has not changed since still stands
            changed = of_rows(labels.select(F.explode(F.array("id", "label")).alias("a")).distinct(), 2 * merges) if labels is not None else None
            kept = fitting if labels is None else fitting.join(changed, "a", "left_anti").join(changed.withColumnRenamed("a", "b"), "b", "left_anti")
            found = found.unionByName(kept)
        fitting = cut(found)
        parents = _parents(fitting)
        merges = parents.count()
        if not merges:
            if least == -1:
                break
            labels, profile = None, profile.withColumn("fresh", F.lit(False))
            continue
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("c"))
        labels = parents.join(of_rows(above, merges), "b", "left").select(F.col("a").alias("id"), F.coalesce("c", "b").alias("label"))
        union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
        merged = profile.drop("rich", "poor", "keys", "fresh").join(of_rows(labels, merges), "id", "left").groupBy(F.coalesce("label", "id").alias("id")).agg(
            F.first("kind").alias("kind"), *(union(c).alias(c) for c in (*_PARTS, "members")), (F.count("*") > 1).alias("fresh")
        )
        profile = _ready(merged, names)
    else:
        raise RuntimeError(f"names still merge after {_MOST_ROUNDS} rounds")
    return profile.select(F.explode("members").alias("name"), F.col("id").alias("entity"))


def linked_spellings(resolved: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, name_a < name_b by code point: two spellings of the same entity."""
    a, b = resolved.withColumnRenamed("name", "name_a"), resolved.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
