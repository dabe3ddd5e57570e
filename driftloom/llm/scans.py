"""Noise in text from scanned pages (problem 1): find it, and repair the text into paragraphs.

*Furniture* (running headers and footers, page numbers) is found per document: page marks by form
and by their sequence, headers by the title, by repetition with another number, and by the form of
periodical titles.  *Broken words* are put together if the corpus writes the whole word without a
hyphen.  *Misread words* are found by a symmetric-delete index over the corpus lexicon: words share
a key if they are equal after dropping one letter, or two that stand together, from either, or once
all confusable letters are written as one (so that several confusions in a word meet as well); a
weighted edit distance in which only known confusions of scanned letters are cheap ranks the
candidates together with their frequency and the bigrams that they form with both neighbours.

Scale: documents are read once into one row per line, written to the checkpoint folder.  Words are
counted with partial aggregation; candidates are found among distinct words by a join on keys;
occurrences meet the suspect words only, and only bigrams that a candidate can form are counted.
Sides of joins are broadcast behind a count of their rows and bytes, and shuffled beyond it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from driftloom.plans.lineage import cut
from driftloom.plans.sides import counted, shuffled
from driftloom.plans.spread import spread

# Fixed values: (true letters, letters read instead).
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("o", "0"), ("s", "5"), ("i", "!"), ("t", "f"), ("l", "1"), ("u", "ii"), ("d", "cl"), ("g", "9"), ("m", "rn"), ("b", "6"), ("h", "b"),
    ("in", "m"), ("w", "vv"), ("li", "h"), ("1", "l"), ("0", "o"), ("5", "s"), ("1", "i"), ("q", "9"), ("z", "2"), ("b", "8"), ("n", "ri"), ("nn", "rm"),
)
CONFUSION_COST = 0.25
#: Words of the longest line that is furniture as a whole.
LONGEST_FURNITURE = 16
_KNOWN = frozenset(CONFUSIONS)
_PLAIN = {read: true for true, read in CONFUSIONS if not read.isalpha()}
#: Letters that are read for one another, written as one; then pairs of letters, on those.
_ALIKE = str.maketrans({"c": "e", "@": "a", "0": "o", "5": "s", "f": "t", "l": "i", "1": "i", "!": "i", "9": "g", "q": "g", "2": "z", "b": "u", "h": "u", "6": "u", "8": "u"})
_PAIRS_ALIKE = {"rn": "m", "in": "m", "ri": "n", "ii": "u", "ei": "d", "vv": "w", "rm": "nn"}
_PAIR = re.compile("|".join(_PAIRS_ALIKE))
#: Longer words share a key if their first or last so many letters are equal.
_LONG = 40
_HALF = 20
_MARKS = "-‐‑¬\u00ad–"
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@!'’](?=[^\W_]))*")
_COMPOUND = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
#: The first half starts where a word does, so that a long run of letters is scanned once.
_BROKEN_END = re.compile(rf"(?<![^\W_])((?:[^\W_]|[@!](?=\w))+(?:[-‐‑](?:[^\W_]|[@!](?=\w))+){{0,6}})([{_MARKS}])\s*$")
_BROKEN_INSIDE = re.compile(rf"(?<![^\W_])((?:[^\W_]|[@!](?=\w))+(?:[-‐‑](?:[^\W_]|[@!](?=\w))+){{0,6}})([{_MARKS}])[ \t]+(?=[^\W_])")
_MARK_PAGE = re.compile(r"^(?:(?:page|pages|p\.|seite|s\.|página|pág\.|pagina)\s*\d{1,5}(?:\s*(?:of|von|de|sur|/)\s*\d{1,5})?|[-–—]\s*\d{1,5}\s*[-–—]|\[\s*\d{1,5}\s*\])$", re.IGNORECASE)
_ROMAN = re.compile(r"^(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.IGNORECASE)
_NUMBERS = re.compile(r"^\s*\d+(?:[.,]\d+)?(?:\s+\d+(?:[.,]\d+)?)*\s*$")
_PERIODICAL = re.compile(r"^(?:\d+\s+)?(?:notes on|papers in|bulletin of|annals of|journal of|proceedings of|transactions of|studies in|archives of|review of)\s+\S+\b", re.IGNORECASE)
_SIGN = re.compile("[" + "".join(re.escape(read) for _, read in CONFUSIONS if not read.isalpha()) + "]")
_LETTER = re.compile(r"[^\W\d_]")
_NOT_SHAPE = re.compile(r"[^a-zà-ÿ]+")
_DIGITS = re.compile(r"\d+")
#: One part of a broken word, as the patterns above have it.
_HALF_WORD = re.compile(r"(?:[^\W_]|[@!](?=\w))+")
_ANY_MARK = re.compile(f"[{_MARKS}]")
_ANY_SPACE = re.compile(r"\s{3}|\[")


def undigit(word: str) -> str:
    """Digits and signs inside a word replaced by the letters that they are read for."""
    return _SIGN.sub(lambda m: _PLAIN[m[0]], word) if _SIGN.search(word) and _LETTER.search(word) else word


def _shape(line: str) -> str:
    return _NOT_SHAPE.sub("", undigit(line.casefold()))


def furniture_lines(lines: list[str]) -> set[int]:
    """Positions of the running headers, footers and page numbers among the lines of a text."""
    bare = [line.strip() for line in lines]
    filled = [k for k, line in enumerate(bare) if line]
    if not filled:
        return set()
    found: set[int] = set()
    previous = {b: a for a, b in zip(filled, filled[1:])}
    following = {a: b for a, b in zip(filled, filled[1:])}
    # page marks by form
    # (no page mark has more than six words)
    numbers = {k: undigit_numbers(bare[k]) for k in filled if _DIGITS.search(bare[k]) and len(bare[k].split()) <= 6}
    styled = [k for k in numbers if _MARK_PAGE.match(numbers[k])]
    roman = [k for k in filled if _ROMAN.match(bare[k]) and len(bare[k]) <= 12]
    found.update(styled)
    found.update(roman)
    # bare numbers: a row of a table if the line before or after holds numbers too
    singles = [k for k, number in numbers.items() if re.fullmatch(r"\d{1,5}", number)]
    tabled = {k for k in singles if any(0 <= j < len(bare) and j not in found and bare[j] and _NUMBERS.match(bare[j]) for j in (k - 1, k + 1))}
    value = {k: int(numbers[k]) for k in singles}
    # longest run of numbers that follow one another, rather of those outside tables
    ends: dict[int, tuple[tuple[int, int], int]] = {}
    before: dict[int, int | None] = {}
    longest: tuple[tuple[int, int], int | None] = ((0, 0), None)
    for k in singles:
        (free, size), last = ends.get(value[k] - 1, ((0, 0), None))
        score = (free + (k not in tabled), size + 1)
        before[k] = last
        if value[k] not in ends or score >= ends[value[k]][0]:
            ends[value[k]] = (score, k)
        if score > longest[0]:
            longest = (score, k)
    best, k = [], longest[1]
    while k is not None:
        best.append(k)
        k = before[k]
    if len(best) >= 2 and any(k not in tabled for k in best):
        found.update(best)
    elif not styled and not roman:
        found.update(k for k in singles if k not in tabled)
    # headers
    title_at = _title_line(bare, filled, found)
    title = _shape(bare[title_at]) if title_at is not None else ""
    shape_of = {k: _shape(bare[k]) for k in filled}
    masked = Counter(_DIGITS.sub("#", bare[k].casefold()) for k in filled)
    shapes = Counter(shape_of.values())
    for k in filled:
        line = bare[k]
        if k in found or _NUMBERS.match(line):
            continue
        # only a line with brackets or a wide gap can hold a number beside a header
        numbered = None if not _ANY_SPACE.search(line) else re.match(r"^(?:\[\s*\w{1,5}\s*\]\s+)(.*)$", line) or re.match(r"^\w{1,5}\s{3,}(.*)$", line) or re.match(r"^(.*\S)\s{3,}\w{1,6}$", line)
        number = bool(numbered) and bool(re.search(r"^\W*[\dlIO]+\b|\b[\dlIO]+\W*$|^\W*[ivxlc]+\s{3}|\s{3}[ivxlc]+$", line))
        rest = _shape(numbered[1]) if numbered else shape_of[k]
        ends_sentence = line.endswith((".", ";", ",")) and not re.search(r"vol\.$", line)
        of_title = len(rest) >= 8 and bool(title) and (title.startswith(rest) or _close_prefix(rest, title))
        if number and re.match(r"^(?:\[\s*\w+\s*\]|\S.*\s{3,}\w{1,6}$|\w{1,5}\s{3,}\S)", line) and not ends_sentence and (of_title or re.match(r"^\[?\s*[\dlIO]+\s*\]?\s{3,}|.*\s{3,}[\dlIO]+$", line) or shapes[rest] > 1 or masked[re.sub(r"\d+", "#", line.casefold())] > 1):
            found.add(k)
        elif " | " in line and not ends_sentence and not line.startswith("|"):
            found.add(k)
        elif " ." in line and re.search(r"\s\.\s", line) and re.search(r"\s\.\s*[\dlIO]{1,5}$|^[\dlIO]{1,5}\s*\.\s", line):
            found.add(k)
        elif not ends_sentence and len(line) <= 120 and _PERIODICAL.match(undigit(line.casefold())) and len(line.split()) <= 14:
            found.add(k)
        elif of_title and k != title_at and not ends_sentence and len(rest) >= 12:
            found.add(k)
        elif k != title_at and not re.search(r"[a-zà-ÿ]", line) and len(re.findall(r"[A-ZÀ-Þ]", line)) >= 5 and _beside(k, previous, following, found | set(singles), title_at):
            found.add(k)
    return found


def undigit_numbers(line: str) -> str:
    """Letters read for digits put right in a line that is a page mark otherwise."""
    if not _DIGITS.search(line):
        return line
    return re.sub(r"(?<![^\W\d_])[lIO\d]+(?![^\W\d_])", lambda m: m[0].replace("l", "1").replace("I", "1").replace("O", "0") if re.search(r"\d", m[0]) else m[0], line)


def _close_prefix(short: str, title: str) -> bool:
    """A title's beginning with one or two letters misread."""
    if len(short) < 12 or len(short) > len(title) + 2:
        return False
    wrong = sum(a != b for a, b in zip(short, title))
    return wrong <= 2


def _title_line(bare: list[str], filled: list[int], found: set[int]) -> int | None:
    """The title: the first filled line, or the one after a header that repeats or numbers it."""
    first = [k for k in filled if k not in found][:4]
    if not first:
        return None
    if len(first) > 1:
        a = re.sub(r"^\[\s*\w+\s*\]\s*|^\w{1,5}\s{3,}|\s{3,}\w{1,6}$", "", bare[first[0]])
        header = a != bare[first[0]] or " | " in a or _PERIODICAL.match(undigit(a.casefold())) or not re.search(r"[a-zà-ÿ]", a) or re.search(r"\s\.\s", a)
        x, y = _shape(a), _shape(bare[first[1]])
        if header or (len(x) >= 8 and (y.startswith(x) or _close_prefix(x, y))):
            return first[1]
    return first[0]


def _beside(k: int, previous: dict, following: dict, marks: set[int], title_at: int | None) -> bool:
    """A line in capitals is a header beside a page mark, or above the title."""
    return previous.get(k) in marks or following.get(k) in marks or (title_at is not None and k < title_at)


def _spans_of(lines: list[str], source: list[str], marks: set[int]) -> list[set[int]]:
    """For each line of a cleaned text the positions of its words that are furniture of the scan,
    whose lines and furniture are given.

    A line in the form of furniture goes as a whole only if it is no longer than furniture can be:
    a cleaned text may be one line, of which only the words of the scan's furniture go.
    """
    spans: list[set[int]] = [set() for _ in lines]
    tokens = [(n, k, w) for n, line in enumerate(lines) for k, w in enumerate(line.split())]
    whole = furniture_lines(lines)
    for n in whole:
        size = len(lines[n].split())
        spans[n].update(range(size) if size <= LONGEST_FURNITURE else ())
    if not source or not tokens:
        return spans
    words = [line.split() for line in source]
    # the word of prose before and after each line
    before_of: list[str | None] = []
    after_of: list[str | None] = [None] * len(words)
    last = None
    for k, line_words in enumerate(words):
        before_of.append(last)
        if line_words and k not in marks:
            last = line_words[-1]
    last = None
    for k in range(len(words) - 1, -1, -1):
        after_of[k] = last
        if words[k] and k not in marks:
            last = words[k][0]
    at: dict[str, list[int]] = {}
    for position, (_, _, w) in enumerate(tokens):
        at.setdefault(w, []).append(position)
    used = 0
    for k in sorted(marks):
        wanted = words[k]
        if not wanted:
            continue
        before, after = before_of[k], after_of[k]
        strict = len(wanted) <= 2
        for start in at.get(wanted[0], ()):
            if start < used or [t[2] for t in tokens[start : start + len(wanted)]] != wanted:
                continue
            left = tokens[start - 1] if start else None
            right = tokens[start + len(wanted)] if start + len(wanted) < len(tokens) else None
            own_line = (left is None or left[0] != tokens[start][0]) and (right is None or right[0] != tokens[start][0])
            beside = (left is not None and left[2] == before) or (right is not None and right[2] == after)
            if strict and not own_line and not beside:
                continue
            if not strict and k == 0 and start == 0 and own_line and len(lines) > 1 and _shape(lines[0]) != _shape(source[0]):
                continue
            for n, position, _ in tokens[start : start + len(wanted)]:
                spans[n].add(position)
            used = start + len(wanted)
            break
    return spans


def _broken_of(body: list[str]) -> Iterator[tuple[int, tuple[int, int], int, tuple[int, int], str]]:
    """(line, span of the first half, line, span of the second half, mark) of words that a hyphen breaks
    at the end of a line or before a blank; lines of furniture are given as empty ones."""
    later: dict[int, int | None] = {}
    last = None
    for n in range(len(body) - 1, -1, -1):
        later[n] = last
        if body[n].strip():
            last = n
    for n, line in enumerate(body):
        if not _ANY_MARK.search(line):
            continue
        matches = [(m, n, m.end()) for m in _BROKEN_INSIDE.finditer(line)]
        end = _BROKEN_END.search(line) if line.rstrip()[-1:] in _MARKS else None
        if end and later[n] is not None:
            matches.append((end, later[n], 0))
        for m, where, offset in matches:
            second = re.match(rf"\W*?({_HALF_WORD.pattern})", body[where][offset:])
            if second:
                yield n, m.span(1), where, (offset + second.start(1), offset + second.end(1)), m[2]


def _parted_of(body: list[str], halves: dict[tuple[str, str], tuple[str, str]]) -> Iterator[tuple[int, tuple[int, int], int, tuple[int, int], str]]:
    """As :func:`_broken_of`: words that the scan broke and whose mark a cleaner took away, so that a
    blank or the end of the line is left between their halves."""
    if not halves:
        return
    heads = {a for a, _ in halves}
    last = None  # line and span of the last word, if only blanks follow it
    for n, line in enumerate(body):
        for m in _HALF_WORD.finditer(line):
            between = line[last[1][1] : m.start()] if last and last[0] == n else line[: m.start()]
            if last and not between.strip() and (head := body[last[0]][slice(*last[1])]) in heads and (head, m[0]) in halves:
                first, mark = halves[head, m[0]]
                start = last[1][1] - len(first)
                start = start if start >= 0 and body[last[0]][start : last[1][1]] == first else last[1][0]
                yield last[0], (start, last[1][1]), n, m.span(), mark
            last = (n, m.span())
        if last and last[0] == n and line[last[1][1] :].strip():
            last = None


def read_lines(text: str | None, parsed: str | None, cleaned: bool) -> Iterator[tuple]:
    """(line number, furniture, text, rest, words, broken words, compounds) of each line.

    The rest is what furniture leaves of its line, null for a line without any.

    Words are those of the running text in lower case; the halves of broken words are not among
    them.  A broken word is (first half with what is before it, second half, mark); in a cleaned text
    also one that its scan breaks and of which the cleaner left both halves without the mark.
    """
    if not text:
        return
    lines = text.split("\n")
    if cleaned:
        source = parsed.split("\n") if parsed else []
        marks = furniture_lines(source)
        spans = _spans_of(lines, source, marks)
        noise = {n for n, s in enumerate(spans) if s} | furniture_lines(lines)
        body = [" ".join(w for k, w in enumerate(line.split()) if k not in spans[n]) if spans[n] else line for n, line in enumerate(lines)]
        source = ["" if n in marks else line for n, line in enumerate(source)]
        halves_of = {}
        for n, first, where, second, mark in _broken_of(source):
            whole = source[n][slice(*first)]
            halves_of[re.split("[-‐‑]", whole)[-1], source[where][slice(*second)]] = (whole, mark)
        parted = list(_parted_of(body, halves_of))
    else:
        noise = furniture_lines(lines)
        body = ["" if n in noise else line for n, line in enumerate(lines)]
        parted = []
    skip: dict[int, set[tuple[int, int]]] = {}
    broken: dict[int, list[tuple[str, str, str]]] = {}
    for n, first, where, second, mark in [*_broken_of(body), *parted]:
        broken.setdefault(n, []).append((body[n][slice(*first)].casefold(), body[where][slice(*second)].casefold(), mark))
        skip.setdefault(n, set()).add(first)
        skip.setdefault(where, set()).add(second)
    for n, line in enumerate(lines):
        halves = {k for a, b in skip.get(n, ()) for k in range(a, b)}
        if halves:
            found = [m[0] for m in _WORD.finditer(body[n]) if m.start() not in halves and m.end() - 1 not in halves]
        else:
            found = _WORD.findall(body[n])
        words = " ".join(found).casefold().replace("’", "'").split(" ") if found else []
        compounds = [c.casefold().replace("‐", "-").replace("‑", "-") for c in _COMPOUND.findall(body[n])] if _ANY_MARK.search(body[n]) else []
        rest = (line[: len(line) - len(line.lstrip())] + body[n] if body[n] else "") if n in noise else None
        yield n + 1, n in noise, line, rest, words, broken.get(n, []), compounds


_COLUMNS = (
    ("cleaned", "boolean", pa.bool_()), ("record_id", "bigint", pa.int64()), ("line_no", "int", pa.int32()), ("furniture", "boolean", pa.bool_()), ("edge", "boolean", pa.bool_()),
    ("line", "string", pa.string()), ("rest", "string", pa.string()), ("words", "string", pa.string()), ("broken", "string", pa.string()), ("compounds", "string", pa.string()),
)
_KEY = ["cleaned", "record_id", "line_no"]
#: Signs between broken words, and between their parts; no text of one line holds them as words.
_NEXT, _PART = "\x1e", "\x1f"


def _edges(rows: list[tuple]) -> list[bool]:
    """Whether each line stands at an end of the text or beside furniture, blank lines aside."""
    filled = [k for k, row in enumerate(rows) if row[2].strip()]
    out = [False] * len(rows)
    for at, k in enumerate(filled):
        out[k] = at in (0, len(filled) - 1) or rows[filled[at - 1]][1] or rows[filled[at + 1]][1]
    return out


def scan_lines(parsed: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """One row per line of both tables, see :func:`read_lines`; words and halves as joined text."""
    rows = parsed.select(F.lit(False).alias("cleaned"), F.col("parse_id").cast("bigint").alias("record_id"), F.col("text").cast("string"), F.lit(None).cast("string").alias("source")).where("record_id is not null")
    rows = spread(rows)
    if cleaned is not None:
        sources = parsed.groupBy(F.col("parse_id").cast("bigint").alias("parse_id")).agg(F.max(F.col("text").cast("string")).alias("source"))
        own = cleaned.select(F.col("clean_id").cast("bigint").alias("record_id"), F.col("parse_id").cast("bigint").alias("parse_id"), F.col("cleaned_text").cast("string").alias("text")).where("record_id is not null")
        rows = rows.unionByName(own.join(shuffled(sources), "parse_id", "left").select(F.lit(True).alias("cleaned"), "record_id", "text", "source"))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, c[2]) for x, c in zip(zip(*out), _COLUMNS)], [c[0] for c in _COLUMNS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for is_cleaned, record, text, source in zip(*(column.to_pylist() for column in batch.columns)):
                found = list(read_lines(text, source, is_cleaned))
                edges = _edges(found) if not is_cleaned else [False] * len(found)
                for edge, (no, noise, line, rest, words, broken, compounds) in zip(edges, found):
                    out.append((is_cleaned, record, no, noise, edge, line, rest, " ".join(words), _NEXT.join(map(_PART.join, broken)), " ".join(compounds)))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return rows.where("text is not null").mapInArrow(read, ", ".join(f"{name} {kind}" for name, kind, _ in _COLUMNS))


def _words_of(column: str):
    return F.filter(F.split(column, " "), lambda w: w != "")


def lexicon_of(lines: DataFrame) -> DataFrame:
    """``(word, n)`` of the running text, written once."""
    return cut(lines.select(F.explode(_words_of("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")))


def _folded(word: str) -> str:
    """The word with letters that are read for one another written as one."""
    word = word.translate(_ALIKE)
    for _ in range(2):
        word = _PAIR.sub(lambda m: _PAIRS_ALIKE[m[0]], word)
    return word


def delete_keys(word: str) -> set[str]:
    """The word, less any letter, less any two letters that stand together; digits also as letters;
    and the word with confusable letters written as one.  Of a very long word both ends instead of
    its deletes: one change leaves one end whole."""
    keys = {"~" + _folded(word)} if len(word) > 3 else set()
    for w in {word, undigit(word)}:
        if len(w) > _LONG:
            keys.update((w, "<" + w[:_HALF], ">" + w[-_HALF:]))
            continue
        keys.add(w)
        if len(w) > 2:
            keys.update(w[:k] + w[k + 1 :] for k in range(len(w)))
        if len(w) > 4:
            keys.update(w[:k] + w[k + 2 :] for k in range(len(w) - 1))
    return keys


def scan_distance(read: str, true: str) -> float:
    """Edit distance from the true to the read word; known confusions are cheap."""
    k = 0
    while k < min(len(true), len(read)) and true[k] == read[k]:
        k += 1
    true, read = true[k:], read[k:]
    while true and read and true[-1] == read[-1]:
        true, read = true[:-1], read[:-1]
    if (true, read) in _KNOWN:
        return CONFUSION_COST
    n, m = len(true), len(read)
    if n <= 1 and m <= 1:
        return float(n or m)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            least = float("inf")
            if i:
                least = best[i - 1][j] + 1
            if j:
                least = min(least, best[i][j - 1] + 1)
            if i and j:
                least = min(least, best[i - 1][j - 1] + (true[i - 1] != read[j - 1]))
            for a, b in CONFUSIONS:
                if i >= len(a) and j >= len(b) and true[i - len(a) : i] == a and read[j - len(b) : j] == b:
                    least = min(least, best[i - len(a)][j - len(b)] + CONFUSION_COST)
            best[i][j] = least
    return best[n][m]


def confusions_between(read: str, true: str, most: int) -> int | None:
    """How many known confusions, and nothing else, make the read word of the true one; at most ``most``.

    No confusion begins with the letter that it replaces, so equal letters always match.
    """
    k = 0
    while k < min(len(true), len(read)) and true[k] == read[k]:
        k += 1
    true, read = true[k:], read[k:]
    if not true and not read:
        return 0
    if not most or not true or not read or abs(len(true) - len(read)) > most:
        return None
    found = [n + 1 for a, b in CONFUSIONS if read.startswith(b) and true.startswith(a) and (n := confusions_between(read[len(b) :], true[len(a) :], most - 1)) is not None]
    return min(found, default=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _delete_keys(word: pd.Series) -> pd.Series:
    return word.map(lambda w: sorted(delete_keys(w)))


def _scan_distance(limit: float):
    """Column function: the scan distance up to ``limit``, infinite above it."""

    @F.pandas_udf(T.DoubleType())
    def distance(read: pd.Series, true: pd.Series) -> pd.Series:
        if limit >= 1:
            return pd.Series([scan_distance(a, b) for a, b in zip(read, true)], dtype=float)
        # below 1 only confusions are cheap enough
        counts = (confusions_between(a, b, int(limit / CONFUSION_COST)) for a, b in zip(read, true))
        return pd.Series([float("inf") if n is None else n * CONFUSION_COST for n in counts], dtype=float)

    return distance


def _mixed(word):
    """Whether a word mixes letters with digits or signs other than in 1910s or 2nd."""
    return word.rlike(r"[^\W\d_]") & word.rlike(r"[\d@!]") & ~word.rlike(r"^\d+(s|er|e|ers|th|st|nd|rd|ern|a|o|bis)?$") & ~word.rlike(r"^[a-zà-ÿ]\d{1,3}$") | _year_like(word)


def _year_like(word):
    """A year with one digit read as a letter: ``l855``, ``186o``."""
    return word.rlike(r"^[il][5-9]\d{2}$|^(1[5-9]\d|20[0-2])o$|^(1[5-9]\d|20[12])s$")


def misread_words(lines: DataFrame, lexicon: DataFrame | None = None, *, ratio: float = 8.0, near_ratio: float = 3.0, limit: float = 0.8) -> DataFrame:
    """``(cleaned, record_id, line_no, word, repair)`` of every misread word occurrence.

    ``ratio``: a candidate must be so many times as frequent as the word; ``near_ratio`` where it
    also forms a known bigram with a neighbour.  A word that mixes letters and signs is misread
    even where no candidate is known (then ``repair`` only replaces the signs).
    """
    lexicon = lexicon_of(lines) if lexicon is None else lexicon
    keyed = lexicon.where(F.length("word") > 1).select("word", "n", F.explode(_delete_keys("word")).alias("key"))
    # only a frequent word can be a candidate, only one with a more frequent likeness a suspect
    true = keyed.where((F.col("n") >= 3) & ~_mixed(F.col("word"))).select("key", F.col("word").alias("true"), F.col("n").alias("true_n"))
    suspects = keyed.select("key", "word", "n").join(shuffled(true), "key").where((F.col("true_n") >= near_ratio * F.col("n")) & (F.col("word") != F.col("true")))
    # a number is no misreading of another number, a word with plain letters none of a number
    letters = r"[^\W\d_]"
    suspects = suspects.where(F.col("word").rlike(letters) & (F.col("true").rlike(letters) | _mixed(F.col("word"))))
    suspects = suspects.select("word", "n", "true", "true_n").distinct().withColumn("cost", _scan_distance(limit)("word", "true"))
    suspects = cut(suspects.where((F.col("cost") <= limit) & (F.col("cost") > 0)))
    signs = lexicon.where(_mixed(F.col("word"))).select("word", F.lit(True).alias("mixed"))
    wanted = cut(suspects.select("word").distinct().join(shuffled(signs), "word", "full"))
    near = "transform(w, (x, i) -> struct(x as word, get(w, i - 1) as left, get(w, i + 1) as right))"
    context = lines.select(*_KEY, _words_of("words").alias("w")).select(*_KEY, F.inline(F.expr(near)))
    tried = cut(context.join(counted(wanted), "word").join(counted(suspects), "word", "left"))
    # bigrams that a candidate forms with a neighbour, counted in the whole text
    formed = tried.where("true is not null and left is not null").select(F.col("left").alias("a"), F.col("true").alias("b"))
    formed = cut(formed.unionByName(tried.where("true is not null and right is not null").select(F.col("true").alias("a"), F.col("right").alias("b"))).distinct())
    pairs = "transform(slice(w, 1, greatest(size(w) - 1, 0)), (x, i) -> struct(x as a, w[i + 1] as b))"
    bigrams = lines.select(_words_of("words").alias("w")).select(F.inline(F.expr(pairs))).join(counted(formed), ["a", "b"], "left_semi")
    bigrams = counted(cut(bigrams.groupBy("a", "b").agg(F.count("*").alias("times"))))
    tried = tried.join(bigrams.select(F.col("a").alias("left"), F.col("b").alias("true"), F.col("times").alias("with_left")), ["left", "true"], "left")
    tried = tried.join(bigrams.select(F.col("a").alias("true"), F.col("b").alias("right"), F.col("times").alias("with_right")), ["true", "right"], "left")
    together = F.coalesce("with_left", F.lit(0)) + F.coalesce("with_right", F.lit(0))
    frequent = F.col("true_n") >= F.when(F.length("word") <= 3, 25 * ratio).otherwise(ratio) * F.col("n")
    known = (together > 0) & (F.length("word") > 3)
    mixed = F.coalesce("mixed", F.lit(False))
    tried = tried.withColumn("score", F.log("true_n") + 2 * F.log1p(together) - 4 * F.col("cost")).where(mixed | (F.col("true").isNotNull() & (frequent | known)))
    best = tried.groupBy(*_KEY, "word").agg(F.max_by("true", F.struct("score", "true")).alias("repair"))
    plain = F.translate("word", "0156!@9", "olsbiag")
    return best.withColumn("repair", F.when(_year_like(F.col("word")), F.translate("word", "ilos", "1105")).otherwise(F.coalesce("repair", plain)))


def broken_words(lines: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``(cleaned, record_id, line_no, first, second, mark, joined)`` of words that only the layout broke.

    What is decided depends on the halves and their mark alone: all forms of each distinct pair
    meet the counts in one join.
    """
    lexicon = lexicon_of(lines) if lexicon is None else lexicon
    part = lambda k: F.get(F.split("b", _PART), F.lit(k))
    pieces = lines.where("broken <> ''").select(*_KEY, F.explode(F.split("broken", _NEXT)).alias("b")).select(*_KEY, F.translate(part(0), "‐‑", "--").alias("first"), part(1).alias("second"), part(2).alias("mark"))
    undone = lambda c: F.when(c.rlike(r"[a-zà-ÿ]"), F.translate(c, "0156!@9", "olsbiag")).otherwise(c)
    head = F.regexp_extract("first", r"([^-‐‑]*)$", 1)
    forms = {"joined": undone(F.concat(head, "second")), "whole": undone(F.concat("first", "second")), "dashed": F.concat_ws("-", "first", "second"), "head": head, "second": F.col("second")}
    halves = pieces.select("first", "second", "mark").distinct()
    melted = halves.select("first", "second", "mark", F.explode(F.array(*(F.struct(F.lit(name).alias("form"), c.alias("word")) for name, c in forms.items()))).alias("f")).select("first", "second", "mark", "f.*")
    compounds = lines.where("compounds <> ''").select(F.explode(_words_of("compounds")).alias("word")).where("word like '%-%'").groupBy("word").agg(F.count("*").alias("n"))
    counts = lexicon.unionByName(compounds)  # words hold no hyphens
    seen = melted.join(shuffled(counts), "word", "left").groupBy("first", "second", "mark").agg(*(F.coalesce(F.max(F.when(F.col("form") == name, F.col("n"))), F.lit(0)).alias(name) for name in forms if name != "second"), F.coalesce(F.max(F.when(F.col("form") == "second", F.col("n"))), F.lit(0)).alias("second_n"))
    n = lambda name: F.col("second_n" if name == "second" else name)
    written = F.greatest(n("joined"), n("whole"))
    # neither form known: a sign that only layout uses, or a half that is no word by itself
    unknown = (written == 0) & (n("dashed") == 0) & (F.col("mark").isin("‐", "¬", "\u00ad") | (F.least(n("head"), n("second")) == 0)) & F.col("second").rlike(r"^[a-zà-ÿ]")
    digits = head.rlike(r"^\d*$") | F.col("second").rlike(r"^\d")
    layout = seen.where(~digits & ((written > n("dashed")) | ((F.col("mark") != "-") & (F.col("mark") != "–") & (written >= n("dashed")) & (written > 0)) | unknown))
    # a half that was misread is put right with the whole word
    whole = F.when(n("whole") > n("joined"), forms["whole"]).otherwise(F.concat(F.regexp_extract("first", r"^(.*?)[^-‐‑]*$", 1), forms["joined"]))
    return pieces.join(shuffled(layout.select("first", "second", "mark", whole.alias("joined"))), ["first", "second", "mark"]).select(*_KEY, "first", "second", "mark", "joined")


def _stamped(lines: DataFrame, *, share: float = 0.01, least: int = 3, words: int = 5, edge_least: int = 20) -> DataFrame:
    """The lines that hold a stamp, each with the stamp; a line that holds several comes with each."""
    own = lines.where("not cleaned")
    records = own.agg(F.count_distinct("record_id")).first()[0] or 0
    plausible = own.select("record_id", "edge", F.trim("line").alias("stamp")).where(F.col("stamp").rlike(rf"^[A-ZÀ-Þ](?:\S*\s+){{{words - 1},11}}\S*[^\s.,;:!?\d]$"))
    stamps = plausible.groupBy("stamp", "record_id").agg(F.max("edge").alias("edge")).groupBy("stamp").agg(F.count("*").alias("n"), F.count_if("edge").alias("edges"))
    stamps = stamps.where((F.col("n") >= max(least, share * records)) | ((F.col("n") >= edge_least) & (F.col("edges") * 2 >= F.col("n")))).select("stamp")
    stamps = cut(stamps.withColumn("start", F.expr(f"array_join(slice(split(stamp, '\\\\s+'), 1, {words}), ' ')")))
    # candidates share the first words with a stamp, so that this is a join on equal keys
    starts = F.array_distinct(F.regexp_extract_all("line", F.lit(rf"(?=([A-ZÀ-Þ]\S*(?:\s+\S+){{{words - 1}}}))\S+"), 1))
    candidates = lines.select(*_KEY, "line", F.explode(starts).alias("start")).withColumn("start", F.regexp_replace("start", r"\s+", " "))
    return candidates.join(counted(stamps), "start").where(F.col("line").contains(F.col("stamp"))).select(*_KEY, "stamp")


def stamped_lines(lines: DataFrame, *, share: float = 0.01, least: int = 3, words: int = 5, edge_least: int = 20) -> DataFrame:
    """Lines that hold a stamp: one line of five words or more, without a full stop, that the same
    way stands alone in at least a hundredth of all scans, or in ``edge_least`` scans, most times at
    an end of the text or beside other furniture.  In cleaned texts it may stand inside."""
    return _stamped(lines, share=share, least=least, words=words, edge_least=edge_least).select(*_KEY).distinct()


def _field():
    return F.when(F.col("cleaned"), F.lit("cleaned_text")).otherwise(F.lit("text")).alias("field_name")


def find_noise(parsed: DataFrame, cleaned: DataFrame) -> DataFrame:
    """``(record_id, field_name, line_no, kind)``: one row per noisy line and kind.

    Defined cases: null and empty texts give no rows; blank lines are counted but never noisy;
    records with a null id are left out; a cleaned text without its parsed text is judged by itself;
    repeated records count once; further columns are ignored; empty tables give an empty result.
    """
    lines = cut(scan_lines(parsed, cleaned))
    lexicon = lexicon_of(lines)
    kinds = [
        lines.where("furniture").select(*_KEY).unionByName(stamped_lines(lines)).select(*_KEY, F.lit("furniture").alias("kind")),
        broken_words(lines, lexicon).select(*_KEY, F.lit("hyphen").alias("kind")),
        misread_words(lines, lexicon).select(*_KEY, F.lit("misread").alias("kind")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct().select("record_id", _field(), "line_no", "kind")


def _without(line: str, stamps: list[str]) -> str:
    """A line without its stamps; one that is inside another goes with that."""
    for stamp in sorted(stamps, key=len, reverse=True):
        line = re.sub(rf"[^\S\n]*{r'\s+'.join(map(re.escape, stamp.split()))}", "", line)
    return line


def _like(word: str, shown: str) -> str:
    """``word`` with the case of what stands in its place."""
    return word.capitalize() if shown[:1].isupper() and shown[1:] == shown[1:].lower() else word.upper() if shown.isupper() and len(shown) > 1 else word


def _rebuild(lines: list[tuple]) -> str:
    """Paragraphs of one record from (line number, text without furniture, stamps, repairs, joins)."""
    kept = []
    for _, line, stamps, repairs, joins in sorted(lines, key=lambda x: x[0]):
        if stamps:
            line = _without(line, stamps)
            if not line.strip():
                continue
        for wrong, right in repairs or ():
            line = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda m, right=right: right.capitalize() if m[0][:1].isupper() else right, line, flags=re.IGNORECASE)
        kept.append((line.rstrip(), {(a, b): whole for a, b, whole in joins or ()}))
    out, current, gap, pending = [], "", False, {}
    for line, joins in kept:
        if not line.strip():
            gap = True
            continue
        starts = line.startswith("  ") or (gap and (not current or current.rstrip()[-1:] in ".!?:»”\"]"))
        if current and starts:
            out.append(current)
            current = ""
        gap = False
        text = line.strip()
        for (first, second), whole in joins.items():
            text = re.sub(rf"(?<!\w){re.escape(first)}[{_MARKS}]?\s+{re.escape(second)}(?!\w)", lambda m, whole=whole: _like(whole, m[0].split()[0].rstrip(_MARKS)), text, flags=re.IGNORECASE)
        begun = re.match(r"\W*?((?:[^\W_]|[@!](?=\w))+)", text)
        bare = current.rstrip(_MARKS + " ")
        halves = [(first, whole) for (first, second), whole in pending.items() if begun and second == begun[1].casefold() and bare.casefold().endswith(first)] if current else []
        if halves:  # the whole word in place of both halves
            first, whole = max(halves, key=lambda h: len(h[0]))
            current = bare[: len(bare) - len(first)] + _like(whole, bare[len(bare) - len(first) :]) + text[begun.end() :]
        elif current and current[-1:] in _MARKS and pending and begun:
            current = current[:-1] + text
        else:
            current = f"{current} {text}".strip() if not (current and current[-1:] == "-") else current + text
        tail = text.casefold().rstrip(_MARKS + " ")
        pending = {halves: whole for halves, whole in joins.items() if tail.replace("‐", "-").replace("‑", "-").endswith(halves[0])}
    if current:
        out.append(current)
    return "\n\n".join(out)


def repair_fields(parsed: DataFrame, cleaned: DataFrame | None) -> DataFrame:
    """``(field_name, record_id, text)``: the texts of both tables, named as in :func:`find_noise`,
    without furniture, stamps, broken and misread words, as paragraphs.

    Lines of furniture go; of a line that furniture or a stamp shares with other text only that
    stays.  Cases as in :func:`find_noise`; null and empty texts give no row, a text of nothing but
    furniture gives an empty one.
    """
    lines = cut(scan_lines(parsed, cleaned))
    lexicon = lexicon_of(lines)
    none = F.lit(None).cast("string")
    part = lambda df, kind, a, b=none, c=none: df.select(*_KEY, F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), c.alias("c"))
    left = lines.withColumn("left", F.coalesce("rest", "line"))
    parts = part(left.where("not furniture or left <> ''"), "line", F.col("left"))
    parts = parts.unionByName(part(lines.where("line_no = 1"), "text", none))
    parts = parts.unionByName(part(_stamped(lines), "stamp", F.col("stamp")))
    parts = parts.unionByName(part(misread_words(lines, lexicon), "repair", F.col("word"), F.col("repair")))
    parts = parts.unionByName(part(broken_words(lines, lexicon), "join", F.col("first"), F.col("second"), F.col("joined")))
    texts = parts.groupBy("cleaned", "record_id").agg(F.collect_set(F.struct("line_no", "kind", "a", "b", "c")).alias("parts"))

    def rebuild(parts) -> str:
        found: dict[int, dict[str, list]] = {}
        for x in parts:
            found.setdefault(x["line_no"], {}).setdefault(x["kind"], []).append((x["a"], x["b"], x["c"]))
        return _rebuild([(n, min(x["line"])[0], [stamp[0] for stamp in x.get("stamp", ())], sorted(r[:2] for r in x.get("repair", ())), sorted(x.get("join", ()))) for n, x in found.items() if "line" in x])

    @F.pandas_udf("string")
    def rebuilt(parts: pd.Series) -> pd.Series:
        return parts.map(rebuild)

    return texts.select(_field(), "record_id", rebuilt("parts").alias("text"))


def repair_texts(parsed: DataFrame) -> DataFrame:
    """``(parse_id, text)``: :func:`repair_fields` of parsed texts by themselves."""
    return repair_fields(parsed, None).select(F.col("record_id").alias("parse_id"), "text")
