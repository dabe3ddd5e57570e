"""Held-out test passages inside training documents (problem 6).

Pigeonhole edit matching, on words.  The smallest reportable stretch of an item has a share of its
words; single changed or dropped words lie at least ``gap`` words apart, which gives the stretch an
error budget of its own.  The item is cut into disjoint pieces so short that every such stretch
holds budget-plus-one whole pieces: one of them must stand in the document unchanged.  A piece hit
is grown to the longest stretch around it whose errors keep their distance; if that is long enough,
Myers' bit-parallel edit distance decides: the stretch counts only within its own error budget.

Letter case, punctuation, white space, markup, soft hyphens and character forms (compatibility
forms, ligatures, accents) are removed before words are compared.

Scale: the documents are read once and never shuffled.  The items' pieces are broadcast in blocks of
at most ``block_chars`` characters of passages; only beyond that bound a further scan follows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.plans.spread import spread

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[A-Za-z]{2,8}|#\d{1,6}|#x[0-9A-Fa-f]{1,6});")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_ACCENT = re.compile("[\u0300-\u036f]+")
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(1_000_003)


def _tag(match: re.Match) -> str:
    found = match[0]
    return html.unescape(found) if found[0] == "&" else ""


def words_of(text: str | None) -> list[str]:
    """Comparable words of a text; none for null."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(_tag, text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKD", text)
        text = _ACCENT.sub("", text)
        if not text.isascii() and any(map(unicodedata.combining, set(text))):
            text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


def myers_distance(a: list, b: list) -> int:
    """Edit distance of two sequences by Myers' bit-vector recurrence (Python integers as words)."""
    if not a or not b:
        return len(a) + len(b)
    peq: dict = {}
    for k, x in enumerate(a):
        peq[x] = peq.get(x, 0) | (1 << k)
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for y in b:
        eq = peq.get(y, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return score


def budget_of(words: int, gap: int) -> int:
    """Most single changed or dropped words, ``gap`` apart and none at an end, in so many words."""
    return (words - 3) // gap + 1 if words >= 3 else 0


def piece_size(least: int, gap: int) -> int:
    """Words of a piece: every stretch of ``least`` words holds budget-plus-one whole pieces."""
    return max(1, (least + 1) // (budget_of(least, gap) + 2))


#: How one changed, dropped or added word may shift item and document: words skipped on either side
#: (a changed word may have been written as two or three, or the other way round).
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 1), (1, 2), (2, 2), (3, 1), (1, 3))


def _grow(item: list, doc: list, i: int, j: int, step: int, run: int, gap: int) -> tuple[int, int, int | None]:
    """Ends (exclusive, in walking direction) of the stretch grown from ``i, j``, and how many words
    match before its first error (None without any).

    ``run``: matching words behind the start, up to the last error there.
    """
    n, m, first = len(item), len(doc), None

    def matched(i: int, j: int) -> int:
        k = 0
        while 0 <= i < n and 0 <= j < m and item[i] == doc[j]:
            k, i, j = k + 1, i + step, j + step
        return k

    k = matched(i, j)
    i, j, run, before = i + k * step, j + k * step, run + k, k
    while 0 <= i < n and 0 <= j < m and run >= gap - 1:
        k = di = dj = 0
        for a, b in _STEPS:
            x, y = i + a * step, j + b * step
            # one common word after a gap is chance: two must match at once
            if 0 <= x < n and 0 <= y < m and item[x] == doc[y] and 0 <= x + step < n and 0 <= y + step < m and item[x + step] == doc[y + step] and (run_on := matched(x, y)) > k:
                k, di, dj = run_on, a, b
        if not k:
            break
        first = before if first is None else first
        i, j, run = i + (di + k) * step, j + (dj + k) * step, k
    return i, j, first


def longest_stretch(item: list, doc: list, i: int, j: int, size: int, gap: int) -> tuple[int, int, int, int]:
    """Item and document bounds of the longest stretch around the piece hit
    ``item[i:i+size] == doc[j:j+size]``; errors on both sides keep their distance over the piece too."""
    # one side grows freely, the other knows how far away that side's first error is
    right, right_j, first = _grow(item, doc, i + size, j + size, 1, gap, gap)
    left, left_j, first_left = _grow(item, doc, i - 1, j - 1, -1, gap if first is None else size + first, gap)
    found = (left + 1, right, left_j + 1, right_j)
    if first is not None and first_left is None:
        left, left_j, first_left = _grow(item, doc, i - 1, j - 1, -1, gap, gap)
        if first_left is not None:
            right, right_j, _ = _grow(item, doc, i + size, j + size, 1, size + first_left, gap)
            if right - left - 1 > found[1] - found[0]:
                found = (left + 1, right, left_j + 1, right_j)
    return found


class _Index:
    """Pieces of a block of items: for each piece size sorted hashes with their item and offset."""

    def __init__(self, items: list[tuple[int, str]], share: float, gap: int):
        self.gap = gap
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        self.least: list[int] = []
        by_size: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for item_id, passage in items:
            found = words_of(passage)
            if not found:
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32)
            least = max(1, int(np.ceil(share * len(codes) - 1e-9)))
            size = piece_size(least, gap)
            offsets = np.arange(0, len(codes) - size + 1, size)
            by_size.setdefault(size, []).append((_hashes(codes, size)[offsets], len(self.items), offsets))
            self.items.append(codes)
            self.ids.append(item_id)
            self.least.append(least)
        self.pieces = {}
        for size, parts in by_size.items():
            h = np.concatenate([p[0] for p in parts])
            owner = np.concatenate([np.full(len(p[0]), p[1], np.int32) for p in parts])
            offset = np.concatenate([p[2] for p in parts]).astype(np.int32)
            order = np.argsort(h, kind="stable")
            self.pieces[size] = h[order], owner[order], offset[order]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text number, item number, item bounds, document bounds) of every leaked item."""
        get = self.vocabulary.get
        codes, bounds = [], [0]
        for text in texts:
            codes.extend([get(w, 0) for w in words_of(text)])
            codes.append(0)
            bounds.append(len(codes))
        flat = np.array(codes, np.int64)
        unknown = np.concatenate(([0], np.cumsum(flat == 0)))
        starts = np.array(bounds)
        reported: set[tuple[int, int]] = set()
        tried: dict[tuple[int, int, int], int] = {}
        doc_at, doc, items = -1, [], {}
        for size, (hashes, owners, offsets) in self.pieces.items():
            h = _hashes(flat, size)
            whole = np.flatnonzero(unknown[size:] == unknown[: len(unknown) - size]) if len(h) else h  # no unknown word, no border
            lo = np.searchsorted(hashes, h[whole], "left") if len(whole) else whole
            hit = np.flatnonzero((lo < len(hashes)) & (hashes[np.minimum(lo, len(hashes) - 1)] == h[whole])) if len(whole) else whole
            texts_of = np.searchsorted(starts, whole[hit], "right") - 1 if len(hit) else hit
            for position, at, k in zip(whole[hit].tolist(), lo[hit].tolist(), texts_of.tolist()):
                if k != doc_at:
                    doc_at, doc = k, codes[bounds[k] : bounds[k + 1] - 1]
                j, value = position - bounds[k], h[position]
                while at < len(hashes) and hashes[at] == value:
                    owner, i = int(owners[at]), int(offsets[at])
                    at += 1
                    # pieces of one diagonal up to the end of a stretch already measured tell nothing new
                    if (k, owner) in reported or tried.get((k, owner, j - i), -1) >= i:
                        continue
                    item = items.get(owner)
                    if item is None:
                        item = items[owner] = self.items[owner].tolist()
                    if item[i : i + size] != doc[j : j + size]:
                        continue
                    a, b, c, d = longest_stretch(item, doc, i, j, size, self.gap)
                    tried[(k, owner, j - i)] = max(i, b - size)
                    # a changed word may have been written as up to three
                    if b - a >= self.least[owner] and myers_distance(item[a:b], doc[c:d]) <= 3 * budget_of(b - a, self.gap):
                        reported.add((k, owner))
                        yield k, owner, a, b, c, d


def _hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    c, h = codes.astype(np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * _BASE + c[k : k + n]
    return h


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    share: float = 0.4,
    gap: int = 9,
    block_chars: int = 32_000_000,
) -> DataFrame:
    """``(doc_id, item_id, first_word, last_word, covered, item_words)`` of every leaked test item.

    A document leaks an item if one stretch of it holds at least ``share`` of the passage's words,
    single changed or dropped words at least ``gap`` words apart allowed.  Items of any length take
    part: their pieces shorten with their budget, down to single words.  Defined cases: null and
    empty texts or passages leak nothing; repeated document rows give a row each; further columns of
    either table are ignored; empty tables give an empty result.
    """
    spark = documents.sparkSession
    numbered = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(passage).cast("string").alias("p")).where("p is not null and i is not null")
    total = numbered.agg(F.sum(F.length("p"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    schema = "doc_id bigint, item_id bigint, first_word int, last_word int, covered int, item_words int"
    texts = spread(documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    result = None
    for block in range(blocks):
        part = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        index = _Index([(r.i, r.p) for r in part.distinct().collect()], share, gap)
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for start in range(0, batch.num_rows, 200):
                    piece = batch.slice(start, 200)
                    ids = piece.column(0).to_pylist()
                    rows = [
                        (ids[k], index.ids[o], c, d - 1, b - a, len(index.items[o]))
                        for k, o, a, b, c, d in index.scan(piece.column(1).to_pylist())
                    ]
                    if rows:
                        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                        names = ("doc_id", "item_id", "first_word", "last_word", "covered", "item_words")
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        found = texts.mapInArrow(scan, schema)
        result = found if result is None else result.unionByName(found)
    return result
