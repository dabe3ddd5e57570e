"""Splitting oversized texts at natural boundaries (problem 8).

Agglomerative merging: a text is cut into atomic segments (sentences, and the words of sentences
that are too long themselves); all pairs of neighbours lie in a heap, the weakest boundary first,
and are merged while their joint size and the overlap before them fit the limit.  What is left are
the strongest boundaries: headings and paragraphs, then lines, then sentences, clauses and words.

Sizes are tokens of a public byte-level tokenizer.  Cuts fall between the words of the tokenizer's
own splitting pattern, so sizes add up exactly; only a single word longer than the limit is cut
inside.  A piece after the first begins with whole words of the text before it, the fewest that
have ``overlap_tokens`` tokens (fewer only where so much would leave no room for one segment).

Scale: one narrow pass over the documents, no shuffle; a text is split for all profiles at once.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.llm.tokens import DEFAULT_TOKENIZER, TokenCounter, counter
from driftloom.plans.spread import spread

#: Strengths of boundaries, weakest first.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
STRENGTHS = ("inside word", "word", "clause", "sentence", "line", "paragraph")
_BOUNDARY = re.compile(
    r"(?<![^\S\n])(?P<para>[^\S\n]*\n[^\S\n]*\n\s*)|(?<![^\S\n])(?P<line>[^\S\n]*\n\s*)|(?<=[.!?…。！？])[\"'”’»)\]]*(?P<sent>\s+)(?=[^\sa-zà-ÿ])|(?<=[,;:])(?P<clause>\s+)"
)
_KINDS = {"para": PARAGRAPH, "line": LINE, "sent": SENTENCE, "clause": CLAUSE}


class _Text:
    """Word borders of one text with the tokens before each, and its natural boundaries.

    A word begins where white space follows something else; there the tokenizer's splitting pattern
    begins a word too.  Words of more than ``longest`` tokens get borders inside, which may change
    how both sides merge, so each counts one token more.
    """

    def __init__(self, text: str, sizes: TokenCounter, codes: np.ndarray, longest: int = 0):
        self.text, self.codes, n = text, codes, len(codes)
        stops = np.cumsum(sizes.lengths[codes])
        starts = stops - sizes.lengths[codes]
        if text.isascii() or not n:
            character = starts
            whole = np.ones(n, bool)
        else:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            lead = (raw & 0xC0) != 0x80
            character = (np.cumsum(lead) - 1)[starts]
            whole = lead[starts]  # tokens that begin with a whole character
        first = sizes.blank_first[codes] & ~np.concatenate(([False], sizes.blank_last[codes[:-1]]))
        if n:
            first[0] = True
        at = np.flatnonzero(first)
        gaps = np.diff(np.append(at, n))
        self.largest = int(gaps.max()) if n else 0
        self.inner: frozenset[int] = frozenset()
        cost = at
        if longest and self.largest > longest:
            step = max(1, min(8, longest))
            more = np.concatenate([np.arange(a + step, a + g, step) for a, g in zip(at[gaps > longest], gaps[gaps > longest])])
            more = more[whole[more]]
            at, inside = np.unique(np.concatenate((at, more)), return_index=True)
            inside = inside >= len(first.nonzero()[0])
            self.inner = frozenset(np.flatnonzero(inside).tolist())
            cost = at + np.cumsum(inside)
            n += int(inside.sum())
        self.tokens = [*cost.tolist(), n]
        self.ends = [*character[at].tolist(), len(text)]

    def find_boundaries(self) -> None:
        ends, self.strength, last, n = self.ends, {}, 0, len(self.ends) - 1
        for m in _BOUNDARY.finditer(self.text):
            kind = m.lastgroup
            # cut before white space: the words of both sides stay those of the whole text
            k = last = bisect_left(ends, m.start(kind), last)
            if 0 < k < n and m.end() < len(self.text) and ends[k] == m.start(kind):
                self.strength[k] = _KINDS[kind]


def split_spans(doc: _Text, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first word with overlap, first word, word after, strength of the cut before) of each piece."""
    tokens, n, natural, inner = doc.tokens, len(doc.tokens) - 1, doc.strength, doc.inner
    overlap = max(0, min(overlap, limit - 1))

    def start_with_overlap(k: int, room: int) -> int:
        """Word at which a piece whose own text starts at word ``k`` begins."""
        if not overlap or not k:
            return k
        first = max(0, bisect_right(tokens, tokens[k] - overlap, 0, k + 1) - 1)
        while first < k and tokens[k] - tokens[first] > room:
            first += 1
        return first

    def lead_of(k: int) -> int:
        return tokens[k] - tokens[start_with_overlap(k, limit)]

    #: own text that surely fits besides the overlap
    fits = max(1, limit - overlap)
    small = max(1, min(fits // 4, 24))
    atoms, a = [0], 0
    for b in (*(k for k, s in natural.items() if s >= SENTENCE), n):
        if tokens[b] - tokens[a] <= fits - small or tokens[b] - tokens[a] + lead_of(a) <= limit:
            atoms.append(b)
        else:  # too long itself: groups of a few words, never across a clause
            start = a
            for k in range(a + 1, b):
                if k in natural or tokens[k + 1] - tokens[start] > small:
                    atoms.append(k)
                    start = k
            atoms.append(b)
        a = b
    m = len(atoms) - 1
    begin, end = atoms[:-1], atoms[1:]
    after, before, alive = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m
    lead = [lead_of(k) for k in begin]
    cut = [INSIDE if k in inner else natural.get(k, WORD) for k in begin]
    from_token, to_token = [tokens[k] for k in begin], [tokens[k] for k in end]
    heap = [
        (cut[k + 1], size, k, k + 1, to_token[k + 1])
        for k in range(m - 1)
        if (size := to_token[k + 1] - from_token[k] + lead[k]) <= limit
    ]
    heapq.heapify(heap)
    while heap:
        _, _, left, right, at = heapq.heappop(heap)
        if not (alive[left] and alive[right]) or after[left] != right or to_token[right] != at:
            continue
        alive[right] = False
        end[left], to_token[left] = end[right], at
        follower = after[left] = after[right]
        if follower < m:
            before[follower] = left
            if (size := to_token[follower] - from_token[left] + lead[left]) <= limit:
                heapq.heappush(heap, (cut[follower], size, left, follower, to_token[follower]))
        leader = before[left]
        if leader >= 0 and (size := at - from_token[leader] + lead[leader]) <= limit:
            heapq.heappush(heap, (cut[left], size, leader, left, at))
    pieces, previous = [], 0
    for k in range(m):
        if alive[k]:
            first = max(start_with_overlap(begin[k], limit - to_token[k] + from_token[k]), previous)
            pieces.append((first, begin[k], end[k], cut[k]))
            previous = first
    return pieces


_FIELDS = (
    ("doc_id", "bigint", pa.int64()), ("profile", "string", pa.string()), ("piece_no", "int", pa.int32()), ("pieces", "int", pa.int32()),
    ("char_start", "int", pa.int32()), ("char_own", "int", pa.int32()), ("char_end", "int", pa.int32()), ("n_tokens", "int", pa.int32()),
    ("overlap_tokens", "int", pa.int32()), ("cut_at", "string", pa.string()), ("text", "string", pa.string()),
)


def split_texts(
    documents: DataFrame,
    limits: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER,
) -> DataFrame:
    """The pieces of every text over a profile's ``max_tokens``, for each profile of ``limits``.

    A piece is ``text[char_start:char_end]``; its own part begins at ``char_own`` and the own parts
    of a text's pieces, in order of ``piece_no`` (from 0), give the text again.  ``n_tokens`` never
    exceeds the limit.  Defined cases: null and empty texts and texts within the limit give no
    pieces; profiles without a name or with a null or non-positive ``max_tokens`` are left out,
    a null or negative overlap counts as 0 and one of the limit or more as one less; a repeated
    profile row or document row gives its pieces again; further columns are ignored.
    """
    profiles = [
        (r.profile, int(r.max_tokens), max(0, int(r.overlap_tokens or 0)))
        for r in limits.where("profile is not null and max_tokens > 0").select("profile", "max_tokens", "overlap_tokens").toLocalIterator()
    ]
    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if not profiles:
        return documents.sparkSession.createDataFrame([], schema)
    smallest = min(p[1] for p in profiles)
    # a token has at least one byte: shorter texts cannot exceed any limit
    rows = rows.where(F.octet_length("text") > smallest)

    def pieces(doc: int, text: str, sizes: TokenCounter) -> Iterator[tuple]:
        codes = sizes.encode(text)
        if len(codes) <= smallest:
            return
        base = _Text(text, sizes, codes)
        parsed = {0: base}
        for name, limit, overlap in profiles:
            if len(codes) <= limit:
                continue
            # only a text with a word over a quarter of the limit is cut inside words
            longest = max(1, limit // 4)
            known = base if base.largest <= longest else parsed.setdefault(longest, None) or _Text(text, sizes, codes, longest)
            if not hasattr(known, "strength"):
                parsed[longest if known is not base else 0] = known
                known.find_boundaries()
            spans = split_spans(known, limit, overlap)
            ends, tokens, exact = known.ends, known.tokens, known is base
            for no, (first, own, last, kind) in enumerate(spans):
                a, b, c = ends[first], ends[own], ends[last]
                part = text[a:c]
                size = tokens[last] - tokens[first] if exact else sizes.count(part)
                shared = tokens[own] - tokens[first] if exact else sizes.count(text[a:b])
                yield doc, name, no, len(spans), a, b, c, size, shared, STRENGTHS[kind] if no else "start", part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counter(tokenizer)
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f[2]) for x, f in zip(zip(*out), _FIELDS)], [f[0] for f in _FIELDS])
            out.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for piece in pieces(doc, text, sizes):
                    out.append(piece)
                    held += len(piece[-1])
                    if held > 2_000_000:
                        yield flush()
                        held = 0
        if out:
            yield flush()

    return spread(rows).mapInArrow(run, schema)
