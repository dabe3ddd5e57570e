"""Token counts by a public byte-level tokenizer, whose vocabulary file is a parameter.

A byte-level BPE splits a text into *words* by a fixed pattern and merges bytes inside each word
only.  The number of tokens of a text is therefore the sum over its words: a text cut between words
has as many tokens as its pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftloom.plans.spread import spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Tokens of texts, and for each token its bytes and whether it begins or ends with white space."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self._encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        top = max(ranks.values()) + 1
        self.lengths = np.zeros(top, np.int64)
        self.blank_first, self.blank_last = np.zeros(top, bool), np.zeros(top, bool)
        for piece, k in ranks.items():
            self.lengths[k] = len(piece)
            self.blank_first[k], self.blank_last[k] = piece[:1].isspace(), piece[-1:].isspace()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._tokens(text), np.int64)

    def count(self, text: str | None) -> int:
        return len(self._tokens(text)) if text else 0

    def _tokens(self, text: str) -> list[int]:
        try:
            return self._encode(text)
        except UnicodeEncodeError:  # a lone surrogate has no UTF-8 form; it counts like "?"
            return self._encode(text.encode("utf-8", "replace").decode())


@lru_cache(maxsize=4)
def counter(path: str = DEFAULT_TOKENIZER) -> TokenCounter:
    """One counter for each worker process and vocabulary."""
    return TokenCounter(path)


def with_token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``; null and empty texts have 0 tokens."""
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", n_tokens int"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counter(tokenizer)
        for batch in batches:
            n = pa.array([sizes.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return spread(kept).mapInArrow(count, schema)
