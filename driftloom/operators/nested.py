"""Deeply nested semi-structured records as flat tables with parent-child links (problem 4).

Vectorised structural indexing.  The payloads of an Arrow batch form one byte buffer; numpy marks
quotes that are not escaped, the bytes inside strings, and the brackets, commas and colons outside
them.  Prefix sums over the brackets give the nesting depth; a stable sort by depth puts the
delimiters of every container side by side.  From these bitmaps follows first which payloads are
readable - legal neighbours among the tokens, matching brackets, a colon for every key - and then all
values at once as spans with their container, position and key.  Strings that hold a JSON object or
array themselves are indexed again, one level after the other, until there is none.

Every value becomes one row with its own and its parent's number and its path, so the tables of
chunks, authors and contents entries are plain filters on it: no join, no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftloom.plans.spread import spread

_KINDS = {ord("{"): "object", ord("["): "array", ord('"'): "string", ord("n"): "null", ord("t"): "boolean", ord("f"): "boolean"}
_NODE_FIELDS = (
    ("node", "int", pa.int32()), ("parent", "int", pa.int32()), ("depth", "int", pa.int32()), ("path", "string", pa.string()),
    ("name", "string", pa.string()), ("position", "int", pa.int32()), ("kind", "string", pa.string()), ("value", "string", pa.string()),
)
_SCALAR = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")
_BLANK = np.frombuffer(b" \t\r\n", np.uint8)
_HEX = np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)
_ESCAPES = np.frombuffer(b'"\\/bfnrtu', np.uint8)

#: Tokens of a text, and which may follow which; a text begins and ends with END.
_OPEN, _CLOSE, _OPEN_LIST, _CLOSE_LIST, _COMMA, _COLON, _STRING, _WORD, _END = range(9)
_FOLLOWS = np.zeros((9, 9), bool)
_VALUES = (_OPEN, _OPEN_LIST, _STRING, _WORD)
for _before in (_END, _COMMA, _COLON, _OPEN_LIST):
    _FOLLOWS[_before, _VALUES] = True
_FOLLOWS[_OPEN, (_STRING, _CLOSE)] = True
_FOLLOWS[_OPEN_LIST, _CLOSE_LIST] = True
for _before in (_CLOSE, _CLOSE_LIST, _STRING, _WORD):
    _FOLLOWS[_before, (_CLOSE, _CLOSE_LIST, _COMMA, _END)] = True
_FOLLOWS[_STRING, _COLON] = True
_TOKEN_OF = np.full(256, _WORD, np.int8)
for _byte, _token in zip(b"{}[],:", (_OPEN, _CLOSE, _OPEN_LIST, _CLOSE_LIST, _COMMA, _COLON)):
    _TOKEN_OF[_byte] = _token


class _Bitmaps:
    """Bit per byte of the joined texts; the texts need not be valid."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray):
        n = len(buffer)
        index = np.arange(n)
        self.buffer, self.starts = buffer, starts
        self.text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        slash = buffer == 0x5C
        # a byte is escaped if the run of backslashes before it, within its text, is odd
        last_other = np.maximum.accumulate(np.where(slash, -1, index)) if n else index
        last_other = np.maximum(last_other, starts[:-1][self.text_of] - 1) if n else index
        run = np.concatenate(([0], (index - last_other)[:-1])) if n else index
        if n:
            run[starts[:-1][np.diff(starts) > 0]] = 0
        self.escaped = run % 2 == 1
        self.quote = (buffer == 0x22) & ~self.escaped
        before = np.cumsum(self.quote) - self.quote
        base = np.concatenate((before, [before[-1] + self.quote[-1] if n else 0]))[starts[:-1]]
        self.odd = np.zeros(len(starts) - 1, bool)
        self.inside = np.zeros(n, bool)
        if n:
            self.inside = (before - base[self.text_of]) % 2 == 1
            self.odd = np.bincount(self.text_of, self.quote, len(starts) - 1) % 2 == 1
        self.blank = np.isin(buffer, _BLANK) & ~self.inside
        self.delimiter = (_TOKEN_OF[buffer] != _WORD) & ~self.inside & ~self.quote


def readable(bits: _Bitmaps) -> np.ndarray:
    """Which of the texts are JSON, from the bitmaps alone."""
    buffer, starts, texts = bits.buffer, bits.starts, len(bits.starts) - 1
    n = len(buffer)
    bad = bits.odd | (np.diff(starts) == 0)
    if not n:
        return ~bad
    # strings: no control characters, only known escapes, four hex digits after \u
    wrong = bits.inside & (buffer < 0x20)
    escape = bits.escaped & bits.inside
    wrong |= escape & ~np.isin(buffer, _ESCAPES)
    at = np.flatnonzero(escape & (buffer == ord("u")))
    hexes = np.isin(buffer, _HEX)
    for k in range(1, 5):
        ahead = at + k
        legal = (ahead < n) & hexes[np.minimum(ahead, n - 1)] & (bits.text_of[np.minimum(ahead, n - 1)] == bits.text_of[at])
        wrong[at[~legal]] = True
    # tokens: delimiters, opening quotes, and where other runs of bytes begin
    loose = ~bits.inside & ~bits.quote & ~bits.blank & ~bits.delimiter
    begins = loose & ~np.concatenate(([False], loose[:-1]))
    begins[starts[:-1][np.diff(starts) > 0]] |= loose[starts[:-1][np.diff(starts) > 0]]
    opening = bits.quote & ~bits.inside
    at = np.flatnonzero(bits.delimiter | opening | begins)
    token = np.where(opening[at], _STRING, _TOKEN_OF[buffer[at]])
    text = bits.text_of[at]
    # other runs are numbers and names
    ends = np.flatnonzero(loose & ~np.concatenate((loose[1:], [False])) | (loose & np.concatenate((bits.text_of[1:] != bits.text_of[:-1], [True]))))
    raw = buffer.tobytes()
    for a, b in zip(np.flatnonzero(begins).tolist(), (ends + 1).tolist()):
        if not _SCALAR.fullmatch(raw, a, b):
            wrong[a] = True
    bad |= np.bincount(bits.text_of, wrong, texts) > 0
    # neighbours, each text between two ends
    count = np.bincount(text, minlength=texts)
    bad |= count == 0
    change = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.empty(0, bool)
    last = np.concatenate((change[1:], [True])) if len(text) else change
    before = np.where(change, _END, np.concatenate(([_END], token[:-1]))) if len(text) else token
    after = np.where(last, _END, np.concatenate((token[1:], [_END]))) if len(text) else token
    legal = _FOLLOWS[before, token] & _FOLLOWS[token, after] & ~((before == _OPEN) & (token == _STRING) & (after != _COLON))
    # depth of each text by itself; delimiters of a container side by side
    keep = token <= _COLON
    d_token, d_text = token[keep], text[keep]
    opens = (d_token == _OPEN) | (d_token == _OPEN_LIST)
    closes = (d_token == _CLOSE) | (d_token == _CLOSE_LIST)
    total = np.cumsum(opens.astype(np.int64) - closes)
    first = np.searchsorted(d_text, np.arange(texts))
    base = np.concatenate(([0], total))[first]
    level = total - base[d_text] + closes
    sums = np.bincount(d_text, opens.astype(np.float64) - closes, texts)
    bad |= sums != 0
    below = (level < 1) if len(level) else np.empty(0, bool)  # a delimiter outside of every bracket
    bad |= np.bincount(d_text, below, texts) > 0
    bad |= np.bincount(text, ~legal, texts) > 0
    if len(d_token):
        order = np.lexsort((np.arange(len(d_token)), level, d_text))
        token_, text_, level_ = d_token[order], d_text[order], level[order]
        opens_, closes_ = opens[order], closes[order]
        box = np.cumsum(opens_) - 1
        kind = token_[opens_][np.maximum(box, 0)] if opens_.any() else token_
        listed = kind == _OPEN_LIST
        following = np.concatenate((token_[1:], [_END]))
        same = np.concatenate(((text_[1:] == text_[:-1]) & (level_[1:] == level_[:-1]), [False]))
        wrong_ = (box < 0) | (closes_ & (token_ != kind + 1)) | (listed & (token_ == _COLON))
        wrong_ |= closes_ & same & ~np.concatenate((opens_[1:], [False]))
        wrong_ |= ~closes_ & ~same
        wrong_ |= ~listed & ((token_ == _COMMA) & (following != _COLON) | (token_ == _OPEN) & (following != _COLON) & (following != _CLOSE) | (token_ == _COLON) & (following == _COLON))
        bad |= np.bincount(text_, wrong_, texts) > 0
    return ~bad


def structural_index(buffer: np.ndarray, starts: np.ndarray, bits: _Bitmaps | None = None) -> dict[str, np.ndarray]:
    """All values of the valid JSON texts that lie one after the other in ``buffer``.

    ``starts``: where each text begins, and the end of the last.  For each value, in order: its text
    number, span, parent value (-1 for a whole text), position among its siblings, depth, and the
    span of its key (empty in arrays).
    """
    n = len(buffer)
    index = np.arange(n)
    bits = _Bitmaps(buffer, starts) if bits is None else bits
    full = np.where(bits.blank, n, index)
    following = np.minimum.accumulate(full[::-1])[::-1] if n else full  # next byte that is not blank
    preceding = np.maximum.accumulate(np.where(bits.blank, -1, index)) if n else full

    at = np.flatnonzero(bits.delimiter)
    byte = buffer[at]
    is_open, is_close = (byte == 0x7B) | (byte == 0x5B), (byte == 0x7D) | (byte == 0x5D)
    level = np.cumsum(is_open.astype(np.int64) - is_close) + is_close  # depth of the container it belongs to
    order = np.argsort(level, kind="stable")
    at, byte, is_open, is_close, level = at[order], byte[order], is_open[order], is_close[order], level[order]

    # a value begins after each opening bracket and comma and ends at the next comma or closing bracket
    begins = is_open | (byte == 0x2C)
    k = np.flatnonzero(begins)
    colon = np.zeros(len(k), bool)
    in_range = k + 1 < len(at)
    colon[in_range] = byte[k[in_range] + 1] == 0x3A
    stop_at = at[np.minimum(k + 1 + colon, max(0, len(at) - 1))] if len(at) else k
    start = following[np.minimum(np.where(colon, at[np.minimum(k + 1, len(at) - 1)] if len(at) else 0, at[k]) + 1, n - 1)] if len(k) else k
    real = start < stop_at  # not an empty container
    number = np.cumsum(is_open) - 1 if len(at) else np.empty(0, np.int64)
    comma = np.cumsum(byte == 0x2C)
    open_rows = np.flatnonzero(is_open)
    position = comma[k] - comma[open_rows[number[k]]] if len(k) else k
    key_start = np.where(colon, following[np.minimum(at[k] + 1, n - 1)] + 1, 0) if len(k) else k
    key_stop = np.where(colon, preceding[at[np.minimum(k + 1, len(at) - 1)] - 1], 0) if len(k) else k
    container = at[open_rows[number[k]]] if len(k) else k

    root_start = following[starts[:-1]] if len(starts) > 1 else np.empty(0, np.int64)
    root_stop = starts[1:]
    values = {
        "start": np.concatenate((root_start, start[real])),
        "stop": np.concatenate((preceding[root_stop - 1] + 1 if len(root_start) else root_start, preceding[stop_at[real] - 1] + 1 if real.any() else start[real])),
        "container": np.concatenate((np.full(len(root_start), -1), container[real])),
        "position": np.concatenate((np.full(len(root_start), -1), np.where(colon, -1, position)[real])),
        "depth": np.concatenate((np.zeros(len(root_start), np.int64), level[k][real])),
        "key_start": np.concatenate((np.zeros(len(root_start), np.int64), key_start[real])),
        "key_stop": np.concatenate((np.zeros(len(root_start), np.int64), key_stop[real])),
    }
    order = np.argsort(values["start"], kind="stable")
    values = {name: column[order] for name, column in values.items()}
    values["text"] = np.searchsorted(starts, values["start"], "right") - 1
    values["parent"] = np.where(values["container"] >= 0, np.searchsorted(values["start"], values["container"]), -1)
    return values


def _joined(raw: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def _unquote(raw: bytes) -> str:
    return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")


def _step(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1").replace("#", "~2")


def index_payloads(payloads: list[str | None], path_depth: int = 1000) -> Iterator[tuple]:
    """(payload number, node, parent, depth, path, name, position, kind, value) of every value."""
    level = [(k, p, -1, 0, "", None, None) for k, p in enumerate(payloads) if p and not p.isspace()]
    used = [0] * len(payloads)
    whole_text = True
    while level:
        raw = [entry[1].encode("utf-8", "replace") for entry in level]
        whole, starts = _joined(raw)
        bits = _Bitmaps(np.frombuffer(whole, np.uint8), starts)
        good = readable(bits)
        if not good.all():
            level = [entry for entry, keep in zip(level, good) if keep]
            whole, starts = _joined([r for r, keep in zip(raw, good) if keep])
            bits = _Bitmaps(np.frombuffer(whole, np.uint8), starts)
        if not level:
            return
        v = structural_index(np.frombuffer(whole, np.uint8), starts, bits)
        nodes, paths, further = [], [], []
        columns = [v[c].tolist() for c in ("text", "start", "stop", "parent", "position", "depth", "key_start", "key_stop")]
        for text, start, stop, parent, position, depth, a, b in zip(*columns):
            payload, _, above, base_depth, base_path, base_name, base_position = level[text]
            if parent < 0:  # a payload itself, or a JSON text in the place of the value that it stands for
                name, at, path, up = base_name, base_position, base_path, above
            else:
                name, at = (_unquote(whole[a:b]), None) if b > 0 else (None, position)
                above_path = paths[parent]
                path = None if above_path is None or base_depth + depth > path_depth else f"{above_path}/{_step(name) if name is not None else f'#{at}'}".lstrip("/")
                up = nodes[parent]
            node = used[payload]
            used[payload] += 1
            nodes.append(node)
            paths.append(path)
            kind = _KINDS.get(whole[start], "number")
            value = None
            if kind == "string":
                value = _unquote(whole[start + 1 : stop - 1])
                if value.lstrip(" \t\r\n")[:1] in ("{", "["):
                    further.append((payload, value, node, base_depth + depth, path, name, at))
            elif kind in ("number", "boolean"):
                value = whole[start:stop].decode()
                kind = "number" if value == "NaN" else kind
            yield payload, node, up, base_depth + depth, path, name, at, kind, value
        level = further


def flatten_records(records: DataFrame, *, record_id: str = "input_id", payload: str = "payload", batch_rows: int = 64, path_depth: int = 1000) -> DataFrame:
    """One row per JSON value: ``(record_id, node, parent, depth, path, name, position, kind, value)``.

    ``node`` counts the values of a record, ``parent`` is the containing value's number (-1 for the
    whole record).  ``path`` joins keys and ``#position`` steps by ``/`` (``~``, ``/`` and ``#`` in
    keys as ``~0``, ``~1``, ``~2``); values more than ``path_depth`` containers deep have their links
    but no path, as paths would grow with the square of the depth.  A string that holds a JSON object
    or array gives its own row and, below it and under the same path, the rows of what it holds, at
    whatever number of levels.  Defined cases: null, blank and unreadable payloads give no rows;
    repeated records give their rows again; of repeated keys each gives a row; further columns are
    ignored; an empty table gives an empty result.
    """
    rows = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(payload).cast("string").alias("payload"))
    names = ["record_id", *(f[0] for f in _NODE_FIELDS)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                piece = batch.slice(start, batch_rows)
                ids = piece.column(0).to_pylist()
                held: list[tuple] = []
                for row in index_payloads(piece.column(1).to_pylist(), path_depth):
                    held.append(row)
                    if len(held) == 50_000:
                        yield _node_batch(held, ids, names)
                        held = []
                if held:
                    yield _node_batch(held, ids, names)

    schema = "record_id bigint, " + ", ".join(f"{name} {kind}" for name, kind, _ in _NODE_FIELDS)
    return spread(rows).mapInArrow(index, schema)


def _node_batch(held: list[tuple], ids: list, names: list[str]) -> pa.RecordBatch:
    numbers, *columns = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in numbers], pa.int64()), *(pa.array(c, f[2]) for c, f in zip(columns, _NODE_FIELDS))], names)


def _positions(path: Column) -> Column:
    """Positions of a path of list steps as dotted text; a value in place of a list has position 0.

    ``path`` alternates list names and positions, as in ``toc/#1/children/#0``.
    """
    explicit = F.regexp_replace(path, r"(toc|children)(?=/children|$)", "$1/#0")
    return F.array_join(F.regexp_extract_all(explicit, F.lit(r"/#(\d+)"), 1), ".")


def chunk_children(
    nodes: DataFrame, *, lists: tuple[str, ...] = ("retrieved_chunks_raw", "chunks_final_to_llm")
) -> DataFrame:
    """``(record_id, list_name, chunk_pos, child_kind, child_path, node, parent)`` of the nested lists.

    One row for each chunk object, each element of its ``metadata.authors`` and each contents entry
    in ``metadata.toc`` with the ``children`` below; null elements keep their position but give no
    row, and a single value in place of a list is a list of one.
    """
    names = "|".join(lists)
    chunk = rf"^(?:.*/)?({names})(?:/#(\d+))?"
    below = F.regexp_extract("path", chunk + "(.*)$", 3)
    by_kind = (
        F.when((F.col("kind") == "object") & (below == ""), F.lit("chunk"))
        .when(~F.col("kind").isin("null", "array") & below.rlike(r"^/metadata/authors(/#\d+)?$"), F.lit("authors"))
        .when((F.col("kind") == "object") & below.rlike(r"^/metadata/toc(/#\d+)?(/children(/#\d+)?)*$"), F.lit("toc"))
    )
    position = F.regexp_extract(below, r"/#(\d+)$", 1)
    child_path = (
        F.when(F.col("child_kind") == "chunk", F.lit("-"))
        .when(F.col("child_kind") == "authors", F.when(position == "", F.lit("0")).otherwise(position))
        .otherwise(_positions(below))
    )
    at = F.regexp_extract("path", chunk, 2)
    return (
        nodes.where(F.col("path").rlike(chunk))
        .withColumn("child_kind", by_kind)
        .where("child_kind is not null")
        .select(
            "record_id",
            F.regexp_extract("path", chunk, 1).alias("list_name"),
            F.when(at == "", F.lit("0")).otherwise(at).cast("int").alias("chunk_pos"),
            "child_kind",
            child_path.alias("child_path"),
            "node",
            "parent",
        )
    )
