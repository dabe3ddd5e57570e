"""Nested records against json.loads and a recursive walk."""

import json

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from driftloom.operators.nested import _Bitmaps, _joined, chunk_children, flatten_records, index_payloads, readable

LISTS = ("retrieved_chunks_raw", "chunks_final_to_llm")


def as_list(value):
    return value if isinstance(value, list) else [value]


def opened(value):
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def walk(record_id, payload):
    """The expected rows, by recursion over the parsed record."""
    try:
        record = json.loads(payload)
    except (ValueError, TypeError):
        return

    def find(value):
        value = opened(value)
        if isinstance(value, dict):
            for name, inner in value.items():
                if name in LISTS:
                    yield name, inner
                else:
                    yield from find(inner)
        elif isinstance(value, list):
            for inner in value:
                yield from find(inner)

    def entries(value, above):
        for n, x in enumerate(as_list(opened(value))):
            x = opened(x)
            if isinstance(x, dict):
                yield (*above, n)
                if x.get("children") is not None:
                    yield from entries(x["children"], (*above, n))

    for name, value in find(record):
        for n, chunk in enumerate(as_list(opened(value))):
            chunk = opened(chunk)
            if not isinstance(chunk, dict):
                continue
            yield record_id, name, n, "chunk", "-"
            metadata = opened(chunk.get("metadata"))
            if isinstance(metadata, dict):
                if metadata.get("authors") is not None:
                    for k, x in enumerate(as_list(metadata["authors"])):
                        if x is not None:
                            yield record_id, name, n, "authors", str(k)
                if metadata.get("toc") is not None:
                    for path in entries(metadata["toc"], ()):
                        yield record_id, name, n, "toc", ".".join(map(str, path))


PAYLOADS = [
    None,
    "",
    "   ",
    "...",
    '{"a": 1',
    "[]",
    "{}",
    "3",
    json.dumps({"retrieved_chunks_raw": [{"metadata": {"authors": ["a", None, "b"], "toc": [{"children": [{"x": []}, None, {"children": {"t": 1}}]}]}}, None, {"metadata": None}]}),
    json.dumps({"run": {"x": [{"chunks_final_to_llm": {"metadata": {"authors": "solo", "toc": {"title": "t"}}}}]}}, indent=2),
    json.dumps({"context": json.dumps({"retrieved_chunks_raw": json.dumps([{"metadata": json.dumps({"authors": ["x"], "toc": []})}])})}),
    json.dumps({'quo"te\\': 'te{xt" [with] \\" braces', "retrieved_chunks_raw": [{"text": "\\", "metadata": {"authors": []}}]}),
    json.dumps({"chunks_final_to_llm": [{"metadata": {"authors": ["é 漢"], "toc": [[], {"children": []}]}}]}, ensure_ascii=False),
    json.dumps({"retrieved_chunks_raw": [{"metadata": {"toc": [{"children": [{"children": [{"children": [{}]}]}]}]}}] * 3}),
]


def test_chunk_children_equal_recursion(spark):
    rows = list(enumerate(PAYLOADS))
    frame = spark.createDataFrame([(k, p, "extra", k) for k, p in rows], "input_id bigint, payload string, node string, parent int")
    found = chunk_children(flatten_records(frame)).select("record_id", "list_name", "chunk_pos", "child_kind", "child_path").collect()
    assert sorted(map(tuple, found)) == sorted(r for k, p in rows if p for r in walk(k, p))


def test_links_lead_to_the_containing_value(spark):
    frame = spark.createDataFrame([(1, PAYLOADS[8])], "input_id bigint, payload string")
    nodes = {r.node: r for r in flatten_records(frame).collect()}
    assert [n.node for n in nodes.values() if n.parent == -1] == [0]
    for node in nodes.values():
        if node.parent >= 0:
            above = nodes[node.parent]
            assert node.path.startswith(above.path) and above.kind in ("object", "array") and node.depth == above.depth + 1


def test_empty_table(spark):
    assert flatten_records(spark.createDataFrame([], "input_id bigint, payload string")).count() == 0


def test_very_long_payload(spark):
    payload = json.dumps({"retrieved_chunks_raw": [{"text": "x" * 200_000, "metadata": {"authors": [str(k) for k in range(5000)]}}]})
    frame = spark.createDataFrame([(1, payload), (1, payload)], "input_id bigint, payload string")
    assert chunk_children(flatten_records(frame)).count() == 2 * 5001


scalars = st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=12)
records = st.recursive(scalars, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=25)


def rebuild(nodes):
    """The value again from its rows."""
    below = {}
    for _, node, parent, *rest in nodes:
        below.setdefault(parent, []).append((node, rest))

    def value(node, rest):
        _, _, _, _, kind, text = rest
        if kind == "object":
            return {r[2]: value(n, r) for n, r in below.get(node, ())}
        if kind == "array":
            return [value(n, r) for n, r in below.get(node, ())]
        return {"null": None, "boolean": text == "true", "string": text}.get(kind, json.loads(text) if kind == "number" else None)

    return value(*below[-1][0])


@settings(max_examples=120, deadline=None)
@given(records, st.sampled_from([None, 1]), st.booleans())
def test_round_trip(record, indent, ascii_only):
    if '"{' in (dumped := json.dumps(record, indent=indent, ensure_ascii=ascii_only)) or '"[' in dumped:
        return  # a string that may hold JSON is indexed as such
    try:
        dumped.encode()
    except UnicodeEncodeError:
        return
    assert rebuild(list(index_payloads([None, dumped]))) == record


@pytest.mark.parametrize("payload", ['{"a": [1, 2}', '{"a" 1}', "[1,]", '"open', "nul"])
def test_unreadable(payload):
    assert list(index_payloads([payload])) == []


def accepted(texts):
    whole, starts = _joined([t.encode("utf-8", "replace") for t in texts])
    return readable(_Bitmaps(np.frombuffer(whole, np.uint8), starts)).tolist()


def loads(text):
    try:
        json.loads(text.encode("utf-8", "replace").decode())
    except ValueError:
        return False
    return True


BROKEN = [
    '{"a": 1}', '{"a": 1,}', '{"a": 1 "b": 2}', '{"a": [1, {"b": null}]}', '{"a": [1, {"b": null]}}', "[[1], [2]]", "[[1] [2]]", "]", "[", "}{", "[]]", "[}", '{"a"}', '{"a":}', '{:1}', '{1: 2}', '{"a": "b": 3}',
    '{"a": 1, [2]}', '[1: 2]', "1 2", "1", " 1 ", "-", "01", "1.", "1e5", "1e", "-0.5E-3", "tru", "true", "truefalse", "NaN", "-Infinity", '"a" "b"', '"a"b', 'a"b"', '"\\u12"', '"\\u12g4"', '"\\u12af"', '"\\x"', '"tab\tin"',
    '"\\"', '"\\\\"', '\\"', '"a\\', '[1,,2]', "[,1]", '{"a": {"b": {"c": [[], {}, [{}]]}}}', '{"a": 1}}', '{"a": 1} {"b": 2}', '{"a": [}]}', "\ufeff[]", "[1]x", "[1],", "", " ", "{}", '{"": ""}', '{"a": 1, "a": 2}',
]


def test_readable_as_the_standard_parser():
    assert accepted(BROKEN) == [loads(t) for t in BROKEN]
    for t in BROKEN:  # alone, not only beside others
        assert accepted([t]) == [loads(t)], t


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='{}[]:,"\\ 1ae\n-u0', max_size=12), min_size=1, max_size=6))
def test_readable_for_any_text(texts):
    assert accepted(texts) == [loads(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(records, st.integers(0, 60), st.sampled_from('{}[]:,"\\x1 '))
def test_readable_after_one_change(record, at, letter):
    text = json.dumps(record)
    texts = [text[:at] + letter + text[at + 1 :], text[:at] + text[at + 1 :], text, text[:at]]
    assert accepted(texts) == [loads(t) for t in texts]


def test_any_number_of_text_levels():
    value = {"retrieved_chunks_raw": [{"metadata": {"authors": ["x"]}}]}
    for _ in range(14):
        value = {"run": json.dumps(value)}
    rows = list(index_payloads([json.dumps(value)]))
    assert sum(r[5] == "authors" for r in rows) == 1 and rows[-1][8] == "x"


def test_very_deep_payload():
    deep = 60_000
    rows = list(index_payloads(["[" * deep + "]" * deep, '{"a": 1}']))
    assert len(rows) == deep + 2
    mine = [r for r in rows if r[0] == 0]
    assert [r[2] for r in mine] == list(range(-1, deep - 1)) and mine[-1][3] == deep - 1
    assert mine[1000][4] is not None and mine[1001][4] is None
