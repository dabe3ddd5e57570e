from pathlib import Path

import pytest

from driftloom.llm.mixing import mix, mix_report, mixing_rates, sized_documents
from driftloom.llm.splitting import split_texts
from driftloom.llm.tokens import DEFAULT_TOKENIZER, counter

pytestmark = pytest.mark.skipif(not Path(DEFAULT_TOKENIZER).exists(), reason="no tokenizer file")

TARGETS = [("big", 0.5, 1, "t"), ("small", 0.3, 3, "t"), ("tiny", 0.1, 2, "t"), ("none", 0.05, 4, "t"), ("zero", 0.0, 2, "t"), (None, 0.05, 2, "t")]
TARGET_SCHEMA = "source string, target_share double, max_repeats int, text string"


def corpus(spark):
    rows = [(k, "big", f"document {k} " + "word " * (k % 50 + 1), "a") for k in range(3000)]
    rows += [(k, "small", f"document {k} " + "other " * (k % 20 + 1), "a") for k in range(3000, 3300)]
    rows += [(k, "tiny", "few words here", "a") for k in range(3300, 3310)]
    rows += [(k, "zero", "never taken", "a") for k in range(3310, 3320)] + [(k, "unlisted", "never taken", "a") for k in range(3320, 3330)]
    rows += [(4000, None, "no source", "a"), (4001, "big", None, "a"), (4002, "big", "", "a"), (None, "big", "no id at all", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string")


def test_shares_and_caps(spark):
    sized = sized_documents(corpus(spark))
    rates = mixing_rates(sized, spark.createDataFrame(TARGETS, TARGET_SCHEMA), total_tokens=60_000)
    chosen = mix(sized, rates, bucket_rows=100)
    rows = chosen.collect()
    caps = {"big": 1, "small": 3, "tiny": 2}
    assert rows and all(1 <= r.copies <= caps[r.source] for r in rows)
    assert {r.source for r in rows} == set(caps)
    report = {r.source: r for r in mix_report(rates, chosen).collect()}
    assert set(report) == {"big", "small", "tiny", "none", "zero"}
    assert abs(report["big"].reached_tokens - report["big"].target_tokens) < 0.02 * report["big"].target_tokens
    assert report["tiny"].at_cap and report["tiny"].copies == 20 and report["none"].reached_tokens == 0
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9
    # expected copies of a source are met to within one in total
    assert abs(report["small"].copies - report["small"].rate * report["small"].documents) <= 1
    assert sorted(map(tuple, chosen.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_of_nothing(spark):
    empty = sized_documents(corpus(spark).limit(0))
    rates = mixing_rates(empty, spark.createDataFrame(TARGETS, TARGET_SCHEMA))
    assert mix(empty, rates).count() == 0
    assert mix_report(rates, mix(empty, rates)).where("reached_share <> 0").count() == 0
    full = sized_documents(corpus(spark))
    assert mix(full, mixing_rates(full, spark.createDataFrame([], TARGET_SCHEMA))).count() == 0


LIMITS = [("a", 40, 8, 1), ("b", 100, 0, 1), ("c", 25, 40, 1), (None, 10, 1, 1), ("d", None, 1, 1), ("e", 0, 1, 1), ("f", 60, None, 1)]


def check_pieces(texts, pieces):
    sizes = counter()
    limits = {name: (limit, overlap or 0) for name, limit, overlap, _ in LIMITS if name and limit}
    groups = {}
    for p in pieces:
        groups.setdefault((p.doc_id, p.profile), []).append(p)
    for (doc, profile), group in groups.items():
        limit, overlap = limits[profile]
        text = texts[doc]
        group.sort(key=lambda p: p.piece_no)
        assert [p.piece_no for p in group] == list(range(len(group))) and all(p.pieces == len(group) for p in group)
        assert "".join(text[p.char_own : p.char_end] for p in group) == text
        for p in group:
            assert p.text == text[p.char_start : p.char_end] and p.char_start <= p.char_own
            assert p.n_tokens == sizes.count(p.text) <= limit
    over = {(d, name) for d, t in texts.items() for name, (limit, _) in limits.items() if sizes.count(t) > limit}
    assert set(groups) == over
    return groups


def test_pieces_fit_and_join_again(spark):
    texts = {
        1: "A first sentence here. A second one follows it! Is there a third? Yes; of course, there is one more.\n\n" * 6,
        2: "no marks at all " * 60,
        3: "x" * 3000,
        4: "漢字" * 400 + "。",
        5: "Heading\n\nOne line\nanother line\n\n\n  Indented paragraph. With two sentences.\r\n\r\nEnd" * 5,
        6: "short",
        7: "🙂" * 200 + " tail " + "é" * 100,
        8: " " * 500 + "\n" * 100,
        9: "<|endoftext|> " * 50,
        10: "Word. " * 20_000,
    }
    rows = [(k, t, "p", 1) for k, t in texts.items()] + [(11, None, "p", 1), (12, "", "p", 1)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, profile string, n_tokens int")
    limits = spark.createDataFrame(LIMITS, "profile string, max_tokens int, overlap_tokens int, doc_id int")
    pieces = split_texts(documents, limits).collect()
    groups = check_pieces(texts, pieces)
    # overlaps of whole words: at least as long as asked for where there is room
    for p in groups[(1, "a")][1:]:
        assert p.overlap_tokens >= 8
    # cuts at paragraphs where they are near enough
    assert {p.cut_at for p in groups[(1, "a")][1:]} <= {"paragraph", "sentence"}
    assert {p.cut_at for p in groups[(2, "a")][1:]} == {"word"}


def test_nothing_to_split(spark):
    limits = spark.createDataFrame(LIMITS, "profile string, max_tokens int, overlap_tokens int, doc_id int")
    documents = spark.createDataFrame([(1, "text " * 500)], "doc_id bigint, text string")
    assert split_texts(documents.limit(0), limits).count() == 0
    assert split_texts(documents, limits.limit(0)).count() == 0
    assert split_texts(documents.union(documents), limits).where("profile = 'b'").count() == 2 * split_texts(documents, limits).where("profile = 'b'").count()
