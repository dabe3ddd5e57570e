import random

from driftloom.llm.leaks import budget_of, find_leaks, myers_distance, piece_size, words_of

WORDS = [f"w{k}" for k in range(400)]


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert myers_distance(a, b) == slow_distance(a, b)


def passages(rng, n=12, size=70):
    return [" ".join(rng.choices(WORDS, k=size)) for _ in range(n)]


def damaged(rng, words, every):
    out = []
    for k, w in enumerate(words):
        if k % every == every - 1:
            if rng.random() < 0.5:
                continue
            w = "changed"
        out.append(w)
    return out


def frames(spark, documents, items):
    return (
        spark.createDataFrame(documents, "doc_id bigint, text string, item_id int, passage string"),
        spark.createDataFrame(items, "item_id bigint, passage string, doc_id int, text string"),
    )


def test_found_parts_and_forms(spark):
    rng = random.Random(2)
    items = passages(rng)
    filler = lambda: " ".join(rng.choices(["x%d" % k for k in range(300)], k=60))
    documents, expected = [], set()
    for k, passage in enumerate(items):
        words = passage.split()
        cases = [
            (words, True),
            (words[10:38], True),  # exactly two fifths
            (words[10:36], False),
            (damaged(rng, words, 10), True),
            (damaged(rng, words, 4), False),
            (words[:20] + filler().split() + words[40:60], False),  # not in one stretch
        ]
        for n, (part, leaks) in enumerate(cases):
            text = " ".join(part)
            form = (str, str.upper, lambda t: t.replace(" ", "\n> "), lambda t: "<b>" + t.replace(" ", "</b> <i>") + "</i>", lambda t: t.replace(" ", ", "))[n % 5]
            documents.append((k * 10 + n, f"{filler()} {form(text)} {filler()}", 1, "clash"))
            if leaks:
                expected.add((k * 10 + n, k))
    found = find_leaks(*frames(spark, documents, [(k, p, 1, "clash") for k, p in enumerate(items)]))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected
    # more blocks of items, same result
    again = find_leaks(*frames(spark, documents, [(k, p, 1, "clash") for k, p in enumerate(items)]), block_chars=500)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == expected


def test_edge_cases(spark):
    passage = " ".join(WORDS[:60])
    documents = [(1, None, 1, ""), (2, "", 1, ""), (3, "x", 1, ""), (4, passage, 1, ""), (4, passage, 1, ""), (None, passage, 1, ""), (5, "y " * 200_000 + passage, 1, "")]
    items = [(1, passage, 1, ""), (1, passage, 1, ""), (2, None, 1, ""), (3, "", 1, ""), (4, "short one", 1, ""), (None, passage, 1, "")]
    found = [(r.doc_id, r.item_id) for r in find_leaks(*frames(spark, documents, items)).collect()]
    assert sorted(found, key=str) == sorted([(4, 1), (4, 1), (5, 1), (None, 1)], key=str)
    assert find_leaks(*frames(spark, [], items)).count() == 0
    assert find_leaks(*frames(spark, documents, [])).count() == 0


def test_words():
    assert words_of("<b>Café</b>&nbsp;ﬁne co­op x_y") == ["cafe", "fine", "coop", "x", "y"]
    assert words_of(None) == []


def test_every_smallest_stretch_keeps_a_piece():
    """Whatever single errors, nine words apart, a smallest stretch has, one whole piece is free of them."""
    for least in range(1, 80):
        size, budget = piece_size(least, 9), budget_of(least, 9)
        for start in range(size):
            whole = [k for k in range(0, least + size, size) if start <= k and k + size <= start + least]
            assert len(whole) >= budget + 1, (least, start)


def test_short_items_and_one_change(spark):
    rng = random.Random(4)
    short, middle = rng.sample(WORDS, 15), rng.sample(WORDS, 35)
    changed = [*middle[10:17], "other", *middle[18:25]]
    filler = " ".join(f"x{k}" for k in range(30))
    documents = [(1, f"{filler} {' '.join(short[4:11])} {filler}", 1, ""), (2, f"{filler} {' '.join(changed)} {filler}", 1, ""), (3, f"{filler} {' '.join(short[4:9])} {filler}", 1, ""), (4, f"{filler} uniquum {filler}", 1, "")]
    items = [(1, " ".join(short), 1, ""), (2, " ".join(middle), 1, ""), (3, "uniquum", 1, "")]
    found = {(r.doc_id, r.item_id, r.covered) for r in find_leaks(*frames(spark, documents, items)).collect()}
    assert found == {(1, 1, 7), (2, 2, 15), (4, 3, 1)}


def test_a_piece_of_many_items(spark):
    """Items that share most of their words are all told apart, in one scan."""
    rng = random.Random(5)
    common = rng.sample(WORDS, 30)
    items = [[*common, *rng.sample(WORDS, 40)] for _ in range(200)]
    documents = [(k, " ".join(items[k][20:65]), 1, "") for k in range(0, 200, 20)]
    found = {(r.doc_id, r.item_id) for r in find_leaks(*frames(spark, documents, [(k, " ".join(w), 1, "") for k, w in enumerate(items)])).collect()}
    assert found == {(k, k) for k in range(0, 200, 20)}
