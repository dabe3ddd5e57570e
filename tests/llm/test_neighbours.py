import numpy as np

from driftloom.llm.neighbours import nearest_neighbours, neighbour_pairs, quantise, tile_top_k


def clustered(rng, n, dim=16, centres=60, noise=0.15):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(centres, size=n)] + noise * rng.normal(size=(n, dim))
    return (x * rng.uniform(0.5, 3, size=(n, 1))).astype(np.float32)


def brute(ids, x, k=5):
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    unit = unit.astype(np.float32).astype(np.float64)
    score = unit @ unit.T
    np.fill_diagonal(score, -np.inf)
    ids = np.asarray(ids)
    order = np.lexsort((np.broadcast_to(ids, score.shape), -np.round(score, 9)), axis=1)[:, :k]
    return {i: [int(j) for j in ids[row]] for i, row in zip(ids.tolist(), order)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vector array<float>, h string, member int")


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r.place)):
        out.setdefault(r.vec_id, []).append(r.neighbour)
    return out


def test_bounds_of_codes():
    x = clustered(np.random.default_rng(0), 300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = quantise(x)
    approx = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(approx - x.astype(float) @ x.T.astype(float)) <= 1.01 * (error[:, None] + error[None, :]) + 1e-5).all()


def test_tiles_are_exact():
    rng = np.random.default_rng(1)
    x = clustered(rng, 5000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(5000)
    found = {q: list(b) for qs, bs, _ in tile_top_k(x, ids, x, ids, 5) for q, b in zip(qs, bs)}
    expected = brute(list(ids), x)
    assert np.mean([found[i] == expected[i] for i in ids]) > 0.999


def test_small_tables_are_exact_with_ties(spark):
    x = clustered(np.random.default_rng(2), 100)
    x[10:20] = x[10]
    x[30:33] = x[30]
    rows = [(k, v.tolist(), "c", 1) for k, v in enumerate(x)]
    bad = [(200, None, "c", 1), (201, [0.0] * 16, "c", 1), (202, [1.0] * 15, "c", 1), (203, [float("nan")] * 16, "c", 1), (None, [1.0] * 16, "c", 1)]
    assert answers(nearest_neighbours(frame(spark, rows + bad))) == brute(list(range(100)), x)


def test_many_copies(spark):
    x = clustered(np.random.default_rng(3), 60)
    rows = [(k, v.tolist(), "c", 1) for k, v in enumerate(x)] + [(1000 + k, x[0].tolist(), "c", 1) for k in range(400)]
    found = answers(nearest_neighbours(frame(spark, rows)))
    assert len(found) == 460 and all(len(v) == 5 for v in found.values())
    assert found[1399] == [0, 1000, 1001, 1002, 1003] and found[0] == [1000, 1001, 1002, 1003, 1004] and found[1001] == [0, 1000, 1002, 1003, 1004]


def test_recall_with_blocks(spark):
    x = clustered(np.random.default_rng(4), 4000, centres=300)
    found = answers(nearest_neighbours(frame(spark, [(k, v.tolist(), "c", 1) for k, v in enumerate(x)])))
    expected = brute(list(range(4000)), x)
    assert np.mean([len(set(found[i]) & set(expected[i])) / 5 for i in expected]) >= 0.95


def test_few_and_none(spark):
    assert nearest_neighbours(frame(spark, [])).count() == 0
    assert nearest_neighbours(frame(spark, [(1, [1.0, 2.0], "c", 1)])).count() == 0
    assert answers(nearest_neighbours(frame(spark, [(1, [1.0, 2.0], "c", 1), (2, [2.0, 1.0], "c", 1), (2, [2.0, 1.0], "c", 1)]))) == {1: [2], 2: [1]}
    pairs = neighbour_pairs(nearest_neighbours(frame(spark, [(1, [1.0, 2.0], "c", 1), (2, [2.0, 1.0], "c", 1)]))).collect()
    assert [tuple(p) for p in pairs] == [(1, 2)]


def recall_of(spark, ids, x, asked, frame_rows=None):
    found = answers(nearest_neighbours(frame(spark, [(int(i), v.tolist(), "c", 1) for i, v in zip(ids, x)]), group_rows=3000))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = []
    for i in asked:
        score = unit @ unit[i]
        score[i] = -np.inf
        best = np.argpartition(-score, 5)[:5]
        hits.append(len(set(found[int(ids[i])]) & {int(ids[b]) for b in best}) / 5)
    assert len(found) == len(ids)
    return np.mean(hits)


def test_a_third_nearly_equal(spark):
    """Vectors that are nearly, but not bit by bit, equal are told apart."""
    rng = np.random.default_rng(6)
    tight = rng.normal(size=16) + 3e-3 * rng.normal(size=(9000, 3)) @ rng.normal(size=(3, 16))
    x = np.concatenate((tight, clustered(rng, 6000, centres=400))).astype(np.float32)
    x = x[rng.permutation(len(x))]
    assert recall_of(spark, np.arange(len(x)), x, range(0, len(x), 50)) >= 0.9


def test_hot_blocks_are_tiled_on_both_sides(spark):
    """Two blocks for all rows, in groups of a few hundred: every query meets every member once."""
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=16) + 1e-3 * rng.normal(size=(2000, 16)), clustered(rng, 1000))).astype(np.float32)
    rows = [(k, v.tolist(), "c", 1) for k, v in enumerate(x)]
    found = answers(nearest_neighbours(frame(spark, rows), max_blocks=2, probes=2, sample_per_block=400, group_rows=300))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1)[:, :5]
    assert np.mean([len(set(found[k]) & set(best[k].tolist())) / 5 for k in range(len(x))]) > 0.99


def test_scaled_copies(spark):
    """Copies of one direction at other lengths are reduced to few before the join."""
    rng = np.random.default_rng(7)
    x = clustered(rng, 200)
    rows = [(k, v.tolist(), "c", 1) for k, v in enumerate(x)] + [(1000 + k, (x[0] * (0.5 + k / 500)).tolist(), "c", 1) for k in range(3000)]
    found = answers(nearest_neighbours(frame(spark, rows)))
    assert len(found) == 3200 and all(len(v) == 5 for v in found.values())
    assert np.mean([set(found[1000 + k]) <= {0, *range(1000, 4000)} for k in range(3000)]) > 0.999


def test_sorted_table(spark):
    """A region that stands only at the end of the table is searched as well as the others."""
    rng = np.random.default_rng(8)
    x = clustered(rng, 6000, centres=300)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    assert recall_of(spark, np.arange(len(x)), x, range(5000, 6000, 5)) >= 0.93


def test_more_groups_than_blocks_hold(spark):
    """Groups of few rows, many of which share a block of any size: their rows are not parted by what else stands there."""
    rng = np.random.default_rng(10)
    x = clustered(rng, 12000, dim=32, centres=1500, noise=0.35)
    assert recall_of(spark, np.arange(len(x)), x, range(0, len(x), 15)) >= 0.95


def test_repeated_ids_are_one_vector(spark):
    """Rows of one id count once, as copies and as members of a block."""
    x = clustered(np.random.default_rng(12), 40)
    rows = [(k, v.tolist(), "c", 1) for k, v in enumerate(x)]
    assert answers(nearest_neighbours(frame(spark, rows + rows[:1] * 8 + rows[1:9] * 4))) == brute(list(range(40)), x)


def test_rows_between_blocks_ask_all_that_are_near(spark):
    """Without groups no few blocks hold the neighbours: the number of blocks follows the row, not a parameter."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 6)).astype(np.float32)
    assert recall_of(spark, np.arange(len(x)), x, range(0, len(x), 15)) >= 0.94
