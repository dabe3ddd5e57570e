"""The k most similar vectors of every vector, by cosine (problem 3).

Block matrix join.  Vectors are routed by leaves, centroids of some ``leaf_rows`` rows each, whose
number grows with the table.  They are found in two levels: cells are fitted on a bounded sample, and
the leaves of each cell in one task, on the cell's rows.  Neighbouring leaves of a cell make a block.
A vector belongs to the block of its nearest leaf and queries the blocks of all leaves that are about
as near as that one (:func:`_probed`): most query one block, those between leaves query many.  A task
multiplies int8 codes of queries with int8 codes of members, tile by tile.  Codes carry the norm of
their quantisation error, which bounds how far a product may be from the cosine; only pairs whose
upper bound reaches the k-th best lower bound are computed again in float, and the best k of a block
are merged with those of the query's other blocks.

Copies: vectors whose unit forms agree to about six digits have the same neighbours.  A group of
more than ``k + 1`` of them is reduced to its ``k + 1`` smallest ids before the join - by the tie rule
all neighbours of any copy are among them - so a vector that fills a third of the table, at whatever
lengths, does not make a block of that size.

Scale: leaves are broadcast as int8 differences from their cell, two or three bytes a row of the
table, up to ``max_blocks`` of them; cells are about as many as leaves in a cell, so a vector is
compared with a number of centroids that grows with the square root of the table.  Samples are the
rows with the least hashes, wherever they stand.  A block with more members or more queries than a
group may hold is tiled on both sides: every group is one part of the members and one part of the
queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from driftloom.plans.lineage import cut
from driftloom.plans.sides import counted
from driftloom.plans.spread import spread

TILE = 2048
#: Unit vectors are compared as whole multiples of this for being copies.
GRAIN = 2.0**-20
#: A leaf is queried if its cosine is less by at most ``NEAR``, or ``CLOSE`` times what the nearest leaf's lacks to 1.
NEAR, CLOSE, CODED = 0.12, 4.0, 1e-3
#: Leaves of a block, cells in which a vector looks for leaves, and the most rows on which a cell's leaves are fitted.
LEAVES, CELLS, CELL_ROWS = 16, 40, 200_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, their scale, and the norm of what the codes lose."""
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30) / 127.0
    codes = np.rint(x / scale).astype(np.int8)
    return codes, scale[:, 0], np.linalg.norm(x - codes * scale, axis=1)


def tile_top_k(query: np.ndarray, query_ids: np.ndarray, member: np.ndarray, member_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For tiles of queries: their ids, and for each query ids and cosines of its k best members.

    Codes are those of the differences from the members' mean c: x.y = c.c + c.dx + c.dy + dx.dy, of
    which the first two do not change the order for x.  So the bounds are as tight as the block is.
    """
    if not len(member):
        return
    # float32 rounds the length of unit vectors, which would hide the order of nearly equal ones
    query, member = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (query.astype(np.float64), member.astype(np.float64)))
    centre = member.mean(0)
    member_rest = (member - centre).astype(np.float32)
    member_codes, member_scale, member_error = quantise(member_rest)
    member_norm = np.linalg.norm(member_rest, axis=1)
    shift = ((member - centre) @ centre).astype(np.float32)
    for start in range(0, len(query), TILE):
        q, ids = query[start : start + TILE], query_ids[start : start + TILE]
        rest = (q - centre).astype(np.float32)
        codes, scale, error = quantise(rest)
        norm = np.linalg.norm(rest, axis=1)
        base = centre @ centre + (q - centre) @ centre
        # products of int8 codes are whole numbers below 2**24, so float32 multiplies them exactly
        codes = codes.astype(np.float32)
        heap_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        heap = np.full((len(q), k), -np.inf)
        for at in range(0, len(member), TILE):
            stop = at + TILE
            order_of = (codes @ member_codes[at:stop].astype(np.float32).T) * scale[:, None] * member_scale[None, at:stop] + shift[None, at:stop]
            # |x.y - x'.y'| <= |x-x'||y'| + |x||y-y'|, and what float32 rounds
            slack = 1.01 * (error[:, None] * (member_norm + member_error)[None, at:stop] + norm[:, None] * member_error[None, at:stop])
            slack += 2e-6 * (np.abs(shift[at:stop]).max() + norm[:, None] * member_norm[None, at:stop])
            own = ids[:, None] == member_ids[None, at:stop]
            low = order_of - slack
            low[own] = -np.inf
            width = low.shape[1]
            # a member whose upper bound is below the k-th best lower bound cannot be among the best
            least = np.partition(low, width - k, axis=1)[:, width - k] if width >= k else np.full(len(q), -np.inf, np.float32)
            known = heap[:, -1] - base - 1e-12
            floor = np.maximum(least, np.where(known > -np.inf, known - 1e-6 * np.abs(known), known)).astype(np.float32)
            passing = (order_of + slack >= floor[:, None]) & ~own
            # rows in slices, so that a tile of equal vectors, where all pairs pass, stays small
            most = max(1, 2_000_000 // width)
            for first in range(0, len(q), most):
                part = slice(first, first + most)
                rows, columns = np.nonzero(passing[part])
                if not len(rows):
                    continue
                exact = np.round(np.einsum("ij,ij->i", q[part][rows], member[at + columns]), 13)
                held = len(heap[part])
                all_rows = np.concatenate((np.repeat(np.arange(held), k), rows))
                all_ids = np.concatenate((heap_ids[part].ravel(), member_ids[at + columns]))
                all_scores = np.concatenate((heap[part].ravel(), exact))
                order = np.lexsort((all_ids, -all_scores, all_rows))
                place = np.arange(len(order)) - np.searchsorted(all_rows[order], all_rows[order], "left")
                best = order[place < k]
                heap_ids[part], heap[part] = all_ids[best].reshape(held, k), all_scores[best].reshape(held, k)
        kept = heap > -np.inf
        yield ids, [i[m] for i, m in zip(heap_ids, kept)], [s[m] for s, m in zip(heap, kept)]


def unit_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "vector", dim: int | None = None) -> tuple[DataFrame, int]:
    """``(vec_id, v, h)``: v of length 1, of the vectors of the usual length, h the hash of v to six
    digits; and that length.

    Null ids, null vectors, vectors with a null, not finite or only zero elements, and vectors of
    another length are left out.  ``dim`` is found as the most frequent length if not given.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<float>").alias("v")).where("vec_id is not null and v is not null")
    if dim is None:
        common = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = int(common.d) if common else 1

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            norm = np.linalg.norm(flat, axis=1)
            good = np.isfinite(norm) & (norm > 0)
            unit = (flat[good] / norm[good][:, None]).astype(np.float32)
            grains = np.rint(unit / GRAIN).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _binary(unit), _binary(grains)], ["vec_id", "v", "g"])

    unit = spread(rows.where(F.size("v") == dim)).mapInArrow(normalise, "vec_id bigint, v binary, g binary")
    return unit.select("vec_id", "v", F.xxhash64("g").alias("h")), dim


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values, without a Python object for each."""
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize if x.ndim == 2 else 0
    offsets = np.arange(len(x) + 1, dtype=np.int32) * step
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, dim), np.float32)
    offsets, data = column.buffers()[1], column.buffers()[2]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float32).reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` nearest centres of each row, best first."""
    out = []
    for start in range(0, len(x), 1000):
        score = x[start : start + 1000] @ centres.T
        if near < score.shape[1]:
            top = np.argpartition(-score, near - 1, axis=1)[:, :near]
            order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(top, order, 1))
        else:
            out.append(np.argsort(-score, axis=1, kind="stable"))
    return np.concatenate(out) if out else np.empty((0, near), np.int64)


@dataclass
class Index:
    """Leaves, as int8 differences from the centre of their cell; leaves of a cell stand together."""

    centres: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    block: np.ndarray
    member_parts: np.ndarray
    query_parts: np.ndarray


def _probed(x: np.ndarray, index: Index, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, block, home)``: the blocks of the leaves that are about as near to a row as its nearest
    leaf, ``probes`` at most, and whether it is the nearest leaf's."""
    near = _nearest(x, index.centres, min(CELLS, len(index.centres)))
    best, found = np.full(len(x), -np.inf, np.float32), []

    def least(best: np.ndarray) -> np.ndarray:
        return best - np.minimum(NEAR, CODED * np.sqrt(np.maximum(2 - 2 * best, 0)) + CLOSE * np.maximum(1 - best, 0)) - 1e-6

    # the nearest cells first, so that few leaves of the others are kept
    for ranks in (near[:, :2], near[:, 2:]):
        order = np.argsort(ranks.ravel(), kind="stable")
        at = np.searchsorted(ranks.ravel()[order], np.arange(len(index.centres) + 1))
        for cell in np.flatnonzero(np.diff(at)):
            first, last = index.starts[cell : cell + 2]
            if first == last:
                continue
            rows = order[at[cell] : at[cell + 1]] // ranks.shape[1]
            q = x[rows]
            score = (q @ index.codes[first:last].astype(np.float32).T) * index.scale[None, first:last] + (q @ index.centres[cell])[:, None]
            best[rows] = np.maximum(best[rows], score.max(1))
            r, leaf = np.nonzero(score >= least(best[rows])[:, None])
            found.append((rows[r], first + leaf, score[r, leaf]))
    row, leaf, score = (np.concatenate(c) for c in zip(*found))
    kept = score >= least(best)[row]
    row, block, score = row[kept], index.block[leaf[kept]], score[kept]
    # one row a block, best first
    order = np.lexsort((-score, block, row))
    row, block, score = row[order], block[order], score[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]
    row, block, score = row[new], block[new], score[new]
    order = np.lexsort((block, -score, row))
    row, block = row[order], block[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    return row[place < probes], block[place < probes], (place == 0)[place < probes]


def _leaves(x: np.ndarray, centre: np.ndarray, want: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means within a cell: differences of the centroids from the cell's centre, of which
    float32 keeps more digits in a narrow cell, and the number of the block of each."""
    rest = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:want]] - centre
    for turn in range(rounds):
        home, best, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32), np.full(len(x), -np.inf, np.float32)
        for at in range(0, len(x), 2000):
            part = slice(at, at + 2000)
            score = x[part] @ rest.T
            home[part], rows = np.argmax(score, axis=1), np.arange(len(score))
            best[part] = score[rows, home[part]]
            if len(rest) > 1:
                score[rows, home[part]] = -np.inf
                second[part] = score.max(1)
        if turn < rounds - 1 and len(rest) > 1:
            # leaves that another replaces at little loss begin again at rows that have none near
            loss = np.bincount(home, best - second, len(rest))
            lack = 1 - x @ centre - best
            spare = np.argsort(loss, kind="stable")[: max(1, len(rest) // 5)]
            far = np.argsort(-lack, kind="stable")[: max(1, len(x) // 4)][:: max(1, len(x) // 4 // len(spare))][: len(spare)]
            spare = spare[: len(far)]
            good = loss[spare] < 3 * lack[far]
            spare, far = spare[good], far[good]
            home[far] = spare
        order = np.argsort(home, kind="stable")
        held, at = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order].astype(np.float64), at, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        rest[held] = np.where(size > 0, sums / np.maximum(size, 1e-30) - centre, rest[held])
    block, groups, done = np.zeros(len(rest), np.int64), [np.arange(len(rest))], 0
    while groups:  # halves along the direction in which they differ most
        group = groups.pop()
        if len(group) <= LEAVES:
            block[group], done = done, done + 1
            continue
        away = rest[group] - rest[group].mean(0)
        order = np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")
        groups += [group[order[: len(group) // 2]], group[order[len(group) // 2 :]]]
    return rest, block


def _fit(sample: DataFrame, dim: int, blocks: int, rounds: int) -> np.ndarray:
    """Spherical k-means over the written sample; the driver sees centroids only, at most ``blocks``."""
    spark = sample.sparkSession
    least = sample.select("h").distinct().orderBy("h").limit(blocks).agg(F.max("h")).first()[0]
    first = sample.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).orderBy("h").select("v").collect()
    centres = np.array([np.frombuffer(r.v, np.float32) for r in first])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def add_up(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros_like(shared.value, np.float64)
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                np.add.at(sums, _nearest(x, shared.value, 1)[:, 0], x)
            held = np.flatnonzero(np.abs(sums).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(list(sums[held].astype(np.float32)), pa.list_(pa.float32()))], ["block", "s"])

        parts = sample.select("v").mapInArrow(add_up, "block int, s array<float>")
        total = F.aggregate(F.collect_list("s"), F.array_repeat(F.lit(0.0), dim), lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double")))
        # as many arrays a block as the sample has partitions: both are bounded
        for r in parts.groupBy("block").agg(total.alias("s")).collect():
            size = np.linalg.norm(r.s)
            if size > 0:
                centres[r.block] = np.asarray(r.s) / size
        shared.unpersist()
    return centres


def _index(joined: DataFrame, dim: int, n: int, leaves: int, probes: int, sample_per_block: int, rounds: int, group_rows: int) -> Index:
    """Cells fitted on a bounded sample, the leaves of each fitted in a task of its own, and the parts
    of a block's members and queries, by what a bounded sample sends there."""
    spark = joined.sparkSession
    place = F.pmod("h", F.lit(1 << 20))

    def share(rows: int) -> int:
        # rows with the least hashes: the same whatever their order or partition, none is preferred
        return int(np.ceil(min(1.0, rows / max(1, n)) * (1 << 20)))

    cells = max(1, int(np.sqrt(leaves) * 0.8))
    sample = cut(joined.where(place < share(cells * 100)))
    centres = _fit(sample, dim, cells, min(rounds, 4))
    shared = spark.sparkContext.broadcast(centres)

    def cell_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(_matrix(batch.column(0), dim), shared.value, 1)[:, 0], pa.int32()), *batch.columns], ["cell", "v", "h"])

    counts = {r.cell: r["count"] for r in sample.select("v", "h").mapInArrow(cell_of, "cell int, v binary, h bigint").groupBy("cell").count().collect()}
    scale = n / max(1, sum(counts.values()))
    rows_in = np.array([counts.get(c, 0) * scale for c in range(len(centres))])
    shares = np.minimum(min(1.0, leaves * sample_per_block / max(1, n)), CELL_ROWS / np.maximum(rows_in, 1))
    bounds, per_leaf = np.ceil(shares * (1 << 20)), sample_per_block

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cell_of(batches):
            taken = np.mod(batch.column(2).to_numpy(), 1 << 20) < bounds[batch.column(0).to_numpy()]
            yield batch.filter(pa.array(taken))

    def grow(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        x, centre = _matrix(table.column("v"), dim)[order], shared.value[cell]
        rest, block = _leaves(x, centre, max(1, int(np.ceil(len(x) / per_leaf))), rounds)
        step = np.maximum(np.abs(rest).max(1), 1e-30) / 127
        return pa.table([pa.array([cell], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (np.rint(rest / step[:, None]).astype(np.int8), step.astype(np.float32), block))], ["cell", "codes", "scale", "block"])

    grown = joined.select("v", "h").where(place < int(bounds.max())).mapInArrow(trained, "cell int, v binary, h bigint").groupBy("cell").applyInArrow(grow, "cell int, codes binary, scale binary, block binary")
    codes, steps, blocks, starts, done = [], [], [], np.zeros(len(centres) + 1, np.int64), 0
    held = {r.cell: (r.codes, r.scale, r.block) for r in grown.collect()}  # one row a cell
    alone = bytes(dim), np.ones(1, np.float32).tobytes(), np.zeros(1, np.int64).tobytes()  # its centre, so that every row meets a leaf
    for cell in range(len(centres)):
        code, step, block = held.get(cell, alone)
        steps.append(np.frombuffer(step, np.float32))
        codes.append(np.frombuffer(code, np.int8).reshape(-1, dim))
        blocks.append(np.frombuffer(block, np.int64) + done)
        starts[cell + 1], done = len(steps[-1]), blocks[-1].max() + 1
    ones = np.ones(done, np.int64)
    index = Index(centres, np.cumsum(starts), np.concatenate(codes), np.concatenate(steps), np.concatenate(blocks), ones, ones.copy())
    shared_index = spark.sparkContext.broadcast(index)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, block, lives = _probed(_matrix(batch.column(0), dim), shared_index.value, probes)
            asked, home = np.bincount(block), np.bincount(block[lives], minlength=block.max() + 1)
            held = np.flatnonzero(asked)
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(home[held], pa.int64()), pa.array(asked[held], pa.int64())], ["block", "home", "asked"])

    sized = joined.where(place < share(200_000)) if n > group_rows else sample
    loads = sized.select("v").mapInArrow(load, "block int, home bigint, asked bigint").groupBy("block").agg(F.sum("home").alias("home"), F.sum("asked").alias("asked"), F.sum(F.sum("home")).over(W.partitionBy()).alias("all"))
    for r in loads.collect():  # at most one row of the sample's a block
        scale = n / max(1, r["all"]) / group_rows
        index.member_parts[r.block], index.query_parts[r.block] = max(1, np.ceil(r.home * scale)), max(1, np.ceil(r.asked * scale / 2))
    shared_index.unpersist()
    return index


def nearest_neighbours(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "vector",
    k: int = 5,
    dim: int | None = None,
    probes: int = 64,
    leaf_rows: int = 20,
    max_blocks: int = 2_500_000,
    sample_per_block: int = 20,
    rounds: int = 8,
    group_rows: int = 20_000,
    exact_rows: int = 1000,
) -> DataFrame:
    """``(vec_id, neighbour, cosine, place)``: the k most similar other vectors of every vector.

    Ties go to the smaller id.  Leaves are fitted on about ``sample_per_block`` rows each; every row is
    indexed.  Up to ``exact_rows`` rows the join is exact.  ``probes`` only bounds the blocks that one
    vector queries; how many it needs is told by :func:`_probed`.  Defined
    cases: see :func:`unit_vectors` for vectors that take no part; a repeated id is one vector (its
    rows are equal, or any one of them is taken); fewer than k others give fewer rows; an empty table
    gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    unit, dim = unit_vectors(vectors, vec_id=vec_id, vector=vector, dim=dim)
    hashed = cut(unit)
    counts = hashed.groupBy("h").agg(F.count("*").alias("n"))
    hot = cut(counts.where(F.col("n") > k + 1))
    reduced = hot.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    n = hashed.count() - reduced["rows"] + reduced.groups * (k + 1)  # rows that are joined
    hot = hot.select("h")
    copies = None
    joined = hashed.select("vec_id", "v", "h", F.lit(True).alias("asks"))
    if reduced.groups:
        # the k+1 smallest ids of each value, within salted parts first
        part = W.partitionBy("h", "salt").orderBy("vec_id")
        whole = W.partitionBy("h").orderBy("vec_id")
        in_hot = hashed.join(counted(hot), "h").select("h", "vec_id").distinct()
        kept = in_hot.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
        kept = kept.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
        # rows of repeated ids may be no more than k others
        smallest = counted(cut(kept.groupBy("h").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).where(F.size("ids") > k)))
        others = F.slice(F.filter("ids", lambda x: x != F.col("vec_id")), 1, k)
        copies = in_hot.join(smallest, "h").select("vec_id", F.posexplode(others).alias("place", "neighbour"))
        copies = copies.select("vec_id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("place") + 1).alias("place"))
        joined = hashed.join(smallest, "h", "left").where(F.col("ids").isNull() | F.array_contains("ids", F.col("vec_id")))
        joined = joined.select("vec_id", "v", "h", F.col("ids").isNull().alias("asks"))

    leaves = int(min(max_blocks, n // leaf_rows)) if n > exact_rows else 1
    index = Index(np.zeros((1, dim), np.float32), np.array([0, 1]), np.zeros((1, dim), np.int8), np.ones(1, np.float32), np.zeros(1, np.int64), np.ones(1, np.int64), np.ones(1, np.int64))
    if leaves > 1:
        index = _index(joined, dim, n, leaves, probes, sample_per_block, rounds, group_rows)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 10_000):
                batch = whole_batch.slice(start, 10_000)
                ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                row, block, lives = _probed(_matrix(batch.column(1), dim), index, probes)
                m, q = index.member_parts[block], index.query_parts[block]
                # where it lives: its member part, for every part of the queries; where it asks: the other way
                home_member, home_query = ids[row] % m, (ids[row] // 7) % q
                asking = asks[row]
                pieces = []
                plain = (m == 1) & (q == 1) & (lives | asking)
                pieces.append((row[plain], block[plain], np.zeros(plain.sum(), np.int64), np.zeros(plain.sum(), np.int64), lives[plain], asking[plain]))
                for r, b, mm, qq, hm, hq, live, ask in zip(*(c[(m > 1) | (q > 1)].tolist() for c in (row, block, m, q, home_member, home_query, lives, asking))):
                    cells = {}
                    if live:
                        cells.update(((hm, c), [True, False]) for c in range(qq))
                    if ask:
                        for c in range(mm):
                            cells.setdefault((c, hq), [False, False])[1] = True
                    at = np.array(list(cells), np.int64).reshape(-1, 2)
                    flags = np.array(list(cells.values()), bool).reshape(-1, 2)
                    pieces.append((np.full(len(at), r), np.full(len(at), b), at[:, 0], at[:, 1], flags[:, 0], flags[:, 1]))
                row, block, mp, qp, lives, asking = (np.concatenate(c) for c in zip(*pieces))
                picked = batch.take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), pa.array(mp, pa.int32()), pa.array(qp, pa.int32()), pa.array(lives), pa.array(asking), picked.column(0), picked.column(1)],
                    ["block", "part", "turn", "member", "asks", "vec_id", "v"],
                )

    def multiply(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"), dim)
        member, asks = (table.column(c).to_numpy() for c in ("member", "asks"))
        # a repeated id is one vector
        member, asks = (held[np.unique(ids[held], return_index=True)[1]] for held in (np.flatnonzero(member), np.flatnonzero(asks)))
        found = [(i, b, s) for q, bs, ss in tile_top_k(x[asks], ids[asks], x[member], ids[member], k) for i, b, s in zip(q, bs, ss) if len(b)]
        columns = list(zip(*found)) if found else [(), (), ()]
        return pa.table(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.list_(pa.float64()))],
            ["vec_id", "ids", "cosines"],
        )

    placed = joined.select("vec_id", "v", "asks").mapInArrow(assign, "block int, part int, turn int, member boolean, asks boolean, vec_id bigint, v binary")
    best = placed.groupBy("block", "part", "turn").applyInArrow(multiply, "vec_id bigint, ids array<bigint>, cosines array<double>")
    # lists of k each, one for every block and member part that was asked: merged in the JVM, best first, ties to the smaller id
    pairs = F.arrays_zip(F.transform("cosines", lambda c: -c).alias("minus"), F.col("ids").alias("id"))
    merged = best.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))), 1, k).alias("best"))
    result = merged.select("vec_id", F.posexplode("best").alias("place", "b")).select(
        "vec_id", F.col("b.id").alias("neighbour"), (-F.col("b.minus")).alias("cosine"), (F.col("place") + 1).alias("place")
    )
    return result if copies is None else result.unionByName(copies)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``(vec_a, vec_b)``, vec_a < vec_b: one of them is among the other's k most similar."""
    return found.select(F.least("vec_id", "neighbour").alias("vec_a"), F.greatest("vec_id", "neighbour").alias("vec_b")).distinct()
