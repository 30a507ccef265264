"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of equal size with few
edges between them; a small classifier learns in which parts a vector's
neighbours lie.  Every row is indexed under its most probable part, and a query
is compared exactly with all rows of the several parts it most probably needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors the index is fitted on at most (those of the smallest hash), whatever the input.
FIT_ROWS = 8192
#: Rows a part should have, and the least and the most parts; a power of two.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1024, 8, 256
#: Edges of a vector in the neighbour graph, and hidden units of the classifier.
EDGES, HIDDEN = 16, 128
#: A query is routed to parts until this much of its probability is covered.
COVERED = 0.95
#: Rows of a part that one task compares with a query, and rows and queries of one product.
BLOCK_ROWS, STEP, QUERIES = 65_536, 8192, 256
NEAREST, QUERY_EVERY = 10, 100


@dataclass(frozen=True)
class Router:
    """Two dense layers; ``dim`` is the length of the vectors it was fitted on."""

    dim: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def neighbour_graph(x: np.ndarray, edges: int = EDGES) -> np.ndarray:
    """The ``edges`` nearest rows of every row, in blocks."""
    k, norms = min(edges, len(x) - 1), (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = norms[None] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for every row: halves along the widest direction, then moved to where most neighbours are while there is room.

    Room is ``slack`` times the mean, so that no part outgrows the others.
    """
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        whole, label = label, np.empty_like(label)
        for part in np.unique(whole):
            own = np.flatnonzero(whole == part)
            centred = x[own] - x[own].mean(0)
            order = np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")
            label[own[order]] = 2 * part + (np.arange(len(own)) >= len(own) // 2)
    room = int(np.ceil(slack * len(x) / parts))
    # an edge counts in both directions
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (both[:, 0], label[both[:, 1]]), 1)
        best, now = votes.argmax(1), votes[np.arange(len(x)), label]
        gain = votes[np.arange(len(x)), best] - now
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit(x: np.ndarray, parts: int, epochs: int = 24, seed: int = 7) -> Router:
    """A classifier of the parts in which a row's neighbours, and the row itself, lie."""
    x = np.unique(x, axis=0)  # copies would be cut apart to balance the parts
    rng = np.random.default_rng(seed)
    dim, n = x.shape[1], len(x)
    if n < 2 * parts:
        parts = 1
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1)
    target[np.arange(n), label] += 1
    target /= target.sum(1, keepdims=True)
    # layers see vectors of mean length one
    scale = 1 / max(np.sqrt((x * x).sum(1).mean()), 1e-300)
    inputs = (x * scale).astype(np.float32)
    w = [rng.normal(0, np.sqrt(2 / dim) * np.sqrt(dim) / 4, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [p.astype(np.float32) for p in w]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 0.0003
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            a, y = inputs[rows], target[rows]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            e = np.exp(z - z.max(1, keepdims=True))
            back = (e / e.sum(1, keepdims=True) - y) / len(rows)
            hidden = (back @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((a.T @ hidden, hidden.sum(0), h.T @ back, back.sum(0))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Router(dim, w[0].astype(np.float64) * scale, w[1].astype(np.float64), w[2].astype(np.float64), w[3].astype(np.float64))


def usable(column: str) -> Column:
    """Vectors that take part: no null, no component null or not finite, not zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(F.forall(column, finite) & F.exists(column, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> list[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_length(vectors: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, np.stack([vectors[i] for i in at])


def routed(batches: Iterator[pa.RecordBatch], router: Router, blocks: int, every: int, covered: float) -> Iterator[pa.RecordBatch]:
    """Index rows and query rows: ``part, block, query, vec_id, vector``.

    A row is indexed under its most probable part, in one of ``blocks``; a query
    goes to every block of the parts it needs.  Vectors of another length than
    the router's have a part of their own for their length, searched whole.
    """
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
        part, block, asked, row = [], [], [], []
        for n, at, x in _by_length(vectors):
            if n == router.dim:
                p = router.probabilities(x)
                own, order = p.argmax(1), np.argsort(-p, axis=1, kind="stable")
                before = np.take_along_axis(p, order, 1).cumsum(1) - np.take_along_axis(p, order, 1)
                probes = [order[i][before[i] < covered] for i in range(len(at))]
            else:
                own, probes = np.full(len(at), -n), [[-n]] * len(at)
            for i, j in enumerate(at):
                part.append(own[i])
                block.append(int(ids[j]) * 0x9E3779B1 % 2**32 % blocks)
                asked.append(False)
                row.append(j)
                if ids[j] % every == 0:
                    for q in probes[i]:
                        part += [q] * blocks
                        block += range(blocks)
                        asked += [True] * blocks
                        row += [j] * blocks
        taken = pa.array(row, pa.int64())
        columns = [pa.array(part, pa.int64()), pa.array(block, pa.int64()), pa.array(asked, pa.bool_()), batch.column(0).take(taken), batch.column(1).take(taken)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "block", "query", "vec_id", "vector"])


def _nearest(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """For each query its ``k`` nearest rows of other ids: query's place, id, distance; ties to smaller ids.

    Products only choose what may be among them; distances are those of the
    vectors themselves.
    """
    norms = (x * x).sum(1)
    q_norms = (queries * queries).sum(1)
    kept: list[list[tuple[float, int]]] = [[] for _ in queries]
    for at in range(0, len(x), STEP):
        rows, these = x[at : at + STEP], ids[at : at + STEP]
        d = q_norms[:, None] + norms[None, at : at + STEP] - 2 * queries @ rows.T
        d[own[:, None] == these[None]] = np.inf
        # a product's rounding error, many times over
        slip = 1e-12 * (q_norms[:, None] + norms[None, at : at + STEP]).max(1) * queries.shape[1]
        reach = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + slip
        for i in range(len(queries)):
            worst = kept[i][-1][0] ** 2 + slip[i] if len(kept[i]) == k else np.inf
            maybe = np.flatnonzero((d[i] <= min(reach[i], worst)) & (own[i] != these))
            if len(maybe):
                exact = np.sqrt(((rows[maybe] - queries[i]) ** 2).sum(1))
                seen = dict.fromkeys(j for _, j in kept[i])
                order = np.lexsort((these[maybe], exact))
                new = [(float(exact[o]), int(these[maybe[o]])) for o in order[: k + len(seen)]]
                kept[i] = sorted(kept[i] + new)[:k]
    for i, found in enumerate(kept):
        for distance, j in found:
            yield i, j, distance


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by part and block, index rows before queries: rows are held for a block, queries pass by."""
    at, ids, x, fresh = None, [], [], True
    matrix = known = None
    for batch in batches:
        parts, blocks, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        vec_ids, vectors = batch.column(3).to_numpy(), _matrix(batch.column(4))
        out: list[tuple[int, int, float]] = []
        edge = np.flatnonzero((np.diff(parts) != 0) | (np.diff(blocks) != 0) | (np.diff(asked.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *edge], [*edge, len(parts)], strict=True):
            if a == b:
                continue
            if (parts[a], blocks[a]) != at:
                at, ids, x, fresh = (parts[a], blocks[a]), [], [], True
            if not asked[a]:
                ids.append(vec_ids[a:b])
                x.append(np.stack(vectors[a:b]))
            elif ids:
                if fresh:
                    known, matrix, fresh = np.concatenate(ids), np.concatenate(x), False
                    whole = np.unique(np.concatenate([known[:, None].view(np.float64), matrix], 1).view(np.int64), axis=0, return_index=True)[1]
                    known, matrix = known[np.sort(whole)], matrix[np.sort(whole)]  # repeated rows once
                for s in range(a, b, QUERIES):
                    e = min(b, s + QUERIES)
                    out += [(int(vec_ids[s + i]), j, d) for i, j, d in _nearest(np.stack(vectors[s:e]), vec_ids[s:e], matrix, known, k)]
        if out:
            q, j, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64())], ["query_id", "vec_id", "score"])


def parts_for(rows: int) -> int:
    """Parts of about PART_ROWS rows: a power of two between LEAST_PARTS and MOST_PARTS."""
    return int(min(MOST_PARTS, max(LEAST_PARTS, 2 ** int(np.log2(max(1, rows / PART_ROWS))))))


def nearest_neighbours(
    vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, fit_rows: int = FIT_ROWS, covered: float = COVERED, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id ``every`` divides, the ``k`` nearest rows found by Euclidean distance.

    Rows with a null id and vectors that are null, zero, or hold a null or
    non-finite component take no part; vectors are only compared with those of
    their length.  A query's own row is every row of its id; repeated rows count
    once, and of one id's different vectors the nearest.  Fewer than ``k``
    candidates: all of them; an empty table has no result.

    The index is fitted on ``fit_rows`` vectors at most, so what the driver holds
    and broadcasts does not grow with the input; every row is indexed.
    """
    held = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    rows = held.where(F.col("vec_id").isNotNull() & usable("vector"))
    total = rows.count()
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("vector").toArrow().column("vector").combine_chunks() if total else None
    sample = _matrix(first.chunk(0) if isinstance(first, pa.ChunkedArray) else first) if total else [np.ones(1)]
    lengths = np.array([len(v) for v in sample])
    common = int(np.bincount(lengths).argmax())
    router = fit(np.stack([v for v in sample if len(v) == common]), parts_for(total))
    # one part may hold all rows; even then a block is a bounded number of them
    blocks = 1 + total // BLOCK_ROWS
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(router)  # HIDDEN x (length + MOST_PARTS) numbers
    dealt = rows.mapInArrow(lambda b: routed(b, sent.value, blocks, every, covered), "part long, block long, query boolean, vec_id long, vector array<double>")
    placed = dealt.repartition("part", "block").sortWithinPartitions("part", "block", "query")
    found = placed.mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
