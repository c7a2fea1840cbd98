"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph. The graph is cut into balanced parts, as few
edges as possible between them, and a small network learns in which parts a vector's neighbours
lie. Every vector of the table is indexed under its most probable part; a query goes to its most
probable parts, whose vectors are ranked by their exact inner products.

Edge cases: rows without id, and vectors that are null, zero, hold null or non-finite components or
differ in length from most others, take no part; among equal products smaller ids come first; rows
that repeat an id as a query are one query; with fewer candidates than asked for, all are returned;
without any valid vector the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .worker import lean

#: Bounds of what is fitted on the driver: vectors of the sample, parts, neighbours in the graph.
SAMPLE, MOST_PARTS, DEGREE = 8192, 256, 10
#: Vectors, and queries, that meet in one task.
_CHUNK = 8192


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id long, vector array<double>) of the rows that take part, apart from their length."""
    vector = F.col(vec_col).cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vector, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), fine.alias("fine")).filter(F.col("vec_id").isNotNull() & F.coalesce("fine", F.lit(False))).drop("fine")


def neighbour_graph(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the edges from each vector to its nearest others by inner product, in both directions."""
    n = len(x)
    k = min(degree, n - 1)
    near = np.empty((n, k), np.int64)
    for lo in range(0, n, 1024):
        score = x[lo : lo + 1024] @ x.T
        score[np.arange(len(score)), np.arange(lo, lo + len(score))] = -np.inf
        near[lo : lo + 1024] = np.argpartition(-score, k - 1, axis=1)[:, :k] if k else 0
    a, b = np.repeat(np.arange(n), k), near.reshape(-1)
    return np.concatenate([a, b]), np.concatenate([b, a])


def _halves(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``nodes`` (ends of edges number into them) go to the second of two equal halves."""
    m = len(nodes)
    degree = np.maximum(np.bincount(a, minlength=m), 1).astype(float)
    root = np.sqrt(degree)
    base = root / np.linalg.norm(root)
    v = np.random.default_rng(m).standard_normal(m)
    for _ in range(40):  # towards the second eigenvector of the normalised adjacency, shifted to be positive
        v -= base * (base @ v)
        v = v / max(np.linalg.norm(v), 1e-300)
        v = v + np.bincount(a, weights=(v / root)[b], minlength=m) / root
    v -= base * (base @ v)
    side = np.zeros(m, bool)
    side[np.argsort(v / root, kind="stable")[m // 2 :]] = True
    for _ in range(6):  # swap the nodes that gain most, as many from either side
        outside = np.bincount(a, weights=side[a] != side[b], minlength=m)
        gain = 2 * outside - degree
        zero, one = (np.flatnonzero((side == s) & (gain > 0)) for s in (False, True))
        many = min(len(zero), len(one)) // 2
        if not many:
            break
        side[zero[np.argsort(-gain[zero], kind="stable")[:many]]] = True
        side[one[np.argsort(-gain[one], kind="stable")[:many]]] = False
    return side


def balanced_parts(n: int, a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """A part for each of ``n`` nodes, all of nearly equal size; ``parts`` is a power of two."""
    part = np.zeros(n, np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            nodes = np.flatnonzero(part == p)
            number = np.full(n, -1)
            number[nodes] = np.arange(len(nodes))
            inside = (number[a] >= 0) & (number[b] >= 0)
            part[nodes[_halves(nodes, number[a[inside]], number[b[inside]])]] += count
        count *= 2
    return part


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer; ``scale`` divides vectors before it."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x / self.scale).astype(np.float32) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, target: np.ndarray, hidden: int = 160, epochs: int = 40, seed: int = 7) -> Router:
    """Learns each vector's distribution over parts by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    scale = float(np.sqrt((x * x).sum(axis=1).mean()) / np.sqrt(x.shape[1])) or 1.0
    z, t = (x / scale).astype(np.float32), target.astype(np.float32)
    sizes = [(z.shape[1], hidden), (hidden, t.shape[1])]
    p = [w for a, b in sizes for w in ((rng.standard_normal((a, b)) * np.sqrt(2 / a)).astype(np.float32), np.zeros(b, np.float32))]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 256):
            at = order[lo : lo + 256]
            h = np.maximum(z[at] @ p[0] + p[1], 0)
            out = h @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            d = (out / out.sum(axis=1, keepdims=True) - t[at]) / len(at)
            dh = (d @ p[2].T) * (h > 0)
            grads, step = [z[at].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)], step + 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *p)


def fit(sample: np.ndarray, parts: int) -> Router:
    """Graph, parts and network from the distinct vectors of a sample."""
    x = np.unique(sample, axis=0)
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    if parts == 1:
        d = x.shape[1]
        return Router(1.0, np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    a, b = neighbour_graph(x, DEGREE)
    part = balanced_parts(len(x), a, b, parts)
    half = len(a) // 2
    target = np.zeros((len(x), parts))
    np.add.at(target, (a[:half], part[b[:half]]), 1.0)
    target[np.arange(len(x)), part] += 2.0
    return fit_router(x, target / target.sum(axis=1, keepdims=True))


def probes_for(router: Router, indexed: np.ndarray, asked: np.ndarray, k: int, recall: float) -> int:
    """How many of its most probable parts a query has to visit for a recall, measured on held-out vectors."""
    parts = len(router.b2)
    if parts == 1 or not len(asked) or not len(indexed):
        return parts
    part = router.logits(indexed).argmax(axis=1)
    order = np.argsort(-router.logits(asked), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(parts), order.shape), axis=1)
    k = min(k, len(indexed))
    near = np.argpartition(-(asked @ indexed.T), k - 1, axis=1)[:, :k]
    needed = np.take_along_axis(place, part[near], axis=1)
    found = np.cumsum(np.bincount(needed.reshape(-1), minlength=parts)) / needed.size
    return int(np.searchsorted(found, recall)) + 1


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def top_of_chunk(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Each query's ``k`` best of some candidates, by product, then id.

    Of equal vectors only the ``k + 1`` smallest ids can be among them. Products of matrices decide
    who is close; those are computed again one by one, so that equal vectors have equal products.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    rank = np.arange(len(ids)) - np.searchsorted(sorted_group, sorted_group)
    stay = np.sort(by_group[rank <= k])
    ids, x = ids[stay], x[stay]
    out = []
    for lo in range(0, len(q), 256):
        score = q[lo : lo + 256] @ x.T
        for i, row in enumerate(score, lo):
            row[ids == query_ids[i]] = -np.inf
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - 1e-9 * max(1.0, abs(row[np.isfinite(row)]).max(initial=0))) if len(row) > k else np.arange(len(row))
            near = near[ids[near] != query_ids[i]]
            exact = (x[near] * q[i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out += [(int(query_ids[i]), int(ids[near[j]]), float(exact[j])) for j in best]
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest that each query finds.

    ``is_query`` is a condition on ``vec_id``. A query visits as many parts as held-out vectors of the
    sample need for ``recall``, and more while these hold too few vectors.
    """
    vectors = valid_vectors(rows, id_col, vec_col)
    lengths = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = rows.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, total = lengths["d"], lengths["count"]
    vectors = vectors.filter(F.size("vector") == d)
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vector").toArrow()["vector"], d)
    parts = 1
    while parts < MOST_PARTS and parts * parts * 16 < total:
        parts *= 2
    distinct = np.random.default_rng(11).permutation(np.unique(sample, axis=0))
    held_out, fitted = np.split(distinct, [min(512, len(distinct) // 8)])
    router = fit(fitted, parts)
    parts = len(router.b2)
    probes = probes_for(router, fitted, held_out, k, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.logits(_matrix(batch.column(1), d)).argmax(axis=1) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], names=["vec_id", "vector", "part"])

    indexed = written(vectors.mapInArrow(lean(index), "vec_id long, vector array<double>, part int"), "indexed")
    held = np.zeros(parts, np.int64)
    for part, many in indexed.groupBy("part").count().collect():  # at most MOST_PARTS rows
        held[part] = many

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, part = [], []
            if len(batch):
                best = np.argsort(-router.logits(_matrix(batch.column(1), d)), axis=1, kind="stable")
                for i, order in enumerate(best):
                    enough = int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1
                    to = order[: max(probes, enough)]
                    to = to[held[to] > 0]
                    at += [i] * len(to)
                    part += to.tolist()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(part, pa.int32())], names=["query_id", "query", "part"])

    queries = written(vectors.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query")), "queries")
    routed = queries.mapInArrow(lean(route), "query_id long, query array<double>, part int")
    # A part with many vectors is searched in chunks, and so are its queries: a task has a chunk of both.
    chunks = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // _CHUNK))) for n in held]), F.col("part") + 1)
    asks = max(1, -(-queries.count() // _CHUNK))
    routed = routed.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("ask", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(asks)).cast("int"))
    dealt = indexed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))

    def search(found: pa.Table, asked: pa.Table) -> pa.Table:
        if len(found) and len(asked):
            got = top_of_chunk(found["vec_id"].to_numpy(), _matrix(found["vector"], d), asked["query_id"].to_numpy(), _matrix(asked["query"], d), k)
        else:
            got = []
        columns = list(zip(*got)) or [(), (), ()]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    best = dealt.groupBy("part", "chunk", "ask").cogroup(routed.groupBy("part", "chunk", "ask")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
