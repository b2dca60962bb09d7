"""Approximate nearest neighbours in learnt partitions: a balanced partition of a neighbour graph, and a classifier that routes to it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

SAMPLE = 4096  # the most vectors that the partition is learnt on
ROWS_PER_PART = 1000
MAX_PARTS = 64
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
GRAPH_DEGREE = 10
COVERAGE = 0.95  # share of sample neighbours that the probed parts must hold
QUERY_EVERY = 100


@dataclass(frozen=True)
class Router:
    """Softmax classifier over parts, and how many of the most probable ones a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts by falling probability, for each vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.argsort(-(unit @ self.weights + self.bias), axis=1, kind="stable")


def usable_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """row (unique), vec_id, vector: rows with an id and a vector of the commonest length, without null or non-finite components and not all zero. Written once."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    picked = table.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    picked = picked.where(~bad & F.exists("vector", lambda x: x != 0))
    picked = cut_lineage(picked.withColumn("row", F.monotonically_increasing_id()))
    usual = picked.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return picked.where(F.size("vector") == (usual["d"] if usual else 0))


def _nearest(vectors: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest others of each query row (places into `vectors`), in blocks."""
    out = np.empty((len(queries), k), dtype=np.int64)
    norms = (vectors * vectors).sum(1)
    for at in range(0, len(queries), 512):
        rows = queries[at:at + 512]
        d = norms[None, :] - 2 * vectors[rows] @ vectors.T
        d[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[at:at + 512] = near
    return out


def partition_graph(near: np.ndarray, parts: int, steps: int = 60) -> np.ndarray:
    """Part of each node of a neighbour graph, parts of equal size to within one node for each halving.

    Halves recursively at the median of the graph's second smoothest vector, found by repeated averaging over neighbours, then swaps the nodes that gain most, pairwise.
    """
    n, k = near.shape
    left, right = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.concatenate([left, right]), np.concatenate([right, left])
    label = np.zeros(n, dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64(5))
    groups = 1
    while groups < parts:
        inside = label[a] == label[b]
        x, y = a[inside], b[inside]
        degree = np.bincount(x, minlength=n) + 1e-9
        v = rng.standard_normal(n)
        for _ in range(steps):
            v = 0.5 * v + 0.5 * np.bincount(x, weights=v[y], minlength=n) / degree
            mean = np.bincount(label, weights=v * degree, minlength=groups) / np.bincount(label, weights=degree, minlength=groups)
            v -= mean[label]
            scale = np.sqrt(np.bincount(label, weights=v * v, minlength=groups)) + 1e-30
            v /= scale[label]
        order = np.lexsort((v, label))
        size = np.bincount(label, minlength=groups)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        half = (rank >= (size // 2)[label]).astype(np.int64)
        for _ in range(10):
            other = np.bincount(x, weights=half[y] != half[x], minlength=n)
            gain = 2 * other - np.bincount(x, minlength=n)
            moved = 0
            for g in range(groups):
                zero, one = (np.flatnonzero((label == g) & (half == h)) for h in (0, 1))
                zero, one = zero[np.argsort(-gain[zero])], one[np.argsort(-gain[one])]
                m = min(len(zero), len(one))
                good = int((gain[zero[:m]] + gain[one[:m]] > 2).sum()) // 2
                half[zero[:good]], half[one[:good]] = 1, 0
                moved += good
            if not moved:
                break
        label = 2 * label + half
        groups *= 2
    return label


def _softmax(vectors: np.ndarray, label: np.ndarray, parts: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient descent with per-weight rates."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    w, c = np.zeros((x.shape[1], parts)), np.zeros(parts)
    mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)
    target = np.eye(parts)[label]
    for t in range(1, steps + 1):
        z = x @ w + c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) / len(x)
        gw, gc = x.T @ g + 1e-5 * w, g.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        w -= 0.1 * (mw / (1 - 0.9 ** t)) / (np.sqrt(vw / (1 - 0.99 ** t)) + 1e-9)
        c -= 0.1 * (mc / (1 - 0.9 ** t)) / (np.sqrt(vc / (1 - 0.99 ** t)) + 1e-9)
    return w, c


def learn_router(sample: np.ndarray, parts: int, coverage: float = COVERAGE) -> Router:
    """Learns parts from a sample's neighbour graph, and probes just as many parts as hold `coverage` of the sample's neighbours."""
    n = len(sample)
    if parts < 2 or n <= GRAPH_DEGREE:
        return Router(np.zeros((sample.shape[1] if n else 1, 1)), np.zeros(1), 1)
    near = _nearest(sample, np.arange(n), GRAPH_DEGREE)
    router = Router(*_softmax(sample, partition_graph(near, parts), parts), parts)
    order = router.order(sample)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, 0), axis=1)
    needed = np.sort(rank[np.repeat(np.arange(n), GRAPH_DEGREE), order[near.ravel(), 0]])
    return Router(router.weights, router.bias, int(needed[min(len(needed) - 1, int(np.ceil(coverage * len(needed))) - 1)]) + 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest of a block for each query, by exact distance and then id. A product of matrices narrows a block down; what could be among the k is measured exactly."""
    out: tuple[list, list, list] = ([], [], [])
    norms = (vectors * vectors).sum(1)
    for at in range(0, len(queries), 256):
        some, own = queries[at:at + 256], query_ids[at:at + 256]
        length = (some * some).sum(1)
        d = norms[None, :] + length[:, None] - 2 * some @ vectors.T
        d[own[:, None] == ids[None, :]] = np.inf
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] if len(vectors) > k else np.full(len(some), np.inf)
        slack = 1e-9 * (length + norms.max())
        for i in range(len(some)):
            close = np.flatnonzero((d[i] <= limit[i] + slack[i]) & (d[i] < np.inf))
            exact = np.sqrt(((vectors[close] - some[i]) ** 2).sum(1))
            best = np.lexsort((ids[close], exact))[:k]
            out[0].append(np.full(len(best), own[i]))
            out[1].append(ids[close][best])
            out[2].append(exact[best])
    return out


def nearest_neighbours(table: DataFrame, k: int = 10, query_every: int = QUERY_EVERY, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `query_every` the k nearest others found, by Euclidean distance, ties to the smaller id.

    The router is fitted on at most `sample` vectors (those with the smallest hashes of their ids); every vector is indexed. The number of parts grows with the table up
    to MAX_PARTS. A part is searched in blocks of rows and of queries, so a part that holds most rows (repeated vectors) is only more tasks. Rows without an
    id, and vectors null, zero, of unusual length or with null or non-finite components take no part. Of rows that repeat a query's id one is the query, and none
    is its neighbour; other repeated rows all count. Fewer than k candidates are all returned; an empty table gives an empty result.
    """
    vectors = usable_vectors(table, id_column, vector_column)
    total = vectors.count()
    wanted = 1 << max(0, min(MAX_PARTS, total // ROWS_PER_PART).bit_length() - 1) if total >= 2 * ROWS_PER_PART else 1
    taken = vectors.orderBy(F.xxhash64("vec_id"), "row").limit(sample).select("vector").toArrow()  # bounded by `sample`
    router = learn_router(_matrix(taken.column(0)) if taken.num_rows else np.zeros((0, 1)), wanted)
    shipped = table.sparkSession.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shipped.value.order(_matrix(batch.column(2)))[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=[*batch.schema.names, "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                probes = shipped.value.order(_matrix(batch.column(1)))[:, :shipped.value.probes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    index = cut_lineage(vectors.select("row", "vec_id", "vector").mapInArrow(place, "row long, vec_id long, vector array<double>, part int"))
    chosen = vectors.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min_by("vector", "row").alias("vector")).withColumnRenamed("vec_id", "query_id")
    routed = chosen.mapInArrow(route, "query_id long, vector array<double>, parts array<int>").select("query_id", "vector", F.explode("parts").alias("part"))
    routed = cut_lineage(routed)

    def blocks(sizes: DataFrame, rows: int) -> F.Column:
        """Number of blocks of each part, as a list of at most MAX_PARTS entries."""
        counted = {r["part"]: r["count"] for r in sizes.groupBy("part").count().collect()}
        return F.element_at(F.array(*[F.lit(max(1, -(-counted.get(p, 0) // rows))) for p in range(router.parts)]), F.col("part") + 1)

    row_blocks, query_blocks = blocks(index, BLOCK_ROWS), blocks(routed, BLOCK_QUERIES)
    every_query_block = F.explode(F.sequence(F.lit(0), query_blocks - 1))
    every_row_block = F.explode(F.sequence(F.lit(0), row_blocks - 1))
    rows = index.select("part", F.pmod(F.xxhash64("row"), row_blocks).cast("int").alias("block"), every_query_block.alias("query_block"), "vec_id", "vector")
    asked = routed.select("part", every_row_block.alias("block"), F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("query_block"), "query_id", "vector")
    key = ["part", "block", "query_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            found = _search(_matrix(left.column("vector")), left.column("vec_id").to_numpy(), _matrix(right.column("vector")), right.column("query_id").to_numpy(), k)
        columns = [np.concatenate(c) if c else np.empty(0) for c in found]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    near = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)")
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
