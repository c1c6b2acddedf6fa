"""Approximate nearest neighbours over learned partitions.

A bounded sample (``SAMPLE`` rows, those of least hash) gives a k-nearest-neighbour graph. The graph is cut into
partitions of equal size, about one for ``PART_ROWS`` rows of the table and ``MOST_PARTS`` at most, by recursive spectral
bisection: each half is split at the median of the slowest mode of the
neighbour-averaging operator. A softmax classifier then learns, from the vector alone, in which partitions the
neighbours of a vector lie. Every row of the table is indexed under its most probable partition; a query is routed to
its most probable partitions, as many as reach ``TARGET`` recall on the sample, and reranked there by exact cosine.

Of rows with equal vectors only those of the least ids can be among the nearest, one more than are asked for (a query's own
may be among them); these are chosen by a limit within each vector, taken before the shuffle as well, so a vector that a
third of all rows hold is a few candidates. Rows of one partition are packed into blocks of at most ``BLOCK`` vectors.
Queries, packed likewise, are sent to the partitions they probe; a partition of more than ``TOGETHER`` blocks is dealt
over salts in proportion to its own size.

Defined cases: null, zero or non-finite vectors, vectors of another length than the most frequent in the sample, and
rows without id take no part; of a query id with several vectors the least counts, in the order of arrays; a repeated row
is a candidate each time; ties go to the smaller vec_id; a row with the query's own vec_id is no candidate; vectors are
scaled by powers of two, which changes no cosine, so very large and very small components neither overflow nor vanish;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that the partitions and the classifier are fitted on.
SAMPLE = 8192
#: Rows of the table a partition stands for, least and most partitions; the most is the bound of a broadcast.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1024, 16, 256
GRAPH_K = 10
BLOCK, TOGETHER = 1024, 8
#: Rows that one task routes and packs, so that blocks fill however the input is dealt.
PACKED_ROWS = 32_768
TARGET = 0.97
TOP = 5


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, nearest first."""
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 512):
        near = unit[at : at + 512] @ unit.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[at : at + 512] = np.take_along_axis(top, order, 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 60) -> np.ndarray:
    """A partition number per node; sizes differ by at most the bisections' rounding."""
    n = len(graph)
    label = np.zeros(n, np.int64)
    rng = np.random.default_rng(7)
    groups = 1
    while groups < parts:
        value = rng.standard_normal(n)
        inside = label[graph] == label[:, None]
        rows, cols = np.repeat(np.arange(n), graph.shape[1])[inside.ravel()], graph[inside]
        degree = 1.0 + np.bincount(rows, minlength=n) + np.bincount(cols, minlength=n)
        size = np.bincount(label, minlength=groups)
        for _ in range(rounds):
            spread = value + np.bincount(rows, value[cols], n) + np.bincount(cols, value[rows], n)
            value = spread / degree
            value -= (np.bincount(label, value * degree, groups) / np.maximum(np.bincount(label, degree, groups), 1))[label]
            value /= np.sqrt(np.bincount(label, value**2, groups) / np.maximum(size, 1) + 1e-30)[label]
        order = np.lexsort((value, label))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        label = 2 * label + (rank >= (size[label] + 1) // 2)
        groups *= 2
    return label


def train_router(unit: np.ndarray, share: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from unit vectors to the share of their neighbours in each partition."""
    weight, bias = np.zeros((unit.shape[1], share.shape[1])), np.zeros(share.shape[1])
    m, v = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, rounds + 1):
        score = unit @ weight + bias
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gap = (p - share) / len(unit)
        grad = unit.T @ gap + 1e-5 * weight
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weight -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        bias -= 0.5 * gap.sum(0)
    return weight, bias


class Router:
    """What the sample taught: dimension, classifier, and how many partitions a query probes."""

    def __init__(self, sample: np.ndarray, parts: int = LEAST_PARTS, target: float = TARGET) -> None:
        self.dim, n = sample.shape[1], len(sample)
        unit = _unit(sample) if n else sample
        while parts > 1 and n < 16 * parts:
            parts //= 2
        self.parts = parts
        self.weight, self.bias, self.probes = np.zeros((self.dim, self.parts)), np.zeros(self.parts), 1
        if self.parts == 1:
            return
        graph = neighbour_graph(unit, GRAPH_K)
        label = balanced_parts(graph, self.parts)
        share = np.eye(self.parts)[label] + np.eye(self.parts)[label[graph]].sum(1)
        self.weight, self.bias = train_router(unit, share / share.sum(1, keepdims=True))
        order = self.order(unit)
        place = np.argsort(order, axis=1)
        needed = np.take_along_axis(place, order[:, 0][graph[:, :TOP]], 1)
        for self.probes in range(1, self.parts + 1):
            if (needed < self.probes).mean() >= target:
                break

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        return np.argsort(-(unit @ self.weight + self.bias), axis=1, kind="stable")


def _vectors(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and double vectors of the rows that take part."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    if dim is None or len(batch) == 0:
        return np.empty(0, np.int64), np.empty((0, dim or 0))
    size = pc.list_value_length(lists)
    fits = pc.fill_null(pc.and_(pc.equal(size, dim), pc.is_valid(ids)), False)
    ids, lists = ids.filter(fits), lists.filter(fits)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
    flat = flat[good]
    if len(flat):
        flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True))[1])
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), np.ascontiguousarray(flat)


def fit(vectors: DataFrame, sample: int = SAMPLE, parts: int | None = None, target: float = TARGET) -> Router | None:
    """Fit on the ``sample`` rows whose hash is least; null if no row takes part. Partitions follow the table's rows."""
    if parts is None:
        parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << round(np.log2(max(1, vectors.count() / PART_ROWS)))))
    chosen = (
        vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
        .select("vec_id", "embedding")
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .limit(sample)
        .toArrow()
    )
    lengths = [len(x) for x in chosen.column("embedding").to_pylist()]
    if not lengths:
        return None
    dim = max(set(lengths), key=lambda k: (lengths.count(k), k))
    found = [_vectors(b, dim)[1] for b in chosen.to_batches()]
    return Router(np.concatenate(found), parts, target)


_KINDS = [pa.int32(), pa.binary(), pa.binary()]


def _packed(parts: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """(part, ids, vecs) blocks of at most ``BLOCK`` vectors; parts: (row, partition) of each vector to pack."""
    out = []
    for p in np.unique(parts[:, 1]).tolist():
        rows = parts[parts[:, 1] == p, 0]
        for at in range(0, len(rows), BLOCK):
            own = rows[at : at + BLOCK]
            out.append((p, ids[own].tobytes(), np.ascontiguousarray(x[own]).tobytes()))
    columns = zip(*out) if out else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], ["part", "ids", "vecs"])


def blocks(vectors: DataFrame, router: Router, probes: int) -> DataFrame:
    """(part, ids, vecs): every row, packed, under its ``probes`` most probable partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held))
            probed = router.order(_unit(x))[:, :probes]
            rows = np.repeat(np.arange(len(x)), probed.shape[1])
            return _packed(np.stack([rows, probed.ravel()], 1), ids, x)

        for batch in batches:
            held.append(_vectors(batch, router.dim))
            size += len(held[-1][0])
            if size >= PACKED_ROWS:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    vectors = cut(vectors.select("vec_id", "embedding"))
    tasks = max(1, -(-vectors.count() // PACKED_ROWS))
    return vectors.repartition(tasks).mapInArrow(run, "part int, ids binary, vecs binary")


def candidates(vectors: DataFrame, top: int) -> DataFrame:
    """The rows of ``vectors`` that can be among the ``top`` nearest: of equal vectors, those of the least ids."""
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.where("vec_id is not null").withColumn("_place", F.dense_rank().over(alike)).where(f"_place <= {top + 1}")
    again = Window.partitionBy("embedding", "vec_id").orderBy("_place")
    return few.withColumn("_turn", F.row_number().over(again)).where(f"_turn <= {top}").select("vec_id", "embedding")


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the ``top`` nearest of each query within a block.

    A matrix product finds the candidates; those within rounding of the last place are scored again one by one, in an
    order of additions that is the same for equal vectors, so that ties stay ties.
    """
    rough = _unit(q) @ _unit(x).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    k = min(top, len(ids))
    last = np.partition(rough, -k, axis=1)[:, -k] - 1e-9
    row, col = np.nonzero((rough >= last[:, None]) & np.isfinite(rough))
    score = np.concatenate(
        [
            (q[row[a : a + 65536]] * x[col[a : a + 65536]]).sum(1)
            / (np.sqrt((q[row[a : a + 65536]] ** 2).sum(1)) * np.sqrt((x[col[a : a + 65536]] ** 2).sum(1)))
            for a in range(0, len(row), 65536)
        ]
        or [np.empty(0)]
    )
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < top
    return query_ids[row[keep]], ids[col[keep]], score[keep]


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, router: Router | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows of ``vectors`` for each row of ``queries``."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    queries = queries.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    queries = queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    router = router or fit(vectors)
    result = "query_id long, vec_id long, score double"
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = best(
                    np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["query_vecs"]).reshape(-1, router.dim),
                    np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vecs"]).reshape(-1, router.dim), top,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["query_id", "vec_id", "score"])

    own = cut(blocks(candidates(vectors, top), router, 1))
    sizes = F.broadcast(own.groupBy("part").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts")))  # a row a partition
    dealt = own.join(sizes, "part").withColumn("salt", F.pmod(F.xxhash64("ids"), F.col("salts")).cast("int"))
    asked = blocks(queries, router, router.probes).join(sizes, "part")
    asked = asked.select(
        "part", F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    )
    found = dealt.join(asked, ["part", "salt"]).select("query_ids", "query_vecs", "ids", "vecs").mapInArrow(run, result)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(f"rank <= {top}").select("query_id", "rank", "vec_id", "score")
