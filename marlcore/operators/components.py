"""Connected components of an edge table: local forests, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, let_workers_import, materialize
from .skew import attach_groups

#: Edges that one task may join at most; larger forests go through the distributed rounds.
ONE_TASK, BLOCK = 1_000_000, 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices that aren't the smallest of their component, and that smallest vertex: hooking and pointer jumping on arrays."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    f = np.arange(len(v))
    while True:
        fx, fy = f[x], f[y]
        low = np.minimum(fx, fy)
        if np.array_equal(np.maximum(fx, fy), low):
            break
        np.minimum.at(f, fx, low)
        np.minimum.at(f, fy, low)
        while not np.array_equal(f, g := f[f]):
            f = g
    apart = f != np.arange(len(v))
    return v[apart], v[f[apart]]


def _forest(batches):
    """Edges (vertex, smallest vertex joined with it) of a partition, at most one for each vertex; BLOCK edges are held at once."""
    import pyarrow as pa

    a, b, size = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        size += batch.num_rows
        if size >= BLOCK:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, size = [x], [y], len(x) // 2
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        for low in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + 100_000]), pa.array(y[low : low + 100_000])], ["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.expr("pmod(xxhash64(a, b), 1000000007)"))).first())


def _with_roots(edges: DataFrame) -> DataFrame:
    roots = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """v, root for every vertex of edges(a, b) that has an edge to another one; root is its component's smallest vertex.

    Each partition first reduces its edges to a forest.  Up to ONE_TASK forest edges are joined by one task; beyond, each
    round joins a vertex's edges with the smallest vertex near it.  Hot vertices get it by a broadcast of bounded
    size, so a star of any degree is spread over all tasks.  The state is written out each round, which cuts lineage.
    """
    let_workers_import(edges.sparkSession)
    edges = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).filter("a <> b")
    edges = materialize(edges.mapInArrow(_forest, "a bigint, b bigint"), "edges")
    if (left := edges.count()) <= one_task:
        if left:
            whole = materialize(edges.coalesce(1).mapInArrow(_forest, "a bigint, b bigint"), "components")
            discard(edges)
            edges = whole
        return _with_roots(edges)
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of a vertex goes to the smallest vertex near it
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = attach_groups(both, least, "u", "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        # small star: every smaller neighbour of a vertex, and itself, goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = attach_groups(large, least, "u", "n", large.count())
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        before_edges, edges = edges, materialize(small, "small-star")
        discard(before_edges, large)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return _with_roots(edges)
