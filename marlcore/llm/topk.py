"""Op 6: exact top-k inner products by a pivot-distance index.

Vectors get one more coordinate, sqrt(M**2 - |v|**2) with M the largest norm, 0 for queries, so that the order of inner
products is the order of distances.  PIVOTS vectors, found on a bounded sample, are the index's pivots: every vector is keyed by
its nearest pivot and its distance to it, and each pivot's vectors are cut into rings (annuli) of about RING vectors, sorted
by distance.  A query first searches the ring where it lies itself, which bounds its k-th distance r; by the triangle
inequality only rings with distances in [d(q, p) - r, d(q, p) + r] of a pivot p whose cell can come so near can hold better
ones.  Those rings are searched, nearest first, and the search ends where no ring can.  Scores are whole-number products, exact as
doubles while squared lengths are below EXACT and as 64-bit integers beyond; lengths for which they might not fit 64 bits are an error.

Defined results: a vector that is null or has a null or non-finite component, or another length than most, takes no part;
ties go to the smaller vec_id; a query does not find its own row, but finds copies with another vec_id; fewer candidates than
k give fewer rows; rows that share a vec_id count as one candidate with their best score; a null vec_id takes no part; empty
tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Sample that pivots are fitted on, pivots, steps of the fit, vectors of a ring, most rings of a pivot, queries of a block.
SAMPLE, PIVOTS, STEPS, RING, MAX_RINGS, BLOCK = 4096, 32, 6, 2048, 256, 512
#: Squared length from which products are no longer exact as doubles, and from which they might not fit 64 bits.
EXACT, MOST = 2.0**52, 2.0**62


def _matrix(column, kind: type = np.float64) -> np.ndarray:
    return np.array(column.to_pylist(), kind).reshape(len(column), -1)


def fit_pivots(x: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """Centres of a few k-means steps, from a spread start."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(STEPS):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def _keyed(pivots: np.ndarray, norm2: float):
    """pivot and distance to it for batches of (vec_id, v)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            n2 = (x * x).sum(axis=1)
            lifted = np.hstack([x, np.sqrt(np.maximum(norm2 - n2, 0))[:, None]])
            d = np.sqrt(np.maximum(((lifted[:, None, :] - pivots[None]) ** 2).sum(axis=2) if len(x) * len(pivots) < 1 << 14 else norm2 + (pivots**2).sum(1) - 2 * lifted @ pivots.T, 0))
            near = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])], ["vec_id", "v", "pivot", "d"])

    return run


def _search(k: int, kind: type):
    """Best k of a ring for every query that comes to it; kind of number in which products are exact."""
    least = -np.inf if kind is np.float64 else np.iinfo(np.int64).min

    def run(ring, queries):
        import pyarrow as pa

        out = [[], [], []]
        if ring.num_rows and queries.num_rows:
            ids, x = ring.column("vec_id").to_numpy(), _matrix(ring.column("v").combine_chunks(), kind)
            once = len(np.unique(ids)) == len(ids)
            who = queries.column("query_id").to_numpy()
            q = _matrix(queries.column("q").combine_chunks(), kind)
            for low in range(0, len(who), BLOCK):
                score = q[low : low + BLOCK] @ x.T  # exact: whole numbers below 2**53, or integers of 64 bits
                for i, query in enumerate(who[low : low + BLOCK]):
                    s = np.where(ids == query, least, score[i])
                    if once and len(s) > 4 * k:
                        at = np.flatnonzero(s >= np.partition(s, -k)[-k])  # ties at the border included
                    else:
                        at = np.arange(len(s))
                    at = at[s[at] > least]
                    at = at[np.lexsort((ids[at], -s[at]))]
                    at = at[np.sort(np.unique(ids[at], return_index=True)[1])[:k]]  # each vec_id with its best score
                    out[0].append(np.full(len(at), query))
                    out[1].append(ids[at])
                    out[2].append(s[at].astype(np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(join(out[0]), pa.int64()), "vec_id": pa.array(join(out[1]), pa.int64()), "score": pa.array(join(out[2]), pa.int64())})

    return run


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as whole numbers (still doubles), of the rows that take part."""
    ok = F.expr("embedding is not null and size(embedding) > 0 and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('inf'))")
    # floor() gives a bigint, which large numbers overflow: these are whole already
    v = F.expr(f"transform(transform(embedding, x -> {scale}D * cast(x as double)), x -> if(abs(x) < 9e15D, cast(floor(if(abs(x) < 9e15D, x, 0D)) as double), x))")
    return vectors.filter(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def top_k(vectors: DataFrame, k: int = 10, query_every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose vec_id is divisible by query_every."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    base = whole_vectors(vectors)
    lengths = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    base = base.filter(F.size("v") == lengths[0])
    norm2 = float(base.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))).first()[0])
    if norm2 >= MOST:
        raise ValueError("components are too large: inner products would not fit 64 bits")
    kind = np.float64 if norm2 < EXACT else np.int64
    base = base.select("vec_id", F.expr("transform(v, x -> cast(x as bigint))").alias("v")).distinct()
    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").limit(SAMPLE).select("v").collect()], np.float64)
    lifted = np.hstack([sample, np.sqrt(np.maximum(norm2 - (sample**2).sum(1), 0))[:, None]])
    pivots = fit_pivots(lifted, min(PIVOTS, len(lifted)))
    index = materialize(base.mapInArrow(_keyed(pivots, norm2), "vec_id bigint, v array<bigint>, pivot int, d double"), "pivot-index")

    # rings: at most PIVOTS * MAX_RINGS edges
    per = index.groupBy("pivot").agg(F.count("*").alias("n")).collect()
    cuts = {}
    for n_rings in sorted({min(MAX_RINGS, max(1, -(-r.n // RING))) for r in per}):
        these = [r.pivot for r in per if min(MAX_RINGS, max(1, -(-r.n // RING))) == n_rings]
        at = [i / n_rings for i in range(1, n_rings)]
        got = index.filter(F.col("pivot").isin(these)).groupBy("pivot").agg(F.percentile_approx("d", at or [1.0], 10000).alias("c")).collect()
        cuts |= {r.pivot: sorted(set(r.c)) if at else [] for r in got}
    edges = spark.createDataFrame([(p, c) for p, c in cuts.items()], "pivot int, cuts array<double>")
    ringed = index.join(F.broadcast(edges), "pivot").withColumn("ring", F.expr("size(filter(cuts, c -> c < d))")).drop("cuts")
    rings = ringed.groupBy("pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n")).cache()
    # a ring of many equal distances is cut by hash, so that no task gets it whole
    shares = rings.select("pivot", "ring", "low", "high", F.expr(f"cast(ceil(n / {4 * RING}D) as int)").alias("shares"))
    shares = spark.createDataFrame(shares.collect(), shares.schema)  # at most PIVOTS * MAX_RINGS rows
    rings.unpersist()
    ringed = ringed.join(F.broadcast(shares.select("pivot", "ring", "shares")), ["pivot", "ring"]).withColumn("share", F.expr("cast(pmod(xxhash64(vec_id), shares) as int)"))
    ringed = materialize(ringed.select("pivot", "ring", "share", "vec_id", "v", "d"), "rings")

    far = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "pivot int, p array<double>")
    queries = ringed.filter(f"vec_id % {query_every} = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    # distances of queries (whose added coordinate is 0) to the pivots; a query's block is its id's
    lifted_q = F.expr("concat(transform(q, x -> cast(x as double)), array(0D))")
    to_pivot = queries.withColumn("lq", lifted_q).crossJoin(F.broadcast(far)).withColumn("dq", F.expr("sqrt(aggregate(zip_with(lq, p, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x))"))
    to_pivot = materialize(to_pivot.select("query_id", "pivot", "dq", F.expr("aggregate(q, 0D, (s, x) -> s + cast(x as double) * x)").alias("q2")), "query-pivots")
    queries = materialize(queries, "queries")

    def search(targets: DataFrame) -> DataFrame:
        """targets(query_id, pivot, ring, share): a query's vector joins only where it is searched for."""
        targets = targets.join(queries, "query_id")
        found = ringed.select("pivot", "ring", "share", "vec_id", "v").groupBy("pivot", "ring", "share").cogroup(targets.select("pivot", "ring", "share", "query_id", "q").groupBy("pivot", "ring", "share"))
        return found.applyInArrow(_search(k, kind), "query_id bigint, vec_id bigint, score bigint")

    each_share = F.explode(F.expr("sequence(0, shares - 1)")).alias("share")
    visits = to_pivot.join(F.broadcast(shares), "pivot")
    gap = F.expr("greatest(low - dq, dq - high, 0D)")
    first = visits.withColumn("order", F.row_number().over(Window.partitionBy("query_id").orderBy(gap, "dq", "pivot", "ring"))).filter("order <= 2")
    first = first.select("query_id", "pivot", "ring", each_share)
    near = materialize(search(first), "first-rings")
    # the k-th best score so far bounds the distance of the k-th neighbour
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = best.withColumn("rank", F.row_number().over(ranked)).filter(f"rank = {k}").select("query_id", F.col("score").alias("kth"))
    seen = first.select("query_id", "pivot", "ring").distinct()
    bounded = visits.join(kth, "query_id", "left").withColumn("r", F.expr(f"if(kth is null, double('inf'), sqrt(greatest({norm2!r}D + q2 - 2 * kth, 0D)) * (1 + 1e-9) + 1e-6)"))
    rest = bounded.filter(gap <= F.col("r")).join(seen, ["query_id", "pivot", "ring"], "left_anti").select("query_id", "pivot", "ring", each_share)
    every = near.unionByName(search(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = every.withColumn("rank", F.row_number().over(ranked)).filter(f"rank <= {k}")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
