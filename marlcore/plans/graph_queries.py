"""Neighbour, graph and density queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, neighbors as N
from .registry import E, PAIRS, knn_sql, query, r

K = 10
KNN = knn_sql(K)
MUTUAL = KNN + ", mu AS (SELECT a.src, a.dst, least(a.w, b.w) AS w FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src)"
JACCARD = (
    KNN + ", dg AS (SELECT src, count(*) AS n FROM k GROUP BY src), cm AS (SELECT a.src, a.dst, count(*) AS c FROM k a JOIN k x ON x.src = a.src JOIN k y ON y.src = a.dst AND y.dst = x.dst GROUP BY ALL), "
    "ja AS (SELECT k.src, k.dst, coalesce(c, 0) / (d1.n + d2.n - coalesce(c, 0)) AS w FROM k LEFT JOIN cm USING (src, dst) JOIN dg d1 ON d1.src = k.src JOIN dg d2 ON d2.src = k.dst)"
)


def edges(t):
    """Unit-weight mutual neighbour graph, both directions."""
    return N.mutual(N.knn_join(t.vectors, K)).select("src", "dst", F.lit(1.0).alias("w"))


def labels(t):
    return t.vectors.select("id", F.col("y").cast("bigint").alias("label"))


@query(f"WITH {KNN} SELECT src, dst, round(w, 6) AS w, CAST(rn AS INTEGER) AS rn FROM k")
def knn_edges(t):
    return N.knn_join(t.vectors, K).select("src", "dst", r("w").alias("w"), "rn")


@query(f"WITH {KNN.replace('list_distance(a.f, b.f)', '1 - list_cosine_similarity(a.f, b.f)')} SELECT src, dst, round(w, 6) AS w, CAST(rn AS INTEGER) AS rn FROM k")
def knn_cosine(t):
    return N.knn_join(t.vectors, K, "cosine").select("src", "dst", r("w").alias("w"), "rn")


@query(f"WITH {knn_sql(30)}, kk AS (SELECT greatest(5, least(30, CAST(floor(sqrt(count(*))) AS INTEGER))) AS k FROM e), m AS (SELECT avg(w) AS radius FROM k, kk WHERE rn <= kk.k) SELECT src, dst, round(w, 6) AS w FROM d, m WHERE w <= radius")
def radius_default(t):
    """Pairs within the mean distance to the nearest neighbours."""
    return N.radius_join(t.vectors).select("src", "dst", r("w").alias("w"))


@query(f"WITH {MUTUAL} SELECT src, dst, round(w, 6) AS w FROM mu")
def mutual_knn(t):
    return N.mutual(N.knn_join(t.vectors, K)).select("src", "dst", r("w").alias("w"))


@query(f"WITH {PAIRS} SELECT src, dst, round(w, 6) AS w FROM d WHERE w <= 1.16")
def radius_edges(t):
    return N.radius_join(t.vectors, 1.16).select("src", "dst", r("w").alias("w"))


@query(f"WITH {JACCARD} SELECT src, dst, round(w, 6) AS w FROM ja")
def jaccard_edges(t):
    return N.shared_neighbours(N.knn_join(t.vectors, K)).select("src", "dst", r("w").alias("w"))


@query(f"WITH {JACCARD}, p AS (SELECT ja.src, ja.dst, ja.w FROM ja JOIN (SELECT src, dst FROM k INTERSECT SELECT dst, src FROM k) USING (src, dst)) SELECT src, dst, round(w, 6) AS w FROM p WHERE w >= 0.1")
def shared_neighbour_graph(t):
    knn = N.knn_join(t.vectors, K)
    return N.shared_neighbours(knn).join(N.mutual(knn).select("src", "dst"), ["src", "dst"]).filter("w >= 0.1").select("src", "dst", r("w").alias("w"))


@query(f"WITH {MUTUAL}, s AS (SELECT src AS id, greatest(max(w), 1e-8) AS s FROM k GROUP BY src) SELECT mu.src, mu.dst, round(exp(-mu.w * mu.w / (a.s * b.s)), 6) AS w FROM mu JOIN s a ON a.id = mu.src JOIN s b ON b.id = mu.dst")
def selftuning_edges(t):
    knn = N.knn_join(t.vectors, K)
    return N.self_tuning(N.mutual(knn), N.bandwidths(knn)).select("src", "dst", r("w").alias("w"))


ADAPTIVE = knn_sql(15).replace(" k AS", " k15 AS") + ", mn AS (SELECT src AS id, avg(w) AS m FROM k15 GROUP BY src), ak AS MATERIALIZED (SELECT id, CAST(floor(5 + (m - lo) / (hi - lo) * 45) AS INTEGER) AS k FROM mn, (SELECT min(m) AS lo, max(m) AS hi FROM mn))"


@query(f"WITH {ADAPTIVE} SELECT id, k FROM ak")
def adaptive_k(t):
    return N.adaptive_k(N.knn_join(t.vectors, 15))


@query(
    f"""WITH {ADAPTIVE}, r50 AS MATERIALIZED (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS rn FROM d), o AS MATERIALIZED (SELECT r50.src, r50.dst, 1 / greatest(w, 1e-8) AS w FROM r50 JOIN ak ON ak.id = r50.src AND rn <= k)
    SELECT a.src, a.dst, round(least(a.w, b.w), 6) AS w FROM o a JOIN o b ON a.src = b.dst AND a.dst = b.src"""
)
def adaptive_neighbourhood(t):
    knn = N.knn_join(t.vectors, 50)
    return N.adaptive_neighbourhoods(knn, N.adaptive_k(knn.filter("rn <= 15"))).select("src", "dst", r("w").alias("w"))


@query(f"WITH {JACCARD} SELECT src, dst, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM (SELECT src, dst, round(w, 9) AS w FROM ja)) WHERE rn <= 5")
def degree_cap(t):
    e = N.shared_neighbours(N.knn_join(t.vectors, K)).withColumn("w", F.round("w", 9))
    return N.degree_cap(e, 5).select("src", "dst", r("w").alias("w"))


EDGES = MUTUAL + ", g AS (SELECT src, dst, 1.0::DOUBLE AS w FROM mu), dg AS (SELECT src AS id, sum(w) AS d FROM g GROUP BY src)"


@query(
    f"""WITH {EDGES}, x AS (SELECT 'unnormalised' AS kind, id AS src, id AS dst, d AS w FROM dg UNION ALL SELECT 'unnormalised', src, dst, -w FROM g
    UNION ALL SELECT k, id, id, 1.0 FROM dg, (VALUES ('random_walk'), ('symmetric')) v(k) UNION ALL SELECT 'random_walk', src, dst, -w / d FROM g JOIN dg ON id = src
    UNION ALL SELECT 'symmetric', src, dst, -w / sqrt(a.d * b.d) FROM g JOIN dg a ON a.id = src JOIN dg b ON b.id = dst) SELECT kind, src, dst, round(w, 6) + 0.0 AS w FROM x"""
)
def laplacian(t):
    e = edges(t)
    kinds = [G.laplacian(e, k).select(F.lit(k).alias("kind"), "src", "dst", r("w").alias("w")) for k in ("unnormalised", "random_walk", "symmetric")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(f"WITH {EDGES} SELECT src, dst, round(w / d, 6) AS w FROM g JOIN dg ON id = src")
def transition(t):
    return G.transition(edges(t)).select("src", "dst", r("w").alias("w"))


P2 = EDGES + ", p AS (SELECT src, dst, w / d AS w FROM g JOIN dg ON id = src), p2 AS (SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM p a JOIN p b ON a.dst = b.src GROUP BY ALL)"


@query(f"WITH {P2} SELECT src, dst, round(w, 6) AS w FROM p2")
def diffusion_t2(t):
    return G.diffusion(edges(t), 2).select("src", "dst", r("w").alias("w"))


@query(
    f"""WITH {P2}, pi AS (SELECT id, d / (SELECT sum(d) FROM dg) AS pi, y FROM dg JOIN e USING (id)),
    s AS (SELECT coalesce(sum(a.pi * p2.w), 0) AS s FROM p2 JOIN pi a ON a.id = p2.src JOIN pi b ON b.id = p2.dst AND a.y = b.y), c AS (SELECT sum(x * x) AS c FROM (SELECT sum(pi) AS x FROM pi GROUP BY y))
    SELECT round(s - c, 6) + 0.0 AS stability FROM s, c"""
)
def markov_stability(t):
    return G.markov_stability(edges(t), labels(t), 2).select(r("stability").alias("stability"))


@query(
    f"""WITH {EDGES}, f AS (SELECT a.y AS l, sum(w) AS vol, sum(CASE WHEN a.y <> b.y THEN w ELSE 0 END) AS cut, count(*) FILTER (a.y = b.y) AS same, count(*) AS n FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst GROUP BY a.y),
    kk AS (SELECT y AS l, coalesce(vol, 0) AS vol, coalesce(cut, 0) AS cut, coalesce(same, 0) AS same, coalesce(n, 0) AS n FROM (SELECT DISTINCT y FROM e) LEFT JOIN f ON l = y),
    t AS (SELECT sum(vol) AS total, sum(cut) AS allcut, count(*) AS c, sum(same) AS same, sum(n) AS n FROM kk),
    m AS (SELECT any_value(c) AS clusters, any_value((total - allcut) / total) AS coverage, sum((vol - cut) / total - (vol / total) * (vol / total)) AS modularity_ng,
        coalesce(avg(CASE WHEN vol > 0 THEN cut / vol END), 0) AS conductance_volume, coalesce(avg(CASE WHEN least(vol, total - vol) > 0 THEN cut / least(vol, total - vol) END), 0) AS conductance_smaller_side,
        sum(CASE WHEN vol > 0 THEN cut / vol ELSE 1e6 END) / any_value(c) AS ncut_mean, sum(CASE WHEN vol > 0 THEN cut / vol ELSE 0 END) AS ncut_sum, any_value(CAST(t.same AS DOUBLE) / t.n) AS preservation FROM kk, t)
    SELECT CAST(clusters AS BIGINT) AS clusters, round(coverage, 6) AS coverage, round(modularity_ng, 6) + 0.0 AS modularity_ng, round(conductance_volume, 6) AS conductance_volume, round(conductance_smaller_side, 6) AS conductance_smaller_side,
        round(ncut_mean, 6) AS ncut_mean, round(ncut_sum, 6) AS ncut_sum, round(preservation, 6) AS preservation, round(0.3 / (1 + ncut_sum) + 0.4 * modularity_ng + 0.3 * (1 - conductance_smaller_side), 6) + 0.0 AS edge_cut_score FROM m"""
)
def graph_cut_metrics(t):
    m = G.edge_cut_score(G.cut_metrics(edges(t), labels(t)))
    return m.select("clusters", *[r(c).alias(c) for c in m.columns if c != "clusters"])


REACH = "RECURSIVE "


def components_sql(nodes: str, links: str) -> str:
    return f"rc AS (SELECT id, id AS root FROM {nodes} UNION SELECT x.dst, rc.root FROM rc JOIN {links} x ON x.src = rc.id), cc AS (SELECT id, min(root) AS label FROM rc GROUP BY id)"


@query(f"WITH RECURSIVE {MUTUAL}, {components_sql('e', 'mu')} SELECT id, label FROM cc")
def components(t):
    return G.components_with_isolated(N.mutual(N.knn_join(t.vectors, K)), t.vectors.select("id"))


@query(f"WITH RECURSIVE {MUTUAL}, mi AS (SELECT src, dst FROM mu JOIN e a ON a.id = src JOIN e b ON b.id = dst AND a.y = b.y), {components_sql('e', 'mi')} SELECT y AS label, count(DISTINCT label) AS parts FROM cc JOIN e USING (id) GROUP BY y")
def topology_split(t):
    s = G.split_clusters(N.mutual(N.knn_join(t.vectors, K)), labels(t))
    return s.select(F.col("label").cast("int").alias("label"), "parts")


@query(
    f"""WITH RECURSIVE {PAIRS}, n AS (SELECT src, dst FROM d WHERE w <= 1.16), co AS (SELECT src AS id FROM n GROUP BY src HAVING count(*) + 1 >= 5), ci AS (SELECT src, dst FROM n WHERE src IN (SELECT id FROM co) AND dst IN (SELECT id FROM co)),
    {components_sql('co', 'ci')}, bo AS (SELECT src AS id, min(label) AS label FROM n JOIN cc ON cc.id = dst WHERE src NOT IN (SELECT id FROM co) GROUP BY src)
    SELECT e.id, coalesce(cc.label, bo.label, -1) AS label FROM e LEFT JOIN cc ON cc.id = e.id LEFT JOIN bo ON bo.id = e.id"""
)
def dbscan(t):
    return G.dbscan(t.vectors, 1.16, 5)


COORDS = "e AS (SELECT vec_id AS id, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS f, label AS y FROM embeddings)"


def spots(t):
    return t.vectors.withColumn("f", F.slice("f", 1, 2))


@query(
    f"""WITH {knn_sql(6).replace(E, COORDS)}, m AS (SELECT src AS id, dst AS o FROM k UNION ALL SELECT id, id FROM e), c AS (SELECT m.id, e.y, count(*) AS n FROM m JOIN e ON e.id = m.o GROUP BY ALL)
    SELECT id, CAST(y AS BIGINT) AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, y) AS rn FROM c) WHERE rn = 1"""
)
def majority_refine(t):
    return N.majority_refine(labels(t), N.knn_join(spots(t), 6))


@query(
    f"""WITH {knn_sql(6).replace(E, COORDS)}, m AS (SELECT src AS id, dst AS o FROM k UNION ALL SELECT id, id FROM e),
    l AS (SELECT vec_id AS o, unnest(range(len(embedding))) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) SELECT id, dim, round(avg(v), 6) + 0.0 AS v FROM m JOIN l USING (o) GROUP BY ALL"""
)
def spatial_smooth(t):
    return N.neighbour_mean(t.vectors, N.knn_join(spots(t), 6)).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("v"))


@query(
    f"""WITH {E}, a AS (SELECT * FROM e WHERE id % 2 = 0), b AS (SELECT * FROM e WHERE id % 2 = 1), d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.f, b.f) AS w FROM a CROSS JOIN b),
    x AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS r1, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS r2 FROM d) SELECT src, dst, round(w, 6) AS w FROM x WHERE r1 <= 3 AND r2 <= 3"""
)
def cross_slice_mnn(t):
    v = t.vectors
    return N.cross_mutual_neighbours(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), 3).select("src", "dst", r("w").alias("w"))


@query(
    f"""WITH {MUTUAL}, a AS (SELECT src, dst FROM mu UNION ALL SELECT id, id FROM e), dg AS (SELECT src AS id, count(*) AS d FROM a GROUP BY src),
    l AS (SELECT id, unnest(range(len(f))) AS dim, unnest(f) AS v FROM e) SELECT a.src AS id, dim, round(sum(v / sqrt(x.d * y.d)), 6) + 0.0 AS v FROM a JOIN dg x ON x.id = a.src JOIN dg y ON y.id = a.dst JOIN l ON l.id = a.dst GROUP BY ALL"""
)
def graph_convolution(t):
    return G.propagate(edges(t), t.vectors).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("v"))


@query(f"WITH {JACCARD}, s AS (SELECT src, dst FROM ja WHERE w < 0.1) SELECT k.src, k.dst, round(k.w, 6) AS w FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.src = k.src AND s.dst = k.dst) OR (s.src = k.dst AND s.dst = k.src))")
def shortcut_pruning(t):
    knn = N.knn_join(t.vectors, K).select("src", "dst", "w")
    return G.prune_edges(knn, N.shared_neighbours(knn).filter("w < 0.1")).select("src", "dst", r("w").alias("w"))


def _lpa_sql(rounds: int) -> str:
    out = EDGES + ", l0 AS (SELECT DISTINCT src AS id, src AS label FROM g)"
    for i in range(1, rounds + 1):
        out += f", l{i} AS (SELECT id, label FROM (SELECT g.src AS id, l.label, row_number() OVER (PARTITION BY g.src ORDER BY round(sum(g.w), 9) DESC, l.label) AS rn FROM g JOIN l{i - 1} l ON l.id = g.dst GROUP BY g.src, l.label) WHERE rn = 1)"
    return f"WITH {out} SELECT id, label FROM l{rounds}"


@query(_lpa_sql(3))
def label_propagation(t):
    return G.label_propagation(edges(t), 3)


@query()
def label_propagation_settled(t):
    """To a fixed point, or 100 rounds; label_propagation stops after the 3 rounds of its SQL."""
    return G.label_propagation(edges(t))


@query()
def markov_clustering(t):
    """Iterates to a fixed point; tested against a dense computation."""
    return G.mcl(edges(t))


@query()
def geodesic_distortion(t):
    """Median relative stretch of graph paths between all rows; iterative, tested against a dense computation."""
    e = N.mutual(N.knn_join(t.vectors, K))
    paths = G.all_shortest_paths(e, t.vectors.select("id"))
    return G.distortion(t.vectors, paths).select(r("distortion").alias("distortion"))
