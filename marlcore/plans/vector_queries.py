"""Feature-table queries over embeddings: scaling, selection, centroids, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, vectors as V
from .registry import E, LONG, PAIRS, knn_sql, query, r


@query(f"WITH {LONG}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY dim) SELECT id, dim, round(coalesce((v - m) / nullif(sd, 0), 0), 6) + 0.0 AS z FROM l JOIN s USING (dim)")
def emb_zscore(t):
    return V.standardise(t.vectors).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("z"))


@query(f"WITH {LONG}, s AS (SELECT dim, min(v) AS a, max(v) AS b FROM l GROUP BY dim) SELECT id, dim, round(coalesce((v - a) / nullif(b - a, 0), 0), 6) + 0.0 AS z FROM l JOIN s USING (dim)")
def emb_minmax(t):
    return V.min_max(t.vectors).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("z"))


@query(f"WITH {LONG}, n AS (SELECT id, sqrt(sum(v * v)) AS n FROM l GROUP BY id) SELECT id, dim, round(CASE WHEN n = 0 THEN 0 ELSE v / n END, 6) + 0.0 AS v FROM l JOIN n USING (id)")
def emb_l2(t):
    return V.long_form(V.l2_normalise(t.vectors)).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("v"))


@query(f"WITH {LONG}, m AS (SELECT dim, median(v) AS m FROM l GROUP BY dim), d AS (SELECT dim, median(abs(v - m)) AS mad FROM l JOIN m USING (dim) GROUP BY dim) SELECT dim, round(mad, 6) AS mad FROM d ORDER BY d.mad DESC, dim LIMIT 10")
def emb_mad_topk(t):
    return V.top_features(V.median_absolute_deviation(V.long_form(t.vectors)), "mad", 10).select(F.col("dim").cast("bigint").alias("dim"), r("mad").alias("mad"))


@query(f"WITH {LONG} SELECT y AS label, dim, round(avg(v), 6) + 0.0 AS c FROM l GROUP BY ALL")
def emb_centroids(t):
    return V.centroids(t.vectors).select("label", F.col("dim").cast("bigint").alias("dim"), r("c").alias("c"))


CENTRES = LONG + ", c AS (SELECT label, list(c ORDER BY dim) AS c FROM (SELECT y AS label, dim, avg(v) AS c FROM l GROUP BY ALL) GROUP BY label)"
NEAREST = CENTRES + ", p AS (SELECT id, y, label, list_distance(f, c) AS d FROM e CROSS JOIN c), a AS (SELECT id, y, label, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, label) AS rn FROM p) WHERE rn = 1)"


@query(f"WITH {NEAREST} SELECT id, label, round(d, 6) AS d FROM a")
def emb_nearest_centroid(t):
    return V.assign_nearest(t.vectors, V.centroid_arrays(t.vectors)).select("id", "label", r("d").alias("d"))


@query(
    f"""WITH {NEAREST}, k AS (SELECT DISTINCT y AS c FROM a UNION SELECT DISTINCT label FROM a),
    f AS (SELECT c, 2.0 * count(*) FILTER (y = c AND label = c) / (count(*) FILTER (y = c) + count(*) FILTER (label = c)) AS f1 FROM a CROSS JOIN k GROUP BY c)
    SELECT round((SELECT avg(CAST(y = label AS DOUBLE)) FROM a), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f"""
)
def emb_confusion_f1(t):
    near = V.assign_nearest(t.vectors, V.centroid_arrays(t.vectors))
    return metrics.accuracy_macro_f1(near, "y", "label").select(r("accuracy").alias("accuracy"), r("macro_f1").alias("macro_f1"))


def ari_sql(source: str, a: str, b: str) -> str:
    return f"""t AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} GROUP BY ALL),
    s AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS ab, sum(n * ln(n)) AS hab FROM t),
    ra AS (SELECT sum(m * (m - 1) / 2) AS pa, sum(m * ln(m)) AS ha FROM (SELECT sum(n) AS m FROM t GROUP BY a)),
    rb AS (SELECT sum(m * (m - 1) / 2) AS pb, sum(m * ln(m)) AS hb FROM (SELECT sum(n) AS m FROM t GROUP BY b)),
    x AS (SELECT *, pa * pb / (n * (n - 1) / 2.0) AS e, ln(n) - ha / n AS ea, ln(n) - hb / n AS eb, ln(n) + (hab - ha - hb) / n AS mi FROM s, ra, rb)
    SELECT round((ab - e) / ((pa + pb) / 2.0 - e), 6) + 0.0 AS ari, round(greatest(0, 2 * mi / (ea + eb)), 6) + 0.0 AS nmi, CAST(n AS BIGINT) AS n FROM x"""


@query(f"WITH {NEAREST}, {ari_sql('a', 'y', 'label')}")
def ari_nmi_centroid(t):
    near = V.assign_nearest(t.vectors, V.centroid_arrays(t.vectors))
    return metrics.ari_nmi(near, "y", "label").select(r("ari").alias("ari"), r("nmi").alias("nmi"), "n")


@query(f"WITH {ari_sql('documents', 'lang', 'source')}")
def batch_vs_bio(t):
    """Association of two categorical columns: the data health check."""
    return metrics.ari_nmi(t.documents, "lang", "source").select(r("ari").alias("ari"), r("nmi").alias("nmi"), "n")


@query(
    f"""WITH {PAIRS}, s AS (SELECT src, y1, y2, avg(w) AS m, count(*) AS n FROM d GROUP BY ALL),
    z AS (SELECT y AS y1, count(*) AS size FROM e GROUP BY y),
    p AS (SELECT src, y1, max(m) FILTER (y1 = y2) AS a, min(m) FILTER (y1 <> y2) AS b FROM s GROUP BY ALL)
    SELECT y1 AS label, round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette, count(*) AS n FROM p JOIN z USING (y1) GROUP BY y1"""
)
def silhouette_exact(t):
    s = metrics.silhouette_samples(t.vectors)
    return s.groupBy(F.col("label").cast("int").alias("label")).agg(r(F.avg("s")).alias("silhouette"), F.count("*").alias("n"))


@query(
    f"""WITH {PAIRS.replace("list_distance(a.f, b.f)", "1 - list_cosine_similarity(a.f, b.f)")}, s AS (SELECT src, y1, y2, avg(w) AS m, count(*) AS n FROM d GROUP BY ALL),
    z AS (SELECT y AS y1, count(*) AS size FROM e GROUP BY y),
    p AS (SELECT src, y1, max(m) FILTER (y1 = y2) AS a, min(m) FILTER (y1 <> y2) AS b FROM s GROUP BY ALL)
    SELECT y1 AS label, round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette, count(*) AS n FROM p JOIN z USING (y1) GROUP BY y1"""
)
def silhouette_cosine(t):
    s = metrics.silhouette_samples(t.vectors, metric="cosine")
    return s.groupBy(F.col("label").cast("int").alias("label")).agg(r(F.avg("s")).alias("silhouette"), F.count("*").alias("n"))


@query(
    f"""WITH {LONG}, g AS (SELECT dim, avg(v) AS m FROM l GROUP BY dim), c AS (SELECT y, dim, avg(v) AS c, count(*) AS n, var_pop(v) * count(*) AS w FROM l GROUP BY ALL),
    s AS (SELECT sum(n * (c - m) * (c - m)) AS b, sum(w) AS w, count(DISTINCT y) AS k FROM c JOIN g USING (dim))
    SELECT round(b * (n - k) / (w * (k - 1)), 6) AS ch, k, n FROM s, (SELECT count(*) AS n FROM e)"""
)
def ch_index(t):
    return metrics.calinski_harabasz(t.vectors).select(r("ch").alias("ch"), "k", "n")


@query(
    f"""WITH {CENTRES}, s AS (SELECT y AS label, avg(list_distance(f, c.c)) AS s, any_value(c.c) AS c FROM e JOIN c ON c.label = y GROUP BY y),
    m AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS db FROM m"""
)
def db_index(t):
    return metrics.davies_bouldin(t.vectors).select(r("db").alias("db"))


@query(
    f"""WITH {knn_sql(9)}, core AS (SELECT src AS id, max(w) AS core FROM k GROUP BY src), m AS (SELECT avg(m) AS m FROM (SELECT median(core) AS m FROM core JOIN e USING (id) GROUP BY y)),
    s AS (SELECT avg(d) AS s FROM (SELECT y1, min(w) AS d FROM d WHERE y1 <> y2 GROUP BY y1)) SELECT round((s - m) / greatest(s, m), 6) + 0.0 AS score FROM m, s"""
)
def dbcv_lite(t):
    return metrics.dbcv_lite(t.vectors).select(r("score").alias("score"))


@query(
    f"""WITH {PAIRS}, s AS (SELECT src, y1, sum(w) FILTER (y1 = y2) AS s FROM d GROUP BY ALL),
    m AS (SELECT y1, src, s, row_number() OVER (PARTITION BY y1 ORDER BY s, src) AS rn FROM s) SELECT y1 AS label, src AS id, round(s, 5) AS s FROM m WHERE rn = 1"""
)
def emb_medoids(t):
    return V.medoids(t.vectors).select(F.col("label").cast("int").alias("label"), "id", r("s", 5).alias("s"))


@query(
    f"""WITH {CENTRES}, k AS (SELECT id, label, 1 / (1 + pow(list_distance(f, c.c), 2)) AS k FROM e CROSS JOIN c), q AS (SELECT id, label, k / sum(k) OVER (PARTITION BY id) AS q FROM k),
    s AS (SELECT id, label, q, q * q / sum(q) OVER (PARTITION BY label) AS s FROM q) SELECT id, label, round(q, 6) AS q, round(s / sum(s) OVER (PARTITION BY id), 6) AS p FROM s"""
)
def soft_assign(t):
    return V.soft_assignment(t.vectors, V.centroid_arrays(t.vectors)).select("id", "label", r("q").alias("q"), r("p").alias("p"))


@query(
    f"""WITH {LONG}, g AS (SELECT y AS label, dim, avg(v) AS m, var_pop(v) + 1e-6 AS s, count(*) AS n FROM l GROUP BY ALL),
    p AS (SELECT l.id, g.label, ln(any_value(g.n) / (SELECT count(*) FROM e)) - 0.5 * sum(ln(2 * pi() * s) + (v - m) * (v - m) / s) AS score FROM l JOIN g USING (dim) GROUP BY ALL)
    SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rn FROM p) WHERE rn = 1"""
)
def gmm_map(t):
    return V.gaussian_assignment(t.vectors)


@query(f"WITH {LONG} SELECT id, dim, round(v, 6) + 0.0 AS v FROM l")
def unpivot_features(t):
    """Wide feature arrays to a long (sample, feature, value) table and back is the identity; the long form is shown."""
    long = V.long_form(t.vectors)
    return V.long_form(V.wide_form(long).withColumn("y", F.lit(None))).select("id", F.col("dim").cast("bigint").alias("dim"), r("v").alias("v"))


@query(
    """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders), m AS (SELECT median(v) AS m FROM v)
    SELECT id, round(coalesce(v, m), 4) AS v FROM v, m"""
)
def median_fill(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey % 7 = 0, null, o_totalprice)").alias("v"))
    return V.fill_missing_with_median(rows).select("id", r("v", 4).alias("v"))


@query("SELECT p_partkey AS id, round(CASE WHEN (SELECT min(p_retailprice) >= 0 AND max(p_retailprice) > 50 FROM part) THEN ln(1 + p_retailprice) ELSE p_retailprice END, 6) AS v FROM part")
def log_counts(t):
    return V.log_if_counts(t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("v"))).select("id", r("v").alias("v"))
