"""Expression-table and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import metrics, neighbors as N, omics as O
from .registry import E, LONG, knn_sql, query, r

#: Orders as samples, parts as features, quantities as counts.
COUNTS = "c AS (SELECT l_suppkey AS sample, l_partkey % 200 AS feature, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def counts(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 200).alias("feature")).agg(F.sum("l_quantity").alias("value"))


@query(f"WITH {COUNTS} SELECT feature, count(*) AS samples FROM c WHERE feature IN (SELECT feature FROM c WHERE value > 0 GROUP BY feature HAVING count(*) >= 8) GROUP BY feature")
def gene_prevalence(t):
    return O.prevalent_features(counts(t), 8).groupBy("feature").agg(F.count("*").alias("samples"))


@query(f"WITH {COUNTS} SELECT sample, feature, round(ln(1 + 10000 * value / sum(value) OVER (PARTITION BY sample)), 6) AS value FROM c")
def count_normalise(t):
    return O.normalise_counts(counts(t)).select("sample", "feature", r("value").alias("value"))


@query(f"WITH {COUNTS} SELECT feature FROM (SELECT feature FROM c WHERE sample % 3 = 0 AND value > 60 INTERSECT SELECT feature FROM c WHERE sample % 3 = 1 AND value > 60)")
def gene_intersection(t):
    c = counts(t).filter("value > 60")
    return O.shared_features(c.filter("sample % 3 = 0"), c.filter("sample % 3 = 1"))


EXPR = LONG.replace("l AS (SELECT id, y,", "l AS (SELECT id AS sample, id, y,")
EVENTS = "o AS (SELECT id AS sample, (id * 37) % 50 + 1 AS time, (id % 3 > 0)::BIGINT AS event FROM e)"


def expression(t):
    return t.vectors.select(F.col("id").alias("sample"), F.posexplode("f").alias("feature", "value")).withColumn("feature", F.col("feature").cast("bigint"))


@query(
    f"""WITH {LONG}, h AS (SELECT id AS sample, dim AS feature, v AS value, row_number() OVER (PARTITION BY dim ORDER BY id) AS p,
        row_number() OVER (PARTITION BY dim ORDER BY ((id * 1103515245 + dim * 12345 + 7) % 2147483648 * 69069 + 7) % 2147483647, id) AS d FROM l)
    SELECT a.sample, a.feature, round(b.value, 6) + 0.0 AS value FROM h a JOIN h b ON a.feature = b.feature AND a.p = b.d"""
)
def permutation_null(t):
    return O.shuffled_null(expression(t), 7).select("sample", "feature", r("value").alias("value"))


@query(
    f"""WITH {LONG}, {EVENTS}, m AS (SELECT dim, median(v) AS m FROM l GROUP BY dim), x AS (SELECT dim AS feature, time, event, (v > m)::BIGINT AS high FROM l JOIN m USING (dim) JOIN o ON o.sample = l.id),
    p AS (SELECT feature, time, count(*) AS l, sum(high) AS lh, sum(event) AS d, sum(event * high) AS dh FROM x GROUP BY ALL), k AS (SELECT *, sum(l) OVER w AS n, sum(lh) OVER w AS nh FROM p WINDOW w AS (PARTITION BY feature ORDER BY time DESC)),
    s AS (SELECT feature, sum(dh - d * nh / n) AS u, sum(d * (nh / n) * (1 - nh / n) * (n - d) / (n - 1)) AS v FROM k WHERE d > 0 AND n >= 2 GROUP BY feature)
    SELECT feature, round(u * u / v, 5) AS chi2 FROM s ORDER BY round(u * u / v, 9) DESC, feature LIMIT 10"""
)
def prognostic_features(t):
    outcome = t.vectors.select(F.col("id").alias("sample"), ((F.col("id") * 37) % 50 + 1).alias("time"), (F.col("id") % 3 > 0).cast("bigint").alias("event"))
    return O.survival_screen(expression(t), outcome, 10).select("feature", r("chi2", 5).alias("chi2"))


ZOO = [("KMeans", None), ("DBSCAN", 15000), ("HDBSCAN", 20000), ("AgglomerativeClustering", 5000), ("SpectralClustering", 5000), ("OPTICS", 10000), ("AffinityPropagation", 3000), ("MeanShift", 5000)]


@query("SELECT name FROM (VALUES ('KMeans', NULL), ('DBSCAN', 15000), ('HDBSCAN', 20000), ('AgglomerativeClustering', 5000), ('SpectralClustering', 5000), ('OPTICS', 10000), ('AffinityPropagation', 3000), ('MeanShift', 5000)) v(name, m) WHERE (m IS NULL OR m >= 6000) AND name <> 'OPTICS'")
def algorithm_fuse(t):
    return D.size_fuse(t.spark.createDataFrame(ZOO, "name string, max_samples int"), 6000, ["OPTICS"]).select("name")


@query(
    """WITH x AS (SELECT p_partkey AS id, (p_partkey % 100) / 100.0 AS a, (p_size % 10) / 10.0 AS i, p_partkey % 3 = 0 AS e, (p_size % 7) / 7.0 AS c, p_partkey % 11 = 0 AS m, p_size % 4 AS n FROM part)
    SELECT id, CASE WHEN a < 0.2 OR (a < 0.3 AND NOT i > 0.5) THEN 'retreat' WHEN m THEN 'run' WHEN e AND c >= 0.75 THEN 'skip' ELSE 'run' END AS ensemble, e AND n < 2 AND NOT (a < 0.2 OR a >= 0.7) AS retry FROM x"""
)
def ensemble_gates(t):
    x = t.part.selectExpr("p_partkey as id", "(p_partkey % 100) / 100.0D as a", "(p_size % 10) / 10.0D as i", "if(p_partkey % 3 = 0, 'endorsed', 'qualified') as e", "(p_size % 7) / 7.0D as c", "p_partkey % 11 = 0 as m", "p_size % 4 as n", "if(p_partkey % 3 = 0, 'RETRY', 'WARN') as act")
    return x.select("id", D.ensemble_gate("a", "i", "e", "c", "m").alias("ensemble"), D.retry_action("a", "act", "n").alias("retry"))


@query(
    """WITH x AS (SELECT c_mktsegment AS s, avg(c_acctbal) / 10000 AS ari FROM customer GROUP BY 1), n AS (SELECT CASE s WHEN 'BUILDING' THEN 'KMeans' WHEN 'MACHINERY' THEN 'DBSCAN' ELSE s END AS algorithm, ari FROM x),
    b AS (SELECT algorithm, ari FROM n WHERE algorithm IN ('KMeans', 'DBSCAN') ORDER BY ari DESC, algorithm DESC LIMIT 1) SELECT n.algorithm AS winner, b.algorithm AS reference, round(b.ari - n.ari, 6) + 0.0 AS gap, b.ari - n.ari > 0.15 AS warn FROM n, b WHERE n.algorithm = 'HOUSEHOLD'"""
)
def artifact_warning(t):
    x = t.customer.groupBy("c_mktsegment").agg((F.avg("c_acctbal") / 10000).alias("ari"))
    named = x.select(F.expr("case c_mktsegment when 'BUILDING' then 'KMeans' when 'MACHINERY' then 'DBSCAN' else c_mktsegment end").alias("algorithm"), "ari")
    return D.artifact_warning(named, "HOUSEHOLD").select("winner", "reference", r("gap").alias("gap"), "warn")


@query("SELECT p_size AS epoch, round(1.0 + (0.1 - 1.0) * 0.5 * (1 + cos(pi() * least(1.0, p_size / 49.0))), 6) AS cosine, round(0.1 + (1.0 - 0.1) * least(1.0, p_size / 49.0), 6) AS linear FROM (SELECT DISTINCT p_size FROM part)")
def annealing(t):
    x = t.part.select("p_size").distinct().withColumn("epochs", F.lit(50))
    return x.select(F.col("p_size").alias("epoch"), r(D.annealed("p_size", "epochs", 0.1, 1.0)).alias("cosine"), r(D.annealed("p_size", "epochs", 0.1, 1.0, "linear")).alias("linear"))


@query(f"WITH {knn_sql(14)} SELECT round(avg((a.y = b.y)::INT), 6) AS agreement FROM k JOIN e a ON a.id = src JOIN e b ON b.id = dst WHERE src < dst")
def connectivity_agreement(t):
    from ..operators.graph import with_end_labels

    labels = t.vectors.select("id", F.col("y").alias("label"))
    e = with_end_labels(N.knn_join(t.vectors, 14).filter("src < dst"), labels)
    return e.agg(r(F.avg((F.col("l1") == F.col("l2")).cast("int"))).alias("agreement"))


@query(f"WITH {E}, h AS (SELECT f[1] > 0 AS c, y FROM e), m AS (SELECT c, avg((y = 3)::INT) AS purity, count(*) FILTER (y = 3) / (SELECT count(*) FROM e WHERE y = 3) AS recall FROM h GROUP BY c) SELECT round(max(recall), 6) AS recall, round(arg_max(purity, recall), 6) AS purity FROM m")
def class_recall(t):
    h = t.vectors.select((F.col("f")[0] > 0).alias("c"), F.col("y"))
    hits = h.groupBy("c").agg(F.avg((F.col("y") == 3).cast("int")).alias("purity"), F.sum((F.col("y") == 3).cast("int")).alias("n"))
    return hits.agg(r(F.max("n") / F.sum("n")).alias("recall"), r(F.max_by("purity", "n")).alias("purity"))


@query(f"WITH {E}, m AS (SELECT y, count(*) AS n FROM e GROUP BY y) SELECT CASE WHEN count(*) < 2 OR count(*) >= sum(n) THEN 'degenerate' ELSE 'scored' END AS state, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM m")
def metric_guard(t):
    ch = metrics.calinski_harabasz(t.vectors)
    return ch.select(F.when(F.col("ch").isNull(), "degenerate").otherwise("scored").alias("state"), "k", "n")
