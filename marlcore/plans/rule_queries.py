"""Consensus, ranking, audit, statistics and benchmark queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import consensus as C, stats as S, vectors as V
from .registry import E, query, r
from .vector_queries import NEAREST

#: Three partitions of embeddings: the labels, the nearest centroids, and the signs of two features.
RUNS_SQL = f"{NEAREST}, runs AS (SELECT 'labels' AS algorithm, id, CAST(y AS BIGINT) AS label, 0.5 AS score FROM e UNION ALL SELECT 'nearest', id, label, 0.6 FROM a UNION ALL SELECT 'signs', id, (f[1] > 0)::BIGINT * 2 + (f[2] > 0)::BIGINT, 0.3 FROM e)"


def runs(t):
    v = t.vectors
    near = V.assign_nearest(v, V.centroid_arrays(v)).select(F.lit("nearest").alias("algorithm"), "id", F.col("label").cast("bigint").alias("label"), F.lit(0.6).alias("score"))
    own = v.select(F.lit("labels").alias("algorithm"), "id", F.col("y").cast("bigint").alias("label"), F.lit(0.5).alias("score"))
    signs = v.select(F.lit("signs").alias("algorithm"), "id", F.expr("cast(f[0] > 0 as bigint) * 2 + cast(f[1] > 0 as bigint)").alias("label"), F.lit(0.3).alias("score"))
    return own.unionByName(near).unionByName(signs)


@query(
    f"""WITH {RUNS_SQL}, s AS (SELECT id, list(algorithm || ':' || label ORDER BY algorithm) AS s FROM runs GROUP BY id), g AS (SELECT s, count(*) AS members, min(id) AS first FROM s GROUP BY s),
    x AS (SELECT first, members, unnest(s) AS x FROM g) SELECT p.first AS a, q.first AS b, p.members AS na, q.members AS nb, round(count(*) / 3, 6) AS share FROM x p JOIN x q ON p.x = q.x AND p.first <= q.first GROUP BY ALL"""
)
def coassociation(t):
    return C.coassociation(runs(t)).select("a", "b", "na", "nb", r("share").alias("share"))


@query(
    f"""WITH {RUNS_SQL}, s AS (SELECT id, list(algorithm || ':' || label ORDER BY algorithm) AS s FROM runs GROUP BY id), g AS (SELECT s, count(*) AS members, min(id) AS first FROM s GROUP BY s),
    x AS (SELECT first, members, unnest(s) AS x FROM g), w AS (SELECT algorithm, max(score) AS w FROM runs GROUP BY algorithm)
    SELECT p.first AS a, q.first AS b, p.members AS na, q.members AS nb, round(sum(w.w) / (SELECT sum(w) FROM w), 6) AS share FROM x p JOIN x q ON p.x = q.x AND p.first <= q.first JOIN w ON w.algorithm = split_part(p.x, ':', 1) GROUP BY ALL"""
)
def weighted_coassociation(t):
    return C.coassociation(runs(t), weighted=True).select("a", "b", "na", "nb", r("share").alias("share"))


@query(
    f"""WITH {RUNS_SQL}, pr AS (SELECT x.id AS i, y.id AS j, count(*) FILTER (x.label = y.label) / 3 AS s FROM runs x JOIN runs y ON x.algorithm = y.algorithm AND x.id <> y.id GROUP BY ALL),
    m AS (SELECT avg(1 - 2.0 * 3 * s * (1 - s) / 2) AS agreement FROM pr), ag AS (SELECT agreement, greatest(0.01, least(0.99, agreement)) AS p FROM m)
    SELECT round(agreement, 6) AS agreement, round(-p * log2(p) - (1 - p) * log2(1 - p), 6) AS entropy FROM ag"""
)
def agreement_entropy(t):
    return C.agreement_entropy(runs(t)).select(r("agreement").alias("agreement"), r("entropy").alias("entropy"))


@query(f"WITH {RUNS_SQL}, k AS (SELECT algorithm, count(DISTINCT label) AS k FROM runs GROUP BY algorithm) SELECT k, count(*) AS votes FROM k GROUP BY k ORDER BY votes DESC, k LIMIT 1")
def k_consensus(t):
    return C.voted_k(C.quality_gate(runs(t)))


@query(f"WITH {RUNS_SQL}, v AS (SELECT r.id, avg((r.label <> a.label)::INT) AS v FROM runs r JOIN a ON a.id = r.id GROUP BY r.id) SELECT round(avg((v >= 0.5)::INT), 6) AS ratio FROM v")
def disagreement(t):
    v = t.vectors
    near = V.assign_nearest(v, V.centroid_arrays(v)).select("id", F.col("label").cast("bigint").alias("label"))
    return C.disagreement(runs(t), near).select(r("ratio").alias("ratio"))


RESAMPLE_SQL = f"{RUNS_SQL}, rs AS (SELECT algorithm AS run, id, label FROM runs WHERE id % 5 <> length(algorithm) % 5), co AS (SELECT x.id AS i, y.id AS j, avg((x.label = y.label)::INT) AS consensus FROM rs x JOIN rs y ON x.run = y.run AND x.id < y.id GROUP BY ALL)"


def resampled(t):
    return runs(t).filter("id % 5 <> length(algorithm) % 5").select(F.col("algorithm").alias("run"), "id", "label")


@query(f"WITH {RESAMPLE_SQL} SELECT i, j, round(consensus, 6) AS consensus FROM co")
def consensus_matrix(t):
    return S.resample_consensus(resampled(t), 6)


@query(f"WITH {RESAMPLE_SQL} SELECT CAST(x.y AS BIGINT) AS label, round(avg(consensus), 6) AS certificate FROM co JOIN e x ON x.id = i JOIN e z ON z.id = j AND z.y = x.y GROUP BY x.y")
def cluster_certificates(t):
    labels = t.vectors.select("id", F.col("y").cast("bigint").alias("label"))
    return S.resampled_certificates(resampled(t), labels).select("label", r("certificate").alias("certificate"))


#: Scores of made-up algorithms, one a type of part.
RESULTS_SQL = """res AS (SELECT p_type AS algorithm, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE (sum(p_size) % 97) / 97.0 END AS ari, (sum(p_size) % 89) / 89.0 AS nmi, (sum(p_partkey) % 83) / 83.0 AS internal FROM part GROUP BY p_type)"""


def results(t):
    return t.part.groupBy(F.col("p_type").alias("algorithm")).agg(
        F.expr("case when count(*) % 5 = 0 then null else (sum(p_size) % 97) / 97.0D end").alias("ari"), F.expr("(sum(p_size) % 89) / 89.0D").alias("nmi"), F.expr("(sum(p_partkey) % 83) / 83.0D").alias("internal")
    )


@query(
    f"""WITH {RESULTS_SQL}, s AS (SELECT *, CASE WHEN ari IS NULL THEN CASE WHEN (SELECT coalesce(max(ari), 0) FROM res) < 0.5 THEN CASE WHEN internal > 0 THEN least(internal, 0.65) ELSE 0 END ELSE -1 END WHEN algorithm = (SELECT min(algorithm) FROM res) THEN 0 ELSE ari END AS sort_ari FROM res)
    SELECT algorithm, round(ari, 6) AS ari, round(nmi, 6) AS nmi, round(internal, 6) AS internal, round(sort_ari, 6) AS sort_ari, CAST(row_number() OVER (ORDER BY sort_ari DESC, coalesce(nmi, 0) DESC, internal DESC, algorithm) AS INTEGER) AS rank FROM s"""
)
def informed_rank(t):
    rows = results(t)
    banned = [x[0] for x in rows.agg(F.min("algorithm")).collect()]
    out = C.rank_results(rows, banned, [])
    return out.select("algorithm", *[r(c).alias(c) for c in ("ari", "nmi", "internal", "sort_ari")], "rank")


@query(
    f"""WITH {RESULTS_SQL}, b AS (SELECT coalesce(ari, 0) AS own, internal FROM res ORDER BY algorithm LIMIT 1), s AS (SELECT ari, algorithm FROM res WHERE algorithm <> (SELECT min(algorithm) FROM res) AND ari IS NOT NULL ORDER BY ari DESC, algorithm DESC LIMIT 1)
    SELECT round(s.ari - own, 6) AS gap, s.algorithm AS outperformed_by, s.ari > 0 AND s.ari - own > 0.03 AND internal >= 0.7 AS trap FROM b, s"""
)
def consensus_trap(t):
    rows = results(t).fillna(0.0, ["ari"])
    first = rows.agg(F.min("algorithm")).first()[0]
    named = rows.withColumn("algorithm", F.when(F.col("algorithm") == first, "EnsembleConsensus").otherwise(F.col("algorithm")))
    return C.consensus_trap(named).select(r("gap").alias("gap"), "outperformed_by", "trap")


@query(
    """WITH x AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 60000 AS INTEGER) AS n, CAST(p_size * 64 AS INTEGER) AS d FROM part), c AS (SELECT *, CAST(n AS BIGINT) * d AS cost FROM x)
    SELECT id, n, d, cost, CASE WHEN cost >= 10000000 THEN 2 WHEN cost >= 2000000 THEN 1 ELSE 0 END AS timeout_tier, CASE WHEN cost >= 50000000 THEN least(32, d) WHEN cost >= 2000000 THEN least(50, d) ELSE 0 END AS cap_dims,
        CASE WHEN cost >= 50000000 THEN least(2000, greatest(500, n // 10)) WHEN cost >= 10000000 AND n > 20000 THEN 2000 ELSE 0 END AS downsample_to,
        concat_ws(',', CASE WHEN cost >= 2000000 THEN 'AgglomerativeClustering,SpectralClustering,AffinityPropagation,MeanShift' END, CASE WHEN cost >= 10000000 THEN 'DBSCAN,OPTICS' END, CASE WHEN cost >= 50000000 THEN 'HDBSCAN,Birch' END) AS blocked FROM c"""
)
def cost_tiers(t):
    x = t.part.select(F.col("p_partkey").alias("id"), F.expr("cast(p_partkey * 37 % 60000 as int)").alias("n"), F.expr("cast(p_size * 64 as int)").alias("d"))
    out = D.cost_tier(x)
    return out.withColumn("downsample_to", F.coalesce("downsample_to", F.lit(0)).cast("int"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'time_series' WHEN p_size % 5 = 0 OR p_brand LIKE '%1' THEN 'text' WHEN p_size % 3 = 0 THEN 'image' ELSE 'tabular' END AS modality,
        CASE WHEN p_size % 7 = 0 THEN 'euclidean' WHEN p_size % 5 = 0 OR p_brand LIKE '%1' THEN 'cosine' ELSE 'euclidean' END AS metric,
        CASE WHEN p_size % 7 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'none' ELSE 'pca' END WHEN p_size % 5 = 0 OR p_brand LIKE '%1' THEN 'truncated_svd' WHEN p_size % 3 = 0 THEN 'pca' ELSE 'none' END AS reduce FROM part"""
)
def modality_case(t):
    x = t.part.selectExpr("p_partkey as id", "p_size % 7 = 0 as ts", "p_size % 5 = 0 as tx", "p_size % 3 = 0 as im", "if(p_brand like '%1', 'sparse', 'dense') as fam", "p_size % 2 = 0 as shp")
    return x.select("id", D.modality("ts", "tx", "im", "fam", "shp").alias("m")).select("id", "m.modality", "m.metric", "m.reduce")


@query(
    """WITH x AS (SELECT p_partkey AS id, (p_partkey % 100) / 100.0 AS s, (p_size % 10) / 10.0 AS h, p_partkey % 3 = 0 AS k, (p_size % 9 - 3) / 9.0 AS v, (p_partkey % 11) / 11.0 AS a, p_size % 7 AS g, (p_partkey % 13) / 20.0 AS sp, p_size % 4 AS pa FROM part),
    y AS (SELECT *, (abs(g) > 3 AND h < 0.3) OR sp > 0.5 OR pa >= 3 AS bad, s >= 0.75 AND h >= 0.6 AND k AND NOT v < 0 AS good FROM x)
    SELECT id, CASE WHEN bad THEN 'qualified_with_warning' WHEN good THEN 'endorsed' WHEN s >= 0.5 THEN 'qualified' ELSE 'qualified_with_warning' END AS endorsement,
        CASE WHEN bad THEN CASE WHEN a >= 0.7 THEN 'CLEAR' ELSE 'RETRY' END WHEN good THEN 'CLEAR' WHEN s >= 0.5 THEN CASE WHEN a >= 0.7 THEN 'CLEAR' ELSE 'WARN' END WHEN a >= 0.7 THEN 'CLEAR' ELSE 'RETRY' END AS action FROM y"""
)
def verdict(t):
    x = t.part.selectExpr(
        "p_partkey as id", "(p_partkey % 100) / 100.0D as s", "(p_size % 10) / 10.0D as h", "p_partkey % 3 = 0 as k", "(p_size % 9 - 3) / 9.0D as v", "(p_partkey % 11) / 11.0D as a", "p_size % 7 as g", "(p_partkey % 13) / 20.0D as sp", "p_size % 4 as pa"
    )
    return x.select("id", D.verdict("s", "h", "k", "v", "a", "g", "sp", "pa").alias("v")).select("id", "v.endorsement", "v.action")


@query(
    """SELECT p_partkey AS id, p_partkey % 9000 AS n, CAST(CASE WHEN p_partkey % 9000 <= 2000 THEN p_partkey % 9000 WHEN p_size * 6 > 200 THEN greatest(400, least(800, CAST(floor(p_partkey % 9000 * 0.06) AS BIGINT)))
        WHEN p_size * 6 > 64 THEN greatest(500, least(1000, CAST(floor(p_partkey % 9000 * 0.10) AS BIGINT))) ELSE greatest(1000, least(2000, CAST(floor(p_partkey % 9000 * 0.15) AS BIGINT))) END AS BIGINT) AS rows FROM part"""
)
def audit_sampling(t):
    x = t.part.selectExpr("p_partkey as id", "p_partkey % 9000 as n", "p_size * 6 as d")
    return x.select("id", "n", D.audit_sample_size("n", "d").cast("bigint").alias("rows"))


@query("SELECT p_partkey AS id, (p_size % 6 = 0) OR ((p_size % 10) / 10.0 > 0.6 AND p_partkey % 4 <> 0) OR p_partkey % 17 = 0 OR p_size BETWEEN 1 AND 5 AS manifold FROM part")
def manifold_rule(t):
    x = t.part.selectExpr("p_partkey as id", "if(p_size % 6 = 0, 'manifold', 'dense') as fam", "(p_size % 10) / 10.0D as h", "if(p_partkey % 4 = 0, 'low', 'high') as risk", "if(p_partkey % 17 = 0, -0.1D, null) as dbcv", "p_size as d")
    return x.select("id", D.is_manifold("fam", "h", "risk", "dbcv", "d").alias("manifold"))


@query(
    """WITH d AS (SELECT p_partkey AS id, p_size * p_size * (CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END) AS d FROM part), c AS (SELECT id, d, ch, d // ch AS f, unnest(range(greatest(8, CAST(round(sqrt(d / ch)) AS BIGINT) - 8), CAST(round(sqrt(d / ch)) AS BIGINT) + 9)) AS h FROM d, (VALUES (3), (1)) v(ch) WHERE d >= 256 AND d % ch = 0),
    k AS (SELECT *, f // h AS w FROM c WHERE f % h = 0), o AS (SELECT * FROM k WHERE w BETWEEN 8 AND 2048 AND h / w BETWEEN 0.2 AND 5.0 AND (d <= 3000 OR (h IN (8, 16, 28, 32, 64, 96, 112, 128, 224, 256, 299, 384, 512) AND w IN (8, 16, 28, 32, 64, 96, 112, 128, 224, 256, 299, 384, 512)))),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ch DESC, h) AS rn FROM o) SELECT d.id, d.d, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, ch AS c FROM d JOIN b ON b.id = d.id AND rn = 1"""
)
def image_shape(t):
    x = t.part.selectExpr("p_partkey as id", "p_size * p_size * if(p_partkey % 2 = 0, 3, 1) as d")
    return x.select("id", "d", D.image_shape("d").alias("s")).filter("s is not null").select("id", "d", "s.h", "s.w", "s.c")


@query(
    """WITH u AS (SELECT l_linestatus AS dataset, l_returnflag AS expert, l_quantity > 5 AS success, l_discount AS score, CASE WHEN l_tax > 0.07 THEN 'NaN'::DOUBLE ELSE l_tax END AS ari, l_extendedprice AS time_ms, l_quantity / 1000 AS cost_usd FROM lineitem)
    SELECT dataset, expert, count(*) AS algorithms_run, count(*) FILTER (success) AS successful, round(coalesce(sum(score) FILTER (success), 0) / greatest(count(*) FILTER (success), 1), 4) AS avg_score,
        round(avg(ari) FILTER (success AND NOT isnan(ari)), 4) AS avg_ari, round(avg(success::INT), 4) AS success_rate, round(avg(time_ms), 0) AS avg_latency_ms, round(sum(cost_usd), 6) AS total_cost_usd FROM u GROUP BY GROUPING SETS ((dataset), (expert), ())"""
)
def bench_rollup(t):
    u = t.lineitem.selectExpr("l_linestatus as dataset", "l_returnflag as expert", "l_quantity > 5 as success", "l_discount as score", "if(l_tax > 0.07, double('NaN'), l_tax) as ari", "l_extendedprice as time_ms", "l_quantity / 1000 as cost_usd")
    return C.roll_up(u)


SURVIVAL_SQL = "sv AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') / 365.25 AS time, (o_orderstatus = 'F')::BIGINT AS event, c_mktsegment AS grp FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT round(time, 1) AS time, event, grp FROM sv WHERE time > 0)"


def survival(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    s = o.select((F.datediff(F.lit("2030-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365.25).alias("time"), (F.col("o_orderstatus") == "F").cast("bigint").alias("event"), F.col("c_mktsegment").alias("grp"))
    return s.filter("time > 0").withColumn("time", F.round("time", 1))


@query(
    f"""WITH {SURVIVAL_SQL}, p AS (SELECT grp, time, sum(event) AS d, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS r FROM p),
    f AS (SELECT *, 1 - d / r AS f FROM k), o AS (SELECT *, max((f <= 0)::INT) OVER w AS dead, sum(CASE WHEN f > 0 THEN ln(f) END) OVER w AS l FROM f WINDOW w AS (PARTITION BY grp ORDER BY time))
    SELECT grp, time, CAST(r AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS deaths, round(CASE WHEN dead = 1 THEN 0 ELSE exp(l) END, 6) AS survival FROM o"""
)
def km_curve(t):
    return S.kaplan_meier(survival(t), by="grp").select("grp", "time", "at_risk", "deaths", r("survival").alias("survival"))


@query(
    f"""WITH {SURVIVAL_SQL}, dt AS (SELECT time, sum(event) AS d FROM s GROUP BY time HAVING sum(event) > 0), n AS (SELECT dt.time, dt.d AS dt, g.grp, count(*) FILTER (s.grp = g.grp) AS n, count(*) AS nt, sum(s.event) FILTER (s.grp = g.grp AND s.time = dt.time) AS d
        FROM dt CROSS JOIN (SELECT DISTINCT grp FROM s) g JOIN s ON s.time >= dt.time GROUP BY ALL) SELECT grp, CAST(sum(coalesce(d, 0)) AS BIGINT) AS observed, round(sum(dt * n / nt), 4) AS expected FROM n WHERE nt >= 2 GROUP BY grp"""
)
def logrank_oe(t):
    return S.logrank_table(survival(t)).select("grp", "observed", r("expected", 4).alias("expected"))


@query("SELECT o_orderkey AS id, round(date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') / 365.25, 4) AS time, (o_orderstatus = 'F')::INT AS event FROM orders WHERE o_orderstatus IN ('F', 'O') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') > 0")
def survival_flags(t):
    days = F.datediff(F.lit("2030-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O") & (days > 0)).select(F.col("o_orderkey").alias("id"), r(days / 365.25, 4).alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"))


@query()
def logrank_chi2(t):
    """The chi-squared tail isn't SQL; tested against direct computation."""
    chi2, df, p = S.logrank(survival(t))
    return t.spark.createDataFrame([(chi2, df, p)], "chi2 double, df int, p double")


@query(
    """WITH p AS (SELECT p_partkey AS id, ((p_partkey * 7919) % 10007 + 1) / 10008.0 AS p FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM p)
    SELECT id, round(p, 6) AS p, round(least(1.0, min(p * n / r) OVER (ORDER BY r DESC)), 6) AS q FROM k"""
)
def bh_fdr(t):
    tests = t.part.selectExpr("p_partkey as id", "((p_partkey * 7919) % 10007 + 1) / 10008.0D as p")
    return S.benjamini_hochberg(tests).select("id", r("p").alias("p"), r("q").alias("q"))


@query(
    """WITH l AS (SELECT l_suppkey AS k, l_linenumber AS run, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), re AS (SELECT s_suppkey AS k, 20 + s_suppkey % 12 AS real FROM supplier)
    SELECT k, real, round(avg(value), 6) AS null_mean, round((real - avg(value)) / (stddev_pop(value) + 1e-9), 4) AS z, round((count(*) FILTER (value >= real) + 1) / (count(*) + 1), 6) AS p FROM l JOIN re USING (k) GROUP BY k, real"""
)
def perm_pvalue(t):
    null = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), "l_linenumber").agg(F.avg("l_quantity").alias("value"))
    real = t.supplier.selectExpr("s_suppkey as k", "20 + s_suppkey % 12 as real")
    return S.permutation_test(real, null, ["k"]).select("k", "real", r("null_mean").alias("null_mean"), r("z", 4).alias("z"), r("p").alias("p"))


@query(
    """WITH w AS (SELECT l_suppkey AS k, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) / sum(w) OVER (PARTITION BY k) AS c FROM w),
    p AS (SELECT *, lag(c) OVER o AS pc, lag(v) OVER o AS pv FROM c WINDOW o AS (PARTITION BY k ORDER BY v)) SELECT k, round(CASE WHEN pc IS NULL THEN v ELSE pv + (v - pv) * (0.5 - pc) / (c - pc) END, 3) AS median FROM p WHERE c >= 0.5 AND coalesce(pc, 0) < 0.5"""
)
def weighted_median(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("w"))
    return S.weighted_median(rows, "v", "w", "k").select("k", r("median", 3).alias("median"))


@query(
    f"""WITH {E}, x AS (SELECT y, id % 5 AS fold, f[1] AS v FROM e), a AS (SELECT y, avg(v) FILTER (fold <> 0) AS w, avg(v) FILTER (fold = 0) AS c FROM x GROUP BY y)
    SELECT y AS label, round(abs(w - c), 6) AS gap, CASE WHEN abs(w - c) > 0.15 THEN 'does not transfer' WHEN abs(w - c) > 0.07 THEN 'weak' ELSE 'transfers' END AS verdict FROM a"""
)
def transfer_gap(t):
    x = t.vectors.select("y", (F.col("id") % 5).alias("fold"), F.col("f")[0].alias("v"))
    a = x.groupBy(F.col("y").alias("label")).agg(F.abs(F.avg(F.when(F.col("fold") != 0, F.col("v"))) - F.avg(F.when(F.col("fold") == 0, F.col("v")))).alias("gap"))
    return a.select("label", r("gap").alias("gap"), D.transfer_verdict("gap").alias("verdict"))


@query("WITH s AS (SELECT l_suppkey % 10 AS method, l_linenumber AS seed, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT method, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM s GROUP BY method")
def multi_seed(t):
    s = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("method"), "l_linenumber").agg(F.avg("l_discount").alias("m"))
    return s.groupBy("method").agg(r(F.avg("m")).alias("mean"), r(F.stddev_pop("m")).alias("std"))
