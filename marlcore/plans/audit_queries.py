"""Gates, selections, merges and rules around an analysis, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from .graph_queries import JACCARD, K, KNN
from .registry import E, query, r


@query("SELECT name, count(*) AS n FROM (SELECT event_type || CASE WHEN event_id % 7 = 0 THEN '_error' ELSE '' END AS name FROM events) WHERE NOT suffix(name, '_error') GROUP BY name")
def artifact_filter(t):
    rows = t.events.select(F.expr("concat(event_type, if(event_id % 7 = 0, '_error', ''))").alias("name"))
    return A.without_errors(rows, "name").groupBy("name").agg(F.count("*").alias("n"))


SHARES = E + ", q AS (SELECT id, list_transform(f[1:3], lambda x: x * x / (f[1] * f[1] + f[2] * f[2] + f[3] * f[3])) AS p FROM e)"


@query(f"WITH {SHARES}, s AS (SELECT id, list_max(p) > least AS sure, least FROM q, (VALUES (0.8), (0.9999)) v(least)) SELECT CAST(least AS DOUBLE) AS least, id FROM (SELECT *, count(*) FILTER (sure) OVER (PARTITION BY least) < 30 AS few FROM s) WHERE few OR sure")
def confident_rows(t):
    """Rows that a mask of confidence keeps, and all of them where it keeps too few."""
    rows = t.vectors.select("id", F.expr("transform(slice(f, 1, 3), x -> x * x / (f[0] * f[0] + f[1] * f[1] + f[2] * f[2]))").alias("p"))
    kept = [A.confident(rows, "p", least, 3).select(F.lit(least).alias("least"), "id") for least in (0.8, 0.9999)]
    return kept[0].unionByName(kept[1])


@query(
    f"""WITH {E}, x AS (SELECT kind, unnest(CASE kind WHEN 'raw' THEN f WHEN 'bytes' THEN list_transform(f, lambda x: floor(abs(x) * 200)) ELSE list_transform(f, lambda x: abs(x) * 200) END) AS v
    FROM (SELECT * FROM e ORDER BY id LIMIT 200), (VALUES ('raw'), ('bytes'), ('parts')) k(kind))
    SELECT kind, NOT (min(v) < -0.01 OR max(v) > 300 OR (max(v) > 10 AND count(*) FILTER (abs(v - round(v)) > 1e-8) > 0)) AS plausible FROM x GROUP BY kind"""
)
def pixel_plausibility(t):
    forms = {"raw": "f", "bytes": "transform(f, x -> cast(floor(abs(x) * 200) as double))", "parts": "transform(f, x -> abs(x) * 200)"}
    found = [A.looks_like_pixels(t.vectors.select("id", F.expr(e).alias("f")), "id", "f").select(F.lit(k).alias("kind"), "plausible") for k, e in forms.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


GRID = "g AS (SELECT n, d FROM (VALUES (40), (5000), (5001), (10000), (10001), (50001)) a(n), (VALUES (2), (50), (512), (513), (784)) b(d))"


def grid(t):
    return t.spark.createDataFrame([(n, d) for n in (40, 5000, 5001, 10000, 10001, 50001) for d in (2, 50, 512, 513, 784)], "n int, d int")


@query(f"WITH {GRID} SELECT n, d, n > 10000 OR d > 512 AS large, CASE WHEN n > 50000 THEN '[HUGE]' WHEN n > 10000 THEN '[LARGE]' ELSE '[SMALL]' END AS label FROM g")
def data_sizes(t):
    return grid(t).withColumn("s", A.size_class("n", "d")).select("n", "d", "s.large", "s.label")


@query(
    f"""WITH {GRID}, i AS (SELECT n, d, d = 784 AS image FROM g)
    SELECT n, d, array_to_string(list_filter([CASE WHEN image THEN 'cnn_features=strongly_recommended' END, CASE WHEN image THEN 'raw_pixels=not_recommended' END,
        CASE WHEN d > 500 AND NOT image THEN 'pca_first=recommended' END, CASE WHEN n > 10000 THEN 'sample_first=recommended' END], lambda x: x IS NOT NULL), ';') AS advice FROM i"""
)
def upload_advice(t):
    return grid(t).select("n", "d", F.concat_ws(";", F.transform(A.upload_advice("n", "d", "(d = 784)"), lambda x: F.concat(x["mode"], F.lit("="), x["priority"]))).alias("advice"))


@query(f"WITH {GRID} SELECT n, d, least(30, greatest(5, CAST(floor(sqrt(n)) AS INTEGER))) AS knn_k, n <= 5000 AS label_propagation, n <= 5000 AS random_walk FROM g")
def graph_defaults(t):
    return grid(t).withColumn("s", A.graph_defaults("n")).select("n", "d", "s.knn_k", "s.label_propagation", "s.random_walk")


FAMILIES = "x AS (SELECT family, distortion, ratio FROM (VALUES ('generic'), ('manifold'), ('non_convex'), ('spherical')) a(family), (VALUES (0.05), (0.2), (0.32), (0.4), (0.6)) b(distortion), (VALUES (0.3), (0.7)) c(ratio))"


def families(t):
    rows = [(a, b, c) for a in ("generic", "manifold", "non_convex", "spherical") for b in (0.05, 0.2, 0.32, 0.4, 0.6) for c in (0.3, 0.7)]
    return t.spark.createDataFrame(rows, "family string, distortion double, ratio double")


@query(
    f"""WITH {FAMILIES}, c AS (SELECT *, CASE WHEN ratio > 0.6 AND distortion < 0.3 THEN 'hierarchical' WHEN distortion > 0.5 THEN 'graph_connected' WHEN family IN ('manifold', 'non_convex') AND distortion > 0.3 THEN 'graph_connected'
    WHEN family = 'manifold' AND distortion > 0.15 THEN 'graph_connected' ELSE family END AS structure FROM x)
    SELECT family, CAST(distortion AS DOUBLE) AS distortion, CAST(ratio AS DOUBLE) AS ratio, structure, structure = 'graph_connected' OR distortion > 0.5 AS graph_expert, structure IN ('graph_connected', 'hierarchical', 'manifold', 'non_convex') AS topology_boost,
    structure = 'graph_connected' AND distortion > 0.3 AS centroid_suppress FROM c"""
)
def data_structure(t):
    rows = families(t).withColumn("structure", A.structure_class("family", "distortion", "ratio"))
    return rows.withColumn("s", A.structure_strategy("structure", "distortion")).select("family", "distortion", "ratio", "structure", "s.*")


@query(
    """SELECT n, CAST(distortion AS DOUBLE) AS distortion, CASE WHEN n >= 50 AND distortion > 0.35 THEN 'KMeans,MiniBatchKMeans,GaussianMixture,GMM,Birch' ELSE '' END AS banned
    FROM (VALUES (49), (50), (2000)) a(n), (VALUES (0.1), (0.35), (0.36)) b(distortion)"""
)
def centroid_bans(t):
    rows = t.spark.createDataFrame([(n, d) for n in (49, 50, 2000) for d in (0.1, 0.35, 0.36)], "n int, distortion double")
    return rows.select("n", "distortion", F.concat_ws(",", A.centroid_ban("n", "distortion")).alias("banned"))


@query(
    """WITH x AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS ari, (event_id % 5 - 2) / 4 AS silhouette, value AS ch, event_id % 4 AS clusters FROM events)
    SELECT id, round(CASE WHEN clusters < 2 THEN 0 WHEN ari IS NOT NULL THEN ari WHEN silhouette > 0 THEN silhouette WHEN ch > 0 THEN ch / (ch + 1000) ELSE 0 END, 6) + 0.0 AS score,
    CASE WHEN clusters < 2 THEN 'none' WHEN ari IS NOT NULL THEN 'ari' WHEN silhouette > 0 THEN 'silhouette' ELSE 'calinski_harabasz' END AS source FROM x"""
)
def score_cascade(t):
    rows = t.events.selectExpr("event_id id", "if(event_id % 3 = 0, value / 100, null) ari", "(event_id % 5 - 2) / 4 silhouette", "value ch", "event_id % 4 clusters")
    return rows.withColumn("s", A.score_cascade("ari", "silhouette", "ch", "clusters", "1000")).select("id", r("s.score").alias("score"), "s.source")


CANDIDATES = "c AS (SELECT CAST(o_custkey % 7 + 2 AS INTEGER) AS k, round(avg(o_totalprice) / 100000, 6) AS real, round(avg(o_orderkey % 100) / 50, 6) AS null_mean, round(avg(o_custkey % 13) / 13, 6) AS p FROM orders GROUP BY ALL)"


@query(
    f"""WITH {CANDIDATES}, s AS (SELECT k, unnest(['gap', 'p', 'real', 'mix']) AS criterion, unnest([real - null_mean, -p, real, 0.6 * real + 0.4 * (1 - p)]) AS score FROM c)
    SELECT criterion, k FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY round(score, 9) DESC, k) AS rn FROM s) WHERE rn = 1"""
)
def best_k(t):
    """The number of clusters by the largest gap to the null, the smallest p, the largest score and a mix of two."""
    rows = t.orders.groupBy(F.expr("cast(o_custkey % 7 + 2 as int)").alias("k")).agg(
        r(F.avg("o_totalprice") / 100000).alias("real"), r(F.avg(F.expr("o_orderkey % 100")) / 50).alias("null_mean"), r(F.avg(F.expr("o_custkey % 13")) / 13).alias("p")
    )
    scores = F.expr("map('gap', real - null_mean, 'p', -p, 'real', real, 'mix', 0.6 * real + 0.4 * (1 - p))")
    return A.best_by(rows.select("k", F.explode(scores).alias("criterion", "score")), "k", F.round("score", 9), ["criterion"])


@query(f"WITH {JACCARD}, s AS (SELECT src, dst, round(w, 9) AS w FROM ja), n AS (SELECT *, row_number() OVER (ORDER BY w DESC, src, dst) AS place, count(*) OVER () AS n FROM s) SELECT src, dst, round(w, 6) AS w FROM n WHERE place <= greatest(1, floor(n * 0.7))")
def top_edges(t):
    """The best 70 % of the edges by shared neighbours."""
    from ..operators import neighbors as N

    e = N.shared_neighbours(N.knn_join(t.vectors, K)).withColumn("w", F.round("w", 9))
    return A.top_share(e, "w", 0.7).select("src", "dst", r("w").alias("w"))


@query(f"WITH {KNN} SELECT src, dst FROM k WHERE src < dst ORDER BY src, dst LIMIT 100")
def first_candidates(t):
    from ..operators import neighbors as N

    return N.knn_join(t.vectors, K).filter("src < dst").select("src", "dst").orderBy("src", "dst").limit(100)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0")
def sample_places(t):
    """A sample's rows in order of their ids again, numbered."""
    return A.with_row_numbers(t.orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id")), [F.asc("id")]).select(F.col("place").cast("bigint").alias("place"), "id")


@query("SELECT key, nation, balance FROM (SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier)")
def common_union(t):
    """Tables stacked on the columns that both have."""
    customers = t.customer.selectExpr("c_custkey key", "c_nationkey nation", "c_acctbal balance", "c_mktsegment segment")
    return A.union_common([customers, t.supplier.selectExpr("s_suppkey key", "s_name name", "s_nationkey nation", "s_acctbal balance")])


@query(f"WITH {E}, b AS (SELECT c_custkey AS id, [c_acctbal / 1000, CAST(c_nationkey AS DOUBLE)] AS f FROM customer), c AS (SELECT s_suppkey AS id, [s_acctbal / 1000] AS f FROM supplier) SELECT id, CAST(len(f) AS INTEGER) AS d, round(list_sum(f), 6) + 0.0 AS total FROM (SELECT e.id, list_concat(list_concat(e.f, b.f), c.f) AS f FROM e JOIN b USING (id) JOIN c USING (id))")
def early_fusion(t):
    """Three feature blocks of the same ids side by side, by a three-way join."""
    b = t.customer.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("f"))
    c = t.supplier.select(F.col("s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 1000).alias("f"))
    return A.fuse_features([t.vectors, b, c]).select("id", F.size("f").alias("d"), r(F.expr("aggregate(f, 0D, (s, x) -> s + x)")).alias("total"))


@query(
    f"""WITH {E}, s AS (SELECT count(*) AS n, max(len(f)) AS d FROM e), x AS (SELECT row_number() OVER (ORDER BY id) - 1 AS place, f, y, n, d FROM e, s), p AS (SELECT *, greatest(1, n // 1000) AS step FROM x),
    l AS (SELECT place, n, d, array_to_string(list_transform(f, lambda x: CAST(CAST(floor(x * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',') || ',' || coalesce(CAST(y AS VARCHAR), '') AS line FROM p WHERE place % step = 0 AND place // step < 1000)
    SELECT sha256(any_value(n) || '|' || any_value(d) || '|' || string_agg(line, '|' ORDER BY place) || '|raw')[:32] AS hash FROM l"""
)
def dataset_fingerprint(t):
    return A.fingerprint(t.vectors, "raw")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def stamps(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT n_nationkey AS id, to_json({'key': n_nationkey, 'name': n_name, 'region': {'key': n_regionkey, 'halves': [n_regionkey, n_nationkey]}}) AS doc FROM nation")
def json_records(t):
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key"), F.array("n_regionkey", "n_nationkey").alias("halves")).alias("region")))
    return t.nation.select(F.col("n_nationkey").alias("id"), doc.alias("doc"))


@query("SELECT c_custkey AS id, coalesce(CAST(s_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS nation, c_mktsegment AS segment, s_name AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def metadata_merge(t):
    """Two maps of metadata merged, the right one's values winning."""
    left = t.customer.select("c_custkey", F.expr("map('nation', cast(c_nationkey as string), 'segment', c_mktsegment)").alias("a"))
    right = t.supplier.select("s_suppkey", F.expr("map('nation', cast(s_nationkey as string), 'name', s_name)").alias("b"))
    both = left.join(right, F.col("c_custkey") == F.col("s_suppkey"), "left").withColumn("b", F.coalesce("b", F.expr("cast(map() as map<string, string>)")))
    m = both.select(F.col("c_custkey").alias("id"), A.right_wins("a", "b").alias("m"))
    return m.select("id", F.expr("m['nation']").alias("nation"), F.expr("m['segment']").alias("segment"), F.expr("m['name']").alias("name"))


@query(
    """WITH b AS (SELECT o_custkey AS id, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')) AS a, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O')) AS b FROM orders GROUP BY o_custkey)
    SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS blocked FROM b"""
)
def constraint_merge(t):
    """Two lists of blocked names for each key as one set."""
    lists = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(*[F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(s) for s in ("F", "O")])
    return lists.select("id", F.concat_ws(",", F.array_sort(F.array_union("F", "O"))).alias("blocked"))


@query(
    f"""WITH {E}, s AS (SELECT y, count(*) AS n, sum(count(*)) OVER () AS total FROM e GROUP BY y), q AS (SELECT *, n * 200 / total AS exact, floor(n * 200 / total) AS whole FROM s),
    w AS (SELECT *, row_number() OVER (ORDER BY round(exact - whole, 9) DESC, y) AS rn, 200 - sum(whole) OVER () AS left_over FROM q), z AS (SELECT y, CASE WHEN total <= 200 THEN n ELSE whole + (rn <= left_over)::INT END AS quota FROM w)
    SELECT id, y FROM (SELECT id, e.y, quota, row_number() OVER (PARTITION BY e.y ORDER BY md5(CAST(id AS VARCHAR)), id) AS place FROM e JOIN z USING (y)) WHERE place <= quota"""
)
def stratified_sample(t):
    return A.stratified_sample(t.vectors.select("id", "y"), "id", "y", 200)


@query(
    """WITH x AS (SELECT c_nationkey % 5 AS label, c_mktsegment AS cls, c_acctbal FROM customer), p AS (SELECT label, count(*) AS n, count(*) FILTER (cls = 'BUILDING') AS hits, avg(c_acctbal) AS mean FROM x GROUP BY label)
    SELECT label, round(hits / n, 6) AS purity, round(hits / (SELECT sum(hits) FROM p), 6) AS recall, round(mean, 6) AS mean FROM p ORDER BY hits DESC, label LIMIT 1"""
)
def cluster_report(t):
    rows = t.customer.select(F.expr("c_nationkey % 5").alias("label"), F.col("c_mktsegment").alias("cls"), "c_acctbal")
    return A.cluster_report(rows, "label", "cls", "BUILDING", "c_acctbal").select("label", r("purity").alias("purity"), r("recall").alias("recall"), r("mean").alias("mean"))


@query("SELECT greatest(0.0::DOUBLE, round(max(value / 100 - 0.5), 6)) AS best, count(*) AS results FROM events WHERE event_type <> 'error'")
def best_ari(t):
    """The largest ARI over the results, 0 at least."""
    return t.events.filter("event_type <> 'error'").agg(F.greatest(F.lit(0.0), r(F.max(F.expr("value / 100 - 0.5")))).alias("best"), F.count("*").alias("results"))


ANCHORS = E + ", a AS (SELECT id, y, f FROM e WHERE id % 25 = 0), g AS (SELECT e.id, a.id AS anchor, round(list_aggregate(list_transform(range(1, 65), lambda i: ((e.f[i] > 0) = (a.f[i] > 0))::INT), 'avg'), 9) AS share FROM e CROSS JOIN a WHERE e.id % 25 <> 0)"


@query(f"WITH {ANCHORS} SELECT id, label FROM (SELECT g.id, CAST(a.y AS BIGINT) AS label, row_number() OVER (PARTITION BY g.id ORDER BY share DESC, anchor) AS rn FROM g JOIN a ON a.id = anchor) WHERE rn = 1")
def anchor_labels(t):
    """Rows that are no anchors take the label of the anchor whose signs of features agree most with theirs; anchors are every 25th row."""
    from ..operators import neighbors as N

    anchors = t.vectors.filter("id % 25 = 0")
    best = N.knn_join(t.vectors.filter("id % 25 <> 0"), 1, "signs", anchors)
    return A.nearest_anchor(best.select(F.col("src").alias("id"), F.col("dst").alias("anchor"), (-F.col("w")).alias("share")), anchors.select("id", F.col("y").cast("bigint").alias("label")))


TOPS = "x AS (SELECT c_custkey AS id, c_acctbal AS score, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)"


@query(f"WITH {TOPS} SELECT section, CAST(place AS INTEGER) AS place, id, score FROM x, (VALUES ('cache', 10), ('table', 5), ('figures', 3)) s(section, most) WHERE place <= most UNION ALL SELECT 'log', CAST(place AS INTEGER), id, score FROM (SELECT row_number() OVER (ORDER BY event_id DESC) AS place, event_id AS id, value AS score FROM events) WHERE place <= 3")
def report_tops(t):
    """What a report shows: ten rows to cache, five in the table, three figures, the last three lines of the log."""
    best = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "id").limit(10)
    best = best.selectExpr("cast(row_number() over (order by score desc, id) as int) place", "id", "score")
    sections = t.spark.createDataFrame([("cache", 10), ("table", 5), ("figures", 3)], "section string, most int")
    last = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score")).orderBy(F.desc("id")).limit(3).selectExpr("'log' section", "cast(row_number() over (order by id desc) as int) place", "id", "score")
    return best.join(F.broadcast(sections), F.expr("place <= most")).select("section", "place", "id", "score").unionByName(last)
