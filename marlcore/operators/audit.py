"""Rules and small table operators around an analysis: gates, sizes, fingerprints, merges, selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Algorithms that look for centres; the scale at which a Calinski-Harabasz score counts one half.
CENTRE_ALGORITHMS = ("KMeans", "MiniBatchKMeans", "GaussianMixture", "GMM", "Birch")
HALF_CH = 1000.0


def without_errors(df: DataFrame, name: str) -> DataFrame:
    """Rows whose artifact isn't named as an error."""
    return df.filter(~F.endswith(name, F.lit("_error")))


def confident(df: DataFrame, probabilities: str, least: float, clusters: int) -> DataFrame:
    """Rows whose largest probability exceeds `least`; all rows if fewer than ten a cluster do."""
    sure = F.array_max(probabilities) > least
    few = df.agg((F.count_if(sure) < 10 * clusters).alias("few"))
    return df.crossJoin(F.broadcast(few)).filter(F.col("few") | sure).drop("few")


def looks_like_pixels(values: DataFrame, order: str, array: str, rows: int = 200) -> DataFrame:
    """plausible: the first rows' values are not negative, at most 300, and whole numbers if any exceeds 10."""
    v = values.orderBy(order).limit(rows).select(F.explode(array).alias("v"))
    return v.agg((~((F.min("v") < -0.01) | (F.max("v") > 300) | ((F.max("v") > 10) & (F.count_if(F.abs(F.col("v") - F.round("v")) > 1e-8) > 0)))).alias("plausible"))


def size_class(n: str, d: str) -> Column:
    """struct(large, label): more than 10,000 rows or 512 features are large; the label goes by rows alone."""
    return F.expr(f"struct({n} > 10000 or {d} > 512 as large, case when {n} > 50000 then '[HUGE]' when {n} > 10000 then '[LARGE]' else '[SMALL]' end as label)")


def upload_advice(n: str, d: str, image: str) -> Column:
    """Array of (mode, priority) for an upload of n rows and d features; image says whether it looks like pictures."""
    return F.expr(
        f"""concat(if({image}, array(struct('cnn_features' as mode, 'strongly_recommended' as priority), struct('raw_pixels' as mode, 'not_recommended' as priority)), array()),
        if({d} > 500 and not {image}, array(struct('pca_first' as mode, 'recommended' as priority)), array()), if({n} > 10000, array(struct('sample_first' as mode, 'recommended' as priority)), array()))"""
    )


def graph_defaults(n: str) -> Column:
    """struct(knn_k, label_propagation, random_walk) for a graph of n rows."""
    return F.expr(f"struct(least(30, greatest(5, cast(floor(sqrt({n})) as int))) as knn_k, {n} <= 5000 as label_propagation, {n} <= 5000 as random_walk)")


def structure_class(family: str, distortion: str, k2_ratio: str) -> Column:
    """What the data look like: hierarchical, graph_connected, non_convex, or what the family says."""
    return F.expr(
        f"""case when {k2_ratio} > 0.6 and {distortion} < 0.3 then 'hierarchical'
        when {distortion} > 0.5 or ({family} in ('non_convex', 'manifold') and {distortion} > 0.3) or ({family} = 'manifold' and {distortion} > 0.15) then 'graph_connected' else {family} end"""
    )


def structure_strategy(structure: str, distortion: str) -> Column:
    """struct(graph_expert, topology_boost, centroid_suppress)."""
    return F.expr(
        f"""struct({structure} = 'graph_connected' or {distortion} > 0.5 as graph_expert, {structure} in ('graph_connected', 'non_convex', 'manifold', 'hierarchical') as topology_boost,
        {structure} = 'graph_connected' and {distortion} > 0.3 as centroid_suppress)"""
    )


def centroid_ban(n: str, distortion: str) -> Column:
    """Algorithms that may not win on a long curve: none below 50 rows or up to a distortion of 0.35."""
    return F.when(F.expr(f"{n} >= 50 and {distortion} > 0.35"), F.array(*map(F.lit, CENTRE_ALGORITHMS))).otherwise(F.expr("cast(array() as array<string>)"))


def score_cascade(ari: str, silhouette: str, ch: str, clusters: str, n: str) -> Column:
    """struct(score, source): ARI if there is one, else a positive silhouette, else ch / (ch + 1000); 0 for fewer than two clusters or one a row."""
    fallback = f"if({ch} > 0, {ch} / ({ch} + {HALF_CH}D), 0D)"
    return F.expr(
        f"""case when {clusters} < 2 or {clusters} >= {n} then struct(0D as score, 'none' as source) when {ari} is not null then struct(cast({ari} as double) as score, 'ari' as source)
        when {silhouette} > 0 then struct(cast({silhouette} as double) as score, 'silhouette' as source) else struct({fallback} as score, 'calinski_harabasz' as source) end"""
    )


def best_by(df: DataFrame, key: str, score: Column, by: list[str] | None = None) -> DataFrame:
    """The key with the largest score, ties to the smaller key; for each `by`, if given."""
    best = F.min(F.struct((-score).alias("s"), F.col(key).alias("k"))).alias("best")
    out = df.groupBy(*by).agg(best) if by else df.agg(best)
    return out.select(*(by or []), F.col("best.k").alias(key))


def top_share(edges: DataFrame, score: str, share: float) -> DataFrame:
    """The floor(share * n), and at least one, edges with the largest scores, ties to the smaller ends: a sort by ranges with counts
    of what comes before each, so no task ranks all edges."""
    order = [F.desc(score), F.asc("src"), F.asc("dst")]
    return with_row_numbers(edges, order).join(F.broadcast(edges.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("most")))).filter("place <= most").drop("place", "most")


def with_row_numbers(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, the number of each row in a total order from 1: range partitions, numbered within and shifted by the sizes of those before.

    The numbered rows are written once: dealt out a second time, for the sizes, the ranges could be others.
    """
    sorted_rows = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    sorted_rows = materialize(sorted_rows.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order))), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shift = sorted_rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return sorted_rows.join(F.broadcast(shift), "part").withColumn("place", F.col("own") + F.col("shift")).drop("part", "own", "shift")


def union_common(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, with the columns that all of them have."""
    shared = [c for c in tables[0].columns if all(c in x.columns for x in tables)]
    return reduce(DataFrame.unionByName, [x.select(*shared) for x in tables])


def fuse_features(tables: list[DataFrame]) -> DataFrame:
    """id, f: the feature blocks of the ids that all tables(id, f) have, one after the other."""
    out = tables[0].select("id", F.col("f").alias("f0"))
    for i, x in enumerate(tables[1:], 1):
        out = out.join(x.select("id", F.col("f").alias(f"f{i}")), "id")
    return out.select("id", F.concat(*[f"f{i}" for i in range(len(tables))]).alias("f"))


def fingerprint(vectors: DataFrame, mode: str = "", most: int = 1000) -> DataFrame:
    """hash: 32 hex digits of the table's shape, at most `most` rows at an even stride of ids in order, their labels and the mode."""
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("f")).alias("d"))
    placed = with_row_numbers(vectors, [F.asc("id")]).crossJoin(F.broadcast(shape))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    rows = placed.filter((F.col("place") - 1) % step == 0).filter((F.col("place") - 1) / step < most)
    line = F.concat_ws(",", F.expr("transform(f, x -> cast(cast(floor(x * 1000000 + 0.5) as bigint) as string))"), F.coalesce(F.col("y").cast("string"), F.lit("")))
    body = rows.groupBy("n", "d").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))  # at most `most` rows
    return body.select(F.substring(F.sha2(F.concat_ws("|", F.col("n"), F.col("d"), F.concat_ws("|", F.expr("transform(x, y -> y.line)")), F.lit(mode)), 256), 1, 32).alias("hash"))


def right_wins(left: str, right: str) -> Column:
    """Two maps merged: the right one's value for a key that both have."""
    return F.expr(f"map_concat(map_filter({left}, (k, v) -> not map_contains_key({right}, k)), {right})")


def stratified_sample(df: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """About `most` rows with the labels' shares kept: whole quotas first, then one more for the largest remainders; the rows of a label
    are the first by the hash of their key.  All rows if there are no more than `most`."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))  # one row a label
    total = sizes.agg(F.sum("n").alias("total"))
    share = sizes.crossJoin(F.broadcast(total)).withColumn("exact", F.col("n") * most / F.col("total")).withColumn("whole", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), label))
    left = F.lit(most) - F.sum("whole").over(Window.partitionBy(F.lit(0)))
    quota = share.withColumn("quota", F.when(F.col("total") <= most, F.col("n")).otherwise(F.col("whole") + F.when(rank <= left, 1).otherwise(0))).select(F.col(label).alias("quota_label"), "quota")
    order = Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    ranked = df.withColumn("place", F.row_number().over(order)).join(F.broadcast(quota), F.col(label).eqNullSafe(F.col("quota_label")))
    return ranked.filter("place <= quota").drop("place", "quota", "quota_label")


def cluster_report(df: DataFrame, cluster: str, truth: str, target, value: str) -> DataFrame:
    """label, purity, recall, mean: the cluster with most rows of the target class, its share of them, theirs in it, and its mean value."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == target).alias("hits"), F.avg(value).alias("mean"))  # one row a cluster
    best = per.agg(F.min(F.struct((-F.col("hits")).alias("h"), F.col(cluster).alias("label"), "n", "mean")).alias("b"), F.sum("hits").alias("all"))
    return best.select("b.label", (-F.col("b.h") / F.col("b.n")).alias("purity"), F.coalesce(F.try_divide(-F.col("b.h"), F.col("all")), F.lit(0.0)).alias("recall"), "b.mean")


def nearest_anchor(agreement: DataFrame, anchors: DataFrame) -> DataFrame:
    """id, label: each row takes the label of the anchor that agrees with it most, ties to the smaller anchor; agreement(id, anchor, share)."""
    best = agreement.groupBy("id").agg(F.min(F.struct((-F.col("share")).alias("s"), "anchor")).alias("b"))
    return best.select("id", F.col("b.anchor").alias("anchor")).join(F.broadcast(anchors.select(F.col("id").alias("anchor"), "label")), "anchor").select("id", "label")
