"""Feature tables: rows (id, f ARRAY<DOUBLE>, y INT) and their long form (id, y, dim, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vector_table(df: DataFrame, id_col: str, array_col: str, label_col: str | None = None) -> DataFrame:
    label = F.col(label_col).cast("int") if label_col else F.lit(None).cast("int")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(array_col).cast("array<double>").alias("f"), label.alias("y"))


def long_form(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", "y", F.posexplode("f").alias("dim", "v"))


def wide_form(long: DataFrame, value: str = "v") -> DataFrame:
    """Arrays again, in order of dim."""
    packed = long.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dim", value))).alias("p"))
    return packed.select("id", F.expr(f"transform(p, x -> x.{value})").alias("f"))


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")


def squared_distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")


def distance(a: str, b: str, metric: str = "euclidean") -> Column:
    """Distance of two array columns; cosine distance of a zero vector is 1."""
    if metric == "euclidean":
        return F.sqrt(squared_distance(a, b))
    if metric == "sqeuclidean":
        return squared_distance(a, b)
    if metric == "cosine":
        return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
    raise ValueError(f"unknown metric {metric}")


def feature_stats(long: DataFrame) -> DataFrame:
    """One row a dimension; at most as many rows as there are features."""
    return long.groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def standardise(vectors: DataFrame) -> DataFrame:
    """(v - mean) / population standard deviation for each feature; constant features become 0."""
    long = long_form(vectors)
    z = F.coalesce(F.try_divide(F.col("v") - F.col("mean"), F.expr("nullif(std, 0D)")), F.lit(0.0))
    return long.join(F.broadcast(feature_stats(long)), "dim").select("id", "y", "dim", z.alias("v"))


def min_max(vectors: DataFrame) -> DataFrame:
    long = long_form(vectors)
    z = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.expr("nullif(high - low, 0D)")), F.lit(0.0))
    return long.join(F.broadcast(feature_stats(long)), "dim").select("id", "y", "dim", z.alias("v"))


def l2_normalise(vectors: DataFrame) -> DataFrame:
    """Rows of length 1; a zero row stays zero."""
    norm = F.sqrt(dot("f", "f"))
    return vectors.withColumn("__n", norm).withColumn("f", F.expr("transform(f, x -> if(__n = 0, 0D, x / __n))")).drop("__n")


def median_absolute_deviation(long: DataFrame) -> DataFrame:
    """dim, mad: median of |v - median(v)| for each feature, by two aggregations."""
    centre = long.groupBy("dim").agg(F.median("v").alias("m"))
    return long.join(F.broadcast(centre), "dim").groupBy("dim").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))


def top_features(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The n features with the largest score, ties to the smaller dim: a bounded top-k sort."""
    return scores.orderBy(F.desc(score), "dim").limit(n)


def fill_missing_with_median(long: DataFrame) -> DataFrame:
    """NULL and NaN values become the median of all values."""
    clean = F.when(F.isnan("v"), None).otherwise(F.col("v"))
    known = long.withColumn("v", clean)
    return known.crossJoin(F.broadcast(known.agg(F.median("v").alias("m")))).withColumn("v", F.coalesce("v", "m")).drop("m")


def log_if_counts(long: DataFrame) -> DataFrame:
    """log(1 + v) of all values if none is negative and some exceed 50, else the values as they are."""
    edge = long.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return long.crossJoin(F.broadcast(edge)).withColumn("v", F.when((F.col("low") >= 0) & (F.col("high") > 50), F.log1p("v")).otherwise(F.col("v"))).drop("low", "high")


def centroids(vectors: DataFrame, label: str = "y") -> DataFrame:
    """label, dim, c: mean of each feature in each cluster."""
    long = vectors.select(F.col(label).alias("label"), F.posexplode("f").alias("dim", "v"))
    return long.groupBy("label").agg(F.count("*").alias("__n")).select("label").join(long.groupBy("label", "dim").agg(F.avg("v").alias("c")), "label")


def centroid_arrays(vectors: DataFrame, label: str = "y") -> DataFrame:
    """label, c (array), n."""
    means = vectors.select(F.col(label).alias("label"), F.posexplode("f").alias("dim", "v")).groupBy("label", "dim").agg(F.avg("v").alias("c"), F.count("*").alias("n"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("p"), F.max("n").alias("n"))
    return packed.select("label", F.expr("transform(p, x -> x.c)").alias("c"), "n")


def assign_nearest(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """id, y, label, d of the nearest of a few centres(label, c); ties to the smaller label.  centres: one row a cluster."""
    pairs = vectors.crossJoin(F.broadcast(centres.select("label", "c"))).withColumn("d", F.sqrt(squared_distance("f", "c")))
    return pairs.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("d", "label")).alias("b")).select("id", "y", F.col("b.label").alias("label"), F.col("b.d").alias("d"))


def medoids(vectors: DataFrame, label: str = "y") -> DataFrame:
    """label, id, s: the member with the smallest sum of distances to its cluster, ties to the smaller id."""
    from .neighbors import pair_sums

    sums = pair_sums(vectors, label).filter("label = other")
    return sums.groupBy("label").agg(F.min(F.struct("s", "id")).alias("b")).select("label", F.col("b.id").alias("id"), F.col("b.s").alias("s"))


def soft_assignment(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """id, label, q, p: Student-t similarities to the centres, and the sharpened target distribution q**2 / f."""
    k = vectors.crossJoin(F.broadcast(centres.select("label", "c"))).withColumn("k", 1 / (1 + squared_distance("f", "c")))
    q = k.select("id", "label", (F.col("k") / F.sum("k").over(Window.partitionBy("id"))).alias("q"))
    f = q.groupBy("label").agg(F.sum("q").alias("f"))
    sharp = q.join(F.broadcast(f), "label").withColumn("s", F.col("q") * F.col("q") / F.col("f"))
    return sharp.select("id", "label", "q", (F.col("s") / F.sum("s").over(Window.partitionBy("id"))).alias("p"))


def gaussian_assignment(vectors: DataFrame, floor: float = 1e-6) -> DataFrame:
    """id, label: most likely diagonal Gaussian, fitted to the labels y by their shares, means and variances."""
    long = long_form(vectors)
    fit = long.groupBy("y", "dim").agg(F.avg("v").alias("m"), (F.var_pop("v") + floor).alias("s"), F.count("*").alias("n"))
    packed = fit.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("g"), F.max("n").alias("n"))
    packed = packed.withColumn("prior", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))  # one row a cluster
    gs = packed.select(F.col("y").alias("label"), "g", "prior")
    score = F.expr("prior - 0.5D * aggregate(zip_with(f, g, (x, c) -> ln(2 * pi() * c.s) + (x - c.m) * (x - c.m) / c.s), 0D, (a, x) -> a + x)")
    scored = vectors.crossJoin(F.broadcast(gs)).withColumn("score", score)
    return scored.groupBy("id").agg(F.min(F.struct(-F.col("score"), "label")).alias("b")).select("id", F.col("b.label").alias("label"))
