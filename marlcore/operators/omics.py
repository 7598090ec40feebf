"""Expression tables (sample, feature, value): filters, normalisation, shuffled nulls, survival screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prevalent_features(counts: DataFrame, least: int = 3) -> DataFrame:
    """Rows of the features that at least `least` samples have above zero."""
    keep = counts.filter("value > 0").groupBy("feature").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select("feature")
    return counts.join(keep, "feature", "left_semi")


def normalise_counts(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """log(1 + target * value / total of the sample); samples without counts stay 0."""
    total = counts.groupBy("sample").agg(F.sum("value").alias("__t"))
    return counts.join(total, "sample").withColumn("value", F.log1p(F.coalesce(F.try_divide(F.col("value") * target, F.expr("nullif(__t, 0D)")), F.lit(0.0)))).drop("__t")


def shared_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features that both tables have."""
    return a.select("feature").distinct().join(b.select("feature").distinct(), "feature")


def focal_share(calls: DataFrame, level: float = 2) -> DataFrame:
    """feature, share of the samples with |value| >= level."""
    return calls.groupBy("feature").agg(F.avg((F.abs("value") >= level).cast("int")).alias("share"))


def shuffled_null(long: DataFrame, salt: int) -> DataFrame:
    """Each feature's values dealt anew to the samples, by a portable hash order: the marginals stay, the structure goes."""
    by = Window.partitionBy("feature")
    place = F.row_number().over(by.orderBy("sample"))
    deal = F.row_number().over(by.orderBy(F.expr(f"((sample * 1103515245 + feature * 12345 + {salt}) % 2147483648 * 69069 + {salt}) % 2147483647"), "sample"))
    values = long.withColumn("r", deal).select("feature", "r", "value")
    return long.withColumn("r", place).select("sample", "feature", "r").join(values, ["feature", "r"]).drop("r")


def survival_screen(long: DataFrame, outcome: DataFrame, top: int) -> DataFrame:
    """feature, chi2 of the `top` features whose split at the median parts the survival curves most (two-group log-rank).

    All features at once: leavers and deaths are summed by feature, side and time before risk sets are counted.
    """
    middle = long.groupBy("feature").agg(F.median("value").alias("m"))
    rows = long.join(middle, "feature").join(outcome, "sample").withColumn("high", (F.col("value") > F.col("m")).cast("int"))
    per = rows.groupBy("feature", "time").agg(F.count("*").alias("l"), F.sum("high").alias("lh"), F.sum("event").alias("d"), F.sum(F.col("event") * F.col("high")).alias("dh"))
    w = Window.partitionBy("feature").orderBy(F.desc("time"))
    risk = per.withColumn("n", F.sum("l").over(w)).withColumn("nh", F.sum("lh").over(w)).filter("d > 0 and n >= 2")
    sums = risk.groupBy("feature").agg(F.sum(F.expr("dh - d * nh / n")).alias("u"), F.sum(F.expr("d * (nh / n) * (1 - nh / n) * (n - d) / (n - 1)")).alias("v"))
    return sums.select("feature", F.coalesce(F.try_divide(F.col("u") * F.col("u"), "v"), F.lit(0.0)).alias("chi2")).orderBy(F.desc(F.round("chi2", 9)), "feature").limit(top)
