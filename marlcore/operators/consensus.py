"""Agreement of several partitions of the same rows: runs(algorithm, id, label, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality_gate(runs: DataFrame, share: float = 0.2) -> DataFrame:
    """Runs of algorithms with 2 <= clusters <= max(share * rows, 2), not all noise, and a positive score."""
    n = F.greatest(F.floor(F.count("*") * share), F.lit(2))
    ok = runs.groupBy("algorithm").agg(F.count_distinct("label").alias("k"), n.alias("most"), F.max("label").alias("top"), F.max("score").alias("score"))
    ok = ok.filter("k between 2 and most and top >= 0 and score > 0").select("algorithm")
    return runs.join(F.broadcast(ok), "algorithm", "left_semi")


def signatures(runs: DataFrame) -> DataFrame:
    """signature, members: rows with equal labels in all runs are interchangeable, so pairs are met between groups of them."""
    own = runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("algorithm", "label"))).alias("s"))
    return own.groupBy("s").agg(F.count("*").alias("members"), F.min("id").alias("first"))


def coassociation(runs: DataFrame, weighted: bool = False) -> DataFrame:
    """a, b (smallest id of each group of interchangeable rows), members of both, and the share of runs (weighted: of their scores) that put them together.

    Groups of at least one common label are joined on it, so no pair without agreement is ever made.
    """
    groups = signatures(runs)
    weights = runs.groupBy("algorithm").agg(F.max("score").alias("weight") if weighted else F.lit(1.0).alias("weight"))  # one row an algorithm
    total = weights.agg(F.sum("weight")).first()[0] or 1.0
    long = groups.select("first", "members", F.explode("s").alias("x")).select("first", "members", "x.algorithm", "x.label")
    other = long.select(F.col("first").alias("b"), F.col("members").alias("nb"), "algorithm", "label")
    pairs = long.select(F.col("first").alias("a"), F.col("members").alias("na"), "algorithm", "label").join(other, ["algorithm", "label"]).filter("a <= b")
    return pairs.join(F.broadcast(weights), "algorithm").groupBy("a", "b", "na", "nb").agg((F.sum("weight") / total).alias("share"))


def agreement_entropy(runs: DataFrame) -> DataFrame:
    """agreement: mean over pairs of rows of 1 - 2 M s (1 - s) / (M - 1), s the share of runs together; and its binary entropy."""
    m = runs.select("algorithm").distinct().count()
    n = runs.select("id").distinct().count()
    co = coassociation(runs)
    lost = F.expr(f"2.0D * {m} * share * (1 - share) / {max(m - 1, 1)}")
    weight = F.expr("if(a = b, na * (na - 1), 2 * na * nb)")
    out = co.agg(F.sum(lost * weight).alias("lost")).select((1 - F.coalesce("lost", F.lit(0.0)) / max(n * (n - 1), 1)).alias("agreement"))
    p = "greatest(0.01D, least(0.99D, agreement))"
    return out.withColumn("entropy", F.expr(f"-{p} * log2({p}) - (1 - {p}) * log2(1 - {p})"))


def voted_k(runs: DataFrame) -> DataFrame:
    """k, votes: the number of clusters that most algorithms find, ties to the smaller; noise counts as a cluster."""
    per = runs.groupBy("algorithm").agg(F.count_distinct("label").alias("k"))
    return per.groupBy("k").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "k").limit(1)


def disagreement(runs: DataFrame, consensus: DataFrame) -> DataFrame:
    """ratio: share of rows where at least half of the runs differ from the consensus label (raw ids)."""
    votes = runs.join(consensus.select("id", F.col("label").alias("c")), "id").groupBy("id").agg(F.avg(F.when(F.col("label") != F.col("c"), 1.0).otherwise(0.0)).alias("v"))
    return votes.agg(F.avg(F.when(F.col("v") >= 0.5, 1.0).otherwise(0.0)).alias("ratio"))


def rank_results(results: DataFrame, banned: list[str], blocked: list[str]) -> DataFrame:
    """results(algorithm, ari, nmi, internal) with rank: banned and blocked algorithms sort as ARI 0, unlabelled ones by internal
    scores of 0.65 at most if no labelled one reaches 0.5, else last; ties by NMI, then internal."""
    out = [F.lit(a) for a in [*banned, *blocked]]
    veto = F.col("algorithm").isin(*[*banned, *blocked]) if out else F.lit(False)
    best = F.max("ari").over(Window.partitionBy(F.lit(0)))  # one row an algorithm
    pseudo = F.when(F.coalesce(best, F.lit(0.0)) < 0.5, F.when(F.col("internal") > 0, F.least("internal", F.lit(0.65))).otherwise(0.0)).otherwise(-1.0)
    sort = F.when(F.col("ari").isNull(), pseudo).when(veto, 0.0).otherwise(F.col("ari"))
    ranked = results.withColumn("sort_ari", sort)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("sort_ari"), F.desc(F.coalesce("nmi", F.lit(0.0))), F.desc("internal"), "algorithm")
    return ranked.withColumn("rank", F.row_number().over(order))


def consensus_trap(results: DataFrame, ensemble: str = "EnsembleConsensus") -> DataFrame:
    """gap, outperformed_by, trap: the best single algorithm beats the ensemble by over 0.03 while its agreement is 0.7 or more."""
    single = results.filter((F.col("algorithm") != ensemble) & ~F.col("algorithm").startswith("_")).agg(F.max(F.struct("ari", "algorithm")).alias("s"))
    own = results.filter(F.col("algorithm") == ensemble).select(F.col("ari").alias("own"), "internal")
    return own.crossJoin(single).select((F.col("s.ari") - F.col("own")).alias("gap"), F.col("s.algorithm").alias("outperformed_by"), F.expr("s.ari > 0 and s.ari - own > 0.03 and internal >= 0.7").alias("trap"))


def roll_up(runs: DataFrame) -> DataFrame:
    """Per data set, per expert and overall totals of benchmark runs, by grouping sets in one aggregation."""
    ok = lambda c: F.when(F.col("success"), F.col(c))
    real = lambda c: F.when(F.col("success") & ~F.isnan(c), F.col(c))
    return (
        runs.groupingSets([[F.col("dataset")], [F.col("expert")], []], "dataset", "expert")
        .agg(
            F.count("*").alias("algorithms_run"), F.sum(F.col("success").cast("int")).alias("successful"),
            F.round(F.coalesce(F.sum(ok("score")), F.lit(0.0)) / F.greatest(F.sum(F.col("success").cast("int")), F.lit(1)), 4).alias("avg_score"),
            F.round(F.avg(real("ari")), 4).alias("avg_ari"), F.round(F.avg(F.col("success").cast("int")), 4).alias("success_rate"),
            F.round(F.avg("time_ms"), 0).alias("avg_latency_ms"), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"),
        )
    )
