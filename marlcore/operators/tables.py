"""Plain table operators: selection, samples, splits, sessions, trace logs, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_labelled(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is neither NULL nor blank."""
    return df.filter(F.trim(F.col(label)) != "")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key: the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def portable_hash(c: str):
    """A whole-number hash that any SQL engine can compute."""
    return F.expr(f"({c} * 1103515245 + 12345) % 2147483648")


def stratified_split(df: DataFrame, key: str, label: str, share: float) -> DataFrame:
    """df with train (boolean): the first floor(share * n) rows of each label in hash order."""
    w = Window.partitionBy(label)
    ranked = df.withColumn("__r", F.row_number().over(w.orderBy(portable_hash(key), key))).withColumn("__n", F.count("*").over(w))
    return ranked.withColumn("train", F.col("__r") <= F.floor(F.col("__n") * share)).drop("__r", "__n")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    w = Window.partitionBy(label).orderBy(portable_hash(key), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def attach_last(left: DataFrame, right: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """left with the value that comes last in right's order for its key: later rows overwrite earlier ones."""
    return left.join(right.groupBy(key).agg(F.max_by(value, order).alias(value)), key, "left")


def quantile_bin(df: DataFrame, value: str, cuts: int) -> DataFrame:
    """df with bin: number of the exact quantile cut points at or below the value."""
    shares = ", ".join(f"{i / cuts}D" for i in range(1, cuts))
    points = df.agg(F.expr(f"percentile({value}, array({shares}))").alias("__p"))
    return df.crossJoin(F.broadcast(points)).withColumn("bin", F.expr(f"size(filter(__p, p -> p <= {value}))")).drop("__p")


def strided(df: DataFrame, order: str, stride: int) -> DataFrame:
    """Every stride-th row; the key's own value stands for its place, so no global sort is needed for dense keys."""
    return df.filter(F.col(order) % stride == 0)


def newest(df: DataFrame, key: str, updated: str, most: int) -> DataFrame:
    """The `most` keys with the latest update, ties to the larger key: a bounded top-k."""
    return df.groupBy(key).agg(F.max(updated).alias("updated"), F.count("*").alias("n")).orderBy(F.desc("updated"), F.desc(key)).limit(most)


def trace_stats(log: DataFrame) -> DataFrame:
    """calls, retries, tokens of a call log(event, tokens_in, tokens_out, is_retry); a fallback counts as a retry only."""
    call = F.col("event") != "provider_fallback"
    return log.agg(
        F.sum(F.when(call, 1).otherwise(0)).alias("calls"), F.sum(F.when(~call | F.col("is_retry"), 1).otherwise(0)).alias("retries"),
        F.sum(F.when(call, F.col("tokens_in")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(call, F.col("tokens_out")).otherwise(0)).alias("completion_tokens"),
    )


def call_costs(log: DataFrame, prices: DataFrame) -> DataFrame:
    """provider, calls, cost: tokens / 1000 at each provider's prices(provider, price_in, price_out)."""
    cost = F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out")
    return log.join(F.broadcast(prices), "provider").groupBy("provider").agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of right's latest row of the key at or before its own time: one sort of both, no range join."""
    both = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(other).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return out.filter("__side = 1").drop("__side", "__v")


def healing_stats(logs: DataFrame, attempt: str, success: str, soft: str, failed: str) -> DataFrame:
    """run, attempts, success, soft_failures, error of numbered log lines(run, pos, line), by regular expressions."""
    hit = lambda p: F.col("line").rlike(p)
    return logs.groupBy("run").agg(
        F.coalesce(F.max(F.expr(f"try_cast(nullif(regexp_extract(line, r'{attempt}', 1), '') as int)")), F.lit(0)).alias("attempts"),
        F.max(hit(success)).alias("success"), F.sum(hit(soft).cast("int")).alias("soft_failures"),
        F.max_by(F.when(hit(failed), F.substring("line", 1, 300)), F.when(hit(failed), F.col("pos"))).alias("error"),
    )
