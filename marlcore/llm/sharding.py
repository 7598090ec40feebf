"""Op 4: a uniform shuffle into shards of exact size, in DataFrame functions only.

Rows belong to P source partitions by a hash.  The driver draws the P x S communication matrix, how many rows of each
partition go to each shard, from the multivariate hypergeometric law of a uniform shuffle; its size is bounded by
MAX_PARTITIONS.  Each partition permutes its rows and deals them out by the drawn counts, rows are exchanged, and each
shard permutes again in blocks whose offsets are known from their counts, so no shard is ever in one task.

The law that holds is `rows`: shards differ by one row at most.  Defined results: null text has no bytes; rows that are
alike in doc_id, size and checksum are interchangeable; empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows aimed at in a partition or block, and the most partitions (and blocks a shard) that there are.
ROWS, MAX_PARTITIONS = 8192, 4096


def draw_hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Successes in draws without replacement, by inversion from the mode; any size of population."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    sd = math.sqrt(draws * good * bad * (total - draws) / (total * total * max(total - 1, 1)))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    low, high = max(low, mode - int(14 * sd) - 14), min(high, mode + int(14 * sd) + 14)
    x = np.arange(low, high, dtype=np.float64)
    step = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(logs - logs.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right"))


def communication_matrix(rows: list[int], capacity: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Counts by partition and shard with the given margins, as a uniform permutation would give them."""
    left, out = list(capacity), []
    for n in rows:
        line, rest = [], sum(left)
        for c in left:
            k = draw_hypergeometric(c, rest - c, n, rng)
            line.append(k)
            rest, n = rest - c, n - k
        left = [c - k for c, k in zip(left, line)]
        out.append(line)
    return out


def shard_rows(rows: DataFrame, keys: list[str], shards: int, seed: int = 42) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard); keys tell rows apart."""
    spark = rows.sparkSession
    mixed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *keys)
    total = rows.count()
    parts = min(MAX_PARTITIONS, max(1, -(-total // ROWS)))
    rows = rows.withColumn("__part", F.pmod(mixed(1), F.lit(parts)))
    counts = {r[0]: r[1] for r in rows.groupBy("__part").count().collect()}  # at most MAX_PARTITIONS rows
    order = sorted(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[p] for p in order], capacity, np.random.default_rng(seed))
    ends = spark.createDataFrame([(p, np.cumsum(line).tolist()) for p, line in zip(order, matrix)], "__part bigint, __ends array<bigint>")
    here = Window.partitionBy("__part").orderBy(mixed(2), *keys)
    dealt = (
        rows.withColumn("__n", F.row_number().over(here))
        .join(F.broadcast(ends), "__part")
        .withColumn("shard", F.expr("cast(size(filter(__ends, e -> e < __n)) as int)"))
        .drop("__part", "__ends", "__n")
    )
    blocks = min(MAX_PARTITIONS, max(1, -(-total // (shards * ROWS))))
    dealt = materialize(dealt.withColumn("__block", F.pmod(mixed(3), F.lit(blocks))), "dealt")
    sizes = dealt.groupBy("shard", "__block").count()
    before = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__from"))
    there = Window.partitionBy("shard", "__block").orderBy(mixed(4), *keys)
    return (
        dealt.withColumn("__n", F.row_number().over(there))
        .join(F.broadcast(offsets.limit(shards * MAX_PARTITIONS)), ["shard", "__block"])
        .withColumn("slot", (F.col("__from") + F.col("__n") - 1).cast("bigint"))
        .drop("__block", "__from", "__n")
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    out = shard_rows(materialize(rows, "sizes"), ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
