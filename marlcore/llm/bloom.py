"""Bloom filters as tables of 64-bit words, in DataFrame functions only: built by group-bys, asked by broadcast joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a filter, in bits: at most MAX_BITS / 64 rows of 16 bytes are broadcast.
MIN_BITS, MAX_BITS, BITS_A_ROW, HASHES = 1 << 12, 1 << 26, 16, 2


def filter_bits(rows: int, most: int | None = None) -> int:
    return min(most or MAX_BITS, max(MIN_BITS, 1 << (BITS_A_ROW * max(rows, 1) - 1).bit_length()))


def positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def build_filter(rows: DataFrame, key: str, bits: int, least: int = 1) -> DataFrame:
    """word, marks of the positions that at least `least` rows set."""
    seen = rows.select(F.explode(F.array(*positions(F.col(key), bits))).alias("at")).groupBy("at").count()
    return seen.filter(f"count >= {least}").groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("marks"))


def ask_filter(rows: DataFrame, key: Column, words: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """rows with the filter's words beside them, as one new column `bloom`, and whether all positions of a row are marked."""
    words, hits = words.limit(bits // 64), []
    rows = rows.withColumn("bloom", F.struct(*[at.alias(f"at{i}") for i, at in enumerate(positions(key, bits))]))
    for i in range(HASHES):
        mine = words.select(F.col("word").alias(f"bloom_word{i}"), F.col("marks").alias(f"bloom_marks{i}"))
        rows = rows.join(F.broadcast(mine), F.expr(f"bloom.at{i} div 64") == F.col(f"bloom_word{i}"), "left").drop(f"bloom_word{i}")
        hits.append(F.expr(f"coalesce(shiftright(bloom_marks{i}, cast(bloom.at{i} % 64 as int)) & 1L, 0L) = 1L"))
    return rows, reduce(lambda a, b: a & b, hits)
