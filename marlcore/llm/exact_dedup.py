"""Op 2: exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts, for each position of a Bloom filter, the rows that set it (partial sums before the shuffle, eight bytes a
position); positions that two rows set form the filter of possibly repeated hashes.  It has BITS_A_ROW bits a row, up to a fixed
bound, so it is broadcast.  Pass 2 tests every row against it: rows whose positions are not all marked are unique for certain
and pass straight through; only the others shuffle, as digests, and are grouped exactly.  Beyond the bound (about 4 million rows; the
filter still clears most rows up to some 60 million) it only sends more rows to the exact grouping; results never depend on it.

Defined results: texts are equal when identical after lower-casing A-Z; null text is the empty text; of equal texts the
row with the largest doc_id stays (a null doc_id is smaller than any; of rows that tie, exactly one stays); empty tables
give empty results; extra columns, whatever their names and kinds, do not matter.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import attach_groups
from ..session import discard, materialize
from .bloom import ask_filter, build_filter, filter_bits


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null as empty.  The general path runs only where there are other letters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def digest(text: Column) -> Column:
    return F.sha2(F.encode(ascii_lower(text), "UTF-8"), 256)


def marked_digests(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Both passes: rows with maybe_repeated, written out, and their number."""
    rows = materialize(rows, "digests")
    total = rows.count()
    bits = filter_bits(total)
    words = materialize(build_filter(rows, key, bits, least=2), "bloom")
    asked, hit = ask_filter(rows, F.col(key), words, bits)
    marked = materialize(asked.select(*rows.columns, hit.alias("maybe_repeated")), "marked")
    discard(rows, words)
    return marked, total


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(F.col("text")).alias("text_sha256"))
    marked, total = marked_digests(rows.withColumn("rid", F.monotonically_increasing_id()), "text_sha256")
    maybe = marked.filter("maybe_repeated").drop("maybe_repeated")
    groups = maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep"))
    out = attach_groups(maybe, materialize(groups, "groups"), "text_sha256", "group_size", total).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256"
    )
    through = marked.filter("not maybe_repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return through.unionByName(out)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: the pipeline stage.

    Rows that the filter clears keep their place; only rows of possibly repeated texts meet their group.
    """
    keys = docs.select(digest(F.col("text")).alias("k"))
    total = keys.count()
    bits = filter_bits(total)
    words = materialize(build_filter(materialize(keys, "digests"), "k", bits, least=2), "bloom")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("id"), digest(F.col("text")).alias("k"))
    marked, hit = ask_filter(rows, F.col("k"), words, bits)
    marked = marked.withColumn("maybe", hit)
    through = marked.filter("not maybe").select("row.*")
    # rows of one group that share the doc_id are told apart by all they hold; equal ones by a number
    maybe = marked.filter("maybe").select("row", "id", "k", F.xxhash64(F.to_json("row")).alias("h"))
    best = materialize(maybe.groupBy("k").agg(F.max(F.struct("id", "h")).alias("b")).select("k", F.col("b.id").alias("id"), F.col("b.h").alias("h")), "kept")
    # only the row that stays meets its group here, so that no key is hot on either side
    same = (maybe["k"] == best["k"]) & maybe["id"].eqNullSafe(best["id"]) & (maybe["h"] == best["h"])
    one = Window.partitionBy("k").orderBy("h")
    kept = maybe.join(best, same, "left_semi").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return through.unionByName(kept.select("row.*"))
