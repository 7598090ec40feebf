"""Op 7: packing by power-of-two decomposition.

A document of n ids (its BPE ids and one end id) is cut into pieces of `longest` ids while that many are left, and the
rest by the binary digits of its length, largest first.  Pieces of one length form a bucket; each piece is a sequence of
its own whose length is a power of two, so nothing is padded and no sequence crosses documents.  Sequence ids run bucket by
bucket, so a loader fills a batch from one bucket: a range of ids.

Defined results: null text is the empty text, whose one piece is the end id; whole texts are encoded; repeated rows give
repeated pieces with sequence ids of their own; extra columns, whatever their names, do not matter; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import CACHE, codec
from .words import release

#: Documents aimed at in a block of sequence numbers, and the most blocks that there are.
BLOCK, MAX_BLOCKS = 8192, 4096


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, none above longest, largest first, that sum to n."""
    out = [longest] * (n // longest)
    n %= longest
    return out + [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(docs: DataFrame, path: str, longest: int = 2048, end_id: int = 1, with_ids: bool = False, cache_size: int = CACHE) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of length); with_ids adds ids (binary)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest has to be a power of two")
    end = end_id.to_bytes(4, "little")
    schema = "doc_id bigint, pieces array<struct<start: bigint, length: bigint, ids_crc32: bigint" + ", ids: binary" * with_ids + ">>, doc_tokens bigint"

    def run(batches):
        import pyarrow as pa

        c = codec(path, cache_size)
        for batch in batches:
            starts, lengths, sums, blobs, counts, totals = [], [], [], [], [], []
            for _, ids, bounds in c.encode_batches(batch.column(1)):
                for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own, at = memoryview(ids[low:high].tobytes() + end), 0
                    pieces = piece_lengths(len(own) // 4, longest)
                    for n in pieces:
                        piece = own[4 * at : 4 * (at + n)]
                        starts.append(at)
                        sums.append(zlib.crc32(piece))
                        if with_ids:
                            blobs.append(bytes(piece))
                        at += n
                    lengths += pieces
                    counts.append(len(pieces))
                    totals.append(at)
            fields = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())] + [pa.array(blobs, pa.binary())] * with_ids
            struct = pa.StructArray.from_arrays(fields, ["start", "length", "ids_crc32"] + ["ids"] * with_ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(totals, pa.int64())], ["doc_id", "pieces", "doc_tokens"])
        release()

    packed = materialize(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema), "pieces")
    blocks = min(MAX_BLOCKS, max(1, -(-packed.count() // BLOCK)))
    keys = ["doc_id", "doc_tokens", "tie", "start"]
    tie = F.xxhash64("doc_id", "doc_tokens", F.to_json("pieces") if with_ids else F.col("pieces"))
    packed = packed.select("doc_id", "doc_tokens", tie.alias("tie"), "pieces").withColumn("block", F.pmod("tie", F.lit(blocks)))
    # sequence ids go bucket by bucket, and in a bucket block by block: at most MAX_BLOCKS rows for each power of two up to longest
    rows = packed.select("doc_id", "doc_tokens", "tie", "block", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "tie", "block", "p.*")
    sizes = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")).limit(MAX_BLOCKS * longest.bit_length())
    # a block's documents come together, and are taken apart there
    rows = packed.repartition("block").select("doc_id", "doc_tokens", "tie", "block", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "tie", "block", "p.*")
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy("block", "length").orderBy(*keys)) - 1).join(F.broadcast(offsets), ["length", "block"])
    return out.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("from") + F.col("place")).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        F.log2("length").cast("int").alias("bucket"), *["ids"] * with_ids,
    )
