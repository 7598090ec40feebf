"""Op 1: removal of long passages that an earlier document has, by maximal repeats of an enhanced suffix array.

Every window of LENGTH bytes has an anchor, its smallest hashed ANCHOR-byte string, so equal windows have equal anchors at
equal places.  The windows of one anchor form its context, a string of LENGTH to 2 * LENGTH - ANCHOR bytes; all windows of
a text lie in exactly one context each.  The steps, all by hash so that no group meets in one place unreduced:

1. documents are dealt into units; each unit tells each bucket of anchors which anchors it has (once each, with a bit for
   "in several documents"), and learns which of them another document has too; 32 bits beside the bucket do for that, as an
   anchor taken for a shared one costs time and changes nothing;
2. contexts of shared anchors go to the anchor's bucket, once a unit, with the smallest doc_id.  A bucket merges equal
   contexts, builds the suffix array of the different ones that share an anchor, scans it with a stack for the intervals
   of its common-prefix tree, and keeps those that are diverse to the left: maximal repeats, with all occurrences;
3. each unit learns for its contexts which stretches occur in a smaller doc_id, and cuts its texts.

A pair of equal windows lies in a maximal repeat that has both, and every window of a repeat occurs in all its documents,
so the bytes removed are exactly those that windows cover which also start in a document with a smaller doc_id.

Defined results: null text is the empty text; a null doc_id counts as larger than any other; documents with the same
doc_id do not remove each other's bytes; texts shorter than a window stay whole; texts of any length are read whole;
empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .planes import deal, pack, rows as dealt, steps, summed, unpack
from .suffixes import maximal_repeats
from .words import chunks, joined, mix, prefix_hash, span_hash

LENGTH, ANCHOR = 50, 18
_NO_ID = np.iinfo(np.int64).max


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n different partitions."""
    out: dict[int, int] = {}
    for k, p in spark.range(40 * n + 200).selectExpr("cast(id as int)", f"pmod(hash(cast(id as int)), {n})").collect():
        out.setdefault(p, k)
    return [out.get(p, p) for p in range(n)]


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All anchors of some texts: text, s1, s2 (first and last window start), hash of the anchor; data is their bytes."""
    data, starts = joined(texts)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"data": data, "starts": starts, "text": none, "s1": none, "s2": none, "h": np.zeros(0, np.uint64)}
    at = np.arange(n - ANCHOR + 1)
    h = span_hash(prefix_hash(data), at, at + ANCHOR)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # ties go to the left
    width, span = LENGTH - ANCHOR + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    best = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the window at each start
    text = np.searchsorted(starts, np.arange(len(best)), side="right") - 1
    inside = np.flatnonzero(np.arange(len(best)) + LENGTH <= starts[1:][text] - 1)
    best, text = best[inside], text[inside]
    if not len(best):
        return {"data": data, "starts": starts, "text": none, "s1": none, "s2": none, "h": np.zeros(0, np.uint64)}
    new = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(new[1:], len(best)) - 1
    return {"data": data, "starts": starts, "text": text[new], "s1": inside[new], "s2": inside[last], "h": h[best[new]]}


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """32 bits of an anchor's hash that tell anchors of a bucket apart, but for a few."""
    return (mix(h & ~np.uint64(1)) >> np.uint64(32)).astype(np.uint32)


def _split(bucket: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each bucket in a sorted array of buckets."""
    return np.searchsorted(bucket, np.arange(n + 1))


def _find(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each key, whether the sorted array `among` has it."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _texts(table) -> list:
    return table.column("text").cast("large_binary" if table.nbytes > 1 << 30 else "binary").to_pylist()


def _several(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, the place of the smallest id of each, and whether it has several ids."""
    order = np.lexsort((ids, key))
    k, i = key[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    several = np.maximum.reduceat(i, first) != i[first] if len(k) else np.zeros(0, bool)
    return k[first], order[first], several


def _tell_anchors(keys: list[int]):
    def run(table):
        import pyarrow as pa

        u, table = table.column("u")[0].as_py(), dealt(table.column("blob"))
        ids, found, docs = _ids(table.column("doc_id")), [], []
        for first, group in chunks(_texts(table)):
            a = anchors(group)
            found.append(a["h"] & ~np.uint64(1))
            docs.append(ids[first + a["text"]])
        h, _, several = _several(np.concatenate(found), np.concatenate(docs))
        both = np.sort(_buckets(h, len(keys)).astype(np.uint64) << np.uint64(33) | _short(h).astype(np.uint64) << np.uint64(1) | several)
        h, several, at = (both >> np.uint64(1)).astype(np.uint32), (both & np.uint64(1)).astype(bool), _split(both >> np.uint64(33), len(keys))
        full = [b for b in range(len(keys)) if at[b] < at[b + 1]]
        told = [pack(steps(h[at[b] : at[b + 1]]), several[at[b] : at[b + 1]]) for b in full]
        return pa.table({"r": pa.array([keys[b] for b in full], pa.int32()), "u": pa.array([u] * len(full), pa.int32()), "blob": pa.array(told, pa.binary())})

    return run


def _shared_anchors(table):
    import pyarrow as pa

    units = np.array(table.column("u").to_pylist(), np.int64)
    told = [unpack(b, np.uint32, bool) for b in table.column("blob").to_pylist()]
    h, several = np.concatenate([summed(a) for a, _ in told]), np.concatenate([b for _, b in told])
    unit = np.repeat(units, [len(a) for a, _ in told])
    order = np.argsort(h, kind="stable")
    h, several, unit = h[order], several[order], unit[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    shared = (np.logical_or.reduceat(several, first) | (np.diff(np.append(first, len(h))) > 1))[np.cumsum(new) - 1]
    h, unit = h[shared], unit[shared]
    order = np.argsort(unit, kind="stable")
    h, unit = h[order], unit[order]
    names = np.unique(unit)
    at = np.append(np.searchsorted(unit, names), len(unit))
    return pa.table({"u": pa.array(names, pa.int32()), "blob": pa.array([pack(steps(h[at[k] : at[k + 1]])) for k in range(len(names))], pa.binary())})


def _contexts(table, shared: np.ndarray):
    """For each group of texts: its first row, anchors (shared ones only) and the hash of each context."""
    for first, group in chunks(_texts(table)):
        a = anchors(group)
        keep = _find(_short(a["h"]), shared)
        for name in ("text", "s1", "s2", "h"):
            a[name] = a[name][keep]
        a["key"] = mix(span_hash(prefix_hash(a["data"]), a["s1"], a["s2"] + LENGTH) + a["h"] * np.uint64(3)) if len(a["h"]) else a["h"]
        yield first, a


def _spread(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of all bytes of stretches given by start and length, one after the other."""
    total = np.cumsum(lengths)
    out = np.ones(int(total[-1]) if len(total) else 0, np.int64)
    if len(out):
        out[0] = starts[0]
        out[total[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def _send_contexts(keys: list[int]):
    def run(docs, told):
        import pyarrow as pa

        schema = pa.schema([("r", pa.int32()), ("u", pa.int32()), ("blob", pa.binary()), ("bytes", pa.binary())])
        if not docs.num_rows or not told.num_rows:
            return schema.empty_table()
        u, docs = docs.column("u")[0].as_py(), dealt(docs.column("blob"))
        shared = np.sort(np.concatenate([summed(*unpack(b, np.uint32)) for b in told.column("blob").to_pylist()]))
        ids, parts = _ids(docs.column("doc_id")), []
        for first, a in _contexts(docs, shared):
            # once a group of texts: its different contexts
            doc = ids[first + a["text"]]
            key, at, several = _several(a["key"], doc)
            length = a["s2"][at] - a["s1"][at] + LENGTH
            parts.append((key, a["h"][at], doc[at], several, length, a["data"][_spread(length, a["s1"][at])]))
        key, h, doc, several, length = (np.concatenate([p[i] for p in parts]) for i in range(5))
        data, begin = np.concatenate([p[5] for p in parts]), np.concatenate([[0], np.cumsum(length)])[:-1]
        kinds, at, mixed = _several(key, doc)
        several = np.logical_or(mixed, np.bincount(np.searchsorted(kinds, key), several, len(kinds)) > 0)
        key, h, doc, length, begin = kinds, h[at], doc[at], length[at], begin[at]
        bucket, h = _buckets(h & ~np.uint64(1), len(keys)), _short(h)
        order = np.lexsort((key, h, bucket))
        bounds = _split(bucket[order], len(keys))
        rows, compressor = [], zstandard.ZstdCompressor(level=3)
        for b in range(len(keys)):
            if bounds[b] < bounds[b + 1]:
                o = order[bounds[b] : bounds[b + 1]]
                head = pack(key[o], steps(h[o]), doc[o], length[o].astype(np.uint8), several[o])
                rows.append((keys[b], u, head, compressor.compress(data[_spread(length[o], begin[o])].tobytes())))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()

    return run


_HEAD = np.dtype([("key", "<u8"), ("h", "<u4"), ("doc", "<i8"), ("length", "u1"), ("several", "?")])
_SPAN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("low", "u1"), ("high", "u1")])


def _heads(blob: bytes) -> np.ndarray:
    key, h, *rest = unpack(blob, *(_HEAD[c] for c in _HEAD.names))
    return np.rec.fromarrays([key, summed(h), *rest], dtype=_HEAD)


def _spans(blob: bytes) -> np.ndarray:
    return np.rec.fromarrays(unpack(blob, *(_SPAN[c] for c in _SPAN.names)), dtype=_SPAN)


def _repeats(table):
    """What each unit has to know of its contexts: stretches that occur in a smaller doc_id."""
    import pyarrow as pa

    unpack = zstandard.ZstdDecompressor()
    heads = [_heads(b) for b in table.column("blob").to_pylist()]
    data = np.frombuffer(b"".join(unpack.decompress(b) for b in table.column("bytes").to_pylist()), np.uint8)
    unit = np.repeat(np.array(table.column("u").to_pylist(), np.int64), [len(x) for x in heads])
    head = np.concatenate(heads).view(np.ndarray)
    begin = np.concatenate([[0], np.cumsum(head["length"].astype(np.int64))])
    order = np.lexsort((head["doc"], head["key"], head["h"]))
    key, h = head["key"][order], head["h"][order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])])
    first = order[np.flatnonzero(new)]  # of each different context, the entry with the smallest doc_id
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    least, kind_h = head["doc"][first], head["h"][first]
    spans = [(np.arange(len(first)), least, np.zeros(len(first), np.int64), head["length"][first].astype(np.int64))]
    alone = np.concatenate([[True], kind_h[1:] != kind_h[:-1]])
    alone &= np.concatenate([kind_h[1:] != kind_h[:-1], [True]])
    several = np.flatnonzero(~alone)
    if len(several):
        length = head["length"][first[several]].astype(np.int64)
        text = data[_spread(length, begin[first[several]])]
        starts = np.concatenate([[0], np.cumsum(length)])
        sizes, places = [], []
        for size, at in maximal_repeats(text, starts, LENGTH):
            sizes.append(size)
            places.append(at)
        if sizes:
            n = np.array([len(p) for p in places])
            at = np.concatenate(places)
            owner = np.searchsorted(starts, at, side="right") - 1
            low = at - starts[owner]
            smallest = np.repeat(np.minimum.reduceat(least[several[owner]], np.concatenate([[0], np.cumsum(n)[:-1]])), n)
            use = smallest < least[several[owner]]  # else the whole context says it already
            spans.append((several[owner][use], smallest[use], low[use], (low + np.repeat(sizes, n))[use]))
    k, doc, low, high = (np.concatenate([s[i] for s in spans]) for i in range(4))
    by = np.argsort(k, kind="stable")
    k, doc, low, high = k[by], doc[by], low[by], high[by]
    at = np.searchsorted(k, np.arange(len(first) + 1))
    # each entry of a unit gets the stretches of its context that can matter there
    count = (at[1:] - at[:-1])[kind]
    entry = np.repeat(np.arange(len(head)), count)
    row = _spread(count[count > 0], at[:-1][kind][count > 0])
    use = (doc[row] < head["doc"][entry]) | head["several"][entry]
    entry, row = entry[use], row[use]
    out = np.empty(len(row), _SPAN)
    out["key"], out["doc"], out["low"], out["high"] = head["key"][entry], doc[row], low[row], high[row]
    by = np.argsort(unit[entry], kind="stable")
    out, units = out[by], unit[entry][by]
    names = np.unique(units)
    at = np.append(np.searchsorted(units, names), len(units))
    return pa.table({"u": pa.array(names, pa.int32()), "blob": pa.array([pack(*(out[c][at[i] : at[i + 1]] for c in _SPAN.names)) for i in range(len(names))], pa.binary())})


def _cut(docs, told):
    import pyarrow as pa

    docs = dealt(docs.column("blob"))
    spans = np.concatenate([np.zeros(0, _SPAN), *[_spans(b) for b in told.column("blob").to_pylist()]]).view(np.ndarray)
    spans = spans[np.argsort(spans["key"], kind="stable")]
    known = np.unique(spans["key"])
    bounds = np.append(np.searchsorted(spans["key"], known), len(spans))
    ids, rows = _ids(docs.column("doc_id")), []
    for first, group in chunks(_texts(docs)):
        a = anchors(group)
        data, starts = a["data"], a["starts"]
        change = np.zeros(len(data) + 1, np.int64)
        if len(a["h"]) and len(known):
            key = mix(span_hash(prefix_hash(data), a["s1"], a["s2"] + LENGTH) + a["h"] * np.uint64(3))
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = np.flatnonzero(known[at] == key)
            n = bounds[at[hit] + 1] - bounds[at[hit]]
            who, row = np.repeat(hit, n), _spread(n, bounds[at[hit]])
            use = spans["doc"][row] < ids[first + a["text"][who]]
            who, row = who[use], row[use]
            np.add.at(change, a["s1"][who] + spans["low"][row], 1)
            np.add.at(change, a["s1"][who] + spans["high"][row], -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
        low, high = edge[::2], edge[1::2]  # runs never cross the blank between texts
        owner = np.searchsorted(starts, low, side="right") - 1
        per = np.searchsorted(owner, np.arange(len(group) + 1))
        for i, t in enumerate(group):
            runs = [(int(x), int(y)) for x, y in zip(low[per[i] : per[i + 1]] - starts[i], high[per[i] : per[i + 1]] - starts[i])]
            kept, at = [], 0
            for x, y in runs:
                kept.append(t[at:x])
                at = y
            kept.append(t[at:])
            rows.append((len(t), sum(y - x for x, y in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": x, "length": y - x} for x, y in runs]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)]
    return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and length of each removed run, in bytes)."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keys = even_keys(spark, n)
    unit = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)) + 1).cast("int"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(unit.alias("u"), "doc_id", "text")
    docs = docs.mapInArrow(deal, "u int, blob binary")  # texts travel packed
    told = docs.groupBy("u").applyInArrow(_tell_anchors(keys), "r int, u int, blob binary")
    shared = told.groupBy("r").applyInArrow(_shared_anchors, "u int, blob binary")
    sent = docs.groupBy("u").cogroup(shared.groupBy("u")).applyInArrow(_send_contexts(keys), "r int, u int, blob binary, bytes binary")
    known = sent.groupBy("r").applyInArrow(_repeats, "u int, blob binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, length: bigint>>"
    return docs.groupBy("u").cogroup(known.groupBy("u")).applyInArrow(_cut, schema)
