"""Which sets of shingles can link at all, known from the shingles that several texts have.

A set of n elements that is linked with a different set at `percent` shares at least percent * n / 100 elements with it.  So a set
that has fewer elements which occur in another set too has no link.  Units of text tell buckets of element hashes which
elements they have (once each, the first BITS bits of a hash, sorted and as differences); a bucket answers which of a
unit's elements another unit has too; the unit counts them for each text.  An element that several texts of a unit have is told
once, so no hot element reaches its bucket more than once a unit.  Hashes that clash only add prospects, never remove one.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, release

#: Bits of an element's hash that are told; bytes of text of a unit and, about, of a bucket; bytes that are hashed at once.
BITS, UNIT, BUCKET, AT_ONCE = 48, 1 << 23, 1 << 24, 1 << 20


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, without the planes that are zero."""
    x = np.ascontiguousarray(x, "<u8")
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + len(x).to_bytes(8, "little") + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack(blob, at: int = 0) -> tuple[np.ndarray, int]:
    """The integers packed at a place of a blob, and where the next ones are."""
    planes, n = blob[at], int.from_bytes(blob[at + 1 : at + 9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(blob, np.uint8, planes * n, at + 9).reshape(planes, n).T
    return out.reshape(-1).view("<u8"), at + 9 + planes * n


def _tell(size: int, buckets: int):
    """Rows u, r, head, blob: for each unit, a message to each bucket, and one (head) that comes back to the unit."""
    from .jaccard import set_keys, shingle_sets

    shift = BITS - (buckets.bit_length() - 1)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        unit, squeeze = TaskContext.get().partitionId() << 24, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            known, number = ~np.array(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
            for first, group in chunks((x.as_py() for x in batch.column(1)), UNIT):
                parts = [shingle_sets(g, size) for _, g in chunks(group, AT_ONCE)]
                h = np.concatenate([x for x, _ in parts])
                n = np.concatenate([np.diff(b) for _, b in parts])
                keys = set_keys(h, np.concatenate([[0], np.cumsum(n)]))
                del parts
                here = slice(first, first + len(group))
                # of equal sets in the unit, one tells its elements
                _, own, same = np.unique(np.rec.fromarrays([keys[:, 0], keys[:, 1], known[here]]), return_index=True, return_inverse=True)
                tells = np.zeros(len(n), bool)
                tells[own] = known[here][own]
                owner = np.repeat(np.arange(len(n)), n)
                use = tells[owner]
                x, owner = h[use] >> np.uint64(64 - BITS), owner[use]
                order = np.argsort(x, kind="stable")
                x, owner = x[order], owner[order]
                new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                several = np.diff(np.append(new, len(x))) > 1
                base = np.bincount(owner[np.repeat(several, np.diff(np.append(new, len(x))))], minlength=len(n))
                x, owner = x[new], owner[new]
                at = np.searchsorted(x, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(shift))
                rows = [(unit % buckets, True, squeeze.compress(pack(number[here].view(np.uint64)) + pack(known[here]) + pack(n) + pack(keys[:, 0]) + pack(keys[:, 1]) + pack(base) + pack(own[same])))]
                for b in np.flatnonzero(at[1:] > at[:-1]).tolist():
                    y, s = x[at[b] : at[b + 1]], several[at[b] : at[b + 1]]
                    rows.append((b, False, squeeze.compress(pack(np.diff(y, prepend=np.uint64(0))) + pack(s) + pack(owner[at[b] : at[b + 1]][~s]))))
                for low in range(0, len(rows), 64):
                    r, head, blob = zip(*rows[low : low + 64])
                    yield pa.RecordBatch.from_arrays([pa.array([unit] * len(r), pa.int64()), pa.array(r, pa.int64()), pa.array(head), pa.array(blob, pa.binary())], ["u", "r", "head", "blob"])
                unit += 1
        release()

    return run


def _answer(table):
    """u, head, blob: the heads as they came, and for each unit the texts (once for each element) whose elements other units have."""
    import pyarrow as pa

    squeeze, loosen = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    units, out = [], []
    x, several, unit, owner = [], [], [], []
    for u, head, blob in zip(table.column("u").to_pylist(), table.column("head").to_pylist(), table.column("blob")):
        if head:
            out.append((u, True, blob.as_py()))
            continue
        raw = loosen.decompress(blob.as_py())
        d, at = unpack(raw)
        s, at = unpack(raw, at)
        o = np.zeros(len(d), np.uint64)
        o[s == 0] = unpack(raw, at)[0]
        x.append(np.cumsum(d, dtype=np.uint64))
        several.append(s > 0)
        owner.append(o.astype(np.uint32))
        unit.append(np.full(len(d), len(units), np.int32))
        units.append(u)
    if units:
        x, several, owner, unit = (np.concatenate(c) for c in (x, several, owner, unit))
        order = np.argsort(x, kind="stable")
        x = x[order]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        first = np.flatnonzero(new)
        shared = np.logical_or.reduceat(several[order], first) | (np.diff(np.append(first, len(x))) > 1)
        told = order[shared[np.cumsum(new) - 1] & ~several[order]]
        del x, order, new
        told = told[np.argsort(unit[told], kind="stable")]
        at = np.searchsorted(unit[told], np.arange(len(units) + 1))
        for i in np.flatnonzero(at[1:] > at[:-1]).tolist():
            out.append((units[i], False, squeeze.compress(pack(np.sort(owner[told[at[i] : at[i + 1]]])))))
    u, head, blob = zip(*out) if out else ((), (), ())
    return pa.table({"u": pa.array(u, pa.int64()), "head": pa.array(head, pa.bool_()), "blob": pa.array(blob, pa.binary())})


def _count(percent: int):
    def run(table):
        import pyarrow as pa

        loosen, shared = zstandard.ZstdDecompressor(), []
        for head, blob in zip(table.column("head").to_pylist(), table.column("blob")):
            raw = loosen.decompress(blob.as_py())
            if head:
                parts, at = [], 0
                for _ in range(7):
                    part, at = unpack(raw, at)
                    parts.append(part)
            else:
                shared.append(unpack(raw)[0])
        number, known, n, key0, key1, base, own = parts
        total = base.astype(np.int64)
        for owner in shared:
            total += np.bincount(owner.astype(np.int64), minlength=len(total))
        n = n.astype(np.int64)
        hope = (known > 0) & (n > 0) & (100 * total[own.astype(np.int64)] >= percent * n)
        keys = np.stack([key0, key1], axis=1)
        ids = pa.array(number.view(np.int64), pa.int64(), mask=known == 0)
        return pa.table({"doc_id": ids, "n": pa.array(n), "k": pa.array([x.tobytes() for x in keys], pa.binary()), "hope": pa.array(hope)})

    return run


def prospects(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (elements), k (key of the set) and hope (false: no different set is similar enough) of docs(doc_id, text)."""
    whole = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(6, (whole // BUCKET).bit_length())
    told = docs.select("doc_id", "text").mapInArrow(_tell(size, buckets), "u bigint, r bigint, head boolean, blob binary")
    answers = told.groupBy("r").applyInArrow(_answer, "u bigint, head boolean, blob binary")
    return answers.groupBy("u").applyInArrow(_count(percent), "doc_id bigint, n bigint, k binary, hope boolean")
