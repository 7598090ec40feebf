import random

import numpy as np
import pyarrow as pa

from marlcore.llm import planes, suffix_dedup
from tests.llm.test_operators import brute_spans


def test_columns_and_rows_come_back():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 32, 1000).astype(np.uint32))
    flags = h % 3 == 0
    a, b, c = planes.unpack(planes.pack(planes.steps(h), flags, h.astype(np.int64) - (1 << 40)), np.uint32, bool, np.int64)
    assert (planes.summed(a) == h).all() and (b == flags).all() and (c == h.astype(np.int64) - (1 << 40)).all()
    assert [len(x) for x in planes.unpack(planes.pack(h[:0], flags[:0]), np.uint32, bool)] == [0, 0]
    table = pa.table({"u": pa.array([3, 1, 3, 1], pa.int32()), "doc_id": pa.array([5, None, 6, 7], pa.int64()), "text": ["a", "bé", None, ""]})
    out = {r["u"]: planes.rows(pa.array([r["blob"]])).to_pylist() for b in planes.deal(table.to_batches()) for r in b.to_pylist()}
    assert out == {1: [{"doc_id": None, "text": "bé"}, {"doc_id": 7, "text": ""}], 3: [{"doc_id": 5, "text": "a"}, {"doc_id": 6, "text": None}]}


def test_anchors_are_told_in_few_bytes():
    """Without Spark: the messages between units and buckets are small, and lead to the same cuts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    passage = " ".join(word() for _ in range(12))
    rows = [(i, f"{' '.join(word() for _ in range(300))} {passage if i % 4 else ''} {' '.join(word() for _ in range(300))}") for i in range(40)]
    keys, units = [0, 1, 2], {}
    table = pa.table({"u": pa.array([i % 2 for i, _ in rows], pa.int32()), "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    for b in planes.deal(table.to_batches()):
        units[b.column("u")[0].as_py()] = pa.Table.from_batches([b])
    group = lambda t, c: {k: t.filter(pa.compute.equal(t[c], k)) for k in t[c].unique().to_pylist()}
    each = lambda f, parts, *more: pa.concat_tables([f(t, *(m[k] for m in more)) for k, t in parts.items()])
    told = each(suffix_dedup._tell_anchors(keys), units)
    n = sum(len(np.unique(suffix_dedup.anchors([t.encode() for i, t in rows if i % 2 == u])["h"])) for u in (0, 1))
    assert sum(len(b) for b in told["blob"].to_pylist()) < 4 * n
    shared = group(each(suffix_dedup._shared_anchors, group(told, "r")), "u")
    known = group(each(suffix_dedup._repeats, group(each(suffix_dedup._send_contexts(keys), units, shared), "r")), "u")
    got = {r["doc_id"]: tuple(r.values())[1:5] for r in each(suffix_dedup._cut, units, known).to_pylist()}
    assert got == brute_spans(rows)
