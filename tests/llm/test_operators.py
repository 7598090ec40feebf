import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlcore.llm import bloom, bpe, entries, exact_dedup, html_text, jaccard, packing, secrets, sharding, suffix_dedup, suffixes, topk, toxicity, tree

from .cases import frame, texts

ROWS = texts()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = entries.tokenizer_path()


def empty(spark):
    return frame(spark, [])


# 1


def brute_spans(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b, gone = (t or "").encode(), set()
        for j in range(len(b) - 49):
            f = first.setdefault(b[j : j + 50], i)
            if f != i:
                gone.update(range(j, j + 50))
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        spans = sum(j - 1 not in gone for j in gone)
        out[i] = (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    rows = ROWS + [(None, ROWS[0][1])]
    got = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_spans(rows)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_maximal_repeats():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 101, 60).astype(np.uint8)
    strings = []
    for _ in range(12):
        s = rng.integers(97, 101, 70).astype(np.uint8)
        a = rng.integers(0, 20)
        s[a : a + 45] = base[:45]
        strings.append(s)
    data, starts = np.concatenate(strings), np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    got = {(n, tuple(sorted(p.tolist()))) for n, p in suffixes.maximal_repeats(data, starts, 30)}
    owner = np.repeat(np.arange(12), 70)
    want = set()
    for n in range(30, 71):
        groups = collections.defaultdict(list)
        for i in range(len(data)):
            if i + n <= starts[owner[i] + 1]:
                groups[data[i : i + n].tobytes()].append(i)
        for p in groups.values():
            left = {(-1 - i if i == starts[owner[i]] else int(data[i - 1])) for i in p}
            right = {(-1 - i if i + n == starts[owner[i] + 1] else int(data[i + n])) for i in p}
            if len(p) > 1 and len(left) > 1 and len(right) > 1:
                want.add((n, tuple(p)))
    assert got == want


# 2


def test_exact_dedup(spark):
    rows = ROWS + [(7, ROWS[0][1]), (7, ROWS[0][1])]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (max(g), len(g))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.drop_repeats(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_full_filter_changes_nothing(spark, monkeypatch):
    want = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, ROWS)).collect()))
    monkeypatch.setattr(bloom, "MAX_BITS", 64)
    monkeypatch.setattr(bloom, "MIN_BITS", 64)
    assert sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, ROWS)).collect())) == want


# 3


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    odd = ["a<|endoftext|>b<|startoftext|>", "don't I'LL we've 12345 ½²", "é é ﬁ Ⅷ x\x1cy\x85z w", "a" * 5000, "ab" * 200, "́ x", "ΑΣ ΣΣ", "\x00\x01"]
    rows = [*ROWS, *enumerate(odd, 900)]
    got = {r.doc_id: r for r in bpe.encode_documents(frame(spark, rows), PATH, with_text=True).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, text
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), PATH).count() == 0


def test_bpe_tables_and_bounded_stores():
    from tokenizers import Tokenizer

    t, c = Tokenizer.from_file(PATH), bpe.BpeCodec(PATH, cache_size=50)
    for piece in ("unbelievably", "abababab", "q", "z" * 300):
        last = c.last_tokens(piece)
        assert len(last) == len(piece) + 1
        whole = t.encode(piece, add_special_tokens=False).ids
        assert last[-1] == whole[-1] and c.encode_piece(piece) == whole
        for end in range(1, len(piece)):  # every prefix has its last token, and following them back covers it
            at = end
            while at:
                assert last[at] >= 0
                at -= c._lengths[last[at]]
            assert at == 0
    words = " ".join(f"w{i}x" for i in range(2000)) + " " + "".join(f"{i}，" for i in range(3000))
    assert np.frombuffer(c.encode(words), "<u4").tolist() == t.encode(words, add_special_tokens=False).ids
    assert len(c._stretches) <= 100 and len(c._pieces) <= 100 and len(c._fits) <= 400


def test_bpe_in_several_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "AT_ONCE", 64)
    c, rows = bpe.codec(PATH), ["one two", None, "", "x" * 200, "three\nfour <|endoftext|> five", "six"] * 3
    got = {}
    for first, ids, bounds in c.encode_batches(pa.array(rows, pa.string()).slice(1)):
        for i in range(len(bounds) - 1):
            got[1 + first + i] = ids[bounds[i] : bounds[i + 1]].tobytes()
    assert got == {i: c.encode(rows[i]) for i in range(1, len(rows))}


# 4


def test_sharding(spark):
    rows = ROWS + [(None, "z"), (8, "same"), (8, "same")]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(8)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_sharding_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS", 16)
    rows = [(i, f"t{i}") for i in range(1000)]
    got = sharding.shard_documents(frame(spark, rows, extra=False)).collect()
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert [len(per[s]) for s in range(8)] == [125] * 8
    assert all(sorted(s) == list(range(125)) for s in per.values())


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    x = np.array([sharding.draw_hypergeometric(30, 70, 20, rng) for _ in range(20_000)])
    assert abs(x.mean() - 6) < 0.05 and abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.1
    big = sharding.draw_hypergeometric(4 * 10**9, 28 * 10**9, 7 * 10**6, rng)
    assert abs(big - 875_000) < 10_000
    m = np.array(sharding.communication_matrix([5, 0, 11], [6, 10], rng))
    assert m.sum(1).tolist() == [5, 0, 11] and m.sum(0).tolist() == [6, 10]


# 5


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, (i, s) in enumerate(sets):
        for j, z in sets[:a]:
            if s and z and 100 * len(s & z) >= percent * len(s | z):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, size, percent):
    rows = [r for r in ROWS if r[0] != 501]
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), size, percent).collect()))
    assert got == brute_components(rows, size, percent)


def test_jaccard_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 60)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = [r for r in ROWS if r[0] not in (500, 501)]
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), 3, 60).collect()))
    assert got == brute_components(rows, 3, 60)


def test_jaccard_defined_cases(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "q r s t"), (2, "q r s t"), (3, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), 3, 90).collect()}
    assert got == {(None, 2, None), (1, 2, 1), (2, 2, 1), (3, 0, 3)}
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    docs = frame(spark, [r for r in ROWS if r[0] != 501])
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute_components([r for r in ROWS if r[0] != 501], 5, 80)}
    assert {r.doc_id for r in kept.collect()} == want


def test_signatures_meet_every_link():
    rng = np.random.default_rng(4)
    for n, percent in ((12, 80), (40, 90), (200, 80), (333, 90)):
        for _ in range(60):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = rng.integers(0, int(n * (100 - percent) / 100) + 1)
            y = x[drop:]
            h = np.concatenate([np.sort(x), np.sort(y)])
            sig, who = jaccard.signatures(h, np.array([0, n, 2 * n - drop]), percent)
            if 100 * (n - drop) >= percent * n and drop:
                assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


# 6


def test_top_k(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(260, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[50:90] = v[3]
    rows = [(i, [float(np.float32(c)) for c in x], 0) for i, x in enumerate(v)] + [(300, None, 1), (400, [float("nan")] * 8, 1), (500, [1.0, 2.0], 1), (None, [0.1] * 8, 1), (600, [0.1] * 7 + [None], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, 10, 50).collect()))
    x = np.floor(1024 * np.array([r[1] for r in rows[:260]], np.float32).astype(float)).astype(int)
    want = []
    for q in range(0, 260, 50):
        s = x @ x[q]
        order = [i for i in sorted(range(260), key=lambda i: (-s[i], i)) if i != q][:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert len(topk.top_k(df.filter("vec_id < 4"), 10, 2).collect()) == 6


@pytest.mark.parametrize("scale, ring", [(1.0, 4), (60_000.0, 16)])
def test_top_k_in_many_rings_and_with_large_numbers(spark, monkeypatch, scale, ring):
    monkeypatch.setattr(topk, "RING", ring)
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(150, 6)) * scale, 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, 5, 30).collect()))
    x = [[int(np.floor(1024 * c)) for c in row] for row in v]
    want = []
    for q in range(0, 150, 30):
        s = [sum(a * b for a, b in zip(x[q], row)) for row in x]
        want += [(q, k + 1, i, s[i]) for k, i in enumerate([i for i in sorted(range(150), key=lambda i: (-s[i], i)) if i != q][:5])]
    assert got == want
    if scale > 1:
        with pytest.raises(ValueError):
            topk.top_k(spark.createDataFrame([(0, [2e12]), (1, [1.0])], "vec_id bigint, embedding array<double>"))


# 7


def test_packing(spark):
    c = bpe.codec(PATH)
    rows = ROWS + [(9, "same"), (9, "same")]
    got = packing.pack_documents(frame(spark, rows), PATH, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and sorted(r.sequence_id for r in got) == list(range(len(got)))
    in_order = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order) and all(r.length == 1 << r.bucket for r in got)  # one bucket after the other
    docs = collections.defaultdict(list)
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        docs[r.doc_id].append(r)
    for i, t in rows:
        if i in (9, *[r[0] for r in ROWS if r[0] == 9]):
            continue
        pieces = sorted(docs[i], key=lambda r: r.start)
        ids = c.encode(t) + (1).to_bytes(4, "little")
        assert b"".join(p.ids for p in pieces) == ids
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
        assert {p.doc_tokens for p in pieces} == {len(ids) // 4}
    assert packing.piece_lengths(2048 * 2 + 7, 2048) == [2048, 2048, 4, 2, 1]
    assert packing.pack_documents(empty(spark), PATH).count() == 0


# 8


def test_toxicity_held_out(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_defined_cases(spark):
    rng = np.random.default_rng(8)
    some = lambda: " ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(30)}" for _ in range(9))
    bad = [(3 * i, f"{some()} awful {some()} wretch {some()}", 1) for i in range(60)]
    good = [(3 * i + 1000, f"{some()} pleasant {some()} garden {some()}", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in bad + good] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, toxic int, quality int")
    docs = frame(spark, [(i, t) for i, t, _ in bad + good] + [(5000, "what an awful wretch"), (5001, "in the garden"), (5002, None), (5003, ""), (None, "x")])
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == 125
    score = {r.doc_id: r.score for r in got}
    assert score[5000] > score[5001] and score[5002] == score[5003]
    assert {r.doc_id: r.held_out for r in got}[5000] == (zlib.crc32(b"5000") % 3 == 1)
    none = toxicity.score_documents(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_documents(empty(spark), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns

def test_toxicity_counts_all_labelled_rows(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{rng.integers(40)}x{rng.integers(40)}" for _ in range(12)) + (" foul word" if i % 2 else " fair word") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    docs = frame(spark, list(enumerate(texts)))
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    models, _ = toxicity.trained_models(docs, labels, 4)  # the sample of the curve is no bound of the counts
    texts_kept = toxicity.training_rows(docs, labels.filter(f"doc_id in ({', '.join(map(str, kept))})"))
    got = {(r.kind, r.a, r.b): r for r in toxicity.expression_counts(toxicity.training_texts(docs, texts_kept)).collect()}
    want = collections.Counter()
    alive = {r.doc_id for r in texts_kept.collect()}
    for i in alive:
        words, stems, before, _ = toxicity.words_of([texts[i].encode()])
        for key in {(0, b, w) for b, w in zip(before.view(np.int64).tolist(), words.view(np.int64).tolist())}:
            want[key, i % 2] += 1
    assert len(alive) > 150
    for (key, toxic), n in want.items():
        assert n == (got[key].n0 + got[key].n1 if toxic else got[key].n2 + got[key].n3)
    often = {k[2] for (k, _) in want if sum(want[k, c] for c in (0, 1)) >= toxicity.RARE}
    assert models.words.get(np.array(sorted(often), np.int64).view(np.uint64))[0].all()


def test_toxicity_continuation_counts(spark):
    texts = [f"only fixed{i} san francisco {'abcde'[i % 5]}{i} often" for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    known = labels.filter("crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 <> 1")
    docs = frame(spark, list(enumerate(texts)) + [(3, texts[3])])  # a row that repeats counts once
    rows = toxicity.training_texts(docs, toxicity.training_rows(docs, known))
    words, stems = (x.collect() for x in toxicity.lower_orders(toxicity.expression_counts(rows)))
    want, of_stem = collections.defaultdict(set), collections.defaultdict(set)
    for i in (r.doc_id for r in known.collect()):
        fold = zlib.crc32(str(i).encode()) % 3 // 2
        w, s, before, _ = toxicity.words_of([texts[i].encode()])
        for b, x, y in zip(before.view(np.int64).tolist(), w.view(np.int64).tolist(), s.view(np.int64).tolist()):
            for c in (fold, 2):
                want[x, "ot"[i % 2] + str(c)].add(b)
                of_stem[y, "ot"[i % 2] + str(c)].add((b, x))
    assert all(r[c] == len(want[r.b, c]) for r in words for c in toxicity.SEEN)
    assert all(r[c] == len(of_stem[r.b, c]) for r in stems for c in toxicity.SEEN)
    francisco, often = (toxicity.words_of([x])[0].view(np.int64)[0] for x in (b"francisco", b"often"))
    by = {r.b: r for r in words}
    assert by[francisco].t2 == 1 and by[often].t2 > 5  # in as many texts, but after one word only
    assert by[francisco].n0 + by[francisco].n1 == by[often].n0 + by[often].n1


def test_toxicity_frequent_expressions_are_held(spark, monkeypatch):
    """A task passes a frequent expression on once, not each time that it has taken in much; the counts are the same."""
    import inspect

    texts = [f"often seen words a{i} b{i} c{i}" for i in range(300)]
    rows = spark.createDataFrame([(t, i % 4) for i, t in enumerate(texts)], "text string, side int").coalesce(1)
    whole = sorted(map(tuple, toxicity.expression_counts(rows).collect()))
    assert "MOST_KEPT" in inspect.getsource(toxicity.expression_counts)
    monkeypatch.setattr(toxicity, "AT_ONCE", 100)
    monkeypatch.setattr(toxicity, "MOST_HELD", 50)
    monkeypatch.setattr(toxicity, "MOST_KEPT", 20)
    assert sorted(map(tuple, toxicity.expression_counts(rows).collect())) == whole
    parts, out = [], []
    for i in range(0, 300, 10):
        kept, rest = toxicity.parted(parts + [toxicity.tally([t.encode() for t in texts[i : i + 10]], np.zeros(10, int))], 20)
        parts, out = [kept], out + [rest]
    words = toxicity.words_of([b"often seen words"])[0]
    assert not any(np.isin(p[2], words).any() for p in out[1:]) and 0 < len(parts[0][0]) <= 20
    n = toxicity.merged(parts + out)
    assert n[3][(n[0] == toxicity.WORD) & (n[2] == words[0])].sum() == 300


def shuffled_bytes(df) -> int:
    """Bytes that the exchanges of a frame that was collected have written."""
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                found += node.metrics().get("shuffleBytesWritten").get().value()
            left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_toxicity_counts_travel_in_few_bytes(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 600").select("text").collect()]
    counts = toxicity.expression_counts(spark.createDataFrame([(t, i % 4) for i, t in enumerate(texts)], "text string, side int").coalesce(2))
    n = len(counts.collect())
    assert n > 200_000 and 0 < shuffled_bytes(counts) < 14 * n


@pytest.mark.parametrize("buckets", [1, 3, 200])
def test_toxicity_messages_keep_all_counts(monkeypatch, buckets):
    """Large buckets are summed cell by cell, hot words have several buckets; counts are those of a plain sum."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{rng.integers(300)} the" for _ in range(30)).encode() for _ in range(120)]
    parts = [toxicity.tally(texts[i : i + 40], np.arange(40) % 4) for i in range(0, 120, 40)]
    rows = lambda kind, a, b, n: [(*k, *c) for *k, c in zip(kind.tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist(), n.tolist())]
    want = sorted(rows(*toxicity.merged(parts)))
    told = collections.defaultdict(list)
    for p in parts:
        for k, n, names, counts in toxicity.messages(p, buckets):
            told[k].append(pa.record_batch({"n": [n], "names": [names], "counts": [counts]}))
    assert (len(told) > 100) == (buckets == 200)
    for most in (toxicity.MOST_SUMMED, 50, 1):
        monkeypatch.setattr(toxicity, "MOST_SUMMED", most)
        got = [tuple(r.values()) for k in told for batch in toxicity._sums(iter(told[k])) for r in batch.to_pylist()]
        assert sorted(got) == want
    assert not list(toxicity.messages(tuple(x[:0] for x in parts[0]), buckets))


def test_toxicity_clashing_hashes_keep_their_counts(monkeypatch):
    part = (np.zeros(4, np.int8), np.array([1, 2, 1, 3], np.uint64), np.array([5, 6, 5, 6], np.uint64), np.eye(4, dtype=np.int32))
    monkeypatch.setattr(toxicity, "pair_hash", lambda a, b: np.zeros(len(a), np.uint64))
    kind, a, b, n = toxicity.merged([part])
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 5, [1, 0, 1, 0]), (2, 6, [0, 1, 0, 0]), (3, 6, [0, 0, 0, 1])]


def test_toxicity_table_keeps_every_key():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(8)  # all clash in their low bits
    keys = np.unique(np.concatenate([keys, np.zeros(1, np.uint64)]))
    table = toxicity.Table.of(keys, np.arange(len(keys))[:, None])
    seen, values = table.get(keys)
    assert seen.all() and values[:, 0].tolist() == list(range(len(keys)))
    assert not table.get(keys + np.uint64(3))[0].any()


# 9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to improve what you see here.</div>
<main><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> text,
and a line.</p><p>Short.<br>After the break &lt;tag&gt;.</p><aside>Related stories are here for you</aside><p>Last one<p>Unclosed one</article>
<section id="comments"><h2>Comments</h2><p>I liked this article very much, thank you for it.</p></section></main>
<form><label>Name</label><input name="n"></form><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    "middle",
    ["<video-player></video-player>", "<title-bar>", "<object-viewer x='1'>", "<svg class='a'/>", "<math/>", "<svg>", "<video src='a'>", "<svg><svg><text>no</text></svg></svg>", "<video>no</video>", "<video><video>no</video>", "<noscript><iframe src=x></noscript>"],
)
def test_html_text_after_special_elements(middle):
    tree = html_text.train_block_tree()
    first, last = "The first part of the article has enough words to stay.", "The last part of the article has enough words to stay too."
    assert html_text.main_text(f"<article><p>{first}</p>{middle}<p>{last}</p></article>", tree) == f"{first}\n{last}"


@pytest.mark.parametrize("open_tag, stays", [("article id='social-history'", True), ("div class='legal-analysis'", True), ("div class='has-sidebar wide'", True), ("article class='comments'", True),
                                             ("div class='site-footer'", False), ("div id='comment-list-3'", False), ("div class='main cookie-notice'", False), ("div class='related-posts'", False)])
def test_html_text_names_of_elements(open_tag, stays):
    text = "This block has quite enough words to look like a part of some article."
    page = f"<{open_tag}><p>{text}</p><p>{text}</p></{open_tag.split()[0]}>"
    assert html_text.main_text(page, html_text.train_block_tree()) == (f"{text}\n{text}" if stays else "")


def test_html_text_math_and_options():
    tree = html_text.train_block_tree()
    text = html_text.main_text("<article><p>Einstein wrote that <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> holds for all of us.</p><select><option>no<option>no2</select>"
                               "<datalist><option>one<option>two</datalist><p>And this is the end of the whole article.</p></article>", tree)  # fmt: skip
    assert text == "Einstein wrote that E=mc holds for all of us.\nAnd this is the end of the whole article."


def test_html_text(spark):
    want = "Title & more\nFirst paragraph with bold text, and a line.\nShort.\nAfter the break <tag>.\nLast one\nUnclosed one"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div"), (4, "u", "<!-- open"), (5, "u", "<p>" + "word " * 50_000 + "</p>")]
    got = html_text.extract_text(spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id bigint, url string, html string, n_chars int, text string")).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == want and by[1].n_chars == len(want)
    assert by[2].text == by[3].text == "" and by[5].n_chars == 249_999
    assert html_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_tree_fits_its_table():
    table = np.array(html_text.LABELLED, float)
    t = tree.fit_tree(table[:, :-1], table[:, -1], 8)
    assert all(round(tree.predict(t, row[:-1])) == row[-1] for row in table)


# 10


def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()[:40]
    mixed = "Zk8" + hashlib.sha256(b"m").hexdigest()[:29] + "Qx"
    rows = [
        (1, f'some words token = "{key}" and more token = "{key}" end'), (2, f"commit {key} fixed it"), (3, "a wonderfultionmentschaft word and 4539148803436467 card"), (4, None), (5, ""),
        (6, f'API_KEY="{mixed}"'), (7, "thononiner" * 5), (8, f"x\n\npassword: {mixed}\n"), (8, f"x\n\npassword: {mixed}\n"),
    ]
    docs = frame(spark, rows)
    got = secrets.scan_secrets(docs).collect()
    texts_of = dict(rows)
    assert collections.Counter(r.doc_id for r in got) == {1: 2, 6: 1, 8: 2}
    for r in got:
        found = texts_of[r.doc_id][r.start - 1 : r.start - 1 + r.length]
        assert found in (key, mixed) and hashlib.sha256(found.encode()).hexdigest() == r.secret_sha256
    assert len({r.start for r in got if r.doc_id == 1}) == 2
    clean = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert clean[1].text == 'some words token = "[SECRET]" and more token = "[SECRET]" end' and clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == texts_of[2] and clean[4].text is None
    assert secrets.redact_secrets(docs).columns == docs.columns and len(clean) == 8
    assert secrets.scan_secrets(empty(spark)).count() == 0
    assert secrets.scan_secrets(docs.drop("source")).count() == 5


def test_secret_positions(spark):
    key, other = (hashlib.sha256(x).hexdigest()[:40] for x in (b"p", b"q"))
    text = f'Ω see commit {key} 😀 and\n\npassword: "{key}" or https://example.com/{key}/x token={other} {other}'
    many = " ".join(f"commit {hashlib.sha256(str(i).encode()).hexdigest()[:40]}  x" for i in range(700)) + f"  password: {key}"
    got = collections.defaultdict(list)
    for r in secrets.scan_secrets(frame(spark, [(1, text), (2, many)])).collect():
        got[r.doc_id].append(r)
    flagged = sorted(r.start for r in got[1])
    assert text.index(f'"{key}') + 2 in flagged and text.index(key) + 1 not in flagged and text.index(f"token={other}") + 7 in flagged
    assert all(text[r.start - 1 : r.start - 1 + r.length] in (key, other) for r in got[1])
    assert [r.start for r in got[2]] == [many.index("password: ") + 11] and got[2][0].length == 40


def test_announced_secrets_of_any_form(spark):
    bad = ['password="hunter2secret"', "api_key = Zk83hTq9LwXy", "pwd: P@ssw0rd!2024#xy", "secret_key=qhzkwpmvxtrbjdnfgcly", "PASSWORD: Winter1987!"]
    fine = ["the password: required", "token = None", "secret: the of and", "password: ********", "auth: <your-key>", "passwort und token sind da", "pass: ${DB_PASSWORD}"]
    rows = list(enumerate(f"some words {x} and more" for x in bad + fine))
    hit = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert set(hit) == set(range(len(bad)))
    for i, r in hit.items():
        assert rows[i][1][r.start - 1 : r.start - 1 + r.length] == re.split("[=:] ?", bad[i])[1].strip('"')


def _judged(spark, findings):
    rows = spark.createDataFrame(findings, "s string, near string, raw string, source string, label int")
    scored = rows.selectExpr(f"array(named_struct('f', {secrets._features('s', 'near', 'raw', 'source')})) a", "label")
    scored = scored.selectExpr(f"transform(a, c -> {secrets.forest_sql(spark)})[0] >= 0.5 as hit", "label = 1 as want")
    n = collections.Counter((r.hit, r.want) for r in scored.collect())
    return n[True, True] / (n[True, True] + n[True, False]), n[True, True] / (n[True, True] + n[False, True])


def test_forest_on_its_findings_and_on_others(spark):
    assert min(_judged(spark, secrets.labelled_findings())) >= 0.97
    precision, recall = _judged(spark, secrets.labelled_findings(seed=7))
    assert precision >= 0.95 and recall >= 0.95
