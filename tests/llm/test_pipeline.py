"""The pipeline against its stages done by hand on whole texts."""

import collections
import zlib

import numpy as np

import corpus_pipeline
from marlcore.llm import bpe, entries, secrets, toxicity

from .test_operators import LOWER, brute_components


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "secrets", "packing"]
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels).filter("predicted = 1").collect()}
    same = collections.defaultdict(list)
    for i, t in text.items():
        if i not in bad:
            same[t.translate(LOWER)].append(i)
    left = [(max(g), text[max(g)]) for g in same.values()]
    left = {i for i, _, root in brute_components(left, 5, 80) if i == root}
    found = collections.defaultdict(set)
    for r in secrets.scan_secrets(docs).collect():
        found[r.doc_id].add(text[r.doc_id][r.start - 1 : r.start - 1 + r.length])
    codec, want = bpe.codec(entries.tokenizer_path()), {}
    for i in left:
        t = text[i]
        for s in found[i]:
            t = t.replace(s, secrets.PLACEHOLDER)
        want[i] = codec.encode(t) + (1).to_bytes(4, "little")
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        for p in pieces:
            assert zlib.crc32(want[i][4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
        assert sum(p.length for p in pieces) == len(want[i]) // 4 == pieces[0].doc_tokens
    assert np.unique([p.sequence_id for g in got.values() for p in g]).size == sum(map(len, got.values()))


def test_stages_keep_columns_and_awkward_rows(spark, sf):
    from .cases import frame, texts

    docs = frame(spark, texts())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out
    assert 0 < docs.count() < 62
