"""Op 8: toxicity by class-conditional Kneser-Ney language models.

Two word models are trained, on toxic and on ordinary labelled texts.  Each is an interpolated Kneser-Ney model: word
after word, then the word by the number of its distinct left neighbours, then the word's stem (its first STEM bytes) by the
number of its distinct pairs of a left neighbour and a word, then counts pooled over both classes.  Pairs are counted by distinct training texts, so that a
text which repeats itself counts once; expressions of fewer than RARE texts have no counts of their own and share the
pooled ones, alike in both classes.  A text's words have
the log ratio of the two likelihoods; the length-normalised ratio of the whole text and of its most toxic stretches
give the score through a logistic curve, fitted on rows that the models it uses have not seen (two folds).

The counts are sums over all labelled rows that are not held out; the models grow with the expressions of RARE texts or more.
Counts travel packed, as messages from tasks to buckets of words, not as rows.
Near copies among the rows (one of MINIMA minimum hashes of three-word shingles in common) count once, so that a family of copies
is no evidence by its size.  Only the logistic curve is fitted on a bounded sample by a hash of doc_id, MAX_ROWS toxic and ORDINARY
times as many ordinary texts; its bias is set to the share of toxic labels.  Every text is scored whole.  doc_id decides the
held-out rows; no id, language, source or label is an input of a score.

Defined results: null or empty text gets the score of a text without evidence; rows without a label are scored alike;
a labelled row that repeats counts once; with no labelled rows of one class every score is the base
rate (0 if there is none); an empty table gives an empty result; extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, shuffle_partitions
from .bloom import ask_filter, build_filter, filter_bits
from .planes import pack, steps, summed, unpack
from .suffix_dedup import even_keys
from .words import LOWER, chunks, joined, mix, prefix_hash, release, span_hash, word_spans

#: Bounds and constants: toxic texts that the curve is fitted on, stem length in bytes, discount, stretch lengths in words, threshold.
MAX_ROWS, STEM, DISCOUNT, RARE, STRETCHES, CUT = 1536, 7, 0.75, 5, (1, 4, 16), 0.7
#: Ordinary texts for each toxic one in the curve's sample; minimum hashes by which near copies are known; bytes scored at once.
ORDINARY, MINIMA, AT_ONCE = 3, 8, 1 << 19
#: Log ratio from which a word counts as evidence.
STRONG = 1.5
#: Counted expressions that a task takes in before it passes on the rare ones, and frequent ones that it goes on holding at most.
MOST_HELD, MOST_KEPT = 1 << 18, 1 << 17
#: Bits of an expression's hash by which a bucket of many expressions is summed in several passes; expressions told that a pass aims at.
CELL_BITS, MOST_SUMMED = 3, 1 << 20


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (bare of ASCII punctuation at their ends) and stems, the word before each, and the text of each."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = word_spans(data)
    bare = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    last = np.maximum.accumulate(np.where(bare, np.arange(len(data)), -1))  # last bare byte up to each position
    first = np.minimum.accumulate(np.where(bare, np.arange(len(data)), len(data))[::-1])[::-1]
    if len(begin):
        begin, end = first[begin], last[end - 1] + 1
    keep = begin < end
    begin, end = begin[keep], end[keep]
    prefix = prefix_hash(data)
    words = span_hash(prefix, begin, end)
    stems = span_hash(prefix, begin, np.minimum(end, begin + STEM))
    text = np.searchsorted(starts, begin, side="right") - 1
    before = np.zeros(len(words), np.uint64)
    if len(words):
        before[1:] = np.where(text[1:] == text[:-1], words[:-1], 0)
    return words, stems, before, text


def pair_hash(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + words)


@dataclass
class Table:
    """Keys with a few numbers each, in twice as many slots at least; a clashing key takes the next free slot, so none is lost."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> "Table":
        keys = np.where(keys == 0, np.uint64(1), keys)  # 0 marks an empty slot
        size = max(1 << 10, 1 << (2 * len(keys)).bit_length())
        k, v = np.zeros(size, np.uint64), np.zeros((size, values.shape[1]), np.float32)
        slot, left = (keys & np.uint64(size - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[k[slot[left]] == 0]
            k[slot[free]] = keys[free]
            there = k[slot[left]] == keys[left]
            v[slot[left[there]]] = values[left[there]]
            left = left[~there]
            slot[left] = (slot[left] + 1) & (size - 1)
        return Table(k, v)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its values (any values if it is not)."""
        keys, last = np.where(keys == 0, np.uint64(1), keys), len(self.keys) - 1
        slot = (keys & np.uint64(last)).astype(np.int64)
        found = self.keys[slot]
        seen = found == keys
        left = np.flatnonzero(~seen & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & last
            found = self.keys[slot[left]]
            seen[left] = found == keys[left]
            left = left[(found != keys[left]) & (found != 0)]
        return seen, self.values[slot]


@dataclass
class Models:
    """The tables of both classes (column 0 toxic, 1 ordinary) and the weights of the logistic curve."""

    pairs: Table
    contexts: Table
    words: Table
    stems: Table
    unseen: np.ndarray
    weights: np.ndarray

    def word_ratios(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words, stems, before, text = words_of(texts)
        seen, stem = self.stems.get(stems)
        p = np.where(seen[:, None], stem, self.unseen[0])  # of the stem; the word within a stem is as likely in both classes
        seen, word = self.words.get(words)
        p = np.where(seen[:, None], word, self.unseen[1] * p)
        seen, back = self.contexts.get(before)
        back = np.where(seen[:, None], back, 1.0)
        seen, pair = self.pairs.get(pair_hash(before, words))
        p = np.where(seen[:, None], pair, 0.0) + back * p
        return np.log(p[:, 0] / p[:, 1]), text

    def features(self, texts: list[bytes]) -> np.ndarray:
        ratio, text = self.word_ratios(texts)
        n = np.bincount(text, minlength=len(texts))
        out = np.zeros((len(texts), 2 + len(STRETCHES)))
        out[:, 0] = np.bincount(text, ratio, len(texts)) / np.maximum(n, 1)
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        ends = np.cumsum(n)
        stop = ends[text] if len(text) else ends[:0]
        some = np.flatnonzero(n)
        for j, length in enumerate(STRETCHES):
            at = np.arange(len(ratio))
            there = np.minimum(at + length, stop)
            mean = (sums[there] - sums[at]) / length
            if len(some):
                out[some, 1 + j] = np.maximum.reduceat(mean, (ends - n)[some])
        out[:, -1] = np.log1p(np.bincount(text, np.maximum(ratio - STRONG, 0), len(texts)))
        return np.clip(out, -20, 20)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -35, 35)))


#: Kinds of counted expressions: a word after another (a: the one before, b: the word), a word (a: its stem), a stem, a word before others.
PAIR, WORD, STEM_OF, CONTEXT = range(4)
#: Columns of counts: toxic and ordinary texts, each of the folds 0 and 1.
SIDES = ["n0", "n1", "n2", "n3"]
#: Columns of continuation counts: toxic and ordinary texts, each of fold 0, fold 1 and both; a count over both folds is no sum.
SEEN = {"t0": "n0", "t1": "n1", "t2": "n0 + n1", "o0": "n2", "o1": "n3", "o2": "n2 + n3"}


def tally(texts: list[bytes], side: np.ndarray) -> tuple[np.ndarray, ...]:
    """kind, a, b of the expressions in the texts, and for each side the number of texts that have it."""
    words, stems, before, text = words_of(texts)
    none, out = np.zeros(len(words), np.uint64), []
    for kind, a, b in ((PAIR, before, words), (WORD, stems, words), (STEM_OF, none, stems), (CONTEXT, none, before)):
        h = pair_hash(a, b)
        new = np.unique(mix(text.astype(np.uint64) * np.uint64(5) + h), return_index=True)[1]  # once for each text
        _, at, which = np.unique(h[new], return_index=True, return_inverse=True)
        n = np.bincount(which * 4 + side[text[new]], minlength=4 * len(at)).reshape(-1, 4).astype(np.int32)
        out.append((np.full(len(at), kind, np.int8), a[new][at], b[new][at], n))
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """One row for each kind, a, b with the sums of the counts."""
    kind, a, b, n = (np.concatenate(x) for x in zip(*parts))
    _, at, which = np.unique(mix(pair_hash(a, b) + kind.astype(np.uint64)), return_index=True, return_inverse=True)
    if any((x[at][which] != x).any() for x in (kind, a, b)):  # hashes clash
        _, at, which = np.unique(np.rec.fromarrays([kind, a, b]), return_index=True, return_inverse=True)
    return kind[at], a[at], b[at], np.stack([np.bincount(which, n[:, j], len(at)).astype(np.int32) for j in range(4)], axis=1)


def parted(parts: list[tuple[np.ndarray, ...]], most: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The merged parts: up to `most` expressions of several texts, the most frequent ones, and the rest."""
    whole = merged(parts)
    n = whole[3].sum(axis=1)
    keep = n > 1
    if keep.sum() > most:
        keep = np.zeros(len(n), bool)
        keep[np.argpartition(-n, most)[:most]] = True
    return tuple(x[keep] for x in whole), tuple(x[~keep] for x in whole)


def messages(part: tuple[np.ndarray, ...], buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Bucket, number of expressions, hashes and counts of the messages that tell buckets the counts of a part.

    An expression goes to the bucket of its b, so that a message names a word once for all words before it; from 64
    buckets on each b has several, by a, so that a very frequent word fills none.
    """
    kind, a, b, n = part
    bucket = mix(b + mix(a) % np.uint64(max(1, buckets // 32))) % np.uint64(buckets)
    cell, wide = mix(pair_hash(a, b)) >> np.uint64(64 - CELL_BITS), max(1, (buckets - 1).bit_length())
    order = np.argsort(bucket << np.uint64(64 - wide) | cell << np.uint64(64 - wide - CELL_BITS) | b >> np.uint64(wide + CELL_BITS))
    at = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(at)).tolist():
        here = order[at[k] : at[k + 1]]
        names, which = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
        which = which.astype(np.uint32)
        yield k, len(here), pack(steps(names)), pack(kind[here], cell[here].astype(np.uint8), which[: len(here)], which[len(here) :], *n[here].T)


def _batch_of(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *(pa.array(n[:, j], pa.int64()) for j in range(4))], ["kind", "a", "b", *SIDES])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, a, b and SIDES of the expressions of a bucket, from its messages, which stay packed; a large bucket is summed cell by cell."""
    told, size = [], 0
    for batch in batches:
        told += zip(batch.column("names").to_pylist(), batch.column("counts").to_pylist())
        size += sum(batch.column("n").to_pylist())
    passes = 1 << min(CELL_BITS, (size // MOST_SUMMED).bit_length())
    for i in range(passes):
        parts = []
        for names, counts in told:
            names = summed(unpack(names, np.uint64)[0])
            kind, cell, a, b, *n = unpack(counts, np.int8, np.uint8, np.uint32, np.uint32, *[np.int32] * 4)
            here = cell % passes == i
            parts.append((kind[here], names[a[here]], names[b[here]], np.stack([x[here] for x in n], axis=1)))
        kind, a, b, n = merged(parts)
        order = np.argsort(b)  # like ones side by side take fewer bytes
        for at in range(0, len(order), 1 << 16):
            some = order[at : at + (1 << 16)]
            yield _batch_of(kind[some], a[some], b[some], n[some])
    release()


@dataclass
class Counts:
    """What the labelled texts give.  Of the expressions of RARE texts or more: keys, numbers of texts (a column for each of
    SIDES) and, of words and stems, continuation counts (for each of SEEN): a word's distinct left neighbours, a stem's
    distinct pairs of a left neighbour and a word.  The total is the number of all distinct pairs."""

    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    stems: tuple[np.ndarray, np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    total: np.ndarray
    known_stems: list[tuple[int, int]]


def model_of(c: Counts, folds: tuple[int, ...]) -> Models:
    """The tables from the texts of the folds."""
    which = folds[0] if len(folds) == 1 else 2
    kind = lambda n: np.float32 if n.ndim > 1 else np.float64  # noqa: E731  tables are large, totals large numbers
    of = lambda n: np.stack([sum(n[..., f] for f in folds), sum(n[..., 2 + f] for f in folds)]).astype(kind(n))
    lower = lambda n: np.stack([n[..., which], n[..., 3 + which]]).astype(kind(n))
    word_texts, stem_texts, context_n, pair_n = of(c.words[2]), of(c.stems[1]), of(c.contexts[1]), of(c.pairs[2])
    word_n, stem_n, known = lower(c.words[3]), lower(c.stems[2]), c.known_stems[which]
    common = lambda n: n[0] + n[1] >= RARE
    pooled_total = lower(c.total).sum() + known[0]
    pooled_stem = (stem_n[0] + stem_n[1] + 1) / pooled_total
    stem_at = np.searchsorted(c.stems[0], c.words[1])
    pooled_word = (word_n[0] + word_n[1]) / np.maximum(stem_n[0] + stem_n[1], 1)[stem_at]  # within its stem
    left = np.searchsorted(c.contexts[0], c.pairs[0])
    stem_p, word_p, pair_p, backs, unseen = [], [], [], [], []
    for sn, wn, cn, pn, stem_total, word_total in zip(stem_n, word_n, context_n, pair_n, lower(c.total), lower(c.total)):
        taken = np.maximum(np.where(common(stem_texts), sn, 0) - DISCOUNT, 0) / (stem_total + 1)
        back = 1 - taken.sum()
        # stems and words without counts of their own are as likely in both classes, up to the mass left for them
        stem_p.append(taken + back * pooled_stem)
        taken = np.maximum(np.where(common(word_texts), wn, 0) - DISCOUNT, 0) / (word_total + 1)
        word_back = 1 - taken.sum()
        word_p.append(taken + word_back * pooled_word * stem_p[-1][stem_at])
        unseen.append((back * (known[1] + 1) / pooled_total, word_back))
        taken = np.maximum(np.where(common(pair_n), pn, 0) - DISCOUNT, 0) / np.maximum(cn[left], 1)
        given = np.bincount(left, taken, len(cn))
        shrink = np.maximum(given, 1.0)  # a context can precede several words in one text
        pair_p.append(taken / shrink[left])
        backs.append(np.maximum(1 - given / shrink, 0.05))
    table = lambda keys, x, n: Table.of(keys[common(n)], np.stack(x, axis=1)[common(n)])
    return Models(
        table(pair_hash(c.pairs[0], c.pairs[1]), pair_p, pair_n), table(c.contexts[0], backs, context_n), table(c.words[0], word_p, word_texts), table(c.stems[0], stem_p, stem_texts),
        np.array([[u[0] for u in unseen], [u[1] for u in unseen]]), np.zeros(3 + len(STRETCHES)),
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.001, steps: int = 60) -> np.ndarray:
    """Weights (bias first) by Newton steps with a ridge penalty on all but the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) / len(y) + penalty @ w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def copy_keys(texts: list[bytes]) -> list[list[int]]:
    """The minimum hashes of each text's three-word shingles, by which near copies are known; a shorter text has one of all its bytes."""
    words, _, _, text = words_of(texts)
    h = mix(words[:-2] + mix(words[1:-1] + mix(words[2:]))) if len(words) > 2 else np.zeros(0, np.uint64)
    h, text = h[text[2:] == text[:-2]], text[2:][text[2:] == text[:-2]]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    full = np.flatnonzero(np.diff(first))
    lows = np.zeros((len(texts), MINIMA), np.uint64)
    for m in range(MINIMA if len(full) else 0):
        lows[full, m] = mix(np.minimum.reduceat(mix(h ^ np.uint64(0x51ED270B * (m + 1))), first[:-1][full]) + np.uint64(m))
    lows, some = lows.view(np.int64), set(full.tolist())
    return [lows[i].tolist() if i in some else [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True)] for i, t in enumerate(texts)]


def _side() -> Column:
    return (F.when(F.col("toxic") == 1, 0).otherwise(2) + F.floor(F.expr("crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 / 2"))).cast("int")


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text and h (hash of the text) of the rows of docs that a Bloom filter lets through for the doc_ids of ids, so
    that few others are shuffled by the join that follows."""
    bits = filter_bits(ids.count())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, hit = ask_filter(rows, F.col("doc_id"), build_filter(ids, "doc_id", bits), bits)
    return rows.filter(hit).select("doc_id", "text", F.xxhash64("text").alias("h"))


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, h, side of the labelled rows of docs that are no near copies of an earlier one of their class: a text counts
    if it is the first with each of its keys.  Only keys are written and joined here, no texts."""
    def run(batches):
        for batch in batches:
            keys = []
            for _, group in chunks((x.as_py() for x in batch.column(1)), AT_ONCE):
                keys += copy_keys(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "keys"])
        release()

    keyed = _rows_of(docs, known).mapInArrow(run, "doc_id bigint, h bigint, keys array<bigint>")
    rows = materialize(keyed.join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "h", _side().alias("side"), "keys").withColumn("uid", F.monotonically_increasing_id()), "labelled")
    me = F.struct("doc_id", "h", "uid", "side", F.size("keys").alias("n"))
    first = rows.select(me.alias("me"), F.floor(F.col("side") / 2).alias("class"), F.explode("keys").alias("key")).groupBy("class", "key").agg(F.min("me").alias("me"))
    kept = materialize(first.groupBy("me").agg(F.count("*").alias("won")).filter("won = me.n").select("me.doc_id", "me.h", "me.side"), "kept")
    discard(rows)
    return kept


def training_texts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """text and side of the rows of kept, each once however often it stands in docs."""
    rows = _rows_of(docs, kept).join(kept.hint("shuffle_hash"), ["doc_id", "h"])
    return rows.groupBy("doc_id", "h", "side").agg(F.first("text").alias("text")).select("text", "side")


def expression_counts(rows: DataFrame) -> DataFrame:
    """kind, a, b and SIDES of every expression in rows(text, side): numbers of distinct texts, over all rows."""
    keys = even_keys(rows.sparkSession, shuffle_partitions(rows.sparkSession))

    def told(part):
        found = list(zip(*messages(part, len(keys))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found[0]], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.binary()), pa.array(found[3], pa.binary())], ["bucket", "n", "names", "counts"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            sides = np.array(batch.column(1).to_pylist(), np.int64)
            for first, group in chunks((x.as_py() for x in batch.column(0)), AT_ONCE):
                parts.append(tally(group, sides[first : first + len(group)]))
                held += len(parts[-1][0])
                if held > MOST_HELD:
                    kept, rest = parted(parts, MOST_KEPT)
                    yield from told(rest)
                    parts, held = [kept], 0
        if parts:
            yield from told(merged(parts))
        release()

    found = rows.select("text", "side").mapInArrow(run, "bucket int, n int, names binary, counts binary")
    return found.groupBy("bucket").applyInArrow(_sums, "kind tinyint, a bigint, b bigint, " + ", ".join(f"{c} bigint" for c in SIDES))


def lower_orders(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All words (b, stem a) with SIDES and SEEN, the numbers of their distinct left neighbours; all stems (b) with SEEN, the
    numbers of their distinct pairs of a left neighbour and a word."""
    seen = [F.expr(f"count_if({n} > 0)").alias(c) for c, n in SEEN.items()]
    words = counts.filter(f"kind = {WORD}").drop("kind").join(counts.filter(f"kind = {PAIR}").groupBy("b").agg(*seen), "b")
    words = materialize(words, "words")
    return words, materialize(words.groupBy(F.col("a").alias("b")).agg(*(F.sum(c).alias(c) for c in SEEN)), "stems")


def collected_counts(counts: DataFrame) -> Counts:
    """The expressions of RARE texts or more come to the driver, with totals over all."""
    n, seen = " + ".join(SIDES), list(SEEN)
    words, stems = lower_orders(counts)
    both = [f"t{i} + o{i}" for i in range(3)]
    sums = stems.agg(*(F.sum(c) for c in seen), *(f for x in both for f in (F.expr(f"count_if({x} > 0)"), F.expr(f"coalesce(min({x}) filter (where {x} > 0), 0)")))).first()

    def arrays(table: DataFrame, keys: list[str], *columns: list[str]) -> tuple[np.ndarray, ...]:
        t = table.select(*keys, *(F.col(x).cast("int") for c in columns for x in c)).toArrow()
        keys = [t.column(k).to_numpy().view(np.uint64) for k in keys]
        order = np.argsort(keys[0], kind="stable")
        return (*(k[order] for k in keys), *(np.stack([t.column(x).to_numpy() for x in c], axis=1)[order] for c in columns))

    common = lambda kind: counts.filter(f"kind = {kind} and {n} >= {RARE}")
    out = Counts(
        arrays(common(PAIR), ["a", "b"], SIDES), arrays(words.filter(f"{n} >= {RARE}"), ["b", "a"], SIDES, seen),
        arrays(common(STEM_OF).select("b", *SIDES).join(stems, "b"), ["b"], SIDES, seen), arrays(common(CONTEXT), ["b"], SIDES),
        np.array([x or 0 for x in sums[:6]], np.int64), [(sums[6 + 2 * i], sums[7 + 2 * i]) for i in range(3)],
    )
    discard(words, stems)
    return out


def trained_models(docs: DataFrame, labels: DataFrame, max_rows: int) -> tuple[Models | None, float]:
    """Models counted over all labelled rows that are not held out, and the share of toxic labels.

    Only the logistic curve is fitted on a sample, of at most max_rows toxic texts and ORDINARY times as many ordinary ones.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 <> 1")
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return None, base
    kept = training_rows(docs, known)
    sizes = dict(kept.groupBy("side").count().collect())
    if not all(sizes.get(c, 0) + sizes.get(c + 1, 0) for c in (0, 2)):
        return None, base
    counted = materialize(expression_counts(training_texts(docs, kept)), "counts")
    counts = collected_counts(counted)
    discard(counted)
    # the model for the held rows of a fold knows the other fold only
    folds = [model_of(counts, (1 - f,)) if sizes.get(1 - f) and sizes.get(3 - f) else None for f in (0, 1)]
    models = model_of(counts, (0, 1))
    del counts
    release()
    shared = docs.sparkSession.sparkContext.broadcast(folds)

    def run(batches):
        for batch in batches:
            sides = np.array(batch.column(1).to_pylist(), np.int64)
            for first, group in chunks((x.as_py() for x in batch.column(0)), AT_ONCE):
                for f, m in enumerate(shared.value):
                    at = np.flatnonzero(sides[first : first + len(group)] % 2 == f)
                    if m is not None and len(at):
                        y = (sides[first + at] < 2).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(m.features([group[i] for i in at]).tolist())], ["y", "x"])
        release()

    sample = [kept.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(k) for c, k in (("side >= 2", ORDINARY * max_rows), ("side < 2", max_rows))]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # at most (1 + ORDINARY) * max_rows rows
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    once = rows.join(sample, ["doc_id", "h"]).groupBy("doc_id", "h", "side").agg(F.first("text").alias("text"))
    found = sorted((r.y, r.x) for r in once.select("text", "side").mapInArrow(run, "y int, x array<double>").collect())
    shared.destroy()
    del folds
    release()
    y = np.array([r[0] for r in found], np.float64)
    if 0 < y.sum() < len(y):
        models.weights = fit_logistic(np.array([r[1] for r in found]), y)
        share = min(max(base, 1e-6), 1 - 1e-6)
        models.weights[0] += np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))  # from the sample's share to the table's
    else:
        models.weights = np.array([np.log(base / (1 - base)), 1.0] + [0.0] * (1 + len(STRETCHES)))
    return models, base


def _scores(docs: DataFrame, labels: DataFrame, max_rows: int):
    """A function from texts to scores, which carries the trained models to the workers."""
    models, base = trained_models(docs, labels, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def scores(texts) -> np.ndarray:
        m, out = shared.value, np.full(len(texts), base)
        if m is not None:
            for first, group in chunks((x if x is None or isinstance(x, str) else x.as_py() for x in texts), AT_ONCE):
                out[first : first + len(group)] = m.score(group)
        return out

    return scores


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scores = _scores(docs, labels, max_rows)

    def run(batches):
        for batch in batches:
            ids, s = batch.column(0), scores(batch.column(1))
            held = [None if i is None else zlib.crc32(str(i).encode()) % 3 == 1 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose score is below CUT, with all their columns: the pipeline stage."""
    from pyspark.sql.pandas.functions import pandas_udf

    scores = _scores(docs, labels, max_rows)

    @pandas_udf("boolean")
    def toxic(text):
        import pandas as pd

        out = pd.Series(scores(text.tolist()) >= CUT)
        release()
        return out

    rows = docs.select(F.struct(*docs.columns).alias("row"), toxic(F.col("text").cast("string")).alias("toxic"))
    return rows.filter("not toxic").select("row.*")
