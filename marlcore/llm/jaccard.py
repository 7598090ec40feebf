"""Op 5: exact Jaccard self-join of word n-gram sets.

Prospects.  A set that links with a different one shares most of its elements with it, so a set with too few elements that
occur in another set too has no link (prospects.py).  This is asked of all sets, then among those left; the rest goes on with them.

Candidates.  Two sets of x <= y elements and similarity s differ in at most D = (1 - s) / (1 + s) * (x + y) elements.  Sets are
banded by size; the elements of a set are dealt by hash into D + 1 (and SPARE more) parts, D for the largest set of the
band, so that two linked sets have a part in common that is equal as a whole and not empty.  Equal parts are found by
one shuffle of their hashes, once for each different set, and give stars of candidates, never pairs.  A set counts in its own
band and in each higher one that a set linked with it can be in.

Tiles.  Components of the candidate stars are checked in tiles: small ones are put together, and one that is too large for
a task is cut by size band and hash, its tiles met in pairs of equal or neighbouring bands.  In a tile, the number of
bits in which two parity bitmaps of hashed elements differ bounds the overlap from above; the survivors are intersected exactly
as sorted arrays.  Sets that are connected already aren't compared again.  Nothing is sampled or capped.

Defined results: a text of fewer words than an n-gram has the whole sequence as one element; null texts and texts without
words have the empty set, which links with nothing; equal sets are linked; rows that share a doc_id are one document for
links; a row with a null doc_id takes no part in links and has a null component_id; long texts are read whole; empty tables
give empty results; extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import attach_groups
from ..session import discard, materialize
from .prospects import prospects
from .words import LOWER, chunks, joined, mix, prefix_hash, release, span_hash, word_spans

#: Parts beyond D + 1, so that a set with up to SPARE empty parts needn't tell of them; ratio of the bands' edges; elements of a
#: tile; words of 64 bits in a bitmap; rows up to which candidates are broadcast to the texts.
SPARE, RATIO, TILE, BITMAP, BROADCAST_ROWS = 2, 1.5, 2_000_000, 16, 400_000
#: Sets next in size that are compared first; times that prospects are asked for again among those left.
NEXT, ROUNDS = 32, 2


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct element hashes of all texts, one text after the other, and the bounds of each text."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = word_spans(data)
    words = span_hash(prefix_hash(data), begin, end)
    text = np.searchsorted(starts, begin, side="right") - 1
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(h)]
    owner = text[: len(h)]
    full = np.arange(len(h)) + size <= (first + n)[owner] if len(h) else np.zeros(0, bool)
    h, owner = mix(h[full]), owner[full]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.array([_sequence(words[first[i] : first[i] + n[i]]) for i in short], np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sequence(words: np.ndarray) -> int:
    h = len(words)
    for w in words.tolist():
        h = (h * 0xA24BAED4963EE407 + w + 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], np.uint64))[0])


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit keys of whole sets, two numbers each."""
    n = np.diff(bounds)
    out = np.zeros((len(n), 2), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        for i, salt in enumerate((0x632BE59BD9B4E019, 0x8CB92BA72F3D8DD7)):
            out[full, i] = mix(np.add.reduceat(mix(h ^ np.uint64(salt)), bounds[:-1][full]) + n[full].astype(np.uint64))
    return out


def band_edges(largest: int, percent: int) -> np.ndarray:
    """First sizes of the bands, up to those that a set linked with one of `largest` elements can be in, and two more."""
    out = [1]
    while out[-1] <= largest * 100 / percent:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array([*out, int(out[-1] * RATIO) + 1, int(out[-1] * RATIO * RATIO) + 2])


def signatures(h: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the parts of each set, in each band that it counts in, and the set of each hash."""
    n = np.diff(bounds)
    edges = band_edges(int(n.max(initial=1)), percent)
    band = np.searchsorted(edges, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    out_h, out_s = [], []
    for up in range(len(edges)):
        b = band + up
        reach = (n > 0) & (b < len(edges) - 1)
        reach[reach] &= n[reach] * 100 >= percent * edges[b[reach]] if up else True
        if not reach.any():
            break
        largest = edges[np.minimum(b + 1, len(edges) - 1)] - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        parts = np.where(reach & (differ > 0), differ + 1 + SPARE, 0)  # if none may differ, sets link only if they're equal
        base = np.concatenate([[0], np.cumsum(parts)])
        use = parts[owner] > 0
        who, x = owner[use], h[use]
        at = base[who] + ((x >> np.uint64(17)) % np.maximum(parts[who], 1).astype(np.uint64)).astype(np.int64)
        total, count = np.zeros(base[-1], np.uint64), np.bincount(at, minlength=base[-1])
        np.add.at(total, at, mix(x ^ np.uint64(0x2545F4914F6CDD1D)))
        s = np.repeat(np.arange(len(n)), parts)
        part = np.arange(base[-1]) - base[:-1][s]
        empty = np.bincount(s, count == 0, len(n))
        tell = (count > 0) | (empty[s] > SPARE)
        label = (b[s].astype(np.uint64) << np.uint64(40)) + part.astype(np.uint64)
        sig = mix(total + mix(label * np.uint64(0x9E6C63D0876A9A47) + np.uint64(percent)) + count.astype(np.uint64))
        out_h.append(sig[tell])
        out_s.append(s[tell])
    return np.concatenate([np.zeros(0, np.uint64), *out_h]), np.concatenate([np.zeros(0, np.int64), *out_s])


def _describe(size: int, percent: int):
    """doc_id and sig, one row for each part that a text tells; of equal sets in a batch, only the smallest doc_id tells its parts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            number = batch.column(0).to_numpy()
            for first, group in chunks((x.as_py() for x in batch.column(1)), 1 << 20):
                h, bounds = shingle_sets(group, size)
                keys, ids = set_keys(h, bounds), number[first : first + len(group)]
                order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
                k = keys[order]
                tells = np.zeros(len(group), bool)
                tells[order[np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])]] = True
                sig, who = signatures(h, bounds, percent)
                sig, who = sig[tells[who]], who[tells[who]]
                for low in range(0, len(sig), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who[low : low + 100_000]]), pa.array(sig[low : low + 100_000].view(np.int64))], ["doc_id", "sig"])
        release()

    return run


class _Forest:
    """Components of the rows of a tile, with the links that joined something."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {}
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        of_a, of_b = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(of_a) < len(of_b):
            a, of_a, of_b = b, of_b, of_a
        self.label[of_b] = a
        of_a.extend(of_b)
        self.members[a] = of_a
        self.links.append((i, j))


def link_sets(h: np.ndarray, bounds: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets whose similarity is high enough; with side, only links between the two sides count."""
    n = np.diff(bounds)
    count = len(n)
    bits = np.zeros((count, BITMAP), np.uint64)
    owner = np.repeat(np.arange(count), n)
    np.bitwise_xor.at(bits, (owner, ((h >> np.uint64(6)) % np.uint64(BITMAP)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
    order = np.argsort(n, kind="stable")
    sizes, forest = n[order], _Forest(count)
    for place in range(1, count):
        i = order[place]
        low = np.searchsorted(sizes, -(-percent * n[i] // 100))
        near = order[low:place]
        if side is not None:
            near = near[side[near] != side[i]]
        mine = h[bounds[i] : bounds[i + 1]]
        # the sets next in size first: most of a group of near copies is joined by them, and then needn't be met one by one
        for some in (near[-NEXT:], near[:-NEXT]):
            some = some[forest.label[some] != forest.label[i]]
            if not len(some) or not n[i]:
                continue
            apart = np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64)
            total = n[some] + n[i]
            ok = (total - apart) // 2 * (100 + percent) >= percent * total
            some, apart = some[ok], apart[ok]
            for j in some[np.argsort(apart, kind="stable")].tolist():
                if forest.label[j] == forest.label[i]:
                    continue
                other = h[bounds[j] : bounds[j + 1]]
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                both = int(np.count_nonzero(mine[at] == other))
                if both * 100 >= percent * (len(mine) + len(other) - both):
                    forest.join(i, j)
    return forest.links


def _check_tile(size: int, percent: int):
    def run(table):
        import pyarrow as pa

        ids, roots, sides = (np.array(table.column(c).to_pylist(), np.int64) for c in ("doc_id", "root", "side"))
        texts = (x.as_py() for x in table.column("text"))
        h, bounds = [], [np.zeros(1, np.int64)]
        for _, group in chunks(texts, 1 << 20):
            x, b = shingle_sets(group, size)
            h.append(x)
            bounds.append(b[1:] + bounds[-1][-1])
        h, bounds = np.concatenate(h), np.concatenate(bounds)
        a, b = [], []
        order = np.argsort(roots, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], roots[order][1:] != roots[order][:-1], [True]]))
        for low, high in zip(cut[:-1], cut[1:]):
            rows = order[low:high]
            if len(rows) < 2:
                continue
            own = np.concatenate([h[bounds[r] : bounds[r + 1]] for r in rows])
            own_bounds = np.concatenate([[0], np.cumsum(bounds[rows + 1] - bounds[rows])])
            side = sides[rows] if sides[rows].min() >= 0 else None
            for i, j in link_sets(own, own_bounds, percent, side):
                a.append(ids[rows[i]])
                b.append(ids[rows[j]])
        del h, bounds
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """members(doc_id, root, n) with g, the tile or pair of tiles of each row, and side (-1: compare all)."""
    totals = members.groupBy("root").agg(F.sum("n").alias("elements"), F.count("*").alias("rows"))
    whole = totals.agg(F.coalesce(F.sum("elements"), F.lit(0))).first()[0]
    bins = max(1, int(2 * whole // TILE) + 1)
    total = members.count()
    sized = attach_groups(members, totals, "root", "rows", total)
    small = sized.filter(f"elements <= {TILE}").select("doc_id", "root", F.concat(F.lit("s"), F.expr(f"pmod(xxhash64(root), {bins})")).alias("g"), F.lit(-1).alias("side"))
    large = sized.filter(f"elements > {TILE}")
    # bands of ratio 100 / percent: only equal and neighbouring ones can link
    large = large.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int"))
    per = large.groupBy("root", "band").agg(F.sum("n").alias("e")).select("root", "band", F.ceil(F.expr(f"2 * e / {TILE}")).cast("int").alias("p"))
    # fewer than 2 * elements / TILE roots and, in each, as many bands as sizes allow: a small table
    p = {name: F.broadcast(per.select("root", (F.col("band") + shift).alias("band"), F.col("p").alias(name))) for name, shift in (("p", 0), ("above", -1), ("below", 1))}
    large = large.join(p["p"], ["root", "band"]).join(p["above"], ["root", "band"], "left").join(p["below"], ["root", "band"], "left")
    large = large.withColumn("i", F.expr("cast(pmod(xxhash64(doc_id), p) as int)"))
    pairs = F.expr(
        "concat(transform(sequence(0, p - 1), j -> struct(concat_ws('|', root, 'e', band, least(i, j), greatest(i, j)) as g, if(i = j, -1, if(i < j, 0, 1)) as side)), "
        "if(above is null, array(), transform(sequence(0, above - 1), j -> struct(concat_ws('|', root, 'n', band, i, j) as g, 0 as side))), "
        "if(below is null, array(), transform(sequence(0, below - 1), j -> struct(concat_ws('|', root, 'n', band - 1, j, i) as g, 1 as side))))"
    )
    large = large.select("doc_id", "root", F.explode(pairs).alias("x")).select("doc_id", "root", "x.g", "x.side")
    return small.unionByName(large)


def _with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by doc_id with the texts: a broadcast of a counted table up to BROADCAST_ROWS rows, a sort-merge join beyond."""
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge"), "doc_id")


def _candidates(sets: DataFrame) -> DataFrame:
    """doc_id of one text of each different set that other sets may be linked with."""
    one = sets.filter("hope").groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    return materialize(one, "prospects")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(prospects(docs, size, percent), "sets")
    plain = sets.select("doc_id", "n", "k")
    groups = materialize(plain.filter("n > 0 and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("size")), "set-groups")
    left = _candidates(sets)
    for _ in range(ROUNDS):
        again = materialize(prospects(_with_texts(docs, left), size, percent), "sets-left")
        fewer = _candidates(again)
        discard(left, again)
        left = fewer
    parts = _with_texts(docs, left).select("doc_id", "text").mapInArrow(_describe(size, percent), "doc_id bigint, sig bigint")
    star = F.expr("first(doc_id) over (partition by sig order by doc_id)")
    stars = parts.select(star.alias("a"), F.col("doc_id").alias("b")).filter("a <> b")
    near = connected_components(stars).withColumnRenamed("v", "doc_id")
    members = near.join(groups.select(F.col("rep").alias("doc_id"), F.col("size").alias("n")), "doc_id").select("doc_id", "root", "n")
    members = materialize(members, "members")
    tiles = materialize(_tiles(members, percent), "tiles")
    links = _with_texts(docs, tiles).select("g", "root", "side", "doc_id", "text").groupBy("g").applyInArrow(_check_tile(size, percent), "a bigint, b bigint")
    found = connected_components(links).select(F.col("v").alias("rep"), "root")
    named = materialize(groups.join(found, "rep", "left").select("k", "copies", F.coalesce("root", "rep").alias("component_id")), "components")
    discard(left, members, tiles, groups)
    counted = plain.filter("n > 0 and doc_id is not null")
    out = attach_groups(counted, named, "k", "copies", counted.count())
    rest = plain.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(rest)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their component, with all their columns: the pipeline stage."""
    found = materialize(jaccard_components(docs, size, percent).filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "dropped")
    gone = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(gone, F.expr("cast(row.doc_id as bigint)") == gone["id"], "left_anti").select("row.*")
