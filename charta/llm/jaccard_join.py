"""N-gram Jaccard join with signature trees.

Documents are sets of distinct word shingles. All pairs of different sets with a Jaccard similarity
of at least the threshold can be found, none is missed:

1. Equal sets form one class; one row of it, the rep, stands for it.
2. A set that links shares a share t of its shingles with other sets, so of any p + m of them, with
   p = n - ceil(t n) + 1, at least m + 1. Reps that share fewer of their first p + m fingerprints drop
   out. Fingerprints travel packed, a blob for each portion of rows and bucket of fingerprints, and
   only the shared ones come back.
3. Of the sets that are left all shingles are counted. In the order of (sets that have it, fingerprint)
   two linked sets share one of their first p shingles. Shingles that one set alone has come first, so
   the lists of what is left of the prefixes are few and short. Lists with equal members become one.
4. Signature trees give the candidates: leaves of sets in the order of size, nodes with OR-combined
   bitmaps and size ranges. A dual traversal drops node pairs whose largest possible overlap is too
   small, then pairs of sets by the same bound; a pair that is left, and that no link connects yet, is
   compared in full there. So a tree gives links that connect what it can connect, not all pairs.
   First each set meets its longest list, in blocks of bounded size. Then all lists whose members
   are not connected yet are traversed, those of equal components as one, long ones by size class and
   as pairs of blocks; blocks of what is connected already do not meet.
5. Links are joined to components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charta.llm.components import components
from charta.llm.wordhash import mix, portions, shingle_sets
from charta.llm.workdir import written

#: Least m; fingerprints in a bucket, shingles in a block of trees, as how many shingles each set counts besides its own, sets in a leaf. None limits what is found.
MARGIN, BUCKET, BLOCK, PER_SET, LEAF = 16, 250_000, 1 << 18, 1024, 48
#: Tables of up to so many narrow rows (40 bytes or less) are broadcast, counted first; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_WIDE = np.uint64((1 << 40) - 1)


def prefix_length(n, percent: int):
    return n + -(percent * n) // 100 + 1


def _bits(n: int) -> int:
    """Bitmap size: a power of two, 64 or more; 8 bits a shingle up to 1024, then 2."""

    def upto(x: float) -> int:
        return 64 << max(0, math.ceil(math.log2(max(1.0, x / 64.0))))

    return min(upto(8 * n), max(1024, upto(2 * n)))


def bitmap(grams: np.ndarray) -> bytes:
    out = np.zeros(_bits(len(grams)), np.uint8)
    out[grams & np.uint64(len(out) - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of as many 64-bit words, OR-combined from a longer one."""
    return bits if len(bits) <= words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets of sizes that allow a link are in the same class or in neighbouring ones."""
    return np.floor(np.log(n) / _width(percent)).astype(np.int64)


def _width(percent: int) -> float:
    """By how much the logarithms of the sizes of linked sets differ at most, and a little more."""
    return max(-math.log(percent / 100.0), 1e-6) * (1 + 1e-9)


class SignatureTree:
    """Sets in order of size, in leaves of LEAF; every node has the OR of its bitmaps, its size range and the most shingles that share a bit."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.at, self.sizes, self.bits = at, sizes, bits
        self.slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.root = self._node(0, len(sizes))

    def _node(self, a: int, z: int) -> tuple:
        if z - a <= LEAF:
            kids, union = (), np.bitwise_or.reduce(self.bits[a:z], axis=0)
        else:
            m = (a + z) // 2
            kids = (self._node(a, m), self._node(m, z))
            union = kids[0][5] | kids[1][5]
        return a, z, int(self.sizes[a:z].min()), int(self.sizes[a:z].max()), int(self.slack[a:z].max()), union, kids


def _needed(total, percent: int):
    """The least overlap of two linked sets with so many shingles together."""
    return -(-percent * total // (100 + percent))


def dual_traversal(x: SignatureTree, y: SignatureTree, percent: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that may be linked and have different labels when they are met; for x is y each pair once. ``labels`` may change meanwhile."""
    todo = [(x.root, y.root)]
    while todo:
        p, q = todo.pop()
        if 100 * p[3] < percent * q[2] or 100 * q[3] < percent * p[2]:
            continue
        if min(p[3], q[3], int(np.bitwise_count(p[5] & q[5]).sum()) + max(p[4], q[4])) < _needed(p[2] + q[2], percent):
            continue
        left, right = labels[x.at[p[0] : p[1]]], labels[y.at[q[0] : q[1]]]
        if (left == left[0]).all() and (right == left[0]).all():
            continue
        if p[6] or q[6]:
            if x is y and p is q:
                todo += [(p[6][0], p[6][0]), (p[6][0], p[6][1]), (p[6][1], p[6][1])]
            elif p[6] and (not q[6] or p[1] - p[0] >= q[1] - q[0]):
                todo += [(kid, q) for kid in p[6]]
            else:
                todo += [(p, kid) for kid in q[6]]
            continue
        fit = left[:, None] != right[None, :]
        if x is y and p is q:
            fit &= np.triu(np.ones(fit.shape, bool), 1)
        i, j = np.nonzero(fit)
        i, j = i + p[0], j + q[0]
        n, m = x.sizes[i], y.sizes[j]
        fit = (100 * n >= percent * m) & (100 * m >= percent * n)
        i, j, n, m = i[fit], j[fit], n[fit], m[fit]
        if len(i):
            overlap = np.bitwise_count(x.bits[i] & y.bits[j]).sum(axis=1, dtype=np.int64) + np.minimum(x.slack[i], y.slack[j])
            fit = np.minimum(np.minimum(n, m), overlap) >= _needed(n + m, percent)
            if fit.any():
                yield x.at[i[fit]], y.at[j[fit]]


def candidates(sizes: np.ndarray, bits: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that may be linked, by trees over neighbouring size classes; between the sides 0 and 1, or within the one side there is."""
    kinds = size_class(sizes, percent)
    sides = np.unique(side).tolist()
    there = set(kinds.tolist())

    def tree(s: int, kind: int, words: int) -> SignatureTree | None:
        at = np.flatnonzero((side == s) & (kinds == kind))
        at = at[np.argsort(sizes[at], kind="stable")]
        return SignatureTree(at, sizes[at], np.stack([_fold(bits[i], words) for i in at])) if len(at) else None

    for kind in sorted(there):
        for near in (kind, kind + 1):
            if near not in there:
                continue
            words = min(len(bits[i]) for i in np.flatnonzero((kinds == kind) | (kinds == near)))
            if len(sides) == 1:
                x = tree(sides[0], kind, words)
                yield from dual_traversal(x, x if near == kind else tree(sides[0], near, words), percent, labels)
            else:
                for a, b in [(0, 1)] if near == kind else [(0, 1), (1, 0)]:
                    x, y = tree(sides[a], kind, words), tree(sides[b], near, words)
                    if x and y:
                        yield from dual_traversal(x, y, percent, labels)


def _blobs(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers of every cell of a binary column."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that come sorted by their first ``keys`` columns; binary cells are buffers."""
    key, rows = None, []
    for batch in batches:
        cols = [[x.as_buffer() if x.is_valid else None for x in c] if pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def _sketches(k: int, percent: int) -> Callable:
    """Of each text: the size of its set, its class, its first p + m fingerprints, and how many of them must be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, 1, 4 << 20)):
            rows: list[tuple] = []
            for _, grams in shingle_sets(batch.column(1), k):
                n = len(grams)
                if not n:
                    rows.append((0, None, 0, None))
                    continue
                p = prefix_length(n, percent)
                take = min(n, p + MARGIN + p // 2)
                rows.append((n, _class(grams), take - p + 1, grams[:take].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n", "cls", "need", "toks"])

    return run


def _class(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _packets(buckets: int) -> Callable:
    """(row, number, fingerprints) as a blob for each portion of rows and bucket of fingerprints.

    A portion is named by its first row (``base``), its rows by their place in it (``far``). One of its
    blobs, by turns, carries (row, number) of all its rows as ``sizes``.
    """

    def packet(rows: np.ndarray, numbers: np.ndarray, toks: list[np.ndarray]) -> pa.RecordBatch:
        base = int(rows[0])
        far = np.repeat(np.arange(len(rows)), [len(t) for t in toks])
        all_ = np.concatenate(toks)
        at = ((mix(all_) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(at, kind="stable")
        names, firsts = np.unique(at[order], return_index=True)
        cuts = [*firsts.tolist(), len(order)]
        subs = (all_[order] & _WIDE).view(np.uint8).reshape(-1, 8)[:, :5]
        far = far[order].astype(np.uint16 if len(rows) <= 1 << 16 else np.uint32)
        sizes: list[bytes | None] = [None] * len(names)
        sizes[hash(base) % len(names)] = np.stack([rows, numbers]).astype(np.int64).tobytes()
        spans = list(zip(cuts, cuts[1:], strict=False))
        return pa.RecordBatch.from_arrays(
            [pa.array(names.astype(np.int32)), pa.array(np.full(len(names), base, np.int64)), pa.array([subs[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([far[a:z].tobytes() for a, z in spans], pa.binary()), pa.array(sizes, pa.binary())],
            names=["bucket", "base", "subs", "far", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, 2, 8 * BUCKET)):
            rows, numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if len(rows):
                yield packet(rows, numbers, _blobs(batch.column(2)))

    return run


_PACKET = "bucket int, base long, subs binary, far binary, sizes binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two rows or more of a bucket have, for each packet, and in how many (up to 65535)."""
    for (bucket,), rows in _groups(batches, 1):
        parts = [np.frombuffer(r[2], np.uint8).reshape(-1, 5) for r in rows]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        np.concatenate(parts, out=wide[:, :5])
        wide = wide.view(np.uint64).ravel()
        _, which, counts = np.unique(wide, return_inverse=True, return_counts=True)
        df = counts[which]
        out: dict[str, list] = {n: [] for n in ("base", "bucket", "subs", "far", "dfs", "sizes")}
        at = 0
        for (_, base, _, far, sizes), part in zip(rows, parts, strict=True):
            own = df[at : at + len(part)]
            at += len(part)
            hit = own > 1
            if not hit.any() and sizes is None:
                continue
            far = np.frombuffer(far, np.uint16 if far.size == 2 * len(part) else np.uint32)
            out["base"].append(base)
            out["bucket"].append(bucket)
            out["subs"].append(part[hit].tobytes())
            out["far"].append(far[hit].tobytes())
            out["dfs"].append(np.minimum(own[hit], 65535).astype(np.uint16).tobytes())
            out["sizes"].append(None if sizes is None else sizes.to_pybytes())
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(out, kinds, strict=True)], names=list(out))


_SHARED = "base long, bucket int, subs binary, far binary, dfs binary, sizes binary"


def _packet_parts(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the row, fingerprint, count) of all hits of a packet, and (row, number) of its rows."""
    far, toks, dfs, sizes = [], [], [], None
    for _, bucket, subs, off, df, size in rows:
        d = np.frombuffer(df, np.uint16)
        wide = np.zeros((len(d), 8), np.uint8)
        wide[:, :5] = np.frombuffer(subs, np.uint8).reshape(-1, 5)
        toks.append(wide.view(np.uint64).ravel() | (np.uint64(bucket) << np.uint64(40)))
        far.append(np.frombuffer(off, np.uint16 if off.size == 2 * len(d) else np.uint32).astype(np.int64))
        dfs.append(d)
        if size is not None:
            sizes = np.frombuffer(size, np.int64).reshape(2, -1)
    return np.concatenate(far), np.concatenate(toks), np.concatenate(dfs), sizes[0], sizes[1]


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with enough shared fingerprints."""
    for _, rows in _groups(batches, 1):
        far, _, _, own, need = _packet_parts(rows)
        yield pa.RecordBatch.from_arrays([pa.array(own[np.bincount(far, minlength=len(own)) >= need])], names=["row"])


def _prefixes(percent: int) -> Callable:
    """(tok, row, n): the shared shingles in the first p of each row, in the order of count and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            far, toks, dfs, own, n = _packet_parts(rows)
            order = np.lexsort((toks, dfs, far))
            far, toks = far[order], toks[order]
            counts = np.bincount(far, minlength=len(n))
            place = np.arange(len(far)) - (np.cumsum(counts) - counts)[far] + (n - counts)[far]
            fit = place < prefix_length(n[far], percent)
            yield pa.RecordBatch.from_arrays([pa.array(toks[fit].view(np.int64)), pa.array(own[far[fit]]), pa.array(n[far[fit]])], names=["tok", "row", "n"])

    return run


def _sets(k: int) -> Callable:
    """The sets of the texts whose class is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, 2, 4 << 20)):
            keep, sizes, blobs = [], [], []
            for i, grams in shingle_sets(batch.column(2), k):
                if len(grams) and _class(grams) == batch.column(1)[i].as_py():
                    keep.append(i)
                    sizes.append(len(grams))
                    blobs.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["row", "n", "grams"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0


def _trees(percent: int, key: int) -> Callable:
    """Links that connect what one block, or one pair of blocks, can connect; rows come sorted by their first ``key`` columns, then side, row, label, grams.

    a, b, shared, united; beside each a label (``row``) that has become another one (``label``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, key):
            side, names, before = (np.array([r[key + c] for r in rows], np.int64) for c in range(3))
            if len(rows) < 2 or (before == before[0]).all():
                continue
            grams = [np.frombuffer(r[key + 3], np.uint64) for r in rows]
            _, first, labels = np.unique(before, return_index=True, return_inverse=True)
            labels = first[labels]  # labels here are positions
            sizes = np.array([len(g) for g in grams], np.int64)
            bits = [np.frombuffer(bitmap(g), np.uint64) for g in grams]
            links: list[tuple[int, int, int, int]] = []
            for left, right in candidates(sizes, bits, labels, np.unique(side, return_inverse=True)[1], percent):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    if labels[i] == labels[j] or names[i] == names[j]:
                        continue
                    shared = _overlap(grams[i], grams[j])
                    united = int(sizes[i] + sizes[j]) - shared
                    if 100 * shared >= percent * united:
                        links.append((int(names[i]), int(names[j]), shared, united))
                        a, b = sorted((int(labels[i]), int(labels[j])))
                        labels[labels == b] = a
            if not links:
                continue
            a, b, shared, united = (np.array(c, np.int64) for c in zip(*links, strict=True))
            # the smallest label of a component is its label
            least = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(least, labels, before)
            now = least[labels]
            moved = np.unique(np.stack([before, now]), axis=1)
            moved = moved[:, moved[0] != moved[1]]
            fill = lambda x: pa.array([*x.tolist(), *[None] * (len(a) - len(x))], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(shared), pa.array(united), fill(moved[0]), fill(moved[1])], names=["a", "b", "shared", "united", "row", "label"])

    return run


_LINKS = "a long, b long, shared long, united long, row long, label long"


def _near(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and broadcast where its rows, counted, are few."""
    return _small(written(df, name))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, broadcast where its rows, counted, are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (row, number, toks) as what is shared of each packet, sorted by packet. total: fingerprints in all."""
    buckets = max(1, -(-total // BUCKET))
    packets = rows.mapInArrow(_packets(buckets), _PACKET)
    found = packets.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _SHARED)
    return found.repartition("base").sortWithinPartitions("base")


def _weight() -> Column:
    """What the sets of a list take of a block."""
    return F.sum(F.col("n") + PER_SET)


def _pairs_of_blocks(chosen: DataFrame) -> DataFrame:
    """``chosen`` (s1, s2, row, n, label, total) dealt to (bi, bj, side).

    A list that weighs up to BLOCK is one block. In a longer one the rows of its largest label
    have blocks of their own, below 0, which never meet each other; all other pairs of blocks meet.
    """
    key = ["s1", "s2"]
    long = chosen.filter(F.col("total") > BLOCK)
    of = long.groupBy(*key, "label").agg(_weight().alias("m")).groupBy(*key).agg(F.max(F.struct("m", "label")).alias("most"))
    of = _near(of.select(*key, F.col("most.label").alias("main"), "most.m"), "main_labels")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / BLOCK)).cast("int")
    rows = long.join(of, key).withColumns({"own": F.col("label") == F.col("main"), "mb": blocks(F.col("m")), "ob": blocks(F.col("total") - F.col("m"))})
    place = lambda b: F.pmod(F.xxhash64("row"), F.col(b).cast("long")).cast("int")
    rows = rows.withColumn("side", F.when(F.col("own"), -1 - place("mb")).otherwise(place("ob")))
    others = F.sequence(F.lit(0), F.col("ob") - 1)
    rows = rows.withColumn("other", F.explode(F.when(F.col("own"), others).otherwise(F.concat(others, F.transform(F.sequence(F.lit(1), F.col("mb")), lambda i: -i)))))
    cols = [*key, "bi", "bj", "side", "row", "label"]
    rows = rows.withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")}).select(*cols)
    zero = F.lit(0)
    return chosen.filter(F.col("total") <= BLOCK).withColumns({"bi": zero, "bj": zero, "side": zero}).select(*cols).unionByName(rows)


def _links(sets: DataFrame, dealt: DataFrame, key: list[str], percent: int) -> DataFrame:
    """What the trees of all blocks find; ``dealt`` (key, side, row, label)."""
    rows = _near(dealt, "dealt").join(sets, "row").select(*key, "side", "row", "label", "grams")
    return written(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_trees(percent, len(key)), _LINKS), "links")


def _first_links(sets: DataFrame, lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels): trees over the longest list of each row, in blocks that weigh about BLOCK.

    labels (row, label): rows that links connect to another; label is the smallest row reached. A list
    of several blocks is dealt once more, in another way, so that its blocks connect.
    """
    key = ["s1", "s2"]
    home = written(lists.groupBy("row").agg(F.max(F.struct("c", *key)).alias("h"), F.first("n").alias("n")).select("row", "n", "h.s1", "h.s2"), "homes")
    sizes = _near(home.groupBy(*key).agg(_weight().alias("total"), F.count("*").alias("c")).filter("c > 1").select(*key, F.ceil(F.col("total") / BLOCK).alias("blocks")), "home_sizes")
    home = written(home.join(sizes, key).select("row", *key, "blocks"), "homes")

    def trees(of: DataFrame, seed: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks")).alias("block")
        return _links(sets, of.select(*key, block, F.lit(0).alias("side"), "row", "label"), [*key, "block"], percent)

    found = trees(home.withColumn("label", F.col("row")), 1)
    links, labels = found.select("a", "b", "shared", "united"), found.filter("row is not null").select("row", "label")
    several = written(home.filter("blocks > 1").join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "several")
    if several.limit(1).count():
        again = trees(several, 2)
        # blocks share labels here, so what they have joined is joined in all
        joined = written(components(again.filter("row is not null").select(F.col("row").alias("a"), F.col("label").alias("b"))), "joined")
        all_ = home.select("row").join(labels, "row", "left").withColumn("old", F.coalesce("label", "row")).drop("label")
        labels = all_.join(joined, F.col("old") == F.col("node"), "left").select("row", F.coalesce("component", "old").alias("label")).filter("row <> label")
        links = links.unionByName(again.select("a", "b", "shared", "united"))
    return links, written(labels, "labels")


def _second_links(sets: DataFrame, lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between rows of different labels, from all lists that have such rows. Lists with the same labels become one list."""
    key = ["s1", "s2"]
    rows = written(lists.join(_small(labels), "row", "left").select(*key, "row", "n", F.coalesce("label", "row").alias("label")), "labelled")
    one = lambda seed: F.bit_xor(F.xxhash64("label", F.lit(seed)))
    mixed = rows.select(*key, "label").distinct().groupBy(*key).agg(one(1).alias("l1"), one(2).alias("l2"), F.count("*").alias("c")).filter("c > 1").drop("c")
    chosen = rows.join(_near(mixed, "mixed"), key).select(F.col("l1").alias("s1"), F.col("l2").alias("s2"), "row", "n", "label").distinct()
    chosen = _weighed(written(chosen, "chosen"))
    # a long list parts into those of neighbouring size classes, which have all its links
    sk = F.explode(F.array("k", F.col("k") + 1)).alias("sk")
    parted = chosen.filter(F.col("total") > BLOCK).select(*key, "row", "n", "label", F.floor(F.log("n") / _width(percent)).cast("int").alias("k")).select("*", sk)
    parted = parted.select(*[F.xxhash64(c, "sk").alias(c) for c in key], "row", "n", "label")
    parted = _weighed(written(parted, "parted"))
    dealt = chosen.filter(F.col("total") <= BLOCK).unionByName(parted)
    return _links(sets, _pairs_of_blocks(dealt).select(*key, "bi", "bj", "side", "row", "label"), [*key, "bi", "bj"], percent)


def _weighed(lists: DataFrame) -> DataFrame:
    """``lists`` (s1, s2, row, n, label), those that have several labels, with what they weigh as ``total``."""
    key = ["s1", "s2"]
    totals = lists.groupBy(*key).agg(_weight().alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(*key, "total")
    return lists.join(_near(totals, "totals"), key)


def similar(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Near duplicates among ``docs`` (doc_id long, text string, any others).

    Two documents link when ``100 * shared >= percent * united`` over their distinct ``k``-word
    shingles; words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z as a-z.

    Returns (documents, links). documents: doc_id, n_shingles, component_id, one row per input row;
    component_id is the smallest doc_id that links reach. links: a, b, shared, united for links
    between different sets that were compared; links between members of equal sets, or of two
    documents that other links already connect, are not listed.

    Null or empty texts, and texts of white space, have no shingles and link with nothing. A text of
    fewer than k words has one shingle, its word sequence. Rows that share a doc_id count as one
    document with several texts: a link of either is a link of the document. Rows with a null doc_id
    link with nothing; their component_id is null. Very long texts are sets like all others. An empty
    table gives empty results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = docs.mapInArrow(_sketches(k, percent), "doc_id long, n long, cls binary, need long, toks binary")
    sketch = written(sketch.withColumn("row", F.monotonically_increasing_id()), "sketch")
    known = sketch.filter("doc_id is not null and n > 0")

    classes = known.groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count("*").alias("c")).filter("c > 1").select("cls", "rep")
    members = written(known.select("row", "doc_id", "cls").join(_near(classes, "classes"), "cls").filter("row <> rep.row").select("row", F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("b")), "members")
    reps = known.join(_near(members.select("row"), "gone"), "row", "left_anti")

    total = known.agg(F.sum(F.octet_length("toks"))).first()[0] or 0
    alive = _dealt(reps.select("row", "need", "toks"), total // 8).mapInArrow(_alive, "row long")
    live = _near(known.select("row", "doc_id", "cls").join(_near(alive, "alive"), "row"), "live")
    sets = written(docs.join(live, "doc_id").select("row", "cls", "text").mapInArrow(_sets(k), "row long, n long, grams binary"), "sets")

    total = sets.agg(F.sum("n")).first()[0] or 0
    flat = written(_dealt(sets.select("row", "n", "grams"), total).mapInArrow(_prefixes(percent), "tok long, row long, n long"), "prefixes")
    one = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    names = flat.groupBy("tok").agg(one(1).alias("s1"), one(2).alias("s2"), F.count("*").alias("c")).filter("c > 1")
    lists = written(flat.join(_near(names, "names"), "tok").select("s1", "s2", "c", "row", "n").distinct(), "lists")

    first, labels = _first_links(sets, lists, percent)
    second = _second_links(sets, lists, labels, percent).select("a", "b", "shared", "united")

    ids = sketch.select("row", "doc_id")
    links = written(first.unionByName(second), "row_links")
    for c in ("a", "b"):
        links = links.join(ids, F.col("row") == F.col(c)).withColumn(c, F.col("doc_id")).drop("row", "doc_id")
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "united").filter("a <> b").distinct(), "links")

    groups = components(links.select("a", "b").unionByName(members.select("a", "b")))
    out = sketch.select("doc_id", F.col("n").alias("n_shingles")).join(_near(groups.withColumnRenamed("node", "doc_id"), "groups"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), links


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest doc_id stays, with all its rows; rows with a null doc_id stay."""
    found, _ = similar(docs, k, percent)
    name = next(f"gone{i}" for i in range(len(docs.columns) + 1) if f"gone{i}" not in docs.columns)
    gone = _near(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
