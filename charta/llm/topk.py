"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector is split into parts of its dimensions. A node holds one part of a group of vectors and knows
that part of their scores alone; nodes are rows (query block, group, part) that tasks work on apart.

1. Every node gathers, for each query, the k best partial scores and the least one. Of the k best of a
   part the other parts are fetched; the k-th best of these full scores is a score that the result
   reaches for certain.
2. This cutoff goes to the nodes. A vector that reaches it exceeds, at one part at least, that part's
   least score by an equal share of what the cutoff exceeds the sum of the least scores by. Only such
   entries leave the nodes.
3. Their missing parts are fetched, from one part's node after the other, and the k best stay.

Vectors stand in slices and queries in blocks of bounded size, as packed matrices of the narrowest
integers that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charta.llm.workdir import written

#: Vectors in a slice, slices in a group, queries in a block, parts of a vector, queries that are multiplied at once. None grows with the data.
SLICE, GROUP, BLOCK, PARTS, ROWS = 4096, 4, 1024, 2, 128
#: Partitions that nodes are dealt to, at most.
MOST = 100_000
_NONE = -(1 << 61)


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component. Null vectors or ids, and vectors with null or non-finite components, are left out; of several vectors with one vec_id the smallest counts."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def parts_of(width: int) -> list[slice]:
    step = max(1, -(-width // PARTS))
    return [slice(a, min(width, a + step)) for a in range(0, max(width, 1), step)]


def _narrow(x: np.ndarray) -> np.ndarray:
    """In the narrowest integers of 2, 4 or 8 bytes."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(raw: pa.Buffer | bytes, count: int) -> np.ndarray:
    """``count`` integers of 2, 4 or 8 bytes."""
    size = len(raw) // count if count else 8
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[size])


def _packed(rows: DataFrame, count: int, size: int, width: int, name: str) -> DataFrame:
    """Rows (name, part, ids, mat), name from 0: about ``size`` vectors each; shorter vectors end in zeros."""
    number = max(1, -(-count // size))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int").alias(name), "vec_id", "v").repartition(name).sortWithinPartitions(name)
    spans = parts_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: int, ids: list[np.ndarray], mats: list[np.ndarray]) -> pa.RecordBatch:
            mat, own = np.concatenate(mats), np.concatenate(ids).tobytes()
            blobs = [_narrow(mat[:, s]).tobytes() for s in spans]
            return pa.RecordBatch.from_arrays([pa.array([at] * len(spans), pa.int32()), pa.array(range(len(spans)), pa.int32()), pa.array([own] * len(spans), pa.binary()), pa.array(blobs, pa.binary())], names=[name, "part", "ids", "mat"])

        key, ids, mats = None, [], []
        for batch in batches:
            keys, vec_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            lists = batch.column(2)
            lengths = np.diff(np.asarray(lists.offsets))
            mat = np.zeros((len(keys), width), np.int64)
            at = np.repeat(np.arange(len(keys)), lengths)
            mat[at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if keys[a] != key:
                    if ids:
                        yield out(key, ids, mats)
                    key, ids, mats = int(keys[a]), [], []
                ids.append(vec_ids[a:z])
                mats.append(mat[a:z])
        if ids:
            yield out(key, ids, mats)

    return dealt.mapInArrow(run, f"{name} int, part int, ids binary, mat binary")


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: by floating point where no sum can pass its exact integers, else by integers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    most = max(int(q.max()), -int(q.min())) * max(int(c.max()), -int(c.min())) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def _best(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in no order."""
    n = min(k, x.shape[1])
    return np.argpartition(x, x.shape[1] - n, axis=1)[:, x.shape[1] - n :]


class _Node:
    """A query block beside a group of slices, at one part; rows come as (block), then for each slice (matrix) and (entries)."""

    def __init__(self, key: tuple, rows: Iterator[dict]) -> None:
        self.qb, self.g, self.part, self.rows = *key, rows
        self.ids = None

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[dict]]]:
        """(slice, ids, matrix, entries) of every slice."""
        now = None
        for row in self.rows:
            if row["kind"] == 0:
                self.ids = np.frombuffer(row["ids"], np.int64)
                self.mat = _wide(row["mat"], len(self.ids) * row["width"]).reshape(len(self.ids), -1)
                # thresholds of all parts, then the cutoff
                self.limits = None if row["val"] is None else np.frombuffer(row["val"], np.int64).reshape(-1, len(self.ids))
            elif row["kind"] == 1:
                if now and self.ids is not None:
                    yield now
                ids = np.frombuffer(row["ids"], np.int64)
                now = (row["slice"], ids, _wide(row["mat"], len(ids) * row["width"]).reshape(len(ids), -1), [])
            elif now:
                now[3].append(row)
        if now and self.ids is not None:
            yield now


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[_Node]:
    """Nodes of rows that come sorted; a node's rows must be read before the next node is asked for."""

    def flat() -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            cols = {n: [x.as_buffer() if x.is_valid else None for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            for i in range(batch.num_rows):
                yield (cols["qb"][i], cols["g"][i], cols["part"][i]), {n: c[i] for n, c in cols.items()}

    stream = flat()
    held = next(stream, None)
    while held is not None:
        key = held[0]

        def own(key: tuple = key) -> Iterator[dict]:
            nonlocal held
            while held is not None and held[0] == key:
                yield held[1]
                held = next(stream, None)

        rows = own()
        yield _Node(key, rows)
        for _ in rows:
            pass


def _gather(k: int) -> Callable:
    """Phase 1 at a node: of each query the k best partial scores, where they stand, and the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _nodes(batches):
            best = None
            for number, cid, c, _ in node.slices():
                if best is None:
                    best = np.full((len(node.ids), k), _NONE, np.int64), np.zeros((len(node.ids), k), np.int64), np.full(len(node.ids), np.iinfo(np.int64).max)
                score, place, least = best
                for a in range(0, len(node.ids), ROWS):
                    rows = slice(a, a + ROWS)
                    x = _product(node.mat[rows], c)
                    least[rows] = np.minimum(least[rows], x.min(axis=1))
                    x[node.ids[rows, None] == cid[None, :]] = _NONE
                    at = _best(x, k)
                    both = np.concatenate([score[rows], np.take_along_axis(x, at, axis=1)], axis=1)
                    where = np.concatenate([place[rows], at + (number << 32)], axis=1)
                    at = _best(both, k)
                    score[rows], place[rows] = np.take_along_axis(both, at, axis=1), np.take_along_axis(where, at, axis=1)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((node.qb, node.part, *(x.tobytes() for x in best)), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["qb", "part", "score", "place", "least"])

    return run


_LISTS = "qb int, part int, score binary, place binary, least binary"


def _merge(k: int) -> Callable:
    """The nodes' lists of a block, sorted by part, as one list of each part: entries by slice, and a row (slice null) with the least scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, score: np.ndarray, place: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
            qi, j = np.nonzero(score > _NONE)
            rows = _by_slice(key[0], key[1], qi, place[qi, j], score[qi, j])
            rows.append((*key, None, None, None, None, least.tobytes()))
            return _entry_batch(rows)

        key, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                score, place, least = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3, 4))
                score, place = score.reshape(-1, k), place.reshape(-1, k)
                if now != key:
                    if held is not None:
                        yield out(key, *held)
                    key, held = now, (score, place, least)
                    continue
                both, where = np.concatenate([held[0], score], axis=1), np.concatenate([held[1], place], axis=1)
                at = _best(both, k)
                held = np.take_along_axis(both, at, axis=1), np.take_along_axis(where, at, axis=1), np.minimum(held[2], least)
        if held is not None:
            yield out(key, *held)

    return run


#: Entries: of the queries qi of block qb the partial (or summed) scores val of the vectors ci of a slice, n of them, first known at the part ``origin``.
_ENTRIES = "qb int, origin int, slice int, n int, qi binary, ci binary, val binary"


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int32()] * 4, *[pa.binary()] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["qb", "origin", "slice", "n", "qi", "ci", "val"])


def _entries(qb: int, origin: int, number: int, qi: np.ndarray, ci: np.ndarray, val: np.ndarray) -> tuple:
    return (qb, origin, number, len(qi), *(_narrow(x).tobytes() for x in (qi, ci, val)))


def _by_slice(qb: int, origin: int, qi: np.ndarray, place: np.ndarray, val: np.ndarray) -> list[tuple]:
    order = np.argsort(place >> 32, kind="stable")
    qi, place, val = qi[order], place[order], val[order]
    cuts = [0, *(np.flatnonzero(np.diff(place >> 32)) + 1).tolist(), len(place)]
    return [_entries(qb, origin, int(place[a] >> 32), qi[a:z], place[a:z] & 0xFFFFFFFF, val[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if a < z]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2 at a node: the entries that reach the part's threshold."""
    for node in _nodes(batches):
        for number, cid, c, _ in node.slices():
            least = node.limits[node.part]
            for a in range(0, len(node.ids), ROWS):
                x = _product(node.mat[a : a + ROWS], c)
                qi, ci = np.nonzero((x >= least[a : a + ROWS, None]) & (node.ids[a : a + ROWS, None] != cid[None, :]))
                if len(qi):
                    yield _entry_batch([_entries(node.qb, node.part, number, qi + a, ci, x[qi, ci])])


def _fetch(k: int | None, last: bool) -> Callable:
    """At a node of another part: entries with this part added.

    With thresholds, an entry that a part before its origin has collected too is left out. last: the
    entries are complete; they leave as rows (qb, qi, query_id, vec_id, score), those that reach the
    cutoff where there is one, and the k best of each query where k is given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _nodes(batches):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for number, cid, c, entries in node.slices():
                for e in entries:
                    qi, ci, val = (_wide(e[c], e["width"]) for c in ("qi", "ci", "val"))
                    for a in range(0, len(qi), 1 << 16):
                        i, j, v = (x[a : a + (1 << 16)].astype(np.int64) for x in (qi, ci, val))
                        x = (node.mat[i].astype(np.int64) * c[j].astype(np.int64)).sum(axis=1)
                        if node.limits is not None and node.part < e["origin"]:
                            fresh = x < node.limits[node.part][i]
                            i, j, v, x = i[fresh], j[fresh], v[fresh], x[fresh]
                        v = v + x
                        if not last:
                            if len(i):
                                yield _entry_batch([_entries(node.qb, e["origin"], number, i, j, v)])
                            continue
                        if node.limits is not None:
                            enough = v >= node.limits[-1][i]
                            i, j, v = i[enough], j[enough], v[enough]
                        found.append((i, cid[j], v))
                        held += len(i)
                        if k is not None and held > 4 * k * len(node.ids) + (1 << 16):
                            found = [_top(found, k)]
                            held = len(found[0][0])
            if last and found:
                i, vec, v = _top(found, k) if k is not None else tuple(np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), node.qb), pa.int32()), pa.array(i, pa.int32()), pa.array(node.ids[i], pa.int64()), pa.array(vec, pa.int64()), pa.array(v, pa.int64())], names=["qb", "qi", "query_id", "vec_id", "score"])

    return run


_FOUND = "qb int, qi int, query_id long, vec_id long, score long"


def _top(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller vector."""
    i, vec, v = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((vec, -v, i))
    i, vec, v = i[order], vec[order], v[order]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], vec[keep], v[keep]


def _cutoffs(k: int, parts: int) -> Callable:
    """Of each block the thresholds of all parts and the cutoff (val): from full scores of candidates (qi not null) and least scores (least not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(qb: int, least: dict[int, np.ndarray], scores: list[np.ndarray]) -> pa.RecordBatch:
            low = np.stack([least[m] for m in range(parts)])
            cut = np.full(low.shape[1], _NONE, np.int64)
            if scores:
                # a candidate of several parts' lists counts once
                qi, _, v = np.unique(np.concatenate(scores, axis=1), axis=1)
                order = np.lexsort((-v, qi))
                qi, v = qi[order], v[order]
                kth = np.arange(len(qi)) - np.searchsorted(qi, qi) == k - 1
                cut[qi[kth]] = v[kth]
            share = -((low.sum(axis=0) - cut) // parts)
            return pa.RecordBatch.from_arrays([pa.array([qb], pa.int32()), pa.array([np.concatenate([low + share, cut[None]]).tobytes()], pa.binary())], names=["qb", "val"])

        key, least, scores = None, {}, []
        for batch in batches:
            cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            qbs = cols["qb"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(qbs)) + 1).tolist(), len(qbs)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if qbs[a] != key:
                    if key is not None:
                        yield out(key, least, scores)
                    key, least, scores = int(qbs[a]), {}, []
                own = batch.slice(a, z - a)
                full = own.filter(own.column("qi").is_valid())
                if full.num_rows:
                    scores.append(np.stack([full.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("qi", "vec_id", "score")]))
                for r in own.filter(own.column("least").is_valid()).select(["part", "least"]).to_pylist():
                    least[r["part"]] = np.frombuffer(r["least"], np.int64)
        if key is not None:
            yield out(key, least, scores)

    return run


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """The k highest inner products of each query with all other vectors: query_id, rank (from 1), vec_id, score.

    vectors: vec_id, embedding (array of numbers), any others. queries: a condition on vec_id. Vectors
    are quantised first, see ``quantised``. Ties go to the smaller vec_id; a query with fewer than k
    other vectors gets all of them, one with none no row. Shorter vectors count as ended by zeros;
    empty ones score 0. Scores are 64-bit integers and wrap beyond them. Empty tables, and no queries,
    give no rows.
    """
    rows = written(quantised(vectors, scale), "vectors")
    total, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = rows.filter(queries)
    number, width = asked.count(), max(PARTS, width or 1)
    spans = parts_of(width)
    parts, groups, several = len(spans), -(-max(1, -(-total // SLICE)) // GROUP), max(1, -(-number // BLOCK))
    wide = F.element_at(F.array(*[F.lit(s.stop - s.start) for s in spans]), F.col("part") + 1).alias("width")
    null = F.lit(None).cast("binary")
    slices = written(_packed(rows, total, SLICE, width, "slice").select("slice", "part", "ids", "mat", wide), "slices")
    blocks = written(_packed(asked, number, BLOCK, width, "qb").select("qb", "part", "ids", "mat", wide), "blocks")
    cols = ["qb", "g", "part", "slice", "kind", "origin", "width", "ids", "mat", "qi", "ci", "val"]
    group = F.floor(F.col("slice") / GROUP).cast("int").alias("g")

    def nodes(of: DataFrame, entries: DataFrame | None, step: int = 0) -> DataFrame:
        """Rows of all nodes; the entries go to the part that stands ``step`` after their origin. Each block goes to each group, each slice to each block."""
        none, zero = F.lit(None).cast("int").alias("origin"), F.lit(0)
        q = of.select("qb", F.explode(F.sequence(zero, F.lit(groups - 1))).alias("g"), "part", F.lit(-1).alias("slice"), F.lit(0).alias("kind"), none, "width", "ids", "mat", null.alias("qi"), null.alias("ci"), "val")
        s = slices.select(F.explode(F.sequence(zero, F.lit(several - 1))).alias("qb"), group, "part", "slice", F.lit(1).alias("kind"), none, "width", "ids", "mat", null.alias("qi"), null.alias("ci"), null.alias("val"))
        out = q.unionByName(s)
        if entries is not None:
            part = ((F.col("origin") + step) % parts).cast("int").alias("part")
            out = out.unionByName(entries.select("qb", group, part, "slice", F.lit(2).alias("kind"), "origin", F.col("n").alias("width"), null.alias("ids"), null.alias("mat"), "qi", "ci", "val"))
        return out.select(*cols).repartition(min(several * groups * parts, MOST), "qb", "g", "part").sortWithinPartitions("qb", "g", "part", "slice", "kind")

    def full(of: DataFrame, entries: DataFrame, best: int | None) -> DataFrame:
        """The entries with all parts."""
        for step in range(1, parts):
            last = step == parts - 1
            found = nodes(of, entries, step).mapInArrow(_fetch(best, last), _FOUND if last else _ENTRIES)
            entries = found if last else written(found, "entries")
        return entries

    plain = blocks.withColumn("val", null)
    lists = nodes(plain, None).mapInArrow(_gather(k), _LISTS)
    lists = written(lists.repartition("qb", "part").sortWithinPartitions("qb", "part").mapInArrow(_merge(k), _ENTRIES), "lists")
    known = full(plain, lists.filter("slice is not null"), None)
    least = lists.filter("slice is null").select("qb", F.col("origin").alias("part"), F.col("val").alias("least"))
    told = known.select("qb", "qi", "vec_id", "score", F.lit(None).cast("int").alias("part"), null.alias("least"))
    told = told.unionByName(least.select("qb", F.lit(None).cast("int").alias("qi"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("score"), "part", "least"))
    cuts = written(told.repartition("qb").sortWithinPartitions("qb").mapInArrow(_cutoffs(k, parts), "qb int, val binary"), "cutoffs")

    limited = written(blocks.join(cuts, "qb"), "limited")
    entries = written(nodes(limited, None).mapInArrow(_collect, _ENTRIES), "entries")
    found = full(limited, entries, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
