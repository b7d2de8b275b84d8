"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern is the one of the public 50k byte-level vocabularies: contractions, runs of letters,
numbers or other signs with at most one space before them, and white space. Boundaries are found
without a regular expression: code points become classes, each class is a transition function of a
small automaton, functions are composed by an associative scan in blocks, and the state before each
code point tells whether a piece begins there. Pieces go through cached pair merging.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charta.llm.wordhash import chunks, portions

# Classes of code points. QUOTE1 and QUOTE2: an apostrophe that a contraction of one or two letters
# follows. GLUE: a space before a sign that is no space; LONE: other white space there.
LETTER, NUMBER, SIGN, SPACE, GLUE, LONE, QUOTE1, QUOTE2 = range(8)
# States: what the code point before was. FRESH: the text or a piece has just ended.
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, GLUED, IN_SPACE, ONE_MORE, TWO_MORE = range(8)

#: The letters of the contractions of the pattern.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: Fixed value: the pattern that pieces match.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded at once.
PORTION = 1 << 20


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point, and whether a piece begins at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FRESH, False
    if kind in (SPACE, GLUE, LONE):
        to = {SPACE: IN_SPACE, GLUE: GLUED, LONE: FRESH}[kind]
        return to, kind != SPACE or state != IN_SPACE
    if kind in (QUOTE1, QUOTE2) and state not in (GLUED, IN_SIGNS):
        return (ONE_MORE if kind == QUOTE1 else TWO_MORE), True
    to = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(kind, IN_SIGNS)
    return to, state not in (to, GLUED)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Composition table of all functions that classes compose to, the id of each class's function and of its reset form, and the functions."""
    plain = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
    reset = [tuple([f[FRESH]] * 8) for f in plain]
    found = list(dict.fromkeys([tuple(range(8)), *plain, *reset]))
    at = {f: i for i, f in enumerate(found)}
    for f in found:  # grows while it runs
        for g in plain:
            h = tuple(g[f[s]] for s in range(8))
            if h not in at:
                at[h] = len(found)
                found.append(h)
    table = np.array([[at.setdefault(tuple(g[f[s]] for s in range(8)), 0) for g in found] for f in found], np.uint16)
    return table, np.array([at[f] for f in plain], np.uint16), np.array([at[f] for f in reset], np.uint16), np.array(found, np.uint8)


_COMPOSE, _PLAIN, _RESET, _APPLY = _monoid()
_NEXT = np.array([[_step(s, k)[0] for k in range(8)] for s in range(8)], np.uint8)
_BEGINS = np.array([[_step(s, k)[1] for k in range(8)] for s in range(8)], bool)
_WIDTH = 256
_classes: np.ndarray | None = None


def _code_point_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = np.full(0x110000, SIGN, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                kinds[c] = LETTER if kind == "L" else NUMBER
        kinds[WHITE_SPACE] = SPACE
        _classes = kinds
    return _classes


def classes(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Class of every code point; ``firsts``: where texts begin. One code point ahead decides white space, two decide contractions."""
    kinds = _code_point_classes()[points]
    n = len(points)
    last = np.zeros(n + 2, bool)
    last[firsts[firsts > 0] - 1] = True
    last[n - 1 :] = True
    after = np.append(kinds[1:], SPACE)
    before_sign = (kinds == SPACE) & (after != SPACE) & ~last[:n]
    quotes = np.flatnonzero((points == 0x27) & ~last[:n])
    kinds[before_sign] = np.where(points[before_sign] == 0x20, GLUE, LONE)
    if len(quotes):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = ahead[quotes + 1], ahead[quotes + 2]
        kinds[quotes[np.isin(one, [ord(c) for c in ONE_LETTER])]] = QUOTE1
        for pair in TWO_LETTERS:
            kinds[quotes[(one == ord(pair[0])) & (two == ord(pair[1])) & ~last[quotes + 1]]] = QUOTE2
    return kinds


def _scan(functions: np.ndarray) -> np.ndarray:
    """State before each block of _WIDTH functions: blocks are composed, and their results scanned the same way."""
    rows = len(functions) // _WIDTH
    grid = np.ascontiguousarray(functions[: rows * _WIDTH].reshape(rows, _WIDTH).T)
    whole = grid[0]
    for column in grid[1:]:
        whole = _COMPOSE[whole, column]
    states = np.empty(rows + 1, np.uint8)
    states[0] = FRESH
    if rows <= _WIDTH:
        for i in range(rows):
            states[i + 1] = _APPLY[whole[i], states[i]]
        return states
    outer = _scan(whole)
    inner = np.full(len(outer) * _WIDTH, 0, np.uint16)
    inner[:rows] = whole
    grid = np.ascontiguousarray(inner.reshape(-1, _WIDTH).T)
    now, got = outer, np.empty(grid.shape, np.uint8)
    for j, column in enumerate(grid):
        now = _APPLY[column, now]
        got[j] = now
    states[1:] = got.T.ravel()[:rows]
    return states


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions of the code points at which pieces begin; every text begins one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = classes(points, firsts)
    functions = _PLAIN[kinds]
    functions[firsts] = _RESET[kinds[firsts]]
    states = _scan(functions)
    padded = np.zeros(len(states) * _WIDTH, np.uint8)
    padded[:n] = kinds
    fresh = np.zeros(len(padded), bool)
    fresh[firsts] = True
    grid, fresh = np.ascontiguousarray(padded.reshape(-1, _WIDTH).T), np.ascontiguousarray(fresh.reshape(-1, _WIDTH).T)
    begins, now = np.empty(grid.shape, bool), states
    for j, column in enumerate(grid):
        now = np.where(fresh[j], FRESH, now)
        begins[j] = _BEGINS[now, column]
        now = _NEXT[now, column]
    return np.flatnonzero(begins.T.ravel()[:n])


class PieceCache:
    """piece -> its ids as little-endian unsigned 32-bit integers, of a bounded number of pieces; the half that was filled earlier goes when it is full."""

    def __init__(self, ranks: dict[bytes, int], size: int = 1 << 17) -> None:
        self.ranks, self.size, self.new, self.old = ranks, size // 2, {}, {}
        self.merger = Merger(ranks)

    def __getitem__(self, pieces: list[bytes]) -> list[bytes]:
        ids = list(map(self.new.get, pieces))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            missing = list(dict.fromkeys(pieces[i] for i in holes))
            found = dict(zip(missing, map(self.old.get, missing), strict=True))
            unknown = [p for p, x in found.items() if x is None]
            found.update(zip(unknown, self.merger(unknown), strict=True))
            for i in holes:
                ids[i] = found[pieces[i]]
            if len(self.new) + len(found) > self.size:
                self.old, self.new = self.new, {}
            self.new.update((p, x) for p, x in found.items() if len(p) <= Merger.WIDEST)
        return ids


class Merger:
    """Pair merging of many pieces at once: in every round each piece merges its adjacent pair of the lowest rank, the leftmost first."""

    WIDEST = 64

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.none = np.int32(1 << 30)
        # open addressing, half full at most; slot of a pair: the top bits of its product with an odd number
        self.shift = np.uint64(64 - max(1, (4 * len(pairs)).bit_length()))
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.keys = np.full(1 << (64 - int(self.shift)), self.EMPTY, np.uint64)
        self.values = np.full(len(self.keys), self.none, np.int32)
        slots, left = self.slot(keys), np.arange(len(pairs))
        while len(left):
            free = left[self.keys[slots[left]] == self.EMPTY]
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = values[free]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) % len(self.keys)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    EMPTY = np.uint64((1 << 64) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of two ids; ``none`` where there is none or either is -1."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self.slot(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], self.none)
        probe = np.flatnonzero((there != keys) & (there != self.EMPTY))
        while len(probe):
            slots[probe] = (slots[probe] + 1) % len(self.keys)
            there = self.keys[slots[probe]]
            hit = there == keys[probe]
            out[probe[hit]] = self.values[slots[probe[hit]]]
            probe = probe[~hit & (there != self.EMPTY)]
        return out

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > self.WIDEST:
                out[i] = np.array(merged_long(piece, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            ids, sizes = self._merge([pieces[i] for i in rows], width)
            packed = ids.astype("<u4")
            for k, i in enumerate(rows):
                out[i] = packed[k, : sizes[k]].tobytes()
        return out

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < sizes[:, None], self.single[raw], -1)
        best = np.full((n, width + 1), self.none, np.int32)
        best[:, : width - 1] = self.rank(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
        done_ids, done_sizes, live = np.full((n, width), -1, np.int32), sizes.copy(), np.arange(n)
        while len(live):
            least = best.argmin(axis=1)
            rows = np.arange(len(live))
            rank = best[rows, least]
            over = rank >= self.none
            if over.any():
                done_ids[live[over]], done_sizes[live[over]] = ids[over, :width], sizes[over]
                ids, best, sizes, live, least, rank = ids[~over], best[~over], sizes[~over], live[~over], least[~over], rank[~over]
                rows = rows[: len(live)]
            # the pair becomes one id, what stands after it moves up
            after = np.arange(width) > least[:, None]
            np.copyto(ids[:, :width], ids[:, 1:].copy(), where=after)
            np.copyto(best[:, :width], best[:, 1:].copy(), where=after)
            ids[rows, least] = rank
            sizes = sizes - 1
            lefts = np.maximum(least - 1, 0)
            fresh = self.rank(np.concatenate([rank, ids[rows, lefts]]), np.concatenate([ids[rows, least + 1], rank]))
            best[rows, least] = fresh[: len(rows)]
            inner = least > 0
            best[rows[inner], lefts[inner]] = fresh[len(rows) :][inner]
        return done_ids, done_sizes


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging of one piece of any length, by a heap over a linked list."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (r := ranks.get(parts[a] + parts[right[a]])) is not None:
                heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[right[a]])))
    return [ranks[p] for p in parts if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as file:
        return _ranks(file.read())


def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


class Coder:
    """A vocabulary with what encoding and decoding look up."""

    def __init__(self, raw: bytes) -> None:
        ranks = _ranks(raw)
        self.cache = PieceCache(ranks)
        tokens = {rank: token for token, rank in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for rank, token in tokens.items():
            self.length[rank] = len(token)
        # all tokens' bytes in one array, in the order of ranks, and where each begins
        self.flat = np.frombuffer(b"".join(tokens.get(rank, b"") for rank in range(len(self.length))), np.uint8)
        self.begin = np.cumsum(self.length) - self.length

    def ends(self, ids: bytes) -> np.ndarray:
        """The byte at which each token ends; ValueError for an id that is none."""
        at = np.frombuffer(ids, "<u4")
        if len(at) and (int(at.max()) >= len(self.length) or not self.length[at].all()):
            raise ValueError("an id outside the vocabulary")
        return np.cumsum(self.length[at])

    def decode(self, ids: bytes, ends: np.ndarray | None = None) -> bytes:
        """The bytes of ids; each token's bytes go to the place that the offsets tell."""
        ends = self.ends(ids) if ends is None else ends
        if not len(ends):
            return b""
        at = np.frombuffer(ids, "<u4")
        sizes = np.diff(ends, prepend=0)
        if len(ends) != len(at) or (sizes != self.length[at]).any():
            raise ValueError("offsets of other ids")
        return self.flat[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes()

    def decode_span(self, ids: bytes, ends: np.ndarray, first: int, last: int) -> bytes:
        """The bytes of the tokens that hold the bytes ``first`` to ``last`` of the text; only those are decoded."""
        a, z = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left")) + 1
        return self.decode(ids[4 * a : 4 * z])


_latest: tuple[bytes, Coder] | None = None


def _coder(raw: bytes) -> Coder:
    """The coder of a vocabulary file; a worker keeps the one that it used last, with its cache."""
    global _latest
    if _latest is None or _latest[0] != raw:
        _latest = (raw, Coder(raw))
    return _latest[1]


def _shared(df: DataFrame, path: str):  # noqa: ANN202
    """The file, read by the driver; its size does not depend on the data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_column(column: pa.Array, cache: PieceCache) -> Iterator[bytes]:
    """The ids of every text, packed."""
    for _, data, offsets in chunks(column):
        raw = data.tobytes()
        try:
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            texts = [raw[a:z].decode(errors="replace").encode() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            raw = b"".join(texts)
            data, offsets = np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((data & 0xC0) != 0x80)
        firsts = np.unique(np.searchsorted(leads, offsets[:-1][np.diff(offsets) > 0]))
        starts = leads[piece_starts(points, firsts)]
        bounds = np.searchsorted(starts, offsets)
        places = [*starts.tolist(), len(raw)]
        ids = cache[[raw[a:z] for a, z in zip(places, places[1:], strict=False)]]
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield b"".join(ids[a:z])


def _renamed(df: DataFrame, left_out: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` without some columns and under names that nothing else has, and the names that it had."""
    kept = [c for c in df.columns if c not in left_out]
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]), kept


def encode(df: DataFrame, vocabulary: str, column: str = "text", decoded: bool = False, without_text: bool = False, pattern: str = PATTERN) -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``ends`` (the same form: the byte at which each token ends).

    Every match of the pattern is encoded separately; there are no special tokens. ``pattern``: the
    vocabulary's own; the automaton is of PATTERN, any other is refused. ``vocabulary``: path of a file
    of ranks, read by the driver and broadcast. decoded: the ids are decoded again by their offsets
    into ``decoded`` (binary), in the same pass. without_text: the text column is left out.

    A null or empty text gives empty ids. Bytes that are no UTF-8 count as U+FFFD. Very long texts are
    encoded whole. Repeated rows are encoded alike. An empty table gives no rows. Columns of ``df``
    named like a new one are replaced.
    """
    if pattern != PATTERN:
        raise ValueError("pre-tokenisation is built for another pattern")
    new = ["ids", "ends", *["decoded"] * decoded]
    inner, kept = _renamed(df, new)
    at = kept.index(column)
    out = [i for i, c in enumerate(kept) if c != column or not without_text]
    schema = inner.select(*[f"c{i}" for i in out]).withColumns({c: F.lit(b"") for c in new}).schema
    shared = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in (x for b in batches for x in portions(b, at, PORTION)):
            ids = list(encode_column(batch.column(at), coder.cache))
            ends = [coder.ends(x) for x in ids]
            made = [ids, [x.astype("<u4").tobytes() for x in ends], *[[coder.decode(x, e) for x, e in zip(ids, ends, strict=True)]] * decoded]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), *(pa.array(x, pa.binary()) for x in made)], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*[kept[i] for i in out], *new)


def decode(df: DataFrame, vocabulary: str, column: str = "ids", offsets: str | None = "ends") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of the packed ids in ``column``.

    offsets: the column with the bytes at which the tokens end, as ``encode`` makes it, if it is there;
    each token's bytes go to the place that they tell, and offsets of other ids fail. Null ids give
    null, ids outside the vocabulary fail. A column named decoded is replaced.
    """
    inner, kept = _renamed(df, ["decoded"])
    at, by = kept.index(column), kept.index(offsets) if offsets in kept else None
    schema = inner.withColumn("decoded", F.lit(b"")).schema
    shared = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in (x for b in batches for x in portions(b, at, PORTION)):
            ends = [None] * batch.num_rows if by is None else [None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(by).to_pylist()]
            out = [None if x is None else coder.decode(x, e) for x, e in zip(batch.column(at).to_pylist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*kept, "decoded")
