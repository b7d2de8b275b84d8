"""Quality by nearest-neighbour voting over latent-semantic vectors.

Fit: a bounded sample of labelled texts gives a term-document matrix; its leading singular vectors
map any text to a short unit vector. Score: exact cosine products of every text with all sampled
vectors, in blocks; the nearest neighbours vote, weighted by similarity. Components of the unit
vectors are multiples of 2**-GRID, so products are exact: equal texts have equal scores wherever they
stand, and of equally near sampled texts the first ones vote.

Terms of a text are its words, dealt by fingerprint into BUCKETS, in a sparse matrix. Beside them
stand pairs of neighbouring byte classes (kind of letter, sign, digit, space) and relations between
words: equal to the word before, to one of the four before that, to any before, a four-word run seen
before. They come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charta.llm.wordhash import chunks, portions, shingle_hashes, word_hashes, word_spans

#: Limits that do not depend on the data: labelled rows that a fit takes, length of vectors, voters.
SAMPLE, RANK, NEIGHBOURS, POWER, THRESHOLD = 4000, 32, 15, 8.0, 0.3
BUCKETS, RELATIONS, GRID = 1 << 14, 5, 12
#: Texts that are compared with the sample at once, bytes of text that are counted at once, entries of a sparse matrix that are multiplied at once.
ROWS, BYTES, ENTRIES = 256, 2 << 20, 1 << 16


def _byte_classes() -> tuple[np.ndarray, int]:
    kinds = np.full(256, 10, np.uint8)
    for k, members in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOUBCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"#*$%&<>", b"|")):
        kinds[list(members)] = k
    kinds[0x80:0xC0], kinds[0xC0:] = 11, 12
    return kinds, 13


_KINDS, _N = _byte_classes()
EXTRA = _N * _N + RELATIONS


@dataclass
class Terms:
    """Of each text the buckets of its words with their shares of its words (text i: ends[i] to ends[i + 1]), and a row of shares of byte pairs and relations."""

    ends: np.ndarray
    buckets: np.ndarray
    shares: np.ndarray
    extra: np.ndarray

    def __len__(self) -> int:
        return len(self.extra)

    def some(self) -> np.ndarray:
        """Texts that have any term."""
        return (np.diff(self.ends) > 0) | self.extra.any(axis=1)


def term_counts(column: pa.Array) -> Terms:
    sizes, buckets, shares = np.zeros(len(column), np.int64), [], []
    extra = np.zeros((len(column), EXTRA), np.float32)
    for row, data, offsets in chunks(column):
        kinds = _KINDS[data].astype(np.int64)
        pairs = kinds[:-1] * _N + kinds[1:] if len(kinds) else kinds
        starts, ends, before = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        grams = shingle_hashes(words, 4)
        # text and bucket as one number; equal ones counted
        owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(before))
        found, counts = np.unique(owner * BUCKETS + (words >> np.uint64(50)).astype(np.int64), return_counts=True)
        texts = found // BUCKETS
        buckets.append((found % BUCKETS).astype(np.int32))
        shares.append((counts / np.diff(before)[texts]).astype(np.float32))
        sizes[row : row + len(offsets) - 1] = np.bincount(texts, minlength=len(offsets) - 1)
        for i in range(len(offsets) - 1):
            a, z = int(offsets[i]), int(offsets[i + 1])
            if z - a > 1:
                extra[row + i, : _N * _N] = np.bincount(pairs[a : z - 1], minlength=_N * _N)[: _N * _N] / (z - a - 1)
            a, z = int(before[i]), int(before[i + 1])
            if z == a:
                continue
            w, n = words[a:z], z - a
            relations = np.zeros(RELATIONS)
            relations[0] = np.count_nonzero(w[1:] == w[:-1])
            near = np.zeros(n, bool)
            for d in range(2, 6):
                near[d:] |= w[d:] == w[:-d]
            relations[1] = np.count_nonzero(near)
            relations[2] = n - len(np.unique(w))
            if n > 4:
                relations[3] = (n - 3) - len(np.unique(grams[a : z - 3]))
            relations[4] = 1.0
            extra[row + i, _N * _N :] = relations / n
    empty = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    return Terms(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(buckets or empty[0]), np.concatenate(shares or empty[1]), extra)


def _times(ends: np.ndarray, at: np.ndarray, values: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """A sparse matrix (row i: entries ends[i] to ends[i + 1], in columns ``at``) times a dense one, whole rows of about ENTRIES entries at a time."""
    out = np.zeros((len(ends) - 1, dense.shape[1]), dense.dtype)
    full = np.flatnonzero(np.diff(ends))
    firsts = ends[full]
    a = 0
    while a < len(full):
        z = max(a + 1, int(np.searchsorted(firsts, firsts[a] + ENTRIES, "right")) - 1) if firsts[-1] > firsts[a] + ENTRIES else len(full)
        lo, hi = int(firsts[a]), int(ends[full[z - 1] + 1])
        out[full[a:z]] = np.add.reduceat(dense[at[lo:hi]] * values[lo:hi, None], firsts[a:z] - lo, axis=0)
        a = z
    return out


@dataclass
class Model:
    """What is broadcast: at most 2 x SAMPLE x RANK numbers, (BUCKETS + EXTRA) x RANK and two rows of as many, whatever the corpus."""

    weights: np.ndarray
    extra_weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, terms: Terms) -> np.ndarray:
        """Unit vectors on the grid."""
        x = _times(terms.ends, terms.buckets, np.sqrt(terms.shares) * self.weights[terms.buckets], self.basis[:BUCKETS])
        x += (np.sqrt(terms.extra) * self.extra_weights) @ self.basis[BUCKETS:]
        return np.rint(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) * (1 << GRID))

    def scores(self, terms: Terms, block: int = ROWS) -> np.ndarray:
        """Share of label 1 among the nearest sampled texts, weighted by similarity; the prior for texts without terms or with no sample."""
        out = np.full(len(terms), self.prior)
        if not len(self.labels) or not len(terms):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        own, some = self.project(terms), terms.some()
        for a in range(0, len(terms), block):
            near = own[a : a + block] @ self.vectors.T
            least = np.partition(near, near.shape[1] - k, axis=1)[:, -k, None]
            votes, level = near > least, near == least
            # of those as near as the last voter the first ones vote
            votes |= level & (np.cumsum(level, axis=1) <= k - votes.sum(axis=1, keepdims=True))
            rows, voters = np.nonzero(votes)
            weight = np.maximum(near[rows, voters] / float(1 << 2 * GRID), 0) ** POWER
            total = np.bincount(rows, weight, minlength=len(near))
            vote = np.bincount(rows, weight * self.labels[voters], minlength=len(near)) / np.maximum(total, 1e-30)
            told = (total > 0) & some[a : a + block]
            out[a : a + block][told] = vote[told]
        return np.clip(out, 0.0, 1.0)


def fit(terms: Terms, labels: np.ndarray) -> Model:
    """Term weights from the sample's document frequencies, then the leading singular vectors, by subspace iteration from a fixed start."""
    labels, n = np.asarray(labels, float), len(terms)
    if not n:
        return Model(np.ones(BUCKETS), np.ones(EXTRA), np.zeros((BUCKETS + EXTRA, RANK)), np.zeros((0, RANK)), labels, 1.0)
    rarity = lambda df: 1.0 + np.log((1.0 + n) / (1.0 + df))
    weights = rarity(np.bincount(terms.buckets, minlength=BUCKETS))
    extra_weights = rarity(np.count_nonzero(terms.extra, axis=0))
    extra_weights[_N * _N :] *= 2.0
    values, extra = ((np.sqrt(x) * w).astype(np.float32) for x, w in ((terms.shares, weights[terms.buckets]), (terms.extra, extra_weights)))
    by = np.argsort(terms.buckets, kind="stable")
    owners = np.repeat(np.arange(n), np.diff(terms.ends))[by]
    column_ends = np.concatenate([[0], np.cumsum(np.bincount(terms.buckets, minlength=BUCKETS))])
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((BUCKETS + EXTRA, RANK + 8), np.float32))[0]
    for _ in range(3):
        y = _times(terms.ends, terms.buckets, values, q[:BUCKETS]) + extra @ q[BUCKETS:]
        q = np.linalg.qr(np.concatenate([_times(column_ends, owners, values[by], y), extra.T @ y]))[0]
    y = _times(terms.ends, terms.buckets, values, q[:BUCKETS]) + extra @ q[BUCKETS:]
    basis = (q @ np.linalg.svd(y, full_matrices=False)[2][:RANK].T).astype(np.float64)
    if basis.shape[1] < RANK:
        basis = np.concatenate([basis, np.zeros((len(basis), RANK - basis.shape[1]))], axis=1)
    model = Model(weights, extra_weights, basis, np.zeros((0, RANK)), labels, float(labels.mean()))
    model.vectors = model.project(terms)
    return model


def in_fold_zero(doc_id: Column) -> Column:
    """Rows that the fit never sees: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for b in batches for x in portions(b, 0, BYTES)):
        terms = term_counts(batch.column(0))
        spans = list(zip(terms.ends[:-1].tolist(), terms.ends[1:].tolist(), strict=True))
        parts = [terms.buckets[a:z].astype(np.uint16).tobytes() for a, z in spans], [terms.shares[a:z].tobytes() for a, z in spans], [x.tobytes() for x in terms.extra]
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x, pa.binary()) for x in parts)], names=["label", "buckets", "shares", "extra"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows, those with the least hash of doc_id outside the held-out fifth.

    labels: doc_id, quality. A doc_id with several labels counts as 1 if their mean is 0.5 or more;
    null labels and ids are left out, and so are labels of documents that are not there. Only terms of
    the sample come to the driver: at most 2 x ``sample`` rows, each with as many words as its text
    has, BUCKETS at most. No labels or no documents: a model without a sample, whose every score is 1.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .filter(~in_fold_zero(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "__id").select("text", "__label").mapInArrow(_counts, "label int, buckets binary, shares binary, extra binary")
    rows = found.orderBy("buckets", "shares", "extra", "label").limit(2 * sample).collect()
    parts = [[np.frombuffer(r[name], kind) for r in rows] for name, kind in (("buckets", np.uint16), ("shares", np.float32), ("extra", np.float32))]
    if not rows:
        return fit(Terms(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((0, EXTRA), np.float32)), np.zeros(0))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts[0]])])
    return fit(Terms(ends, np.concatenate(parts[0]).astype(np.int32), np.concatenate(parts[1]), np.stack(parts[2])), np.array([r["label"] for r in rows], float))


def _scored(docs: DataFrame, model: Model, names: tuple[str, str]) -> DataFrame:
    """``docs`` with two more columns, named so that no other has their names; the text alone goes through Python."""
    at = docs.columns.index("text")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in portions(b, at, BYTES)):
            scores = shared.value.scores(term_counts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    out = inner.mapInArrow(run, inner.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
    return out.toDF(*docs.columns, *names)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int, 1 from THRESHOLD on); columns of these names are replaced.

    Null and empty texts get the share of label 1 in the sample. The score depends on the text alone:
    equal texts have equal scores, repeated rows too. Very long texts are counted whole. Of sampled
    texts that are equally near the first in the order of their terms vote. An empty table gives no
    rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return _scored(docs.select(*[F.col(f"`{c}`") for c in kept]), model, ("score", "predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a model of ``labels`` predicts as 1, with the columns of ``docs`` as they are, whatever their names."""
    taken = set(docs.columns)
    names = tuple(next(f"__{n}{i}" for i in range(len(taken) + 1) if f"__{n}{i}" not in taken) for n in ("score", "predicted"))
    return _scored(docs, train(docs, labels), names).filter(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
