import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from charta.llm import classifier as C

WORDS = "the and of river stone light under green often moves along quiet paths where birds rest".split()


def corpus(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        good = i % 4 > 0
        text = " ".join(rng.choice(WORDS) for _ in range(40)) + "." if good else " ".join(rng.choice(WORDS) + rng.choice(["***", "$$$", "%%%"]) for _ in range(40))
        rows.append((i, text, int(good)))
    return rows


def test_scores_separate_held_out_texts(spark, docs_of):
    rows = corpus(400)
    docs = docs_of([(i, t, "s") for i, t, _ in rows] + [(9000, None, "s"), (9001, "", None), (9002, "x" * 200_000, "s"), (0, rows[0][1], "s"), (None, rows[1][1], "s")])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 3] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = C.score(docs.withColumn("score", F.lit("old")), C.train(docs, labels)).collect()
    assert len(out) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    truth = {i: y for i, _, y in rows}
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    kept = C.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _, y in rows if y}


def test_labels_of_the_held_out_fifth_do_not_count(spark, docs_of):
    rows = corpus(100)
    docs = docs_of([(i, t, "s") for i, t, _ in rows])
    seen = [(i, y) for i, _, y in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in seen]
    a, b = (C.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (seen, flipped))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.labels, b.labels)


def plain_scores(model, texts):
    """Votes in plain Python: exact products of whole numbers, ties to the first sampled text."""
    terms = C.term_counts(pa.array(texts, pa.string()))
    mine, some = model.project(terms), terms.some()
    sample = [[int(x) for x in u] for u in model.vectors]
    out = []
    for v, has in zip(mine, some):
        v = [int(x) for x in v]
        near = sorted(((-sum(a * b for a, b in zip(v, u)), j) for j, u in enumerate(sample)))[: C.NEIGHBOURS]
        w = [max(-s / 4.0**C.GRID, 0) ** C.POWER for s, _ in near]
        out.append(sum(a * model.labels[j] for a, (_, j) in zip(w, near)) / sum(w) if has and sum(w) else model.prior)
    return out


def test_votes_equal_brute_force():
    rows = corpus(60)
    texts = [t for _, t, _ in rows]
    model = C.fit(C.term_counts(pa.array(texts[:40] + texts[:3])), np.array([y for _, _, y in rows[:40]] + [1 - y for _, _, y in rows[:3]]))
    for block in (7, 256):
        assert np.allclose(model.scores(C.term_counts(pa.array(texts)), block=block), plain_scores(model, texts), atol=1e-12)


def test_query_equals_brute_force(spark):
    from charta.llm.queries import op9_quality_classifier
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = C.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: s for r, s in zip(rows, plain_scores(model, [r["text"] for r in rows]))}
    got = op9_quality_classifier(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-12 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_sparse_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(1)
    counts = [0, 3, 0, 5, 1, 0, 9, 2, 0]
    ends = np.concatenate([[0], np.cumsum(counts)])
    at, values, dense = rng.integers(0, 6, ends[-1]), rng.random(ends[-1]), rng.random((6, 4))
    full = np.zeros((len(counts), 6))
    np.add.at(full, (np.repeat(np.arange(len(counts)), counts), at), values)
    for most in (1, 4, 1000):
        monkeypatch.setattr(C, "ENTRIES", most)
        assert np.allclose(C._times(ends, at, values, dense), full @ dense)


def test_equal_texts_have_equal_scores_and_columns_stay(spark):
    rows = corpus(200)
    texts = [t for _, t, _ in rows]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, texts[i % 7], "own", 5, 0.5) for i in range(200)], "doc_id long, text string, `a.b` string, predicted int, score double")
    train = C.train(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), labels)
    scores = {}
    for r in C.score(docs.repartition(5), train).collect():
        scores.setdefault(r["text"], set()).add(r["score"])
    assert len(scores) == 7 and all(len(x) == 1 for x in scores.values())
    kept = C.accepted(docs, labels)
    assert kept.columns == docs.columns and {(r["a.b"], r["predicted"], r["score"]) for r in kept.collect()} == {("own", 5, 0.5)}


def test_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"a \xff b"), (2, b"good words")], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text")
    model = C.fit(C.term_counts(pa.array(["good words", "*** $$$"])), np.array([1.0, 0.0]))
    assert len(C.score(docs, model).collect()) == 2


def test_no_labels_and_no_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = C.train(docs_of([(1, "a b", "s")]), none)
    assert [r["score"] for r in C.score(docs_of([(1, "a b", "s")]), model).collect()] == [1.0]
    assert C.score(docs_of([]), model).collect() == []
