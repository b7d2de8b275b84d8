import math
import random

import pytest
from pyspark.sql import functions as F

from charta.llm import topk


def brute(rows, k, every):
    vecs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        vecs[i] = min(vecs.get(i, q), q)
    out = []
    for a in sorted(vecs):
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(vecs[a], vecs[b])), b) for b in vecs if b != a)[:k]
            out += [(a, r, b, -s) for r, (s, b) in enumerate(scored, 1)]
    return out


def run(spark, rows, k=5, every=3):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, slice int, block int")
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % every == 0, k).collect())


@pytest.mark.parametrize("parts, group, rows_", [(2, 4, 128), (4, 1, 5), (3, 2, 1000)])
def test_equals_brute_force(spark, monkeypatch, parts, group, rows_):
    for name, value in {"SLICE": 40, "BLOCK": 16, "PARTS": parts, "GROUP": group, "ROWS": rows_, "MOST": 7}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(10)]) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 10), (2003, [float("inf")] * 10), (None, [1.0]), (2004, []), (2005, [1.0, 2.0]), (0, rows[0][1]), (3, [9.0] * 10), (2006, [1e9] * 10)]
    assert run(spark, rows) == brute(rows, 5, 3)


def test_few_or_no_candidates(spark):
    assert run(spark, [(0, [1.0]), (3, [2.0])]) == [(0, 1, 3, 8192), (3, 1, 0, 8192)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_ties_go_to_the_smaller_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 10)
    rows = [(i, [1.0, -1.0, 0.5, 0.0] if i % 2 else [-1.0, 1.0, -0.5, 0.25]) for i in range(90)]
    assert run(spark, rows, k=7) == brute(rows, 7, 3)


def test_few_entries_leave_the_nodes(spark, monkeypatch):
    """The threshold works: of all entries of all parts a fraction is collected."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(1200)]
    seen = []
    written = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    assert run(spark, rows, k=5, every=100) == brute(rows, 5, 100)
    entries = next(df for name, df in seen if name == "entries").agg(F.sum("n")).first()[0]
    assert 0 < entries < 0.25 * 2 * 12 * 1200
