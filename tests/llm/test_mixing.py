import math
from collections import defaultdict

from pyspark.sql import functions as F

from charta.llm import mixing as M


def shape(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "src string, tokens long")


def test_exponent_keeps_the_repetition_limit(spark):
    a = M.exponent(shape(spark, [100, 1000, 10_000]), max_repeat=2.0)
    assert abs(100 ** (1 - a) - 2.0) < 1e-4
    assert M.exponent(shape(spark, [5, 5]), max_repeat=2.0) == 0.0
    assert M.exponent(shape(spark, []), max_repeat=2.0) in (0.0, 1.0)


def test_exponent_meets_the_entropy(spark):
    tokens = [10, 300, 5000]
    a = M.exponent(shape(spark, tokens), max_repeat=None, entropy=0.8)
    w = [t**a for t in tokens]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert abs(h - 0.8) < 1e-4
    assert M.exponent(shape(spark, tokens), max_repeat=None, entropy=9.0) == 0.0


def sums(out):
    whole, mixture = defaultdict(int), defaultdict(int)
    for r in out:
        whole[r["source"]] += r["tokens"]
        mixture[r["source"]] += r["tokens"] * r["copies"]
    return whole, mixture


def test_budgets_are_met_within_one_document(docs_of):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(600)] + [(1000 + i, "w " * (1 + i % 5), "small") for i in range(80)] + [(5000, None, "small"), (5001, "", None), (5002, "x y", None)]
    out = M.mixed(docs_of(rows), max_repeat=2.0, block=32).collect()
    assert len(out) == len(rows)
    whole, mixture = sums(out)
    assert mixture["big"] == whole["big"]
    weights = {r["source"]: r["weight"] for r in out if r["tokens"]}
    total = whole["big"] / weights["big"]
    for s in ("big", "small", None):
        assert 0 <= mixture[s] - round(weights[s] * total) < 10
    assert max(r["copies"] for r in out) <= 2 and min(r["copies"] for r in out) >= 1


def test_small_budget_takes_parts_of_one_epoch(docs_of):
    rows = [(i, "w w w", f"s{i % 2}") for i in range(200)]
    out = M.mixed(docs_of(rows), budget=150, block=8).collect()
    _, mixture = sums(out)
    assert mixture == {"s0": 75, "s1": 75}


def test_rows_are_realised_as_often_as_their_copies(docs_of):
    rows = [(i, f"w{i} " * 9, "a" if i else "b") for i in range(50)] + [(7, "w7 " * 9, "a")]
    docs = docs_of(rows)
    counts = defaultdict(int)
    for r in M.mixed(docs).collect():
        counts[r["doc_id"]] += r["copies"]
    out = M.realised(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert got == counts
    assert M.realised(docs_of([])).collect() == []


def brute(rows, alpha, budget, seed=0):
    """Weight, tokens and copies of (doc_id, source, text, mark, tie) in plain Python."""
    white = " \t\n\x0b\x0c\r"
    words = lambda t: len([w for w in (t or "").translate(str.maketrans(white, " " * 6)).split(" ") if w])
    by = defaultdict(list)
    for i, s, t, mark, tie in rows:
        by[s].append((mark, tie, i, words(t)))
    totals = {s: sum(r[3] for r in x) for s, x in by.items() if any(r[3] for r in x)}
    power = {s: t**alpha for s, t in totals.items()}
    scale = max(t / power[s] for s, t in totals.items()) if budget is None else budget / sum(power.values())
    out = []
    for s, x in by.items():
        epochs, rest = divmod(round(power[s] * scale), totals[s]) if s in totals else (1, 0)
        before = 0
        for _, _, i, n in sorted(x):
            out.append((i, s, n, round(power[s] / sum(power.values()), 9) if n else 0.0, epochs + (before < rest) if n else 1))
            before += n
    return sorted(out, key=str)


def marked(df, seed=0):
    return [tuple(r) for r in df.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), "doc_id", "text"), F.xxhash64("doc_id", F.lit(seed + 1))).collect()]


def test_query_equals_brute_force(spark):
    from charta.llm.queries import op5_source_mixing
    from tests.conftest import SF

    rows = marked(spark.read.parquet(f"{SF}/documents.parquet"))
    totals = defaultdict(int)
    for _, s, t, _, _ in rows:
        totals[s] += len(t.split())
    alpha = M.exponent(shape(spark, totals.values()), max_repeat=2.0)
    assert abs(alpha - max(0.0, 1 - math.log(2) / math.log(max(totals.values()) / min(totals.values())))) < 1e-6
    got = sorted(((r["doc_id"], r["source"], r["tokens"], r["weight"], r["copies"]) for r in op5_source_mixing(spark, SF).collect()), key=str)
    want = brute(rows, alpha, None)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, want))


def test_cut_within_a_block_equals_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 2)
    docs = docs_of([(i, "w " * (1 + i % 9), f"s{i % 3 if i % 5 else 0}") for i in range(400)])
    for budget, block in ((700, 16), (1999, 4), (9000, 512)):
        got = sorted(((r["doc_id"], r["source"], r["tokens"], round(r["weight"], 9), r["copies"]) for r in M.mixed(docs, max_repeat=3.0, budget=budget, block=block).collect()), key=str)
        alpha = M.exponent(docs.groupBy(F.col("source").alias("src")).agg(F.sum(M.word_count(F.col("text"))).alias("tokens")), 3.0)
        assert got == brute(marked(docs), alpha, budget)


def test_epochs_are_permuted_anew(docs_of):
    docs = docs_of([(i, "w w", "a") for i in range(300)] + [(1000 + i, "w w", "b") for i in range(120)])
    out = M.sequenced(docs, max_repeat=2.0, budget=3000, block=16)
    assert out.columns == [*docs.columns, "epoch", "block", "place"]
    rows = sorted((r["epoch"], r["block"], r["place"], r["doc_id"], r["source"]) for r in out.collect())
    order = lambda e: [r[3] for r in rows if r[0] == e]
    assert set(order(0)) == set(order(1)) and order(0) != order(1) and len({r[0] for r in rows}) > 2
    # a block's documents stand together, and blocks of both sources alternate
    blocks = [r[1] for r in rows if r[0] == 0]
    assert len(set(blocks)) == 1 + sum(a != b for a, b in zip(blocks, blocks[1:])) > 10
    sources = [r[4] for r in rows if r[0] == 0]
    assert sum(a != b for a, b in zip(sources, sources[1:])) > 3


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(i, "a b", "s", 7, 8, 9, 10) for i in range(9)], "doc_id long, text string, source string, tokens int, copies int, `a.b` int, epoch int")
    out = M.realised(docs)
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {(7, 8, 9, 10)}
