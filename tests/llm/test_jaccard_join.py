import random
import re

import numpy as np
import pytest

from charta.llm import jaccard_join as J
from charta.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(rows[a][0]), root(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(30))
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 20, 60, 150]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words) + (f"\n{boiler}" if rng.random() < 0.4 else "")))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One Two"), (n + 4, "one two"), (n + 5, "one"), (None, rows[0][1]), (0, rows[0][1]), (n + 6, " ".join(f"v{j}" for j in range(6000))), (n + 7, " ".join(f"V{j}" for j in range(5990)))]
    return rows


# every constant shrunk: several buckets, blocks of first trees, pairs of blocks, leaves, joins by shuffle
SMALL = {"MARGIN": 2, "BUCKET": 500, "BLOCK": 400, "PER_SET": 8, "LEAF": 3, "BROADCAST_ROWS": 0}


@pytest.mark.parametrize("k, percent, constants", [(4, 85, {}), (4, 85, {"BLOCK": 400, "PER_SET": 0}), (3, 80, SMALL)])
def test_equals_brute_force(docs_of, monkeypatch, k, percent, constants):
    for name, value in constants.items():
        monkeypatch.setattr(J, name, value)
    rows = corpus(120, k)
    found, links = J.similar(docs_of([(i, t, "s") for i, t in rows]), k, percent)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, k, percent)
    for r in links.collect():
        assert 100 * r["shared"] >= percent * r["united"]


def test_second_trees_alone_find_all_links(docs_of, monkeypatch):
    """Without the first trees every link comes from the lists, long ones as pairs of blocks."""
    monkeypatch.setattr(J, "BLOCK", 2000)
    monkeypatch.setattr(J, "_first_links", lambda sets, lists, percent: (sets.selectExpr("row a", "row b", "n shared", "n united").limit(0), sets.selectExpr("row", "row label").limit(0)))
    rows = corpus(100, 9)
    assert sorted((tuple(r) for r in J.similar(docs_of([(i, t, "s") for i, t in rows]), 4, 85)[0].collect()), key=str) == brute(rows, 4, 85)


def test_a_hot_group_of_near_copies_is_one_component(docs_of, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 12_000)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if j != i % 97 else f"x{i}" for j, w in enumerate(base))) for i in range(150)] + [(200 + i, " ".join(f"v{rng.randrange(9**9)}" for _ in range(50))) for i in range(60)]
    assert sorted((tuple(r) for r in J.similar(docs_of([(i, t, "s") for i, t in rows]), 4, 85)[0].collect()), key=str) == brute(rows, 4, 85)


def test_dual_traversal_finds_all_pairs_and_prunes():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 120, replace=False) if i % 3 else base[:120], rng.integers(0, 1 << 63, rng.integers(0, 30), dtype=np.uint64)])) for i in range(230)]
    n = np.array([len(s) for s in sets])
    bits = [np.frombuffer(J.bitmap(s), np.uint64) for s in sets]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * (c := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (n[a] + n[b] - c)}
    pair = lambda i, j: [(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())]
    got = [x for i, j in J.candidates(n, bits, np.arange(len(sets)), np.zeros(len(sets), int), 85) for x in pair(i, j)]
    assert want and want <= set(got) and len(got) == len(set(got)) < 230 * 229 // 4
    side = np.arange(len(sets)) % 2
    got = [x for i, j in J.candidates(n, bits, np.arange(len(sets)), side, 85) for x in pair(i, j)]
    assert {x for x in want if side[x[0]] != side[x[1]]} <= set(got) and all(side[a] != side[b] for a, b in got)
    assert not list(J.candidates(n, bits, np.zeros(len(sets), int), side, 85))


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    monkeypatch.setattr("charta.llm.components.BROADCAST_EDGES", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_group_stays(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([(3, text, "s"), (2, text + " end", "s"), (9, "other words here now then", "s"), (8, None, "s"), (None, text, "s")])
    out = J.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "8", "9", "None"]
    assert J.deduplicated(docs_of([])).collect() == []
