from collections import Counter

from charta.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, least):
    key = lambda x: x.strip(WHITE).translate(FOLD)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        dropped = [len(key(x)) >= least and seen[key(x)] >= min_docs for x in lines]
        out.append((i, len(lines), sum(dropped), "\n".join(x for x, d in zip(lines, dropped) if not d)))
    return sorted(out, key=str)


def run(docs, **settings):
    return sorted(((r["doc_id"], len(r["lines"]), sum(r["dropped"]), r["kept"]) for r in L.without_frequent_lines(docs, **settings).collect()), key=str)


def test_equals_brute_force_with_odd_rows(docs_of):
    rows = [(i, f"Same line \n own {i}\n\tSAME LINE\x0b\nÉ{i % 2}\n", "s") for i in range(6)]
    rows += [(10, None, None), (11, "", "s"), (12, "\n\n", "s"), (None, "same line\nx", "s"), (0, "Same line \n own 0\n\tSAME LINE\x0b\nÉ0\n", "s"), (13, "é0\nÉ0", "s"), (14, "x" * 100_000 + "\n" + "same line\n" * 3000, "s")]
    for min_docs in (2, 3, 7):
        assert run(docs_of(rows), min_docs=min_docs) == brute([r[:2] for r in rows], min_docs, 1)


def test_short_keys_and_one_document(docs_of):
    rows = [(i, "ab\nabc\n \n", "s") for i in range(3)]
    assert run(docs_of(rows), min_docs=3, least_length=3) == brute([r[:2] for r in rows], 3, 3)
    assert run(docs_of(rows), min_docs=1, batches=1, fan_in=3) == brute([r[:2] for r in rows], 1, 1)


def test_runs_are_compacted_and_known_lines_are_left_out(spark):
    store = L.LineRuns(spark, min_docs=2, fan_in=2, buckets=2)
    for batch in (["a", "a", "b"], ["a", "b", "c"], ["c"], ["a", "d"]):
        store.add(spark.createDataFrame([(x.encode(),) for x in batch], "hash binary"))
    assert [len(level) for level in store.levels] == [0, 0, 1]
    got = {bytes(r["hash"]): r["n"] for r in store.compact().collect()}
    assert got[b"a"] >= 2 and got[b"b"] == 2 and got[b"c"] == 2 and got[b"d"] == 1


def test_empty_table_and_columns(docs_of):
    assert run(docs_of([])) == []
    docs = docs_of([(1, "a\nb", "s"), (2, None, "s")])
    out = L.cleaned(docs, min_docs=1)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: ("", 0), 2: (None, None)}


def test_a_text_of_very_many_lines(docs_of):
    rows = [(1, "\n".join(f"line {i}" for i in range(200_000)), "s"), (2, "line 7\nline 199999\nmine", "s")]
    assert run(docs_of(rows), min_docs=2) == brute([r[:2] for r in rows], 2, 1)


def test_joins_by_shuffle_give_the_same(docs_of, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "BUCKET_LINES", 3)
    rows = [(i, f"a\nb {i % 3}\nc {i}\na", "s") for i in range(20)]
    assert run(docs_of(rows), min_docs=7) == brute([r[:2] for r in rows], 7, 1)


def test_own_columns_stay_and_no_table_is_left(spark):
    docs = spark.createDataFrame([(i, "same\nown %d" % i, "l", "d", "k", 3) for i in range(12)], "doc_id long, text string, lines string, dropped string, kept string, `a.b` int")
    before = {t.name for t in spark.catalog.listTables()}
    out = L.cleaned(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(i, f"own {i}", "l", "d", "k", 3) for i in range(12)]
    assert L.without_frequent_lines(docs).columns == ["doc_id", "text", "a.b", "lines", "dropped", "kept"]
    assert {t.name for t in spark.catalog.listTables()} == before
