import re
from collections import Counter

from charta.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + d for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for d in range(5)}
    base = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(hit), base


def test_counts_equal_brute_force(docs_of):
    texts = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 40, "a b c d e f\na b c d e f\n\n\nz", "é🙂 b c d e é🙂 b c d e f g h i j k l m n", "# $ % & | < > * plain words", "w" * 50_000, " ".join(f"w{i % 97} v{i % 89}" for i in range(4000)), "a b c\x0bd"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(4, texts[4], "s"), (None, "x", None)]
    got = Q.judged(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        m = r["quality"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], r["base_failed"]) == brute(r["text"])
        assert r["kept"] == (not r["base_failed"] and not r["broken"])


def test_rules_name_what_is_broken(docs_of):
    good = "The quick brown fox and the lazy dog were in the garden with a small cat on a wall"
    rows = [(1, good, "s"), (2, " ".join(f"{w}***" for w in good.split()), "s"), (3, " ".join(f"{w.upper()}!!" for w in f"{good} {good[::-1]}".split()), "s"), (4, "\n".join(["alpha beta", "gamma delta"] * 6), "s")]
    got = {r["doc_id"]: r["broken"] for r in Q.judged(docs_of(rows)).collect()}
    assert got[1] == [] and "symbols to words" in got[2] and "exclamation marks to words" in got[3] and "repeated lines" in got[4]


def test_no_python_in_the_plan(docs_of):
    plan = Q.judged(docs_of([(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Q.judged(docs_of([])).collect() == []
