"""Operators over the whole of their inputs, against brute force."""

import re

import duckdb

from charta.functions import text as T
from charta.operators import lexical, provenance
from charta.plans import queries as plans
from tests.conftest import SF


def column(table, name):
    return [r[0] for r in duckdb.sql(f"SELECT {name} FROM '{SF}/{table}.parquet'").fetchall()]


def words_of(table):
    """Lower-cased runs of letters."""
    return {w for t in column(table, "text") for w in re.findall(r"[^\W\d_]+", (t or "").lower())}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def begins(text, item):
    """Lines in which an occurrence of ``item`` begins."""
    return {text.count("\n", 0, i) + 1 for i in range(len(text) - len(item) + 1) if text.startswith(item, i)}


def test_items_are_cited_across_lines_and_signs(spark):
    texts = ["zero\n«one two three\nfour five six seven» end", "a\na\na b", "(one, two)\nx é.é y", "", None, "one two three four five six seven", "q \\E+ (r\\E+ s t u"]
    items = ["one two three\nfour five six seven", "a\na", "one, two", ".é", "", None, "one two three four", "two three\nfour five si", "absent words here", "\n", "\\E+ (r\\E+ s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(tuple(r) for r in provenance.cited(docs, asked).collect())
    assert got == sorted((j, i, n) for i, t in enumerate(texts) for j, x in enumerate(items) if t and x for n in begins(t, x))
    assert provenance.cited(docs, asked.limit(0)).collect() == [] == provenance.cited(docs.limit(0), asked).collect()


def test_passage_cite_and_negative_coverage_search_whole_texts(spark):
    docs = list(zip(column("documents", "doc_id"), column("documents", "text")))
    want = {(j, i, n) for i, t in docs for j, x in zip(column("benchmark", "item_id"), column("benchmark", "text")) if t and x and x in t for n in begins(t, x)}
    assert any("\n" in x for j, _, _ in want for k, x in zip(column("benchmark", "item_id"), column("benchmark", "text")) if j == k)
    assert {tuple(r) for r in plans.queries()["passage_cite"](spark, SF).collect()} == want
    assert {r["doc_id"] for r in plans.queries()["negative_coverage"](spark, SF).collect()} == {i for i, _ in docs} - {i for _, i, _ in want}


def one_edit(word, signs):
    """Every string one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in signs} | {a + c + b for a, b in cuts for c in signs}


def test_suggestions_for_accented_and_short_words_and_first_letters(spark):
    terms = ["élève", "xolonel", "ab", "größe", "zzzz", "lonel", "é"]
    known = ["eleve", "élèves", "colonel", "ac", "cb", "grösse", "grösße", "a"]
    asked, entries = (spark.createDataFrame([(w,) for w in x], "term string") for x in (terms, known))
    want = {t: min((distance(t, e), e) for e in known if distance(t, e) <= 1) for t in terms if any(distance(t, e) <= 1 for e in known)}
    assert {r["term"]: (r["distance"], r["suggestion"]) for r in lexical.corrections(asked, entries).collect()} == want


def test_spelling_suggestions_looks_at_every_unknown_word(spark):
    known = words_of("benchmark")
    signs = {c for w in known for c in w}
    want = {}
    for term in words_of("documents") - known:
        if near := one_edit(term, signs) & known:
            want[term] = (min(near), 1)
    assert any(not re.fullmatch("[a-z]{5,}", t) for t in want) and any(t[0] != s[0] for t, (s, _) in want.items())
    assert {r["term"]: (r["suggestion"], r["distance"]) for r in plans.queries()["spelling_suggestions"](spark, SF).collect()} == want


def test_fuzzy_match_compares_every_word(spark):
    words = sorted(words_of("benchmark"))
    want = {(a, b, d) for a in words for b in words if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    assert any(not re.fullmatch("[a-z]{4,}", a) for a, _, _ in want)
    assert {tuple(r) for r in plans.queries()["fuzzy_match"](spark, SF).collect()} == want


def test_doc_path_takes_the_first_line(spark):
    fold = str.maketrans(T.ACCENTED, T.PLAIN)
    want = {}
    for i, text, source, lang in zip(*(column("documents", c) for c in ("doc_id", "text", "source", "lang"))):
        name = re.sub("[^a-z0-9]+", "_", text.split("\n")[0].lower().translate(fold).replace("ß", "ss")).strip("_")
        want[i] = f"sources/{source}/{name}_{source}_{i:06d}_{lang}.md"
    assert {r["doc_id"]: r["path"] for r in plans.queries()["doc_path"](spark, SF).collect()} == want


def test_entity_gazetteer_covers_all_mentions(spark):
    assert plans.queries()["entity_gazetteer"](spark, SF).filter("entity_type IS NULL").count() == 0
