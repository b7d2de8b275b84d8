"""The pipeline against plain Python versions of its stages, each on its own input."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline as P
from charta.llm.workdir import written
from tests.conftest import SF
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as lines


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "_")))
    return out


def test_all_but_the_last_return_documents(stages):
    assert [name for name, _ in P.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "source mixing", "byte-level BPE"]
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_bad_documents_go_and_good_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    known = [(i, y) for i, y in labels.items()]
    assert sum((i in kept) == bool(y) for i, y in known) / len(known) > 0.97


def test_shared_lines_go(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in stages[2].collect()) == sorted((i, t, len(t)) for i, _, _, t in lines(before, 10, 1))


def test_one_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted({i for i, _, c in groups(before, 5, 80) if i == c})


def test_the_mixture_has_every_document_once_or_twice(stages):
    before = {r["doc_id"] for r in stages[3].collect()}
    counts = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(counts) == before and set(counts.values()) <= {1, 2}


def test_tokens_are_the_library_s(stages):
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], hashlib.sha256(np.array(coder.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest()) for r in stages[4].collect())
    assert Counter((r["doc_id"], hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in stages[5].collect()) == want


def through(spark, docs):
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "_"))
    return docs


def test_an_empty_table_stays_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    out = through(spark, docs)
    assert out.collect() == [] and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]


def test_odd_rows_go_through(spark):
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    rows = [(i, t, "en", "s" if i % 3 else None, len(t), 1) for i, t in enumerate(good)]
    rows += [(100, None, None, None, None, 1), (101, "", "en", "s", 0, 1), (102, " \n\t", "en", None, 3, 1), (None, good[0], "en", "s", 5, 1), (3, good[3], "en", "s", 5, 1), (103, "word " * 60_000, "en", "s", 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens int").withColumnRenamed("tokens", "a.b")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), name.replace(" ", "_"))
        assert kept.columns == docs.columns
    out = P.tokens(spark, kept, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"]: r["n_tokens"] for r in out if r["decoded_sha256"] == empty}.items() >= {100: 0, 101: 0}.items()
    assert len({r["doc_id"] for r in out}) > 10
