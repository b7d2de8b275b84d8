"""Queries against their SQL, and those without SQL against brute force."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from charta.llm import queries as q
from tests.conftest import SF

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same):
    same(q.queries()[name], SQL[name])


def test_tokens_equal_the_library(spark, duck):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in q.op8_byte_bpe(spark, SF).collect()}
    for doc_id, text in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = coder.encode_ordinary(text)
        assert got.pop(doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_held_out_accuracy(spark, duck):
    sf = SF.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in q.op9_quality_classifier(spark, sf).collect()}
    labels = duck.execute(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_mixing_of_the_whole_table(spark, duck):
    rows = q.op5_source_mixing(spark, SF).collect()
    assert len(rows) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    want = dict(duck.execute(r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) FROM documents").fetchall())
    assert {r["doc_id"]: r["tokens"] for r in rows} == want
    assert {r["copies"] for r in rows} <= {1, 2}
