import base64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from charta.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


CACHE = bpe.PieceCache(RANKS, 256)


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_column(pa.array(texts, pa.string()), CACHE)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abst'rvel dm\n\t 19.,!é漢  ²½🙂\r\x85") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
def test_equals_the_library(coder, texts):
    assert ids_of(texts) == [coder.encode_ordinary(t) for t in texts]


def test_scan_over_many_blocks(coder):
    long = "it's  we'll 'sx ''re \n\n a1b2  " * 9000
    assert ids_of([long, "", "x" * 5000, long[7:]]) == [coder.encode_ordinary(t) for t in (long, "", "x" * 5000, long[7:])]


def test_merging_of_long_and_short_pieces_agrees():
    pieces = [b"abcdefgh" * 4, "é漢字".encode() * 3, b"\x80\xff\x00" * 8, b"zzzz"]
    batch = bpe.Merger(RANKS)(pieces)
    assert [np.frombuffer(x, "<u4").tolist() for x in batch] == [[RANKS[p]] if p in RANKS else bpe.merged_long(p, RANKS) for p in pieces]


def test_round_trip_offsets_and_odd_rows(docs_of):
    rows = [(1, "Hello wörld", "s"), (2, None, None), (3, "", "s"), (1, "Hello wörld", "s"), (None, " a\n", "s")]
    docs = docs_of(rows).withColumnRenamed("n", "ids").withColumnRenamed("key", "decoded")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in out) == sorted((t or "").encode() for _, t, _ in rows)
    for r in out:
        ends = np.frombuffer(r["ends"], "<u4").tolist()
        assert len(ends) == len(r["ids"]) // 4 and (not ends or ends[-1] == len((r["text"] or "").encode()))
    once = bpe.encode(docs, PATH, decoded=True, without_text=True)
    assert "text" not in once.columns and sorted(bytes(r["decoded"]) for r in once.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(docs_of([]), PATH).collect() == []


def test_vocabulary_file_is_base64_and_rank():
    token, rank = open(PATH, "rb").readline().split()
    assert RANKS[base64.b64decode(token)] == int(rank)


def test_other_patterns_are_refused(docs_of):
    assert bpe.PATTERN == public_tokenizers.PATTERN
    with pytest.raises(ValueError):
        bpe.encode(docs_of([]), PATH, pattern=r"\S+|\s+")


def test_decoding_by_offsets():
    coder = bpe._coder(open(PATH, "rb").read())
    text = "Größe and  naïve 🙂 words\n" * 50
    raw = text.encode()
    (ids,) = bpe.encode_column(pa.array([text]), coder.cache)
    ends = coder.ends(ids)
    assert coder.decode(ids) == coder.decode(ids, ends) == raw and ends[-1] == len(raw)
    for a, z in ((0, 1), (5, 40), (100, 101), (len(raw) - 3, len(raw))):
        assert raw[a:z] in coder.decode_span(ids, ends, a, z) and len(coder.decode_span(ids, ends, a, z)) < z - a + 40
    with pytest.raises(ValueError):
        coder.decode(ids, ends + 1)
    with pytest.raises(ValueError):
        coder.ends(np.array([60_000], "<u4").tobytes())


def test_own_columns_and_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([(1, b"a \xff b", 5), (2, None, 6)], "doc_id long, text binary, `a.b` int").selectExpr("doc_id", "cast(text as string) text", "`a.b`")
    out = bpe.encode(docs, PATH, decoded=True, without_text=True)
    assert out.columns == ["doc_id", "a.b", "ids", "ends", "decoded"]
    assert {r["doc_id"]: (bytes(r["decoded"]).decode(), r["a.b"]) for r in out.collect()} == {1: ("a \ufffd b", 5), 2: ("", 6)}
