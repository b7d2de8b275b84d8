import hashlib

import corpus_pipeline as P


def test_tokens_decode_to_the_text(spark):
    texts = ["Été à Genève\n\tßx  1234", "", None, "a" * 3000 + " \U0001f600"]
    docs = spark.createDataFrame([(i, "fr", "s", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r["decoded_sha256"] for r in P.tokens(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
