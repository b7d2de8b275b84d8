"""One query for each operator of this subpackage, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.llm import bpe, classifier, html_extract, jaccard_join, line_dedup, mixing, quality_rules, topk, url_filter, warc
from charta.llm.workdir import fresh_path

#: The rules that the URL query applies, (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary() -> str:
    """Path of the rank file that the token query encodes by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    """The pattern that comes with the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, least_length=1)
    dropped = F.size(F.filter("dropped", lambda x: x)).cast("long")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "copies")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded=True, without_text=True, pattern=pattern())
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classifier.score(docs, classifier.train(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", classifier.in_fold_zero(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_line_dedup, op2_quality_rules, op3_warc, op4_topk_search, op5_source_mixing, op6_url_filters, op7_html_extraction, op8_byte_bpe, op9_quality_classifier, op10_jaccard_join)
    return {f.__name__: f for f in found}


_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_SPLIT = r"[\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL expresses; the others have tests against brute force."""
    return {
        "op1_line_dedup": f"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                FROM documents),
            k AS (SELECT *, translate(trim(line, {_WHITE}), {_LOWER}) AS key FROM l),
            f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
            SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
            FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
        "op2_quality_rules": rf"""
            WITH d AS (
                SELECT doc_id, coalesce(text, '') AS t,
                       list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda w: w <> '') AS words,
                       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WHITE}) <> '') AS rows_
                FROM documents),
            w AS (
                SELECT doc_id, generate_subscripts(words, 1) AS pos, words[generate_subscripts(words, 1):generate_subscripts(words, 1) + 4] AS win
                FROM d WHERE len(words) >= 5),
            r AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM w WHERE len(win) = 5),
            c AS (
                SELECT doc_id, sum(least(5, coalesce(pos - before, 5))) AS n_repeat_words
                FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r WHERE n > 1)
                GROUP BY doc_id),
            m AS (
                SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                       len(rows_) - len(list_distinct(rows_)) AS n_dup_lines,
                       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(rows_) AS n_rows,
                       length(t) - length(replace(t, '!', '')) AS shouts,
                       len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS stops,
                       len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS echoes
                FROM d LEFT JOIN c USING (doc_id)),
            b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                   NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.3
                   AND (n_words < 20 OR shouts / n_words <= 0.5) AND (n_words < 60 OR stops / n_words >= 0.01)
                   AND n_dup_lines / n_rows <= 0.5 AND echoes / n_words <= 0.3 AS kept
            FROM b""",
        "op3_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
            b AS (
                SELECT *, max(page_id) OVER (PARTITION BY html) AS newest,
                       list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                           (((('0x' || substr(h, ((i // 4) * 5 + 1)::BIGINT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::BIGINT, 1)) AS digits
                FROM p)
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(digits, '') AS payload_digest,
                   CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> newest THEN newest END AS refers_to
            FROM b""",
        "op4_topk_search": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
                SELECT a.vec_id AS query_id, b.vec_id,
                       list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
                FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 20""",
        "op6_url_filters": f"""
            WITH r(verdict, h, p) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
            u AS (
                SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
                FROM pages),
            f AS (
                SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
            SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (page_id)""",
        "op7_html_extraction": r"""
            WITH a AS (
                SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1),
                       '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
            c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'), '&quot;', '"'), chr(1), '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM a)
            SELECT page_id, url, text, length(text) AS n_chars FROM c""",
        "op10_jaccard_join": rf"""
            WITH RECURSIVE d AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '{_SPLIT}'), lambda w: w <> '') AS w FROM documents),
            g AS (
                SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                       ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
            reach AS (SELECT a AS doc_id, b AS to_id FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.to_id)
            SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(to_id), d.doc_id)) AS component_id
            FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id""",
    }
