"""Registered queries: each calls one operator over its whole tables, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.functions import python, versions
from charta.functions import text as T
from charta.operators import entities, index, lexical, provenance, quant, retrieve
from charta.plans.fixtures import COSTS, PDF_LINES, PDF_TITLES, PERSONS, table, values
from charta.sources import connectors, containers, fetch, pdf, registry, run
from charta.sources.tables import ENTITIES, administered, load
from charta.sources.workdir import fresh_path
from charta.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
BM25_TERMS = ["the", "leaux", "eauou"]
KWIC_TERM = "leaux"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# connectors and dispatch

_REG = values("registry", registry.registry_rows(), "ordinal, name, alias, script, flag, help")
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_LINES = "unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INT AS line_no"


@_query(f"WITH {_REG} SELECT ordinal, name, alias, script, flag, help FROM registry")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    connectors.register(spark)
    return spark.read.format("connectors").load()


@_query(f"WITH {_REG} SELECT a.name AS key, t.name, t.script, t.flag FROM registry a JOIN registry t ON t.name = coalesce(a.alias, a.name)")
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.resolved(registry.registry(spark))


@_query(f"WITH {_REG} SELECT c.case_id, coalesce(r.alias, r.name, lower(c.args[1])) AS canonical FROM c LEFT JOIN registry r ON r.name = lower(c.args[1]) WHERE len(c.args) > 0".replace("WITH ", f"WITH {values('requests')}, c AS (SELECT * FROM requests), ", 1))
def registry_canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, "requests").filter(F.size("args") > 0).withColumn("key", F.lower(F.get("args", F.lit(0))))
    return keyed.join(F.broadcast(registry.resolved(registry.registry(spark))), "key", "left").select("case_id", F.coalesce("name", "key").alias("canonical"))


@_query(f"WITH {_REG}, g AS (SELECT alias AS name, list(name ORDER BY ordinal) AS aliases FROM registry WHERE alias IS NOT NULL GROUP BY alias) SELECT r.name, array_to_string(coalesce(aliases, []), ',') AS aliases, CASE WHEN aliases IS NULL THEN '' ELSE '  (alias: ' || array_to_string(aliases, ', ') || ')' END AS listed FROM registry r LEFT JOIN g USING (name) WHERE r.alias IS NULL")
def registry_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.aliases(registry.registry(spark)).withColumn("aliases", F.array_join("aliases", ","))


@_query(f"WITH {_REG} SELECT string_agg(name, ', ' ORDER BY name) AS names FROM registry WHERE alias IS NULL")
def registry_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.canonical(registry.registry(spark)).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))


@_query(f"WITH {_REG}, {values('requests')} SELECT case_id, lower(args[1]) AS key FROM requests WHERE len(args) > 0 AND args[1] NOT IN ('-h', '--help', 'help') AND lower(args[1]) NOT IN (SELECT name FROM registry)")
def registry_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.unknown(table(spark, "requests"), registry.registry(spark))


_HELP_TAIL = " UNION ALL ".join("SELECT {}, {}, '{}'".format(a, b, line.replace("'", "''")) for a, b, line in registry.help_frame())


@_query(f"""WITH {_REG}, g AS (SELECT alias AS name, '  (alias: ' || string_agg(name, ', ' ORDER BY ordinal) || ')' AS listed FROM registry WHERE alias IS NOT NULL GROUP BY alias),
    r AS (SELECT r.*, coalesce(listed, '') AS listed FROM registry r LEFT JOIN g USING (name) WHERE r.alias IS NULL),
    l(a, b, line) AS (SELECT ordinal, 0, '  ' || name || listed FROM r UNION ALL SELECT ordinal, 1, '    ' || help FROM r UNION ALL SELECT ordinal, 2, '    fetch ' || name || ' <' || ltrim(flag, '-') || '>' FROM r UNION ALL {_HELP_TAIL})
    SELECT (row_number() OVER (ORDER BY a, b))::INT AS line_no, line FROM l""")
def registry_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.help_lines(registry.registry(spark))


_SPLIT = r"""s AS (SELECT case_id, args, args[2:] AS rest, coalesce(list_position(list_transform(args[2:], lambda t: starts_with(t, '-')), true), 0) AS first FROM requests),
    p AS (SELECT case_id, args, regexp_replace(regexp_replace(array_to_string(CASE WHEN first > 0 THEN rest[:first - 1] ELSE rest END, ' '), '^\s+', ''), '\s+$', '') AS main,
        CASE WHEN first > 0 THEN rest[first:] ELSE [] END AS extra FROM s)"""


@_query(f"WITH {values('requests')}, {_SPLIT} SELECT case_id, main, array_to_string(extra, '|') AS extra FROM p")
def cli_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, extra = registry.split_request(F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))))
    return table(spark, "requests").select("case_id", main.alias("main"), F.array_join(extra, "|").alias("extra"))


@_query(f"""WITH {_REG}, {values('requests')}, {_SPLIT},
    q AS (SELECT p.*, len(args) = 0 OR args[1] IN ('-h', '--help', 'help') AS is_help, coalesce(r.alias, r.name) AS name FROM p LEFT JOIN registry r ON r.name = lower(args[1])),
    x AS (SELECT q.case_id, q.main, q.name, CASE WHEN is_help THEN 'help' WHEN q.name IS NULL THEN 'unknown' ELSE 'run' END AS outcome, t.script, t.flag,
        CASE WHEN q.main = '' AND len(extra) = 0 THEN ['--help'] ELSE extra END AS extra FROM q LEFT JOIN registry t ON t.name = q.name),
    c AS (SELECT *, list_concat(['python', '-u', script], list_concat(CASE WHEN main <> '' THEN [flag, main] ELSE [] END, extra)) AS command FROM x)
    SELECT case_id, outcome, CASE outcome WHEN 'help' THEN 0 WHEN 'unknown' THEN 2 END AS exit_code, CASE WHEN outcome = 'run' THEN name END AS name, CASE WHEN outcome = 'run' THEN main END AS main,
        CASE WHEN outcome = 'run' THEN array_to_string(command, '|') END AS command,
        CASE WHEN outcome = 'run' THEN '[fetch:' || name || '] ' || regexp_extract(script, '([^/]*)$', 1) || ' ' || array_to_string(list_transform(command[4:], lambda a: CASE WHEN contains(a, ' ') THEN '"' || a || '"' ELSE a END), ' ') END AS trace FROM c""")
def cli_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registry.dispatched(table(spark, "requests"), registry.registry(spark))
    return out.drop("extra").withColumn("command", F.array_join("command", "|"))


@_query(f"WITH {_REG}, {values('requests')} SELECT c.case_id, '/srv/charta/' || r.script AS path FROM requests c JOIN registry k ON k.name = lower(c.args[1]) JOIN registry r ON r.name = coalesce(k.alias, k.name) WHERE c.args[1] <> 'help'")
def cli_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registry.dispatched(table(spark, "requests"), registry.registry(spark), root="/srv/charta/")
    return out.filter("outcome = 'run'").select("case_id", F.get("command", F.lit(2)).alias("path"))


@_query(f"WITH {_REG}, {values('requests')} SELECT c.case_id, r.name FROM requests c JOIN registry k ON k.name = lower(c.args[1]) JOIN registry r ON r.name = coalesce(k.alias, k.name) WHERE c.args[1] <> 'help' AND r.name NOT IN ('dhs', 'wikipedia')")
def cli_missing_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = spark.createDataFrame([("connectors/dhs.py",), ("connectors/wikipedia.py",)], "script string")
    reg = registry.registry(spark)
    gone = registry.dispatched(table(spark, "requests"), reg, scripts=there).filter("outcome = 'missing'").select("case_id")
    named = table(spark, "requests").withColumn("key", F.lower(F.get("args", F.lit(0)))).join(F.broadcast(registry.resolved(reg)), "key")
    return named.join(gone, "case_id", "left_semi").select("case_id", "name")


@_query("SELECT n, array_to_string(list_transform(range(1, least(n, 9) + 1), lambda i: 'a' || i), ' ') AS handed FROM (VALUES (0), (3), (9), (12)) t(n)")
def wrapper_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, [f"a{i}" for i in range(1, n + 1)]) for n in (0, 3, 9, 12)]
    return spark.createDataFrame(rows, "n int, args array<string>").select("n", F.array_join(registry.wrapped(F.col("args")), " ").alias("handed"))


# what connectors select

_FIRST = "string_split(text, chr(10))[1]"
# DuckDB's distance counts bytes: each accented letter stands as one of ASCII that no lower-cased word has
_ASCII = "translate({}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ012345')"
_FOLD = f"translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}')"
_SLUG = f"regexp_replace(regexp_replace(replace({_FOLD}, 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_NORMAL = f"array_to_string(list_sort(string_split(trim(regexp_replace(translate(lower({{}}), '{T.ACCENTED}', '{T.PLAIN}'), '[\\s,]+', ' ', 'g')), ' ')), ' ')"


@_query(f"SELECT doc_id, lang FROM documents WHERE contains(translate(lower({_FIRST}), '{T.ACCENTED}', '{T.PLAIN}'), 'eaux')")
def fetch_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.by_term(load(spark, sf_dir, "documents"), "eaux").select("doc_id", "lang")


@_query(f"SELECT doc_id, lang FROM documents WHERE lang = 'en' AND regexp_replace(regexp_replace(replace(translate(lower({_FIRST}), '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = 'the_and_attion_to_thanedble_the_anea_eriner_thanea'")
def fetch_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.by_title(load(spark, sf_dir, "documents"), "The and attion to thanedble the, anea: Eriner thanea", "en").select("doc_id", "lang")


@_query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 43")
def fetch_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.by_id(load(spark, sf_dir, "documents"), "doc_id", 43).select("doc_id", "source", "lang")


@_query(r"SELECT page_id, url FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) = 'www.ththea.example.com' AND regexp_extract(url, '[?&]ref=([^&#]*)', 1) = 'x'")
def fetch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch.search(load(spark, sf_dir, "pages"), "www.ththea.example.com", ref="x").select("page_id", "url")


@_query("WITH w AS (SELECT url FROM pages UNION SELECT 'http://nowhere.example/') SELECT w.url, page_id, length(html) AS n_chars FROM w LEFT JOIN pages USING (url)")
def fetch_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    wanted = pages.select("url").unionByName(spark.createDataFrame([("http://nowhere.example/",)], "url string"))
    return fetch.contents(pages, wanted).select("url", "page_id", F.length("html").cast("long").alias("n_chars"))


@_query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS ordinal FROM documents WHERE source IN ('src1', 'src7')")
def fetch_vote_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = spark.createDataFrame([("src1",), ("src7",), ("none",)], "source string")
    return fetch.sources_of(F.broadcast(votes), load(spark, sf_dir, "documents").select("source", "doc_id"), "source")


_RAN = f"""d AS (SELECT doc_id, lang, source, text, {_FIRST} AS heading, {_SLUG.format(_FIRST)} AS slug FROM documents),
    o AS (SELECT x.*, r.name FROM (SELECT case_id, args[1] AS key, main, extra FROM p WHERE len(args) > 0) x JOIN registry k ON k.name = lower(key) JOIN registry r ON r.name = coalesce(k.alias, k.name)),
    c AS (SELECT *, extra[list_position(extra, '--lang') + 1] AS lang_, extra[list_position(extra, '--start-year') + 1]::INT AS from_, extra[list_position(extra, '--end-year') + 1]::INT AS to_,
        regexp_extract(main, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(main, '\\?([^#]*)', 1), '') AS query FROM o WHERE main <> '' AND NOT list_contains(extra, '--dry-run')),
    g AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)"""


@_query(f"""WITH {_REG}, {values('runs').replace('runs(', 'requests(', 1)}, {values('persons').replace('index,', '"index",')}, {_SPLIT}, {_RAN}
    SELECT case_id, name, doc_id::VARCHAR AS ref, heading AS title FROM c JOIN d ON name = 'dhs' AND contains({_FOLD.format('heading')}, {_FOLD.format('main')})
    UNION ALL SELECT case_id, name, doc_id::VARCHAR, heading FROM c JOIN d ON name = 'wikipedia' AND slug = {_SLUG.format('main')} AND (lang_ IS NULL OR lang = lang_)
    UNION ALL SELECT case_id, name, doc_id::VARCHAR, heading FROM c JOIN d ON name = 'dodis-document' AND doc_id = try_cast(main AS BIGINT)
    UNION ALL SELECT case_id, name, doc_id::VARCHAR, heading FROM c JOIN d ON name = 'swissvote' AND source = 'src' || main
    UNION ALL SELECT case_id, name, page_id::VARCHAR, title FROM c JOIN g ON name IN ('url', 'enewspaper-content') AND url = main
    UNION ALL SELECT case_id, name, page_id::VARCHAR, title FROM c JOIN g ON name = 'dodis' AND regexp_extract(url, '://([^/?#]*)', 1) = host AND nullif(regexp_extract(url, '\\?([^#]*)', 1), '') = query
    UNION ALL SELECT case_id, name, record_id::VARCHAR, full_name FROM c JOIN persons ON "index" = CASE name WHEN 'dodis-person' THEN 'dodis' WHEN 'elitesuisse' THEN 'elitesuisse' END AND {_NORMAL.format('main')} = {_NORMAL.format('full_name')}
    UNION ALL SELECT case_id, name, doc_id::VARCHAR, heading FROM c JOIN (SELECT d.*, year(ts) AS y, {_WORDS} AS w FROM d JOIN events ON event_id = doc_id) a
        ON name = 'enewspaper' AND list_has_all(w, regexp_extract_all(lower(main), '\\p{{L}}+')) AND (from_ IS NULL OR y >= from_) AND (to_ IS NULL OR y <= to_)""")
def connector_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = registry.dispatched(table(spark, "runs"), registry.registry(spark))
    pages = load(spark, sf_dir, "pages").select("page_id", "url", T.html_title(F.col("html")).alias("title"))
    return run.executed(asked, {"documents": load(spark, sf_dir, "documents"), "pages": pages, "persons": table(spark, "persons"), "articles": _articles(spark, sf_dir)})


@_query(f"WITH {values('persons').replace('index,', '"index",')}, n(name) AS (VALUES ('Wille Ulrich'), ('muller  EMILE'), ('Nobody')) SELECT name, record_id, full_name FROM n LEFT JOIN persons ON \"index\" = 'elitesuisse' AND {_NORMAL.format('name')} = {_NORMAL.format('full_name')}")
def elite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Wille Ulrich",), ("muller  EMILE",), ("Nobody",)], "name string")
    return entities.looked_up(names, table(spark, "persons").filter("index = 'elitesuisse'").drop("index"))


@_query("SELECT page_id, url, length(html) AS n_chars FROM pages WHERE url IN (SELECT url FROM pages) UNION ALL SELECT NULL, 'http://nowhere.example/', NULL")
def fetch_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = load(spark, sf_dir, "pages"), fresh_path(spark, "list")
    spark.createDataFrame([("http://nowhere.example/",)], "url string").unionByName(pages.select("url")).write.json(path)
    return run.listed_contents(spark, path, pages).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


@_query("SELECT source AS provider, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def source_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "folder")
    connectors.write_documents(load(spark, sf_dir, "documents").select(F.col("source").alias("provider"), "text"), path)
    return connectors.read_documents(spark, path).groupBy("provider").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@_query("SELECT 'json' AS kind, page_id, length(url) AS n_chars FROM pages")
def read_any_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "any")
    load(spark, sf_dir, "pages").select("page_id", "url").repartition(3).write.json(path)
    found = connectors.read_any(spark, path).filter("kind = 'json'").select("kind", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    row = F.from_json("line", "page_id long, url string")
    return found.select("kind", row["page_id"].alias("page_id"), F.length(row["url"]).cast("long").alias("n_chars"))


# tables and versions

_ENTITY_ROWS = [(name, i, c.split(" ")[0], c.split(" ")[1]) for name, columns in ENTITIES.items() for i, c in enumerate(columns.replace("10,2", "10;2").split(", "))]


@_query(f"WITH {values('e', _ENTITY_ROWS, 'table_name, position, column_name, data_type')} SELECT table_name, position, column_name, replace(data_type, ';', ',') AS data_type FROM e")
def db_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"charta_{uuid.uuid4().hex}"
    out = administered(spark, name, ["init"], fresh_path(spark, "database"))
    spark.sql(f"DROP DATABASE {name} CASCADE")
    return out


@_query("SELECT 'before' AS moment, 'source' AS name, count(*) AS n FROM documents UNION ALL SELECT 'after', 'source', count(*) FROM documents UNION ALL SELECT moment, name, n FROM (VALUES ('before', 'mention', 2), ('after', 'mention', 0)) t(moment, name, n)")
def db_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"charta_{uuid.uuid4().hex}"
    administered(spark, name, ["init"], fresh_path(spark, "database"))
    try:
        described_ = index.described(load(spark, sf_dir, "documents"))
        spark.createDataFrame([("s1", 1, "A B", "person", "en"), ("s1", 2, "C D", None, "en")], ENTITIES["mention"]).write.insertInto(f"{name}.mention")
        columns = [c.split(" ")[0] for c in ENTITIES["source"].split(", ")]
        described_.select(*[(F.col(c) if c in described_.columns else F.lit(None)).alias(c) for c in columns]).write.insertInto(f"{name}.source")
        rows = [("before", r["name"], r["n"]) for r in administered(spark, name, ["stats"]).collect()]
        rows += [("after", r["name"], r["n"]) for r in administered(spark, name, ["reset", "mention"]).collect()]
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.createDataFrame([r for r in rows if r[1] in ("source", "mention")], "moment string, name string, n long")


@_query(f"""WITH {values('costs')}, r AS (SELECT row_number() OVER (ORDER BY place)::INT + 2 AS line_no, '| ' || place || ' | ' || replace(skill, '|', '\\|') || ' | ' || coalesce(credits, '') || ' |' AS line FROM costs)
    SELECT 1 AS line_no, '| place | skill | credits |' AS line UNION ALL SELECT 2, '| --- | --- | --- |' UNION ALL SELECT * FROM r""")
def tabular_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "table")
    table(spark, "costs").coalesce(1).write.option("header", "true").option("escape", '"').csv(path)
    return connectors.table_lines(connectors.read_delimited(spark, path, "place int, skill string, credits string"), "place")


@_query(f"WITH {values('persons').replace('index,', '\"index\",')} SELECT record_id, full_name FROM persons")
def sqlite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, name) for _, i, name in PERSONS]
    files = spark.createDataFrame([(containers.sqlite_bytes({"source": ("record_id INTEGER, full_name TEXT", rows)}),)], "content binary")
    return containers.sqlite_rows(files, "source", "record_id int, full_name string")


@_query(f"WITH {values('costs')}, c AS (SELECT place + 1 AS row_no, unnest([1, 2, 3]) AS col_no, unnest([place::VARCHAR, skill, credits]) AS value FROM costs UNION ALL SELECT 1, unnest([1, 2, 3]), unnest(['place', 'skill', 'credits'])) SELECT 'credits' AS sheet, * FROM c WHERE value IS NOT NULL")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = containers.workbook_bytes({"credits": [["place", "skill", "credits"], *[list(r) for r in COSTS]]})
    return containers.workbook_cells(spark.createDataFrame([(content,)], "content binary"))


_PDF = f"{values('pdf_lines')}, {values('pdf_titles')}, g AS (SELECT path, page_no, string_agg(line, chr(10)) AS text FROM pdf_lines GROUP BY ALL)"


def _pdfs(spark: SparkSession) -> DataFrame:
    pages = {path: [[line for p, i, line in PDF_LINES if (p, i) == (path, n)] for n in range(1, 1 + max(i for p, i, _ in PDF_LINES if p == path))] for path, _ in PDF_TITLES}
    return spark.createDataFrame([(path, pdf.pdf_bytes(pages[path], title)) for path, title in PDF_TITLES] + [("c.pdf", b"none")], "path string, content binary")


@_query(f"WITH {_PDF} SELECT path, page_no, text, title, NULL::VARCHAR AS fault FROM g JOIN pdf_titles USING (path) UNION ALL SELECT 'c.pdf', 0, NULL, NULL, 'no PDF file'")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_pages(_pdfs(spark)).drop("author")


@_query(f"WITH {_PDF} SELECT path, CASE WHEN title IS NULL THEN '' ELSE '# ' || title || chr(10) || chr(10) END || string_agg('<!-- page ' || page_no || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_no) AS markdown FROM g JOIN pdf_titles USING (path) GROUP BY path, title")
def pdf_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.pdf_markdown(_pdfs(spark))


_VERSION = "list_transform(string_split(regexp_replace(regexp_extract({}, '(\\d+(?:\\.\\d+)*)', 1), '(\\.0+)+$', ''), '.'), lambda x: x::BIGINT)"


@_query(f"WITH {values('tools')} SELECT tool, CASE WHEN regexp_matches(found, '\\d') THEN {_VERSION.format('found')} >= {_VERSION.format('least')} END AS fits FROM tools")
def version_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "tools").select("tool", versions.at_least(F.col("found"), F.col("least")).alias("fits"))


# functions in Python, for what no built-in expression says

@_query("SELECT doc_id, nfc_normalize(strip_accents(text)) AS bare FROM documents")
def unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", python.unaccented("text").alias("bare"))


@_query(f"SELECT doc_id, line_no, length(line)::INT AS n_chars, string_split(line, ' ')[1] AS first FROM (SELECT doc_id, {_LINES} FROM documents WHERE text IS NOT NULL)")
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.lateralJoin(python.LineTable(F.col("text").outer())).select("doc_id", "line_no", "n_chars", "first")


# normalisation

_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@_query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@_query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@_query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.explode(T.html_links(F.col("html"))).alias("link"))


@_query(
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<head>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS t FROM pages),
    h AS (SELECT page_id, """
    + "regexp_replace(" * 6
    + "t"
    + "".join(f", '(?i)<h{n}[^>]*>', chr(10) || '{'#' * n} ', 'g')" for n in range(1, 7))
    + r""" AS t FROM a),
    l AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<a href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g') AS t FROM h),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|article|nav|ul|ol|footer|h[1-6]|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM l)
    SELECT page_id, trim(regexp_replace(t, '\n[ \t\n]*\n', chr(10) || chr(10), 'g')) AS markdown FROM b"""
)
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", T.markdown(F.col("html")).alias("markdown"))


@_query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.url_parts(load(spark, sf_dir, "pages"))


@_query(r"SELECT regexp_extract(url, '\?([^#]*)', 1) <> '' AS has_query, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, count(*) AS n FROM pages GROUP BY ALL")
def search_results_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "pages").select(F.expr("try_parse_url(url, 'QUERY')").isNotNull().alias("has_query"), F.expr("try_parse_url(url, 'QUERY', 'page')").alias("page"))
    return rows.groupBy("has_query", "page").agg(F.count("*").alias("n"))


@_query(f"SELECT doc_id, line_no, line AS text FROM (SELECT doc_id, {_LINES} FROM documents)")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("at", "text"))
    return found.select("doc_id", (F.col("at") + 1).alias("line_no"), "text")


@_query(f"SELECT doc_id, line_no, len(regexp_split_to_array(regexp_replace(line, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))::INT AS n_sentences FROM (SELECT doc_id, {_LINES} FROM documents)")
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@_query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.folded(F.col("text")).alias("folded"))


@_query(f"SELECT doc_id, 'sources/' || source || '/' || regexp_replace(regexp_replace(replace({_FOLD.format(_FIRST)}, 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || source || '_' || lpad(doc_id::VARCHAR, 6, '0') || '_' || lang || '.md' AS path FROM documents")
def doc_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.source_path(F.col("source"), fetch.first_line(F.col("text")), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.col("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


# index

@_query("SELECT substr(sha256(source || '|' || doc_id::VARCHAR), 1, 16) AS source_id, source AS provider, doc_id::VARCHAR AS external_id, lang, sha256(text) AS sha256, length(text) AS n_chars FROM documents")
def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.described(load(spark, sf_dir, "documents"))


@_query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.exact_duplicates(load(spark, sf_dir, "documents"))


@_query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents")
def canonical_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.canonical(load(spark, sf_dir, "documents"))


@_query("WITH i AS (SELECT doc_id, source, lang, 1 AS version FROM documents WHERE source <> 'src3'), n AS (SELECT doc_id, source, lang, 2 AS version FROM documents WHERE lang <> 'en') SELECT * FROM i WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return index.upserted(docs.filter("source <> 'src3'").withColumn("version", F.lit(1)), docs.filter("lang <> 'en'").withColumn("version", F.lit(2)), "doc_id")


@_query("SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(load(spark, sf_dir, "documents"))


@_query("SELECT lang, source, count(*) AS n_docs, count(DISTINCT n_chars) AS n_lengths, grouping(lang, source)::INT AS level FROM documents GROUP BY CUBE (lang, source)")
def lang_source_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cube(load(spark, sf_dir, "documents"))


@_query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, string_agg(lang, ',' ORDER BY lang) AS langs, max(n) FILTER (lang = 'en') AS english, (coalesce(sum(n) FILTER (lang <> 'en'), 0))::BIGINT AS others FROM c GROUP BY source")
def source_lang_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.language_map(load(spark, sf_dir, "documents"))
    others = F.aggregate(F.map_values(F.map_filter("langs", lambda k, v: k != "en")), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select("source", F.array_join(F.sort_array(F.map_keys("langs")), ",").alias("langs"), F.try_element_at("langs", F.lit("en")).alias("english"), others.alias("others"))


@_query()
def approx_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.approximate_statistics(load(spark, sf_dir, "documents"))


@_query("SELECT 'mention' AS name, 0 AS n UNION ALL SELECT 'source', count(*) FROM documents")
def reset_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    after = index.without_derived({"source": index.described(docs), "mention": entities.mentions(docs)})
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in after.items()]
    return parts[0].unionByName(parts[1])


# lexical fields

@_query(f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY term")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_frequency(load(spark, sf_dir, "documents"))


@_query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    s AS (SELECT doc_id, term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS score FROM c JOIN d USING (term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 3""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.tfidf(load(spark, sf_dir, "documents"))


@_query(f"WITH w AS (SELECT {_WORDS} AS w FROM documents), p AS (SELECT unnest(w[:-2]) AS first, unnest(w[2:]) AS second FROM w WHERE len(w) > 1) SELECT first, second, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2")
def bigram_cooccur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bigrams(load(spark, sf_dir, "documents"))


@_query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1)::INT AS word_no FROM w) SELECT doc_id, word_no, array_to_string(w[greatest(word_no - 3, 1):word_no - 1], ' ') AS before, array_to_string(w[word_no + 1:word_no + 3], ' ') AS after FROM p WHERE word = '{KWIC_TERM}'")
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.in_context(load(spark, sf_dir, "documents"), KWIC_TERM)


@_query(f"WITH w AS (SELECT lang, unnest({_WORDS}) AS term FROM documents), x AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM benchmark) SELECT lang, count(*) AS n_words, count(*) FILTER (x.term IS NULL) AS n_unknown, round(count(*) FILTER (x.term IS NULL) / count(*), 9) AS rate FROM w LEFT JOIN x USING (term) GROUP BY lang")
def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = load(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("term"))
    return lexical.unknown_rate(load(spark, sf_dir, "documents"), lexicon)


@_query(f"""WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM documents), x AS (SELECT DISTINCT unnest({_WORDS}) AS term FROM benchmark),
    u AS (SELECT term, {_ASCII.format('term')} AS k FROM w WHERE term NOT IN (SELECT term FROM x)), y AS (SELECT term, {_ASCII.format('term')} AS k FROM x),
    d AS (SELECT len(k) + unnest([-1, 0, 1]) AS n, term, k FROM u),
    n AS (SELECT d.term, y.term AS suggestion FROM d JOIN y ON d.n = len(y.k) WHERE levenshtein(d.k, y.k) <= 1)
    SELECT term, min(suggestion) AS suggestion, 1::INT AS distance FROM n GROUP BY term""")
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = load(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    terms = load(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("term")).distinct()
    return lexical.corrections(terms.join(lexicon, "term", "left_anti"), lexicon)


# retrieval and provenance

_QUERY_VECTOR = [round(0.05 * ((7 * i) % 13 - 6), 2) for i in range(64)]


@_query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE len(embedding) = 64),
    s AS (SELECT vec_id, round(list_cosine_similarity(v, {_QUERY_VECTOR}::DOUBLE[]), 6) AS similarity FROM v)
    SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id)::INT AS rank FROM s ORDER BY similarity DESC, vec_id LIMIT 10""")
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.nearest(load(spark, sf_dir, "embeddings"), _QUERY_VECTOR)


_BM25 = f"""p AS (SELECT source, doc_id, line_no, line AS text FROM (SELECT source, doc_id, {_LINES} FROM documents) WHERE trim(line) <> ''),
    w AS (SELECT *, {_WORDS} AS w FROM p), c AS (SELECT *, len(w) AS n, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(BM25_TERMS))} FROM w),
    t AS (SELECT count(*) AS rows_, avg(n) AS mean, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(BM25_TERMS)))} FROM c),
    s AS (SELECT source, doc_id, line_no, text, round({" + ".join(f"ln(1 + (rows_ - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(BM25_TERMS)))}, 6) AS score
        FROM c, t WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(BM25_TERMS)))})"""


@_query(f"WITH {_BM25} SELECT source, doc_id, line_no, score, substr(text, 1, 120) AS snippet FROM s ORDER BY score DESC, doc_id, line_no LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.cited_top(load(spark, sf_dir, "documents"), BM25_TERMS)


@_query(f"WITH {_BM25} SELECT source, doc_id, line_no, score FROM s")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(retrieve.passages(load(spark, sf_dir, "documents")), BM25_TERMS, ["source", "doc_id", "line_no"]).drop("text")


# an item's occurrences stand between the parts that it cuts a text into; the line of one is told by the text before it
_CITE = """x AS (SELECT item_id, doc_id, source, b.text AS item, string_split(d.text, b.text) AS parts FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0),
    y AS (SELECT item_id, doc_id, source, list_transform(parts, lambda p: length(p) - length(replace(p, chr(10), ''))) AS breaks, length(item) - length(replace(item, chr(10), '')) AS own, unnest(range(1, len(parts))) AS k FROM x),
    c AS (SELECT DISTINCT item_id, doc_id, source, (1 + list_sum(breaks[1:k]) + (k - 1) * own)::INT AS line_no FROM y)"""


@_query(f"WITH {_CITE} SELECT item_id, doc_id, line_no FROM c")
def passage_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.cited(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@_query(f"WITH {_CITE} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def negative_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.uncovered(load(spark, sf_dir, "documents").select("doc_id", "source"), passage_cite(spark, sf_dir), ["doc_id"])


@_query(f"WITH {values('letters')}, l AS (SELECT source_id, {_LINES} FROM letters) SELECT source_id, line_no, unnest(regexp_extract_all(line, '\\[(\\d+)\\]', 1))::INT AS ref_no FROM l")
def ref_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.references(table(spark, "letters"))


_CHAIN = f"{values('claims')}, {values('refs')}, r AS (SELECT c.claim, c.provider, c.source_id, c.claim_line, c.ref_no, refs.line_no AS ref_line, target_url, citation FROM claims c LEFT JOIN refs USING (source_id, ref_no))"
_CLASS = "CASE WHEN regexp_matches(coalesce(target_url, '') || ' ' || coalesce(citation, ''), '(?i)dodis\\.ch|archive|letter|transcript') THEN 'primary' WHEN regexp_matches(coalesce(target_url, '') || ' ' || coalesce(citation, ''), '(?i)\\(\\d{4}\\)|dictionary|wikipedia|book|history') THEN 'secondary' ELSE 'unclassified' END"


def _chain(spark: SparkSession) -> DataFrame:
    return provenance.resolved(table(spark, "claims"), table(spark, "refs"))


def _classified(spark: SparkSession) -> DataFrame:
    shown = F.concat(F.coalesce("target_url", F.lit("")), F.lit(" "), F.coalesce("citation", F.lit("")))
    return _chain(spark).withColumn("evidence_class", provenance.evidence_class(shown))


@_query(f"WITH {_CHAIN} SELECT * FROM r")
def ref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark)


@_query(f"WITH {_CHAIN} SELECT claim, source_id, ref_no, {_CLASS} AS evidence_class FROM r")
def evidence_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark).select("claim", "source_id", "ref_no", "evidence_class")


@_query(f"WITH {_CHAIN} SELECT claim, count(DISTINCT provider) AS providers, count(*) FILTER (({_CLASS}) = 'primary') AS \"primary\", count(*) FILTER (({_CLASS}) = 'secondary') AS secondary, count(DISTINCT provider) >= 2 AS triangulated FROM r GROUP BY claim")
def triangulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.triangulated(_classified(spark))


@_query(f"WITH RECURSIVE {values('links')}, reach(node, hop) AS (SELECT 's1', 0 UNION SELECT dst, hop + 1 FROM reach JOIN links ON src = node WHERE hop < 3) SELECT node, min(hop) AS hop FROM reach GROUP BY node")
def ref_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.hops(table(spark, "links"), "s1", 3)


@_query(f"WITH {values('declared')}, {values('used')} SELECT coalesce(d.source_id, u.source_id) AS source_id, CASE WHEN u.source_id IS NULL THEN 'declared only' WHEN d.source_id IS NULL THEN 'used only' ELSE 'both' END AS state FROM declared d FULL JOIN (SELECT DISTINCT source_id FROM used) u USING (source_id)")
def declared_vs_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.declared_and_used(table(spark, "declared"), table(spark, "used"), ["source_id"])


@_query(f"WITH {values('declared')}, {values('used')} SELECT 'used' AS side, source_id FROM (SELECT * FROM used EXCEPT ALL SELECT * FROM declared) UNION ALL SELECT 'declared', source_id FROM (SELECT * FROM declared EXCEPT ALL SELECT * FROM used)")
def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, z = table(spark, "declared"), table(spark, "used")
    parts = [provenance.only_in(x, y).select(F.lit(side).alias("side"), "source_id") for side, x, y in (("used", z, a), ("declared", a, z))]
    return parts[0].unionByName(parts[1])


@_query(f"WITH {values('declared')}, {values('used')} SELECT source_id FROM declared INTERSECT SELECT source_id FROM used")
def inventory_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.in_both(table(spark, "declared"), table(spark, "used"))


@_query(f"WITH {values('turns')}, {values('asked')}, u AS (SELECT unnest(regexp_extract_all(text, '(https?://[^\\s)\\]>\"'']+)', 1)) AS url FROM turns) SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n, url IN (SELECT url FROM asked) AS was_requested FROM u GROUP BY url")
def url_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.cited_addresses(table(spark, "turns"), table(spark, "asked"))


@_query("SELECT conv_id, turn, length(text) AS n_chars FROM conversations WHERE role = 'assistant' AND NOT coalesce(regexp_matches(text, '\\[\\d+\\]|https?://[^\\s)\\]>\"'']+'), false)")
def uncited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.uncited_answers(load(spark, sf_dir, "conversations"))


@_query(f"WITH {values('answers')}, {values('versions')}, c AS (SELECT a.answer_id, a.source_id, a.used, arg_max(v.version, v.fetched_at) FILTER (v.fetched_at <= a.answered_at) AS current FROM answers a LEFT JOIN versions v USING (source_id) GROUP BY ALL) SELECT *, coalesce(used < current, false) AS stale FROM c")
def stale_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.stale_versions(table(spark, "answers"), table(spark, "versions"))


@_query(f"WITH {values('left_version')}, {values('right_version')} SELECT line_no, CASE WHEN l.text IS NULL THEN 'added' WHEN r.text IS NULL THEN 'removed' WHEN l.text = r.text THEN 'same' ELSE 'changed' END AS state, l.text AS left_text, r.text AS right_text FROM left_version l FULL JOIN right_version r USING (line_no)")
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.versions_compared(table(spark, "left_version"), table(spark, "right_version"))


@_query(f"WITH {values('letters')} SELECT source_id, try_strptime(nullif(regexp_extract(text, '(\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}})', 1), ''), '%d.%m.%Y')::DATE AS date, nullif(regexp_extract(text, '(?m)^From: *(.*)$', 1), '') AS sender, nullif(regexp_extract(text, '(?m)^To: *(.*)$', 1), '') AS recipient, len(string_split(text, chr(10)))::INT AS n_lines, NOT contains(text, chr(10)) AS one_block FROM letters".replace("chr(10)", "chr(10)"))
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.summary_fields(table(spark, "letters"))


_SETS = "list_distinct(regexp_extract_all(lower({}), '\\p{{L}}+'))"


@_query(f"""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM conversations),
    s AS (SELECT conv_id, turn, {_SETS.format("text")} AS a, {_SETS.format("before")} AS b FROM t WHERE role = 'assistant' AND before IS NOT NULL)
    SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS relevance FROM s""")
def citation_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = load(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role")))
    pairs = turns.filter("role = 'assistant' AND before IS NOT NULL").select("conv_id", "turn", F.col("text").alias("claim"), F.col("before").alias("passage"))
    return provenance.relevance(pairs).select("conv_id", "turn", "relevance")


@_query(f"WITH {values('criteria')} SELECT criterion, 'one' AS system, one AS score FROM criteria UNION ALL SELECT criterion, 'other', other FROM criteria")
def criteria_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.criteria_long(table(spark, "criteria"), "criterion", ["one", "other"])


_SOURCES = [f"src{i}" for i in range(20)]


@_query(f"SELECT lang, {', '.join(f"count(*) FILTER (source = '{s}') AS {s}" for s in _SOURCES)} FROM documents GROUP BY lang")
def criteria_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    counts = docs.groupBy("lang", F.col("source").alias("system")).agg(F.count("*").alias("score"))
    return provenance.criteria_wide(counts, "lang", _SOURCES).fillna(0)


@_query(f"WITH {_REG}, q(question) AS (VALUES ('record of a person by name'), ('newspaper articles that match'), ('any address'), ('nothing here fits xyz')), k AS (SELECT question, r.name, len(list_intersect({_SETS.format('question')}, {_SETS.format('r.help')})) AS score FROM q, registry r WHERE r.alias IS NULL) SELECT question, arg_max(name, score * 100 - ascii(name) / 1000) AS name, max(score) AS score FROM (SELECT * FROM k WHERE score > 0) GROUP BY question".replace("arg_max(name, score * 100 - ascii(name) / 1000)", "list(name ORDER BY score DESC, name)[1]"))
def skill_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("record of a person by name",), ("newspaper articles that match",), ("any address",), ("nothing here fits xyz",)], "question string")
    skills = registry.canonical(registry.registry(spark)).select("name", F.explode(F.array_distinct(T.words(F.col("help")))).alias("word"))
    hits = asked.select("question", F.explode(F.array_distinct(T.words(F.col("question")))).alias("word")).join(F.broadcast(skills), "word")
    counts = hits.groupBy("question", "name").agg(F.count("*").alias("score"))
    return counts.groupBy("question").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b")).select("question", "b.name", (-F.col("b.s")).alias("score"))


# entities

_MENTIONS = f"m AS (SELECT doc_id, lang, line_no, unnest(regexp_extract_all(line, '(\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)+)', 1)) AS surface FROM (SELECT doc_id, lang, {_LINES} FROM documents))"


@_query(f"WITH {_MENTIONS} SELECT * FROM m")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.mentions(load(spark, sf_dir, "documents"))


@_query(f"WITH {_MENTIONS}, c AS (SELECT lang, surface, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, surface)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def entity_top_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.top_by_language(entities.mentions(load(spark, sf_dir, "documents")))


_KEY = f"translate(lower(surface), '{T.ACCENTED}', '{T.PLAIN}')"


@_query(f"WITH {_MENTIONS}, g AS (SELECT DISTINCT {_KEY} AS key, CASE WHEN length(surface) % 2 = 0 THEN 'place' ELSE 'person' END AS entity_type FROM m) SELECT doc_id, line_no, surface, entity_type FROM m LEFT JOIN g ON key = {_KEY}")
def entity_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entities.mentions(load(spark, sf_dir, "documents"))
    kind = F.when(F.length("surface") % 2 == 0, "place").otherwise("person")
    gazetteer = found.select("surface", kind.alias("entity_type"))
    return entities.typed(found, gazetteer).select("doc_id", "line_no", "surface", "entity_type")


@_query(f"WITH {values('names')}, {values('records')} SELECT name, record_id, full_name FROM names LEFT JOIN records ON {_NORMAL.format('name')} = {_NORMAL.format('full_name')}")
def person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.looked_up(table(spark, "names"), table(spark, "records"))


@_query(f"WITH x AS (SELECT DISTINCT unnest({_WORDS}) AS s FROM benchmark), y AS (SELECT s, {_ASCII.format('s')} AS k FROM x) SELECT a.s AS a, b.s AS b, levenshtein(a.k, b.k)::INT AS distance FROM y a JOIN y b ON abs(length(a.s) - length(b.s)) <= 2 WHERE levenshtein(a.k, b.k) <= 2")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("s")).distinct()
    return entities.fuzzy(words, words)


# series and accounts

_MONTHLY = "m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)"


@_query(f"WITH {_MONTHLY} SELECT month, n, lag(n) OVER (ORDER BY month) AS before, round((n - lag(n) OVER (ORDER BY month)) / lag(n) OVER (ORDER BY month), 9) AS growth FROM m")
def growth_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quant.growth(quant.monthly(load(spark, sf_dir, "orders"))).drop("total")


@_query(f"WITH {_MONTHLY} SELECT month, n, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS average, (sum(n) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM m")
def moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quant.moving_average(quant.monthly(load(spark, sf_dir, "orders"))).drop("total")


_VOTES = "o AS (SELECT r_name, n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")}
    out = tables["orders"].join(tables["customer"], F.col("o_custkey") == F.col("c_custkey")).join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return out.join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "o_orderkey", F.lit(1).alias("vote"))


@_query(f"WITH {_VOTES}, t AS (SELECT r_name, n_name, count(*) AS total, grouping(r_name, n_name)::INT AS level FROM o GROUP BY ROLLUP (r_name, n_name)) SELECT r_name, n_name, total, level, round(CASE level WHEN 0 THEN total / sum(total) FILTER (level = 0) OVER (PARTITION BY r_name) WHEN 1 THEN total / sum(total) FILTER (level = 1) OVER () ELSE 1.0 END, 9) AS share FROM t")
def share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quant.shares(_votes(spark, sf_dir), "r_name", "n_name", "vote")


@_query(f"WITH {_VOTES}, t AS (SELECT r_name, n_name, count(*) AS n FROM o GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY r_name ORDER BY n DESC)::INT AS rank, row_number() OVER (PARTITION BY r_name ORDER BY n DESC, n_name)::INT AS place, ntile(4) OVER (PARTITION BY r_name ORDER BY n DESC, n_name)::INT AS quarter FROM t")
def vote_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quant.ranked(_votes(spark, sf_dir).groupBy("r_name", "n_name").agg(F.count("*").alias("n")), "r_name", "n", "n_name")


@_query("SELECT o_orderpriority, round(regr_slope(o_totalprice, epoch(o_orderdate) / 86400), 6) AS slope, round(regr_r2(o_totalprice, epoch(o_orderdate) / 86400), 6) AS r2, count(*) AS n FROM orders GROUP BY o_orderpriority")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    return quant.trend(load(spark, sf_dir, "orders").withColumn("day", days), "o_orderpriority", "o_totalprice", "day")


@_query(f"WITH {values('usage')}, {values('prices')}, c AS (SELECT model, turn, round((tokens_in * price_in + tokens_out * price_out) / 1000000, 6) AS credits FROM usage JOIN prices USING (model)) SELECT *, round(sum(credits) OVER (PARTITION BY model ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS running FROM c")
def cost_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quant.token_cost(table(spark, "usage"), table(spark, "prices"))


@_query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, grouping(event_type, strftime(ts, '%Y-%m-%d'))::INT AS level, round(sum(value), 4) AS cost, sum((props::JSON->>'k')::INT)::BIGINT AS k FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", F.from_json("props", "k int")["k"].alias("k"))
    return rows.rollup("event_type", "day").agg(F.grouping_id().cast("int").alias("level"), F.round(F.sum("value"), 4).alias("cost"), F.sum("k").alias("k"))


@_query("WITH v AS (SELECT user_id, ts AS since, event_id AS version FROM events WHERE event_type = 'purchase') SELECT e.event_id, e.user_id, max(v.version) AS version_as_of FROM events e LEFT JOIN v ON v.user_id = e.user_id AND v.since <= e.ts AND v.version IS NOT NULL WHERE e.event_type <> 'purchase' GROUP BY e.event_id, e.user_id")
def events_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("version"))
    return quant.as_of(events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "since", "version").select("event_id", "user_id", "version_as_of")


@_query(f"SELECT year(ts)::INT AS year, doc_id, {_FIRST} AS title FROM documents JOIN events ON event_id = doc_id WHERE year(ts) BETWEEN 2020 AND 2024 AND list_has_all({_WORDS}, ['the', 'of']) ORDER BY year, doc_id")
def search_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.article_list(_articles(spark, sf_dir), "the of", 2020, 2024)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the year of the event of the same number, as newspaper articles."""
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.year("ts").alias("year"))
    return load(spark, sf_dir, "documents").join(events, "doc_id").select("doc_id", "text", "year")


@_query(f"WITH {values('periods')} SELECT period, event_id, user_id FROM events JOIN periods ON ts >= starts::TIMESTAMP AND ts < ends::TIMESTAMP")
def events_in_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = table(spark, "periods").select("period", *[F.to_timestamp_ntz(c).alias(c) for c in ("starts", "ends")])
    return quant.in_periods(load(spark, sf_dir, "events"), "ts", F.broadcast(periods), "starts", "ends").select("period", "event_id", "user_id")


# windows over events

_DAY = "INTERVAL 1 DAY"


@_query(f"SELECT time_bucket({_DAY}, ts) AS start, time_bucket({_DAY}, ts) + {_DAY} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(windows.timed(load(spark, sf_dir, "events")))


@_query("WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS start FROM events, (VALUES (0), (1)) t(k)) SELECT start, start + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM b GROUP BY start")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(windows.timed(load(spark, sf_dir, "events")))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(windows.timed(load(spark, sf_dir, "events")))


@_query(_SQL["events_tumbling"])
def events_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_to_table(windows.tumbling(windows.stream(spark, sf_dir)), "complete")


@_query(_SQL["events_sliding"])
def events_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_to_table(windows.sliding(windows.stream(spark, sf_dir)), "complete")


@_query(_SQL["events_session"])
def events_stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_to_table(windows.sessions(windows.stream(spark, sf_dir)), "complete")


@_query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def events_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_to_table(windows.running_totals(windows.stream(spark, sf_dir)), "update", ["user_id"])
