"""Small inline tables for operators whose subjects the generated tables do not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUESTS = [
    (1, ["dhs", "affaire", "des", "colonels"]),
    (2, ["wikipedia", "affaire", "des", "colonels", "--lang", "en"]),
    (3, ["dodis-person", "Jean", "Pascal", "Delamuraz"]),
    (4, ["enewspaper", "affaire des colonels", "--start-year", "1900", "--end-year", "1950"]),
    (5, ["swissvote", "639"]),
    (6, ["dodis-document", "43445"]),
    (7, ["WIKI", "x"]),
    (8, ["dhs"]),
    (9, ["dhs", "a", "--dry-run", "b"]),
    (10, ["dhs", "-5", "x"]),
    (11, ["nosuch", "x"]),
    (12, ["HELP"]),
    (13, []),
    (14, ["-h"]),
    (15, ["--help", "x"]),
    (16, ["help"]),
    (17, ["enpa-content", "https://example.org/a?b=c", "--input-json", "two words.json"]),
    (18, ["dhs", "  ", "a", "\t"]),
]

CLAIMS = [("Russian reaction", "s1", "wikipedia", 40, 7), ("French reaction", "s1", "wikipedia", 38, 5), ("French reaction", "s2", "dhs", 12, 1), ("Loss of posts", "s2", "dhs", 9, 2), ("Loss of posts", "s3", "dodis", 1, 1), ("Rumour", "s1", "wikipedia", 41, 9)]
REFS = [("s1", 7, 55, "https://dodis.ch/43445", "Letter of the envoy"), ("s1", 5, 53, "", "Langendorf and Streit (2007)"), ("s2", 1, 30, "https://example.org/dictionary", "Historical dictionary"), ("s2", 2, 31, "https://example.org/archive/2", "Archive, box 2"), ("s3", 1, 2, "", "Unsigned note")]
LINKS = [("s1", "s2"), ("s2", "s3"), ("s3", "s1"), ("s3", "s4"), ("s4", "s5"), ("s1", "s4"), ("s6", "s1")]
DECLARED = [("s1",), ("s2",), ("s3",), ("s4",)]
USED = [("s2",), ("s3",), ("s5",), ("s3",)]
VERSIONS = [("s1", 1, 10), ("s1", 2, 20), ("s1", 3, 30), ("s2", 1, 5)]
ANSWERS = [(1, "s1", 1, 15), (2, "s1", 1, 25), (3, "s1", 3, 35), (4, "s2", 1, 99), (5, "s1", 1, 5), (6, "s9", 1, 50)]
USAGE = [(1, "a", 12000, 1300), (2, "a", 20000, 2000), (3, "a", 15000, 1200), (1, "b", 10000, 2000)]
PRICES = [("a", 175, 1400), ("b", 500, 3000)]
CRITERIA = [("citations", 5, 2), ("coverage", 4, 4), ("limits", 5, 3), ("speed", 2, 5)]
LEFT_VERSION = [(1, "Title"), (2, "First line"), (3, "Second line"), (4, "Last")]
RIGHT_VERSION = [(1, "Title"), (2, "First line, corrected"), (3, "Second line"), (5, "Note")]
RECORDS = [(1, "Jean Pascal Delamuraz"), (2, "Ulrich Wille"), (3, "Émile Müller"), (4, "Wille, Ulrich")]
NAMES = [("Delamuraz Jean  Pascal",), ("ULRICH WILLE",), ("Emile Muller",), ("Nobody",)]
LETTERS = [("s1", "From: A. Example\nTo: B. Example\nBern, 18.1.1916\nText [7] and [5]."), ("s2", "One raw block without a head [1]"), ("s3", "Date 3.12.1915\n\nSee [2], [2]")]
TURNS = [(1, "See https://dodis.ch/43445 and https://example.org/a?b=1."), (2, "As https://dodis.ch/43445 shows"), (3, "No address"), (4, "(https://example.org/c)")]
ASKED = [("https://dodis.ch/43445",)]

RUNS = [
    (1, ["dhs", "EAUX"]),
    (2, ["wiki", "The and attion to thanedble the, anea: Eriner thanea", "--lang", "en"]),
    (3, ["wikipedia", "The and attion to thanedble the, anea: Eriner thanea", "--lang", "de"]),
    (4, ["dodis-doc", "43"]),
    (5, ["dodis-document", "not a number"]),
    (6, ["url", "https://thther.example.org/en/685"]),
    (7, ["generic", "http://nowhere.example/"]),
    (8, ["enpa", "the thanea", "--start-year", "2024", "--end-year", "2024"]),
    (9, ["enewspaper", "the", "--end-year", "2023"]),
    (10, ["elite", "Wille", "Ulrich"]),
    (11, ["dodis-p", "Delamuraz", "Jean", "Pascal"]),
    (12, ["votation", "7"]),
    (13, ["dodis", "http://ththre.example.com/anything?page=2&ref=x"]),
    (14, ["enpa-content", "https://thther.example.org/en/685"]),
    (15, ["dhs", "eaux", "--dry-run"]),
    (16, ["dhs"]),
    (17, ["nosuch", "x"]),
]
PERSONS = [("dodis", 1, "Jean Pascal Delamuraz"), ("dodis", 2, "Ulrich Wille"), ("elitesuisse", 7, "Ulrich Wille"), ("elitesuisse", 8, "Émile Müller")]
PERIODS = [("first", "2024-01-03 00:00:00", "2024-01-05 12:00:00"), ("second", "2024-01-05 06:00:00", "2024-01-20 00:00:00"), ("empty", "2024-01-09 00:00:00", "2024-01-09 00:00:00"), ("past", "2023-01-01 00:00:00", "2023-02-01 00:00:00")]
TOOLS = [("python", "Python 3.12.4", "3.12"), ("git", "git version 2.9.0.windows.1", "2.10"), ("java", "17", "17.0.0"), ("node", "v18.19.1", "18.2"), ("none", "not found", "1.0"), ("long", "1.2.3.4", "1.2.3")]
COSTS = [(1, "fetch | one", "1.1"), (2, "index", None), (3, "a \"quoted\", name", "2.5")]

PDF_LINES = [("a.pdf", 1, "Bern, 18 January 1916"), ("a.pdf", 1, "The colonels (both) were moved \\ not dismissed"), ("a.pdf", 2, "Größe, élève — end"), ("b.pdf", 1, "Only line")]
PDF_TITLES = [("a.pdf", "Affaire des colonels"), ("b.pdf", None)]

SCHEMAS = {
    "pdf_lines": (PDF_LINES, "path string, page_no int, line string"),
    "pdf_titles": (PDF_TITLES, "path string, title string"),
    "runs": (RUNS, "case_id int, args array<string>"),
    "persons": (PERSONS, "index string, record_id int, full_name string"),
    "periods": (PERIODS, "period string, starts string, ends string"),
    "tools": (TOOLS, "tool string, found string, least string"),
    "costs": (COSTS, "place int, skill string, credits string"),
    "requests": (REQUESTS, "case_id int, args array<string>"),
    "claims": (CLAIMS, "claim string, source_id string, provider string, claim_line int, ref_no int"),
    "refs": (REFS, "source_id string, ref_no int, line_no int, target_url string, citation string"),
    "links": (LINKS, "src string, dst string"),
    "declared": (DECLARED, "source_id string"),
    "used": (USED, "source_id string"),
    "versions": (VERSIONS, "source_id string, version int, fetched_at int"),
    "answers": (ANSWERS, "answer_id int, source_id string, used int, answered_at int"),
    "usage": (USAGE, "turn int, model string, tokens_in long, tokens_out long"),
    "prices": (PRICES, "model string, price_in long, price_out long"),
    "criteria": (CRITERIA, "criterion string, one int, other int"),
    "left_version": (LEFT_VERSION, "line_no int, text string"),
    "right_version": (RIGHT_VERSION, "line_no int, text string"),
    "records": (RECORDS, "record_id int, full_name string"),
    "names": (NAMES, "name string"),
    "letters": (LETTERS, "source_id string, text string"),
    "turns": (TURNS, "turn int, text string"),
    "asked": (ASKED, "url string"),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = SCHEMAS[name]
    return spark.createDataFrame(rows, schema)


def _literal(value) -> str:  # noqa: ANN001
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]::VARCHAR[]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "NULL" if value is None else str(value)


def values(name: str, rows: list[tuple] | None = None, columns: str | None = None) -> str:
    """A WITH item of SQL that has the same rows."""
    if rows is None:
        rows, schema = SCHEMAS[name]
        columns = ", ".join(c.split(" ")[0] for c in schema.split(", "))
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"
