"""Connector registry and request dispatch, as column expressions over tables of requests.

A request is an array of tokens. The first one names a connector, by its name or an alias; the tokens
up to the first that begins with a dash are the connector's main value, the rest passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = "ordinal int, name string, alias string, script string, flag string, help string"

#: Connectors with their main flag, in order; a connector's aliases follow it.
CONNECTORS = [
    ("dhs", "--term", "Article of the historical dictionary, by term", []),
    ("wikipedia", "--title", "Encyclopedia article, by title", ["wiki"]),
    ("dodis", "--url", "Results of a document search, by address", []),
    ("dodis-person", "--name", "Record of a person from the index, by name", ["dodis-p"]),
    ("dodis-document", "--document-id", "Document, by identifier", ["dodis-doc"]),
    ("elitesuisse", "--name", "Record of a person from the index of elites, by name", ["elite"]),
    ("enewspaper", "--query", "Newspaper articles that match a query", ["enpa"]),
    ("enewspaper-content", "--article-url", "Content of a newspaper article, by address", ["enpa-content"]),
    ("url", "--url", "Any document, by address", ["generic"]),
    ("swissvote", "--votation-id", "Official sources of a vote, by identifier", ["votation"]),
]
#: Tokens that ask for help; they are matched as they are written.
HELP_WORDS = ["-h", "--help", "help"]
#: What the examples of the help text ask for, one each line.
EXAMPLES = [
    'dhs "affaire des colonels"', "dhs affaire des colonels", 'wikipedia "affaire des colonels"', "wikipedia affaire des colonels --lang de",
    'dodis-person "Jean Pascal Delamuraz"', 'elitesuisse "Thierry Pun"', 'enewspaper "affaire des colonels" --start-year 1900 --end-year 1960',
    'enewspaper-content "https://www.e-newspaperarchives.ch/?a=d&d=..."', 'url "https://example.com/document.pdf"', "swissvote 639",
    'dodis "https://dodis.ch/search?q=panama&c=Document"', "dodis-document 43445",
]
#: Lines before the connectors, before the examples and before the options.
HEADS = (["Usage: fetch <source> <request> [further options]", "", "Sources:"], ["", "Examples:"], ["", "Options, passed on to the connector:"])
#: Options that every connector gets passed through.
OPTIONS = [("--dry-run", "Check without downloading"), ("--out-dir <dir>", "Folder for output"), ("--help", "The connector's own help")]
#: Arguments that the wrapper of the database commands hands on.
WRAPPER_ARGUMENTS = 9


def registry_rows() -> list[tuple]:
    rows: list[tuple] = []
    for name, flag, text, aliases in CONNECTORS:
        rows.append((len(rows), name, None, f"connectors/{name}.py", flag, text))
        for alias in aliases:
            rows.append((len(rows), alias, name, None, None, None))
    return rows


def registry(spark: SparkSession) -> DataFrame:
    """All names, aliases included; a few rows, whatever the corpus."""
    return spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)


def resolved(registry_: DataFrame) -> DataFrame:
    """(key, name, script, flag): every key with the connector it stands for. An alias is followed once."""
    target = registry_.select(F.col("name").alias("target"), F.col("script").alias("t_script"), F.col("flag").alias("t_flag"), F.col("alias").alias("t_alias"))
    keyed = registry_.select(F.col("name").alias("key"), F.coalesce("alias", "name").alias("target"))
    return keyed.join(F.broadcast(target), "target").select("key", F.col("target").alias("name"), F.col("t_script").alias("script"), F.col("t_flag").alias("flag"))


def canonical(registry_: DataFrame) -> DataFrame:
    """The connectors themselves, without aliases."""
    return registry_.filter(F.col("alias").isNull())


def aliases(registry_: DataFrame) -> DataFrame:
    """(name, aliases, listed): each connector's aliases in registry order, and as text."""
    grouped = registry_.filter(F.col("alias").isNotNull()).groupBy(F.col("alias").alias("name")).agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("found"))
    out = canonical(registry_).select("name").join(F.broadcast(grouped), "name", "left")
    names = F.coalesce(F.col("found.name"), F.array().cast("array<string>"))
    return out.select("name", names.alias("aliases")).withColumn("listed", F.when(F.size("aliases") > 0, F.concat(F.lit("  (alias: "), F.array_join("aliases", ", "), F.lit(")"))).otherwise(""))


def help_lines(registry_: DataFrame) -> DataFrame:
    """(line_no, line): the help text: usage, each connector with its aliases, description and usage, examples and options."""
    rows = canonical(registry_).join(aliases(registry_).select("name", "listed"), "name")
    each = rows.select("ordinal", F.posexplode(F.array(F.concat(F.lit("  "), "name", "listed"), F.concat(F.lit("    "), "help"), F.concat(F.lit("    fetch "), "name", F.lit(" <"), F.regexp_replace("flag", "^-+", ""), F.lit(">")))).alias("part", "line"))
    spark = registry_.sparkSession
    tail = spark.createDataFrame(help_frame(), "ordinal int, part int, line string")
    spot = F.struct("ordinal", "part")
    lines = each.unionByName(tail).agg(F.sort_array(F.collect_list(F.struct(spot.alias("spot"), "line"))).alias("all"))
    return lines.select(F.posexplode(F.col("all.line")).alias("line_no", "line")).select((F.col("line_no") + 1).alias("line_no"), "line")


def help_frame() -> list[tuple[int, int, str]]:
    """(block, line, text) of the help text around the connectors, which are blocks 0 and up."""
    blocks = {-1: HEADS[0], 10_000: [*HEADS[1], *[f"  fetch {e}" for e in EXAMPLES]], 10_001: [*HEADS[2], *[f"  {o:<18}{text}" for o, text in OPTIONS]]}
    return [(block, i, line) for block, lines in blocks.items() for i, line in enumerate(lines)]


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def split_request(tokens: Column) -> tuple[Column, Column]:
    """(main value, passed through) of the tokens after the name."""
    flags = F.transform(tokens, lambda t: t.startswith("-"))
    first = F.array_position(flags, F.lit(True)).cast("int")
    size = F.size(tokens)
    head = F.when(first > 0, F.slice(tokens, F.lit(1), first - 1)).otherwise(tokens)
    tail = F.when(first > 0, F.slice(tokens, first, size - first + 1)).otherwise(F.array().cast("array<string>"))
    return stripped(F.array_join(head, " ")), tail


def wrapped(arguments: Column) -> Column:
    """The arguments that the database wrapper hands on: the first nine."""
    return F.slice(arguments, 1, WRAPPER_ARGUMENTS)


def dispatched(requests: DataFrame, registry_: DataFrame, root: str = "", scripts: DataFrame | None = None) -> DataFrame:
    """Every request (case_id, args) with what its dispatch comes to.

    outcome: help, unknown, missing (its script is not in ``scripts`` (script), if given) or run;
    exit_code 0, 2, 2 and null; name, main value, extra tokens, command and trace line of those that
    run. Help words are matched before the name is lower-cased. Without a main value and extra tokens
    the connector is asked for its help.
    """
    first = F.get("args", F.lit(0))
    asked = requests.withColumn("is_help", (F.size("args") <= 0) | F.coalesce(first.isin(HELP_WORDS), F.lit(False)))
    asked = asked.withColumn("key", F.when(~F.col("is_help"), F.lower(first)))
    out = asked.join(F.broadcast(resolved(registry_)), "key", "left")
    if scripts is not None:
        there = scripts.select("script", F.lit(True).alias("there")).distinct()
        out = out.join(F.broadcast(there) if scripts.limit(10_001).count() <= 10_000 else there, "script", "left")
    else:
        out = out.withColumn("there", F.lit(True))
    main, extra = split_request(F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))))
    out = out.withColumns({"main": main, "extra": extra})
    out = out.withColumn("extra", F.when((F.col("main") == "") & (F.size("extra") == 0), F.array(F.lit("--help"))).otherwise(F.col("extra")))
    outcome = F.when(F.col("is_help"), "help").when(F.col("name").isNull(), "unknown").when(~F.coalesce("there", F.lit(False)), "missing").otherwise("run")
    out = out.withColumn("outcome", outcome)
    runs = F.col("outcome") == "run"
    value = F.when(F.col("main") != "", F.array("flag", "main")).otherwise(F.array().cast("array<string>"))
    command = F.concat(F.array(F.lit("python"), F.lit("-u"), F.concat(F.lit(root), "script")), value, F.col("extra"))
    shown = F.array_join(F.transform(F.slice(command, F.lit(4), F.greatest(F.size(command) - 3, F.lit(0))), lambda a: F.when(a.contains(" "), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ")
    trace = F.concat(F.lit("[fetch:"), "name", F.lit("] "), F.regexp_extract("script", "([^/]*)$", 1), F.lit(" "), shown)
    return out.select(
        "case_id",
        "outcome",
        F.when(F.col("outcome") == "help", 0).when(~runs, 2).alias("exit_code"),
        F.when(runs, F.col("name")).alias("name"),
        F.when(runs, F.col("main")).alias("main"),
        F.when(runs, F.col("extra")).alias("extra"),
        F.when(runs, command).alias("command"),
        F.when(runs, trace).alias("trace"),
    )


def unknown(requests: DataFrame, registry_: DataFrame) -> DataFrame:
    """Requests whose name no connector or alias has."""
    first = F.get("args", F.lit(0))
    named = requests.filter((F.size("args") > 0) & ~first.isin(HELP_WORDS)).withColumn("key", F.lower(first))
    return named.join(F.broadcast(registry_.select(F.col("name").alias("key"))), "key", "left_anti").select("case_id", "key")
