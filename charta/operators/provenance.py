"""Provenance: citations, reference chains, and audits of what was declared, used and cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charta.functions.text import lines
from charta.operators.lexical import overlap
from charta.sources.workdir import written

#: Item keys up to this number, items up to this many characters and pairs of document and item up to this number are broadcast; more are joined by shuffle.
KEYS, CHARS, PAIRS = 1_000_000, 16_000_000, 100_000
#: Units of a window that are hashed one by one; longer windows are sliced.
WIDE = 16


def cited(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, line_no): where whole texts hold an item's text word for word, by the line in which it begins.

    An item may run over several lines. White space around an item's inner words stands in the
    document too, so windows of as many words of the document join by the hash of the first inner
    words, whatever quote, bracket or letter stands at the item's ends; items without inner words
    join by windows of characters. What meets is searched for the whole item, as it is. Empty and
    null items and null texts give nothing.
    """
    k = 5
    asked = items.filter(F.length("text") > 0).select("item_id", F.col("text").alias("item"), F.split("text", r"\s+", -1).alias("w"))
    inner = F.size("w") > 2
    head = F.when(inner, F.slice("w", F.lit(2), F.least(F.size("w") - 2, F.lit(k)))).otherwise(F.split("item", "", -1))
    keyed = asked.select("item_id", inner.alias("inner"), head.alias("head")).select("item_id", "inner", F.size("head").alias("k"), F.xxhash64("head").alias("hash"))
    shapes = keyed.groupBy("inner", "k").count().collect()  # at most k sizes of words, and lengths of items of one or two words
    if not shapes:
        return docs.join(items.filter(F.lit(False)).select("item_id"), F.lit(False)).select("item_id", "doc_id", F.lit(1).alias("line_no"))

    def windows(units: str, size: int) -> Column:
        # the hash of some values is that of an array of them
        own = (lambda i: F.xxhash64(*[F.get(units, i + d) for d in range(size)])) if size <= WIDE else (lambda i: F.xxhash64(F.slice(units, i + 1, F.lit(size))))
        each = F.transform(F.sequence(F.lit(0), F.size(units) - size), own)
        return F.when(F.size(units) >= size, each).otherwise(F.array().cast("array<bigint>"))

    split = {"w": F.split("text", r"\s+", -1)} | ({} if all(s["inner"] for s in shapes) else {"c": F.split("text", "", -1)})
    each = [windows("w" if s["inner"] else "c", s["k"]) for s in shapes]
    found = docs.filter(F.col("text").isNotNull()).withColumns(split).select("doc_id", F.explode(F.flatten(F.array(*each))).alias("hash"))
    keys = keyed.select("hash", "item_id")
    met = found.join(F.broadcast(keys) if sum(s["count"] for s in shapes) <= KEYS else keys, "hash").select("doc_id", "item_id").distinct()
    pairs = met.limit(PAIRS + 1).collect()
    near = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(pairs, met.schema)) if len(pairs) <= PAIRS else met, "doc_id")
    texts = asked.select("item_id", "item")
    both = near.join(F.broadcast(texts) if texts.agg(F.sum(F.length("item"))).first()[0] <= CHARS else texts, "item_id").filter(F.contains("text", "item"))
    # cut before every occurrence, overlapping ones too: all cuts but perhaps the first begin with one
    cuts = F.split("text", F.concat(F.lit("(?=\\Q"), F.replace("item", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)")), -1)
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("begin"))

    def step(done: Column, cut: Column) -> Column:
        line = done["line"] + F.length(cut) - F.length(F.replace(cut, F.lit("\n"), F.lit("")))
        return F.struct(line.alias("line"), F.when(F.get(done["begin"], F.size(done["begin"]) - 1) == line, done["begin"]).otherwise(F.concat(done["begin"], F.array(line))).alias("begin"))

    found = both.select("item_id", "doc_id", F.startswith("text", "item").alias("first"), cuts.alias("cuts"))
    later = F.aggregate(F.slice("cuts", F.lit(1), F.size("cuts") - 1), start, step, lambda done: done["begin"])
    begun = F.when(F.col("first"), F.concat(F.array(F.lit(1)), later)).otherwise(later)
    return found.select("item_id", "doc_id", F.explode(begun).alias("line_no")).distinct()


def uncovered(sources: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Sources in which nothing was found (anti join)."""
    return sources.join(matches, keys, "left_anti")


def references(docs: DataFrame) -> DataFrame:
    """(source_id, line_no, ref_no): marks like [7] in lines of documents (source_id, text)."""
    found = docs.select("source_id", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    marks = F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), F.lit(1))
    return found.select("source_id", (F.col("at") + 1).alias("line_no"), F.explode(marks).alias("ref")).select("source_id", "line_no", F.col("ref").cast("int").alias("ref_no"))


def resolved(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """Claims (source_id, ref_no, ...) with the target of their reference."""
    return claims.join(refs.select("source_id", "ref_no", F.col("line_no").alias("ref_line"), "target_url", "citation"), ["source_id", "ref_no"], "left")


def hops(links: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, hop): what a chain of references (src, dst) reaches from ``start`` in at most ``depth`` steps, by the fewest steps.

    Each step expands the nodes found last and leaves out those found before, so a node is expanded
    once, however many paths lead to it. Nothing is gathered by the driver but whether a step found any.
    """
    spark, edges = links.sparkSession, links.select("src", "dst").distinct()
    last = seen = written(spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hop")), "hops")
    for hop in range(1, depth + 1):
        found = edges.join(last, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).filter("node is not null").distinct()
        last = written(found.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen


#: What a target's address or citation shows about the kind of evidence, first match counts.
EVIDENCE_RULES = [("primary", r"(?i)dodis\.ch|archive|letter|transcript"), ("secondary", r"(?i)\(\d{4}\)|dictionary|wikipedia|book|history")]


def evidence_class(citation: Column) -> Column:
    out = F.lit("unclassified")
    for kind, pattern in reversed(EVIDENCE_RULES):
        out = F.when(citation.rlike(pattern), kind).otherwise(out)
    return out


def declared_and_used(declared: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and state: sources that were declared only, used only, or both."""
    a = declared.select(*keys).distinct().withColumn("d", F.lit(1))
    z = used.select(*keys).distinct().withColumn("u", F.lit(1))
    state = F.when(F.col("u").isNull(), "declared only").when(F.col("d").isNull(), "used only").otherwise("both")
    return a.join(z, keys, "full").withColumn("state", state).select(*keys, "state")


def only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference of two inventories."""
    return a.exceptAll(b)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """What two inventories have in common, each row once."""
    return a.intersect(b)


ADDRESS = r"https?://[^\s)\]>\"']+"


def cited_addresses(turns: DataFrame, requested: DataFrame) -> DataFrame:
    """(url, host, n, was_requested): addresses in answers, and whether anyone asked for them."""
    urls = turns.select(F.explode(F.regexp_extract_all("text", F.lit(f"({ADDRESS})"), F.lit(1))).alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    asked = requested.select("url").distinct().withColumn("r", F.lit(True))
    return urls.join(asked, "url", "left").select("url", F.expr("try_parse_url(url, 'HOST')").alias("host"), "n", F.coalesce("r", F.lit(False)).alias("was_requested"))


def uncited_answers(turns: DataFrame) -> DataFrame:
    """Assistant turns without a mark like [1] and without an address."""
    answers = turns.filter("role = 'assistant'")
    return answers.filter(~F.coalesce(F.col("text").rlike(rf"\[\d+\]|{ADDRESS}"), F.lit(False))).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


def relevance(claims: DataFrame) -> DataFrame:
    """Claims (claim, passage, ...) with the share of words that claim and cited passage have in common."""
    return claims.withColumn("relevance", F.round(overlap(F.col("claim"), F.col("passage")), 6))


def stale_versions(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """(answer_id, source_id, used, current, stale): the version that was current when an answer was given (as-of, by aggregation) beside the one it used."""
    seen = answers.join(versions.select("source_id", "version", "fetched_at"), "source_id", "left")
    known = F.when(F.col("fetched_at") <= F.col("answered_at"), F.struct("fetched_at", "version"))
    current = seen.groupBy("answer_id", "source_id", "used").agg(F.max(known).alias("k"))
    return current.select("answer_id", "source_id", "used", F.col("k.version").alias("current"), F.coalesce(F.col("used") < F.col("k.version"), F.lit(False)).alias("stale"))


def triangulated(claims: DataFrame) -> DataFrame:
    """(claim, providers, primary, secondary, triangulated): by how many providers and kinds of evidence a claim is backed."""
    kinds = [F.count_if(F.col("evidence_class") == k).alias(k) for k in ("primary", "secondary")]
    return claims.groupBy("claim").agg(F.countDistinct("provider").alias("providers"), *kinds).withColumn("triangulated", F.col("providers") >= 2)


def versions_compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(line_no, state, left_text, right_text): two versions (line_no, text) line by line."""
    x, y = a.select("line_no", F.col("text").alias("left_text")), b.select("line_no", F.col("text").alias("right_text"))
    state = F.when(F.col("left_text").isNull(), "added").when(F.col("right_text").isNull(), "removed").when(F.col("left_text") == F.col("right_text"), "same").otherwise("changed")
    return x.join(y, "line_no", "full").withColumn("state", state).select("line_no", "state", "left_text", "right_text")


def summary_fields(docs: DataFrame) -> DataFrame:
    """(source_id, date, sender, recipient, n_lines, one_block): what the head of a letter shows, and whether its text is one unbroken block."""
    date = F.expr(r"try_to_timestamp(nullif(regexp_extract(text, '(\\d{1,2}\\.\\d{1,2}\\.\\d{4})', 1), ''), 'd.M.yyyy')").cast("date")
    field = lambda name: F.nullif(F.regexp_extract("text", rf"(?m)^{name}: *(.*)$", 1), F.lit(""))
    n = F.size(lines(F.col("text")))
    return docs.select("source_id", date.alias("date"), field("From").alias("sender"), field("To").alias("recipient"), n.alias("n_lines"), (n == 1).alias("one_block"))


def criteria_long(matrix: DataFrame, key: str, systems: list[str]) -> DataFrame:
    """A matrix of criteria by system as (key, system, score)."""
    return matrix.unpivot(key, systems, "system", "score")


def criteria_wide(scores: DataFrame, key: str, systems: list[str]) -> DataFrame:
    return scores.groupBy(key).pivot("system", systems).agg(F.first("score"))
