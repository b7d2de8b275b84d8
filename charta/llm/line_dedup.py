"""Line deduplication against levelled sorted runs of line hashes.

A run is a bucketed table (hash, n): in how many documents of its batches a line occurs, sorted by
hash within buckets. A new batch merge-anti-joins the runs, so that lines already known to be
frequent are not counted again, and adds its own run at level 0; when a level has ``fan_in`` runs
they are compacted into one run of the next level. Runs are bucketed alike, so the joins read them in
order without a shuffle of the runs. The number of buckets follows the number of lines. The runs are
tables while they are built and dropped once the frequent lines are written. Everything is built-in
expressions; line texts are never moved, only their hashes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charta.llm.workdir import fresh_path, written

#: Lines that a bucket of a run is meant for, and rows of a table of hashes or masks that is broadcast, counted first.
BUCKET_LINES, BROADCAST_ROWS = 100_000, 200_000
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """Lines of a text at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def key_hash(key: Column, least_length: int) -> Column:
    """128-bit hash of a key; null for a key shorter than ``least_length``."""
    return F.when(F.length(key) >= least_length, F.unhex(F.md5(key)))


class LineRuns:
    """Levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 2, buckets: int = 12) -> None:
        self.spark, self.min_docs, self.fan_in, self.buckets = spark, min_docs, fan_in, buckets
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", fresh_path(self.spark, name)).format("parquet").saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unknown(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (hash, ...) whose line no run has in ``min_docs`` documents yet."""
        for run in self.runs():
            keys = keys.join(run.filter(F.col("n") >= self.min_docs).hint("merge"), "hash", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """A batch: ``keys`` (hash) has a row for each document and distinct line."""
        self._push(self._run(self.unknown(keys.groupBy("hash").agg(F.count("*").alias("n")))), 0)

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            self._push(self._run(self._merged(self.levels[level])), level + 1)
            self.levels[level] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Full merge joins of sorted runs; a hash is at most once in each."""
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))

        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.hint("merge").join(b.withColumnRenamed("n", "m"), "hash", "full").select("hash", (zero("n") + zero("m")).alias("n"))

        return reduce(both, runs)

    def compact(self) -> DataFrame:
        """All runs as one, (hash, n); n is exact for lines below ``min_docs`` and a lower bound from there on."""
        runs = self.runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels] + [[self._run(self._merged(runs))]]
            runs = self.runs()
        return runs[0]

    def close(self) -> None:
        """Take the runs out of the catalog; nothing may read them any more."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables, self.levels = [], []


def _frequent(spark: SparkSession, hashed: DataFrame, min_docs: int, batches: int, fan_in: int) -> DataFrame:
    """(hash) of the lines that ``min_docs`` rows of ``hashed`` (row, hashes) or more have, written."""
    total = hashed.agg(F.sum(F.size("hashes"))).first()[0] or 0
    store = LineRuns(spark, min_docs, fan_in, max(1, -(-total // (batches * BUCKET_LINES))))
    batch = F.pmod(F.xxhash64("row"), F.lit(batches))
    # distinct over text is by hash in Spark, over bytes it compares all pairs
    distinct = F.array_distinct(F.transform("hashes", F.hex))
    try:
        for i in range(batches):
            store.add(hashed.filter(batch == i).select(F.explode(distinct).alias("hash")).filter("hash is not null").select(F.unhex("hash").alias("hash")))
        return written(store.compact().filter(F.col("n") >= min_docs).select("hash"), "frequent")
    finally:
        store.close()


def _near(df: DataFrame) -> DataFrame:
    """A written table, broadcast where its rows, counted, are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _decided(docs: DataFrame, min_docs: int, least_length: int, batches: int, fan_in: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of our own, told beside, with lines, dropped and kept."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    doc_id, text = (F.col(names[c]) for c in ("doc_id", "text"))
    row = F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))))
    hashes = F.transform(lines(text), lambda x: key_hash(line_key(x), least_length))
    hashed = written(docs.select(row.alias("row"), hashes.alias("hashes")), "line_hashes")
    frequent = _frequent(docs.sparkSession, hashed, min_docs, batches, fan_in)

    # rows that are equal in doc_id and text have equal places, so each counts once
    places = hashed.select("row", F.posexplode("hashes").alias("place", "hash")).join(_near(frequent), "hash").select("row", "place")
    hits = places.groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("at"))
    # 1 at the place of each line that goes, 0 before it
    marks = F.transform("at", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i == 0, F.lit(-1)).otherwise(F.get("at", i - 1)) - 1), F.lit("1")))
    masks = written(hits.select("row", F.array_join(marks, "").alias("mask")), "masks")
    out = docs.withColumn("row", row).join(masks, "row", "left").drop("row").withColumn("lines", lines(text))
    gone = F.split("mask", "")
    dropped = F.transform(gone, lambda x: x == "1")
    out = out.withColumn("dropped", F.when(F.col("mask").isNotNull(), F.concat(F.slice(dropped, 1, F.length("mask")), F.array_repeat(F.lit(False), F.size("lines") - F.length("mask")))).otherwise(F.array_repeat(F.lit(False), F.size("lines"))))
    kept = F.when(F.col("mask").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter("lines", lambda x, i: ~F.get("dropped", i)), "\n"))
    return out.withColumn("kept", kept).drop("mask"), names


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, least_length: int = 1, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """``docs`` with ``lines`` (array<string>, all), ``dropped`` (array<boolean>, for each line) and ``kept`` (string).

    A line goes, in every document, when its key (see ``line_key``) has ``least_length`` code points
    or more and occurs in ``min_docs`` rows of ``docs`` or more; a line's repeats within a text count
    once. ``kept`` joins the others with line feeds; it is empty if all are dropped.

    Null and empty texts are one empty line, which stays while least_length is 1 or more. Each row is
    a document, also when rows repeat or doc_id is null; rows that are equal in doc_id and text share
    one decision. Very long texts are looked at whole, in time that grows with their lines. Columns
    named lines, dropped or kept are replaced. An empty table gives no rows.
    """
    new = ("lines", "dropped", "kept")
    out, names = _decided(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new]), min_docs, least_length, batches, fan_in)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *new)


def cleaned(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The columns of ``docs``, whatever their names, with frequent lines gone from ``text`` and n_chars, if there, counted anew. Null texts stay null."""
    out, names = _decided(docs, min_docs, 1, 4, 2)
    text = F.when(F.col(names["text"]).isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])
