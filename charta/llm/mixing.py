"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and normalised. The exponent is bisected,
between 1 (as the corpus is) and 0 (all sources alike), to the smallest one that meets a limit on
repetition, or to the one that meets a target entropy. The weights become token budgets, and each
budget is realised as whole epochs and a part of one: blocks of a source's documents in an order that
hashes decide, then the documents of the block in which the budget ends. Each epoch permutes the
blocks, and the documents in them, anew. All of it is DataFrame
expressions; to the driver come only the totals of each round of the bisection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charta.llm.workdir import written

#: Intervals that one round of the bisection splits the range into, and rounds: the exponent is found to 32**-5.
FAN, STEPS = 32, 5
#: Blocks whose sums are ordered in one task.
GROUP = 1024


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")).cast("long")


def exponent(sources: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None) -> float:
    """The exponent for ``sources`` (source, tokens > 0).

    entropy: the target, in nats; entropy falls as the exponent grows, and the largest exponent that
    reaches it is taken, 0 if none does. max_repeat: no source is seen more than this many times as
    often as the largest one; the smallest exponent that keeps it is taken. With both, the larger of
    the two exponents. Every round tests FAN exponents in one pass.
    """

    def search(good_at_one: bool, meets) -> float:
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            grid = [low + (high - low) * i / FAN for i in range(FAN + 1)]
            row = sources.agg(F.max("tokens").alias("most"), *[F.sum(F.pow("tokens", F.lit(a))).alias(f"s{i}") for i, a in enumerate(grid)]).first()
            if row["most"] is None:
                return 1.0
            tests = meets(grid, row)
            if good_at_one:  # fails up to some exponent, then holds
                first = next((i for i, ok in enumerate(tests) if ok), FAN)
                if first == 0:
                    return grid[0]
                low, high = grid[first - 1], grid[first]
            else:  # holds up to some exponent
                last = max((i for i, ok in enumerate(tests) if ok), default=0)
                if last == FAN:
                    return grid[FAN]
                low, high = grid[last], grid[last + 1]
        return high if good_at_one else low

    def repeats(grid: list[float], _) -> list[bool]:
        most, least = sources.agg(F.max("tokens"), F.min("tokens")).first()
        return [(most / least) ** (1.0 - a) <= max_repeat * (1 + 1e-12) for a in grid]

    def disorder(grid: list[float], row) -> list[bool]:
        sums = [row[f"s{i}"] for i in range(len(grid))]
        terms = sources.agg(*[F.sum(F.pow("tokens", F.lit(a)) / F.lit(s) * F.log(F.pow("tokens", F.lit(a)) / F.lit(s))).alias(f"h{i}") for i, (a, s) in enumerate(zip(grid, sums, strict=True))]).first()
        return [-h >= entropy - 1e-12 for h in terms]

    found = [0.0]
    if max_repeat is not None:
        found.append(search(True, repeats))
    if entropy is not None:
        found.append(search(False, disorder))
    return round(max(found), 7)


def plan(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, target): each source's weight and token budget.

    budget: tokens of the mixture. None: the smallest budget under which every source is seen in full
    at least once.
    """
    power = F.pow("tokens", F.lit(alpha))
    total, cover = sources.agg(F.sum(power), F.max(F.col("tokens") / power)).first()
    scale = (cover or 0.0) if budget is None else budget / (total or 1.0)
    return sources.withColumns({"weight": power / F.lit(total or 1.0), "target": F.round(power * F.lit(float(scale))).cast("long")})


def _mixture(docs: DataFrame, max_repeat: float | None, entropy: float | None, budget: int | None, block: int, seed: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names of our own, told beside, with src, tokens, weight, epochs, copies, blk, mark and tie."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    at = {c: F.col(f"`{c}`") for c in docs.columns}
    mark = F.xxhash64(F.lit(seed), at["doc_id"], at["text"])
    rows = written(
        docs.select(*[at[c].alias(n) for c, n in names.items()], F.coalesce(at["source"].cast("string"), F.lit("\0")).alias("src"), word_count(at["text"]).alias("tokens"), mark.alias("mark"), F.xxhash64(at["doc_id"], F.lit(seed + 1)).alias("tie")),
        "mixing",
    )
    words = rows.filter("tokens > 0")
    sources = written(words.groupBy("src").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    alpha = exponent(sources, max_repeat, entropy)
    targets = plan(sources, alpha, budget)
    targets = written(
        targets.select("src", "weight", F.floor(F.col("target") / F.col("tokens")).alias("epochs"), (F.col("target") % F.col("tokens")).alias("rest"), F.ceil(F.col("docs") / block).cast("long").alias("blocks")),
        "targets",
    )
    # a hash's block is its share of the range of hashes, so blocks in order are documents in order
    blk = F.floor((F.shiftright("mark", 32) + F.lit(1 << 31)) * F.col("blocks") / F.lit(float(1 << 32))).cast("long")
    sums = words.select("src", "tokens", "mark").join(targets, "src").select("src", blk.alias("blk"), "tokens").groupBy("src", "blk").agg(F.sum("tokens").alias("sum"))
    sums = written(_running(sums), "sums")
    sums = sums.join(targets, "src").select("src", "blk", "weight", "epochs", "rest", "sum", "before")
    cut = sums.filter("before < rest and before + sum > rest")
    dealt = words.join(targets.select("src", "blocks"), "src").withColumn("blk", blk).drop("blocks")
    order = Window.partitionBy("src", "blk").orderBy("mark", "tie").rowsBetween(Window.unboundedPreceding, -1)
    narrow = dealt.select("src", "blk", "tokens", "mark", "tie").join(cut, ["src", "blk"])
    inside = narrow.withColumn("first", F.col("before") + F.coalesce(F.sum("tokens").over(order), F.lit(0)) < F.col("rest"))
    # the last document that still begins below the rest tells all others of its block
    edge = inside.groupBy("src", "blk").agg(F.max(F.when(F.col("first"), F.struct("mark", "tie"))).alias("edge"))
    told = sums.join(edge, ["src", "blk"], "left").withColumn("all", F.col("before") + F.col("sum") <= F.col("rest")).withColumn("none", F.col("before") >= F.col("rest"))
    extra = F.when(F.col("none"), 0).when(F.col("all"), 1).otherwise(F.coalesce((F.struct("mark", "tie") <= F.col("edge")).cast("int"), F.lit(0)))
    cols = [*names.values(), "src", "tokens", "mark", "tie", "blk", "weight", "epochs"]
    out = dealt.join(told.select("src", "blk", "weight", "epochs", "all", "none", "edge"), ["src", "blk"]).select(*cols, (F.col("epochs") + extra).cast("long").alias("copies"))
    zero = F.lit(0).cast("long")
    empty = rows.filter("tokens = 0").withColumns({"blk": zero, "weight": F.lit(0.0), "epochs": F.lit(1).cast("long"), "copies": F.lit(1).cast("long")}).select(*cols, "copies")
    return out.unionByName(empty), names


def _running(sums: DataFrame) -> DataFrame:
    """``sums`` (src, blk, sum) with ``before``: the sum of the blocks before. In two levels, so that no task orders all blocks of a hot source."""
    part = F.floor(F.col("blk") / GROUP).alias("part")
    parts = sums.groupBy("src", part).agg(F.sum("sum").alias("sum"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("sum").over(earlier("src").orderBy("part")), F.lit(0)).alias("base"))
    inner = sums.withColumn("part", part).withColumn("inner", F.coalesce(F.sum("sum").over(earlier("src", "part").orderBy("blk")), F.lit(0)))
    return inner.join(parts, ["src", "part"]).select("src", "blk", "sum", (F.col("base") + F.col("inner")).alias("before"))


def mixed(docs: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block: int = 256, seed: int = 0) -> DataFrame:
    """``docs`` with ``tokens`` (long, words), ``weight`` (double, the source's) and ``copies`` (long: how often the mixture has the row).

    Each source gives floor(target / tokens) whole epochs, and of one more the first documents in
    permuted order whose tokens before them stay below the rest of the budget. The order is that of
    blocks of about ``block`` documents by hash, then of documents by hash, so a hot source is cut at
    a block: totals of blocks are summed first, and only the block in which the budget ends is looked
    at by document.

    Rows without words, null and empty texts among them, have copies 1 whatever the budget; they cost
    nothing. A null source is a source. Equal rows are ordered by chance among themselves, the number
    of copies of them together is not. Very long texts count whole. Columns named tokens, weight or
    copies are replaced. An empty table gives no rows.
    """
    new = ("tokens", "weight", "copies")
    out, names = _mixture(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new]), max_repeat, entropy, budget, block, seed)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *new)


def _repeated(out: DataFrame) -> DataFrame:
    """Each row as often as its copies, with the number of the epoch."""
    return out.withColumn("epoch", F.explode(F.transform(F.array_repeat(F.lit(0), F.col("copies").cast("int")), lambda x, i: i.cast("long"))))


def sequenced(docs: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block: int = 256, seed: int = 0) -> DataFrame:
    """The mixture as a sequence: the columns of ``docs`` with epoch, block and place (long), each row as often as its copies.

    Ordered by these three, the blocks of all sources stand in an order that is permuted anew in each
    epoch by a seeded hash, and so do the documents in each block. The order is a sort key, so nothing
    is ordered here; a source's part of an epoch is the first blocks in the order in which it is cut.
    Columns named epoch, block or place are replaced; all else is as in ``mixed``.
    """
    new = ("epoch", "block", "place")
    out, names = _mixture(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new]), max_repeat, entropy, budget, block, seed)
    keys = F.xxhash64(F.lit(seed), "epoch", "src", "blk").alias("block"), F.xxhash64(F.lit(seed + 2), "epoch", "mark", "tie").alias("place")
    return _repeated(out).select(*[F.col(n).alias(c) for c, n in names.items()], "epoch", *keys)


def realised(docs: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block: int = 256, seed: int = 0) -> DataFrame:
    """The mixture: each row as often as its copies, with the columns of ``docs``, whatever their names."""
    out, names = _mixture(docs, max_repeat, entropy, budget, block, seed)
    return _repeated(out).select(*[F.col(n).alias(c) for c, n in names.items()])
