"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as at by this are from or was an he his not they "
    "le la les de des du un une et en est que qui dans pour pas sur au aux avec ce il elle son "
    "der die das und ist in den von zu mit sich des auf für ein eine nicht dem im als auch "
    "el los las una y es por con para su se lo del al más como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; the rule holds for texts of ``least_words`` words or more."""

    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")
    least_words: int = 0


#: The threshold table. Measures: see ``measures``.
RULES = (
    Rule("mean word length", "mean_word", 1.5, 20.0),
    Rule("symbols to words", "symbol_ratio", high=0.3),
    Rule("exclamation marks to words", "shout_ratio", high=0.5, least_words=20),
    Rule("stop words to words", "stop_ratio", 0.01, least_words=60),
    Rule("repeated lines", "dup_line_ratio", high=0.5),
    Rule("words equal to the word before", "echo_ratio", high=0.3, least_words=10),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though it is used often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def repeat_words(words: Column, k: int = 5) -> Column:
    """Number of words in windows of ``k`` words that occur twice or more, the first occurrence included.

    Windows are compared by 64-bit hashes. Sorted by hash and place, equal windows stand together; the
    places of those, in order, cover min(k, gap to the place before) words each.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(k)]))

    def covered(hashes: Column) -> Column:
        def places(pairs: Column) -> Column:
            equal = lambda p, j: F.coalesce(F.get(pairs, j)["h"] == p["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(pairs, lambda p, i: equal(p, i - 1) | equal(p, i + 1)), lambda p: p["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(k)).otherwise(F.least(F.lit(k), p - F.get(at, i - 1))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(_let(pairs, places), total))

    return F.when(F.size(words) >= k, _let(windows, covered)).otherwise(F.lit(0).cast("long"))


def measures(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a struct ``quality`` of counts and ratios of the text; null texts have no words and no lines."""
    text = F.coalesce(F.col(column), F.lit(""))

    def of(words: Column) -> Column:
        rows = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
        n = F.size(words)
        share = lambda x, of_: F.coalesce(F.try_divide(x, of_), F.lit(0.0))
        chars = F.length(F.array_join(words, ""))
        symbols = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
        echoes = F.size(F.filter(words, lambda w, i: F.when(i > 0, w == F.get(words, i - 1)).otherwise(False)))
        return _let(
            rows,
            lambda x: F.struct(
                n.cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                share(chars, n).alias("mean_word"),
                share(symbols, n).alias("symbol_ratio"),
                share(F.length(text) - F.length(F.regexp_replace(text, "!", "")), n).alias("shout_ratio"),
                share(stops, n).alias("stop_ratio"),
                share(F.size(x) - F.size(F.array_distinct(x)), F.size(x)).alias("dup_line_ratio"),
                share(echoes, n).alias("echo_ratio"),
            ),
        )

    return df.withColumn("quality", _let(text_words(text), of))


def compiled(rules: tuple[Rule, ...], quality: str = "quality") -> Column:
    """Array of the names of the rules that a text breaks."""
    broken = [F.when((F.col(f"{quality}.n_words") >= r.least_words) & ~F.col(f"{quality}.{r.measure}").between(r.low, r.high), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*broken))


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """``df`` with quality (struct of measures), base_failed, broken (names of broken rules) and kept; columns of these names are replaced.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words in
    repeated windows. kept: neither that nor a broken rule. Null and empty texts fail. The result
    depends on the row's text alone; repeated rows are judged alike; an empty table gives no rows.
    """
    out = measures(df.drop("quality"), column)
    base = (F.col("quality.n_words") < min_words) | (100 * F.col("quality.n_repeat_words") > max_repeat_percent * F.col("quality.n_words"))
    out = out.withColumns({"base_failed": base, "broken": compiled(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
