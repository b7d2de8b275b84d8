"""Series and accounts: growth, moving averages, shares, trends, costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def growth(series: DataFrame, key: str = "month", value: str = "n") -> DataFrame:
    """Change of a series against the step before. The window is over the aggregated series, one row a step."""
    before = F.lag(value).over(Window.orderBy(key))
    return series.withColumn("before", before).withColumn("growth", F.round((F.col(value) - before) / before, 9))


def moving_average(series: DataFrame, key: str = "month", value: str = "n", before: int = 2) -> DataFrame:
    frame = Window.orderBy(key).rowsBetween(-before, 0)
    return series.withColumn("average", F.round(F.avg(value).over(frame), 6)).withColumn("running", F.sum(value).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))


def shares(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Roll-up of a value over two levels, with each row's share of the level above."""
    out = rows.rollup(outer, inner).agg(F.sum(value).alias("total"), F.grouping_id().cast("int").alias("level"))
    above = F.sum(F.when(F.col("level") == 0, F.col("total"))).over(Window.partitionBy(outer))
    whole = F.sum(F.when(F.col("level") == 1, F.col("total"))).over(Window.partitionBy())
    return out.withColumn("share", F.round(F.when(F.col("level") == 0, F.col("total") / above).when(F.col("level") == 1, F.col("total") / whole).otherwise(1.0), 9))


def trend(rows: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Slope and fit of a straight line in each group."""
    return rows.groupBy(by).agg(F.round(F.regr_slope(F.col(y), F.col(x)), 6).alias("slope"), F.round(F.regr_r2(F.col(y), F.col(x)), 6).alias("r2"), F.count("*").alias("n"))


def ranked(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(value), key)
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(by).orderBy(F.desc(value)))).withColumn("place", F.row_number().over(w)).withColumn("quarter", F.ntile(4).over(w))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of usage rows (turn, model, tokens_in, tokens_out) by price a million tokens, with the running sum."""
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000
    out = usage.join(F.broadcast(prices), "model").withColumn("credits", F.round(cost.cast("double"), 6))
    return out.withColumn("running", F.round(F.sum("credits").over(Window.partitionBy("model").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)), 6)).select("model", "turn", "credits", "running")


def in_periods(rows: DataFrame, at: str, periods: DataFrame, start: str, end: str, days: int = 7) -> DataFrame:
    """Each row with every period that holds its time (start <= at < end), as an equi-join.

    Periods are cut into spans of ``days`` days and rows meet the spans that they fall into, so no row
    meets periods far from it. Periods with a null bound, or that end before they start, hold nothing.
    """
    width = days * 86400
    span = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / width)
    spans = periods.filter(F.col(start) < F.col(end)).withColumn("__span", F.explode(F.sequence(span(F.col(start)), span(F.col(end)))))
    met = rows.withColumn("__span", span(F.col(at))).join(spans, "__span").drop("__span")
    return met.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each left row with the last value of its key that right has at or before it.

    Both sides are stacked and one window carries the last value forward, so rows shuffle once and no
    pairs are made.
    """
    a = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    z = right.select(key, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("__row"), F.col(value).alias("__v"))
    last = F.last("__v", ignorenulls=True).over(Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(z).withColumn("__last", last).filter("__side = 1").select("__row.*", F.col("__last").alias(f"{value}_as_of"))
