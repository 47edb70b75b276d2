"""Relational operators over run logs and event traces (inventory N1-N11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_average(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])


def field(lines: DataFrame, n: int, title: str, line: str = "value") -> DataFrame:
    """The n-th blank-separated field of lines that are no comments."""
    return lines.where(~F.col(line).startswith("#")).select(F.get(F.split(F.trim(line), " +"), F.lit(n)).alias(title))


def pivoted(df: DataFrame, key: str, names: str, values: list[str], value: Column) -> DataFrame:
    """One column for each of the named values."""
    return df.groupBy(key).agg(*[F.avg(F.when(F.col(names) == v, value)).alias(v) for v in values])


def speedup(df: DataFrame, base: Column, time: str) -> DataFrame:
    """time of the base row over each row's (N5); the base is one row."""
    one = df.where(base).agg(F.min(time).alias("_base"))
    return df.crossJoin(F.broadcast(one)).withColumn("speedup", F.col("_base") / F.col(time)).drop("_base")


def change_points(df: DataFrame, keys: list[str], order: list[str], watched: str) -> DataFrame:
    """Rows whose watched value differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_last", F.lag(watched).over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col(watched))).drop("_last")


def gaps(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Seconds to the next event of the same keys."""
    following = F.lead(time).over(Window.partitionBy(*keys).orderBy(time, tie))
    return df.withColumn("gap", F.unix_micros(following) - F.unix_micros(time))


def steady_mean(df: DataFrame, keys: list[str], live: str = "live", skip: int = 10) -> DataFrame:
    """most: the largest number of live threads; steady: their mean over the events at which at least a skip-th of that number
    was alive, so that starting and ending do not count (N11)."""
    w = Window.partitionBy(*keys)
    top = df.withColumn("_most", F.max(live).over(w))
    return top.groupBy(*keys).agg(F.max("_most").alias("most"), F.avg(F.when(F.col(live) * skip >= F.col("_most"), F.col(live))).alias("steady"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], delta: Column) -> DataFrame:
    """live: the running sum of delta."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("live", F.sum(delta).over(w))
