"""Global order without one task that holds it all (inventory H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with ``rank`` from 0 in the order of these columns, nulls first.

    Rows are dealt to ranges of the whole order (Spark samples the bounds), so rows that agree in the first columns only are
    told apart by the others, and sorted within their range. A rank is the rows before the range, a prefix sum over one row
    for each range, plus the place within it. The sorted rows are checkpointed: both sums must see the same ranges, also
    where a lost executor makes Spark sample again."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each of n ranges
    offsets = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    rank = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")
    return placed.withColumn("_p", part).join(offsets, F.col("_p") == F.col("_part")).withColumn("rank", rank).drop("_at", "_p", "_part", "_before")
