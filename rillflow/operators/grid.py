"""Diffusion on grids of (i, j, v) rows: four-neighbour stencils with replicated borders (inventory E7-E9, G1, F3, C2, C3, C8).

A neighbour is looked up by lag and lead within a row or a column of the grid, so tasks hold single rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import saturate


def gradients(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """d_n, d_s, d_w, d_e: neighbour minus self, zero at the borders. keys: columns that tell images apart."""
    keys = keys or []
    down, along = Window.partitionBy(*keys, "j").orderBy("i"), Window.partitionBy(*keys, "i").orderBy("j")
    near = lambda f, w: F.coalesce(f("v").over(w), F.col("v")) - F.col("v")
    return df.select("*", near(F.lag, down).alias("d_n"), near(F.lead, down).alias("d_s"), near(F.lag, along).alias("d_w"), near(F.lead, along).alias("d_e"))


def coefficient(q0: Column) -> Column:
    """Diffusion coefficient from the gradients and q0 squared."""
    v, d = F.col("v"), [F.col(c) for c in ("d_n", "d_s", "d_w", "d_e")]
    g2 = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3]) / (v * v)
    lap = (d[0] + d[1] + d[2] + d[3]) / v
    q = (F.lit(0.5) * g2 - F.lit(0.0625) * lap * lap) / ((1 + F.lit(0.25) * lap) * (1 + F.lit(0.25) * lap))
    return saturate(1 / (1 + (q - q0) / (q0 * (1 + q0))))


def diffuse(df: DataFrame, q0: float | Column, rate: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """One step: v + rate / 4 * divergence, with the coefficients at the place, its southern and its eastern neighbour.
    q0: a number, or a column that holds each image's own (with_statistic())."""
    keys = keys or []
    c = gradients(df, keys).withColumn("c", coefficient(q0 if isinstance(q0, Column) else F.lit(q0)))
    south = F.coalesce(F.lead("c").over(Window.partitionBy(*keys, "j").orderBy("i")), F.col("c"))
    east = F.coalesce(F.lead("c").over(Window.partitionBy(*keys, "i").orderBy("j")), F.col("c"))
    div = F.col("c") * F.col("d_n") + south * F.col("d_s") + F.col("c") * F.col("d_w") + east * F.col("d_e")
    return c.select(*keys, "i", "j", (F.col("v") + F.lit(0.25 * rate) * div).alias("v"))


def with_statistic(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its image's q0 = variance / mean squared (F3): the images are aggregated before the shuffle, and Spark
    picks the join by the number of images."""
    m, v = F.avg("v"), F.var_pop("v")
    return df.join(df.groupBy(*keys).agg((v / (m * m)).alias("q0")), keys)


def srad(df: DataFrame, keys: list[str], rate: float = 0.5) -> DataFrame:
    """Speckle-reducing diffusion of images: exponential, statistic, both stencils, logarithm."""
    held = with_statistic(df.withColumn("v", F.exp("v")), keys)
    return diffuse(held, F.col("q0"), rate, keys).withColumn("v", F.log("v"))


def block_statistics(df: DataFrame, block: Column, value: str = "x") -> DataFrame:
    """block, n, mean, variance, q0 = variance / mean squared of each block."""
    m, v = F.avg(value), F.var_pop(value)
    return df.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), m.alias("mean"), v.alias("variance"), (v / (m * m)).alias("q0"))
