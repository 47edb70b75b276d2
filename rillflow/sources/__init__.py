"""Streams and grids from tables (inventory A1-A4, A8-A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lcg, pack_rgba


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream: seq, x."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.col("value").alias("x"))


def grid(spark: SparkSession, sf_dir: str, width: int = 100) -> DataFrame:
    """events as a grid of positive values: i, j, v."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / width).alias("i"), (F.col("event_id") % width).alias("j"), (F.abs("value") + 1.0).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as rows of doubles: vec_id, xs."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("xs"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines; splits never cut a line."""
    return spark.read.text(path)


def lcg_sequence(spark: SparkSession, n: int) -> DataFrame:
    """seq, x: the first n values of the integer generator (A5), made in parallel."""
    return spark.range(n).select(F.col("id").alias("seq"), lcg(F.col("id")).alias("x"))


def images(spark: SparkSession, sf_dir: str, width: int = 100, height: int = 50) -> DataFrame:
    """events as images of packed pixels: img, i, j, pixel; the last image may be lower than the others (A3)."""
    row = F.floor(F.col("event_id") / width)
    channel = lambda c: F.pmod(F.floor(F.abs(c)), F.lit(256)).cast("double")
    pixel = pack_rgba(channel(F.col("value")), channel(F.col("user_id")), channel(F.col("event_id")), F.lit(255.0))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(row / height).alias("img"), F.pmod(row, F.lit(height)).alias("i"), (F.col("event_id") % width).alias("j"), pixel.alias("pixel"))


def drain(df: DataFrame) -> None:
    """Runs a plan and discards its rows."""
    df.write.format("noop").mode("overwrite").save()
