"""Feedback loops (inventory J3, F5): a driver loop that unrolls levels and cuts lineage with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def levels(df: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int | None = None, cut_every: int = 8) -> DataFrame:
    """All rows of df and of step applied again and again, with their level: for so many rounds, or until nothing is left.

    Every cut_every rounds the levels made since are written by one checkpoint in the session's checkpoint folder, and the
    next ones start from there; so level k costs cut_every steps at most, and an ended loop is seen without another run."""
    checkpoint_dir(df.sparkSession)
    done, level, now = [], 0, df
    while rounds is None or level <= rounds:
        run = []
        while len(run) < cut_every and (rounds is None or level <= rounds):
            run.append(now.withColumn("level", F.lit(level)))
            now, level = step(now), level + 1
        held = reduce(DataFrame.unionByName, run).checkpoint()
        done.append(held)
        last = held.where(F.col("level") == level - 1).drop("level")
        if last.isEmpty():
            break
        now = step(last)
    return reduce(DataFrame.unionByName, done)
