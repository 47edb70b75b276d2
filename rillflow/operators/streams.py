"""Ordered streams: frames with a ``seq`` column. Position windows, routing and positional merging (inventory B, D, E, F).

Position windows never order a whole stream in one task. A stream is cut into blocks of BLOCK positions; each block also
gets the first P - 1 rows of the next one (its halo), so every window lies in one block. A kernel's body works on blocks as
numpy arrays, an Arrow batch of blocks at a time. Streams that run in parallel (bands, duplicates) are lanes: one frame with
a lane column, so a stage over all of them is one scan and one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

BLOCK = 4096


def zero_padded(df: DataFrame, n: int, value: str = "x") -> DataFrame:
    """The stream (seq 0..n-1 of n_rows rows) followed by n zeros (A4)."""
    rows = df.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).select(F.explode(F.sequence(F.col("n"), F.col("n") + n - 1)).alias("seq"))
    return df.unionByName(rows.select("seq", F.lit(0.0).alias(value)))


def _blocks(df: DataFrame, peek: int, keys: list[str], value: str, block: int) -> DataFrame:
    """keys, _block, xs: each block's values in order, its halo included. Needs block >= peek."""
    own = F.floor(F.col("seq") / block)
    # the first peek - 1 rows also end the block before
    both = F.when((F.col("seq") % block < peek - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = df.select(*keys, "seq", value, F.explode(both).alias("_block"))
    held = dealt.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("seq", value))).alias("_s"))
    return held.select(*keys, "_block", F.transform("_s", lambda s: s[value]).alias("xs"))


def kernel(df: DataFrame, body: Callable, peek: int = 1, pop: int = 1, keys: list[str] | None = None, value: str = "x", block: int = BLOCK, lane: str | None = None) -> DataFrame:
    """A user's kernel: body(xs, key) gives one output for each complete window of ``peek`` elements, a window beginning at
    every pop-th position (B5, B14, K1). xs holds a run of elements that ends with its last window; key the values of the key
    columns. With ``lane``, body gives a dict from lane numbers to outputs, and the result has that column too.

    Nulls reach the body as NaN. Positions (seq) must be dense from 0 within their keys; rows at the end that no complete
    window has are drained."""
    keys = keys or []
    block = max(1, -(-max(block, peek) // pop)) * pop
    ship(df.sparkSession)
    held = _blocks(df, peek, keys, value, block).select(*keys, "_block", "xs")
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *([f"`{lane}` int"] if lane else []), "seq long", f"`{value}` double"])
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                xs = b.column(b.num_columns - 1)[r].values.to_numpy(zero_copy_only=False)
                n = min(block // pop, (len(xs) - peek) // pop + 1)
                if n < 1:
                    continue
                key = [b.column(k)[r] for k in range(len(keys))]
                seq = b.column(len(keys))[r].as_py() * (block // pop) + np.arange(n)
                out = body(xs[: (n - 1) * pop + peek].astype(np.float64), tuple(k.as_py() for k in key))
                for at, y in out.items() if lane else [(None, out)]:
                    lanes = [pa.array(np.full(n, at, dtype=np.int32))] if lane else []
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(k, n) for k in key), *lanes, pa.array(seq), pa.array(y)], schema=fields)

    return held.mapInArrow(run, schema)


def _filtered(xs: np.ndarray, taps: list[float], step: int) -> np.ndarray:
    """Sums of products, added up in the order of the taps for all outputs at once."""
    n = (len(xs) - len(taps)) // step + 1
    y = np.zeros(n)
    for i, c in enumerate(taps):
        y += xs[i : i + (n - 1) * step + 1 : step] * c
    return y


def fir(df: DataFrame, taps: list[float] | dict, step: int = 1, keys: list[str] | None = None, value: str = "x", block: int = BLOCK, lane: str | None = None) -> DataFrame:
    """sum_i taps[i] * x[step * o + i] as the o-th output, for complete windows only.

    taps may be a dict from the value of the first key column to that key's taps or, with ``lane``, from a lane's number to its
    taps: every stream then goes through all of these filters, and the result has that column."""
    several = isinstance(taps, dict)
    n = len(next(iter(taps.values()))) if several else len(taps)
    if lane:
        body = lambda xs, _: {k: _filtered(xs, t, step) for k, t in taps.items()}
    else:
        body = lambda xs, key: _filtered(xs, taps[key[0]] if several else taps, step)
    return kernel(df, body, n, step, keys, value, block, lane)


def pairs(df: DataFrame, f, keys: list[str] | None = None, value: str = "x", block: int = BLOCK) -> DataFrame:
    """f(x[t], x[t+1]) for each t."""
    keys = keys or []
    held = _blocks(df, 2, keys, value, block)
    starts = F.when(F.size("xs") >= 2, F.sequence(F.lit(0), F.least(F.lit(block - 1), F.size("xs") - 2)))
    out = held.select(*keys, "_block", F.explode(F.transform(starts, lambda at: F.struct(at.alias("at"), f(F.col("xs")[at], F.col("xs")[at + 1]).alias("y")))).alias("o"))
    return out.select(*keys, (F.col("_block") * block + F.col("o.at")).cast("long").alias("seq"), F.col("o.y").alias(value))


def blocks_of(df: DataFrame, n: int, short_last: bool = False, value: str = "x") -> DataFrame:
    """Tumbling blocks of n elements as arrays (B3, B4, E10); an incomplete last one is drained unless asked for."""
    out = df.groupBy(F.floor(F.col("seq") / n).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda s: s[value]).alias("xs"))
    return out if short_last else out.where(F.size("xs") == n)


def sized_blocks(df: DataFrame, sizes: DataFrame, value: str = "x", width: int = BLOCK) -> DataFrame:
    """Blocks whose sizes another stream (seq, n) gives (E11): seq, value, block. Elements beyond the last block are drained;
    a size of null or below 1 gives no block.

    The sizes' running sum is taken over runs of ``width`` sizes and over the runs' sums, and an element finds its block among
    those that overlap its own range of ``width`` positions: neither side is made longer but for blocks over several ranges."""
    at = sizes.where(F.col("n") > 0).select("seq", F.col("n").cast("long").alias("n"), F.floor(F.col("seq") / width).alias("_run"))
    runs = at.groupBy(F.col("_run").alias("_r")).agg(F.sum("n").alias("_total"))
    before = runs.select("_r", F.coalesce(F.sum("_total").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("_run").orderBy("seq"))
    ends = at.withColumn("_in", within).join(before, F.col("_run") == F.col("_r")).select(F.col("seq").alias("block"), (F.col("_before") + F.col("_in")).alias("_end"), "n")
    first = F.col("_end") - F.col("n")
    ranges = ends.select("block", first.alias("_from"), "_end", F.explode(F.sequence(F.floor(first / width), F.floor((F.col("_end") - 1) / width))).alias("_range"))
    rows = df.withColumn("_range", F.floor(F.col("seq") / width))
    return rows.join(ranges, "_range").where((F.col("seq") >= F.col("_from")) & (F.col("seq") < F.col("_end"))).select("seq", value, "block")


def decimate(df: DataFrame, m: int) -> DataFrame:
    """The first of every m elements."""
    return df.where(F.col("seq") % m == 0).withColumn("seq", F.floor(F.col("seq") / m))


def upsample(df: DataFrame, n: int, value: str = "x") -> DataFrame:
    """Each element and n - 1 zeros after it."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    rest = [c for c in df.columns if c not in ("seq", value)]
    return df.select(*rest, "seq", value, k).select(*rest, (F.col("seq") * n + F.col("_k")).alias("seq"), F.when(F.col("_k") == 0, F.col(value)).otherwise(F.lit(0.0)).alias(value))


def lanes(df: DataFrame, n: int, lane: str = "lane") -> DataFrame:
    """n copies of a stream, told apart by a lane column (D1, D2): the stream is read once."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(lane))


def zip_lanes(df: DataFrame, weights: list[float], lane: str = "lane", value: str = "x") -> DataFrame:
    """The weighted sum of lanes position by position, where every lane has a row (F1, F2): one shuffle, after a partial
    aggregation. The terms are added in the order of the lanes."""
    each = [F.max(F.when(F.col(lane) == i, F.col(value))).alias(f"_v{i}") for i in range(len(weights))]
    zipped = df.groupBy("seq").agg(F.count(lane).alias("_n"), *each).where(F.col("_n") == len(weights))
    return zipped.select("seq", reduce(lambda s, i: s + F.col(f"_v{i}") * F.lit(float(weights[i])), range(len(weights)), F.lit(0.0)).alias(value))


def zip_add(streams: list[DataFrame], weights: list[float] | None = None, value: str = "x") -> DataFrame:
    """The weighted sum of streams position by position (F1, F2), where all have a row: one shuffle for any number of streams."""
    tagged = [s.select("seq", F.lit(i).alias("lane"), F.col(value).alias(value)) for i, s in enumerate(streams)]
    return zip_lanes(reduce(DataFrame.unionByName, tagged), weights or [1.0] * len(streams), value=value)


def equaliser_weights(gains: list[float], literal: bool = False) -> list[float]:
    """Lane weights of sum_k g[k] (q[2k + 1] - q[2k]) (F2); literal: the last band is taken from itself and cancels."""
    weights = [w for g in gains for w in (-g, g)]
    return [*weights[:-2], 0.0, 0.0] if literal else weights


def zip_files(parts: list[DataFrame], names: list[str], value: str = "value") -> DataFrame:
    """Streams side by side, one column each, position by position; null where a stream has ended."""
    tagged = [s.select("seq", F.lit(i).alias("lane"), F.col(value).cast("string").alias("_v")) for i, s in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).groupBy("seq").agg(*[F.max(F.when(F.col("lane") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)])


def merge_sorted(left: DataFrame, right: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """The stable merge of two sorted streams, left first on ties (F4): the rows with ``side`` and ``rank``, their place in it
    from 0. Equal rows of one stream keep their order, which the columns ``within`` tell."""
    from .sorting import ranked

    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return ranked(both, [*order, "side", *(within or [])])
