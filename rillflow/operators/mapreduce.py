"""Map, combine and reduce as DataFrame operations (inventory A9, A12, F6, G2-G6, H6, K3-K9)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship


@dataclass
class MapReduce:
    """mapper makes an array of (key, value) structs of a row, or is an array of keys and the value of each; combiner folds the values of a key and must be associative
    and commutative, so it runs before the shuffle too; without one (None) pairs stay as they are. A split, a fold, a reducer
    and a process are optional.

    split: what a row's input column becomes before it is mapped, one row for each piece (K3).
    fold: a Python function of two values of a key in place of the combiner (K5), associative and commutative: it runs over a
    task's pairs before the shuffle, FOLD_KEYS keys at most in memory, and over sorted pairs after it, one key at a time."""

    mapper: Column | tuple[Column, Column]
    combiner: Callable[[Column], Column] | None = F.sum
    split: tuple[str, Column] | None = None
    fold: Callable | None = None
    reducer: Callable[[Column, Column], Column] | None = None
    process: Callable | None = None

    def run(self, df: DataFrame, in_key_order: bool | Callable[[Column], Column] = False) -> DataFrame:
        """key, value. in_key_order: results in the order of their keys (H6), or of what a comparator's sort expression makes
        of them (C13, K8)."""
        if self.split:
            df = df.withColumn(self.split[0], F.explode(self.split[1]))
        if isinstance(self.mapper, tuple):
            pairs = df.select(F.explode(self.mapper[0]).alias("key")).select("key", self.mapper[1].alias("value"))
        else:
            pairs = df.select(F.explode(self.mapper).alias("t")).select("t.key", "t.value")
        if self.fold:
            out = folded(pairs, self.fold)
        elif self.combiner:
            out = pairs.groupBy("key").agg(self.combiner(F.col("value")).alias("value"))
        else:
            out = pairs
        if self.reducer:
            out = out.select("key", self.reducer(F.col("key"), F.col("value")).alias("value"))
        if in_key_order:
            out = out.orderBy(in_key_order(F.col("key")) if callable(in_key_order) else "key")
        if self.process:
            out.foreachPartition(self.process)
        return out


#: Keys that folded() holds before the shuffle.
FOLD_KEYS = 100_000


def folded(pairs: DataFrame, fold: Callable) -> DataFrame:
    """key, value with a key's values folded by a Python function; null keys are a key of their own."""
    ship(pairs.sparkSession)
    schema: StructType = pairs.schema

    def batch(rows: list[tuple]):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)

    def before(batches):
        held: dict = {}
        for b in batches:
            for k, v in zip(*b.to_pydict().values()):
                held[k] = fold(held[k], v) if k in held else v
            if len(held) > FOLD_KEYS:
                yield batch(list(held.items()))
                held = {}
        if held:
            yield batch(list(held.items()))

    def after(batches):
        now: list[tuple] = []
        for b in batches:
            out = []
            for k, v in zip(*b.to_pydict().values()):
                if now and now[0][0] == k:
                    now = [(k, fold(now[0][1], v))]
                else:
                    out += now
                    now = [(k, v)]
            if out:
                yield batch(out)
        if now:
            yield batch(now)

    return pairs.mapInArrow(before, schema).repartition("key").sortWithinPartitions("key").mapInArrow(after, schema)


def word_count_mapper(words: Column) -> tuple[Column, Column]:
    return words, F.lit(1).cast("long")
