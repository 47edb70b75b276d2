"""Stream operators over unbounded input (inventory J1, J2, J4, J5): windows that look ahead keep their tail as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def streaming_fir(stream: DataFrame, key: str, taps: list[float]) -> DataFrame:
    """key, seq, y: the FIR of each key's (seq, x) rows. The last len(taps) - 1 rows of a key are its state; within a
    micro-batch rows are sorted by seq, and a key's seq must not go backwards between micro-batches."""
    ship(stream.sparkSession)
    n = len(taps)
    kind = dict(stream.dtypes)[key]

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        seq, xs = (list(v) for v in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("seq")
        seq, xs = [*seq, *new["seq"].tolist()], [*xs, *new["x"].tolist()]
        if len(xs) >= n:
            y = np.convolve(np.array(xs), np.array(taps)[::-1], mode="valid")
            yield pd.DataFrame({key: group[0], "seq": seq[: len(y)], "y": y})
        keep = n - 1
        state.update((seq[len(seq) - keep :] if keep else [], xs[len(xs) - keep :] if keep else []) if len(xs) > keep else (seq, xs))

    return stream.select(key, "seq", "x").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, y double", "seq array<long>, xs array<double>", "append", GroupStateTimeout.NoTimeout)
