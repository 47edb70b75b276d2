"""Operators on fixed-length rows held as arrays: reordering, padding, transforms and recurrences (inventory D, E5, E6, I).

Reorderings are array expressions. Transforms and recurrences are numpy over whole Arrow batches (rows x elements), as Spark
interprets lambdas over arrays one element at a time. Null rows give null; rows of different lengths are worked on by length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.design import gaussian_iir, twiddles
from ..session import ship


def even_odd(xs: Column, n: int | None = None) -> Column:
    """Elements at even places, then those at odd ones, within runs of n (D3)."""
    split = lambda a: F.concat(F.filter(a, lambda _, i: i % 2 == 0), F.filter(a, lambda _, i: i % 2 == 1))
    if n is None:
        return split(xs)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(xs) - n, F.lit(n)), lambda s: split(F.slice(xs, s + 1, n))))


def bit_order(n: int) -> list[int]:
    bits = n.bit_length() - 1
    return [int(format(i, f"0{bits}b")[::-1], 2) if bits else 0 for i in range(n)]


def bit_reversed(xs: Column, n: int = 64) -> Column:
    """even_odd at n, n/2, ..., 4: one index permutation."""
    return F.transform(F.array(*[F.lit(i) for i in bit_order(n)]), lambda i: F.get(xs, i))


def expand(xs: Column, n: int) -> Column:
    """xs with zeros behind it up to n elements."""
    return F.concat(xs, F.array_repeat(F.lit(0.0), n - F.size(xs)))


def contract(xs: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(xs, 1, n)


def transposed(xs: Column, rows: int, cols: int, literal: bool = False) -> Column:
    """A row-major rows x cols matrix with rows and columns exchanged (D5, D6); literal: left as it is."""
    if literal:
        return xs
    return _rows(xs, lambda x: x.reshape(-1, rows, cols).transpose(0, 2, 1).reshape(len(x), rows * cols))


def expand_rows(xs: Column, rows: int, cols: int, to: int) -> Column:
    """A cols x rows matrix transposed, and each of its rows of cols elements padded with zeros to ``to``."""
    return _rows(xs, lambda x: np.pad(x.reshape(-1, cols, rows).transpose(0, 2, 1), ((0, 0), (0, 0), (0, to - cols))).reshape(len(x), rows * to))


def contract_rows(xs: Column, rows: int, cols: int, to: int) -> Column:
    """The first ``to`` elements of each row of a rows x cols matrix, transposed to ``to`` x rows."""
    return _rows(xs, lambda x: x.reshape(-1, rows, cols)[:, :, :to].transpose(0, 2, 1).reshape(len(x), rows * to))


def by_rows(columns: list[pa.Array], f: Callable[..., list[np.ndarray]]) -> list[pa.Array]:
    """f over the (rows x elements) matrices of list columns, as list columns."""
    lists = [c.cast(pa.list_(pa.float64())) for c in columns]
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in lists])
    sizes = np.where(known, lists[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    done: dict[int, list] = {}
    outs = 0
    for n in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == n)
        take = pa.array(rows)
        got = f(*[c.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(n)) for c in lists])
        outs = len(got)
        if len(rows) == len(sizes):
            return [pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * g.shape[1], np.ascontiguousarray(g).ravel()) for g in got]
        for k, r in enumerate(rows.tolist()):
            done[r] = [g[k] for g in got]
    return [pa.array([done[r][o] if r in done else None for r in range(len(sizes))], pa.list_(pa.float64())) for o in range(outs or 2)]


def butterflies(x: np.ndarray, size: int, inverse: bool = False) -> np.ndarray:
    """One radix-2 stage over each run of ``size`` elements: halves y0, y1 become y0 + w y1, y0 - w y1."""
    c, s = twiddles(size, inverse)
    w = np.array(c[: size // 2]) + 1j * np.array(s[: size // 2])
    both = x.reshape(len(x), -1, 2, size // 2)
    low, high = both[:, :, 0], both[:, :, 1] * w
    return np.stack([low + high, low - high], axis=2).reshape(x.shape)


def transform(x: np.ndarray, n: int, inverse: bool = False) -> np.ndarray:
    """The n-point transform of each run of n elements: bit reversal, then stages of 2, 4, ..., n; any n but a power of two
    is multiplied out."""
    runs = x.reshape(-1, n)
    if n & (n - 1):
        c, s = twiddles(n, inverse)
        w = (np.array(c) + 1j * np.array(s))[np.outer(np.arange(n), np.arange(n)) % n]
        out = runs @ w
    else:
        out, size = runs[:, bit_order(n)], 2
        while size <= n:
            out, size = butterflies(out, size, inverse), 2 * size
    return (out / n if inverse else out).reshape(x.shape)


def _complex(re: Column, im: Column, f: Callable[[np.ndarray], np.ndarray]) -> tuple[Column, Column]:
    def both(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        y = f(a + 1j * b)
        return [y.real, y.imag]

    @arrow_udf("struct<re:array<double>,im:array<double>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(by_rows([a, b], both), ["re", "im"])

    ship(SparkSession.active())
    out = run(re, im)
    return out["re"], out["im"]


def dft(re: Column, im: Column, n: int, inverse: bool = False) -> tuple[Column, Column]:
    """Real and imaginary parts of the n-point transform of each run of n elements (I2-I6); the inverse is scaled by 1/n."""
    return _complex(re, im, lambda x: transform(x, n, inverse))


def butterfly(re: Column, im: Column, size: int, inverse: bool = False) -> tuple[Column, Column]:
    """One stage of the transform."""
    return _complex(re, im, lambda x: butterflies(x, size, inverse))


def _recur(x: np.ndarray, near: float, far: float, b1: float, b2: float, ahead: bool) -> np.ndarray:
    """y = near u + far u' - b1 y' - b2 y'' along each row, u the input here (or, with ahead, the one before it)."""
    out = np.empty_like(x)
    if not x.shape[1]:
        return out
    first = x[:, 0]
    u1 = u2 = first
    y1 = y2 = first * ((near + far) / (1 + b1 + b2))
    for k in range(x.shape[1]):
        a, b = (u1, u2) if ahead else (x[:, k], u1)
        y = near * a + far * b - b1 * y1 - b2 * y2
        u1, u2, y1, y2 = x[:, k], u1, y, y1
        out[:, k] = y
    return out


def forward(x: np.ndarray, a0: float, a1: float, b1: float, b2: float) -> np.ndarray:
    return _recur(x, a0, a1, b1, b2, False)


def backward(x: np.ndarray, a2: float, a3: float, b1: float, b2: float) -> np.ndarray:
    return _recur(x[:, ::-1], a2, a3, b1, b2, True)[:, ::-1]


def _rows(xs: Column, f: Callable[[np.ndarray], np.ndarray]) -> Column:
    @arrow_udf("array<double>")
    def run(a: pa.Array) -> pa.Array:
        return by_rows([a], lambda x: [f(x)])[0]

    ship(SparkSession.active())
    return run(xs)


def iir_forward(xs: Column, a0: float, a1: float, b1: float, b2: float) -> Column:
    """y = a0 x + a1 x' - b1 y' - b2 y'' along each array (E5). Past inputs are the first sample, past outputs its steady state."""
    return _rows(xs, lambda x: forward(x, a0, a1, b1, b2))


def iir_backward(xs: Column, a2: float, a3: float, b1: float, b2: float) -> Column:
    """y[t] = a2 x[t+1] + a3 x[t+2] - b1 y[t+1] - b2 y[t+2], from the last sample back."""
    return _rows(xs, lambda x: backward(x, a2, a3, b1, b2))


def gaussian_rows(xs: Column, sigma: float, order: int = 0, eight_bits: bool = False) -> Column:
    """The recursive Gaussian along each array: forward pass plus backward pass.

    eight_bits: the forward result and the sum are cut to whole numbers from 0 to 255, as packed pixels hold them."""
    g = gaussian_iir(sigma, order)
    cut = (lambda v: np.clip(np.floor(v), 0, 255)) if eight_bits else (lambda v: v)
    return _rows(xs, lambda x: cut(cut(forward(x, g["a0"], g["a1"], g["b1"], g["b2"])) + backward(x, g["a2"], g["a3"], g["b1"], g["b2"])))
