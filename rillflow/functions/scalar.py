"""Element-wise functions on columns (inventory C1-C14). All are expressions of the JVM; those over arrays (vector, median3)
are interpreted per element, the others are generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scale(x: Column, m: float = 1 / 256) -> Column:
    return x * F.lit(m)


def saturate(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def demodulate(x: Column, following: Column, gain: float) -> Column:
    return F.lit(gain) * F.atan(x * following)


def pack_rgba(r: Column, g: Column, b: Column, a: Column, literal: bool = False) -> Column:
    """Four values as one packed integer. literal: values above 255 wrap instead of being clamped."""
    def part(c: Column) -> Column:
        whole = F.greatest(c, F.lit(0.0)).cast("long")
        return whole.bitwiseAND(255) if literal else F.least(whole, F.lit(255))

    return part(r).bitwiseOR(F.shiftleft(part(g), 8)).bitwiseOR(F.shiftleft(part(b), 16)).bitwiseOR(F.shiftleft(part(a), 24))


def unpack_rgba(p: Column) -> list[Column]:
    return [F.shiftright(p, s).bitwiseAND(255).cast("double") for s in (0, 8, 16, 24)]


def splat(x: Column, n: int) -> Column:
    """n lanes of one value."""
    return F.array_repeat(x, n)


def table_lookup(values: list[float], sizes: list[int], at: list[Column]) -> Column:
    """An element of a constant table of one, two or three dimensions, the last one running fastest (B13); null outside it."""
    flat, inside = F.lit(0), F.lit(True)
    for n, i in zip(sizes, at):
        flat, inside = flat * n + i, inside & (i >= 0) & (i < n)
    return F.when(inside, F.get(F.array(*[F.lit(v) for v in values]), flat.cast("int")))


def vector(op: str, a: Column, b: Column) -> Column:
    """Lane-wise + - * / of two arrays; of different lengths, the longer one's other lanes are null."""
    f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y}[op]
    return F.zip_with(a, b, f)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))[1]


def ascii_upper(s: Column) -> Column:
    """Upper case of a-z only; other letters stay."""
    return F.translate(s, LOWER, UPPER)


def words(s: Column) -> Column:
    """Maximal runs of a letter and then letters or apostrophes, in upper case."""
    return F.regexp_extract_all(ascii_upper(s), F.lit("([A-Z][A-Z']*)"), 1)


def has_space(s: Column) -> Column:
    return s.rlike("[ \\t\\r\\n]")


def uniform(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Random numbers from low up to high (C14)."""
    return F.rand(seed) * (high - low) + low


def uniform_int(seed: int, low: int = 0, high: int = (1 << 31) - 1) -> Column:
    """Random whole numbers from low to high, both included (C14)."""
    return F.floor(F.rand(seed) * (high - low + 1)).cast("long") + low


def coin(seed: int) -> Column:
    return F.rand(seed) < 0.5


def lcg(n: Column) -> Column:
    """The n-th value (n from 0) of x = 1103515245 x + 12345 in wrapping 32-bit integers from 0 (A5), computed on its own:
    the step's powers of two are applied for the bits of n + 1, so that a sequence needs no order of evaluation."""
    steps, a, c = [], 1103515245, 12345
    for bit in range(32):
        steps.append(F.struct(F.lit(bit).alias("bit"), F.lit(a >> 16).cast("long").alias("high"), F.lit(a & 0xFFFF).cast("long").alias("low"), F.lit(c).cast("long").alias("c")))
        a, c = a * a & 0xFFFFFFFF, (a * c + c) & 0xFFFFFFFF

    def apply(x: Column, s: Column) -> Column:
        # a product of two 32-bit numbers, by halves of one, so that no long overflows
        product = F.shiftleft((x * s["high"]).bitwiseAND(0xFFFF), 16) + x * s["low"]
        return F.when(F.call_function("shiftright", n + 1, s["bit"]).bitwiseAND(1) == 1, (product + s["c"]).bitwiseAND(0xFFFFFFFF)).otherwise(x)

    x = F.aggregate(F.array(*steps), F.lit(0).cast("long"), apply)
    return wrap32(x)


def wrap32(x: Column) -> Column:
    """A long cut to a signed 32-bit integer."""
    return F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
