"""Filter and transform coefficients, computed on the driver and used as literal arrays (inventory C15)."""

from __future__ import annotations

import math


def receiver_lowpass(rate: float, cutoff: float, taps: int = 128) -> list[float]:
    """Windowed-sinc low-pass of the receiver: Hamming window, gain 1."""
    m, w = taps - 1, 2 * math.pi * cutoff / rate
    return [w / math.pi if i == m / 2 else math.sin(w * (i - m / 2)) / (math.pi * (i - m / 2)) * (0.54 - 0.46 * math.cos(2 * math.pi * i / m)) for i in range(taps)]


def _sinc(wc: float, gain: float, taps: int) -> list[float]:
    middle = taps // 2
    return [gain * (wc / math.pi if i + 1 == middle else math.sin(wc * (i + 1 - middle)) / (math.pi * (i + 1 - middle))) for i in range(taps)]


def band_lowpass(band: int, bands: int = 8, gain: float = 1.0, taps: int = 128) -> list[float]:
    return _sinc((band + 1) * math.pi / bands, gain, taps)


def band_highpass(band: int, bands: int = 8, gain: float = 1.0, taps: int = 128) -> list[float]:
    return [h if i % 2 == 0 else -h for i, h in enumerate(_sinc(math.pi - band * math.pi / bands, gain, taps))]


def equaliser_cutoffs(bands: int = 6, low: float = 55.0, high: float = 1760.0) -> list[float]:
    return [math.exp(k * (math.log(high) - math.log(low)) / bands + math.log(low)) for k in range(bands + 1)]


def equaliser_gains(bands: int = 6) -> list[float]:
    out = []
    for k in range(bands):
        v = (k - (bands - 1) / 2) / 5
        out.append(2 - v if v > 0 else 2 + v)
    return out


def demodulator_gain(rate: float = 250e6, max_amplitude: float = 27000.0, bandwidth: float = 10000.0) -> float:
    return max_amplitude * rate / (bandwidth * math.pi)


def gaussian_iir(sigma: float, order: int = 0) -> dict[str, float]:
    """a0..a3, b1, b2 of the recursive Gaussian of a derivative order."""
    alpha = 1.695 / sigma
    e, e2 = math.exp(-alpha), math.exp(-2 * alpha)
    if order == 0:
        k = (1 - e) ** 2 / (1 + 2 * alpha * e - e2)
        a = (k, k * (alpha - 1) * e, k * (alpha + 1) * e, -k * e2)
    elif order == 1:
        a0 = (1 - e) ** 2
        a = (a0, 0.0, -a0, 0.0)
    else:
        q = -(e2 - 1) / (2 * alpha * e)
        n = -2 * (-1 + 3 * e - 3 * e * e + e**3) / (1 + 3 * e + 3 * e * e + e**3)
        a = (n, -n * (1 + q * alpha) * e, n * (1 - q * alpha) * e, -n * e2)
    return dict(zip(("a0", "a1", "a2", "a3"), a)) | {"b1": -2 * e, "b2": e2}


def twiddles(n: int, inverse: bool = False) -> tuple[list[float], list[float]]:
    """cos and sin of every multiple of the base angle, forward (negative angle) or inverse."""
    sign = 1 if inverse else -1
    return [math.cos(2 * math.pi * k / n) for k in range(n)], [sign * math.sin(2 * math.pi * k / n) for k in range(n)]
