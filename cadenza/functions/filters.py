"""Coefficients and responses of second-order filters: (b0, b1, b2, a1, a2), normalised."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

Biquad = tuple[float, float, float, float, float]

#: Fixed values of the K-weighting filters (ITU-R BS.1770): shelf and high-pass, as frequency, gain and Q.
SHELF_HZ, SHELF_DB, SHELF_Q, SHELF_POWER = 1681.9744509555319, 3.9998438533940324, 0.7071752369554193, 0.4996667741545416
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773


def k_weighting(rate: float) -> tuple[Biquad, Biquad]:
    """The shelf and the high-pass for a sample rate; the high-pass keeps its numerator 1, -2, 1."""
    k = math.tan(math.pi * SHELF_HZ / rate)
    high = 10 ** (SHELF_DB / 20)
    mid = high**SHELF_POWER
    a0 = 1 + k / SHELF_Q + k * k
    poles = (2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0)
    shelf = ((high + mid * k / SHELF_Q + k * k) / a0, 2 * (k * k - high) / a0, (high - mid * k / SHELF_Q + k * k) / a0, *poles)
    k = math.tan(math.pi * PASS_HZ / rate)
    a0 = 1 + k / PASS_Q + k * k
    return shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / PASS_Q + k * k) / a0)


def _cookbook(b: Sequence[float], a: Sequence[float]) -> Biquad:
    return b[0] / a[0], b[1] / a[0], b[2] / a[0], a[1] / a[0], a[2] / a[0]


def _turn(freq: float, rate: float, q: float) -> tuple[float, float]:
    w = 2 * math.pi * freq / rate
    return math.cos(w), math.sin(w) / (2 * q)


def peaking(freq: float, gain_db: float, q: float, rate: float) -> Biquad:
    c, alpha = _turn(freq, rate, q)
    g = 10 ** (gain_db / 40)
    return _cookbook((1 + alpha * g, -2 * c, 1 - alpha * g), (1 + alpha / g, -2 * c, 1 - alpha / g))


def shelf(freq: float, gain_db: float, q: float, rate: float, high: bool) -> Biquad:
    """Low shelf, or high shelf: the same with the sign of the cosine turned."""
    c, alpha = _turn(freq, rate, q)
    g = 10 ** (gain_db / 40)
    s, root = (-1 if high else 1), 2 * math.sqrt(g) * alpha
    b = (g * (g + 1 - s * (g - 1) * c + root), s * 2 * g * (g - 1 - s * (g + 1) * c), g * (g + 1 - s * (g - 1) * c - root))
    a = (g + 1 + s * (g - 1) * c + root, s * -2 * (g - 1 + s * (g + 1) * c), g + 1 + s * (g - 1) * c - root)
    return _cookbook(b, a)


def high_pass(freq: float, rate: float, q: float = math.sqrt(0.5)) -> Biquad:
    """Second-order high-pass; a Butterworth one by default."""
    c, alpha = _turn(freq, rate, q)
    return _cookbook(((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha))


def response_db(cascade: Sequence[Biquad], freq: float, rate: float) -> float:
    """Magnitude of a cascade in dB at a frequency."""
    z = np.exp(-2j * np.pi * freq / rate)
    h = 1.0 + 0j
    for b0, b1, b2, a1, a2 in cascade:
        h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return float(20 * np.log10(abs(h)))


def settle(cascade: Sequence[Biquad], least: float = 2.0**-53) -> int:
    """Samples after which what a cascade held at the start weighs less than ``least``."""
    radius = max(float(np.abs(np.roots((1.0, a1, a2))).max(initial=0.0)) for *_, a1, a2 in cascade)
    if radius >= 1:
        raise ValueError("the filter does not settle")
    return 64 if radius < 1e-3 else 64 + math.ceil(2 * math.log(least) / math.log(radius))
