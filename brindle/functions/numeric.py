"""Scalar column functions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of a probability before its logarithm is taken.
PROB_FLOOR = 1e-12
DELTA_BOUNDS = (0.01, 100.0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def floored_log(p: Column | str, floor: float = PROB_FLOOR) -> Column:
    return F.log(F.greatest(_c(p), F.lit(floor)))


def is_finite(x: Column | str) -> Column:
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column | str) -> Column:
    return F.when(is_finite(x), _c(x))


def mean_finite(x: Column | str) -> Column:
    """Mean of the finite values; null when there are none."""
    return F.avg(finite_or_null(x))


def nb_weight(phi: Column | str, mu: Column | str) -> Column:
    """Fisher weight ``phi / (mu + phi)`` of a negative binomial, phi at least 1e-6; 1 where phi is null."""
    p = F.greatest(_c(phi), F.lit(1e-6))
    return F.when(_c(phi).isNull(), F.lit(1.0)).otherwise(p / (_c(mu) + p))


def delta_ratio(observed: Column | str, predicted: Column | str, prior: float = 0.0, scale: Column | float = 1.0) -> Column:
    """Batch ratio ``(obs + a * r) / max(pred + a, 1e-10)`` within its bounds."""
    s = scale if isinstance(scale, Column) else F.lit(scale)
    raw = (_c(observed) + F.lit(prior) * s) / F.greatest(_c(predicted) + F.lit(prior), F.lit(1e-10))
    return F.least(F.greatest(raw, F.lit(DELTA_BOUNDS[0])), F.lit(DELTA_BOUNDS[1]))


def normal_upper_tail(z: Column | str) -> Column:
    """P(Z > z) by the five-term rational approximation of erf (Abramowitz and Stegun 7.1.26, fixed values)."""
    x = F.abs(_c(z)) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(_c(z) >= 0, half).otherwise(1.0 - half)


def matern52(distance: Column | str, length: float = 1.0) -> Column:
    """Correlation ``(1 + r + r^2/3) exp(-r)`` with ``r = sqrt(5) d / length``."""
    r = _c(distance) * F.lit(5.0**0.5 / length)
    return (1.0 + r + r * r / 3.0) * F.exp(-r)


def spliced_level(u0: Column | str, s0: Column | str, alpha: Column | str, beta: Column | str, gamma: Column | str, t: Column | str) -> Column:
    """Spliced level after time t: ``ds/dt = beta u - gamma s`` under ``du/dt = alpha - beta u``; a series near beta = gamma."""
    u0, s0, a, b, g, t = map(_c, (u0, s0, alpha, beta, gamma, t))
    eb, eg = F.exp(-b * t), F.exp(-g * t)
    gap = g - b
    # (exp(-bt) - exp(-gt)) / (g - b), of which the limit is t exp(-bt)
    ratio = F.when(F.abs(gap * t) < 1e-6, t * eb * (1.0 - gap * t / 2.0)).otherwise((eb - eg) / F.when(F.abs(gap * t) < 1e-6, F.lit(1.0)).otherwise(gap))
    return s0 * eg + a / g * (1.0 - eg) + (b * u0 - a) * ratio


def unspliced_level(u0: Column | str, alpha: Column | str, beta: Column | str, t: Column | str) -> Column:
    u0, a, b, t = map(_c, (u0, alpha, beta, t))
    e = F.exp(-b * t)
    return u0 * e + a / b * (1.0 - e)


def ramp(x: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Position of x between bounds, within [0, 1]; 0 where the bounds coincide."""
    width = _c(hi) - _c(lo)
    t = (_c(x) - _c(lo)) / F.when(width > 0, width)
    return F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def drawn(*keys: Column | str, seed: int = 0) -> Column:
    """A number between 0 and 1 by the checksum of the keys: alike on every run, and in any engine that has md5."""
    named = F.concat_ws("/", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
