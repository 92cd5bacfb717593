"""Complex and phase arithmetic as column expressions; complex values are (re, im) pairs of doubles."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


class Complex(NamedTuple):
    re: Column
    im: Column


def cpx(re: str | Column, im: str | Column) -> Complex:
    return Complex(*(F.col(x) if isinstance(x, str) else x for x in (re, im)))


def polar(size: Column, angle: Column) -> Complex:
    return Complex(size * F.cos(angle), size * F.sin(angle))


def mul(a: Complex, b: Complex) -> Complex:
    return Complex(a.re * b.re - a.im * b.im, a.re * b.im + a.im * b.re)


def conj(a: Complex) -> Complex:
    return Complex(a.re, -a.im)


def arg(a: Complex) -> Column:
    return F.atan2(a.im, a.re)


def norm(a: Complex) -> Column:
    return F.sqrt(a.re * a.re + a.im * a.im)


def unit(a: Complex) -> Complex:
    """The phasor; zero stays zero."""
    size = norm(a)
    return Complex(*(F.when(size > 0, x / size).otherwise(0.0) for x in a))


def is_zero(a: Complex) -> Column:
    return (a.re == 0) & (a.im == 0)


def wrap(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(TAU)) - math.pi


def wrapped_difference(a: Column, b: Column, period: float = TAU) -> Column:
    return F.abs(F.pmod(a - b + period / 2, F.lit(period)) - period / 2)


def amplitude(a: Complex) -> Column:
    """The norm, 1 for zero: what a phase matrix is normalised by."""
    return F.when(norm(a) == 0, 1.0).otherwise(norm(a))


def detrend(a: Complex, slope: Column, baseline: Column, weight: Column | None = None) -> Complex:
    """a * exp(-i slope baseline) * weight."""
    out = mul(a, polar(F.lit(1.0), -slope * baseline))
    return out if weight is None else Complex(out.re * weight, out.im * weight)


def half_away(x: Column) -> Column:
    """Rounds to an integer, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def half_even(x: Column) -> Column:
    return F.rint(x)
