"""Beta posterior of a success rate as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import let

PRIOR_ALPHA = 1.0
PRIOR_BETA = 1.0
#: Above this count on both sides the integral is summed over nodes.
LARGE = 1000.0
#: Steps allowed for a quantile; about ten are taken, more only where halving has to find the bracket.
STEPS = 200
#: Nodes and weights of the Gauss-Legendre rule on (0, 1).
NODES = [((u + 1) / 2, w / 2) for u, w in zip(*np.polynomial.legendre.leggauss(64))]


def beta_score(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def beta_variance(alpha: Column, beta: Column) -> Column:
    total = alpha + beta
    return alpha * beta / (total * total * (total + 1.0))


def _stirling_rest(z: Column) -> Column:
    """``lgamma(z)`` less its Stirling form, for ``z`` above 0: ten steps up, then the series."""
    steps = [(z + (i + 0.5)) * F.log1p(1.0 / (z + i)) - 1.0 for i in range(10)]
    y = 1.0 / (z + 10.0)
    w = y * y
    series = y * (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * (691 / 360360))))))
    return sum(steps, series)


def _scale(a: Column, b: Column) -> Column:
    n = a + b
    rests = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
    return 0.5 * F.log(a * b / (2.0 * math.pi * n)) + rests


def _weight(x: Column, a: Column, b: Column, scale: Column) -> Column:
    """``x^a (1-x)^b / B(a, b)``, from distances to the mean: no large logarithms cancel."""
    off = x - a / (a + b)
    return F.exp(a * F.log1p(off * (a + b) / a) + b * F.log1p(-off * (a + b) / b) + scale)


def _fraction(p: Column, q: Column, t: Column, rest: Column) -> Column:
    """The continued fraction of the incomplete beta integral at ``t = 1 - rest``, from its last term back.

    Denominators are kept as what they exceed 1 by.  Near ``t = 1`` large products
    would cancel; there they are subtracted by algebra and ``rest`` keeps its digits.
    """
    last = F.ceil(12.0 + 2.0 * F.sqrt(F.least(p, q, F.lit(LARGE)))).cast("int")
    low = t < 0.5

    def step(more: Column, m: Column) -> Column:
        wide, grown = (p + 2 * m) * (p + 2 * m + 1), (p + m) * (p + q + m)
        plain = wide * (1.0 + more) - grown * t
        left = F.when(low, plain).otherwise((p + m) * (2 * m + 1 - q) + m * (m + 1) + wide * more + grown * rest)
        return m * (q - m) * t * (p + 2 * m + 1) * (1.0 + more) / ((p + 2 * m - 1) * left)

    def value(more: Column) -> Column:
        left = F.when(low, (p + 1.0) * (1.0 + more) - (p + q) * t)
        left = left.otherwise((p + 1.0) * more + 1.0 - q + (p + q) * rest)
        return (p + 1.0) * (1.0 + more) / left

    return let(F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.lit(0.0), step), value)


def _tail(x: Column, a: Column, b: Column, scale: Column) -> Column:
    """The integral from ``x`` over ten deviations away from the mean, by Gauss-Legendre nodes."""
    below = x < a / (a + b)
    reach = 10.0 * F.sqrt(beta_variance(a, b))
    width = F.when(below, F.least(reach, x)).otherwise(F.least(reach, 1.0 - x))
    nodes = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w")) for u, w in NODES])

    def whole(bound: Column) -> Column:
        def add(acc: Column, node: Column) -> Column:
            y = F.when(bound["below"], x - bound["width"] * node["u"]).otherwise(x + bound["width"] * node["u"])
            return acc + let(y, lambda v: node["w"] * _weight(v, a, b, scale) / (v * (1.0 - v)))

        mass = F.aggregate(nodes, F.lit(0.0), add) * bound["width"]
        return let(mass, lambda m: F.when(bound["below"], m).otherwise(1.0 - m))

    return let(F.struct(below.alias("below"), width.alias("width")), whole)


def _cdf(x: Column, a: Column, b: Column, scale: Column, weight: Column) -> Column:
    direct = x <= (a + 1.0) / (a + b + 2.0)
    near = F.when(direct, weight * _fraction(a, b, x, 1.0 - x) / a)
    near = near.otherwise(1.0 - weight * _fraction(b, a, 1.0 - x, x) / b)
    return F.when(F.least(a, b) > LARGE, _tail(x, a, b, scale)).otherwise(near)


def beta_cdf(x: Column, alpha: Column, beta: Column) -> Column:
    """The regularised incomplete beta function, for ``x`` inside (0, 1) and counts above 0.

    A continued fraction; where both counts are above ``LARGE`` the density is
    smooth and the tail is summed over fixed nodes instead, so the work per row
    is bounded whatever the counts are.
    """

    def found(row: Column) -> Column:
        at, a, b, scale = row["x"], row["a"], row["b"], row["scale"]
        return _cdf(at, a, b, scale, _weight(at, a, b, scale))

    a, b = alpha.cast("double"), beta.cast("double")
    return let(F.struct(x.alias("x"), a.alias("a"), b.alias("b"), _scale(a, b).alias("scale")), found)


def beta_quantiles(alpha: Column, beta: Column, levels: list[float]) -> Column:
    """Array of quantiles of Beta(alpha, beta), for counts above 0; NULL counts give NULLs.

    Newton steps on ``beta_cdf`` from the mean.  A step that leaves the bracket
    known so far is replaced by halving it.  The steps end with one so small that
    its square is below the precision of doubles.
    """

    def quantile(row: Column, level: Column) -> Column:
        a, b, scale, spread = row["a"], row["b"], row["scale"], row["spread"]

        def move(acc: Column, _: Column) -> Column:
            x = acc["x"]

            def stepped(weight: Column) -> Column:
                def bracket(over: Column) -> Column:
                    low, high = F.when(over < 0, x).otherwise(acc["low"]), F.when(over < 0, acc["high"]).otherwise(x)
                    # ``weight`` over ``x (1 - x)`` is the density, the slope of the integral
                    newton = x - F.try_divide(over * x * (1.0 - x), weight)
                    return let(F.struct(low.alias("low"), high.alias("high"), newton.alias("x")), inside)

                def inside(to: Column) -> Column:
                    good = (to["x"] >= to["low"]) & (to["x"] <= to["high"])
                    goal = F.when(good, to["x"]).otherwise((to["low"] + to["high"]) / 2)
                    done = F.abs(goal - x) <= 1e-8 * F.least(spread, goal, 1.0 - goal)
                    return F.struct(to["low"].alias("low"), to["high"].alias("high"), goal.alias("x"), done.alias("done"))

                return let(_cdf(x, a, b, scale, weight) - level, bracket)

            return F.when(acc["done"], acc).otherwise(let(_weight(x, a, b, scale), stepped))

        parts = {"low": F.lit(0.0), "high": F.lit(1.0), "x": beta_score(a, b), "done": F.lit(False)}
        start = F.struct(*[value.alias(name) for name, value in parts.items()])
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, move, lambda acc: acc["x"])

    a, b = alpha.cast("double"), beta.cast("double")
    spread = F.sqrt(beta_variance(a, b))
    row = F.struct(a.alias("a"), b.alias("b"), _scale(a, b).alias("scale"), spread.alias("spread"))
    wanted = F.array(*[F.lit(float(level)) for level in levels])
    return let(row, lambda r: F.transform(wanted, lambda level: quantile(r, level)))
