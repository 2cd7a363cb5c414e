"""Tail probabilities as Column expressions.

`norm_sf` / `norm_cdf` follow Zelen & Severo's polynomial (about 1 % relative error
far in the tail). The exact tails evaluate series and continued fractions with
`aggregate` over a sequence of term numbers. They are meant for statistics that are
already aggregated, a handful of rows at most.
"""

from __future__ import annotations

from functools import reduce
from math import factorial
from operator import add

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values: Zelen & Severo (1964), formula 26.2.17 ---------------------
ZS_P = 0.2316419
ZS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# ------------------------------------------------------------------------------


def _upper_tail(distance: Column) -> Column:
    """P(Z > distance) for distance >= 0."""
    t = 1.0 / (1.0 + F.lit(ZS_P) * distance)
    poly = F.lit(0.0)
    for b in reversed(ZS_B):
        poly = t * (F.lit(b) + poly)
    return _density(distance) * poly


def norm_sf(x: Column) -> Column:
    """P(Z > x), without the cancellation of 1 - cdf for large x."""
    tail = _upper_tail(F.abs(x))
    return F.when(x >= 0, tail).when(x < 0, 1.0 - tail)


def norm_cdf(x: Column) -> Column:
    tail = _upper_tail(F.abs(x))
    return F.when(x >= 0, 1.0 - tail).when(x < 0, tail)


def register_sql_functions(spark: SparkSession) -> None:
    """Make norm_sf(x) and norm_cdf(x) callable from SQL text."""
    b1, b2, b3, b4, b5 = (repr(b) + "D" for b in ZS_B)
    t = f"(1D / (1D + {ZS_P!r}D * abs(x)))"
    poly = f"{t} * ({b1} + {t} * ({b2} + {t} * ({b3} + {t} * ({b4} + {t} * {b5}))))"
    tail = f"exp(-0.5D * x * x) / sqrt(2D * pi()) * ({poly})"
    for name, positive, negative in (
        ("norm_sf", tail, f"1D - {tail}"),
        ("norm_cdf", f"1D - {tail}", tail),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE) RETURNS DOUBLE "
            f"RETURN CASE WHEN x >= 0 THEN {positive} WHEN x < 0 THEN {negative} END"
        )


def _density(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / F.sqrt(2.0 * F.pi())


def _fold_down(terms: Column, start: Column, step) -> Column:
    """Fold term numbers terms, terms - 1, ..., 1 into `start`: a nested fraction from the inside out."""
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), start.cast("double"), step)


def two_sided_normal_p(z: Column) -> Column:
    """P(|Z| > |z|), to full precision however far in the tail."""
    x = F.abs(z).cast("double")
    # Near the middle: cdf - 1/2 = density * x * (1 + x^2/3 * (1 + x^2/5 * (1 + ...)))
    series = _fold_down(F.lit(60), F.lit(1.0), lambda acc, k: 1.0 + x * x / (2 * k + 1) * acc)
    # In the tail: sf = density / (x + 1/(x + 2/(x + 3/(x + ...))))
    fraction = _fold_down(F.lit(200), x, lambda acc, k: x + k / acc)
    return F.when(x < 2.0, 1.0 - 2.0 * _density(x) * x * series).when(x >= 2.0, 2.0 * _density(x) / fraction)


def _stirling(x: Column) -> Column:
    """Correction of Stirling's formula for log(Gamma(x)), x >= 10."""
    y = 1.0 / (x * x)
    return (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x


def log_gamma_ratio(a: Column, step: Column) -> Column:
    """log(Gamma(a + step) / Gamma(a)), stable when a dwarfs the step."""
    shifted = a + 10.0
    smooth = (
        (shifted - 0.5) * F.log1p(step / shifted)
        + step * F.log(shifted + step)
        - step
        + _stirling(shifted + step)
        - _stirling(shifted)
    )
    return smooth - reduce(add, [F.log1p(step / (a + float(i))) for i in range(10)])


def _expandable(a: Column, b: Column) -> Column:
    return (a >= LARGE) & (b <= FEW)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function; sqrt(max(a, b)) terms settle it."""
    terms = F.when(_expandable(a, b) | _expandable(b, a), 1).otherwise((200 + 5 * F.sqrt(F.greatest(a, b))).cast("int"))

    def odd(m):
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))

    def even(m):
        return m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))

    inner = _fold_down(terms, F.lit(1.0), lambda acc, m: 1.0 + even(m) / (1.0 + odd(m) / acc))
    return 1.0 / (1.0 + odd(F.lit(0.0)) / inner)


def _upper_gamma(b: Column, u: Column, front: Column) -> Column:
    """Upper incomplete gamma function of b at u over u**b * exp(-u); `front` is that over Gamma(b)."""
    terms = (200 + 10 * F.sqrt(b)).cast("int")
    fraction = _fold_down(terms, u + 2 * terms + 1.0 - b, lambda acc, k: u + 2 * k - 1.0 - b - k * (k - b) / acc)
    series = _fold_down(terms, F.lit(1.0), lambda acc, k: 1.0 + u / (b + k) * acc) / b
    return F.when(u < b + 1.0, 1.0 / front - series).otherwise(1.0 / fraction)


#: From this first parameter on the incomplete beta function is expanded about the gamma function.
LARGE = 1e6
#: Up to this second parameter.
FEW = 1000.0
#: Terms of the expansion: at LARGE each is smaller than the one before by nine digits or more.
EXPANSION = 4


def _beta_expansion(a: Column, b: Column, odds: Column, log_gamma_b: Column) -> Column:
    """I_x(a, b) at x = 1 / (1 + odds) for a far above b (DiDonato and Morris 1992, formula 9).

    The number of terms does not depend on a, and no large numbers cancel.
    """
    middle = a + (b - 1.0) / 2.0
    log_x = -F.log1p(odds)
    u = -middle * log_x
    front = F.exp(b * F.log(u) - u - log_gamma_b)
    scale = F.exp(log_gamma_ratio(a, b) - b * F.log(middle))
    part = _upper_gamma(b, u, front)
    total, factor, power = part, [F.lit(1.0)], F.lit(1.0)
    for n in range(1, EXPANSION + 1):
        mixed = [(m * b - n) * factor[n - m] / float(factorial(2 * m + 1)) for m in range(1, n)]
        factor.append(reduce(add, mixed, F.lit(0.0)) / float(n) + (b - 1.0) / float(factorial(2 * n + 1)))
        at = b + 2.0 * (n - 1)
        part = (at * (at + 1.0) * part + (u + at + 1.0) * power) / (4.0 * middle * middle)
        power = power * log_x * log_x / 4.0
        total = total + factor[n] * part
    # beyond the range of doubles the tail is zero
    return F.when(front > 0, scale * front * total).otherwise(0.0)


def f_tail(f: Column, dof1: Column, dof2: Column) -> Column:
    """P(F > f) for an F(dof1, dof2) variable, the incomplete beta function
    I_x(dof2 / 2, dof1 / 2) at x = dof2 / (dof2 + dof1 f).

    With many degrees of freedom below and few above, as in tests over large tables, by an
    expansion of a fixed number of terms; else by a continued fraction."""
    a, b = dof2 / 2.0, dof1 / 2.0
    odds = dof1 * f / dof2
    x, y = 1.0 / (1.0 + odds), odds / (1.0 + odds)
    log_gamma_b = log_gamma_ratio(F.lit(1.0), b - 1.0)
    log_front = (
        log_gamma_ratio(a, b) - log_gamma_b - (a + b) * F.log1p(odds) + b * F.log(odds)
    )
    front = F.exp(log_front)
    return (
        F.when(~(dof1 > 0) | ~(dof2 > 0), None)
        .when(f <= 0, 1.0)
        .when(f == float("inf"), 0.0)
        .when(_expandable(a, b), _beta_expansion(a, b, odds, log_gamma_b))
        .when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a)
        .when(f > 0, 1.0 - front * _beta_fraction(b, a, y) / b)
    )
