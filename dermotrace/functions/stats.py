"""Small-sample statistics: Column expressions where Spark has the pieces, plain numbers for the tails of Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation 7.1.26 of erf (Abramowitz and Stegun), and its scale.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + F.lit(c)) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def t_p_value(t: float | None, df: float | None) -> float | None:
    """Two-sided."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_critical(df: float, p: float = 0.05) -> float:
    """The value whose two-sided tails hold ``p``, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p_value(mid, df) > p else (low, mid)
    return (low + high) / 2


def t_p_sql(t: str, df: str, n: int = 20_000) -> str:
    """``t_p_value`` as SQL: the share of the angles beyond t's, by Simpson's rule.

    With t = sqrt(df) tan(angle) the density is cos(angle) ** (df - 1); in the fourth root of the angle from the far end it
    is smooth for any df of 1 or more.
    """

    def area(end: str) -> str:
        u = f"({end} * i / {n})"
        return f"{end} * list_sum(list_transform(range({n + 1}), lambda i: CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow({u}, 3) * pow(sin(pow({u}, 4)), {df} - 1)))"

    near = f"pow(pi() / 2 - atan(abs({t}) / sqrt({df})), 0.25)"
    return f"({area(near)} / ({area('pow(pi() / 2, 0.25)')}))"
