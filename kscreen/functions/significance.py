"""The significance of a hit total, as columns.

The spread is the variance itself, not its root, and the error function is the one-sided
polynomial 7.1.26 of Abramowitz and Stegun, used for negative arguments as well. The value is
kept for compatibility; it is not a calibrated p-value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of formula 7.1.26.
P = 0.3275911
COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
PI = 3.14159265


def erf(x: Column) -> Column:
    y = F.lit(1.0) / (F.lit(1.0) + F.lit(P) * x)
    poly = F.lit(COEFFICIENTS[-1])
    for c in COEFFICIENTS[-2::-1]:
        poly = poly * y + F.lit(c)
    return F.lit(1.0) - poly * y * F.exp(-x * x)


def cdf(x: Column, mean: Column, spread: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf((x - mean) / (spread * F.sqrt(F.lit(2.0)))))


def pdf(x: Column, mean: Column, spread: Column) -> Column:
    z = (x - mean) / spread
    return F.exp(-z * z / F.lit(2.0)) / (spread * F.sqrt(F.lit(2 * PI)))


def p_value(hits: Column, bases: Column, probability: Column) -> Column:
    """Null where no bases were read."""
    mean = bases.cast("double") * probability
    return F.when(bases > 0, cdf(hits.cast("double"), mean, mean * (F.lit(1.0) - probability)))
