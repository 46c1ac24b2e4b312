"""Probabilities of Student's t as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom up to which the finite sum is used; beyond, the distribution is moved to the normal one.
EXACT = 400


def _normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, a published polynomial with an error under 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    factors = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    total = F.lit(0.0)
    for f in reversed(factors):
        total = (total + f) * t
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total


def two_sided(t: Column, df: Column) -> Column:
    """Probability of a larger |t| with ``df`` (whole, at least 1) degrees of freedom; null for fewer and for no t.

    The distribution function has a finite sum of powers of cos(atan(t / sqrt(df))), each term a fraction of the last.
    Past ``EXACT`` degrees a transformed t is normal, with an error under 1e-6."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos = F.sin(angle), F.cos(angle)
    odd = df % 2 == 1
    last = F.floor(F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2)).cast("int")

    def step(state: Column, k: Column) -> Column:
        share = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = state["term"] * share * cos * cos
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    steps = F.when((last >= 1) & (df <= EXACT), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step)["total"]
    inside = F.when(df == 1, 2 * angle / math.pi).when(odd, 2 / math.pi * (angle + sin * cos * total)).otherwise(sin * total)
    moved = F.abs(t) * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > EXACT, 2 * _normal_tail(moved)).when((df >= 1) & t.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))
