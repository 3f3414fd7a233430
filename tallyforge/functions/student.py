"""Two-sided 95 % Student-t quantile as a column of integer degrees of freedom."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import literal_array

TABLE_SIZE = 200
NORMAL_975 = 1.959963984540054


def t_upper_tail(t: float, df: int) -> float:
    """P(T > t) for whole ``df`` by the finite series in the angle atan(t / sqrt(df))."""
    angle = math.atan(t / math.sqrt(df))
    cos2 = math.cos(angle) ** 2
    if df % 2:
        term, total = math.cos(angle), 0.0
        for i in range(1, df - 1, 2):
            total += term
            term *= cos2 * (i + 1) / (i + 2)
        inside = 2 / math.pi * (angle + math.sin(angle) * total)
    else:
        term, total = 1.0, 0.0
        for i in range(0, df - 1, 2):
            total += term
            term *= cos2 * (i + 1) / (i + 2)
        inside = math.sin(angle) * total
    return (1 - inside) / 2


@cache
def t_975(df: int) -> float:
    if df == 1:
        return math.tan(0.475 * math.pi)
    if df == 2:
        return 0.95 * math.sqrt(2 / (1 - 0.95**2))
    low, high = 1.9, 13.0
    for _ in range(200):
        middle = (low + high) / 2
        if t_upper_tail(middle, df) > 0.025:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def small_table() -> list[float]:
    return [t_975(df) for df in range(1, TABLE_SIZE + 1)]


def expansion(df: Column) -> Column:
    """Large-sample expansion around the normal quantile; below 1e-10 off past the table."""
    z, inverse = NORMAL_975, F.lit(1.0) / df
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.lit(z) + inverse * (g1 + inverse * (g2 + inverse * (g3 + inverse * g4)))


def t_quantile_975(df: Column) -> Column:
    """Null below one degree of freedom."""
    table = literal_array(small_table())
    whole = df.cast("int")
    return (
        F.when(whole < 1, F.lit(None).cast("double"))
        .when(whole <= TABLE_SIZE, F.get(table, whole - 1))
        .otherwise(expansion(df.cast("double")))
    )
