"""Student t quantile as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import T_975, Z_975


def t_975(degrees: Column) -> Column:
    """t(0.975, degrees): tabled for small samples, the expansion around the normal quantile beyond; missing below 1."""
    z = Z_975
    v = degrees.cast("double")
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    tail = F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v) + F.lit(g4) / (v * v * v * v)
    table = F.array(*[F.lit(t) for t in T_975])
    small = F.get(table, (degrees - 1).cast("int"))
    return F.when(degrees < 1, F.lit(None).cast("double")).when(degrees <= len(T_975), small).otherwise(tail)
