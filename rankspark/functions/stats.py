"""Student-t p-values as Column expressions.

For a whole number of degrees of freedom the t distribution is a finite sum
(Abramowitz and Stegun 26.7.3 and 26.7.4), so no numerical integration is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t with ``dof`` (a whole number >= 1) degrees of freedom; null outside."""
    nu = dof.cast("long")
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    odd = nu % 2 == 1
    last = F.when(odd, F.expr("0") + (nu - 3) / 2).otherwise((nu - 2) / 2).cast("long")
    # each term is the one before times cos^2 and a ratio of neighbours: odd 2j/(2j+1), even (2j-1)/(2j)
    steps = F.when(last >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, j):
        ratio = F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
        term = acc["term"] * ratio * cos2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(steps, start, add)["total"]
    inside = (F.when(nu == 1, 2 / math.pi * theta)
              .when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total))
              .otherwise(F.sin(theta) * total))
    return F.when((nu >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))
