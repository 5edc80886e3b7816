"""Exact percentiles without collecting a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that may be sorted at once, and bins of a counting pass.
FEW, BINS = 50_000, 4_096


def percentile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact percentile with linear interpolation; null values are left out, None if there are none.

    Each pass counts the values per bin (combined on the map side) and keeps the bin that holds the
    two ranks asked for, until few values are left or all are equal.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = q * (n - 1)
    first, second = math.floor(place), math.ceil(place)

    def at(rank: int) -> float:
        part, lo, hi, skip, size = values, low, high, 0, n
        while size > FEW and hi > lo:
            width = (hi - lo) / BINS
            if width <= 0 or lo + width == lo:
                break
            bin_ = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1))
            counts = part.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
            for r in counts:
                if rank < skip + r.n:
                    break
                skip += r.n
            lo, hi, size = r.lo, r.hi, r.n
            part = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        if hi == lo:
            return lo
        return part.orderBy("v").limit(rank - skip + 1).agg(F.max("v")).first()[0]

    a = at(first)
    b = a if second == first else at(second)
    return a + (b - a) * (place - first)
