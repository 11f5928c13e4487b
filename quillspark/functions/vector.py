"""Vector expressions (M1-M5), in double precision within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, size: int | None = None) -> Column:
    """``v`` at length one; null where it is all zero or hasn't ``size`` numbers."""
    unit = lambda n: F.when((n > 0) & (F.lit(True) if size is None else F.size(v) == size), F.transform(v, lambda x: x.cast("double") / n))
    return F.transform(F.array(norm(v)), unit)[0]


def quantized(v: Column) -> Column:
    """``struct<q: array<tinyint>, scale, norm>``: numbers over scale, rounded half to even, with the length of what they stand for."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / F.lit(127.0)).otherwise(F.lit(1.0))

    def with_scale(s: Column) -> Column:
        q = F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / s))).cast("tinyint"))
        return F.transform(F.array(q), lambda q: F.struct(q.alias("q"), s.alias("scale"), (F.sqrt(F.aggregate(q, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))) * s).alias("norm")))[0]

    # Bound once by the lambda, or the planner would put the scale's expression at every element.
    return F.transform(F.array(scale), with_scale)[0]
