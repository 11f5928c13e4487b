"""Counting expressions (M6, M9, A10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_evenly(total: Column, count: Column, index: Column) -> Column:
    """The part of ``total`` that the ``index``-th of ``count`` gets; the first ones get what is left over."""
    return F.floor(total / count) + (index < total % count).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """Unrounded share in per cent, 0 of nothing."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def clamp_similarity(value: Column) -> Column:
    """A number between -1 and 1; 0 where it is none."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))))
