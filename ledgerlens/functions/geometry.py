"""Bounding box expressions. A box is x_min, y_min, x_max, y_max unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(low: Column, high: Column) -> Column:
    return (low + high) / 2


def ltrb_to_xywh(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def quad_to_xywh(quad: Column) -> Column:
    """Four corner points (array of arrays) to the box around them; null unless there are four."""
    xs, ys = ([F.get(F.get(quad, F.lit(i)), F.lit(axis)) for i in range(4)] for axis in (0, 1))
    x, y = F.least(*xs), F.least(*ys)
    box = F.struct(x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("width"), (F.greatest(*ys) - y).alias("height"))
    return F.when(F.size(quad) == 4, box)


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column, threshold: float = 0.5) -> Column:
    """Overlap on one axis above a share of the smaller side; never for an empty side."""
    overlap = F.greatest(F.lit(0.0), F.least(a_max, b_max) - F.greatest(a_min, b_min))
    side = F.least(a_max - a_min, b_max - b_min)
    return F.when(side > 0, overlap > side * threshold).otherwise(F.lit(False))


def axis_gap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Smallest of the two edge distances and the centre distance on one axis."""
    return F.least(F.abs(a_min - b_max), F.abs(b_min - a_max), F.abs(center(a_min, a_max) - center(b_min, b_max)))


def cells(low: Column, high: Column, size: float) -> Column:
    """Grid cells an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))
