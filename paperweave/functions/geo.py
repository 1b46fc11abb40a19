"""Boxes, overlaps, axes and likeness of sets as Columns. Boxes are [x0, y0, x1, y1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _area(box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def box_of(value: Column) -> list[Column]:
    return [F.get(value, i).cast("double") for i in range(4)]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 for boxes without area or with missing corners."""
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    missing = F.lit(False)
    for x in (*a, *b):
        missing = missing | x.isNull()
    union = _area(a) + _area(b) - both
    return F.when(missing | (union <= 0), F.lit(0.0)).otherwise(both / union)


def overlap_of_narrower(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The shared length of two intervals over the shorter one's."""
    width = F.least(a1 - a0, b1 - b0)
    return F.when(width > 0, F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / width).otherwise(F.lit(0.0))


def axis_value(pixel: Column, p0: Column, p1: Column, v0: Column, v1: Column) -> Column:
    """The value at a pixel of an axis through two points; null if they coincide."""
    return v0 + (pixel - p0) * (v1 - v0) / F.nullif(p1 - p0, F.lit(0.0))


def tick_value(label: Column) -> Column:
    """The number of a tick label of 24 characters at most that holds no words."""
    ok = (F.length(label) <= 24) & ~label.rlike(r"[A-Za-z]{2,}")
    return F.when(ok, F.nullif(F.regexp_extract(F.replace(label, F.lit("−"), F.lit("-")), r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?", 0), F.lit("")).try_cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set's; 0 for empty sets."""
    n = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))
