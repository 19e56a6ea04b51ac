"""Polygons as array<struct<x, y>>: area, boxes, intervals and validity, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xs(p: Column) -> Column:
    return F.transform(p, lambda q: q["x"])


def ys(p: Column) -> Column:
    return F.transform(p, lambda q: q["y"])


def area(p: Column) -> Column:
    """Absolute shoelace area; 0 with fewer than three points."""
    shifted = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    cross = F.zip_with(p, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(p) < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2)


def bbox(p: Column) -> Column:
    """struct(x0, y0, x1, y1); zeros for an empty polygon."""
    side = lambda f, v: F.when(F.size(p) > 0, f(v)).otherwise(0.0)
    return F.struct(side(F.array_min, xs(p)).alias("x0"), side(F.array_min, ys(p)).alias("y0"), side(F.array_max, xs(p)).alias("x1"), side(F.array_max, ys(p)).alias("y1"))


def crop(b: Column, width: Column, height: Column) -> Column:
    """Integer box within the page, one pixel wider, at least one pixel."""
    x0, y0 = F.greatest(F.floor(b["x0"]), F.lit(0)), F.greatest(F.floor(b["y0"]), F.lit(0))
    x1, y1 = F.least(F.ceil(b["x1"]) + 1, width), F.least(F.ceil(b["y1"]) + 1, height)
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), F.greatest(x1, x0 + 1).cast("int").alias("x1"), F.greatest(y1, y0 + 1).cast("int").alias("y1"))


def core_interval(p: Column) -> Column:
    """The 15th and 85th percentile vertex in x by floor index; the box's sides with fewer than four points."""
    order, n = F.array_sort(xs(p)), F.size(p)
    at = lambda q: F.element_at(order, (F.floor((n - 1) * q) + 1).cast("int"))
    return F.when(n < 4, F.struct(F.array_min(xs(p)).alias("lo"), F.array_max(xs(p)).alias("hi"))).otherwise(F.struct(at(0.15).alias("lo"), at(0.85).alias("hi")))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def polygon_problem(p: Column, width: Column, height: Column) -> Column:
    """Why a line's polygon is invalid, or null: too few points, not finite, no area, out of bounds."""
    finite = F.forall(p, lambda q: q["x"].isNotNull() & q["y"].isNotNull() & ~F.isnan(q["x"]) & ~F.isnan(q["y"]) & (F.abs(q["x"]) < float("inf")) & (F.abs(q["y"]) < float("inf")))
    inside = F.forall(p, lambda q: (q["x"] >= 0) & (q["y"] >= 0) & (q["x"] <= width) & (q["y"] <= height))
    return F.when(F.coalesce(F.size(p), F.lit(0)) < 3, "too_few_points").when(~finite, "non_finite").when(area(p) <= 0, "zero_area").when(~inside, "out_of_bounds")


def polygon_from_arrays(points: Column) -> Column:
    """array<array<double>> as array<struct<x, y>>."""
    return F.transform(points, lambda q: F.struct(q[0].cast("double").alias("x"), q[1].cast("double").alias("y")))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width < height, "portrait").when(width > height, "landscape").otherwise("square")
