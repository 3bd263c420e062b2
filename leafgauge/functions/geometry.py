"""Boxes, polygons and overlap decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INSIDE = 0.80
OUTSIDE = 0.05


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height); 0 for an empty union, null for a null box."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"]))
    both = a["width"] * a["height"] + b["width"] * b["height"] - w * h
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(both > 0, w * h / both).otherwise(F.lit(0.0))


def overlap_decision(overlap: Column, share: Column) -> Column:
    """(inside, confidence): inside, outside or undecided (null) by overlap and dominant share."""
    inside = (overlap >= INSIDE) & (share >= INSIDE)
    outside = overlap <= OUTSIDE
    return F.struct(
        F.when(inside, F.lit(True)).when(outside, F.lit(False)).alias("inside"),
        F.when(inside, F.least(overlap, share)).when(outside, 1 - overlap).otherwise(F.greatest(overlap, 1 - overlap)).alias("confidence"),
    )


def capacity(box: Column, glyph: int = 20) -> Column:
    """Characters that fit a box; null without a box of positive size."""
    n = F.floor(box["width"] / glyph) * F.floor(box["height"] / glyph)
    return F.when((box["width"] > 0) & (box["height"] > 0), F.greatest(F.lit(1), n))


def _edges(points: Column) -> Column:
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.zip_with(points, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def polygon_area(points: Column) -> Column:
    """Area of a polygon given as an array of (x, y)."""
    cross = F.aggregate(_edges(points), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(cross) / 2


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule."""
    crossed = F.filter(
        _edges(points),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1
