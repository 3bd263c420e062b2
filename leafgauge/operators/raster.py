"""Label masks and rasters as pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgauge.functions.geometry import overlap_decision, point_in_polygon


def pixels(grids: DataFrame, column: str, width: int, *keys: str) -> DataFrame:
    """(keys, x, y, v) from rows that hold a grid as an array, line by line."""
    df = grids.select(*keys, F.posexplode(column).alias("i", "v"))
    return df.select(*keys, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "v")


def mask_overlap(labels: DataFrame, boxes: DataFrame, key: str, polygon: Column | None = None) -> DataFrame:
    """(key, region_id, geometry_pixels, nonzero, dominant, overlap_rate, dominant_share, inside, confidence).

    ``labels``: key, x, y, v (0 is no bubble).  ``boxes``: key, region_id, x0, y0, x1, y1 in
    pixels (and the columns of ``polygon``).  A pixel counts when its centre lies in the
    polygon, or in the box without one.  Ties of the dominant label go to the lesser label.
    """
    met = boxes.join(labels, key).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    if polygon is not None:
        met = met.where(polygon.isNull() | point_in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, polygon))
    per = met.groupBy(key, "region_id", "v").agg(F.count("*").alias("n"))
    agg = per.groupBy(key, "region_id").agg(
        F.sum("n").alias("geometry_pixels"), F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0)).alias("nonzero"),
        F.min(F.when(F.col("v") != 0, F.struct((-F.col("n")).alias("n"), F.col("v").alias("label")))).alias("top"),
    )
    rate = F.col("nonzero") / F.col("geometry_pixels")
    share = F.coalesce(F.try_divide(-F.col("top.n"), F.col("nonzero")), F.lit(0.0))
    df = agg.withColumns({"dominant": F.col("top.label"), "overlap_rate": rate, "dominant_share": share})
    decision = overlap_decision(F.col("overlap_rate"), F.col("dominant_share"))
    return df.withColumn("d", decision).select(key, "region_id", "geometry_pixels", "nonzero", "dominant", "overlap_rate", "dominant_share", F.col("d.inside").alias("inside"), F.col("d.confidence").alias("confidence"))


def _near(df: DataFrame, reach: int) -> DataFrame:
    """Each pixel sent to its neighbours within ``reach``: (key, x, y of the receiver, dx, dy, columns of the sender)."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
    return df.withColumn("s", F.explode(steps)).withColumn("x", F.col("x") - F.col("s.dx")).withColumn("y", F.col("y") - F.col("s.dy"))


def outside_changes(before: DataFrame, after: DataFrame, mask: DataFrame, key: str, width: int, height: int, tolerance: float = 0) -> DataFrame:
    """Per raster: pixels changed outside the mask, greatest delta, edge strength inside and around it, residual risk.

    All inputs: key, x, y, v with one grey value a pixel (mask: v > 0 is masked).  Edges are
    Sobel magnitudes of ``after`` with clamped borders; around means within two pixels.  One
    aggregation over pixels sent to their neighbours replaces the neighbour joins.
    """
    base = after.select(key, "x", "y", F.col("v").alias("a")).join(before.select(key, "x", "y", F.col("v").alias("b")), [key, "x", "y"]).join(mask.select(key, "x", "y", (F.col("v") > 0).alias("m")), [key, "x", "y"])
    # Borders are clamped: a border pixel also stands for those beyond it.
    wide = base.select(key, "a", "m", F.explode(F.array_distinct(F.array(F.col("x"), F.when(F.col("x") == 0, -1).otherwise(F.col("x")), F.when(F.col("x") == width - 1, width).otherwise(F.col("x"))))).alias("x"), "y", F.lit(True).alias("_"))
    wide = wide.select(key, "a", "x", F.explode(F.array_distinct(F.array(F.col("y"), F.when(F.col("y") == 0, -1).otherwise(F.col("y")), F.when(F.col("y") == height - 1, height).otherwise(F.col("y"))))).alias("y"))
    dx, dy = F.col("s.dx"), F.col("s.dy")
    gx = F.when(dx == 0, 0).otherwise(dx * F.when(dy == 0, 2).otherwise(1))
    gy = F.when(dy == 0, 0).otherwise(dy * F.when(dx == 0, 2).otherwise(1))
    edges = _near(wide, 1).where(f"x between 0 and {width - 1} and y between 0 and {height - 1}").groupBy(key, "x", "y").agg(F.hypot(F.sum(gx * F.col("a")), F.sum(gy * F.col("a"))).alias("edge"))
    near = _near(base.where("m").select(key, "x", "y"), 2).select(key, "x", "y").distinct().withColumn("near", F.lit(True))
    df = base.join(edges, [key, "x", "y"]).join(near, [key, "x", "y"], "left")
    delta = F.abs(F.col("a") - F.col("b"))
    out = ~F.col("m")
    agg = df.groupBy(key).agg(
        F.count_if(out & (delta > tolerance)).alias("changed"), F.coalesce(F.max(F.when(out, delta)), F.lit(0.0)).alias("max_delta"), F.count_if(out).alias("outside"), F.count_if("m").alias("inside"),
        F.coalesce(F.avg(F.when(F.col("m"), F.col("edge"))), F.lit(0.0)).alias("inside_edges"), F.coalesce(F.avg(F.when(out & F.col("near"), F.col("edge"))), F.lit(0.0)).alias("around_edges"),
    )
    return agg.withColumn("risk", (F.col("inside") > 0) & (F.col("inside_edges") > F.greatest(F.lit(80.0), 2.5 * F.col("around_edges"))))
