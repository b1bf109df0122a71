"""Outlines as arrays of points: struct<x: double, y: double>.  Columns to columns; a null ring gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: double, y: double>"


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def outer_ring(kind: Column, coordinates: Column) -> Column:
    """From GeoJSON coordinates as text: a LineString as it is, a Polygon's first ring, a MultiPolygon's largest.

    A third number of a point is dropped; any other type is an error.
    """
    points = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    line = points(F.from_json(coordinates, "array<array<double>>"))
    polygon = points(F.get(F.from_json(coordinates, "array<array<array<double>>>"), F.lit(0)))
    parts = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), lambda p, i: F.struct(area(points(F.get(p, F.lit(0)))).alias("area"), (-i).alias("i"), points(F.get(p, F.lit(0))).alias("ring")))
    return (
        F.when(kind == "LineString", line).when(kind == "Polygon", polygon).when(kind == "MultiPolygon", F.array_max(parts)["ring"])
        .otherwise(F.raise_error(F.concat(F.lit("no outline in a "), F.coalesce(kind, F.lit("null"))))).cast(f"array<{POINT}>")
    )


def _turned(r: Column) -> Column:
    """Each point's successor, the first after the last."""
    return F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def _cross(r: Column) -> Column:
    return F.zip_with(r, _turned(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def area(r: Column) -> Column:
    """By the shoelace formula; 0 under three points."""
    return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.abs(_sum(_cross(r))) / 2)


def perimeter(r: Column) -> Column:
    return _sum(F.zip_with(r, _turned(r), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def vertex_centroid(r: Column) -> Column:
    """The mean of the vertices, a repeated closing one included; an empty ring is an error."""
    mean = lambda c: _sum(F.transform(r, lambda p: p[c])) / F.size(r)
    return F.when(F.size(r) == 0, F.raise_error(F.lit("an outline without points")).cast(POINT)).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y")))


def area_centroid(r: Column) -> Column:
    """The centre of the area; null without area."""
    twice = _sum(_cross(r))
    part = lambda c: _sum(F.zip_with(F.zip_with(r, _turned(r), lambda p, q: p[c] + q[c]), _cross(r), lambda a, b: a * b)) / (3 * F.nullif(twice, F.lit(0.0)))
    return F.when(twice != 0, F.struct(part("x").alias("x"), part("y").alias("y")))


def bounds(r: Column) -> Column:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def translate(r: Column, x0: Column, y0: Column) -> Column:
    """Moved to a new origin, rounded half to even to ten places."""
    return F.transform(r, lambda p: F.struct(F.bround(p["x"] - x0, 10).alias("x"), F.bround(p["y"] - y0, 10).alias("y")))


def box_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return overlap_area(a, b) / F.nullif(F.least(box_area(a), box_area(b)), F.lit(0.0))


def in_box(x: Column, y: Column, b: Column) -> Column:
    """On the border counts, on all four sides."""
    return x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"])


def box_metrics(r: Column) -> Column:
    """Box area (null if it has none), share of the box covered, width over height."""
    b = bounds(r)
    boxed = F.nullif(box_area(b), F.lit(0.0))
    return F.struct(boxed.alias("bbox_area"), (area(r) / boxed).alias("coverage"), ((b["x1"] - b["x0"]) / F.nullif(b["y1"] - b["y0"], F.lit(0.0))).alias("aspect"))


def centred_box(cx: Column, cy: Column, size: int, width: Column, height: Column) -> Column:
    """A tile box around a point, shifted into the image."""
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.bround(c - size / 2).cast("long"), (most - size).cast("long")))
    x, y = at(cx, width), at(cy, height)
    return F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))


def detection_line(cls: Column, b: Column, width: Column, height: Column) -> Column:
    """``class cx cy w h`` in shares of the image, clipped, six places."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.format_string(
        "%d %.6f %.6f %.6f %.6f", cls, clip((b["x0"] + b["x1"]) / 2 / width), clip((b["y0"] + b["y1"]) / 2 / height), clip((b["x1"] - b["x0"]) / width), clip((b["y1"] - b["y0"]) / height)
    )


def segmentation_line(cls: Column, r: Column, width: Column, height: Column, most: int = 200) -> Column:
    """``class x y x y ...`` in shares of the image, the closing point dropped, thinned evenly; null under three points."""
    closed = (F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1))
    r = F.when(closed, F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    n = F.size(r)
    thin = F.when(n > most, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(r, F.floor(i * (n - 1) / (most - 1)).cast("int") + 1))).otherwise(r)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    points = F.transform(thin, lambda p: F.format_string("%.6f %.6f", clip(p["x"] / width), clip(p["y"] / height)))
    return F.when(n >= 3, F.concat_ws(" ", cls.cast("string"), F.array_join(points, " ")))


def thumbnail_box(x: Column, y: Column, w: Column, h: Column, scale: float, margin: int, width: Column, height: Column) -> Column:
    """A region of a thumbnail at full resolution: margin, clamp, and scaling cut to whole pixels."""
    low = lambda c: (F.greatest(F.lit(0), c - margin) * scale).cast("long")
    high = lambda c, d, most: F.least(most.cast("long"), ((c + d + margin) * scale).cast("long"))
    return F.struct(low(x).alias("x0"), low(y).alias("y0"), high(x, w, width).alias("x1"), high(y, h, height).alias("y1"))
