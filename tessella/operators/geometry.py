"""Outlines with the roles of their rings, and which of them can be measured.

A feature keeps all its rings: ``parts`` is an array of polygons, each an array
of rings, the outer one first.  Areas are measured on single rings only, so that
holes and further parts are refused there and never cut away unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import names, rings
from tessella.operators.index import hold
from tessella.operators.polygon_area import covered_area

PARTS = f"array<array<array<{rings.POINT}>>>"
#: Points of a ring at least, to have an area.
LEAST = 3


def parts(kind: Column, coordinates: Column) -> Column:
    """All rings of GeoJSON coordinates as text; null for a type without rings, or coordinates that aren't numbers."""
    points = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    line = F.array(F.array(points(F.from_json(coordinates, "array<array<double>>"))))
    polygon = F.array(F.transform(F.from_json(coordinates, "array<array<array<double>>>"), points))
    many = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"), lambda p: F.transform(p, points))
    found = F.when(kind == "LineString", line).when(kind == "Polygon", polygon).when(kind == "MultiPolygon", many).cast(PARTS)
    broken = F.exists(found, lambda p: p.isNull() | F.exists(p, lambda r: r.isNull() | F.exists(r, lambda q: q["x"].isNull() | q["y"].isNull())))
    return F.when(~F.coalesce(broken, F.lit(True)), found)


def features(rows: DataFrame) -> DataFrame:
    """``rows`` (stem, feature_pos, geom_type, coordinates and more) with ``parts`` and ``ring``, the first part's outer ring."""
    found = rows.withColumn("parts", parts(F.col("geom_type"), F.col("coordinates")))
    return found.withColumn("ring", F.get(F.get("parts", F.lit(0)), F.lit(0)))


def lossy(rows: DataFrame) -> DataFrame:
    """Features whose area a single ring can't tell: stem, feature_pos, reason."""
    holes = F.size(F.get("parts", F.lit(0))) - 1
    reason = F.when(F.col("geom_type") == "MultiPolygon", "several parts").when((F.col("geom_type") == "Polygon") & (holes > 0), F.format_string("%d holes", holes))
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("stem", "feature_pos", "reason")


def even_odd_area(ring: str) -> Column:
    """The area inside a ring by the even-odd rule, also where it crosses itself."""
    b = rings.bounds(F.col(ring))
    return covered_area(F.array(F.col(ring)), b["x0"], b["y0"], b["x1"], b["y1"])


def unusable(rows: DataFrame) -> DataFrame:
    """Features without a measurable ring: stem, feature_pos, reason (not a ring, too few points, no area)."""
    area = rows.filter(F.size("ring") >= LEAST).withColumn("__a", even_odd_area("ring")).select("stem", "feature_pos", "__a")
    both = rows.filter(F.col("feature_pos").isNotNull()).join(area, ["stem", "feature_pos"], "left")
    reason = F.when(F.col("ring").isNull(), "not a ring").when(F.size("ring") < LEAST, "too few points").when(~(F.col("__a") > 0), "no area")
    return both.withColumn("reason", reason).filter("reason IS NOT NULL").select("stem", "feature_pos", "reason")


def foreign(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs of a cut's tiles and an annotation file (cut_name, stem) that don't belong together: cut_name, stem, reason.

    A file belongs to the cut that its name has before ``_annotations``.
    """
    pairs = tiles.select("cut_name", F.col("annotations_stem").alias("stem")).distinct().join(rows.select("stem").distinct(), "stem")
    reason = F.when(F.coalesce(F.col("cut_name"), F.lit("")) == "", "no cut name").when(F.col("stem") != F.concat("cut_name", F.lit("_annotations")), "of another cut")
    return pairs.withColumn("reason", reason).filter("reason IS NOT NULL").select("cut_name", "stem", "reason")


def none_usable(rows: DataFrame) -> DataFrame:
    """Files with features none of which can be measured: stem, n."""
    n = rows.groupBy("stem").agg(F.count("feature_pos").alias("n")).filter("n > 0")
    bad = unusable(rows).groupBy("stem").agg(F.count(F.lit(1)).alias("bad"))
    return n.join(bad, "stem").filter("n = bad").select("stem", "n")


def measurable(rows: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """The outlines that areas are measured on: cut_name, id, ring.

    Holes, several parts, files of another cut, and files with features but none
    that can be measured are errors; single unusable features are left out.
    """
    hold(rows, lossy(rows), "outlines whose area a single ring can't tell")
    if tiles is not None:
        hold(rows, foreign(rows, tiles), "annotations of another cut")
    hold(rows, none_usable(rows), "files without a usable outline")
    good = rows.filter("feature_pos IS NOT NULL").join(unusable(rows), ["stem", "feature_pos"], "left_anti")
    return good.select(F.regexp_replace("stem", "_annotations$", "").alias("cut_name"), "id", "ring")


def instance_lines(clips: DataFrame, classes: dict[int, int], boxes: bool = False) -> DataFrame:
    """Label lines of clipped outlines (tile columns, stage, ring in cut coordinates) in shares of their tile: tile columns, line.

    ``classes`` gives a stage's class; other stages and rings of under three points give no line.
    """
    cls = F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("stage"))
    local = rings.translate(F.col("ring"), F.col("x0"), F.col("y0"))
    size = F.col("tile_size").cast("double")
    rows = clips.withColumns({"__c": cls, "__r": local})
    line = rings.detection_line(F.col("__c"), rings.bounds(F.col("__r")), size, size) if boxes else rings.segmentation_line(F.col("__c"), F.col("__r"), size, size)
    rows = rows.withColumn("line", F.when(F.col("__c").isNotNull() & (F.size("__r") >= LEAST), line))
    return rows.filter("line IS NOT NULL").select(*[c for c in clips.columns if c not in ("ring", "visible")], "line")


def stem_of_cut_file(stem: Column) -> Column:
    """The slide of an annotation file of a cut."""
    return names.stem_of_cut(F.regexp_replace(stem, "_annotations$", ""))
