"""Spatial joins on arithmetic grids.

A join of points or boxes with tiles never compares all of a cut's pairs: a
tile's row and column follow from its place, so each point or box is exploded
to the few cells that can hold it and joined by equality; the exact test comes
after.  Neither side is assumed small, and a cut with very many annotations is
split by cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import rings
from tessella.operators.geometry import even_odd_area
from tessella.operators.grid import candidate_cells, exchanged, stride_of
from tessella.operators.polygon_area import CELLS, batch_areas, boxes_area, clip_ring, covered_area, listed
from tessella.session import can_checkpoint

RING = f"array<{rings.POINT}>"
CELL = ["cut_name", "tile_size", "row", "col"]
#: Different boxes of a cell whose union is taken at once, and boxes of a group that is settled at once.
DENSE = 256
#: Fuller groups whose names are broadcast at most.
MOST_FULL = 100_000


def _cells(df: DataFrame, sizes: list[int], overlap: float, low: tuple[str, str], high: tuple[str, str]) -> DataFrame:
    """Each row at every grid cell that its box [low, high] may touch; needs the cut's width and height."""
    sized = df.select("*", F.inline(F.array(*[F.struct(F.lit(s).alias("tile_size"), F.lit(stride_of(s, overlap)).alias("__stride")) for s in sizes])))
    lines = lambda k, extent: candidate_cells(F.col(low[k]), F.col("tile_size"), F.col("__stride"), F.col(extent), F.col(low[k]), F.col(high[k]))
    placed = sized.select("*", F.explode(lines(1, "height")).alias("row")).select("*", F.explode(lines(0, "width")).alias("col"))
    return placed.withColumns({"row": F.col("row").cast("int"), "col": F.col("col").cast("int")}).drop("__stride")


def points_in_tiles(tiles: DataFrame, points: DataFrame, cuts: DataFrame, sizes: list[int], overlap: float = 0.2) -> DataFrame:
    """Pairs of tiles and points (cut_name, cx, cy and more) inside or on the border of their box."""
    at = _cells(points.join(exchanged(cuts.select("cut_name", "width", "height")), "cut_name"), sizes, overlap, ("cx", "cy"), ("cx", "cy")).drop("width", "height")
    found = exchanged(tiles).join(at, CELL)
    return found.filter(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))


def tiles_with_points(tiles: DataFrame, points: DataFrame, cuts: DataFrame, sizes: list[int], overlap: float = 0.2) -> DataFrame:
    """Every tile with the number of points in it and their distinct stages."""
    found = points_in_tiles(tiles, points, cuts, sizes, overlap)
    counts = found.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_points"), F.sort_array(F.collect_set("stage")).alias("stages"))
    return exchanged(tiles).join(counts, CELL, "left").withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))


def tiles_without_points(tiles: DataFrame, points: DataFrame, cuts: DataFrame, sizes: list[int], overlap: float, buffer: float) -> DataFrame:
    """Tiles that no point comes nearer than ``buffer``, in either direction, border included."""
    wide = points.join(exchanged(cuts.select("cut_name", "width", "height")), "cut_name").withColumns({"__x0": F.col("cx") - buffer, "__x1": F.col("cx") + buffer, "__y0": F.col("cy") - buffer, "__y1": F.col("cy") + buffer})
    at = _cells(wide, sizes, overlap, ("__x0", "__y0"), ("__x1", "__y1")).select(*CELL, "cx", "cy")
    near = exchanged(tiles).join(at, CELL).filter(F.col("cx").between(F.col("x0") - buffer, F.col("x1") + buffer) & F.col("cy").between(F.col("y0") - buffer, F.col("y1") + buffer))
    return exchanged(tiles).join(near.select(*CELL).distinct(), CELL, "left_anti")


#: Edges of a strip of a tile, about; a tile with more is cut into so many strips of equal height.
STRIP_EDGES = 2000
#: Points of an outline from which it is itself cut to the heights of a tile.
LONG_RING = 64


def _upright(r: Column) -> Column:
    """Whether a ring is a rectangle with upright sides, which its bounds tell."""
    p = lambda i: F.get(r, F.lit(i))
    turns = lambda a, c: (p(0)[a] == p(1)[a]) & (p(1)[c] == p(2)[c]) & (p(2)[a] == p(3)[a]) & (p(3)[c] == p(0)[c])
    closed = (F.size(r) == 4) | (F.size(r) == 5) & (p(4) == p(0))
    return F.coalesce(closed & (turns("x", "y") | turns("y", "x")), F.lit(False))


def _corners(r: Column) -> Column:
    """The bounds of an upright rectangle, from two points that face each other."""
    p, q = F.get(r, F.lit(0)), F.get(r, F.lit(2))
    return F.struct(F.least(p["x"], q["x"]).alias("x0"), F.least(p["y"], q["y"]).alias("y0"), F.greatest(p["x"], q["x"]).alias("x1"), F.greatest(p["y"], q["y"]).alias("y1"))


def _marked(outlines: DataFrame, key: str) -> DataFrame:
    """Usable outlines with their bounds, how many edges they have, and their points: none for an upright rectangle, which its bounds tell."""
    r = F.col("ring")
    b = rings.bounds(r)
    rows = outlines.filter(F.size("ring") >= 3).select(key, "ring", b.alias("b")).select(key, "ring", F.col("b.x0").alias("__x0"), F.col("b.y0").alias("__y0"), F.col("b.x1").alias("__x1"), F.col("b.y1").alias("__y1"))
    upright = _upright(r)
    return rows.select(key, "__x0", "__y0", "__x1", "__y1", F.when(upright, 2).otherwise(F.size(r)).alias("__n"), F.when(~upright, r).alias("__ring"))


def _areas(names: list[str], schema: pa.Schema):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in names] + [pa.array(batch_areas(batch))], schema=schema)

    return run


def _covered(near: DataFrame, crowded: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, __area: of each key's box x0, y0, x1, y1 what the marked outlines beside it cover together.

    Area adds up, so a crowded box (keys, __strips) is cut into strips that are
    grouped apart, each with the edges that reach it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    box = ["x0", "y0", "x1", "y1"]
    near = near.join(crowded, keys, "left").withColumn("__strips", F.coalesce("__strips", F.lit(1)))
    height = (F.col("y1") - F.col("y0")) / F.col("__strips")
    at = lambda c: F.least(F.col("__strips") - 1, F.greatest(F.lit(0), F.floor((F.col(c) - F.col("y0")) / height).cast("int")))
    cut = near.withColumn("__strip", F.explode(F.when(F.col("__strips") > 1, F.sequence(at("__y0"), at("__y1"))).otherwise(F.array(F.lit(0)))))
    low, high = F.col("y0") + F.col("__strip") * height, F.when(F.col("__strip") == F.col("__strips") - 1, F.col("y1")).otherwise(F.col("y0") + (F.col("__strip") + 1) * height)
    cut = cut.select(*keys, "__strip", F.col("x0").cast("double"), low.cast("double").alias("y0"), F.col("x1").cast("double"), high.cast("double").alias("y1"), "__x0", "__y0", "__x1", "__y1", "__ring", F.monotonically_increasing_id().alias("__o"))
    r = F.col("__ring")
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    edges = F.zip_with(r, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), F.col("__o").cast("double").alias("o")))
    edges = F.when(F.size(r) > LONG_RING, F.filter(edges, lambda e: (F.least(e["y1"], e["y2"]) <= F.col("y1")) & (F.greatest(e["y1"], e["y2"]) >= F.col("y0")))).otherwise(edges)
    upright = F.struct(*[F.col(c).cast("double").alias(c) for c in ("__x0", "__y0", "__x1", "__y1")])
    rows = cut.groupBy(*keys, "__strip", *box).agg(F.collect_list(F.when(r.isNull(), upright)).alias("boxes"), F.flatten(F.collect_list(F.when(r.isNotNull(), edges))).alias("edges"))
    kind = T.StructType([*[rows.schema[c] for c in keys], T.StructField("__area", T.DoubleType())])
    parts = rows.mapInArrow(_areas(keys, to_arrow_schema(kind)), kind)
    return parts.groupBy(*keys).agg(F.sum("__area").alias("__area"))


def tile_coverage(tiles: DataFrame, outlines: DataFrame, cuts: DataFrame, sizes: list[int], overlap: float = 0.2) -> DataFrame:
    """Every tile with ``area_fraction``: the share of its clipped box that its cut's outlines cover together.

    ``outlines`` has cut_name and ring.  Overlapping outlines count once, by the
    even-odd rule for each; a degenerate box is an error, as are holes, which a
    single ring can't have.
    """
    marked = _marked(outlines, "cut_name").join(exchanged(cuts.select("cut_name", "width", "height")), "cut_name")
    at = _cells(marked, sizes, overlap, ("__x0", "__y0"), ("__x1", "__y1"))
    crowded = _cells(marked.drop("__ring"), sizes, overlap, ("__x0", "__y0"), ("__x1", "__y1")).groupBy(*CELL).agg(F.sum("__n").alias("__n")).filter(F.col("__n") > STRIP_EDGES)
    crowded = crowded.select(*CELL, F.ceil(F.col("__n") / STRIP_EDGES).cast("int").alias("__strips"))
    near = at.drop("width", "height").join(exchanged(tiles.select(*CELL, "x0", "y0", "x1", "y1")), CELL).filter("__x0 < x1 AND __x1 > x0 AND __y0 < y1 AND __y1 > y0")
    box = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    share = F.least(F.lit(1.0), F.coalesce("__area", F.lit(0.0)) / box)
    return exchanged(tiles).join(_covered(near, crowded, CELL), CELL, "left").withColumn("area_fraction", F.when(box <= 0, F.raise_error(F.lit("a tile without area")).cast("double")).otherwise(share)).drop("__area")


def covered_share(outlines: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every cut with the share of its whole area that its outlines cover together."""
    marked = _marked(outlines, "cut_name")
    crowded = marked.groupBy("cut_name").agg(F.sum("__n").alias("__n")).filter(F.col("__n") > STRIP_EDGES).select("cut_name", F.ceil(F.col("__n") / STRIP_EDGES).cast("int").alias("__strips"))
    zero = F.lit(0.0)
    whole = cuts.select("cut_name", zero.alias("x0"), zero.alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"))
    near = marked.join(exchanged(whole), "cut_name").filter("__x0 < x1 AND __x1 > x0 AND __y0 < y1 AND __y1 > y0")
    full = exchanged(cuts).join(_covered(near, crowded, ["cut_name"]), "cut_name", "left")
    return full.select(*cuts.columns, (F.coalesce("__area", zero) / (F.col("width") * F.col("height"))).alias("covered_share"))


def _touching(outlines: DataFrame, tiles: DataFrame, side: int, most: tuple[float, float]) -> DataFrame:
    """Pairs of outlines with bounds __x0 to __y1 and tiles of their cut whose boxes share some area.

    Both sides meet in square blocks that hold a few dozen tiles, so an outline is
    exchanged once, and not for each tile; a pair counts in the block that
    holds the low corner of what it shares.  ``most`` ends the blocks of
    outlines that reach beyond any cut.
    """
    block = lambda c: F.floor(c / side).cast("int")
    span = lambda low, high, end: F.when(low <= end, F.sequence(block(F.greatest(low, F.lit(0))), block(F.least(F.greatest(high, low, F.lit(0)), F.lit(end))))).otherwise(F.array().cast("array<int>"))
    placed = lambda df, pre: df.select("*", F.explode(span(F.col(f"{pre}x0"), F.col(f"{pre}x1"), most[0])).alias("__bx")).select("*", F.explode(span(F.col(f"{pre}y0"), F.col(f"{pre}y1"), most[1])).alias("__by"))
    there = exchanged(placed(tiles, "").withColumnsRenamed({"cut_name": "__cut", "__bx": "__tx", "__by": "__ty"}))
    same = (F.col("cut_name") == F.col("__cut")) & (F.col("__bx") == F.col("__tx")) & (F.col("__by") == F.col("__ty"))
    shared = (F.col("__x0") < F.col("x1")) & (F.col("__x1") > F.col("x0")) & (F.col("__y0") < F.col("y1")) & (F.col("__y1") > F.col("y0"))
    here = (F.col("__bx") == block(F.greatest("__x0", "x0"))) & (F.col("__by") == block(F.greatest("__y0", "y0")))
    return placed(outlines, "__").join(there, same & shared & here).drop("__cut", "__bx", "__by", "__tx", "__ty")


def clipped_instances(tiles: DataFrame, outlines: DataFrame, cuts: DataFrame, sizes: list[int], overlap: float = 0.2, least: float = 0.3) -> DataFrame:
    """Outlines cut to the tiles that show at least a share of their area: columns of the tile, id, ring, visible, and others of theirs.

    Areas go by the even-odd rule, so that outlines that cross themselves count in
    full; an upright rectangle's share follows from its bounds, so its points are
    only moved where the result's ring is read.  The tiles' own boxes are compared,
    whatever their ``overlap``; of the cuts only the largest sides matter.
    """
    others = [c for c in outlines.columns if c not in ("cut_name", "id", "ring")]
    most = cuts.agg(F.max("width"), F.max("height")).first()
    most = tuple(float(m or 0) for m in most)
    tiles = tiles.filter(F.col("tile_size").isin(sizes))
    whole = (F.col("__x0") >= F.col("x0")) & (F.col("__x1") <= F.col("x1")) & (F.col("__y0") >= F.col("y0")) & (F.col("__y1") <= F.col("y1"))
    side = lambda c: F.least(f"__{c}1", f"{c}1") - F.greatest(f"__{c}0", f"{c}0")
    own = (F.col("__x1") - F.col("__x0")) * (F.col("__y1") - F.col("__y0"))

    def bounded(kind: Column, bounds: Column) -> DataFrame:
        """Outlines of a kind; they are chosen by ``explode``, as Spark would repeat a filter's test, point by point, in the joins before it."""
        named = F.struct(*[bounds[c].alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")])
        some = outlines.select("cut_name", "id", "ring", *others, F.explode(F.when(kind, F.array(F.lit(0)))))
        return some.select("cut_name", "id", "ring", *others, F.inline(F.array(named)))

    def found(some: DataFrame) -> DataFrame:
        pairs = _touching(some, tiles, 2 * max(sizes), most).withColumn("__cross", F.when(~whole, F.col("ring")))
        return pairs.withColumn("clip", F.when(whole, F.col("ring")).otherwise(clip_ring("__cross", "x0", "y0", "x1", "y1").cast(RING)))

    box = _upright(F.col("ring"))
    plain = found(bounded(box, _corners(F.col("ring")))).withColumn("visible", side("x") * side("y") / F.nullif(own, F.lit(0.0)))
    odd = found(bounded(~box, rings.bounds(F.col("ring"))).withColumn("__own", even_odd_area("ring")))
    odd = odd.withColumn("visible", even_odd_area("clip") / F.nullif(F.col("__own"), F.lit(0.0)))
    columns = [*tiles.columns, "id", F.col("clip").alias("ring"), "visible", *others]
    return plain.filter(F.col("visible") >= least).select(*columns).unionByName(odd.filter(F.col("visible") >= least).select(*columns))


def assign_to_cuts(annotations: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each annotation (stem, id, ring) with its cut: the one whose box holds its vertex centroid, the largest overlap among
    several, else the one that holds most vertices, else none; ties go to the first cut.

    ``cuts`` has stem, cut_index, cut_name and a box; a stem has few cuts, so
    the join on the stem makes few rows for each annotation.
    """
    c = rings.vertex_centroid(F.col("ring"))
    marked = annotations.select("stem", "id", "ring", c.alias("c"), rings.bounds(F.col("ring")).alias("b"))
    box = F.struct("x0", "y0", "x1", "y1")
    pairs = marked.join(exchanged(cuts.select("stem", "cut_index", "cut_name", box.alias("box"))), "stem", "left")
    inside = rings.in_box(F.col("c.x"), F.col("c.y"), F.col("box"))
    vertices = F.size(F.filter("ring", lambda p: rings.in_box(p["x"], p["y"], F.col("box"))))
    pairs = pairs.withColumns({"inside": F.coalesce(inside, F.lit(False)), "shared": rings.overlap_area(F.col("b"), F.col("box")), "vertices": F.coalesce(vertices, F.lit(0))})
    mine = Window.partitionBy("stem", "id")
    best = mine.orderBy(F.desc("inside"), F.desc(F.when(F.col("inside"), F.col("shared"))), F.desc("vertices"), F.asc("cut_index"))
    pairs = pairs.withColumns({"n_inside": F.count_if("inside").over(mine), "k": F.row_number().over(best)}).filter("k = 1")
    method = F.when(F.col("n_inside") == 1, "centroid_in_bbox").when(F.col("n_inside") > 1, "largest_overlap").when(F.col("vertices") > 0, "vertex_in_bbox").otherwise("unassigned")
    ok = method != "unassigned"
    return pairs.select("stem", "id", F.when(ok, F.col("cut_index")).alias("cut_index"), F.when(ok, F.col("cut_name")).alias("cut_name"), method.alias("method"))


def _dealt(boxes: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of groups of at most DENSE, which are settled many groups at a time, and those of fuller ones, if there are any."""
    can_checkpoint(boxes.sparkSession)
    full = boxes.groupBy(F.col(group).alias("__full")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE).select("__full").checkpoint()
    n = full.count()
    if not n:
        return boxes, None
    side = F.broadcast(full) if n <= MOST_FULL else exchanged(full)
    of = lambda how: boxes.join(side, F.col(group).eqNullSafe(F.col("__full")), how)
    return of("left_anti"), of("left_semi")


def _united_few(names: list[str], schema: pa.Schema):
    def run(batches):
        for batch in batches:
            sides, at = listed(batch.column("boxes"), ["x0", "y0", "x1", "y1"])
            out, sizes = np.zeros(len(at) - 1), np.diff(at)
            for k in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == k)
                mine = sides[at[rows][:, None] + np.arange(k)]
                out[rows] = boxes_area(mine, np.concatenate((mine[..., :2].min(axis=1), mine[..., 2:].max(axis=1)), axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in names] + [pa.array(out)], schema=schema)

    return run


def _united(boxes: DataFrame, group: str) -> DataFrame:
    """For each group the area of its boxes' union, as summed over disjoint cells of at most DENSE different clipped boxes.

    A fuller cell is cut at the medians of the edges inside it.  Each cut halves
    those edges, and a box without an edge inside is the whole cell, so the
    rounds grow with the logarithm of a group's size.
    """
    c = F.col
    sides = {"x0": F.least("x0", "x1"), "y0": F.least("y0", "y1"), "x1": F.greatest("x0", "x1"), "y1": F.greatest("y0", "y1")}
    rest = boxes.select(c(group).alias("__g"), *[v.cast("double").alias(k) for k, v in sides.items()]).filter("x0 < x1 AND y0 < y1").distinct()
    whole = rest.groupBy("__g").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    rest = rest.alias("r").join(whole.alias("w"), c("r.__g").eqNullSafe(c("w.__g"))).select("r.*", "a", "b", "c", "d")
    cell, box = ["__g", "a", "b", "c", "d"], ["x0", "y0", "x1", "y1"]
    ring = F.array(*[F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    areas = None
    while True:
        rest = rest.persist()
        same = lambda l, r: F.expr(" AND ".join(f"{l}.{k} <=> {r}.{k}" for k in cell))
        sums = rest.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.expr("x0 = a AND y0 = b AND x1 = c AND y1 = d")).alias("full"))
        full = sums.filter("full").select("__g", ((c("c") - c("a")) * (c("d") - c("b"))).alias("area"))
        few = rest.alias("r").join(sums.filter(f"NOT full AND n <= {DENSE}").alias("s"), same("r", "s"), "left_semi")
        some = few.groupBy(*cell).agg(F.collect_list(ring).alias("rings")).select("__g", covered_area("rings", "a", "b", "c", "d").alias("area"))
        areas = full.unionByName(some) if areas is None else areas.unionByName(full).unionByName(some)
        dense = rest.alias("r").join(sums.filter(f"NOT full AND n > {DENSE}").alias("s"), same("r", "s"), "left_semi")
        if dense.isEmpty():
            return areas.groupBy("__g").agg(F.sum("area").alias("united"))
        edges = dense.select(*cell, F.explode(F.array(F.struct(c("x0").alias("x"), c("y0").alias("y")), F.struct(c("x1").alias("x"), c("y1").alias("y")))).alias("e"))
        middle = lambda e, lo, hi: F.coalesce(F.percentile_approx(F.when((c(e) > c(lo)) & (c(e) < c(hi)), c(e)), 0.5), (F.first(lo) + F.first(hi)) / 2)
        cuts = edges.groupBy(*cell).agg(middle("e.x", "a", "c").alias("mx"), middle("e.y", "b", "d").alias("my"))
        parts = dense.alias("r").join(cuts.alias("s"), same("r", "s")).select("r.*", "mx", "my")
        quarters = F.array(*[F.struct(F.expr(p).alias("p"), F.expr(q).alias("q"), F.expr(u).alias("u"), F.expr(v).alias("v")) for p, u in (("a", "mx"), ("mx", "c")) for q, v in (("b", "my"), ("my", "d"))])
        parts = parts.select("__g", *box, F.inline(quarters)).filter("x0 < u AND x1 > p AND y0 < v AND y1 > q")
        clip = [F.greatest("x0", "p").alias("x0"), F.greatest("y0", "q").alias("y0"), F.least("x1", "u").alias("x1"), F.least("y1", "v").alias("y1")]
        rest = parts.select("__g", *clip, c("p").alias("a"), c("q").alias("b"), c("u").alias("c"), c("v").alias("d")).distinct()


def box_overlap(boxes: DataFrame, group: str) -> DataFrame:
    """For each group: summed box area, area of their union, and the share that overlaps."""
    from pyspark.sql.pandas.types import to_arrow_schema

    total = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double").alias("total")
    few, many = _dealt(boxes.select(group, "x0", "y0", "x1", "y1"), group)
    low, high = [F.least(f"{a}0", f"{a}1").cast("double") for a in "xy"], [F.greatest(f"{a}0", f"{a}1").cast("double") for a in "xy"]
    box = F.struct(*[c.alias(k) for c, k in zip((*low, *high), ("x0", "y0", "x1", "y1"))])
    rows = few.groupBy(group).agg(total, F.collect_list(F.when((low[0] < high[0]) & (low[1] < high[1]), box)).alias("boxes"))
    kind = T.StructType([rows.schema[group], rows.schema["total"], T.StructField("united", T.DoubleType())])
    per = rows.mapInArrow(_united_few([group, "total"], to_arrow_schema(kind)), kind)
    if many is not None:
        full = many.groupBy(group).agg(total).join(_united(many, group), F.col(group).eqNullSafe(F.col("__g")), "left")
        per = per.unionByName(full.select(group, "total", F.coalesce("united", F.lit(0.0)).alias("united")))
    return per.select(group, "total", "united", (1 - F.col("united") / F.nullif(F.col("total"), F.lit(0.0))).alias("overlap_fraction"))


def _suppressed(small: DataFrame, big: DataFrame, most: float, larger: float, top: int, how: str) -> DataFrame:
    """Rows of ``small`` with (left_semi) or without (left_anti) a box in ``big`` that would suppress them.

    A box stands in the cells of the grid whose width is the power of two above
    its longer side, four at most.  A box looked for covers a share of this
    one's width and height, so it can't be much smaller, and where the share is
    over a half it holds the centre: that is looked up on every grid that is
    coarse enough.  The first match ends a row's search.
    """
    cell = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level))
    span = lambda lo, hi, level: F.sequence(cell(lo, level), cell(hi, level))
    there = big.select(*[F.col(c).alias(f"b_{c}") for c in ("g", "id", "n", "size", "x0", "y0", "x1", "y1")], F.col("level").alias("b_level"))
    there = there.withColumn("b_col", F.explode(span("b_x0", "b_x1", F.col("b_level")))).withColumn("b_row", F.explode(span("b_y0", "b_y1", F.col("b_level"))))
    low = F.col("level") - (1 if most > 0.5 else math.ceil(math.log2(1 / most)) + 1)
    here = small.withColumn("l", F.explode(F.sequence(low, F.greatest(low, F.lit(top)))))
    if most > 0.5:
        here = here.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
        here = here.withColumns({"col": cell("cx", F.col("l")), "row": cell("cy", F.col("l"))})
    else:
        here = here.withColumn("col", F.explode(span("x0", "x1", F.col("l")))).withColumn("row", F.explode(span("y0", "y1", F.col("l"))))
    side = lambda a: F.least(f"{a}1", f"b_{a}1") - F.greatest(f"{a}0", f"b_{a}0")
    first = (F.col("b_size") > F.col("size")) | (F.col("b_size") == F.col("size")) & (F.struct("b_id", "b_n") < F.struct(F.col("id").alias("b_id"), F.col("n").alias("b_n")))
    inside = first & (side("x") > 0) & (side("y") > 0) & (F.col("b_size") >= larger * F.col("size")) & (side("x") * side("y") / F.col("size") >= most)
    same = F.col("g").eqNullSafe(F.col("b_g")) & (F.col("l") == F.col("b_level")) & (F.col("col") == F.col("b_col")) & (F.col("row") == F.col("b_row"))
    found = here.join(there, same & inside, "left_semi").select("n").distinct()
    return small.join(found, "n", how)


def _staying_few(most: float, larger: float, schema: pa.Schema):
    """Of each group's boxes those that stay; their order is that of the list, where sizes are equal."""

    def run(batches):
        for batch in batches:
            lists = batch.column("boxes")
            sides, at = listed(lists, ["x0", "y0", "x1", "y1"])
            stays, sizes = np.ones(len(sides), dtype=bool), np.diff(at)
            for k in np.unique(sizes[sizes > 1]):
                rows = np.flatnonzero(sizes == k)
                step = max(1, CELLS // int(k * k))
                for t in range(0, len(rows), step):
                    where = at[rows[t : t + step]][:, None] + np.arange(k)
                    stays[where] = _settled(sides[where], most, larger)
            of = np.repeat(np.arange(len(sizes)), sizes)[stays]
            ids = lists.flatten().field("id").take(pa.array(np.flatnonzero(stays)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)).cast(schema.field(0).type), ids.cast(schema.field(1).type)], schema=schema)

    return run


def _settled(boxes: np.ndarray, most: float, larger: float) -> np.ndarray:
    """For groups of equally many boxes, (groups, boxes, 4), which stay; settled in rounds as in ``suppress_boxes``."""
    x0, y0, x1, y1 = np.moveaxis(boxes, -1, 0)
    size, open_ = (x1 - x0) * (y1 - y0), (x1 > x0) & (y1 > y0)
    mine, other = (slice(None), slice(None), None), (slice(None), None, slice(None))
    dx = np.minimum(x1[mine], x1[other]) - np.maximum(x0[mine], x0[other])
    dy = np.minimum(y1[mine], y1[other]) - np.maximum(y0[mine], y0[other])
    before = np.tri(boxes.shape[1], k=-1, dtype=bool)
    first = (size[other] > size[mine]) | (size[other] == size[mine]) & before
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = first & (dx > 0) & (dy > 0) & (size[other] >= larger * size[mine]) & (dx * dy / size[mine] >= most)
    inside &= open_[mine] & open_[other]
    left, stays = open_.copy(), ~open_
    while left.any():
        stay = left & ~(inside & left[other]).any(axis=2)
        stays |= stay
        left &= ~stay & ~(inside & stay[other]).any(axis=2)
    return stays


def suppress_boxes(boxes: DataFrame, group: str, most: float, larger: float = 2.0) -> DataFrame:
    """Boxes that stay when, from the largest down, a box goes whose area lies by ``most`` or more in one that stayed and
    is ``larger`` times as large at least.

    What goes depends on boxes before it in order alone (larger ones, by id among
    equals), so boxes settle in rounds: those in a kept box go, those in no
    undecided one stay.  Rounds are as many as the longest chain of boxes in
    each other; areas grow by ``larger`` along it, so they are few unless that
    is near 1.  Groups of at most DENSE boxes are settled many at a time, each in a
    table of its pairs.  No fuller group is walked through; they are cut by cells.
    Boxes without area stay.
    """
    if not 0 < most <= 1:
        raise ValueError("a share lies in (0, 1]")
    from pyspark.sql.pandas.types import to_arrow_schema

    sides = {c: F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")}
    few, many = _dealt(boxes.select(group, "id", *sides.values()), group)
    entries = F.collect_list(F.struct("id", "x0", "y0", "x1", "y1"))
    lists = few.groupBy(group).agg((entries if larger > 1 else F.array_sort(entries)).alias("boxes"))  # equal sizes go by id
    kind = T.StructType([few.schema[group], few.schema["id"]])
    small = lists.mapInArrow(_staying_few(most, larger, to_arrow_schema(kind)), kind)
    if many is None:
        return small
    all_ = many.select(F.col(group).alias("g"), "id", *sides).withColumn("size", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    longer = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    all_ = all_.withColumns({"level": F.ceil(F.log2(F.greatest(longer, F.lit(2.0**-20)))).cast("int"), "n": F.monotonically_increasing_id()}).checkpoint()
    flat = all_.filter("NOT coalesce(x1 > x0 AND y1 > y0, false)")
    open_ = all_.filter("x1 > x0 AND y1 > y0")
    top = open_.agg(F.max("level")).first()[0]
    kept = flat
    while top is not None:
        inside = _suppressed(open_, open_, most, larger, top, "left_semi")
        inside = inside.checkpoint()
        stay = open_.join(inside.select("n"), "n", "left_anti").checkpoint()
        kept = kept.unionByName(stay)
        if inside.isEmpty():
            break
        # what lies in a box that stays is gone; the rest may yet stay
        open_ = _suppressed(inside, stay, most, larger, top, "left_anti").checkpoint()
        if open_.isEmpty():
            break
    return small.unionByName(kept.select(F.col("g").alias(group), "id"))
