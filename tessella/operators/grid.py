"""Overlapping tile grids over image extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import names


def stride_of(size: int, overlap: float) -> int:
    """size times what doesn't overlap, rounded half to even."""
    if size < 1 or not 0 <= overlap < 1:
        raise ValueError("a size is 1 at least, an overlap from 0 to under 1")
    return max(1, round(size * (1 - overlap)))


def sizes_table(spark, sizes: list[int], overlap: float) -> DataFrame:
    return spark.createDataFrame([(s, stride_of(s, overlap)) for s in sizes], "tile_size int, stride int")


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges both sides: cuts and tiles are as many as the table has.

    Spark takes exploded rows to be as few as those before, and compressed columns
    to be as small as their file, so it would send a large table whole through the driver.
    """
    return df.hint("merge")


def tile_grid(cuts: DataFrame, sizes: list[int], overlap: float = 0.2, stop_at_edge: bool = False) -> DataFrame:
    """Columns cut_name, width, height to one row for each tile, with its clipped box and padding.

    Tails are kept; with ``stop_at_edge`` a row or column ends at the first tile
    that touches the border.
    """
    sized = cuts.select("cut_name", "width", "height", F.explode(F.array(*[F.struct(F.lit(s).alias("tile_size"), F.lit(stride_of(s, overlap)).alias("stride")) for s in sizes])).alias("g"))
    sized = sized.select("cut_name", "width", "height", "g.*")
    starts = lambda extent: F.sequence(F.lit(0).cast("long"), F.col(extent).cast("long") - 1, F.col("stride").cast("long"))
    sized = sized.filter("width > 0 AND height > 0")
    out = sized.select("*", F.posexplode(starts("height")).alias("row", "y0")).select("*", F.posexplode(starts("width")).alias("col", "x0"))
    if stop_at_edge:
        first = lambda at, extent: (F.col(at) == 0) | (F.col(at) - F.col("stride") + F.col("tile_size") < F.col(extent))
        out = out.filter(first("x0", "width") & first("y0", "height"))
    x1, y1 = F.least(F.col("x0") + F.col("tile_size"), F.col("width").cast("long")), F.least(F.col("y0") + F.col("tile_size"), F.col("height").cast("long"))
    out = out.withColumns({"x1": x1, "y1": y1})
    return out.select(
        "cut_name", "tile_size", "row", "col", "x0", "y0", "x1", "y1",
        (F.col("x0") + F.col("tile_size") - F.col("x1")).alias("pad_right"), (F.col("y0") + F.col("tile_size") - F.col("y1")).alias("pad_bottom"),
    )


def with_tile_ids(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_id", names.tile_id(F.col("cut_name"), F.col("tile_size"), F.col("row"), F.col("col")))


def quadrants(tiles: DataFrame) -> DataFrame:
    """Each tile's box as two by two boxes; an odd size is an error."""
    size = F.when(F.col("tile_size") % 2 != 0, F.raise_error(F.lit("an odd tile size has no quadrants")).cast("int")).otherwise(F.col("tile_size"))
    halfs = F.floor(size / 2).cast("long")
    corner = lambda i, j: F.struct(F.lit(2 * j + i).alias("quadrant"), (F.col("x0") + i * halfs).alias("qx0"), (F.col("y0") + j * halfs).alias("qy0"), (F.col("x0") + (i + 1) * halfs).alias("qx1"), (F.col("y0") + (j + 1) * halfs).alias("qy1"))
    return tiles.select("*", F.inline(F.array(*[corner(i, j) for j in (0, 1) for i in (0, 1)])))


def candidate_cells(at: Column, size: Column, stride: Column, extent: Column, reach_low: Column | None = None, reach_high: Column | None = None) -> Column:
    """Grid lines whose tile can hold a coordinate or an interval of them, as a sequence.

    Borders count as inside.  The tile of line i spans from i * stride to
    that plus size, clipped at the extent.
    """
    low, high = (at if reach_low is None else reach_low), (at if reach_high is None else reach_high)
    last = F.floor((extent - 1) / stride)
    first = F.greatest(F.lit(0), F.ceil((low - size) / stride))
    end = F.least(last, F.floor(high / stride))
    return F.when(first <= end, F.sequence(first.cast("long"), end.cast("long"))).otherwise(F.array().cast("array<bigint>"))
