"""Tables that grow with the input are never sent whole through the driver."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import rings
from tessella.operators import grid, review, review_sampling, sampling, spatial


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    cuts = spark.range(200).select(F.concat(F.lit("P"), "id").alias("cut_name"), F.lit(2000).cast("long").alias("width"), F.lit(1500).cast("long").alias("height"))
    points = cuts.select("cut_name", F.col("cut_name").alias("id"), F.lit(700).alias("cx"), F.lit(600).alias("cy"), F.lit(1).alias("stage"))
    for name, df in (("cuts", cuts), ("points", points)):
        df.write.parquet(str(tmp_path / name))
    cuts, points = (spark.read.parquet(str(tmp_path / n)) for n in ("cuts", "points"))
    square = rings.ring(*[(F.col("cx") + i, F.col("cy") + j) for i, j in ((0, 0), (50, 0), (50, 50), (0, 50))])
    return cuts, grid.tile_grid(cuts, [512]), points, points.select("cut_name", "id", square.alias("ring"))


@pytest.mark.parametrize("what", ["with", "without", "coverage", "clipped", "centred"])
def test_tiles_and_cuts_are_exchanged(tables, what):
    cuts, tiles, points, outlines = tables
    made = {
        "with": lambda: spatial.tiles_with_points(tiles, points, cuts, [512]),
        "without": lambda: spatial.tiles_without_points(tiles, points, cuts, [512], 0.2, 64),
        "coverage": lambda: spatial.tile_coverage(tiles, outlines, cuts, [512]),
        "clipped": lambda: spatial.clipped_instances(tiles, outlines, cuts, [512]),
        "centred": lambda: review_sampling.centred(points, cuts, 128),
    }[what]()
    found = plan(made)
    assert "SortMergeJoin" in found and "BroadcastExchange" not in found


def test_cuts_of_annotations_are_exchanged(tables):
    cuts, _, _, outlines = tables
    boxes = cuts.select(F.col("cut_name").alias("stem"), F.lit(0).alias("cut_index"), "cut_name", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    found = plan(spatial.assign_to_cuts(outlines.withColumnRenamed("cut_name", "stem"), boxes))
    assert "SortMergeJoin" in found and "BroadcastExchange" not in found


def test_orders_are_tried_once(spark):
    """Only tries are exchanged 512-fold, once, and without their hashes."""
    tiles = spark.range(40).selectExpr("id AS tile_id", "id % 3 AS tile_size", "id % 2 AS label", "id % 4 AS session")
    found = plan(sampling.display_order(tiles, "tile_id", "tile_size", "label"))
    assert found.count("Generate explode") == 1


def test_frames_end_at_the_row(spark):
    """A frame that begins behind each row costs the square of a session."""
    rows = spark.range(40).selectExpr("id % 4 AS session", "id AS display_index", "CASE WHEN id % 3 > 0 THEN true END AS collaborator_label")
    assert "RowFrame, 1, unboundedfollowing" not in plan(review.next_unlabelled(rows))
