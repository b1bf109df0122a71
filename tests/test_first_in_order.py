"""The first tiles that pass, in a seeded order: joins are made for a few candidates alone, and all are ranked only where these don't suffice."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import review_sampling as R
from tessella.operators.grid import tile_grid


def place(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16), key


@pytest.mark.parametrize("pool", [1, 7, 30, 200, 201, 4096])
def test_any_pool_gives_the_same(spark, monkeypatch, pool):
    monkeypatch.setattr(R, "POOL", pool)
    some = spark.range(200).select(F.col("id").cast("string").alias("id")).repartition(5)
    half = lambda d, few: d.filter(F.col("id").cast("int") % 2 == 0)
    measure = lambda d: d.withColumn("tissue_fraction", (F.col("id").cast("int") % 6 == 0).cast("double"))
    got = [r.id for r in R.passing(some, "id", 20, 5, measure, 0.5, usable=half).collect()]
    assert got == sorted((str(i) for i in range(0, 200, 6)), key=lambda i: place(5, i))[:20]
    with pytest.raises(ValueError, match="only 34 tiles pass"):
        R.passing(some, "id", 35, 5, measure, 0.5, usable=half)


def test_equal_keys_stay_together(spark, monkeypatch):
    monkeypatch.setattr(R, "POOL", 3)
    some = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(4)], "id string, n int")
    once = lambda d, few: d.groupBy("id").agg(F.count("n").alias("n"))
    got = R.passing(some, "id", 2, 5, lambda d: d.withColumn("tissue_fraction", F.lit(1.0)), 0.5, usable=once).collect()
    assert sorted((r.id, r.n) for r in got) == [("a", 4), ("b", 4)]


def test_few_tiles_are_compared(spark):
    """Points are looked for beside the first tiles only, not beside every tile of the grid."""
    rng = random.Random(2)
    cuts = spark.createDataFrame([(f"c{i}", 2000, 1600) for i in range(60)], "cut_name string, width long, height long")
    rows = [(f"c{rng.randrange(60)}", f"p{i}", rng.randrange(2000), rng.randrange(1600)) for i in range(600)]
    points = spark.createDataFrame(rows, "cut_name string, id string, cx long, cy long")
    seen = []
    real = R.spatial.tiles_without_points
    try:
        R.spatial.tiles_without_points = lambda tiles, *a: seen.append(tiles.count()) or real(tiles, *a)
        R.POOL, before = 500, R.POOL
        got = R.negatives(points, cuts, 64, 10, 3, lambda d: d.withColumn("tissue_fraction", F.lit(0.9)), 0.2, 0.5).collect()
    finally:
        R.spatial.tiles_without_points, R.POOL = real, before
    assert seen == [499] and len(got) == 10  # of 48,000 tiles
    tiles = [(c, x, y, min(x + 64, 2000), min(y + 64, 1600)) for c in {r[0] for r in rows} for x in range(0, 2000, 64) for y in range(0, 1600, 64)]
    free = [f"{c}_s0064_x{x:06d}_y{y:06d}" for c, x, y, z, w in tiles if not any(p[0] == c and x - 32 <= p[2] <= z + 32 and y - 32 <= p[3] <= w + 32 for p in rows)]
    assert [r.id for r in got] == sorted(free, key=lambda i: place(3, i))[:10]


def test_tile_names(spark):
    """As formatted, also beyond their width, below zero and where something is null."""
    rows = [("a", 5, 0, 17), ("a%s", 12345, 1234567, 999999), (None, 128, -5, 1000000), ("b", None, None, 3)]
    df = spark.createDataFrame(rows, "c string, s int, x long, y long")
    got = df.select(names.tile_id_at(F.col("c"), F.col("s"), F.col("x"), F.col("y")).alias("a"), F.format_string("%s_s%04d_x%06d_y%06d", "c", "s", "x", "y").alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert tile_grid(spark.createDataFrame([("c", 70, 70)], "cut_name string, width long, height long"), [64], 0.0).select(names.tile_id_at(F.col("cut_name"), F.lit(64), F.col("x0"), F.col("y0"))).collect()[-1][0] == "c_s0064_x000064_y000064"
