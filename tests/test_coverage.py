"""Coverage by strips and by vectors of boxes against the plain area of a union."""

from __future__ import annotations

import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import grid, polygon_area, spatial

RING = "array<struct<x: double, y: double>>"


def star(rng, cx, cy, r, n):
    angles = sorted(rng.uniform(0, 2 * np.pi) for _ in range(n))
    return [(cx + rng.uniform(0.2, 1) * r * np.cos(a), cy + rng.uniform(0.2, 1) * r * np.sin(a)) for a in angles]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_boxes_of_many_tiles(k):
    rng = np.random.default_rng(k)
    low = rng.integers(-5, 20, (30, k, 2)).astype(float)
    boxes = np.concatenate((low, low + rng.integers(-1, 12, (30, k, 2))), axis=2)
    within = np.tile([0.0, 0.0, 16.0, 13.0], (30, 1))
    plain = [polygon_area.union_area([np.array(box(*b)) for b in t if b[2] > b[0] and b[3] > b[1]], 0, 0, 16, 13) for t in boxes]
    assert polygon_area.boxes_area(boxes, within) == pytest.approx(plain, abs=1e-9)


@pytest.mark.parametrize("edges", [10, 2000])
def test_tiles_of_all_kinds(spark, monkeypatch, edges):
    """Boxes, stars, crossing rings, unusable ones; crowded tiles are cut into strips."""
    monkeypatch.setattr(spatial, "STRIP_EDGES", edges)
    monkeypatch.setattr(spatial, "LONG_RING", 20)
    rng = random.Random(edges)
    shapes = {"a": [], "b": [], "c": []}
    for _ in range(25):
        x, y = rng.uniform(-20, 300), rng.uniform(-20, 200)
        shapes["a"].append(box(x, y, x + rng.uniform(1, 90), y + rng.uniform(1, 90)))
        shapes["b"].append(star(rng, x, y, rng.uniform(5, 80), rng.choice([3, 4, 5, 30, 60])))
    shapes["b"] += [*shapes["a"][:6], [(10, 10), (60, 60), (60, 10), (10, 60)], [(0, 0), (1, 1)], [], box(5, 5, 50, 40)[::-1], [*box(20, 20, 90, 60), (20, 20)]]
    cuts = spark.createDataFrame([(c, 300, 200) for c in shapes], "cut_name string, width long, height long")
    rows = [(c, [tuple(map(float, p)) for p in r]) for c, found in shapes.items() for r in found]
    outlines = spark.createDataFrame(rows, f"cut_name string, ring {RING}")
    tiles = grid.tile_grid(cuts, [128])
    got = spatial.tile_coverage(tiles, outlines, cuts, [128]).collect()
    assert len(got) == tiles.count()
    for r in got:
        want = polygon_area.union_area([np.array(s, dtype=float) for s in shapes[r.cut_name] if len(s) > 2], r.x0, r.y0, r.x1, r.y1) / ((r.x1 - r.x0) * (r.y1 - r.y0))
        assert r.area_fraction == pytest.approx(want, abs=1e-9)
    whole = {r.cut_name: r.covered_share for r in spatial.covered_share(outlines, cuts).collect()}
    assert whole == {c: pytest.approx(polygon_area.union_area([np.array(s, dtype=float) for s in found if len(s) > 2], 0, 0, 300, 200) / 60_000, abs=1e-9) for c, found in shapes.items()}


def test_many_edges_in_bounded_memory():
    """20,000 edges in one tile, all of them across the same heights."""
    rng = np.random.default_rng(3)
    x = np.sort(rng.uniform(0, 1000, 5000))
    rings = [np.array([(a, 0.0), (a + 0.01, 0.0), (a + 0.06, 900.0), (a + 0.05, 900.0)]) for a in x]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = polygon_area.union_area(rings, 0, 0, 1000, 1000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000
    assert 0.9 * 5000 * 0.01 * 900 < got <= 5000 * 0.01 * 900 + 1e-6


def test_a_tile_without_area_is_an_error(spark):
    cuts = spark.createDataFrame([("a", 10, 10)], "cut_name string, width long, height long")
    flat = grid.tile_grid(cuts, [128]).withColumn("x1", F.col("x0"))
    none = spark.createDataFrame([], f"cut_name string, ring {RING}")
    with pytest.raises(Exception, match="a tile without area"):
        spatial.tile_coverage(flat, none, cuts, [128]).collect()
