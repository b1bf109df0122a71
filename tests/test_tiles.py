"""Literal cases of the tile operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import labels, names, rings
from tessella.operators import grid, metrics, polygon_area, quality, review, sampling, spatial, splits

R = f"array<{rings.POINT}>"


def square(x, y, n):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


def pts(*ps):
    return [{"x": float(x), "y": float(y)} for x, y in ps]


def test_grid_padding(spark):
    cuts = spark.createDataFrame([("a", 300, 300), ("b", 100, 100), ("none", 0, 50)], "cut_name string, width long, height long")
    rows = grid.tile_grid(cuts, [256]).collect()
    a = [r for r in rows if r.cut_name == "a"]
    assert len(a) == 4 and {r.pad_right for r in a if r.col == 1} == {161} and {r.pad_bottom for r in a if r.row == 1} == {161}
    (b,) = [r for r in rows if r.cut_name == "b"]
    assert (b.pad_right, b.pad_bottom) == (156, 156)
    assert [grid.stride_of(s, 0.2) for s in (128, 256, 512, 1024)] == [102, 205, 410, 819]


@pytest.mark.parametrize(
    "shapes, box, area",
    [
        ([square(0, 0, 2000)], (0, 0, 512, 512), 512.0**2),
        ([square(0, 0, 50)], (0, 0, 100, 100), 2500.0),
        ([square(0, 0, 50), square(0, 0, 50)], (0, 0, 100, 100), 2500.0),
        ([square(0, 0, 20), square(60, 60, 20)], (0, 0, 100, 100), 800.0),
        ([[(0, 0), (10, 10), (10, 0), (0, 10)]], (0, 0, 10, 10), 50.0),
        ([[(0, 0), (10, 0), (0, 10)]], (0, 0, 10, 10), 50.0),
        ([[(0, 0), (1, 1)]], (0, 0, 10, 10), 0.0),
        ([], (0, 0, 10, 10), 0.0),
    ],
)
def test_union_area(shapes, box, area):
    assert polygon_area.union_area([np.array(s, dtype=float).reshape(-1, 2) for s in shapes], *box) == pytest.approx(area, abs=1e-9)


def test_union_area_against_sampling():
    rng = np.random.default_rng(0)
    for _ in range(10):
        shapes = [rng.uniform(-2, 12, (int(rng.integers(3, 8)), 2)) for _ in range(3)]
        p = rng.uniform(0, 10, (40_000, 2))
        inside = np.zeros(len(p), dtype=bool)
        for s in shapes:
            a, b = s, np.roll(s, -1, axis=0)
            crosses = (a[:, 1] > p[:, 1, None]) != (b[:, 1] > p[:, 1, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (p[:, 1, None] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
            inside |= ((crosses & (p[:, 0, None] < x)).sum(axis=1) % 2).astype(bool)
        assert polygon_area.union_area(shapes, 0, 0, 10, 10) == pytest.approx(100 * inside.mean(), abs=1.5)


def test_coverage_and_labels(spark):
    cuts = spark.createDataFrame([("a", 6000, 6000)], "cut_name string, width long, height long")
    outlines = spark.createDataFrame([("a", pts(*square(0, 0, 2000)))], f"cut_name string, ring {R}")
    t = spatial.tile_coverage(grid.tile_grid(cuts, [512]), outlines, cuts, [512]).withColumns({"l5": labels.label_of(F.col("area_fraction"), 0.05), "l1": labels.label_of(F.col("area_fraction"), 0.01)})
    by = {(r.row, r.col): r for r in t.collect()}
    assert by[0, 0].area_fraction == 1.0 and by[12, 12].area_fraction == 0.0 and by[12, 12].l5 == "negative"
    edge = by[0, 4]  # starts at 1640
    assert edge.area_fraction == pytest.approx(360 / 512) and edge.l5 == "positive"


def test_points_on_borders(spark):
    cuts = spark.createDataFrame([("a", 300, 300)], "cut_name string, width long, height long")
    points = spark.createDataFrame([("a", 256.0, 256.0, 1), ("a", 300.0, 300.0, 2), ("b", 1.0, 1.0, 3)], "cut_name string, cx double, cy double, stage int")
    t = spatial.tiles_with_points(grid.tile_grid(cuts, [256]), points, cuts, [256])
    assert {(r.row, r.col): r.n_points for r in t.collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_assignment(spark):
    cuts = spark.createDataFrame([("s", 0, "c0", 0, 0, 100, 100), ("s", 1, "c1", 90, 0, 200, 100)], "stem string, cut_index int, cut_name string, x0 long, y0 long, x1 long, y1 long")
    rows = [("s", "in0", pts(*square(10, 10, 10))), ("s", "both", pts(*square(85, 10, 20))), ("s", "vertex", pts((50, 90), (50, 300), (60, 300))), ("s", "none", pts(*square(500, 500, 5))), ("x", "no cut", pts((1, 1)))]
    got = {r.id: (r.cut_index, r.method) for r in spatial.assign_to_cuts(spark.createDataFrame(rows, f"stem string, id string, ring {R}"), cuts).collect()}
    assert got == {"in0": (0, "centroid_in_bbox"), "both": (0, "largest_overlap"), "vertex": (0, "vertex_in_bbox"), "none": (None, "unassigned"), "no cut": (None, "unassigned")}


def test_ring_functions(spark):
    df = spark.createDataFrame([(pts(*square(0, 0, 10)),)], f"ring {R}")
    r = df.select(rings.area(F.col("ring")).alias("a"), rings.perimeter(F.col("ring")).alias("p"), rings.vertex_centroid(F.col("ring")).alias("c"), rings.area_centroid(F.col("ring")).alias("ac"), rings.box_metrics(F.col("ring")).alias("m"), rings.translate(F.col("ring"), F.lit(4200), F.lit(1800))[0].alias("t")).first()
    assert (r.a, r.p, r.c.x, r.c.y, r.ac.x, r.m.coverage, r.m.aspect, r.t.x) == (100.0, 40.0, 5.0, 5.0, 5.0, 1.0, 1.0, -4200.0)
    kinds = spark.createDataFrame([("LineString", "[[0,0,7],[10,0],[10,10]]"), ("Polygon", "[[[0,0],[1,0],[1,1]]]"), ("MultiPolygon", "[[[[0,0],[1,0],[1,1]]],[[[0,0],[5,0],[5,5]]]]")], "k string, c string")
    assert [len(x.r) for x in kinds.select(rings.outer_ring(F.col("k"), F.col("c")).alias("r")).collect()] == [3, 3, 3]
    line = df.select(rings.detection_line(F.lit(2), rings.bounds(F.col("ring")), F.lit(100), F.lit(100)).alias("d"), rings.segmentation_line(F.lit(1), F.col("ring"), F.lit(10), F.lit(10)).alias("s")).first()
    assert line.d == "2 0.050000 0.050000 0.100000 0.100000" and line.s.startswith("1 0.000000 0.000000 1.000000")


def test_names(spark):
    df = spark.createDataFrame([("CHN_SP_5_22-24",), ("nounderscore",), (None,)], "s string")
    got = df.select(names.specimen_of(F.col("s")), names.cut_count(F.col("s")), names.stem_parts(F.col("s"))["location"]).collect()
    assert [tuple(r) for r in got] == [("CHN_SP_5", 3, "CHN"), ("nounderscore", None, None), (None, None, None)]
    t = spark.createDataFrame([(None, "Stage 3 x", "stage 1"), ("STAGE2", None, None), ("none", None, None)], "a string, b string, c string")
    assert [r[0] for r in t.select(names.stage_number(F.col("a"), F.col("b"), F.col("c"))).collect()] == [3, 2, None]
    assert df.select(names.stem_of_cut(F.lit("A_B_cut_cut003"))).first()[0] == "A_B_cut"


def test_outcomes(spark):
    rows = [("positive", 0.9, 0.5), ("positive", 0.1, 0.5), ("negative", 0.9, 0.5), ("negative", 0.1, 0.5), ("ambiguous", 0.9, 0.5), ("positive", None, 0.5), ("positive", 0.5, None), ("positive", float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "l string, p double, t double")
    assert [r[0] for r in df.select(labels.outcome(F.col("l"), F.col("p"), F.col("t"))).collect()] == ["TP", "FN", "FP", "TN", "not scored", "no prediction", "no prediction", "no prediction"]
    with pytest.raises(ValueError):
        labels.label_of(F.lit(0.1), 1.5)


def test_metrics(spark):
    p = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, prob double")
    s = metrics.ranking_scores(p, []).first()
    assert (s.average_precision, s.roc_auc) == (1.0, 1.0)
    flat = spark.createDataFrame([(int(i < 2), 0.0) for i in range(20)], "y int, prob double")
    m = metrics.point_scores(metrics.confusion(flat, [], F.lit(0.5))).first()
    assert (m.accuracy, m.balanced_accuracy, m.mcc, m.f1) == (0.9, 0.5, 0.0, 0.0)
    one = spark.createDataFrame([(0, 0.3)], "y int, prob double")
    assert metrics.best_threshold(one, []).first().source == "fallback_single_class"
    assert metrics.ranking_scores(one, []).first().roc_auc is None
    v = spark.createDataFrame([(1, 0.30 + i / 100) for i in range(5)] + [(0, 0.02 + i / 100) for i in range(18)], "y int, prob double")
    assert 0.19 < metrics.best_threshold(v, []).first().threshold <= 0.30
    two = spark.createDataFrame([("a", int(i > 4), i / 10) for i in range(10)] + [("b", int(i < 5), i / 10) for i in range(10)], "specimen string, y int, prob double")
    ci = {r.metric: r for r in metrics.bootstrap_interval(two, "specimen", 0.5, 40, 1).collect()}
    assert ci["average_precision"].high - ci["average_precision"].low > 0.3


def test_quality_flags(spark):
    rows = [("a", 100.0, 20), ("b", 110.0, 20), ("c", 90.0, 20), ("d", 20.0, 20), ("e", None, 20), ("f", 500.0, 2)]
    df = spark.createDataFrame(rows, "cut string, v double, n int")
    got = [(r.cut, r.flag) for r in quality.flag_groups(df, "cut", "v", "n", 0.5, 10).collect()]
    assert got[0] == ("e", "too few tiles") and got[1] == ("d", "blurred") and ("f", "too few tiles") in got and ("a", "") in got
    p = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    assert sorted((r.v or 0, round(r.percentile or 0, 3)) for r in quality.percentile_rank(p, "v").collect()) == [(0, 0), (1.0, 33.333), (2.0, 83.333), (2.0, 83.333)]


def test_splits(spark):
    s = spark.createDataFrame([(f"s{i}", "A" if i < 8 else "B") for i in range(14)], "stem string, stratum string")
    got = splits.quota_split(s, {"A": (2, 1), "B": (1, 1)}, 42)
    assert {(r.stratum, r.split): r["count"] for r in got.groupBy("stratum", "split").count().collect()} == {("A", "val"): 2, ("A", "test"): 1, ("A", "train"): 5, ("B", "val"): 1, ("B", "test"): 1, ("B", "train"): 4}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, splits.quota_split(s.orderBy(F.desc("stem")), {"A": (2, 1), "B": (1, 1)}, 42).collect()))
    with pytest.raises(ValueError):
        splits.quota_split(s, {"A": (2, 1)}, 42)
    f = spark.createDataFrame([("A_X_1", "train"), ("A_X_1", "test"), ("B", "val")], "specimen string, split string")
    assert [tuple(r) for r in splits.straddling(f).collect()] == [("A_X_1", ["test", "train"])]
    c = spark.createDataFrame([("A", 10, 5), ("B", 10, 5), ("C", 10, 1), ("D", 10, 1)], "specimen string, tiles_512 long, positives_512 long")
    best = {r.specimen: r.fold for r in splits.fold_search(c, 2, 2, 2.0, [512]).collect()}
    assert best["A"] != best["B"] and best["C"] != best["D"]
    assert splits.fold_search(c, 2, 30, 2.0, [512]).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(i, int(i < 7)) for i in range(50)], "id long, y int")
    b = sampling.ratio_batches(df, 8, 0.5, 12, 3, "id").collect()
    per = {}
    for r in b:
        per.setdefault(r.batch, []).append((r.id, r.y))
    assert sorted(per) == list(range(12)) and all(len(x) == 8 == len(set(x)) and sum(y for _, y in x) == 4 for x in per.values())
    hard = sampling.hard_pool(spark.createDataFrame([(i, 1.0 if i < 5 else 0.5) for i in range(10)], "id long, s double"), "s", "id", 0.3)
    assert sorted(r.id for r in hard.collect()) == [0, 1, 2]


def test_strict_review_join(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "tile_id string, display_index int")
    ok = spark.createDataFrame([("a", 1, True), ("b", 2, None)], "tile_id string, display_index int, collaborator_label boolean")
    assert review.strict_join(t, ok).count() == 2
    bad = spark.createDataFrame([("a", 3, True)], "tile_id string, display_index int, collaborator_label boolean")
    with pytest.raises(Exception, match="don't match"):
        review.strict_join(t, bad).collect()
    assert {(r.tile_id, r.reason) for r in review.join_breaks(t, bad).collect()} == {("a", "other display index"), ("b", "tile without label")}
