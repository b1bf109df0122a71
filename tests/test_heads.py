"""The row bootstrap against draws that are expanded row by row, and a head against plain steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import geometry, heads, ranking, row_bootstrap, sampling


def average_precision(rows):
    """Ties taken together."""
    p = sum(n for _, y, n in rows if y)
    tp = seen = total = 0
    for prob in sorted({r[0] for r in rows}, reverse=True):
        pos = sum(n for q, y, n in rows if q == prob and y)
        tp, seen = tp + pos, seen + sum(n for q, _, n in rows if q == prob)
        total += pos * tp / seen if seen else 0
    return total / p


@pytest.mark.parametrize("sample", [8192, 50])
def test_row_bootstrap(spark, monkeypatch, sample):
    """With many bands, too: each replicate's scores are those of its own draws."""
    monkeypatch.setattr(ranking, "SAMPLE", sample)
    rng = np.random.default_rng(2)
    rows = [(int(y), round(float(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)), 2)) for y in rng.integers(0, 2, 400)]
    df = spark.createDataFrame([*rows, (1, None), (0, float("nan"))], "y int, prob double")
    got = {r.metric: r for r in row_bootstrap.row_interval(df, 0.5, 60, 3).collect()}
    ties = df.filter("prob IS NOT NULL AND NOT isnan(prob)").groupBy("prob").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    frame = ranking.with_band(ties, [-F.col("prob")]).toPandas()
    bands = sorted(frame["__band"].unique())
    assert (len(bands) > 20) == (sample == 50)
    totals = row_bootstrap.band_totals(np.array([frame.loc[frame["__band"] == b, ["pos", "neg"]].to_numpy().sum() for b in bands]), 60, 3)
    drawn = [[] for _ in range(60)]
    for k, b in enumerate(bands):
        pdf = frame[frame["__band"] == b].sort_values("prob", ascending=False)
        for reps, pos, neg in row_bootstrap.band_draws(pdf, 3, int(b), totals[:, k]):
            for r, p, n in zip(reps, pos, neg):
                drawn[r] += [(q, 1, c) for q, c in zip(pdf["prob"], p)] + [(q, 0, c) for q, c in zip(pdf["prob"], n)]
    assert {sum(n for *_, n in d) for d in drawn} == {400}
    scores = pd.DataFrame([(average_precision(d), *(lambda tp, fp, p: (2 * tp / (tp + fp + p), tp / p))(*(sum(n for q, y, n in d if ok(q, y)) for ok in (lambda q, y: y and q >= 0.5, lambda q, y: not y and q >= 0.5, lambda q, y: y)))) for d in drawn], columns=["average_precision", "f1", "recall"])
    for m in scores:
        assert got[m].n_usable == 60 and (got[m].low, got[m].high) == pytest.approx(tuple(np.percentile(scores[m], [2.5, 97.5])))
    widths = row_bootstrap.interval_widths(row_bootstrap.row_interval(df, 0.5, 60, 3), row_bootstrap.row_interval(df, 0.5, 60, 3))
    assert {r.ratio for r in widths.collect()} == {1.0}
    assert row_bootstrap.mean_widths(widths.withColumn("run", F.lit(1)), ["run"]).first().n_undefined == 0


def test_row_bootstrap_of_one_class(spark):
    for rows in ([], [(1, 0.5)] * 3):
        got = row_bootstrap.row_interval(spark.createDataFrame(rows, "y int, prob double"), 0.5, 5).collect()
        assert [(r.n_usable, r.low, r.high) for r in got] == [(0, None, None)] * 3


def embedded(spark, seed=1, n=300):
    rng = np.random.default_rng(seed)
    y = (rng.uniform(size=n) < 0.3).astype(int)
    x = rng.normal(size=(n, 3)) + y[:, None] * np.array([1.5, 0.0, -1.0])
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "tile_id long, pooled array<double>, y int"), x, y


def test_head_equals_plain_steps(spark):
    """One shard: the same batches in the same order, one after the other."""
    df, x, y = embedded(spark)
    head, log = heads.train_head(df, df, epochs=2, batches=5, batch_size=16, shards=1, seed=9)
    state = {"w": np.zeros(4), "m": np.zeros(4), "v": np.zeros(4), "t": np.zeros(1)}
    for epoch in (1, 2):
        dealt: dict = {}
        for r in sampling.ratio_batches(df, 16, 0.25, 5, 9 + 1000 * epoch, "tile_id").collect():
            dealt.setdefault(r.batch, []).append(r.tile_id)
        batches = [(np.column_stack((x[sorted(dealt[b])], np.ones(16))), y[sorted(dealt[b])].astype(float)) for b in sorted(dealt)]
        state, n, loss = heads.adam_steps(state, batches, 1e-3, 0.01)
        assert n == 5 and head.epochs[epoch - 1]["train_loss"] == pytest.approx(loss / 5)
    assert head.best_epoch in (1, 2)
    if head.best_epoch == 2:
        assert [*head.weights, head.bias] == pytest.approx(state["w"].tolist())
    assert {tuple(r)[1:] for r in log.select("epoch", "batch_size", "n_positive", "n_negative", "n_hard_negative").collect()} == {(16, 4, 12, 0)}


def test_head_learns_and_stops(spark):
    df, x, y = embedded(spark, 2, 600)
    head, log = heads.train_head(df.filter("tile_id % 3 > 0"), df.filter("tile_id % 3 = 0"), epochs=6, patience=2, batch_size=32, rate=0.05, mining=(1, 0.2, 0.5))
    assert head.best_average_precision > 0.7 and max(e["val_average_precision"] for e in head.epochs) == head.best_average_precision
    assert [e["mining_active"] for e in head.epochs] == [k > 0 for k in range(len(head.epochs))]
    assert head.early_stopped == (len(head.epochs) - head.best_epoch >= 2)
    assert {(r.epoch > 1, r.n_hard_negative) for r in log.collect()} == {(False, 0), (True, 12)}
    prob = np.array([r.p for r in df.orderBy("tile_id").select(head.probability("pooled").alias("p")).collect()])
    assert prob == pytest.approx(1 / (1 + np.exp(-(x @ np.array(head.weights) + head.bias))))
    with pytest.raises(ValueError, match="both classes"):
        heads.train_head(df, df.filter("y = 0"), epochs=2, batches=2, patience=1)
    with pytest.raises(ValueError):
        heads.train_head(df.limit(0), df)


def test_geometry_roles(spark):
    kinds = [("LineString", "[[0,0],[4,0],[4,4]]"), ("Polygon", "[[[0,0],[4,0],[4,4]],[[1,1],[2,1],[2,2]]]"), ("MultiPolygon", "[[[[0,0],[4,0],[4,4]]]]"), ("Point", "[1,2]"), ("LineString", "[[0,null],[1,1]]"), ("Polygon", "[]"), (None, None)]
    rows = spark.createDataFrame([("C_cut000_annotations", i, f"a{i}", k, c) for i, (k, c) in enumerate(kinds)], "stem string, feature_pos int, id string, geom_type string, coordinates string")
    f = geometry.features(rows)
    assert {r.feature_pos: r.reason for r in geometry.lossy(f).collect()} == {1: "1 holes", 2: "several parts"}
    assert {r.feature_pos: r.reason for r in geometry.unusable(f).collect()} == {3: "not a ring", 4: "not a ring", 5: "not a ring", 6: "not a ring"}
    with pytest.raises(ValueError, match="single ring"):
        geometry.measurable(f)
    good = f.filter("feature_pos NOT IN (1, 2)")
    assert [(r.cut_name, r.id, len(r.ring)) for r in geometry.measurable(good).collect()] == [("C_cut000", "a0", 3)]
    with pytest.raises(ValueError, match="without a usable"):
        geometry.measurable(good.filter("feature_pos > 2"))
    empty = spark.createDataFrame([("C_cut001_annotations", None, None, None, None)], rows.schema)  # a file without features
    assert geometry.measurable(geometry.features(empty)).count() == 0
    tiles = spark.createDataFrame([("D_cut000", "C_cut000_annotations")], "cut_name string, annotations_stem string")
    with pytest.raises(ValueError, match="another cut"):
        geometry.measurable(good, tiles)


def test_label_lines(spark):
    ring = "array<struct<x: double, y: double>>"
    rows = [("c", 100, 0, 0, 100, 0, 200, 100, 1, [(110.0, 10.0), (150.0, 10.0), (150.0, 60.0), (110.0, 60.0)], 0.5), ("c", 100, 0, 0, 100, 0, 200, 100, 9, [(110.0, 10.0), (150.0, 10.0), (150.0, 60.0)], 0.5)]
    clips = spark.createDataFrame(rows, f"cut_name string, tile_size int, row int, col int, x0 long, y0 long, x1 long, y1 long, stage int, ring {ring}, visible double")
    assert [r.line for r in geometry.instance_lines(clips, {1: 3}).collect()] == ["3 0.100000 0.100000 0.500000 0.100000 0.500000 0.600000 0.100000 0.600000"]
    assert [r.line for r in geometry.instance_lines(clips, {1: 3}, boxes=True).collect()] == ["3 0.300000 0.350000 0.400000 0.500000"]
