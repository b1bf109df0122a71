"""Review sessions and embedding tables: what is sampled, what is refused, and what a reviewer sees."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import review_sampling as R
from tessella.sources import embedding_table as E

POINTS = "cut_name string, id string, cx double, cy double"


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(3)
    cuts = [("a", 900, 700), ("b", 300, 1200), ("small", 90, 80), ("empty", 500, 500)]
    points = [(c, f"{c}{i}", rng.uniform(0, w / (3 if c != "small" else 1)), rng.uniform(0, h)) for c, w, h in cuts[:3] for i in range(12)]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(cuts, "cut_name string, width long, height long"), points, cuts


def test_boxes_and_their_points(places):
    points, cuts, rows, sizes = places
    extent = {c: (w, h) for c, w, h in sizes}
    got = R.points_in_boxes(R.centred(points, cuts, 128), points, 128).collect()
    assert len(got) == len(rows)
    for r in got:
        w, h = extent[r.cut_name]
        assert 0 <= r.x0 and r.x1 <= w and r.x1 - r.x0 == min(128, w) and r.y1 - r.y0 == min(128, h)
        assert r.annotation_ids == sorted(i for c, i, x, y in rows if c == r.cut_name and r.x0 <= x <= r.x1 and r.y0 <= y <= r.y1) and r.id in r.annotation_ids and r.n_points == len(r.annotation_ids)


def test_only_as_much_is_measured_as_is_needed(spark):
    seen = []

    def measure(df):
        seen.append(df.count())
        return df.withColumn("tissue_fraction", (F.col("id").cast("long") % 4 == 0).cast("double"))

    some = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    got = R.passing(some, "id", 10, 5, measure, 0.5).collect()
    assert len(got) == 10 and all(int(r.id) % 4 == 0 for r in got) and sum(seen) < 200
    first = {r.id for r in R.passing(some, "id", 10, 5, lambda d: d.withColumn("tissue_fraction", (F.col("id").cast("long") % 4 == 0).cast("double")), 0.5).collect()}
    assert {r.id for r in got} == first
    with pytest.raises(ValueError, match="only 250 tiles pass"):
        R.passing(some, "id", 251, 5, measure, 0.5)


def test_a_session(spark, places):
    points, cuts, rows, _ = places
    full = lambda df: df.withColumn("tissue_fraction", F.lit(0.9))
    tiles = R.session_tiles(points, cuts, [64, 128], 6, 5, full, seed=3)
    out = R.session(tiles, "s1", 8)
    got = out.collect()
    assert len(got) == 22 and sorted(r.display_index for r in got) == list(range(22))
    for r in got:
        inside = [i for c, i, x, y in rows if c == r.cut_name and r.x0 <= x <= r.x1 and r.y0 <= y <= r.y1]
        assert r.n_points == len(inside) and r.ground_truth == bool(inside) and r.cut_name != "empty"
        assert r.png_filename == f"tiles/tile_{r.display_index + 1:04d}.png"
        if not r.ground_truth:
            b = r.tile_size * 0.5
            assert not any(c == r.cut_name and r.x0 - b <= x <= r.x1 + b and r.y0 - b <= y <= r.y1 + b for c, _, x, y in rows)
    assert {(r.tile_size, r.ground_truth): 0 for r in got}.keys() == {(64, True), (64, False), (128, True), (128, False)}
    assert set(R.shared(out).columns) == {"session_id", "tile_id", "display_index", "png_filename", "tile_size", "collaborator_label", "labelled_at"}
    for bad in (dict(sizes=[]), dict(n_positive=0), dict(least=1.5), dict(buffer=-1.0), dict(n_positive=99)):
        given = dict(sizes=[64], n_positive=2, n_negative=2, least=0.2, buffer=0.5) | bad
        with pytest.raises(ValueError):
            R.session_tiles(points, cuts, given["sizes"], given["n_positive"], given["n_negative"], full, given["least"], given["buffer"])


TILES = "tile_id string, png_path string, tile_size int"


def test_embedding_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tiles = spark.createDataFrame([(f"t{i}", f"p{i}", 512 if i < 8 else 256) for i in range(10)], TILES)
    made = lambda n=10, dim=3, extra=0: spark.createDataFrame([(f"t{i}", [[float(i), 1.0, 2.0][:dim]] * 2) for i in [*range(n), *range(extra)]], "tile_id string, sub array<array<float>>")
    inputs = spark.createDataFrame([("p0", "x"), ("p1", "y")], "path string, sha256 string")
    with pytest.raises(ValueError, match="no whole table"):
        E.open_table(spark, path, "enc", 512, tiles)
    E.write_table(tiles, made(), path, "enc", 512, inputs)
    rows = E.open_table(spark, path, "enc", 512, tiles, inputs).orderBy("tile_id").collect()
    assert [(r.tile_id, r.sub) for r in rows] == [(f"t{i}", [[float(i), 1.0, 2.0]] * 2) for i in range(8)]
    for what, args in (("encoder", ("other", 512, tiles)), ("tile size", ("enc", 256, tiles)), ("other tiles", ("enc", 512, tiles.filter("tile_id <> 't3'"))), ("other tiles", ("enc", 512, tiles.withColumn("png_path", F.lit("q")))), ("other inputs", ("enc", 512, tiles, inputs.limit(1)))):
        with pytest.raises(ValueError, match=what):
            E.open_table(spark, path, *args)
    # what can't replace the table leaves it as it is
    for why, bad in (("no embedding", made(5)), ("have several", made(10, 3, 2)), ("one shape", made(10).unionByName(made(1, 2)).filter("tile_id <> 't0' OR size(sub[0]) = 2"))):
        with pytest.raises(ValueError, match=why):
            E.write_table(tiles, bad, path, "enc", 512, inputs)
    with pytest.raises(ValueError, match="changed while"):
        E.write_table(tiles, made(), path, "new", 512, inputs.withColumn("sha256", F.reflect(F.lit("java.util.UUID"), F.lit("randomUUID"))))
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and E.open_table(spark, path, "enc", 512, tiles).count() == 8
    changed = E.open_table(spark, path, "enc", 512, tiles).withColumn("sub", F.transform("sub", lambda v: F.transform(v, lambda x: x + 1))).collect()
    spark.createDataFrame(changed, "tile_id string, png_path string, sub array<array<double>>").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="other content"):
        E.open_table(spark, path, "enc", 512, tiles)
    spark.createDataFrame(changed[:5], "tile_id string, png_path string, sub array<array<double>>").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="shape or number"):
        E.open_table(spark, path, "enc", 512, tiles)
    E.write_table(tiles, made(), path, "enc", 512, inputs)  # in place of the broken one
    monkey = E.VERSION
    try:
        E.VERSION = 2
        with pytest.raises(ValueError, match="format"):
            E.open_table(spark, path, "enc", 512, tiles)
    finally:
        E.VERSION = monkey


def test_candidates_are_made_once(spark):
    """A ranking reads its rows several times, and on a join's plan that took the driver's memory."""
    from tessella.operators import review_sampling

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("CAST(id AS STRING) AS id").mapInArrow(counted, "id string")
    found = review_sampling.passing(rows, "id", 5, 1, lambda some: some.selectExpr("*", "1.0D AS tissue_fraction"), 0.2)
    assert found.count() == 5 and made.value == 50
