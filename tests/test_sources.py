"""Readers, writers, images and streams on small files."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import images
from tessella.sources import readers, schemas, writers
from tessella.streaming import streams


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + rgb[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_annotations(spark, tmp_path):
    feature = {"type": "Feature", "id": None, "geometry": {"type": "LineString", "coordinates": [[0, 0], [10, 0], [10, 10]]}, "properties": {"name": "x", "metadata": {"ANNOTATION_DESCRIPTION": "stage 2"}, "classification": {"name": "Stage 4"}}}
    (tmp_path / "S_1.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    (tmp_path / "S_2.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    rows = {r.stem: r for r in readers.annotations(spark, str(tmp_path / "*.geojson")).collect()}
    assert rows["S_1"].id == "S_1:0" and rows["S_1"].stage == 2 and rows["S_1"].stage_name == "Stage 4" and len(rows["S_1"].ring) == 3
    assert rows["S_2"].feature_pos is None
    (tmp_path / "bad.geojson").write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.annotations(spark, str(tmp_path / "bad.geojson")).collect()


def test_manifests(spark, tmp_path):
    cut = {"index": 0, "name": "S_cut000", "level0_bbox": {"x0": 1, "y0": 2, "x1": 11, "y1": 22}, "level0_size": [10, 20]}
    (tmp_path / "m.json").write_text(json.dumps({"source_ndpi": "/a/S.ndpi", "cuts": [cut]}))
    r = readers.cut_manifests(spark, str(tmp_path / "m.json")).first()
    assert (r.stem, r.cut_name, r.width, r.height) == ("S", "S_cut000", 10, 20)
    (tmp_path / "s.json").write_text(json.dumps({"manifest_version": "1", "slides": {"A_1": {"split": "val", "location": "A", "stage_counts": {"2": 3}}}}))
    r = readers.split_manifest(spark, str(tmp_path / "s.json")).first()
    assert (r.stem, r.split, r.stage_counts) == ("A_1", "val", {2: 3})


def test_exclusions(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("﻿cut_name,status,reason\nA_cut001,excluded,torn\n\nB_cut002,known_empty,\n")
    got = readers.exclusions(spark, str(f))
    assert [(r.line, r.cut_name, r.status, r.reason) for r in got.collect()] == [(2, "A_cut001", "excluded", "torn"), (4, "B_cut002", "known_empty", None)]
    assert readers.exclusion_record(got).first().excluded == ["A_cut001"]
    f.write_text('reason,status,cut_name\n"torn, ""blurred""",excluded,A_cut001\n , ,\n')
    assert [(r.line, r.cut_name, r.status, r.reason) for r in readers.exclusions(spark, str(f)).collect()] == [(2, "A_cut001", "excluded", 'torn, "blurred"')]
    for text, why in (('cut_name,status,reason\nA_cut001,excluded,"torn\nB_cut002,excluded,\n', "line 3"), ("cut_name,status,reason\nA_cut001,excluded,torn, blurred\n", "line 2: more fields")):
        f.write_text(text)
        with pytest.raises(ValueError, match=why):
            readers.exclusions(spark, str(f))
    for text, why in (("cut_name,status\nA_cut001,odd\n", "line 2: unknown"), ("cut_name,status\nA_cut001,excluded\nA_cut001,excluded\n", "line 3: .* twice"), ("cut,status\n", "line 1"), ("cut_name,status\nA,excluded\n", "no cut")):
        f.write_text(text)
        with pytest.raises(ValueError, match=why):
            readers.exclusions(spark, str(f))


def test_images(spark, tmp_path):
    rgb = np.full((64, 64, 3), (250, 250, 250), dtype=np.uint8)
    rgb[:, :32] = (200, 100, 50)
    (tmp_path / "a.png").write_bytes(png(rgb))
    (tmp_path / "b.png").write_bytes(png(np.full((32, 32, 3), 255, dtype=np.uint8)))
    got = {r.path[-5:]: r for r in images.image_stats(readers.images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.png"} and got["b.png"].brightness is None and got["b.png"].tissue_fraction == 0
    assert got["a.png"].red == pytest.approx(200 / 255, abs=0.02) and got["a.png"].blue == pytest.approx(50 / 255, abs=0.06)
    tiles = readers.images(spark, str(tmp_path)).select(F.col("image.origin").alias("path")).filter("path LIKE '%a.png'").withColumns({"tile_id": F.lit("t"), "x0": F.lit(40), "y0": F.lit(40), "tile_size": F.lit(32)})
    px = np.frombuffer(images.crop_tiles(readers.images(spark, str(tmp_path)), tiles).first().pixels, dtype=np.uint8).reshape(32, 32, 3)
    assert px[0, 0].tolist() == [250, 250, 250] and px[30, 30].tolist() == [0, 0, 0]
    (tmp_path / "c.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="not an image: .*c.png"):
        readers.images(spark, str(tmp_path)).collect()


def test_tissue():
    grey, pink, pale = ([230, 230, 230], [200, 120, 150], [228, 219, 228])
    flat = lambda c: np.full((32, 32, 3), c, dtype=np.uint8)
    assert not images.tissue_mask(flat(grey)).any() and images.tissue_mask(flat(pink)).all()
    assert not images.tissue_mask(flat(grey), "brightness").any() and images.tissue_mask(flat(pale), "brightness").all()  # bright, but not pale enough
    assert images.tissue_mask(flat([90, 90, 90]), "brightness").all() and not images.tissue_mask(flat([90, 90, 90])).any()
    assert images.tile_stats(flat([255, 215, 255])) == (0.0, *[None] * 5)  # stained, but as bright as glass
    dots = flat(pink)
    dots[16, 16] = [100, 60, 75]
    share, brightness, *_, sharpness = images.tile_stats(dots)
    assert share == 1 and 0 < sharpness < 1 and brightness == pytest.approx(np.mean(dots @ [0.299, 0.587, 0.114]) / 255)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan"), 1), ("b", 0.5, 2)], "k string, v double, n int")
    writers.one_document(df, str(tmp_path / "one"))
    assert sorted(r.v or 0 for r in spark.read.json(str(tmp_path / "one")).collect()) == [0, 0.5]
    assert sorted(r.line for r in writers.markdown(df, ["k", "v", "n"]).collect()) == ["| a | - | 1 |", "| b | 0.500 | 2 |"]
    with pytest.raises(ValueError, match="missing"):
        writers.fixed_columns(df, ["k", "x"], str(tmp_path / "no"))
    s = spark.createDataFrame([(0, "s1", "test"), (0, "s2", "train"), (1, "s1", "val")], "held_out int, stem string, split string")
    sums = writers.hashed_folds(s, str(tmp_path / "folds")).collect()
    assert sorted(r.fold for r in sums) == [0, 1] and all(len(r.sha256) == 64 for r in sums)
    assert writers.not_yet_written(df, df.filter("k = 'a'"), "k").count() == 1


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(0, 0, 16, 4, 12, 0, 0.25), (0, 1, 16, 4, 12, 0, 0.25), (1, 0, 16, 8, 8, 0, 0.25)], schemas.COMPOSITION)
    writers.append_log(log, str(tmp_path / "log"))
    q = streams.running_fraction(spark.readStream.schema(schemas.COMPOSITION).json(str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("fraction").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.epoch: r.positive_fraction for r in streams.running_fraction(readers.composition_log(spark, str(tmp_path / "log"))).collect()}
    assert {r.epoch: r.positive_fraction for r in spark.table("fraction").collect()} == want == {0: 0.25, 1: 0.5}
    events = spark.sql("SELECT * FROM VALUES ('t', TIMESTAMP '2024-01-01 10:00:00', 'a'), ('t', TIMESTAMP '2024-01-01 10:05:00', 'b'), ('u', TIMESTAMP '2024-01-01 10:01:00', 'c') AS v(tile_id, labelled_at, label)")
    events.write.parquet(str(tmp_path / "events"))
    q = streams.latest_label_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.tile_id: r.label for r in spark.table("latest").collect()} == {"t": "b", "u": "c"}


def test_fingerprint(spark):
    maps = [{"b": "2", "a": "1", "c": None}, {"a": '1","b":"2'}, {"b": "2", "a": "1"}]
    got = [r[0] for r in spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "i int, m map<string,string>").orderBy("i").select(names.fingerprint(F.col("m"))).collect()]
    assert got[0] == got[2] == hashlib.sha256(b'{"a":"1","b":"2"}').hexdigest() and got[1] != got[0]
