"""Fold assignment, manifests, tiling provenance, label lists and the quality report from pictures."""

from __future__ import annotations

import hashlib
import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import quality, reports, splits
from tessella.sources import readers, writers

COUNTS = "specimen string, site string, tiles_512 long, positives_512 long, tiles_1024 long, positives_1024 long"


def plain_folds(rows, site, n, floors, sizes, cap, ratio):
    anchors, others = ([r for r in sorted(rows) if (r[1] == site) == flag] for flag in (True, False))
    at = {512: (2, 3), 1024: (4, 5)}
    best = None
    for deal in itertools.product(range(n), repeat=len(others)):
        of = [[a] + [o for o, f in zip(others, deal) if f == k] for k, a in enumerate(anchors)]
        total = lambda s, i: [sum(r[at[s][i]] for r in fold) for fold in of]
        if any(p < floor for s, floor in floors.items() for p in total(s, 1)) or any(t == 0 for s in sizes for t in total(s, 0)):
            continue
        if cap and max(total(cap, 0)) > ratio * min(total(cap, 0)):
            continue
        spread = max([0.0] + [max(r) - min(r) for s in sizes for r in [[p / t for p, t in zip(total(s, 1), total(s, 0))]]])
        if best is None or spread < best[0]:
            best = (spread, deal)
    return {**{a[0]: k + 1 for k, a in enumerate(anchors)}, **{o[0]: f + 1 for o, f in zip(others, best[1])}}


def test_fold_assignment(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i}", "A" if i in (2, 5, 7) else "B", t, int(t * rng.uniform(0.05, 0.4)), t // 3, int(t // 3 * rng.uniform(0.1, 0.5))) for i, t in enumerate(rng.integers(30, 200, 9).tolist())]
    counts = spark.createDataFrame(rows, COUNTS)
    for floors, sizes, cap, ratio in (({512: 20, 1024: 5}, [512, 1024], 512, 1.6), ({}, [1024], None, 0), ({512: 30}, [], 1024, 2.0)):
        got = {r.specimen: r.fold for r in splits.assign_folds(counts, "A", 3, floors, sizes, cap, ratio).collect()}
        assert got == plain_folds(rows, "A", 3, floors, sizes, cap, ratio)
    for bad in (("B", 3, {}, [512], None, 0), ("A", 2, {}, [512], None, 0), ("A", 3, {512: 10**6}, [512], None, 0), ("A", 3, {}, [256], None, 0), ("A", 3, {}, [512], 512, 0.5)):
        with pytest.raises(ValueError):
            splits.assign_folds(counts, *bad)
    only = counts.filter("site = 'A'")
    assert {r.specimen: r.fold for r in splits.assign_folds(only, "A", 3, {}, [512], None, 0).collect()} == {"s2": 1, "s5": 2, "s7": 3}


def test_fold_manifest_carries_what_was_written(spark, tmp_path):
    folds = spark.createDataFrame([(1, ["A"], ["A_1"], "A", {"512": 5}), (2, ["B"], ["B_1"], "B", {"512": 6})], "fold int, specimens array<string>, slides array<string>, inner_val_specimen string, tiles map<string, long>")
    given = spark.createDataFrame([(h, s, "test" if s == t else "train") for h, t in ((1, "A_1"), (2, "B_1")) for s in ("A_1", "B_1")], "held_out int, stem string, split string")
    writers.fold_manifest(folds, given, str(tmp_path), "v1", "2024-01-01")
    (part,) = (tmp_path / "fold_manifest").glob("part-*")
    made = json.loads(part.read_text())
    assert (made["manifest_version"], made["n_folds"], [f["fold"] for f in made["folds"]]) == ("v1", 2, [1, 2])
    for f in made["folds"]:
        (file,) = (tmp_path / "splits" / f"held_out={f['fold']}").glob("part-*.txt")
        assert f["split_manifest_sha256"] == hashlib.sha256(file.read_bytes()).hexdigest() and f["split_manifest_path"].endswith(f"held_out={f['fold']}")
    read = readers.fold_manifest(spark, str(tmp_path / "fold_manifest")).collect()
    assert {r.fold: (r.specimens, r.tiles["512"]) for r in read} == {1: (["A"], 5), 2: (["B"], 6)}
    with pytest.raises(ValueError):
        writers.fold_manifest(folds, given.filter("held_out = 1"), str(tmp_path / "other"), "v1", "")


def test_label_lists(spark, tmp_path):
    stems = spark.createDataFrame([(f"s{i}",) for i in range(10)], "stem string")
    writers.detection_classes({0: "one", 2: "three"}, stems, str(tmp_path), {"val": 0.2, "test": 0.1})
    assert "".join(p.read_text() for p in (tmp_path / "classes").glob("part-*")) == "one\nclass_1\nthree\n"
    lists = {d.name: sorted(x for p in d.glob("part-*") for x in p.read_text().split()) for d in (tmp_path / "lists").glob("split=*")}
    assert {k: len(v) for k, v in lists.items()} == {"split=val": 2, "split=test": 1, "split=train": 7} and sorted(sum(lists.values(), [])) == sorted(f"s{i}.png" for i in range(10))


def test_tiling_provenance(spark, tmp_path):
    tile = {"tile_id": "t", "tile_size": 512, "row": 0, "col": 0, "cut_local_bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}}
    for name, share in (("b", 0.5), ("a", 0.25)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"cut_name": name, "stem": "s", "min_tissue_fraction": share, "overlap": 0.2, "tiles": [tile]}))
    tiles = readers.tile_manifests(spark, str(tmp_path))
    assert tiles.count() == 2 and tuple(readers.tiling_provenance(tiles).first()) == (0.25, 0.2)
    assert tuple(readers.tiling_provenance(tiles.limit(0)).first()) == (None, None)
    (tmp_path / "c.json").write_text(json.dumps({"cut_name": "c", "stem": "s"}))
    with pytest.raises(Exception, match="no tiles in"):
        readers.tile_manifests(spark, str(tmp_path)).collect()


def png(path, rgb: np.ndarray) -> None:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_quality_report_from_pictures(spark, tmp_path):
    """Sharp cuts, a flat one, one with few tiles; only sampled pictures are read."""
    rng, rows = np.random.default_rng(1), []
    for cut, n, rough in (("a_cut000", 4, 60), ("b_cut000", 4, 50), ("c_cut000", 4, 2), ("d_cut000", 1, 55), ("e_cut000", 4, 1)):
        for i in range(n):
            picture = np.full((24, 24, 3), (150, 60, 90)) + rng.integers(-rough, rough + 1, (24, 24, 1))
            path = tmp_path / f"{cut}_{i}.png"
            png(path, np.clip(picture, 0, 255).astype(np.uint8))
            rows.append((cut, str(path)))
    tiles = spark.createDataFrame(rows, "cut_name string, png_path string")
    listed = spark.createDataFrame([("e_cut000", "excluded"), ("z_cut000", "known_empty")], "cut_name string, status string")
    asked = []

    def read(paths):
        asked.extend(paths)
        return readers.images(spark, paths)

    out = quality.quality_report(tiles, read, listed, 3, 0.5, 2)
    got = [(r.cut_name, r.n_tiles, r.flag, r.listed) for r in out.collect()]
    assert len(asked) == 13
    assert {(c, n, f, w) for c, n, f, w in got} == {("a_cut000", 3, "", None), ("b_cut000", 3, "", None), ("c_cut000", 3, "blurred", None), ("d_cut000", 1, "too few tiles", None), ("e_cut000", 3, "blurred", "excluded")}
    assert {(r.cut_name, r.warning) for r in quality.quality_warnings(out, listed).collect()} == {("c_cut000", "out of focus and not excluded"), ("d_cut000", "too few tiles to judge"), ("z_cut000", "listed without a tile")}
    lines = [r.line for r in writers.markdown(out, ["cut_name", "n_tiles", "median_sharpness", "ratio", "flag"]).collect()]
    assert len(lines) == 5 and all(x.startswith("| ") and x.endswith(" |") for x in lines)
    with pytest.raises(ValueError):
        quality.quality_report(tiles.limit(0), read, listed, 3, 0.5, 2)


def test_report_tables(spark):
    v = spark.createDataFrame([("m", 1, 0.0025), ("m", 2, None), ("n", 1, 0.4735)], "model string, size int, score double")
    assert {tuple(r) for r in reports.score_grid(v, "model", "size", "score", [1, 2]).collect()} == {("m", f"{0.0025:.3f}", "-"), ("n", f"{0.4735:.3f}", "-")}
    t = spark.createDataFrame([(0.5, 0.4, 0.6), (0.5, None, 0.6), (None, 0.1, 0.2)], "v double, a double, b double")
    assert [r.t for r in t.select(reports.interval_text("v", "a", "b").alias("t")).collect()] == ["0.500 [0.400, 0.600]", "0.500", "-"]
    assert reports.expect_rows(t, 3, "rows") is t
    with pytest.raises(ValueError, match="3 rows, not 4"):
        reports.expect_rows(t, 4, "rows")
    assert [tuple(r) for r in reports.images_by_site(spark.createDataFrame([("x", "i", True), ("x", "i", True), ("x", "j", False)], "site string, image string, annotated boolean")).collect()] == [("x", 2, 1)]
    assert reports.in_both(v, v.filter("model = 'n'"), "model").collect()[0].model == "n"
