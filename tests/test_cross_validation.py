"""Every refusal of a cross-validation, its result against plain numbers, run identities and recorded lists."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cross_validation as cv

FOLDS = "fold int, specimens array<string>, slides array<string>, inner_val_specimen string, split_manifest_path string, split_manifest_sha256 string"
RUNS = "fold int, run_id string, split_manifest_sha256 string, decision_threshold double, label_rule string, area_fraction double, is_subset_run boolean"
PRED = "fold int, tile_id string, stem string, split string, y int, prob double"
SPECIMENS = {0: ["A_S_1", "A_S_2"], 1: ["B_S_1", "B_S_2"], 2: ["C_S_1", "C_S_2"]}
INNER = {0: "A_S_1", 1: "B_S_1", 2: "C_S_1"}


def tables():
    rng = np.random.default_rng(1)
    folds = [(f, s, [f"{x}_1-2" for x in s], INNER[f], f"split{f}.json", f"sha{f}") for f, s in SPECIMENS.items()]
    runs = [(f, f"run{f}", f"sha{f}", 0.5, "area", 0.05, False) for f in SPECIMENS]
    tiles = [(f"{s}-{i}", f"{s}_1-2", f, int(i % 3 == 0), round(float(rng.uniform()), 3)) for f, found in SPECIMENS.items() for s in found for i in range(8)]
    pred = [(f, t, stem, "test", y, p) for t, stem, f, y, p in tiles]
    pred += [(held, t, stem, "val", y, p) for t, stem, f, y, p in tiles for held in SPECIMENS if held != f and stem.startswith(INNER[f])]
    return folds, runs, pred, [(t, stem) for t, stem, *_ in tiles]


@pytest.fixture
def made(spark):
    def of(folds, runs, pred, tiles):
        kinds = (FOLDS, RUNS, PRED, "tile_id string, stem string")
        return [spark.createDataFrame(x, k) for x, k in zip((folds, runs, pred, tiles), kinds)]

    return of


def test_a_whole_result(made):
    folds, runs, pred, tiles = tables()
    r = cv.cross_validation(*made(folds, runs, pred, tiles)).first()
    assert (r.evaluation_design, r.is_partial, r.folds_missing, r.is_subset_run, r.n_tiles_held_out) == ("flat_grouped_3fold", False, [], False, 48)
    lifts = []
    for got in r.per_fold:
        rows = sorted(((p, y) for f, _, _, s, y, p in pred if f == got.fold and s == "test"), reverse=True)
        hits, ap = 0, 0.0
        for k, (_, y) in enumerate(rows):  # no ties
            hits += y
            ap += y * hits / (k + 1) / 6
        assert (got.n_tiles, got.n_positive, got.n_slides, got.n_specimens, got.val_n_tiles, got.val_n_specimens) == (16, 6, 2, 2, 16, 2)
        assert got.average_precision == pytest.approx(ap) and got.lift == pytest.approx(ap / (6 / 16)) and not got.undefined
        tp = sum(y for p, y in rows if p >= 0.5)
        assert got.recall == pytest.approx(tp / 6)
        lifts.append(got.lift)
    s = r.summary.lift
    assert (s.mean, s.min, s.max, s.n_defined) == (pytest.approx(np.mean(lifts)), min(lifts), max(lifts), 3) and s.iqr == pytest.approx([np.percentile(lifts, 25), np.percentile(lifts, 75)])
    assert r.summary.note.startswith("spread is a range over 3 ")


def changed(name):
    folds, runs, pred, tiles = tables()
    if name == "no run":
        runs, pred = runs[:2], [p for p in pred if p[0] < 2]
    elif name == "several runs":
        runs.append(runs[0])
    elif name == "unknown fold":
        runs.append((9, "run9", "sha9", 0.5, "area", 0.05, False))
    elif name == "other split file":
        runs[1] = (1, "run1", "old", 0.5, "area", 0.05, False)
    elif name == "other configuration":
        runs[2] = (2, "another", "sha2", 0.5, "area", 0.05, False)
    elif name == "different labellings":
        runs[2] = (2, "run2", "sha2", 0.5, "area", 0.1, False)
    elif name == "several splits":
        pred.append((0, "x", "B_S_1_1-2", "train", 0, 0.1))
    elif name == "specimen missing":
        pred = [p for p in pred if not (p[0] == 0 and p[2].startswith("A_S_2"))]
        tiles = [t for t in tiles if not t[1].startswith("A_S_2")]
    elif name == "specimen unexpected":
        pred.append((0, "y", "B_S_2_1-2", "val", 0, 0.1))
    elif name == "held out more than once":
        pred.append(pred[0])
    elif name == "never held out":
        tiles.append(("new", "A_S_1_1-2"))
    elif name == "not scorable":
        tiles = tiles[1:]
    return folds, runs, pred, tiles


@pytest.mark.parametrize("name", ["no run", "several runs", "unknown fold", "other split file", "other configuration", "different labellings", "several splits", "specimen missing", "specimen unexpected", "held out more than once", "never held out", "not scorable"])
def test_refusals(spark, made, name):
    given = made(*changed(name))
    expected = spark.createDataFrame([(f, f"run{f}") for f in SPECIMENS] + [(9, "run9")], "fold int, run_id string")
    found = {r.check for r in cv.all_breaks(*given, expected).collect()}
    assert name in found
    with pytest.raises(ValueError, match=name):
        cv.cross_validation(*given, expected)
    if name != "no run":
        with pytest.raises(ValueError, match=name):
            cv.cross_validation(*given, expected, allow_partial=True)


def test_a_partial_result_says_so(made):
    folds, runs, pred, tiles = changed("no run")
    r = cv.cross_validation(*made(folds, [(*runs[0][:-1], True), runs[1]], pred, tiles), allow_partial=True).first()
    assert (r.is_partial, r.folds_missing, r.is_subset_run, len(r.per_fold), r.evaluation_design) == (True, [2], True, 2, "flat_grouped_3fold")
    with pytest.raises(ValueError):
        cv.cross_validation(*made(folds, [], [], tiles), allow_partial=True)
    with pytest.raises(ValueError):
        cv.isolation_breaks(made(folds, runs, pred, tiles)[2], made(folds, runs, pred, tiles)[0], ("dev",))


def test_a_fold_of_one_class_is_undefined(made):
    folds, runs, pred, tiles = tables()
    r = cv.cross_validation(*made(folds, runs, [(*p[:4], 0, p[5]) if p[0] == 1 and p[3] == "test" else p for p in pred], tiles)).first()
    assert [f.undefined for f in r.per_fold] == [False, True, False] and r.summary.lift.n_defined == 2


def plain_run_id(config, cv_sha=None):
    left = {"split_manifest_path": "data/splits/split_manifest.json", "split_manifest_sha256": None, "embedding_cache_dir": None, "embedding_cache_sha256": None, "quadrant_pooling": "mean", "excluded_cuts": [], "known_empty_cuts": [], "cut_exclusions_applied": False}
    payload = {k: v for k, v in sorted(config.items()) if k != "output_dir" and not (k in left and v == left[k])}
    if cv_sha:
        payload = {k: v for k, v in payload.items() if not k.startswith("split_manifest")} | {"fold_manifest_sha256": cv_sha}
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:8]
    return f"net_own-enc-x_0512_area0540_seed7_{'cv_' if cv_sha else ''}{digest}"


def test_run_ids(spark):
    config = {"architecture": "net", "encoder_name": "own/enc x", "tile_size": 512, "label_rule": "area", "min_oocyte_area_fraction": 0.054, "seed": 7, "output_dir": "out", "quadrant_pooling": "mean", "note": 'a "quote" é', "excluded_cuts": ["a_cut001"], "split_manifest_path": "s.json", "lr": 0.001}
    df = spark.createDataFrame([({k: json.dumps(v) for k, v in config.items()},)], "config map<string, string>")
    r = df.select(cv.run_id(F.col("config")).alias("run"), cv.cv_run_id(F.col("config"), F.lit("abc")).alias("cv")).first()
    assert (r.run, r.cv) == (plain_run_id(config), plain_run_id(config, "abc"))
    folds = spark.createDataFrame(tables()[0], FOLDS)
    want = {f: plain_run_id(config | {"split_manifest_path": f"split{f}.json", "split_manifest_sha256": None}) for f in SPECIMENS}
    assert {r.fold: r.run_id for r in cv.expected_runs(df, folds).collect()} == want
    assert spark.range(1).select(cv.path_part(F.lit("//")).alias("p")).first().p == "unnamed"


RECORD = "id int, excluded_cuts array<string>, known_empty_cuts array<string>, cut_exclusions_applied boolean"


def test_recorded_lists(spark):
    mine = spark.createDataFrame([(0, ["b_cut000", "a_cut000"], [], True)], RECORD)
    records = spark.createDataFrame([(1, ["a_cut000", "b_cut000"], None, True), (2, None, None, None), (3, [], [], True), (4, ["a_cut000"], ["c_cut000"], True)], RECORD)
    got = {r.id: r.recorded for r in cv.list_conflicts(records, mine).collect()}
    assert got == {2: "no cut exclusion list (the legacy corpus)", 3: "a cut exclusion list excluding nothing and confirming empty nothing", 4: "a cut exclusion list excluding ['a_cut000'] and confirming empty ['c_cut000']"}
    for bad, why in (((1, ["a_cut000"], None, False), "has to be applied"), ((1, ["a_cut000"], ["a_cut000"], True), "listed both")):
        with pytest.raises(Exception, match=why):
            cv.recorded_lists(spark.createDataFrame([bad], RECORD)).collect()


def test_default_run(spark):
    kind = "path string, config map<string, string>, is_subset_run boolean, is_partial boolean, fold_manifest_sha256 string"
    same, other = {"lr": "1", "num_workers": "3"}, {"lr": "2"}
    rows = [("a", same, False, False, "s"), ("b", same, False, True, "s"), ("c", same | {"excluded_cuts": '["x"]'}, False, False, "s"), ("d", same, False, False, "t"), ("e", other, False, False, "s"), ("f", same, True, False, "s")]
    default = {"lr": "1", "num_workers": "7", "excluded_cuts": "[]"}
    reasons = lambda given: cv.default_run(spark.createDataFrame(given, kind), default, "s")
    assert {r.path: r.reason for r in reasons(rows).collect()} == {"a": None, "b": "partial", "c": "other exclusion list", "d": "other folds", "e": "other configuration", "f": "subset"}
    assert cv.one_default_run(reasons(rows)) == "a"
    with pytest.raises(ValueError, match="'partial': 1"):
        cv.one_default_run(reasons(rows[1:]))
    with pytest.raises(LookupError):
        cv.one_default_run(reasons(rows[4:]))
    with pytest.raises(ValueError):
        cv.one_default_run(reasons([*rows, ("g", same, False, False, "s")]))


def test_fold_table_without_a_rate(spark):
    kind = "fold int, slides array<string>, tiles map<string, long>, positives map<string, long>, positive_rate map<string, double>, specimens array<string>, inner_val_specimen string"
    f = spark.createDataFrame([(1, ["s"] * 3, {"256": 12345, "512": 0}, {"256": 1234, "512": 0}, {"256": 0.1, "512": None}, ["A", "B"], "A")], kind)
    assert cv.fold_table(f, [256, 512]).first().line == "fold 1   3 slides  256px  12,345  1,234 10.0%  512px       0      0   n/a\n        A, B  (inner val: A)"
