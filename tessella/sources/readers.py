"""Readers of annotation, manifest, prediction and log files as DataFrames.

All go through Spark's readers, so paths may lie in any store that Spark reads.
A rule that a file breaks raises when its rows are read.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import names, rings
from tessella.sources import schemas


def _fail(ok: Column, message: Column | str) -> Column:
    """True, or an error."""
    m = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, True).otherwise(F.raise_error(m).cast("boolean"))


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON files to one row for each feature; a file without features keeps one row with a null position."""
    raw = _json(spark, path, schemas.FEATURES)
    raw = raw.filter(_fail(F.coalesce(F.col("type") == "FeatureCollection", F.lit(False)), F.concat(F.lit("not a FeatureCollection: "), F.col("path"))))
    rows = raw.select(file_stem(F.col("path")).alias("stem"), F.posexplode_outer("features").alias("feature_pos", "f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    p = F.col("f.properties")
    return rows.select(
        "stem", "feature_pos", names.annotation_id(F.col("f.id"), F.col("stem"), F.col("feature_pos")).alias("id"), kind.alias("geom_type"),
        F.when(F.col("f").isNotNull(), rings.outer_ring(kind, coordinates)).alias("ring"),
        names.stage_number(p["metadata"]["ANNOTATION_DESCRIPTION"], p["name"], p["classification"]["name"]).alias("stage"), names.stage_name(p["classification"]["name"]).alias("stage_name"),
    )


def cut_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Cuts of manifests, each with a whole index, a name and a full box; an empty list is an error."""
    raw = _json(spark, path, schemas.CUTS)
    raw = raw.filter(_fail(F.coalesce(F.size("cuts") > 0, F.lit(False)), F.concat(F.lit("no cuts in "), F.col("path"))))
    rows = raw.select(file_stem(F.col("source_ndpi")).alias("stem"), "mpp_x", "mpp_y", "path", F.explode("cuts").alias("c"))
    b = F.col("c.level0_bbox")
    ok = F.col("c.index").isNotNull() & F.col("c.name").isNotNull() & b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull()
    rows = rows.filter(_fail(ok, F.concat(F.lit("an incomplete cut in "), F.col("path"))))
    return rows.select("stem", F.col("c.index").alias("cut_index"), F.col("c.name").alias("cut_name"), "c.level0_bbox.*", (b["x1"] - b["x0"]).alias("width"), (b["y1"] - b["y0"]).alias("height"), "mpp_x", "mpp_y")


def tile_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each tile of each manifest, with the manifest's path and its tiling settings; no manifest, or one without a list, is an error."""
    raw = _json(spark, path, schemas.TILES)
    if not raw.head(1):
        raise ValueError(f"no tile manifests at {path}")
    some = F.coalesce("tiles", F.raise_error(F.concat(F.lit("no tiles in "), F.col("path"))).cast(raw.schema["tiles"].dataType))  # a filter could be moved behind the explosion's own
    rows = raw.select("stem", "cut_name", "path", "min_tissue_fraction", "overlap", F.explode(some).alias("t"))
    return rows.select(
        "stem", "cut_name", *[F.col(f"t.{c}").alias(c) for c in ("tile_id", "tile_size", "row", "col")], "t.cut_local_bbox.*", *[F.col(f"t.{c}").alias(c) for c in ("pad_right", "pad_bottom", "tissue_fraction", "n_oocytes", "stages", "annotations", "png_path")], "path", "min_tissue_fraction", "overlap"
    )


def tiling_provenance(tiles: DataFrame, path: str = "path") -> DataFrame:
    """One row with the tiling settings of the first manifest in order of paths; nulls without a manifest."""
    return tiles.agg(F.min_by(F.struct("min_tissue_fraction", "overlap"), path).alias("first")).select("first.*")


def split_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = _json(spark, path, schemas.SPLITS)
    raw = raw.filter(_fail(F.coalesce(F.size("slides") > 0, F.lit(False)), F.concat(F.lit("no slides in "), F.col("path"))))
    return raw.select(F.explode("slides").alias("stem", "s")).select("stem", "s.split", "s.location", F.transform_keys("s.stage_counts", lambda k, v: k.cast("int")).alias("stage_counts"))


def fold_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, schemas.FOLDS).select("n_folds", F.inline("folds"))


def changed_fold_files(folds: DataFrame, directory: str) -> DataFrame:
    """Folds whose split file is missing or has another SHA-256 than recorded."""
    files = folds.sparkSession.read.format("binaryFile").load(directory).select(F.regexp_replace("path", r"^.*/", "").alias("name"), F.sha2("content", 256).alias("found"))
    wanted = folds.select("fold", F.regexp_replace("split_manifest_path", r"^.*/", "").alias("name"), F.col("split_manifest_sha256").alias("recorded"))
    return wanted.join(files, "name", "left").filter(~F.col("recorded").eqNullSafe(F.col("found")))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """The strict list of excluded cuts: rows (line, cut_name, status, reason, date), or an error that names the line.

    Fields may be quoted, inside one line; columns come in any order, and
    reason and date may lack.  Blank lines are skipped; known statuses, names
    that end in ``_cutNNN``, and no repetition are demanded.  It is one small file.
    """
    text = spark.read.text(path, wholetext=True).first()
    rows = csv.reader(io.StringIO(text[0].removeprefix("\ufeff") if text else "", newline=""), strict=True)
    seen: set[str] = set()
    out = []
    try:
        header = [c.strip() for c in next(rows, [])]
        known = [c for c in header if c]
        if not {"cut_name", "status"} <= set(known) or set(known) - set(schemas.EXCLUSIONS) or len(set(known)) != len(known):
            raise ValueError("line 1: the columns are cut_name, status, and maybe reason and date")
        for fields in rows:
            i = rows.line_num
            if any(re.search(r"[\r\n]", x) for x in fields):
                raise ValueError(f"line {i}: a quoted field goes over lines")
            if len(fields) > len(header) or any(x.strip() for c, x in zip(header, fields) if not c):
                raise ValueError(f"line {i}: more fields than columns")
            row = {c: x.strip() for c, x in zip(header, fields) if c}
            if not any(row.values()):
                continue
            name, status = row.get("cut_name", ""), row.get("status")
            if not re.fullmatch(r".+_cut\d{3}", name):
                raise ValueError(f"line {i}: {name!r} is no cut")
            if status not in ("excluded", "known_empty"):
                raise ValueError(f"line {i}: unknown status {status!r}")
            if name in seen:
                raise ValueError(f"line {i}: {name} is listed twice")
            seen.add(name)
            out.append((i, name, status, row.get("reason") or None, row.get("date") or None))
    except csv.Error as error:
        raise ValueError(f"line {rows.line_num}: {error}") from error
    return spark.createDataFrame(out, "line int, cut_name string, status string, reason string, date string")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction logs; NaN becomes null."""
    raw = spark.read.schema(schemas.PREDICTIONS).option("header", True).csv(path)
    return raw.withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))


def composition_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPOSITION).json(path)


def slide_metadata(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """All-string CSV with cleaned flags; a site given by the caller stands for a missing column."""
    raw = spark.read.option("header", True).csv(path)
    for c in ("Site", "Season", "Polyp No", "Cut no", "Oosorbtion", "Scan", "IMAGE", "Date/Time"):
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(site if c == "Site" else None).cast("string"))
    return raw.select(
        F.trim("Site").alias("site"), F.trim("Season").alias("season"), F.trim("`Polyp No`").alias("polyp"), F.trim("`Cut no`").alias("cut"), names.yes_no(F.col("Oosorbtion")).alias("flag"), names.yes_no(F.col("Scan")).alias("scan"),
        F.trim("IMAGE").alias("image"), names.date_or_null(F.col("`Date/Time`"), "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd").alias("day"),
    )


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; one that can't be decoded is an error that names it, not a missing row."""
    read = spark.read.format("image").load(path)
    return read.filter(_fail(F.col("image.nChannels") > 0, F.concat(F.lit("not an image: "), F.col("image.origin"))))


def review_sessions(spark: SparkSession, meta: str, labels: str | None = None) -> DataFrame:
    """Tiles of a session with labels: from two files, or from one older file that holds both."""
    tile = "tile_id: STRING, display_index: INT, png_filename: STRING, tile_size: INT, ground_truth: BOOLEAN"
    if labels is None:
        rows = _json(spark, meta, f"session_id STRING, tiles ARRAY<STRUCT<{tile}, collaborator_label: BOOLEAN, labelled_at: TIMESTAMP>>")
        return rows.select("session_id", F.inline("tiles"))
    tiles = _json(spark, meta, f"session_id STRING, tiles ARRAY<STRUCT<{tile}>>").select("session_id", F.inline("tiles"))
    given = _json(spark, labels, "session_id STRING, labels ARRAY<STRUCT<display_index: INT, tile_id: STRING, collaborator_label: BOOLEAN, labelled_at: TIMESTAMP>>").select("session_id", F.inline("labels"))
    from tessella.operators.review import strict_join

    return strict_join(tiles, given.drop("session_id"))


def expected_files(stems: DataFrame, listing: DataFrame, ending: str = ".ndpi") -> DataFrame:
    """Each stem's expected file with whether it is there and its size.  ``listing`` has path and length, as of the binaryFile source."""
    found = listing.select(file_stem(F.col("path")).alias("stem"), "length").groupBy("stem").agg(F.max("length").alias("length"))
    return stems.select("stem").distinct().join(found, "stem", "left").select("stem", F.concat("stem", F.lit(ending)).alias("file_name"), F.col("length").isNotNull().alias("present"), "length")


def image_of_stem(stems: DataFrame, listing: DataFrame, endings: list[str]) -> DataFrame:
    """For each stem the path whose ending comes first in the list."""
    rank = F.array_position(F.array(*map(F.lit, endings)), F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)))
    files = listing.select(file_stem(F.col("path")).alias("stem"), "path", rank.alias("rank")).filter("rank > 0")
    return stems.join(files.groupBy("stem").agg(F.min_by("path", F.struct("rank", "path")).alias("path")), "stem", "left")


def slide_size(slides: DataFrame, outlines: DataFrame) -> DataFrame:
    """Width and height: the image's, else the given ones, else what the outlines reach, plus one."""
    b = rings.bounds(F.col("ring"))
    reach = outlines.select("stem", b.alias("b")).groupBy("stem").agg((F.ceil(F.max("b.x1")) + 1).alias("__w"), (F.ceil(F.max("b.y1")) + 1).alias("__h"))
    return slides.join(reach, "stem", "left").select(*slides.columns, F.coalesce("image_width", "given_width", "__w").alias("width"), F.coalesce("image_height", "given_height", "__h").alias("height"))


def matching_runs(runs: DataFrame, default: dict[str, str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """Runs with the fields in which their recorded configuration (a map) differs from the default; none: it matches."""
    rows = runs.withColumn("__d", F.create_map(*[F.lit(x) for kv in default.items() for x in kv]))
    keys = F.array_except(F.array_union(F.map_keys("config"), F.map_keys("__d")), F.array(*map(F.lit, ignored)).cast("array<string>"))
    differs = F.filter(keys, lambda k: ~F.try_element_at("config", k).eqNullSafe(F.try_element_at("__d", k)))
    return rows.withColumn("differs", F.sort_array(differs)).drop("__d")


def run_lengths(runs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Each run's epochs and best epoch, null without a log."""
    e = epochs.groupBy("run").agg(F.count(F.lit(1)).alias("n_epochs"), F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("best_epoch"))
    return runs.join(e, "run", "left")


def exclusion_record(listed: DataFrame) -> DataFrame:
    """The list as it is recorded: sorted names by status, and a hash that ignores order, reasons and dates."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("cut_name"))))
    lines = F.array_join(F.sort_array(F.collect_list(F.concat("cut_name", F.lit(","), "status"))), "\n")
    return listed.agg(of("excluded").alias("excluded"), of("known_empty").alias("known_empty"), F.sha2(lines, 256).alias("sha256"))


def latest_only(df: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
