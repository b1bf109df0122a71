"""Writers of manifests, reports and logs, all by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.reports import null_nan


def feature_collections(assigned: DataFrame, cuts: DataFrame, path: str) -> None:
    """One FeatureCollection for each cut, empty ones too, by folders of the cut's name."""
    coordinates = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct("cut_index", F.col("method").alias("assignment_method")).alias("properties"))
    per = assigned.filter("cut_name IS NOT NULL").groupBy("cut_name").agg(F.collect_list(feature).alias("features"))
    full = cuts.select("cut_name").join(per, "cut_name", "left")
    empty = F.coalesce("features", F.array().cast(per.schema["features"].dataType))
    full.select("cut_name", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), empty.alias("features"))).alias("value")).write.partitionBy("cut_name").text(path)


def tile_manifest(tiles: DataFrame, path: str) -> None:
    tiles.write.partitionBy("tile_size").parquet(path)


def one_document(df: DataFrame, path: str) -> None:
    """A small table as JSON lines of one file; NaN becomes null."""
    null_nan(df).coalesce(1).write.option("ignoreNullFields", False).json(path)


def fixed_columns(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV of exactly these columns; a missing one is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    df.select(*columns).write.option("header", True).csv(path)


def hashed_folds(splits: DataFrame, path: str) -> DataFrame:
    """Each held-out fold's split file first; gives their SHA-256 for the manifest, from what was written."""
    text = splits.groupBy("held_out").agg(F.sort_array(F.collect_list(F.struct("stem", "split"))).alias("slides")).select("held_out", F.to_json(F.struct("slides")).alias("value"))
    text.write.partitionBy("held_out").text(path)
    files = splits.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"held_out=(\d+)", 1).cast("int").alias("fold"), F.sha2("content", 256).alias("sha256"))


def fold_manifest(folds: DataFrame, splits: DataFrame, path: str, version: str, created: str) -> None:
    """Each fold's split file, then the manifest ``path``/fold_manifest that carries their paths and SHA-256.

    ``folds`` has fold, specimens, slides, inner_val_specimen and maps by tile
    size; ``splits`` is ``splits.fold_splits`` (held_out, stem, split).
    """
    hashed = hashed_folds(splits, f"{path}/splits").withColumnRenamed("sha256", "split_manifest_sha256")
    rows = folds.join(hashed, "fold").withColumn("split_manifest_path", F.format_string(f"{path}/splits/held_out=%d", "fold"))
    whole = rows.agg(F.count(F.lit(1)).cast("int").alias("n_folds"), F.array_sort(F.collect_list(F.struct("fold", *[c for c in rows.columns if c != "fold"])), lambda a, b: a["fold"] - b["fold"]).alias("folds"))
    if whole.first().n_folds != folds.count():
        raise ValueError("a fold has no split file")
    one_document(whole.select(F.lit(version).alias("manifest_version"), F.lit(created).alias("created"), "n_folds", "folds"), f"{path}/fold_manifest")


def detection_classes(classes: dict[int, str], stems: DataFrame, path: str, shares: dict[str, float], seed: int = 42) -> None:
    """The list of class names by index, and a list of images for each split, dealt in a seeded order."""
    from tessella.operators.index import random_lists

    spark = stems.sparkSession
    names = [classes.get(i, f"class_{i}") for i in range(max(classes) + 1)]
    spark.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.text(f"{path}/classes")
    random_lists(stems.select("stem").distinct(), shares, seed).select("split", F.concat("stem", F.lit(".png")).alias("value")).write.partitionBy("split").text(f"{path}/lists")


def detection_labels(lines: DataFrame, key: str, path: str) -> None:
    """Columns key, line: a text of sorted lines for each key."""
    lines.groupBy(key).agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("value")).write.partitionBy(key).text(path)


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of text for each row, as of a Markdown table; missing values are dashes."""
    cells = [F.coalesce(F.when(~F.isnan(c), F.format_string("%.3f", c)) if t in ("double", "float") else F.col(c).cast("string"), F.lit("-")) for c, t in df.select(*columns).dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def review_session(tiles: DataFrame, path: str) -> None:
    """Session tiles and blank labels apart; the labels hold nothing that gives the truth away."""
    tiles.write.json(f"{path}/session_meta")
    tiles.select("tile_id", "display_index", F.lit(None).cast("boolean").alias("collaborator_label"), F.lit(None).cast("timestamp").alias("labelled_at")).write.option("ignoreNullFields", False).json(f"{path}/labels")


def append_log(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def not_yet_written(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose output isn't there yet."""
    return units.join(done.select(key).distinct(), key, "left_anti")
