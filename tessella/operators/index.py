"""The tile index: tiles joined with exclusions, splits and labels, and the rules it has to keep.

Rules give a table of what breaks them, so that all breaks are seen at once;
``hold`` turns such a table into an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import labels, names
from tessella.operators.ranking import ranked
from tessella.operators.splits import hash_order

INDEX = ["tile_id", "png_path", "stem", "cut_name", "tile_size", "n_oocytes", "tissue_fraction", "oocyte_area_fraction", "label", "is_ambiguous", "split"]


def tile_index(tiles: DataFrame, splits: DataFrame, listed: DataFrame, threshold: float = 0.05, rule: str = "area", tissue: float = 0.0) -> DataFrame:
    """One row for each tile of a listed slide outside the excluded cuts, with its label and split.

    ``tiles`` has the fraction and the number of centroids; the fraction is null
    under the centroid rule.  A limit on tissue over 0 drops tiles with less, or
    with none known.  A slide without a split is an error.
    """
    gone = listed.filter("status = 'excluded'").select("cut_name")
    kept = tiles.join(gone, "cut_name", "left_anti")
    if tissue > 0:
        kept = kept.filter(F.col("tissue_fraction") >= tissue)
    known = kept.join(splits.select("stem", F.col("split").alias("__s")), "stem", "left")
    split = F.coalesce("__s", F.raise_error(F.concat(F.lit("a slide without a split: "), "stem")).cast("string"))
    fraction = F.col("area_fraction") if rule == "area" else F.lit(None).cast("double")
    label = labels.label_by(rule, F.col("area_fraction"), F.col("n_oocytes"), threshold)
    out = known.withColumns({"oocyte_area_fraction": fraction, "label": label, "split": split}).withColumn("is_ambiguous", F.col("label") == "ambiguous")
    return out.select(*INDEX)


def training_rows(index: DataFrame, split: str) -> DataFrame:
    """A split's rows without the ambiguous ones, with the target."""
    rows = index.filter((F.col("split") == split) & ~F.col("is_ambiguous"))
    return rows.withColumn("target", labels.binary_target(F.col("label")))


def tissue_counts(tiles: DataFrame, by: str, least: float) -> DataFrame:
    """Kept and dropped tiles by group."""
    enough = F.coalesce(F.col("tissue_fraction") >= least, F.lit(False))
    return tiles.groupBy(by).agg(F.count_if(enough).alias("n_kept"), F.count_if(~enough).alias("n_dropped"))


def stage_rejects(df: DataFrame, low: int = 0, high: int = 4) -> DataFrame:
    """Annotations by what becomes of them: kept, unlabelled, out of range."""
    fate = F.when(F.col("stage").isNull(), "unlabelled").when(F.col("stage").between(low, high), "kept").otherwise("out of range")
    return df.groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


def unusable_outlines(outlines: DataFrame, area: Column) -> DataFrame:
    """By cut: outlines, and how many have too few points or no area; a cut with outlines but none usable is marked."""
    bad = (F.coalesce(F.size("ring"), F.lit(0)) < 3) | (area <= 0)
    return outlines.groupBy("cut_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_unusable")).withColumn("none_usable", F.col("n") == F.col("n_unusable"))


def first_slides(index: DataFrame, split: str, n: int) -> DataFrame:
    """All rows but those of a split's slides behind its first n in order; slides are ranked, not rows."""
    stems = index.filter(F.col("split") == split).select("stem").distinct()
    first = stems.withColumn("__k", F.row_number().over(Window.orderBy("stem"))).filter(F.col("__k") <= n).select("stem")  # slides are few
    return index.filter(F.col("split") != split).unionByName(index.filter(F.col("split") == split).join(first, "stem", "left_semi").select(*index.columns))


def exclusion_breaks(cuts: DataFrame, annotated: DataFrame, listed: DataFrame) -> DataFrame:
    """Columns check, detail: names that aren't cuts, known-empty cuts with annotations, cuts without any that aren't listed, and everything excluded."""
    names_ = cuts.select("cut_name").distinct()
    ann = annotated.select("cut_name").distinct()
    row = lambda df, check: df.select(F.lit(check).alias("check"), F.col("cut_name").alias("detail"))
    unknown = row(listed.join(names_, "cut_name", "left_anti"), "listed but no cut")
    empty = row(listed.filter("status = 'known_empty'").join(ann, "cut_name", "left_semi"), "known empty but annotated")
    silent = row(names_.join(ann, "cut_name", "left_anti").join(listed, "cut_name", "left_anti"), "not annotated and not listed")
    left = names_.join(listed.filter("status = 'excluded'"), "cut_name", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    nothing = left.filter("n = 0").select(F.lit("all excluded").alias("check"), F.lit("").alias("detail"))
    return unknown.unionByName(empty).unionByName(silent).unionByName(nothing)


def key_breaks(df: DataFrame, key: str, size: str) -> DataFrame:
    """Keys that occur more than once or under more than one size."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(size).alias("n_sizes"))
    return n.filter("n > 1 OR n_sizes > 1")


def hold(df: DataFrame, breaks: DataFrame, message: str) -> DataFrame:
    """``df``, or an error with the first three breaks, which are looked up now."""
    if some := breaks.limit(3).collect():
        raise ValueError(f"{message}: {[r.asDict() for r in some]}")
    return df


def class_positions(df: DataFrame, order: str, label: str) -> DataFrame:
    """Each row's position in a label's list, in order of a key."""
    return ranked(df, [F.col(order)], [label], "position").withColumn("position", F.col("position") - 1)


def prediction_join(index: DataFrame, predictions: DataFrame) -> DataFrame:
    return index.join(predictions.select("tile_id", "prob"), "tile_id", "left")


def prediction_mismatches(index: DataFrame, predictions: DataFrame) -> DataFrame:
    """How many predictions disagree with the index in split or label, or aren't in it."""
    both = predictions.select("tile_id", F.col("split").alias("__s"), F.col("label").alias("__l")).join(index.select("tile_id", "split", "label"), "tile_id", "left")
    return both.agg(F.count_if(F.col("split").isNull()).alias("n_unknown"), F.count_if(F.col("split") != F.col("__s")).alias("n_other_split"), F.count_if(F.col("label") != F.col("__l")).alias("n_other_label"))


def leakage_flags(test: DataFrame, train: DataFrame, unit: str = "specimen") -> DataFrame:
    """``test`` with whether its unit stands in train, too."""
    seen = train.select(unit).distinct().withColumn("__t", F.lit(True))
    return test.join(seen, unit, "left").withColumn("leaks", F.coalesce("__t", F.lit(False))).drop("__t")


def metric_differences(recorded: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Metrics (keys, value) that differ by more than the tolerance or stand on one side only."""
    both = recorded.withColumnRenamed("value", "recorded").join(recomputed.withColumnRenamed("value", "recomputed"), keys, "full_outer")
    same = F.coalesce(F.abs(F.col("recorded") - F.col("recomputed")) <= tolerance, F.col("recorded").isNull() & F.col("recomputed").isNull())
    return both.filter(~same)


def cut_view(cut: str, cuts: DataFrame, index: DataFrame, sizes: list[int]) -> DataFrame:
    """A cut's tiles of some sizes with the cut's scale; an unknown cut is an error."""
    one = cuts.filter(F.col("cut_name") == cut).select("cut_name", "width", "height", "mpp_x", "mpp_y")
    if one.isEmpty():
        raise ValueError(f"no cut {cut}")
    return one.join(index.filter((F.col("cut_name") == cut) & F.col("tile_size").isin(sizes)), "cut_name", "left")


def ambiguous_per_split(index: DataFrame, splits: list[str] = ("train", "val", "test")) -> DataFrame:
    return index.groupBy("tile_size").agg(*[F.count_if((F.col("split") == s) & F.col("is_ambiguous")).alias(f"ambiguous_{s}") for s in splits])


def train_summary(index: DataFrame) -> DataFrame:
    """Of scored rows by split: tiles, positives, slides, specimens."""
    rows = index.filter(~F.col("is_ambiguous")).withColumn("specimen", names.specimen_of(F.col("stem")))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_tiles"), F.count_if(F.col("label") == "positive").alias("n_positive"), F.countDistinct("stem").alias("n_slides"), F.countDistinct("specimen").alias("n_specimens"))


def manifest_counts(tiles: DataFrame) -> DataFrame:
    """Tiles by cut and size: how many, with annotations, and padded."""
    return tiles.groupBy("cut_name", "tile_size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_points") > 0).alias("n_annotated"), F.count_if((F.col("pad_right") > 0) | (F.col("pad_bottom") > 0)).alias("n_padded"))


def cut_reconciliation(cuts: DataFrame) -> DataFrame:
    """Slides whose number of cuts isn't what their name says: columns stem, expected, found."""
    found = cuts.groupBy("stem").agg(F.count(F.lit(1)).alias("found"))
    return found.withColumn("expected", names.cut_count(F.col("stem"))).filter(F.col("expected").isNotNull() & (F.col("expected") != F.col("found"))).select("stem", "expected", "found")


def split_breaks(manifest: DataFrame, slides: DataFrame, scarce: Column) -> DataFrame:
    """Columns check, detail: slides on one side only, scarce slides outside train, sites that miss a split."""
    row = lambda df, check: df.select(F.lit(check).alias("check"), F.col("stem").alias("detail"))
    a, b = manifest.select("stem"), slides.select("stem")
    site = manifest.groupBy("location").agg(F.countDistinct("split").alias("n")).filter("n < 3").select(F.lit("a site misses a split").alias("check"), F.col("location").alias("detail"))
    return row(a.exceptAll(b), "not a slide").unionByName(row(b.exceptAll(a), "not split")).unionByName(row(manifest.filter(scarce & (F.col("split") != "train")), "scarce outside train")).unionByName(site)


def epoch_means(log: DataFrame) -> DataFrame:
    """Loss by epoch: each batch alike, and by its rows."""
    return log.groupBy("epoch").agg(F.avg("loss").alias("loss_by_batch"), (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss_by_row"))


def positive_candidates(tiles_with_annotations: DataFrame) -> DataFrame:
    """One row for each annotation of a tile."""
    return tiles_with_annotations.select("*", F.explode("annotations").alias("annotation"))


def random_lists(slides: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """Slides dealt to named lists, max(1, int(n * share)) each in a seeded order, the rest to train."""
    n = slides.agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.orderBy(hash_order(seed, F.col("stem")), "stem"))  # slides are few
    at, split = F.lit(0), F.lit("train")
    out = slides.withColumn("__k", k).crossJoin(F.broadcast(n))
    bounds = []
    for name, share in shares.items():
        size = F.greatest(F.lit(1), F.floor(F.col("n") * share))
        bounds.append((name, at, at + size))
        at = at + size
    for name, low, high in bounds:
        split = F.when((F.col("__k") > low) & (F.col("__k") <= high), name).otherwise(split)
    return out.select(*slides.columns, split.alias("split"))


def cut_sources(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts with both an image and annotations, and those with one of them only (cut_name, missing)."""
    a, b = images.select("cut_name", "path"), annotations.filter("n > 0").select("cut_name")
    lone = a.join(b, "cut_name", "left_anti").select("cut_name", F.lit("annotations").alias("missing")).unionByName(b.join(a, "cut_name", "left_anti").select("cut_name", F.lit("image").alias("missing")))
    return a.join(b, "cut_name"), lone


def with_content_hash(embeddings: DataFrame) -> DataFrame:
    """Each embedding with a SHA-256 of its numbers, by which a rebuilt table is compared."""
    return embeddings.withColumn("sha256", F.sha2(F.to_json("sub"), 256))
